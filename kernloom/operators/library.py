"""Search in gene-set libraries: library(library, group, gene), a local table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Organisms that can be asked for.
ORGANISMS = ("human", "mouse", "yeast", "fly", "fish", "worm")


def check_organism(organism: str) -> str:
    """The organism's lower-case name, or ValueError."""
    if organism.lower() not in ORGANISMS:
        raise ValueError(f"organism must be one of {ORGANISMS}")
    return organism.lower()


def other_organism(organism: str) -> str:
    return {"human": "mouse", "mouse": "human"}.get(check_organism(organism), "")


def _terms(terms) -> list[str]:
    if isinstance(terms, str):
        return [terms]
    return list(terms) if isinstance(terms, (list, tuple)) else []


def any_term(name: Column, terms) -> Column:
    """Whether the name holds any of the terms, in any case. '' holds in every name; terms that
    are neither text nor a list hold nowhere."""
    found = [F.lower(name).contains(t.lower()) for t in _terms(terms)]
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def check_groups(groups: DataFrame, key_terms="", blacklist=False, other_org: str = "") -> DataFrame:
    """Distinct groups with key_terms_in and blacklist_in; groups naming the other organism go
    (an empty name drops none)."""
    rows = groups.select(*[c for c in ("library", "group") if c in groups.columns]).distinct()
    if other_org:
        rows = rows.where(~F.lower("group").contains(other_org.lower()))
    return rows.withColumns({"key_terms_in": any_term(F.col("group"), key_terms), "blacklist_in": any_term(F.col("group"), blacklist)})


def check_libraries(library: DataFrame, key_terms="", blacklist=False, other_org: str = "") -> tuple[DataFrame, DataFrame]:
    """(summary per library, tally per group). Libraries without groups left vanish."""
    tally = check_groups(library, key_terms, blacklist, other_org)
    wanted = [F.count(F.lit(1)).alias("n_groups")]
    if key_terms:
        wanted.append(F.sum(F.col("key_terms_in").cast("bigint")).alias("n_key_terms"))
    if blacklist:
        wanted.append(F.sum(F.col("blacklist_in").cast("bigint")).alias("n_blacklist"))
    return tally.groupBy("library").agg(*wanted).orderBy("library"), tally


def find_candidates(library: DataFrame, organism: str = "human", key_terms="", blacklist=False) -> DataFrame:
    other = other_organism(organism)
    if other:
        library = library.where(~F.lower("library").contains(other))
    return check_libraries(library, key_terms, blacklist, other)[0]


def gene_groupings(library: DataFrame, name: str, organism: str = "human", key_terms="", blacklist=False, min_overlap: int = 2, genes: DataFrame | None = None) -> DataFrame:
    """(group, gene) of one library's groups that fit the terms and share at least
    ``min_overlap`` genes with ``genes`` (if given). Groups keep all their genes."""
    rows = library.where(F.col("library") == name).select("group", "gene").distinct()
    tally = check_groups(rows, key_terms, blacklist, other_organism(organism))
    kept = tally.where(F.col("key_terms_in") & ~F.col("blacklist_in")).select("group")
    if genes is not None:
        shared = rows.join(genes.select("gene").distinct(), "gene", "left_semi")
        enough = shared.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_overlap)
        kept = kept.join(enough.select("group"), "group", "left_semi")
    return rows.join(kept, "group", "left_semi")
