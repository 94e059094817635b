"""URL filters: rules by host and path, and trust propagated over host links.

Rules come first: a rule ``host/path`` fits its host and all subdomains if the url's path
starts with the rule's; the longest wins. Urls that no rule fits get their host's verdict from
the link graph: personalised PageRank from trusted seeds along links (a site that trusted
sites link to), and from blocked seeds against them (a site that links to blocked sites). A
host's seed value is the share of its pages that rules allow or block; a host is blocked if
its distrust less its trust, in units of a seed's own value, is ``LIMIT`` or more.

Links are the page's hrefs with a host (a scheme may lack). They are summed to weighted host edges before
anything else moves, so a host with a third of all pages is one row; both walks are one table
of edges with a direction, and each round is one join and one sum, written to the shared
folder every few rounds. Rounds go on until what is still to come can change no value by
``TOLERANCE``, ``ROUNDS`` at most (at that number a walk has 1e-7 of its weight left).

Null urls and urls without ``://`` have empty host and path, no rule fits them, and they are
allowed. Null pages have no links. Repeated rows get repeated results; an empty table gives
an empty one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernloom.llm.common import staged

#: Fixed values: (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
ROUNDS, DAMPING, LIMIT, STAGE_EVERY = 100, 0.85, 0.5, 4
TOLERANCE = 1e-4
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, summed."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(host.alias("src"), F.explode(found).alias("to"))
    links = links.select("src", host_of(F.regexp_replace("to", "^//", "any://")).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) in units of a seed's own value. ``seeds``: host, allowed, blocked."""
    edges = staged(edges, "host-edges")
    both = edges.select(F.lit(0).alias("way"), "src", "dst", "n").unionByName(
        edges.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("way", "src").agg(F.sum("n").alias("all"))
    both = staged(both.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "host-walks")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("allowed").alias("v")), F.struct(F.lit(1).alias("way"), F.col("blocked").alias("v")))).alias("s"))
    start = staged(start.select("host", "s.way", "s.v").where("v > 0"), "host-seeds")
    now = start
    for i in range(0 if edges.isEmpty() else rounds):
        moved = now.select("way", F.col("host").alias("src"), "v").join(both, ["way", "src"]).select(F.col("dst").alias("host"), "way", (F.col("v") * F.col("w") * damping).alias("v"))
        before, now = now, start.unionByName(moved).groupBy("host", "way").agg(F.sum("v").alias("v"))
        if i % STAGE_EVERY == STAGE_EVERY - 1:
            now = staged(now, "host-values")
            # values only grow; the rounds to come add at most damping / (1 - damping) of the last change
            old = before.select("host", "way", F.col("v").alias("o"))
            change = now.join(old, ["host", "way"], "left").agg(F.sum(F.col("v") - F.coalesce("o", F.lit(0.0)))).first()[0]
            if (change or 0.0) * damping / (1 - damping) < tolerance:
                break
    value = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("v"))), F.lit(0.0))
    return now.groupBy("host").agg(value(0).alias("trust"), value(1).alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (replacing columns of these names)."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_v": verdict})
    share = lambda kind: F.avg(F.when(F.col("_v") == kind, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    values = propagate(host_edges(pages, host, html_col), seeds)
    bad = values.where(F.col("distrust") - F.col("trust") >= limit).select("host", F.lit("block").alias("_h"))
    # hosts that no rule settles are few rows beside the pages; a hot host's pages are split by AQE
    out = ruled.join(bad, "host", "left").withColumn("verdict", F.coalesce("_v", "_h", F.lit("allow")))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, "host", "path", "rule", "verdict")


def op10_url_filter(pages: DataFrame) -> DataFrame:
    """The contract's columns; the html is read for its links only."""
    return judge_urls(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
