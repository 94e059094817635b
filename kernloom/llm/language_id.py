"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent n-grams (1 to 3 characters of words padded by one
blank on either side; letters only, lower case), most frequent first, ties by the n-gram's
code. A document's profile is compared with each language's by the out-of-place distance:
the sum of rank differences, an n-gram that the language lacks counting as ``depth``. The
least distance wins, ties by the language's name. The score is 1 minus the distance over the
greatest possible one.

Language profiles are counted on a bounded sample of labelled training documents:
about ``per_language`` whole documents for each language, those whose id's hash is in the
language's share (all, where it has fewer). Rows of one id are drawn together. Counting at the executors, one row of counts per task and language n-gram; the driver gets
profiles of ``depth`` entries per language.

Null texts and texts without a letter are ``und``, score 0. Rows with a null language or a
null doc_id are never learnt from. Without any training row all documents are ``und``. Whole
texts are read, in any length. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernloom.llm.common import broadcast_if_few, crc_mod, staged

DEPTH = 300
PER_LANGUAGE = 2000
UNKNOWN = "und"
_BITS = 21  # of a code point
BLANK = 1


class _Letters:
    """Code point -> lower-case letter code, BLANK for all that is no letter; filled on demand."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[raw]
        if (out < 0).any():
            for c in np.unique(raw[out < 0]):
                ch = chr(c)
                low = ch.lower()
                self.table[c] = ord(low[0]) if ch.isalpha() else BLANK
            out = self.table[raw]
        return out


def gram_codes(text: str, letters: _Letters) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams, repeats included. A run of non-letters is one blank."""
    codes = letters.codes(text).astype(np.int64)
    padded = np.full(len(codes) + 2, BLANK, np.int64)
    padded[1:-1] = codes
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != BLANK) | (padded[:-1] != BLANK)
    s = padded[keep]
    if len(s) < 3:
        return np.empty(0, np.int64)
    two = s[:-1] << _BITS | s[1:]
    three = s[:-2] << 2 * _BITS | two[1:]
    return np.concatenate([s[s != BLANK], two, three[s[1:-1] != BLANK]])


def ranked(codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` most frequent codes, ties by code (codes come sorted)."""
    if len(codes) > depth:
        # all that are at least as frequent as the last one wanted, then a stable sort of those
        floor = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.argsort(-counts, kind="stable")[:depth]]


def profile(text: str, letters: _Letters, depth: int) -> np.ndarray:
    grams = gram_codes(text, letters)
    grams.sort()
    if not len(grams):
        return grams
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return ranked(grams[starts], np.diff(np.append(starts, len(grams))), depth)


def learn_profiles(
    docs: DataFrame, depth: int = DEPTH, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"
) -> dict[str, np.ndarray]:
    """Profiles of the languages in ``docs``."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    named = rows.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    # one row a language; no group of ids is ranked in one place
    sizes = broadcast_if_few(staged(named.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "language-sizes"))
    drawn = F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 40)) < F.lit(float(per_language << 40)) / F.col("n")
    sample = named.join(sizes, "l").where(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        found: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in found.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["l", "g", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = gram_codes(text, letters)
                found.setdefault(lang, []).append(grams)
                held += len(grams)
                if held > 4_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    counts = sample.select("l", "t").mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rn", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("rn") <= depth)
    out: dict[str, list] = {}
    for r in best.select("l", "g", "rn").collect():
        out.setdefault(r["l"], []).append((r["rn"], r["g"]))
    return {lang: np.array([g for _, g in sorted(v)], np.int64) for lang, v in sorted(out.items())}


class Scorer:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], depth: int) -> None:
        self.langs, self.depth = sorted(profiles), depth
        self.grams = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))
        self.letters = _Letters()

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not len(self.grams):
            return UNKNOWN, 0.0
        own = profile(text, self.letters, self.depth)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        there = self.ranks[:, at]
        places = np.where(there < 0, self.depth, np.abs(there - np.arange(len(own))))
        distance = places.sum(1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.depth * len(own))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], depth: int = DEPTH, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score"
) -> DataFrame:
    """``docs`` with two more columns (they replace columns of these names)."""
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    docs = docs.select(*kept)
    at = kept.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles, depth)
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column(at)]
            langs = pa.array([x[0] for x in found], pa.string())
            scores = pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, scores], [*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def op4_language_id(docs: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 4) == 2
    train = docs.where(~held).select("doc_id", "text", "lang")
    profiles = learn_profiles(train)
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    # the text goes through Python and is dropped there: only its id comes back
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles, DEPTH)
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema)
