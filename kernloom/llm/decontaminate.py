"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Text is lower-cased and white space folded. Each benchmark item is cut into windows (items up
to ``WHOLE`` characters are one window; longer ones overlap by half), each with an edit budget
k of a tenth of its length. A region of a document within k edits of a window shares at least
``length + 1 - (k + 1) * q`` q-grams with it, whose diagonals (place in the text less place in
the window) lie within k of each other. Hits are counted in bands of 2(k + 1) diagonals that
overlap by half, so one band holds them all; bands that reach the bound are verified by an
alignment of the window against the band's region (free ends in the text). q is ``Q``, or the
largest at which the bound is one or more: windows of each q have an index of their own.

Documents are read whole, in slices that overlap by more than a region. The benchmark is taken
in blocks of ``BLOCK`` characters at most; each block is one pass over the documents, and its
index is what travels to the executors.

Null and empty texts and items match nothing; items shorter than 2 * Q are matched by plain
inclusion of the folded item. Items of one id are one item. Repeated documents give repeated
results, an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, SHARE, WHOLE, WINDOW = 8, 0.1, 200, 160
BLOCK = 4_000_000
SLICE, OVERLAP = 300_000, 2048
HITS = 1_000_000  # places times windows that are expanded at once
_BITS = 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def folded(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, built from those of half the size."""
    if len(codes) < q:
        return np.empty(0, _U)

    def built(q: int) -> np.ndarray:
        if q == 1:
            return codes.astype(_U)
        half = built(q // 2)
        out = half[: len(half) - q // 2] * _U(pow(int(_STEP), q, 1 << 64)) + half[q // 2 :]
        return out if q % 2 == 0 else out[:-1] * _STEP + codes[q - 1 :]

    h = built(q)
    return h ^ (h >> _U(31))


@dataclass
class Index:
    """Windows of a block of benchmark items and their q-grams by hash."""

    items: list[int]  # of each window
    texts: list[str]
    budgets: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray  # sorted, distinct
    starts: np.ndarray  # of each hash in ``entries``
    entries: np.ndarray  # window << 16 | place
    filter: np.ndarray
    q: int


@dataclass
class Indexes:
    """One index for each q, and the short items."""

    of: list[Index]
    short: list[tuple[int, str]]


def q_of(length: int) -> int:
    """The q of a window: the largest up to ``Q`` whose bound is one at least."""
    return min(Q, length // (int(length * SHARE) + 1))


def build_index(items: list[tuple[int, str]]) -> Indexes:
    owner, texts, short = [], [], []
    for item, text in items:
        text = folded(text)
        if not text:
            continue
        if len(text) < 2 * Q:
            short.append((item, text))
            continue
        if len(text) <= WHOLE:
            parts = [text]
        else:
            last = len(text) - WINDOW
            parts = [text[a : a + WINDOW] for a in [*range(0, last, WINDOW // 2), last]]
        owner += [item] * len(parts)
        texts += parts
    sizes = sorted({q_of(len(t)) for t in texts}, reverse=True)
    return Indexes([_index_of([(o, t) for o, t in zip(owner, texts) if q_of(len(t)) == q], q) for q in sizes], short)


def _index_of(windows: list[tuple[int, str]], q: int) -> Index:
    owner, texts = [o for o, _ in windows], [t for _, t in windows]
    length = np.array([len(t) for t in texts], np.int64)
    budgets = (length * SHARE).astype(np.int64)
    bounds = length + 1 - (budgets + 1) * q
    grams = [gram_hashes(codes_of(t), q) for t in texts]
    h = np.concatenate(grams)
    entry = np.concatenate([(w << 16) + np.arange(len(g)) for w, g in enumerate(grams)])
    order = np.argsort(h, kind="stable")
    hashes, starts = np.unique(h[order], return_index=True)
    bloom = np.zeros(1 << _BITS, bool)
    bloom[(hashes >> _U(64 - _BITS)).astype(np.int64)] = True
    return Index(owner, texts, budgets, bounds, hashes, np.append(starts, len(h)), entry[order], bloom, q)


def align(window: str, region: str, budget: int) -> tuple[int, int] | None:
    """(edits, end in region) of the best alignment of all of ``window`` inside ``region``, if it
    is within ``budget``. Row by row over the window, all ends of the region at once."""
    at = region.find(window)
    if at >= 0:
        return 0, at + len(window)
    text = codes_of(region).astype(np.int64)
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(codes_of(window), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != c))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > budget:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= budget else None


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)


def slice_matches(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(window, edits, start, end) in a slice; start is the region's, not trimmed."""
    h = gram_hashes(codes_of(text), index.q)
    place = np.flatnonzero(index.filter[(h >> _U(64 - _BITS)).astype(np.int64)])
    if not len(place):
        return []
    h = h[place]
    at = np.searchsorted(index.hashes, h)
    at[at == len(index.hashes)] = 0
    hit = index.hashes[at] == h
    at, place = at[hit], place[hit]
    sizes = index.starts[at + 1] - index.starts[at]
    # a q-gram of many windows at many places is expanded part by part; parts leave counts of bands
    part = np.cumsum(sizes) // HITS
    found = []
    for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1) if len(at) else []:
        n = sizes[cut]
        entry = index.entries[np.repeat(index.starts[at[cut]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        window = entry >> 16
        diagonal = np.repeat(place[cut], n) - (entry & 0xFFFF) + (1 << 20)
        band = diagonal // (index.budgets[window] + 1)
        found.append(np.unique(np.concatenate([window << 40 | band, window << 40 | band - 1]), return_counts=True))
        if len(found) > 16:
            found = [_merged(found)]
    if not found:
        return []
    keys, count = _merged(found)
    good = keys[count >= index.bounds[keys >> 40]]
    out = []
    for key in good:
        w, b = int(key >> 40), int(key & ((1 << 40) - 1))
        k = int(index.budgets[w])
        low = b * (k + 1) - (1 << 20)
        start = max(0, low - k)
        stop = min(len(text), low + 2 * (k + 1) + len(index.texts[w]) + k)
        found = align(index.texts[w], text[start:stop], k)
        if found:
            out.append((w, found[0], start, start + found[1]))
    return out


def find(texts: list[str | None], indexes: Indexes) -> list[dict[int, tuple[int, int, int]]]:
    """For each text: {item: (edits, start, end)} of the best window, in the folded text."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    plain = [folded(t) for t in texts]
    for i, t in enumerate(plain):
        for item, s in indexes.short:
            at = t.find(s)
            if at >= 0:
                found[i][item] = (0, at, at + len(s))

    def note(doc: int, at: int, index: Index, match: tuple[int, int, int, int]) -> None:
        w, edits, start, end = match
        item, new = index.items[w], (edits, at + start, at + end)
        old = found[doc].get(item)
        if old is None or new < old:
            found[doc][item] = new

    # short texts share a slice, long ones have several
    group: list[int] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        starts = np.cumsum([0] + [len(plain[i]) + 1 for i in group])
        joined = "\0".join(plain[i] for i in group)
        for index in indexes.of:
            for m in slice_matches(joined, index):
                j = int(np.searchsorted(starts, m[3], side="left")) - 1
                note(group[j], 0, index, (m[0], m[1], max(0, m[2] - int(starts[j])), m[3] - int(starts[j])))
        group.clear()

    for i, t in enumerate(plain):
        if len(t) > SLICE:
            for at in range(0, len(t), SLICE):
                for index in indexes.of:
                    for m in slice_matches(t[at : at + SLICE + OVERLAP], index):
                        note(i, at, index, m)
            continue
        if size + len(t) > SLICE:
            flush()
            size = 0
        group.append(i)
        size += len(t)
    flush()
    return found


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Indexes]:
    """Indexes over the benchmark, ``BLOCK`` characters at a time; rows of one id share a block."""
    held, size = [], 0
    for r in items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).orderBy(id_col).toLocalIterator():
        if size >= BLOCK and held[-1][0] != r[0]:
            yield build_index(held)
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield build_index(held)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): one row per document row and benchmark item found in
    it; places count code points of the folded text."""
    schema = "doc_id long, item_id long, edits int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], index: Indexes = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = find(batch.column(1).to_pylist(), index)
                rows = [(d, item, *x) for d, f in zip(ids, found) for item, x in sorted(f.items())]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "edits", "start", "end"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found."""
    at = docs.columns.index(text_col)
    for index in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], index: Indexes = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not f for f in find(batch.column(at).to_pylist(), index)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items)
