"""Alignment of two tokenizers' tokens by byte spans, and how often their ids meet in a corpus.

Per document the byte spans of the B tokens are a static interval index: sorted, without overlap.
Bisection finds for each A token the B tokens that it overlaps; a gap between two A tokens that no
B token spans is a boundary, and boundaries cut both lists into groups. Links are the pairs of
A and B tokens of one group; a group's pairs are counted by distinct ids, and never laid out
beyond ``PAIRS`` at a time.

How many documents hold an id pair is counted in two steps: each block of documents (bounded in
rows and bytes) is one list of its distinct pairs, so what is shuffled grows with distinct pairs per block.
The counts go back the same way: each block gets those of its own pairs.

A is byte-level BPE over a space and the text, B a SentencePiece model over the text (which puts a
space first). Texts that are null, empty, or that either side doesn't give back byte by byte have
no tokens: zeros, and no groups. Strings of special tokens are plain text. Null and repeated ids are
documents of their own; other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernloom.llm import packing, pieces
from kernloom.llm.common import staged

BLOCK_ROWS, BLOCK_BYTES = 2000, 8_000_000
PAIRS = 1 << 20  # links laid out at once
SHIFT = 32  # a pair's code: A id << 32 | B id


@dataclass
class Tokens:
    """Ids of a text and the byte where each token ends."""

    ids: np.ndarray
    ends: np.ndarray


class Encoder:
    """text -> Tokens or None where the tokens' bytes aren't those of ``want``."""

    def __init__(self, encode: Callable[[str], np.ndarray], spoken: list[bytes]) -> None:
        self.encode, self.spoken = encode, spoken
        self.size = np.array([len(x) for x in spoken], np.int64)

    def tokens(self, text: str, want: bytes) -> Tokens | None:
        ids = self.encode(text)
        ends = np.cumsum(self.size[ids])
        if not len(ids) or ends[-1] != len(want) or b"".join([self.spoken[i] for i in ids.tolist()]) != want:
            return None
        return Tokens(ids, ends)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Encoder:
    """Byte-level BPE of a file; special tokens in a text are plain text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet = packing._byte_alphabet()
    spoken = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        spoken[i] = text.encode() if text in special else bytes(alphabet[c] for c in text)
    return Encoder(packing.encoder(path, specials=False), spoken)


@lru_cache(maxsize=2)
def piece_level(path: str) -> Encoder:
    m = pieces.model(path)
    return Encoder(m.encode, m.spoken)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) B token that each A token overlaps, by bisection in the sorted spans of B."""
    a_start = np.concatenate([[0], a.ends[:-1]])
    b_start = np.concatenate([[0], b.ends[:-1]])
    return np.searchsorted(b.ends, a_start, side="right"), np.searchsorted(b_start, a.ends, side="left") - 1


def groups_of(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The group (from 0) of each A and each B token."""
    first, last = overlaps(a, b)
    group_a = np.concatenate([[0], np.cumsum(last[:-1] < first[1:])])
    # an A token that starts a group overlaps the group's first B token
    starts = first[np.flatnonzero(np.diff(group_a, prepend=-1))]
    return group_a, np.searchsorted(starts, np.arange(len(b.ids)), side="right") - 1


def link_counts(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes ascending, how many links each has): pairs of distinct (group, id) on both sides,
    weighted by how often each is in the group."""
    ka, ma = np.unique(group_a << SHIFT | a.ids, return_counts=True)
    kb, mb = np.unique(group_b << SHIFT | b.ids, return_counts=True)
    ga, gb = ka >> SHIFT, kb >> SHIFT
    begin, end = np.searchsorted(gb, ga, side="left"), np.searchsorted(gb, ga, side="right")
    width, mask = end - begin, (1 << SHIFT) - 1
    total = np.cumsum(width)
    codes, links, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(ka):
        upto = max(at + 1, int(np.searchsorted(total, total[at] - width[at] + PAIRS, side="right")))
        n = width[at:upto]
        left = np.repeat(np.arange(at, upto), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[at:upto], n)
        found, back = np.unique(np.concatenate([codes, (ka[left] & mask) << SHIFT | kb[right] & mask]), return_inverse=True)
        links = np.bincount(back, np.concatenate([links, ma[left] * mb[right]]), len(found)).astype(np.int64)
        codes, at = found, upto
    return codes, links


class GroupText:
    """``a1,a2|b1;a3|b2,b3``: the ids by group."""

    def __init__(self, n_a: int, n_b: int) -> None:
        # each id with what may follow it: A "," or "|", B "," or ";"
        self.n_a, self.n_b = n_a, n_b
        shown = [f"{i}{c}" for n, cs in ((n_a, ",|"), (n_b, ",;")) for c in cs for i in range(n)]
        self.table = np.array(shown, dtype=object)

    def __call__(self, a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> str:
        last = lambda g: np.diff(g, append=g[-1] + 1) != 0
        rows = np.concatenate([a.ids + last(group_a) * self.n_a, 2 * self.n_a + b.ids + last(group_b) * self.n_b])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        return "".join(self.table[rows[order]].tolist())[:-1]


@lru_cache(maxsize=2)
def _shown(n_a: int, n_b: int) -> GroupText:
    return GroupText(n_a, n_b)


def align(text: str | None, left: Encoder, right: Encoder) -> tuple[Tokens, Tokens, np.ndarray, np.ndarray] | None:
    """(A, B, group of each A token, of each B token) of a text, or None without tokens."""
    if not text:
        return None
    want = (" " + text).encode()
    a = left.tokens(" " + text, want)
    b = right.tokens(text, want) if a is not None else None
    if a is None or b is None:
        return None
    return a, b, *groups_of(a, b)


ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, links binary, pairs array<long>, held array<int>"
_ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("places", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))]
)


def _squeezed(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _opened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind).astype(np.int64)


def aligned_blocks(docs: DataFrame, byte_vocabulary: str, piece_model: str, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Two kinds of rows: per document its figures with ``places`` (of its distinct pairs in the block's
    list, as compressed differences) and ``links`` (of each); per block one row with ``pairs``, the
    list, and ``held``, in how many of its documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(byte_vocabulary), piece_level(piece_model)
        shown = _shown(len(left.spoken), len(right.spoken))
        block, size = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def closed() -> pa.RecordBatch:
            every = np.concatenate([r[6] for r in rows]) if rows else np.zeros(0, np.int64)
            pairs, held = np.unique(every, return_counts=True)
            out = []
            for *figures, codes, links in rows:
                at = np.searchsorted(pairs, codes)
                out.append((block, *figures, _squeezed(np.diff(at, prepend=0), "<u4"), _squeezed(links, "<u4" if not len(links) or links.max() < 1 << 32 else "<u8"), None, None))
            out.append((block, *[None] * 8, pairs, held.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = align(text, left, right)
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                else:
                    codes, links = link_counts(*found)
                    digest = hashlib.sha256(shown(*found).encode()).hexdigest()
                    rows.append((doc_id, len(found[0].ids), len(found[1].ids), int(found[2][-1]) + 1, int(links.sum()), digest, codes, links))
                    size += len(text) + 8 * len(codes)
                if len(rows) >= block_rows or size >= block_bytes:
                    yield closed()
                    rows, size, block = [], 0, block + 1
        if rows:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents each id pair is linked, and whether no other pair of
    the same A id is in more."""
    each = blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.held").alias("n"))
    counts = staged(each.groupBy("pair").agg(F.sum("n").cast("long").alias("n")), "pair-counts")
    a = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "a", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b"), "n", (F.col("n") == F.col("most")).alias("best"))


def scored(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents with ``n_best`` and ``count_sum``. A block's documents meet the counts of its own
    pairs."""
    lists = blocks.where("pairs IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    own = lists.join(counts.select("pair", "n", "best"), "pair").select("of_block", "place", "n", "best")
    docs = blocks.where("pairs IS NULL").drop("pairs", "held")
    kept = [c for c in docs.columns if c not in ("block", "places", "links")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(len(right), np.int64)
        best = np.zeros(len(right), np.int64)
        at = right.column("place").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for places, links, n_links in zip(left.column("places").to_pylist(), left.column("links").to_pylist(), left.column("n_links").to_pylist()):
            p = np.cumsum(_opened(places, "<u4"))
            raw = zlib.decompress(links)
            times = np.frombuffer(raw, "<u4" if len(raw) == 4 * len(p) else "<u8").astype(np.int64)
            n_best.append(int((times * best[p]).sum()))
            count_sum.append(int((times * n[p]).sum()))
        out = left.select(kept)
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", n_best long, count_sum long"
    return docs.groupBy("block").cogroup(own.groupBy("of_block")).applyInArrow(run, schema)


def op11_alignment(docs: DataFrame, byte_vocabulary: str | None = None, piece_model: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    blocks = staged(aligned_blocks(docs, byte_vocabulary or packing.default_vocabulary(), piece_model or pieces.default_model(), block_rows), "aligned")
    rows = scored(blocks, pair_counts(blocks))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
