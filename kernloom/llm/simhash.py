"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: words of the text lower-cased in A-Z, three-word shingles with repeats, XXH64
(seed 42) of each; a bit is 1 if it is set in over half the hashes.

Index, over distinct fingerprints only (exact copies have collapsed): the upper nodes are
masked bit patterns. Of the four masks of 16 bits at least one is equal in two fingerprints
that differ in at most three bits, so each fingerprint hangs under four upper nodes. Nodes
with more than ``SPLIT`` members are factored again by four masks of 12 of the other bits.
Under an upper node fingerprints are sorted by Gray rank and cut into leaves; leaves are
joined into higher nodes, which keep the bits that all their members share. A pair of nodes
is dropped as a whole once the differences in shared bits exceed the limit, or once both are
known to lie in one component. Only links that join components are reported, so a tight
group of n fingerprints gives n-1 links.

Links are connected in Spark (see ``components``). Nulls and texts without words have
fingerprint zero. Repeated rows and ids are separate documents; a component's id is its
least doc_id, null if it has none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernloom.llm.common import broadcast_if_few, staged
from kernloom.llm.components import components

BITS = 3
SPLIT = 5000
LEAF, FAN, SMALL = 32, 8, 48
_U = np.uint64


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    digest, n, ones = xxhash.xxh64_intdigest, len(shingles), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = shingles[at : at + (1 << 16)]
        hashes = np.fromiter((digest(s, 42) for s in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep_text: bool = True, name: str = "simhash") -> DataFrame:
    """``docs`` with the fingerprint as a signed bigint (replacing a column of its name)."""
    kept = [c for c in docs.columns if c != name]
    docs = docs.select(*kept)
    at = kept.index(text_col)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    out = codes.astype(_U)
    for shift in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> _U(shift))
    return out


class _Union:
    """Union-find over 0..n-1 in numpy: labels are the least member."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _tree_links(fps: np.ndarray, bits: int, union: _Union, base: int) -> None:
    """Join all within ``bits`` among ``fps`` (one upper node's members, in Gray order)."""
    n = len(fps)
    levels = []
    starts = np.arange(0, n, LEAF)
    ones, zeros = np.bitwise_and.reduceat(fps, starts), np.bitwise_and.reduceat(~fps, starts)
    levels.append((ones, zeros))
    while len(levels[-1][0]) > FAN:
        at = np.arange(0, len(levels[-1][0]), FAN)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], at), np.bitwise_and.reduceat(levels[-1][1], at)))
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    stack = [(len(levels) - 1, a, b)]
    offsets = np.arange(FAN)
    while stack:
        level, a, b = stack.pop()
        if len(a) > 1 << 15:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        ones, zeros = levels[level]
        apart = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b]))
        a, b = a[apart <= bits], b[apart <= bits]
        if level:
            size = len(levels[level - 1][0])
            x = np.repeat(a[:, None] * FAN + offsets, FAN, axis=1).ravel()
            y = np.tile(b[:, None] * FAN + offsets, (1, FAN)).ravel()
            keep = (x < size) & (y < size) & (x <= y)
            # near the diagonal first: what is joined there spares the rest
            x, y = x[keep], y[keep]
            order = np.argsort(x - y, kind="stable")
            stack.append((level - 1, x[order], y[order]))
            continue
        for at in range(0, len(a), 256):
            x, y = a[at : at + 256], b[at : at + 256]
            low = np.minimum.reduceat(union.label[base : base + n], starts)
            high = np.maximum.reduceat(union.label[base : base + n], starts)
            live = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
            x, y = x[live], y[live]
            if not len(x):
                continue
            i = np.minimum(x[:, None] * LEAF + np.arange(LEAF), n - 1)
            j = np.minimum(y[:, None] * LEAF + np.arange(LEAF), n - 1)
            near = np.bitwise_count(fps[i][:, :, None] ^ fps[j][:, None, :]) <= bits
            p, q, r = np.nonzero(near)
            union.join(i[p, q] + base, j[p, r] + base)


def group_links(keys: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a star for each component) among fingerprints with equal keys."""
    order = np.lexsort((gray_rank(fps), keys))
    keys, fps = keys[order], fps[order]
    n = len(fps)
    union = _Union(n)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes <= SMALL, sizes)
    ends = np.repeat(starts + sizes, sizes)
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        i = np.flatnonzero(small[:-shift] & (np.arange(n - shift) + shift < ends[:-shift]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        union.join(i, i + shift)
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        _tree_links(fps[start : start + size], bits, union, int(start))
    linked = np.flatnonzero(union.label != np.arange(n))
    return fps[linked], fps[union.label[linked]]


def _under(fp: Column) -> Column:
    """Keys of the four upper nodes of a fingerprint: mask number, then the 16 masked bits."""
    return F.array(*[(F.lit(i << 16) + F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("bigint") for i in range(4)])


def _further(fp: Column, key: Column) -> Column:
    """Keys below a large upper node: four masks of 12 of the 48 other bits."""
    mask = F.shiftrightunsigned(key, 16).cast("int")
    turned = F.when(mask == 0, F.shiftrightunsigned(fp, 16)).when(
        mask == 1, F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftleft(fp.bitwiseAND(F.lit(0xFFFF)), 32))
    ).when(
        mask == 2, F.shiftrightunsigned(fp, 48).bitwiseOR(F.shiftleft(fp.bitwiseAND(F.lit(0xFFFFFFFF)), 16))
    ).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFFFFFF)))
    return F.array(
        *[
            F.lit(1 << 40) + F.shiftleft(key, 14) + F.lit(i << 12) + F.shiftrightunsigned(turned, 12 * i).bitwiseAND(F.lit(0xFFF))
            for i in range(4)
        ]
    )


def cells(rows: DataFrame, by: str, split: int) -> DataFrame:
    """``rows`` (key, ...) with ``part``, in groups of bounded size: a key of more than ``split`` rows
    is dealt into parts by a hash of ``by``, and every two parts meet under a key of their own.
    Keys of the input are under 2**41, the cell's number goes above."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > split)
    sizes = broadcast_if_few(staged(sizes, "group-sizes"))
    parts = F.ceil(F.col("__size") / split)
    own = F.pmod(F.xxhash64(by), parts)
    meet = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda x: F.least(x, own) * parts + F.greatest(x, own) + 1)
    out = rows.join(sizes, "key", "left").withColumns({"part": F.coalesce(own, F.lit(0).cast("bigint")), "__cell": F.explode(F.coalesce(meet, F.array(F.lit(0).cast("bigint"))))})
    return out.withColumn("key", F.col("key") + F.shiftleft("__cell", 41)).drop("__size", "__cell")


def whole_groups(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[list[pa.Array]]:
    """Columns of rows sorted by the first (a key), cut only where its value changes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n > most and held[0].column(0)[0] != batch.column(0)[-1]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            yield [c.combine_chunks() for c in table.slice(0, cut).columns]
            held = table.slice(cut).to_batches()
            n -= cut
    if n:
        yield [c.combine_chunks() for c in pa.Table.from_batches(held).combine_chunks().columns]


def links(nodes: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``nodes.simhash`` within ``bits``."""
    if bits > 3:
        raise ValueError("four masks find up to three differing bits")
    hung = nodes.select("simhash", F.explode(_under(F.col("simhash"))).alias("key"))
    # at most 4 * 65536 keys exist, so this side is bounded by the masks, not by the rows
    large = hung.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("key", F.lit(True).alias("large"))
    hung = hung.join(F.broadcast(large), "key", "left")
    keys = F.when(F.col("large"), _further(F.col("simhash"), F.col("key"))).otherwise(F.array("key"))
    hung = hung.select("simhash", F.explode(keys).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, print_ in whole_groups(batches):
            a, b = group_links(key.to_numpy(), print_.to_numpy().view(np.uint64), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # fingerprints that share a mask of both levels may still be many: they meet in cells
    hung = cells(hung, "simhash", split)
    dealt = hung.select("key", "simhash").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """Staged ``prints`` (an id, ``simhash``, any other columns) with ``component_id`` and
    ``stays`` (true for exactly one row of each component)."""
    rows = staged(prints.withColumn("_row", F.monotonically_increasing_id()), "simhash-prints")
    # the least id, nulls last; the row number tells repeated ids apart
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row")))
    nodes = staged(rows.groupBy("simhash").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = staged(components(links(nodes, bits)), "simhash-components")
    # roots belong to their own components
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = member.join(nodes.select(F.col("simhash").alias("node"), "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select(F.col("node").alias("simhash"), "least")
    groups = nodes.where("n > 1").select("simhash", F.col("first").alias("own")).join(linked, "simhash", "full")
    groups = groups.select("simhash", F.coalesce("least", "own").alias("least"))
    out = rows.join(groups, "simhash", "left")
    return out.select(
        *[F.col(c) for c in prints.columns],
        F.coalesce("least.id", id_col).alias("component_id"),
        F.coalesce(F.col("least.row") == F.col("_row"), F.lit(True)).alias("stays"),
    )


def op7_simhash(docs: DataFrame) -> DataFrame:
    rows = near_duplicates(with_fingerprint(docs.select("doc_id", "text"), keep_text=False))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
