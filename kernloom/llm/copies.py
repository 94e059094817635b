"""SimHash near-dedup of whole texts by five-word shingles and a Jaccard similarity of four fifths.

The same index as in ``simhash``, with a setting of its own. Words are those of the text
lower-cased in A-Z; a shingle is the XXH64 (seed 42) of five words, or of the whole text where
it has fewer. Rows of equal sets of shingles are one node. A node's fingerprint is the SimHash
of its set in ``PRINT`` bits: two sets of similarity 4/5 differ in about 0.15 of them.

Upper nodes of the index are masked bit patterns. The width of a mask follows from the number of
nodes (``LEAST_BITS`` at least), so that about ``MEMBERS`` of them at most agree in its bits at any
size of corpus; the number of masks follows from the width, so that of pairs with a share of ``APART`` differing bits all but
``MISSED`` agree in one. The bits are drawn from a fixed seed. Under an upper node fingerprints are in Gray order, cut into
leaves and higher nodes that keep the bits which all their members share; a pair of nodes is
dropped as a whole once the differences in shared bits exceed ``NEAR`` bits. A pair that shares
several masks counts at the first of them only. Candidates are verified: their whole sets are
compared, and linked from a similarity of 4/5.

No group is expanded into its pairs. The first round verifies at most ``WAYS`` candidates a
node, the nearest ones. The second round concerns nodes that have more candidates than that,
and verifies all of those that the first round has not put into one component. A sketch goes
first: the parities of a set's shingles in ``BUCKETS`` buckets differ in no more places than
the sets do, so a pair that differs in too many can't be similar. Groups under a mask that
hold more than ``SPLIT`` nodes are dealt into cells of two parts each.

What the masks and the limit in bits miss is missed (README has measured figures).

Nulls and texts without words have the empty set, and are copies of each other. Repeated rows
and ids are separate documents. An empty table gives an empty result. Columns of the input are
kept as they are, whatever their names; the two added columns replace theirs of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernloom.llm.common import broadcast_if_few, staged
from kernloom.llm.components import components
from kernloom.llm.simhash import FAN, LEAF, cells, gray_rank, whole_groups

WIDTH = 5
PRINT, NEAR = 256, 52
MEMBERS, LEAST_BITS, APART, MISSED = 2048, 8, 0.17, 0.04
SHIFT = 24  # a key is mask << 24 | bits
WAYS = 4
SPLIT, SMALL = 20_000, 128
MEET = 50_000  # rows that a task holds at once, or those of one key
BUCKETS = 1024
_WORDS = PRINT // 64
_U = np.uint64
_GOLDEN, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


@lru_cache(maxsize=8)
def _chosen(count: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks x bits, masks x words): the places of each mask, and the same as set bits."""
    chosen = np.stack([np.random.default_rng(31 + i).permutation(PRINT)[:bits] for i in range(count)])
    marks = np.zeros((count, PRINT), np.uint8)
    np.put_along_axis(marks, chosen, 1, axis=1)
    return chosen, np.packbits(marks, axis=1, bitorder="little").view(_U)


@dataclass(frozen=True)
class Masks:
    count: int
    bits: int

    @classmethod
    def of(cls, nodes: int) -> Masks:
        bits = min(max(round(math.log2(max(nodes, 1) / MEMBERS)), LEAST_BITS), SHIFT)
        return cls(math.ceil(math.log(MISSED) / math.log(1 - (1 - APART) ** bits)), bits)

    @property
    def chosen(self) -> np.ndarray:
        return _chosen(self.count, self.bits)[0]

    @property
    def marks(self) -> np.ndarray:
        return _chosen(self.count, self.bits)[1]


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingles of a whole text, ascending."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], _U)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b"%b %b %b %b %b" % x, 42) for x in zip(w, w[1:], w[2:], w[3:], w[4:])), _U, len(w) - WIDTH + 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 4/5 at least."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def wide_print(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set in ``PRINT`` bits, as bytes."""
    ones = np.zeros(PRINT, np.int64)
    for at in range(0, len(found), 255):
        part = found[at : at + 255]
        h = part[:, None] + np.array([_GOLDEN * (k + 1) % (1 << 64) for k in range(_WORDS)], _U)
        h = (h ^ (h >> _U(30))) * _MIX_A
        h = (h ^ (h >> _U(27))) * _MIX_B
        h ^= h >> _U(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little")


def parities(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8))


def with_prints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __node (hash of the set), __n (its size) and __print."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType()), T.StructField("__n", T.IntegerType()), T.StructField("__print", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, prints = [], [], []
            for text in batch.column(at):
                found = shingles(text.as_py())
                node.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                n.append(len(found))
                prints.append(wide_print(found).tobytes())
            columns = [pa.array(np.array(node, _U).view(np.int64)), pa.array(n, pa.int32()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return docs.mapInArrow(run, schema)


def _prints(column: pa.BinaryArray) -> np.ndarray:
    """Words of equally long values: the fingerprint's, then those of a sketch, if there is one."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(_U).reshape(len(column), -1)


def hung(nodes: DataFrame, masks: Masks) -> DataFrame:
    """(key, node, n, print, root): ``nodes`` under all their masks."""
    weights = (1 << np.arange(masks.bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                bits = np.unpackbits(np.ascontiguousarray(_prints(batch.column(2))[:, :_WORDS]).view(np.uint8), axis=1, bitorder="little")
                key = (bits[:, masks.chosen].astype(np.int64) @ weights) + (np.arange(masks.count) << SHIFT)
                each = pa.array(np.repeat(np.arange(len(key)), masks.count))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[c.take(each) for c in batch.columns]], ["key", "node", "n", "print", "root"])

    return nodes.select("node", "n", "print", "root").mapInArrow(run, "key long, node long, n int, print binary, root long")


def _mask(key: np.ndarray) -> np.ndarray:
    """The number of the mask; a cell's number is above it."""
    return (key & ((1 << 41) - 1)) >> SHIFT


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def gray_order(prints: np.ndarray) -> np.ndarray:
    """Order of wide fingerprints by Gray rank: the rank of a word is turned if the bits before
    it are odd in number."""
    odd, columns = np.zeros(len(prints), bool), []
    for w in range(prints.shape[1]):
        rank = gray_rank(prints[:, w])
        columns.append(np.where(odd, ~rank, rank))
        odd ^= (np.bitwise_count(prints[:, w]) & 1).astype(bool)
    return np.lexsort(columns[::-1])


def tree_pairs(prints: np.ndarray, near: int = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all pairs within ``near`` bits, i < j, in blocks of bounded size.
    ``prints`` is in Gray order."""
    n, starts = len(prints), np.arange(0, len(prints), LEAF)
    levels = [(np.bitwise_and.reduceat(prints, starts, axis=0), np.bitwise_and.reduceat(~prints, starts, axis=0))]
    while len(levels[-1][0]) > FAN:
        at = np.arange(0, len(levels[-1][0]), FAN)
        levels.append(tuple(np.bitwise_and.reduceat(x, at, axis=0) for x in levels[-1]))
    a, b = np.triu_indices(len(levels[-1][0]))
    stack = [(len(levels) - 1, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 1 << 14:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        ones, zeros = levels[level]
        apart = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b])).sum(1, dtype=np.int64)
        a, b = a[apart <= near], b[apart <= near]
        if level:
            x = np.repeat(a[:, None] * FAN + np.arange(FAN), FAN, axis=1).ravel()
            y = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
            keep = (y < len(levels[level - 1][0])) & (x <= y)
            stack.append((level - 1, x[keep], y[keep]))
            continue
        for at in range(0, len(a), 64):
            i = a[at : at + 64, None] * LEAF + np.arange(LEAF)
            j = b[at : at + 64, None] * LEAF + np.arange(LEAF)
            p, q = np.minimum(i, n - 1), np.minimum(j, n - 1)
            d = np.zeros((len(i), LEAF, LEAF), np.int16)
            for w in range(_WORDS):
                d += np.bitwise_count(prints[p, w][:, :, None] ^ prints[q, w][:, None, :])
            ok = (d <= near) & (i[:, :, None] < j[:, None, :]) & (j < n)[:, None, :]
            r, x, y = np.nonzero(ok)
            if len(r):
                yield i[r, x], j[r, y], d[r, x, y].astype(np.int64)


def _masked_pairs(key: np.ndarray, n: np.ndarray, prints: np.ndarray, part: np.ndarray, root: np.ndarray | None, masks: Masks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of candidates in groups of equal keys (sorted): near in bits and in size,
    with no earlier mask in common, and of different roots where these are given."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    mask = _mask(key)
    prints, odd = np.ascontiguousarray(prints[:, :_WORDS]), prints[:, _WORDS:]
    parted = np.repeat(np.maximum.reduceat(part, starts) != np.minimum.reduceat(part, starts), sizes)

    def kept(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        good = (d <= NEAR) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (~parted[i] | (part[i] != part[j]))
        if root is not None:
            good &= root[i] != root[j]
        i, j, d = i[good], j[good], d[good]
        if odd.shape[1]:  # sets of similarity 4/5 differ in a ninth of their common size at most
            good = 9 * _distance(odd[i], odd[j]) <= n[i] + n[j]
            i, j, d = i[good], j[good], d[good]
        apart, first = prints[i] ^ prints[j], np.ones(len(i), bool)
        for t in range(int(mask[i].max(initial=0))):
            first &= (mask[i] <= t) | ((apart & masks.marks[t]) != 0).any(1)
        return i[first], j[first], d[first]

    small = np.repeat(sizes <= SMALL, sizes)
    ends = np.repeat(starts + sizes, sizes)
    i, shift = np.flatnonzero(small), 0
    while len(i):
        shift += 1
        i = i[i + shift < ends[i]]
        for at in range(0, len(i), 1 << 17):
            x = i[at : at + (1 << 17)]
            yield kept(x, x + shift, _distance(prints[x], prints[x + shift]))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        order = gray_order(prints[start : start + size]) + start
        for x, y, d in tree_pairs(prints[order]):
            yield kept(order[x], order[y], d)


def _over_groups(rows: DataFrame, found: Callable, schema: str) -> DataFrame:
    """``found(key, node, n, prints, part, root)`` over whole groups of equal keys."""
    rows = cells(rows, "node", SPLIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, prints, root, part in whole_groups(batches, MEET):
            key, node, n, root, part = (x.to_numpy() for x in (key, node, n, root, part))
            yield from found(key, node, n.astype(np.int64), _prints(prints), part, root)

    dealt = rows.select("key", "node", "n", "print", "root", "part").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, schema)


def nearest_candidates(nodes: DataFrame, masks: Masks) -> DataFrame:
    """(node, all, nearest): how many candidates a node has, and the nearest ones, at most ``WAYS``."""

    def found(key, node, n, prints, part, root) -> Iterator[pa.RecordBatch]:
        size, none = len(key), np.iinfo(np.int64).max
        by_node = np.argsort(node, kind="stable")
        rank = np.empty(size, np.int64)
        rank[by_node] = np.arange(size)
        best, count = np.full(size, none), np.zeros(size, np.int64)
        for i, j, d in _masked_pairs(key, n, prints, part, None, masks):
            for x, y in ((i, j), (j, i)):
                np.minimum.at(best, x, d * size + rank[y])
                np.add.at(count, x, 1)
        at = np.flatnonzero(count)
        if len(at):
            distance, other = np.divmod(best[at], size)
            columns = [node[at], _mask(key[at]) % WAYS, distance, node[by_node[other]], count[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "way", "distance", "other", "all"])

    rows = _over_groups(hung(nodes.withColumn("root", F.lit(0).cast("bigint")), masks), found, "node long, way long, distance long, other long, all long")
    ways = rows.groupBy("node", "way").agg(F.min(F.struct("distance", "other")).alias("best"), F.sum("all").alias("all"))
    return ways.groupBy("node").agg(F.sum("all").alias("all"), F.collect_set("best.other").alias("nearest"))


def other_candidates(nodes: DataFrame, masks: Masks) -> DataFrame:
    """(a, b, x, y): all candidates among ``nodes`` whose roots differ, and these."""

    def found(key, node, n, prints, part, root) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep = np.repeat(mixed, np.diff(np.append(starts, len(key))))
        if keep.any():
            key, node, n, prints, part, root = (x[keep] for x in (key, node, n, prints, part, root))
            for i, j, _ in _masked_pairs(key, n, prints, part, root, masks):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[i], node[j], root[i], root[j])], ["a", "b", "x", "y"])

    return _over_groups(hung(nodes, masks), found, "a long, b long, x long, y long")


def of_texts(ends: DataFrame, rows: DataFrame, text_col: str, made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(node, found): ``made`` of the sets of the nodes in ``ends`` (node, __row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [made(shingles(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "found"])

    ends = broadcast_if_few(staged(ends, "copies-ends"))
    texts = rows.select("__row", F.col(text_col).alias("text")).join(ends, "__row").select("node", "text")
    return staged(texts.mapInArrow(run, "node long, found binary"), "copies-sets")


def _met(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str, made: Callable[[np.ndarray], np.ndarray], good: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The ``pairs`` (a, b, x, y) for which ``good`` holds of what is ``made`` of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(4), batch.column(5))
            keep = [bool(good(np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U))) for a, b in both]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = ends.join(nodes.select("node", F.col("first.row").alias("__row")), "node")
    found = of_texts(ends, rows, text_col, made)
    # both sides are shuffled at any size, so that small inputs have the plan of large ones
    both = pairs.repartition("a").join(found.toDF("a", "found_a").repartition("a").hint("merge"), "a")
    both = both.repartition("b").join(found.toDF("b", "found_b").repartition("b").hint("merge"), "b")
    return both.select("a", "b", "x", "y", "found_a", "found_b").mapInArrow(run, "a long, b long, x long, y long")


def sketch(found: np.ndarray) -> np.ndarray:
    """A set's parities and its size."""
    return np.append(parities(found).view(_U), _U(len(found)))


def can_be_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sketches allow a similarity of 4/5: the sets differ in a ninth of their common size at most."""
    return 9 * int(_distance(a[:-1], b[:-1])) <= int(a[-1]) + int(b[-1])


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, text_col: str, sketched: bool = False) -> DataFrame:
    """(x, y) of the ``pairs`` (a, b, x, y) whose whole sets are similar. Sketches of sets meet first
    (unless the pairs come ``sketched``), whole sets only where these allow it."""
    if not sketched:
        pairs = staged(_met(pairs, nodes, rows, text_col, sketch, can_be_similar), "copies-pairs")
    return _met(pairs, nodes, rows, text_col, lambda found: found, similar).select("x", "y")


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``component_id`` (its least id, null if it has none) and ``stays`` (true for
    exactly one row of each component)."""
    docs = docs.select(*[c for c in docs.columns if c not in ("component_id", "stays")])
    # columns go by their places meanwhile, so no name can clash with those made here
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text_col, id_col = (f"c{names.index(c)}" for c in (text_col, id_col))
    rows = staged(with_prints(docs, text_col).withColumn("__row", F.monotonically_increasing_id()), "copies-rows")
    # the least id, nulls last; the row number tells repeated ids apart
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row")))
    nodes = rows.groupBy(F.col("__node").alias("node")).agg(first.alias("first"), F.min("__n").alias("n"), F.min("__print").alias("print"), F.count(F.lit(1)).alias("rows"))
    nodes = staged(nodes.withColumn("root", F.col("node")), "copies-nodes")
    masks = Masks.of(nodes.where("n > 0").count())
    near = staged(nearest_candidates(nodes.where("n > 0"), masks), "copies-nearest")
    pairs = near.select("node", F.explode("nearest").alias("other"))
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    pairs = staged(pairs.withColumns({"x": F.col("a"), "y": F.col("b")}), "copies-pairs")
    roots = staged(components(verified(pairs, nodes, rows, text_col).toDF("a", "b")), "copies-components")
    more = near.where(F.col("all") > F.size("nearest")).select("node")
    more = nodes.drop("root").join(more, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = staged(more.withColumn("__row", F.col("first.row")), "copies-more")
    if not more.isEmpty():
        odd = of_texts(more.select("node", "__row"), rows, text_col, parities)
        more = more.join(odd, "node").withColumn("print", F.concat("print", "found"))
        others = staged(other_candidates(more, masks), "copies-others")
        if not others.isEmpty():
            # links between components of the first round: a graph of its own, of their roots
            upper = staged(components(verified(others, nodes, rows, text_col, sketched=True).toDF("a", "b")), "copies-components")
            above = upper.select(F.col("node").alias("root"), F.col("root").alias("__above"))
            roots = roots.join(above, "root", "left").select("node", F.coalesce("__above", "root").alias("root"))
            roots = staged(roots.unionByName(upper), "copies-components")
    # roots belong to their own components
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = member.join(nodes.select("node", "first"), "node")
    linked = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "least")
    groups = nodes.where("rows > 1").select("node", F.col("first").alias("own")).join(linked, "node", "full")
    groups = groups.select(F.col("node").alias("__node"), F.coalesce("least", "own").alias("least"))
    # narrow rows meet first; then only rows of groups travel to the texts
    decided = staged(rows.select("__row", "__node").join(groups, "__node").select("__row", "least"), "copies-decided")
    return rows.join(broadcast_if_few(decided), "__row", "left").select(
        *[F.col(c).alias(n) for c, n in zip(docs.columns, names)],
        F.coalesce("least.id", id_col).alias("component_id"),
        F.coalesce(F.col("least.row") == F.col("__row"), F.lit(True)).alias("stays"),
    )
