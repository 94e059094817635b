"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Words form a tree of classes with at most ``FAN`` branches each, cut by frequency (as equal in
mass as the order by count allows), so a frequent word has a short path. P(word | history) is
the product over its path of P(branch | class, history); each is a softmax over the class's
log shares plus weights of hashed features: the word before, the second word back alone (a
skip), and the pair. All of the ``LOCAL`` most frequent words have leaves of their own; the
other words share ``RARE`` leaves by their ending, and inside those a word's share is its
smoothed count. As context every local word counts whole, a rarer one by its last three bytes.

1. Texts are tokenized once, into segments of about ``TOKENS`` tokens that are staged: numbers
   into a dictionary of the segment's own, which has each word's hash (64 bits) and ending.
2. Words of the training rows are counted, one row per segment and word.
3. Training is distributed: tasks take minibatch gradient steps (Adagrad) over their segments
   from the common weights. Weights are averaged row by row, weighted by the gradients that a
   row has seen; every training row is used once, in ``ROUNDS`` rounds.
4. Scoring runs in sparse numpy batches over the segments. Counts of words that aren't local
   are joined from the table of counts, which may have any size.

Null texts are empty: they have the end token alone. Null doc_ids are not learnt from and are
not held out. Repeated rows are scored each. Without training documents all counts are zero.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernloom.llm.common import crc_mod, smaller_batches, staged

FAN, RARE = 16, 16
LOCAL = 1 << 17
ENDINGS = 1 << 15
TABLE = 1 << 16  # rows of weights: row numbers have 16 bits
# the step and the levels were picked on a tenth of the training rows, left out for that (README)
ROUNDS, STEP, BATCH = 2, 0.25, 8192
PAIR_LEVELS = 1  # levels of the tree at which pairs count; below, the single words do
TOKENS, DISTINCT = 500_000, 120_000  # a segment ends with the document that reaches either
ROW_GROUP_MB = 8  # of staged segments, which are 3 MB each, and of scored rows with their rare words
BATCH_MB = 4  # sent to Python at once: a segment or two
END = b" "  # no word holds a blank
_START = LOCAL + ENDINGS  # context before the first word
_RUN = 48  # members of a run that are summed beside those of other runs
_BLOCK = 1 << 12  # rows of weights that travel together
_U = np.uint64
_FEATURES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
_NODE, _MIX = _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash that stands for a word in all tables."""
    h = xxhash.xxh64_intdigest(word, 0)
    return h - (1 << 64) if h >> 63 else h


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class _Local(dict):
    """Word -> its number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


_SEGMENT = "ids array<long>, held array<boolean>, sizes binary, tokens binary, hashes binary, endings binary"


def segments(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Tokenized segments of ``docs`` (an id, held_out, text): ids, held_out and lengths (int32) of
    whole documents, their tokens (int32), hashes (int64) and endings (uint16) of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, out, n = _Local(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(word_hash, number), np.int64, len(number))
            endings = np.fromiter(map(ending, number), np.uint16, len(number))
            sizes = np.array([len(x) for x in out], np.int32)
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (sizes, np.concatenate(out), hashes, endings)]
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays([*lists, *binary], ["ids", "held", "sizes", "tokens", "hashes", "endings"])

        for batch in batches:
            for id_, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w = words(text.as_py())
                w.append(END)
                out.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                ids.append(id_)
                held.append(held_out)
                n += len(w)
                if n >= TOKENS or len(number) >= DISTINCT:
                    yield flush()
                    number, ids, held, out, n = _Local(), [], [], [], 0
        if out:
            yield flush()

    return docs.select(id_col, "held_out", "text").mapInArrow(run, _SEGMENT)


@dataclass
class Segment:
    """A staged row of ``segments``."""

    ids: pa.Array
    held: np.ndarray
    size: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray
    endings: np.ndarray

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
        for batch in batches:
            for i in range(batch.num_rows):
                binary = [np.frombuffer(batch.column(2 + k)[i].as_buffer(), kind) for k, kind in enumerate((np.int32, np.int32, np.int64, np.uint16))]
                yield Segment(batch.column(0)[i].values, np.array(batch.column(1)[i].as_py(), bool), binary[0].astype(np.int64), *binary[1:])

    def part(self, rounds: int) -> np.ndarray:
        """The round in which each document is learnt, -1 if in none."""
        numbers = np.array(self.ids.fill_null(0)).astype(_U)
        part = ((numbers + _U(1)) * _FEATURES[0] >> _U(40)) % _U(rounds)
        return np.where(self.held | np.array(self.ids.is_null()), -1, part.astype(np.int64))

    def codes(self, vocabulary: Vocabulary) -> np.ndarray:
        """Of each word of the dictionary: its rank, or LOCAL + its ending."""
        order = np.argsort(vocabulary.hashes)
        known = vocabulary.hashes[order]
        at = np.minimum(np.searchsorted(known, self.hashes), max(len(known) - 1, 0))
        found = known[at] == self.hashes if len(known) else np.zeros(len(self.hashes), bool)
        return np.where(found, order[at] if len(known) else 0, LOCAL + self.endings.astype(np.int64))


def count_words(staged_segments: DataFrame) -> DataFrame:
    """(h, kind, n) over all training rows, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in Segment.read(batches):
            learnt = np.repeat(x.part(1) == 0, x.size)
            n = np.bincount(x.tokens[learnt], minlength=len(x.hashes))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes[at]), pa.array((x.endings[at] % RARE).astype(np.int32)), pa.array(n[at])], ["h", "kind", "n"])

    counted = staged_segments.mapInArrow(run, "h long, kind int, n long")
    return counted.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))


_TREES: list = []  # the last tree and the masses it was made from


@dataclass
class Vocabulary:
    """Hashes and counts of the local words, most frequent first, and totals of all."""

    hashes: np.ndarray
    kinds: np.ndarray
    count: np.ndarray
    total: int
    distinct: int
    rare_total: np.ndarray  # of the words that aren't local, by kind
    rare_distinct: np.ndarray

    @property
    def tree(self) -> Tree:
        """The tree of classes; made once in a process, it doesn't travel."""
        mass = np.concatenate([self.count.astype(float), self.rare_mass])
        if not _TREES or not np.array_equal(_TREES[0][0], mass):
            _TREES[:] = [(mass, Tree(mass))]
        return _TREES[0][1]

    @property
    def rare_mass(self) -> np.ndarray:
        return self.rare_total + 0.1 * (self.rare_distinct + 1)

    @property
    def mass(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)


class Tree:
    """Classes over items with masses: paths (node, branch) of each item, log shares of branches."""

    def __init__(self, mass: np.ndarray) -> None:
        order = np.argsort(-mass, kind="stable")
        shares: list[np.ndarray] = []
        now = [(0, len(order))] if len(order) > 1 else []
        sums = np.concatenate([[0.0], np.cumsum(mass[order])])
        found_item, found_node, found_branch, found_level = [], [], [], []
        level = 0
        while now:
            below = []
            for start, stop in now:
                if stop - start <= FAN:
                    branch = np.arange(stop - start)
                else:
                    middle = (sums[start:stop] + sums[start + 1 : stop + 1]) / 2 - sums[start]
                    branch = np.minimum((FAN * middle / (sums[stop] - sums[start])).astype(np.int64), FAN - 1)
                    branch = np.unique(branch, return_inverse=True)[1]
                found_item.append(order[start:stop])
                found_node.append(np.full(stop - start, len(shares)))
                found_branch.append(branch)
                found_level.append(np.full(stop - start, level))
                share = np.full(FAN, -30.0, np.float32)
                cuts = np.append(np.flatnonzero(np.concatenate([[True], branch[1:] != branch[:-1]])), stop - start) + start
                share[: len(cuts) - 1] = np.log(np.diff(sums[cuts]) / (sums[stop] - sums[start]))
                shares.append(share)
                below += [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
            now = below
            level += 1
        item = np.concatenate(found_item) if found_item else np.empty(0, np.int64)
        by_item = np.argsort(item, kind="stable")  # levels come in order
        self.depth = np.bincount(item, minlength=len(mass))
        self.start = np.cumsum(self.depth) - self.depth
        take = lambda x: (np.concatenate(x) if x else np.empty(0, np.int64))[by_item]
        self.node, self.branch, self.level = take(found_node).astype(np.int64), take(found_branch).astype(np.int64), take(found_level).astype(np.int64)
        self.shares = np.stack(shares) if shares else np.empty((0, FAN), np.float32)


def learn_vocabulary(counts: DataFrame, most: int = LOCAL) -> Vocabulary:
    """Totals and the ``most`` most frequent words of a staged table (h, kind, n); equal counts by
    the hash.

    Words by steps of the logarithm of n tell down to which step at most that many words reach;
    only those come to the driver, and of the next step a share by the hash, which fills the rest.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * 64)
    steps = sorted(((r["b"], r["v"]) for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    held, wanted = 0, F.lit(False)
    for b, words_in in steps:
        if held + words_in > most:
            share = int((most - held) / words_in * (1 << 40))
            wanted = (step > b) | ((step == b) & (F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < share))
            break
        held, wanted = held + words_in, step >= b
    end = word_hash(END)
    top = sorted(((r["n"], r["h"], r["kind"]) for r in counts.where(wanted | (F.col("h") == end)).collect()), key=lambda x: (x[1] != end, -x[0], x[1]))[:most]
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n, h, kind = (np.array([x[i] for x in top], np.int64) for i in range(3))
    rare_total = np.array([float(sums.get(k, (0, 0))[0]) for k in range(RARE)]) - np.bincount(kind, weights=n, minlength=RARE)
    rare_distinct = np.array([float(sums.get(k, (0, 0))[1]) for k in range(RARE)]) - np.bincount(kind, minlength=RARE)
    return Vocabulary(h, kind, n, int(total), int(distinct), rare_total, rare_distinct)


def _take(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a table; ``take`` without a range check is several times faster than an index."""
    return np.take(table, rows.astype(np.intp, copy=False), axis=0, mode="clip")


class Model:
    """Weights of hashed features over the tree's branches."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None) -> None:
        self.weights = np.zeros((TABLE, FAN), np.float32) if weights is None else weights
        self.seen = np.zeros(TABLE, np.float32)
        tree, n = vocabulary.tree, len(vocabulary.count)
        self.tree, self.shares = tree, tree.shares
        # the item of each code: itself, or the leaf of its ending
        self.item = np.concatenate([np.arange(LOCAL), n + np.arange(ENDINGS) % RARE])
        self.item[n:LOCAL] = n
        self.ones = np.ones(FAN, np.float32)

    @staticmethod
    def histories(codes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashed features of each token's history; ``first``: its place in its document."""
        back = []
        for k in (1, 2):
            x = np.full(len(codes), _START, np.int64)
            x[k:] = codes[:-k]
            x[first < k] = _START
            back.append(x.astype(_U))
        return [back[0] * _FEATURES[0], back[1] * _FEATURES[1], (back[0] * _U(1 << 20) + back[1]) * _FEATURES[2]]

    def paths(self, codes: np.ndarray, histories: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Steps of all tokens' paths: token, branch, logits' base, and for each feature the steps
        where it counts and its rows."""
        item = self.item[codes]
        depth = self.tree.depth[item]
        token = np.repeat(np.arange(len(codes)), depth)
        at = np.arange(len(token)) - np.repeat(np.cumsum(depth) - depth, depth) + self.tree.start[item][token]
        node = self.tree.node[at]
        mixed = node.astype(_U) * _NODE
        where = [None, None, np.flatnonzero(self.tree.level[at] < PAIR_LEVELS)]
        rows = []
        for h, w in zip(histories, where):
            x = np.take(h, token) ^ mixed if w is None else np.take(h, np.take(token, w)) ^ np.take(mixed, w)
            x ^= x >> _U(29)
            rows.append(((x * _MIX) >> _U(48)).astype(np.uint16))
        return token, self.tree.branch[at], node, where, rows

    def logits(self, node: np.ndarray, where: list, rows: list) -> np.ndarray:
        out = _take(self.shares, node)
        for w, r in zip(where, rows):
            if w is None:
                out += _take(self.weights, r)
            else:
                out[w] += _take(self.weights, r)
        return out

    def step(self, codes: np.ndarray, histories: list[np.ndarray]) -> None:
        token, branch, node, where, rows = self.paths(codes, histories)
        if not len(token):
            return
        grad = self.logits(node, where, rows)
        np.exp(grad, out=grad)
        grad /= (grad @ self.ones)[:, None]
        grad[np.arange(len(grad)), branch] -= 1
        # sums of gradients by row of the table: runs of equal rows, the longest runs first, so that
        # the k-th members of all runs that have one are a prefix
        source = np.concatenate([np.arange(len(grad)) if w is None else w for w in where])
        all_rows = np.concatenate(rows)
        order = np.argsort(all_rows, kind="stable")
        all_rows, source = np.take(all_rows, order), np.take(source, order)
        start = np.flatnonzero(np.concatenate([[True], all_rows[1:] != all_rows[:-1]]))
        size = np.diff(np.append(start, len(all_rows)))
        by_size = np.argsort((0xFFFF - np.minimum(size, 0xFFFF)).astype(np.uint16), kind="stable")
        start, size = np.take(start, by_size), np.take(size, by_size)
        g, falling = _take(grad, np.take(source, start)), -size
        for k in range(1, min(int(size[0]), _RUN)):
            n = int(np.searchsorted(falling, -k, side="left"))  # runs with more than k members
            g[:n] += _take(grad, np.take(source, start[:n] + k))
        for r in range(int(np.searchsorted(falling, -_RUN, side="left"))):
            g[r] += _take(grad, source[start[r] + _RUN : start[r] + size[r]]).sum(0)
        u = np.take(all_rows, start).astype(np.intp)
        seen = np.take(self.seen, u) + np.einsum("ij,ij->i", g, g)
        self.seen[u] = seen
        g *= (STEP / np.sqrt(seen + 1.0))[:, None]
        self.weights[u] = _take(self.weights, u) - g

    def logs(self, codes: np.ndarray, histories: list[np.ndarray]) -> np.ndarray:
        """log10 of each token's probability (of its leaf, where that is a rare one)."""
        token, branch, node, where, rows = self.paths(codes, histories)
        logits = self.logits(node, where, rows)
        own = logits[np.arange(len(logits)), branch].astype(np.float64)
        np.exp(logits, out=logits)
        return np.bincount(token, weights=(own - np.log(logits @ self.ones)) / np.log(10.0), minlength=len(codes))


def _groups(size: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` tokens."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def _documents(x: Segment, codes: np.ndarray, at: int, stop: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a range of documents and each token's place in its document."""
    size = x.size[at:stop]
    tokens = x.tokens[starts[at] : starts[at] + size.sum()]
    return np.take(codes, tokens), np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)


def train(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds over disjoint parts of the staged segments ``rows``."""
    weights = np.zeros((TABLE, FAN), np.float32)
    schema = "at long, n binary, x binary"

    def block(at: int, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n.astype("<f4").tobytes()], pa.binary()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["at", "n", "x"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(at, [0.0, 0.0])
                held[0] = held[0] + np.frombuffer(n, "<f4").astype(np.float64)
                held[1] = held[1] + np.frombuffer(x, "<f4").astype(np.float64)
        for at, (n, x) in sums.items():
            yield block(at, n, x)

    for i in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], i: int = i, weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            model = Model(vocabulary, weights.copy())
            for x in Segment.read(batches):
                mine = x.part(rounds) == i
                tokens = x.tokens[np.repeat(mine, x.size)]
                x = Segment(x.ids, x.held, x.size[mine], tokens, x.hashes, x.endings)
                codes, starts = x.codes(vocabulary), np.cumsum(x.size) - x.size
                for a, b in _groups(x.size):
                    own, first = _documents(x, codes, a, b, starts)
                    histories = model.histories(own, first)
                    for at in range(0, len(own), BATCH):
                        model.step(own[at : at + BATCH], [h[at : at + BATCH] for h in histories])
            for at in range(0, TABLE, _BLOCK):
                n = model.seen[at : at + _BLOCK]
                if n.any():
                    yield block(at, n, model.weights[at : at + _BLOCK] * n[:, None])

        partial = rows.mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % 16)
        partial = partial.repartition("at", "salt").select("at", "n", "x").mapInArrow(combine, schema)
        found = partial.repartition("at").mapInArrow(combine, schema).collect()  # as many rows as the model has blocks
        weights = weights.copy()
        for r in found:
            n, x = np.frombuffer(r["n"], "<f4"), np.frombuffer(r["x"], "<f4").reshape(-1, FAN)
            at = r["at"] + np.flatnonzero(n)
            weights[at] = x[n > 0] / n[n > 0][:, None]
    return weights


def score_rows(rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """Per document of the staged segments ``rows``: n_tokens, n_known, train_tokens, base_score and score."""
    schema = f"{id_col} long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, local = Model(vocabulary, weights), len(vocabulary.count)
        base = np.full(LOCAL + ENDINGS, -np.log10(vocabulary.mass))
        base[:local] += np.log10(vocabulary.count + 0.1)
        inside = np.zeros(LOCAL + ENDINGS)
        inside[LOCAL:] = -np.log10(vocabulary.rare_mass)[np.arange(ENDINGS) % RARE]
        for x in Segment.read(batches):
            codes, begin = x.codes(vocabulary), np.cumsum(x.size) - x.size
            for a, b in _groups(x.size):
                own, first = _documents(x, codes, a, b, begin)
                histories, logs = model.histories(own, first), inside[own]
                for at in range(0, len(own), BATCH):
                    logs[at : at + BATCH] += model.logs(own[at : at + BATCH], [h[at : at + BATCH] for h in histories])
                size = x.size[a:b]
                starts = np.cumsum(size) - size
                columns = [size, np.add.reduceat(own < LOCAL, starts, dtype=np.int64), np.add.reduceat(base[own], starts), np.add.reduceat(logs, starts)]
                # words that aren't local: distinct ones of each document with their times
                other = np.flatnonzero(own >= LOCAL)
                document = np.repeat(np.arange(b - a), size)[other]
                pairs, times = np.unique(document << 32 | x.tokens[begin[a] + other], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) << 32).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (x.hashes[pairs & 0xFFFFFFFF], times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [x.ids.slice(a, b - a), pa.array(x.held[a:b]), *map(pa.array, columns), *lists],
                    [id_col, "held_out", "n_tokens", "known", "base", "score", "rare", "times"],
                )

    scored = staged(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows", ROW_GROUP_MB)
    other = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    joined = other.join(counts.select("h", "n"), "h", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("s"),
    )
    s = F.coalesce("s", F.lit(0.0))
    return scored.drop("rare", "times").join(sums, "row", "left").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + s).alias("base_score"),
        (F.col("score") + s).alias("score"),
    )


def op6_lm_scoring(docs: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 10) == 0
    with smaller_batches(docs.sparkSession, BATCH_MB):  # all that goes to Python is staged in here
        rows = staged(segments(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")), "lm-segments", ROW_GROUP_MB)
        counts = staged(count_words(rows), "lm-counts")
        vocabulary = learn_vocabulary(counts)
        return score_rows(rows, counts, vocabulary, train(rows, vocabulary))
