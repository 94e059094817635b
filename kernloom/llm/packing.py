"""Best-fit packing by bin completion over the histogram of lengths.

All pieces of one length are alike, so the packing problem is a histogram of at most
``capacity`` counts, whatever the corpus. The driver solves it by bin completion: around the
largest length left, the undominated fillings of the gap are enumerated lazily, the least
waste first. (A filling is dominated if a length left out can replace a part of it: one that
is larger than that part and still fits, or as large as several together.) Each is applied to
as many sequences as the counts allow, then to a single one; branches whose waste can't beat
the best solution so far are cut. The incumbent is best-fit decreasing.

The search ends when the lower bound is reached or every branch is cut: then no packing has
fewer sequences. It also ends after ``nodes`` fillings; then up to ``repairs`` times the
sequences that have waste are taken out with some full ones, completed anew around their
largest lengths, and kept if no worse. Where that doesn't reach the lower bound either, the
gap between ``sequences`` and ``least_sequences`` (two columns) tells how far the optimum can
be. Neither limit drops a piece.

Pieces are then matched to places by their rank within their length, which comes from counts
per task and length: no group of equal lengths is gathered anywhere.

Tokens: a document's ids, then the separator id. Longer documents are cut from the end, so
all pieces but the first are full. Null texts are empty (one separator). Null and repeated
ids are separate documents. An empty table gives no pieces. Texts are tokenized whole.
"""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernloom.llm.common import staged

CAPACITY = 2048
NODES, REPAIRS = 20_000, 25_000
SINGLES = 200  # sequences of one pattern that repairs may take apart
OPEN = 32  # branches of the search that hold their enumeration; those above start theirs anew at their turn
SEPARATOR = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: byte -> character, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, specials: bool = True):
    """text -> ids (uint32 array), the same as ``tokenizers`` gives for the file with
    add_special_tokens=False: added tokens that the text spells out have their own ids, unless
    ``specials`` is false; then they are plain text. Byte-level BPE whose merges are in id order runs
    in the faster ``tiktoken``, but for texts with runs too long for its pattern."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab = model["vocab"]
    ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    added = spec.get("added_tokens", [])
    plain = plain and all(t.get("special") and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
    if model.get("type") == "BPE" and plain and ordered and not model.get("ignore_merges"):
        import tiktoken

        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        # the split pattern of byte-level pre-tokenizers, a fixed value
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        slow = _Slow(vocabulary, specials)

        def encode(text: str) -> np.ndarray:
            try:
                if specials:
                    return fast.encode_to_numpy(text, allowed_special="all")
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the pattern gave up on a run of hundreds of thousands of characters
                return slow(text)

        return encode
    return _Slow(vocabulary, specials)


class _Slow:
    """The file's own tokenizer, read when it is first needed."""

    def __init__(self, vocabulary: str, specials: bool) -> None:
        self.vocabulary, self.specials, self.found = vocabulary, specials, None

    def __call__(self, text: str) -> np.ndarray:
        if self.found is None:
            from tokenizers import Tokenizer

            self.found = Tokenizer.from_file(self.vocabulary)
            self.found.encode_special_tokens = not self.specials
        return np.array(self.found.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, _task and _rank (its rank within its
    task and length)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        end = np.array([separator], np.uint32)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = np.concatenate([encode(text), end]).astype("<u4") if text else end
                start, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
                while start < len(ids):
                    n = stop - start
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), task, seen[n]))
                    seen[n] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) if rows else [()] * 7
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over equal sequences: [(lengths, how many sequences)]."""
    by_gap: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g, open_ in by_gap.items() if g >= length and open_), default=None)
            if gap is None:
                fit = capacity // length
                full, rest = divmod(left, fit)
                for k, n in ((fit, full), (rest, 1 if rest else 0)):
                    if n:
                        by_gap.setdefault(capacity - k * length, []).append([(length,) * k, n])
                left = 0
                continue
            lengths, n = by_gap[gap].pop()
            used = min(n, left)
            if n > used:
                by_gap[gap].append([lengths, n - used])
            by_gap.setdefault(gap - length, []).append([(*lengths, length), used])
            left -= used
    return [(tuple(x), n) for open_ in by_gap.values() for x, n in open_]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of sequences: total length, or lengths that can't share (all thresholds)."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    n = np.zeros(capacity + 2, np.int64)
    for k, c in counts.items():
        n[k] = c
    mass = np.arange(capacity + 2) * n
    up, upm = np.cumsum(n[::-1])[::-1], np.cumsum(mass[::-1])[::-1]
    half = capacity // 2 + 1
    for t in range(0, half):
        big = up[capacity - t + 1] if t else 0
        mid = up[half] - (up[capacity - t + 1] if t else 0)
        mid_mass = upm[half] - (upm[capacity - t + 1] if t else 0)
        small = upm[max(t, 1)] - upm[half]
        best = max(best, int(big + mid + max(0, -(-(small - (mid * capacity - mid_mass)) // capacity))))
    return best


def _dominated(filling: tuple[int, ...], waste: int, others: int) -> bool:
    """Whether one of the lengths left out (bits of ``others``) can take the place of one or more of
    the filling's: larger than these and still fitting, or as large as several."""
    some = several = 0  # bits: sums of one or more of the filling's lengths, of two or more
    for x in filling:
        several |= several << x | some << x
        some |= some << x | 1 << x
    wider, reach = some << 1 if waste else 0, 1
    while reach < waste:  # sums and up to ``waste`` more
        step = min(reach, waste - reach)
        wider |= wider << step
        reach += step
    return bool(others & (several | wider))


def _of_sums(lengths: list[int], counts: list[int], gap: int, least: int = 0) -> Iterator[tuple[int, ...]]:
    """All choices of ``lengths`` (descending, each ``counts`` times at most) of a sum from ``least``
    to ``gap``, larger sums first. Suffixes know the sums that they can make, so there are no dead ends."""
    reach, keep = [1], (1 << gap + 1) - 1
    for x, n in zip(reversed(lengths), reversed(counts)):
        out = now = reach[-1]
        for _ in range(min(n, gap // x)):
            now = now << x & keep
            out |= now
        reach.append(out)
    reach.reverse()
    for total in range(gap, max(least, 0) - 1, -1):
        if not reach[0] >> total & 1:
            continue
        stack = [(0, total, ())]
        while stack:
            i, rest, chosen = stack.pop()
            while rest:  # the next length that may take part
                x = lengths[i]
                if x <= rest:
                    ways = [k for k in range(1, min(counts[i], rest // x) + 1) if reach[i + 1] >> rest - k * x & 1]
                    without = reach[i + 1] >> rest & 1
                    if ways:
                        if without:
                            stack.append((i + 1, rest, chosen))
                        for k in ways[:-1]:
                            stack.append((i + 1, rest - k * x, chosen + (x,) * k))
                        k = ways[-1]
                        rest, chosen = rest - k * x, chosen + (x,) * k
                i += 1
            yield chosen


def _quick(left: np.ndarray, gap: int, width: int = 4) -> list[tuple[int, ...]]:
    """A few good fillings without an enumeration: the two largest lengths vary, the rest is filled
    from above; less waste first, then larger lengths."""
    there = np.flatnonzero(left[: gap + 1])
    if not len(there):
        return [()]
    below = np.zeros(gap + 1, np.int64)  # the largest length left that is <= the index
    below[there] = there
    below = np.maximum.accumulate(below)

    def filled(key: tuple[int, ...]) -> tuple[int, ...]:
        room, top, out, used = gap - sum(key), key[-1], list(key), Counter(key)
        while room > 0:
            c = int(below[min(room, top)])
            while c and used[c] >= left[c]:
                c = int(below[c - 1])
            if not c:
                break
            out.append(c)
            used[c] += 1
            room -= c
            top = c
        return tuple(out)

    first = there[::-1]
    second = below[np.minimum(gap - first, first)]
    second = np.where((second == first) & (left[first] < 2), below[np.maximum(np.minimum(gap - first, first) - 1, 0)], second)
    order = np.argsort(gap - first - second, kind="stable")[:width]
    found = {filled((int(first[i]), int(second[i])) if second[i] else (int(first[i]),)) for i in order}
    return sorted(found, key=lambda f: (-sum(f), [-x for x in f]))


def fillings(left: np.ndarray, gap: int, slack: int = CAPACITY) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``gap`` from ``left`` that waste ``slack`` at most, good ones first; ()
    if nothing fits. An exact single length dominates all others."""
    if gap < len(left) and left[gap] and gap:
        yield (gap,)
        return
    there = np.flatnonzero(left[: gap + 1])[::-1]
    if not len(there):
        yield ()
        return
    bits = 0
    for x in there.tolist():
        bits |= 1 << x

    def kept(some: Iterable[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
        for f in some:
            if not f or sum(f) < gap - slack:
                continue
            others = bits
            for x, n in Counter(f).items():
                if n >= left[x]:
                    others &= ~(1 << x)
            # what still fits beside a filling makes it dominated, too
            waste = gap - sum(f)
            if not others & ((1 << waste + 1) - 1) and not _dominated(f, waste, others):
                yield f

    quick = _quick(left, gap)
    yield from kept(quick)
    yield from kept(f for f in _of_sums(there.tolist(), left[there].tolist(), gap, gap - slack) if f not in quick)


@dataclass
class _Frame:
    """A branch of the search: the pattern that led to it, and how many of its own were taken."""

    led: Pattern | None
    used: int
    waste: int
    slack: int
    taken: int = 0
    branches: Iterator[Pattern] | None = None


def _branch_and_bound(start: np.ndarray, best_n: int, bound: int, capacity: int, nodes: int) -> list[Pattern] | None:
    """A packing in fewer than ``best_n`` sequences, the best one found; None if there is none.

    Thousands of branches can be open above one another. All share one array of counts, and only the
    last ``OPEN`` hold the state of their enumeration."""
    total = int((start * np.arange(len(start))).sum())
    left, best = start.copy(), None

    def take(pattern: Pattern, sign: int) -> None:
        for k, m in Counter(pattern[0]).items():
            left[k] -= sign * m * pattern[1]

    def slack(waste: int) -> int:
        return (best_n - 1) * capacity - total - waste

    def opened(slack: int) -> Iterator[Pattern]:
        """The largest length with each filling, as often as the counts allow and once."""
        largest = int(np.flatnonzero(left)[-1])
        without = left.copy()
        without[largest] -= 1
        for f in fillings(without, capacity - largest, slack):
            most = min(int(left[k]) // m for k, m in Counter((largest, *f)).items())
            yield from (((largest, *f), n) for n in ((most, 1) if most > 1 else (1,)))

    # depth first; ``left`` is what the last frame has to pack
    stack = [_Frame(None, 0, 0, slack(0))]
    while stack and nodes and best_n > bound:
        frame = stack[-1]
        if frame.branches is None:
            frame.branches = islice(opened(frame.slack), frame.taken, None)
        found = next(frame.branches, None)
        if found is None:
            stack.pop()
            if frame.led:
                take(frame.led, -1)
            continue
        nodes -= 1
        frame.taken += 1
        lengths, times = found
        used, waste = frame.used + times, frame.waste + (capacity - sum(lengths)) * times
        if slack(waste) < 0:
            continue
        take(found, 1)
        if left.any():
            stack.append(_Frame(found, used, waste, slack(waste)))
            if len(stack) > OPEN:
                stack[-OPEN - 1].branches = None
            continue
        if used < best_n:
            best_n, best = used, [found, *(f.led for f in reversed(stack[1:]))]
        take(found, -1)
    return best


def _completed(items: list[int], capacity: int, rng: random.Random) -> list[tuple[int, ...]]:
    """Sequences around the largest length left, each with one of its fullest fillings."""
    left, out = Counter(items), []
    while left:
        largest = max(left)
        left[largest] -= 1
        lengths = sorted((x for x, n in left.items() if n and x <= capacity - largest), reverse=True)
        best: list[tuple[int, ...]] = []
        for f in _of_sums(lengths, [left[x] for x in lengths], capacity - largest):
            if best and (sum(f) < sum(best[0]) or len(best) >= 6):
                break
            best.append(f)
        filling = rng.choice(best)
        left -= Counter(filling)
        left += Counter()
        out.append((largest, *filling))
    return out


def _repaired(patterns: list[Pattern], bound: int, capacity: int, repairs: int) -> list[Pattern]:
    """``patterns`` after up to ``repairs`` partial completions; never more sequences."""
    rng = random.Random(5)
    ordered = [(tuple(sorted(p, reverse=True)), n) for p, n in patterns]
    bins = {w: [p for p, n in ordered for _ in range(min(n, SINGLES)) if (sum(p) < capacity) == w] for w in (True, False)}
    rest = [(p, n - SINGLES) for p, n in patterns if n > SINGLES]
    total = sum(n for _, n in patterns)

    def drawn(from_: list, most: int) -> list:
        out = []
        for _ in range(min(len(from_), most)):
            i = rng.randrange(len(from_))
            from_[i], from_[-1] = from_[-1], from_[i]
            out.append(from_.pop())
        return out

    for turn in range(repairs):
        if total <= bound:
            break
        some = drawn(bins[True], rng.randint(2, 8)) + drawn(bins[False], rng.randint(2, 12 if turn % 8 else 30))
        items = [x for p in some for x in p]
        if turn % 8:
            new = [tuple(sorted(p, reverse=True)) for p in _completed(items, capacity, rng)]
        else:  # all ways to save a sequence among these
            start = np.bincount(items, minlength=capacity + 1)
            found = _branch_and_bound(start, len(some), -(-sum(items) // capacity), capacity, 400)
            new = [tuple(sorted(p, reverse=True)) for p, n in found for _ in range(n)] if found else some
        rank = lambda x: (-len(x), sum(sum(p) ** 2 for p in x))
        if rank(new) < rank(some):
            new = some
        total += len(new) - len(some)
        for p in new:
            bins[sum(p) < capacity].append(p)
    return [*rest, *Counter(bins[True] + bins[False]).items()]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, repairs: int = REPAIRS) -> list[Pattern]:
    """[(lengths, how many sequences)], never worse than best fit."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    best_n = sum(n for _, n in best)
    if best_n > bound:
        start = np.zeros(capacity + 1, np.int64)
        for k, n in counts.items():
            start[k] = n
        best = _branch_and_bound(start, best_n, bound, capacity, nodes) or best
        best = _repaired(best, bound, capacity, repairs)
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Segments of ranks by length: piece number k of a length, first <= k, goes to sequence
    ``sequence`` + (k - first) // ``times`` at ``offset`` + (k - first) % ``times`` * length."""
    rows, next_rank, sequence = [], Counter(), 0
    for lengths, n in patterns:
        offset = 0
        for length, times in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, next_rank[length], sequence, times, offset))
            next_rank[length] += n * times
            offset += length * times
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "times", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (length, _task, _rank and others) with sequence_id, offset, sequences (their number)
    and least_sequences (a lower bound of any packing's)."""
    pieces = staged(pieces, "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = complete_bins(histogram, capacity, nodes)
    table = places(patterns)
    by_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "_task", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    rows = pieces.join(base, ["length", "_task"]).withColumn("_k", F.col("_base") + F.col("_rank"))
    kept = [c for c in pieces.columns if c not in ("_task", "_rank", "sequence_id", "offset", "sequences", "least_sequences")]
    rows = rows.select(*kept, F.col("length").alias("_length"), "_k")
    fields = rows.select(*kept).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["sequence_id long", "offset long"])
    # one code per (length, rank): ranks are below 2**50
    codes = table["length"] << 50 | table["first"] if len(table.get("length", ())) else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, k = batch.column(len(kept)).to_numpy(), batch.column(len(kept) + 1).to_numpy()
            at = np.searchsorted(codes, length << 50 | k, side="right") - 1
            nth = k - table["first"][at]
            sequence = table["sequence"][at] + nth // table["times"][at]
            offset = table["offset"][at] + nth % table["times"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema).withColumns(
        {
            "sequences": F.lit(sum(n for _, n in patterns)).cast("bigint"),
            "least_sequences": F.lit(lower_bound(histogram, capacity) if histogram else 0).cast("bigint"),
        }
    )


def op8_packing(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs, default_vocabulary()))
