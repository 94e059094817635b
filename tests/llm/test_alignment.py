"""Alignment against plain loops with the installed libraries."""

import collections
import hashlib
import random

import numpy as np
import pytest

from kernloom.llm import alignment as A
from kernloom.llm import packing, pieces

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def plain_groups(a, b):
    """[(A places, B places)] of two lists of token lengths."""
    ends = lambda sizes: np.cumsum(sizes).tolist()
    ea, eb = ends(a), ends(b)
    out, ia, ib = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        ja, jb = ea.index(cut) + 1, eb.index(cut) + 1
        out.append((list(range(ia, ja)), list(range(ib, jb))))
        ia, ib = ja, jb
    return out


def plain(rows):
    slow = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    slow.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    alphabet, names = packing._byte_alphabet(), {i: t for t, i in slow.get_vocab().items()}
    held, counts = [], collections.Counter()
    for key, text in rows:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in names[x]) for x in a]
        bytes_b = [bytes([int(model.id_to_piece(x)[3:-1], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        want = (" " + (text or "")).encode()
        groups = None
        if text and b"".join(bytes_a) == want == b"".join(bytes_b):
            groups = [([a[i] for i in p], [b[j] for j in q]) for p, q in plain_groups([len(x) for x in bytes_a], [len(x) for x in bytes_b])]
            counts.update({(x, y) for p, q in groups for x in p for y in q})
        held.append((key, groups))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for key, groups in held:
        if groups is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((key, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def tokens(ids, sizes):
    return A.Tokens(np.array(ids, np.int64), np.cumsum(sizes))


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_groups_and_links_of_random_cuts(pairs, monkeypatch):
    monkeypatch.setattr(A, "PAIRS", pairs)
    rng = random.Random(1)
    shown = A.GroupText(5, 4)
    for _ in range(400):
        total = rng.randrange(1, 40)

        def cut():
            at = sorted({*rng.sample(range(1, total), rng.randrange(0, total)), total}) if total > 1 else [1]
            return np.diff([0, *at]).tolist()

        sa, sb = cut(), cut()
        ia, ib = [rng.randrange(5) for _ in sa], [rng.randrange(4) for _ in sb]
        a, b = tokens(ia, sa), tokens(ib, sb)
        want = plain_groups(sa, sb)
        ga, gb = A.groups_of(a, b)
        assert ga.tolist() == [g for g, (p, _) in enumerate(want) for _ in p]
        assert gb.tolist() == [g for g, (_, q) in enumerate(want) for _ in q]
        first, last = A.overlaps(a, b)
        spans = lambda sizes: list(zip(np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes)))
        for (x, y), f, t in zip(spans(sa), first, last):
            assert [j for j, (p, q) in enumerate(spans(sb)) if p < y and x < q] == list(range(f, t + 1))
        links = collections.Counter((ia[i], ib[j]) for p, q in want for i in p for j in q)
        codes, n = A.link_counts(a, b, ga, gb)
        assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(k) for c, k in zip(codes, n)} == dict(links)
        assert shown(a, b, ga, gb) == ";".join(",".join(str(ia[i]) for i in p) + "|" + ",".join(str(ib[j]) for j in q) for p, q in want)


def test_one_group_of_many_tokens_is_counted_by_ids(monkeypatch):
    n = 200_000
    a, b = tokens([1, *[2] * (n - 1)], [3, *[2] * (n - 1)]), tokens([7] * (n - 1) + [8], [2] * (n - 1) + [3])
    ga, gb = A.groups_of(a, b)
    assert ga.max() == 0 == gb.max()
    codes, links = A.link_counts(a, b, ga, gb)
    assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(k) for c, k in zip(codes, links)} == {(1, 7): n - 1, (1, 8): 1, (2, 7): (n - 1) ** 2, (2, 8): n - 1}


@pytest.mark.parametrize("block", [2, 2000])
def test_documents_against_the_libraries(spark, block):
    rng = random.Random(2)
    parts = ["the house", " cat", "é", "中文", "😀", "\n\n", "  ", "<|endoftext|>", "</s>", "<0x41>", "123", "!?", "\t", "\0", "\r\n", "naïve", "é"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "with ▁ inside"), (103, "   "), (5, "again"), (None, "no id"), (104, "copy of one text")] + [(200 + i, "copy of one text") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, block string, n int").repartition(3)
    found = A.op11_alignment(docs, block_rows=block)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.op11_alignment(docs).count() == 0


def test_long_runs():
    left, right = A.byte_level(packing.default_vocabulary()), A.piece_level(pieces.default_model())
    for text in (" " * 1_000_000 + "a", "a" * 300_000, "\n" * 300_000):
        a, b, ga, gb = A.align(text, left, right)
        assert a.ends[-1] == b.ends[-1] == len(text) + 1 and ga[-1] == gb[-1]
