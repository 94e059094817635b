import random

import corpus_pipeline as C

import numpy as np

from kernloom.llm import copies as N


def sets_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, parent = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def planted():
    """Chains of edits around the limit, one common passage, short texts, odd ones."""
    rng = random.Random(4)
    draw = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = draw(60), [None, "", " ", "a b", "A B", "a b c d e", "a b c d e f"]
    for _ in range(40):
        now = draw(rng.choice([5, 9, 30, 120, 400])) + passage * rng.randrange(2)
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(now))
            for _ in range(rng.randrange(1, max(2, len(now) // 40 + 2))):
                now[rng.randrange(len(now))] = f"x{rng.randrange(4000)}"
    base = draw(100)
    for _ in range(60):  # a large group, whose members differ from each other more than from the base
        now = list(base)
        now[rng.randrange(20, 80)] = "y%d" % rng.randrange(9999)
        now[rng.randrange(20, 80)] = "y%d" % rng.randrange(9999)
        texts.append(" ".join(now))
    rng.shuffle(texts)
    return texts


def test_stage_is_brute_force(spark):
    texts = planted()
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for split, ways in ((20_000, 4), (9, 1)):
        real = N.SPLIT, N.WAYS
        N.SPLIT, N.WAYS = split, ways
        try:
            got = {r.doc_id: r for r in N.near_copies(docs).collect()}
        finally:
            N.SPLIT, N.WAYS = real
        # no wrong link; of the links between different sets at least nine of ten are found
        groups = [got[i].component_id for i in range(len(texts))]
        assert all(want[g] == want[i] for i, g in enumerate(groups))
        sets = [frozenset(sets_of(t)) for t in texts]
        pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        assert sum(groups[i] == groups[j] for i, j in pairs) >= 0.9 * len(pairs) and len(pairs) > 50
        same = {}
        for s, g in zip(sets, groups):
            assert same.setdefault(s, g) == g
    kept = sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(groups))


def test_tree_and_masks_are_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, 4)).astype(np.uint64)
    prints = []
    for k in range(700):
        bits = np.unpackbits(base[k % 3].view(np.uint8), bitorder="little")
        bits[rng.choice(256, rng.integers(0, 45), replace=False)] ^= 1
        prints.append(np.packbits(bits, bitorder="little").view(np.uint64))
    prints = np.unique(np.stack(prints), axis=0)
    prints = prints[N.gray_order(prints)]
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2, dtype=int)
    want = {(i, j, int(d[i, j])) for i in range(len(prints)) for j in range(i + 1, len(prints)) if d[i, j] <= N.NEAR}
    got = [x for i, j, e in N.tree_pairs(prints) for x in zip(i.tolist(), j.tolist(), e.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    # masks: a pair is found once, at the first mask that it shares
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    masks = N.Masks(20, 10)
    weights = 1 << np.arange(masks.bits)
    found = []
    for t in range(masks.count):
        key = bits[:, masks.chosen[t]].astype(np.int64) @ weights + (t << N.SHIFT)
        order = np.argsort(key, kind="stable")
        n = np.full(len(key), 10)
        for i, j, _ in N._masked_pairs(key[order], n, prints[order], np.zeros(len(key), int), None, masks):
            found += [tuple(sorted(x)) for x in zip(order[i].tolist(), order[j].tolist())]
    share = [(i, j) for i, j, _ in want if any((bits[i, masks.chosen[t]] == bits[j, masks.chosen[t]]).all() for t in range(masks.count))]
    assert len(found) == len(set(found)) and set(found) == set(share) and len(share) > 1000


def test_masks_follow_the_number_of_nodes():
    found = [N.Masks.of(n) for n in (0, 1, 500_000, 2_000_000, 15_000_000, 1 << 33)]
    assert [m.bits for m in found] == [8, 8, 8, 10, 13, 22]
    for m in found:
        assert (1 - (1 - N.APART) ** m.bits) ** m.count <= N.MISSED < (1 - (1 - N.APART) ** m.bits) ** (m.count - 1)
        assert all(len(set(c)) == m.bits for c in m.chosen.tolist())


def test_parities_never_drop_a_similar_pair():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9, 50, 400, 5000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 60, n // 12).astype(np.uint64)]))
            if N.similar(a, b):
                apart = np.bitwise_count(N.parities(a) ^ N.parities(b)).sum(dtype=int)
                assert apart <= len(np.setxor1d(a, b)) and N.can_be_similar(N.sketch(a), N.sketch(b))


def test_wide_print_brute():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 300, 1000):
        found = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        ones = [0] * 256
        for x in found.tolist():
            for k in range(4):
                h = (x + 0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64)
                h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
                h = (h ^ (h >> 27)) * 0x94D049BB133111EB % (1 << 64)
                h ^= h >> 31
                for b in range(64):
                    ones[64 * k + b] += h >> b & 1
        bits = np.unpackbits(N.wide_print(found), bitorder="little").tolist()
        assert bits == [int(2 * x > len(found)) for x in ones]


def test_edges(spark):
    docs = spark.createDataFrame([(7, "a b c", "k"), (7, "A b c", "k"), (None, None, ""), (None, "", "q"), (3, "x", None)], "doc_id bigint, text string, lang string")
    rows = N.near_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (3, 3), (7, 7), (7, 7)]
    assert sum(r.stays for r in rows) == 3
    assert N.near_copies(docs.limit(0)).count() == 0
