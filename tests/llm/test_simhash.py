import random

import numpy as np
import xxhash

from kernloom.llm import simhash as S


def brute_components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted(rng, n_seeds, copies):
    out = [0]
    for _ in range(n_seeds):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(copies)):
            out.append(f)
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
    return sorted(set(out))


def test_fingerprint_brute():
    for t in ("One two THREE four\x0bfive é", "a", "", None, "É É É a b" * 50):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0
        assert S.fingerprint(t) == want


def test_tree_finds_all_components():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    tight = {base ^ sum(1 << rng.randrange(14) for _ in range(rng.randrange(9))) for _ in range(900)}
    wide = {base & 0xFFFF | rng.getrandbits(48) << 16 for _ in range(700)}
    fps = np.array(sorted(f & (1 << 64) - 1 for f in tight | wide), np.uint64)
    union = S._Union(len(fps))
    fps = fps[np.argsort(S.gray_rank(fps))]
    S._tree_links(fps, 3, union, 0)
    assert union.label.tolist() == brute_components([int(f) for f in fps])
    # Gray neighbours differ in one bit
    codes = np.arange(64, dtype=np.uint64)
    by_rank = codes[np.argsort(S.gray_rank(codes))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def test_links_and_components_in_spark(spark):
    rng = random.Random(3)
    fps = planted(rng, 150, 9)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = [(i, f) for i, f in enumerate(signed)] + [(1000 + i, f) for i, f in enumerate(signed[:20])]
    want = brute_components(fps)
    for split in (5000, 2):
        real = S.SPLIT
        df = spark.createDataFrame(rows, "doc_id bigint, simhash bigint")
        S.links.__defaults__ = (3, split)
        try:
            got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
        finally:
            S.links.__defaults__ = (3, real)
        assert [got[i].component_id for i in range(len(fps))] == want
        assert sum(r.stays for r in got.values()) == len(set(want))


def test_edges(spark):
    df = spark.createDataFrame([(7, "a b c d", "k"), (7, "a b c d", "k"), (None, None, ""), (None, "", "q"), (3, "x", None)], "doc_id bigint, text string, simhash string")
    rows = S.op7_simhash(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (3, 3), (7, 7), (7, 7)]
    assert {r.fingerprint for r in rows if r.doc_id is None} == {"0" * 16}
    kept = S.near_duplicates(S.with_fingerprint(df)).where("stays")
    assert kept.count() == 3
    assert S.op7_simhash(df.limit(0)).count() == 0
