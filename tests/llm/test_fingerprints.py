import hashlib
import re
import unicodedata

import xxhash

from kernloom.llm import fingerprints as P

TEXTS = {
    5: "Straße  ＡＢＣ ﬁn x",
    9: "STRASSE abc fin X ",
    1: None,
    2: "",
    7: "Café \t\n noir",
    8: "CAFÉ noir",
    3: "plain Ascii",
    4: "plain  ascii\n",
    6: "😀😁😂🤣😃 tail é",
}


def canon(t):
    n = unicodedata.normalize
    return re.sub(r"\s+", " ", n("NFKC", n("NFKC", t or "").casefold())).strip(" ")


def check(rows, texts, buckets_ok=True):
    order = sorted(texts, reverse=True)
    for r in rows:
        t = texts[r.doc_id] or ""
        nxt = texts[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canon(t) == canon(edited)) and r.near_next == float(canon(t) == canon(nxt))
        same = sorted(d for d in texts if canon(texts[d]) == canon(t))
        assert (r.class_id, r.copies) == (same[0], len(same))
        assert len(r.fingerprint) == 64


def test_brute_force(spark):
    df = spark.createDataFrame([(d, t, "f") for d, t in TEXTS.items()], "doc_id bigint, text string, fingerprint string")
    rows = P.op5_document_fingerprints(df).collect()
    assert len(rows) == len(TEXTS)
    check(rows, TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[5].fingerprint == by[9].fingerprint != by[3].fingerprint == by[4].fingerprint
    seed = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), 42)
    assert len({r.fingerprint for r in rows}) == len({canon(t) for t in TEXTS.values()}) and seed


def test_neighbours_over_many_buckets(spark):
    texts = {i * 7919 % 100003: f"t{i % 50} " * (i % 9) for i in range(5000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    check(P.op5_document_fingerprints(df).collect(), texts)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id bigint, text string")
    rows = P.op5_document_fingerprints(df).collect()
    assert len(rows) == 4
    assert P.op5_document_fingerprints(df.limit(0)).count() == 0
    assert P.op5_document_fingerprints(df.where("doc_id = 1").limit(1)).first().near_next == 1.0


def test_colliding_buckets_are_divided(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id bigint, text string")
    real = P.digest
    try:
        P.digest = lambda canon: P.F.lpad(P.F.lit("7"), 64, "0")
        prints = docs.select("doc_id", P.F.lpad(P.F.lit("7"), 64, "0").alias("fingerprint"))
        got = {r.doc_id: (r.class_id, r.copies) for r in P.exact_groups(docs, prints).collect()}
    finally:
        P.digest = real
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}
