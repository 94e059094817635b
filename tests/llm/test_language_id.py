import zlib
from collections import Counter

from kernloom.llm import language_id as L


def brute_profile(text, depth):
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    s = " " + " ".join(low.split()) + " " if low.split() else ""
    grams = Counter(g for k in (1, 2, 3) for i in range(len(s) - k + 1) if (g := s[i : i + k]) != " ")

    def code(g):
        n = 0
        for c in g:
            n = n << 21 | (1 if c == " " else ord(c))
        return n

    grams = Counter({code(g): n for g, n in grams.items() if not (len(g) == 3 and g[1] == " ")})
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))][:depth]


def test_profile_is_brute_force():
    letters = L._Letters()
    for t in ("Der Hund!! bellt, ÄÖ  42x", "a", "", "123", "é" * 500 + " b", "x y " * 3000):
        assert L.profile(t, letters, 20).tolist() == brute_profile(t, 20)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.n_chars) for r in docs.collect()}
    rows = L.op4_language_id(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.97


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string, score string"
    df = spark.createDataFrame(
        [(1, "the cat and the dog", "en", "s"), (2, None, "en", None), (3, "", None, None), (None, "le chat et le chien", "fr", ""), (5, "!! 12", "x", ""), (5, "!! 12", "x", "")],
        schema,
    )
    got = L.op4_language_id(df).collect()
    assert len(got) == 6 and {r.doc_id: r.lang_pred for r in got}[2] == "und" and {r.doc_id: r.lang_pred for r in got}[5] == "und"
    assert L.op4_language_id(df.limit(0)).count() == 0
    out = L.identify(df, L.learn_profiles(df))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.count() == 6
