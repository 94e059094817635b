import zlib

import numpy as np

from kernloom.llm import toxicity as X


def made(rng, n):
    stems = ["the", "house", "river", "walks", "green", "slowly", "table", "cloud", "winter", "bread"]
    clean = [" ".join(rng.choice(stems, rng.integers(5, 400))) for _ in range(n)]
    toxic = [t + " " + " ".join(rng.choice(["scumbag", "idiotic", "worthless"], 1 + len(t) // 300)) for t in clean[: n // 2]]
    return toxic, clean[n // 2 :]


def test_held_out_and_misspellings():
    rng = np.random.default_rng(1)
    toxic, clean = made(rng, 900)
    rows = [(t, 1) for t in toxic[:300]] + [(t, 0) for t in clean[:300]]
    windows = [(X.words_of(t)[a : a + X.WINDOW], y) for t, y in rows for a in range(0, len(X.words_of(t)), X.WINDOW)]
    score = X.Scorer(X.train([w for w, _ in windows], [y for _, y in windows]))
    assert np.mean([score(t) > score(c) for t, c in zip(toxic[300:], clean[300:])]) > 0.95
    base = "the river walks slowly "
    assert score(base + "scumbagg wortthless") > score(base + "bread table")
    assert score("the " * 5000 + "scumbag") >= score("the " * 200) and 0 <= score(None) == score("") <= 1


def test_query_and_edges(spark):
    docs = spark.createDataFrame(
        [(i, None if i % 17 == 0 else ("fine words here " * 9 + ("trash moron" if i % 3 == 0 else "")), "q") for i in range(60)] + [(None, "x", "q"), (5, "", "q"), (5, "", "q")],
        "doc_id bigint, text string, score string",
    )
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = X.op1_toxicity(docs, labels).collect()
    assert len(rows) == 63
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert X.op1_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in X.op1_toxicity(docs, labels.limit(0)).collect()} == {0.0} or max(r.score for r in X.op1_toxicity(docs, labels.limit(0)).collect()) < 1e-100
