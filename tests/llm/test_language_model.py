import math
import random
import zlib
from collections import Counter

import numpy as np

from kernloom.llm import language_model as M


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def base_scores(rows):
    """n_tokens, n_known, N and the base score of each row, from the definition."""
    c = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            c.update(M.words(t))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for _, t in rows:
        tokens = [*M.words(t), "end"]
        out.append((len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    return out


def test_query_is_brute_force_and_beats_base(spark):
    rng = random.Random(8)
    tokens = [f"w{i}" for i in range(60)] + ["É", "A\x0bB"]
    rows = []
    for i in range(900):
        at = rng.randrange(60)
        text = []
        for _ in range(rng.randrange(60)):
            at = (at * 7 + rng.randrange(3)) % len(tokens)
            text.append(tokens[at])
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (None, "w1 never-seen w2"), (3, rows[3][1]), (902, "z" * 5000 + " W3")]
    rows += [(2000 + i, f"rare{i} " * 3) for i in range(200)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, score string").repartition(6)
    got = M.op6_lm_scoring(df).collect()
    want = base_scores(rows)
    key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
    wanted = sorted([(i, held(i), *w[:3], w[3]) for (i, _), w in zip(rows, want)], key=key)
    found = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for a, b in zip(wanted, found):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(a[5]))
    learnt = M.learn_vocabulary
    try:  # most words not local: their counts come from the join
        M.learn_vocabulary = lambda counts: learnt(counts, 20)
        again = M.op6_lm_scoring(df).collect()
    finally:
        M.learn_vocabulary = learnt
    for a, b in zip(wanted, sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in again], key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(a[5]))
    test = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in test) > 0.9 * sum(r.base_score for r in test)
    assert M.op6_lm_scoring(df.limit(0)).count() == 0


def small_model(size=700, local=None):
    words = [f"w{i}".encode() for i in range(size)]
    count = np.arange(size, 0, -1)
    rare = np.zeros(M.RARE)
    rare[:5] = 40
    return words, M.Vocabulary(np.array([M.word_hash(w) for w in words]), np.array([M.ending(w) % M.RARE for w in words]), count, int(count.sum() + 200), size + 90, rare, rare / 4)


def brute_log(model, vocabulary, code, history):
    """log10 P(code | history) by the definition, one branch at a time."""
    tree, mask = vocabulary.tree, (1 << 64) - 1
    one, two = history
    features = [one * int(M._FEATURES[0]), two * int(M._FEATURES[1]), (one * (1 << 20) + two) * int(M._FEATURES[2])]
    item, out = int(model.item[code]), 0.0
    for at in range(tree.start[item], tree.start[item] + tree.depth[item]):
        logits = [float(x) for x in tree.shares[tree.node[at]]]
        for k, f in enumerate(features):
            if k == 2 and tree.level[at] >= M.PAIR_LEVELS:
                continue
            x = (f & mask) ^ (int(tree.node[at]) * int(M._NODE) & mask)
            x ^= x >> 29
            row = (x * int(M._MIX) & mask) >> 48
            logits = [a + float(w) for a, w in zip(logits, model.weights[row])]
        out += (logits[tree.branch[at]] - math.log(sum(math.exp(x) for x in logits))) / math.log(10)
    return out


def test_score_is_brute_force_and_a_distribution():
    _, vocabulary = small_model()
    model = M.Model(vocabulary)
    rng = np.random.default_rng(0)
    codes = np.concatenate([rng.integers(0, 700, 3000), M.LOCAL + rng.integers(0, M.ENDINGS, 200)])
    rng.shuffle(codes)
    first = np.arange(len(codes)) % 50
    histories = model.histories(codes, first)
    before = model.logs(codes, histories).sum()
    for _ in range(5):
        model.step(codes, histories)
    got = model.logs(codes, histories)
    assert got.sum() > before
    back = lambda i, k: int(codes[i - k]) if first[i] >= k else M._START
    for i in range(120):
        assert abs(got[i] - brute_log(model, vocabulary, int(codes[i]), (back(i, 1), back(i, 2)))) < 1e-3
    leaves = [*range(700), *range(M.LOCAL, M.LOCAL + M.RARE)]
    for history in ((3, 9), (M._START, M._START), (M.LOCAL + 5, 0)):
        assert abs(sum(10 ** brute_log(model, vocabulary, c, history) for c in leaves) - 1) < 1e-4


def test_gradient_is_the_softmax_gradient():
    _, vocabulary = small_model(40)
    rng = np.random.default_rng(1)
    codes, first = rng.integers(0, 40, 500), np.arange(500) % 9
    model = M.Model(vocabulary, rng.normal(0, 0.1, (M.TABLE, M.FAN)).astype(np.float32))
    histories, old = model.histories(codes, first), model.weights.copy()
    token, branch, node, where, rows = model.paths(codes, histories)
    logits = model.logits(node, where, rows).astype(float)
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    p[np.arange(len(p)), branch] -= 1
    want = np.zeros((M.TABLE, M.FAN))
    for w, r in zip(where, rows):
        np.add.at(want, r, p if w is None else p[w])
    model.step(codes, histories)
    want *= (M.STEP / np.sqrt((want**2).sum(1) + 1))[:, None]
    assert np.allclose(old - model.weights, want, atol=1e-4) and (np.bincount(rows[0]).max() > M._RUN)


def test_vocabulary_with_ties_at_the_limit(spark):
    rows = [(M.word_hash(M.END), 3, 5)] + [(i * 7919, i % 16, 1) for i in range(1, 3001)]
    counts = spark.createDataFrame(rows, "h long, kind int, n long")
    found = M.learn_vocabulary(counts, 1000)
    assert 850 < len(found.hashes) <= 1000 and found.hashes[0] == M.word_hash(M.END)
    assert found.total == 3005 and found.distinct == 3001
    assert found.rare_total.sum() == 3001 - len(found.hashes) and (found.rare_total >= 0).all()
    # a leaf for each local word and each ending, shares that sum to one
    assert (found.tree.depth > 0).all() and np.allclose(np.exp(found.tree.shares).sum(1), 1, atol=1e-4)


def test_segments_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """While the operator works; the session's own limit is back afterwards."""
    from kernloom.llm import common, language_model

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)
    monkeypatch.setattr(language_model, "staged", lambda df, what, *more: seen.append((what, spark.conf.get(name), more)) or common.staged(df, what, *more))
    spark.conf.set(name, f"{common.BATCH_MB}m")
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], "doc_id long, text string")
    assert language_model.op6_lm_scoring(docs).count() == 40
    assert {x for _, x, _ in seen} == {f"{language_model.BATCH_MB}m"} and spark.conf.get(name) == f"{common.BATCH_MB}m"
    assert ("lm-rows", "4m", (8,)) in seen
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)
