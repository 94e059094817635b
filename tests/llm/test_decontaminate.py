import random

from kernloom.llm import decontaminate as D


def distance_inside(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (t != c)))
        row = new
    return min(row)


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def edited(rng, text, k):
    text = list(text)
    for _ in range(k):
        i = rng.randrange(len(text))
        text[i : i + 1] = rng.choice([[], ["x"], [text[i], "y"]])
    return "".join(text)


def test_find_is_brute_force():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice((12, 20, 34, 60)))) for i in range(12)] + [(90, "tiny item"), (91, " "), (92, None)]
    index = D.build_index([x for x in items if x[1] is not None])
    texts = [None, "", "tiny   ITEM here", sentence(rng, 300)]
    for _ in range(30):
        item = rng.choice(items[:12])[1]
        cut = edited(rng, item, rng.randrange(0, 1 + int(len(item) * 0.16)))
        texts.append(sentence(rng, rng.randrange(60)) + "  " + cut.upper() + "\n" + sentence(rng, rng.randrange(60)))
    got = D.find(texts, index)
    for t, g in zip(texts, got):
        plain = D.folded(t)
        want = {item for own in index.of for item, w, k in zip(own.items, own.texts, own.budgets) if distance_inside(w, plain) <= k}
        want |= {item for item, s in index.short if s in plain}
        assert set(g) == want
    assert got[2] == {90: (0, 0, 9)}


def test_long_texts_in_slices(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(D, "SLICE", 3000)
    item = sentence(rng, 30)
    index = D.build_index([(1, item)])
    for at in (0, 2900, 3001, 5990, 20000):
        filler = sentence(rng, 6000)
        text = filler[:at] + " " + item + " " + filler[at:]
        assert set(D.find([text, "short"], index)[0]) == {1}


def test_spark(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, 30)) for i in range(5)] + [(None, "a b c d e f g h i j"), (7, None)]
    rows = [(1, "x " + items[0][1] + " y", 3), (2, sentence(rng, 80), 4), (None, items[1][1], 5), (4, None, 6), (1, "x " + items[0][1] + " y", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.op3_decontamination(docs, bench).collect())
    assert got == [(0, 1, 0), (1, 0, 0), (1, 0, 0)]
    assert sorted(r.doc_id for r in D.without_leaks(docs, bench).collect()) == [2, 4]
    assert D.op3_decontamination(docs.limit(0), bench).count() == 0
    assert D.without_leaks(docs, bench.limit(0)).count() == 5


def test_no_edit_budget_is_missed_at_any_length():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for length in [*range(16, 41), 160, 199]:
        assert length + 1 - (int(length * D.SHARE) + 1) * D.q_of(length) >= 1
        missed = 0
        for trial in range(25):
            item = "".join(rng.choice(letters[:26]) for _ in range(length))
            k, now = int(length * D.SHARE), list(item)
            for e in range(k):  # spread, so that they cut as many q-grams as they can
                at = min((2 * e + 1) * length // (2 * k), len(now) - 1)
                way = rng.randrange(3)
                if way == 0:
                    now[at] = "#"
                elif way == 1:
                    now.insert(at, "#")
                else:
                    del now[at]
            text = "".join(rng.choice(letters) for _ in range(300)) + "|" + "".join(now) + "|" + "".join(rng.choice(letters) for _ in range(300))
            got = D.find([text], D.build_index([(7, item)]))[0]
            missed += 7 not in got or got[7][0] > k
        assert not missed, length


def test_common_grams_are_expanded_part_by_part():
    real = D.HITS
    items = [(i, "the same words again and again in every item " * 3 + f"item number {i}") for i in range(30)]
    texts = ["x " + "the same words again and again in every item " * 40 + "item number 3", "nothing here at all, or nearly so"]
    want = D.find(texts, D.build_index(items))
    try:
        D.HITS = 500
        assert D.find(texts, D.build_index(items)) == want and want[0] and not want[1]
    finally:
        D.HITS = real


def test_gram_hashes_tell_grams():
    codes = D.codes_of("abcabcabcxabcabd")
    for q in range(1, 9):
        h = D.gram_hashes(codes, q)
        grams = [tuple(codes[i : i + q]) for i in range(len(codes) - q + 1)]
        assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))
        assert len(set(zip(h.tolist(), grams))) == len(set(grams))
