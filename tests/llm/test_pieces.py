"""Piece encoding against the installed library; the character map on one built here."""

import hashlib
import random
import struct

import numpy as np
import pytest

from kernloom.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
ALPHABET = [" ", "  ", "▁", "a", "b", "the", "in", "\n", "\t", "é", "中", "文", "😀", "<s>", "</s>", "<0x41>", "\0", "\r", " ", "　", "é", "�", "1", ".", "ﬁ", "﻿", "​"]


@pytest.fixture(scope="module")
def both():
    path = pieces.default_model()
    return pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_spans_and_text_equal_the_library(both):
    own, library = both
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40)))
        ids, begins, ends = own.encode_with_spans(text)
        want = library.encode(text)
        assert ids.tolist() == want == own.encode(text).tolist()
        assert own.decode([*want, own.end]) == library.decode([*want, 2])
        data, at = text.encode(), 0
        for i, a, b in zip(want, begins, ends):
            shown = data[a:b].replace("▁".encode(), b" ")
            assert a == at and (shown == own.spoken[i] or (a == 0 and b" " + shown == own.spoken[i]))
            at = b
        assert at == (len(data) if want else 0)


def test_merges_of_words_equal_the_library(both):
    own, library = both
    rng = random.Random(2)
    for n in [*range(1, 60), 500]:
        word = "".join(rng.choice("abcdeinrst▁é中") for _ in range(n)) + "x"
        shown = own.normalised(word)[0]
        assert np.frombuffer(own._word(shown), np.int32).tolist() == library.encode(word)
        assert own.merged(shown) == own._merged_short(shown)


def test_decoding_of_any_ids(both):
    own, library = both
    rng = random.Random(3)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 0, 1, 2]) for _ in range(rng.randrange(0, 12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", [" " * 200_000 + "a", "a" * 200_000, "中" * 50_000, "▁" * 50_000, "\n" * 50_000])
def test_long_runs(both, text):
    own, library = both
    assert own.encode(text).tolist() == library.encode(text)


def test_a_full_word_table_starts_anew(both, monkeypatch):
    own, library = pieces.Pieces(pieces.default_model()), both[1]
    monkeypatch.setattr(pieces, "WORDS", 5)
    for text in ("a b c", "d e f g", "a a b", " ".join(map(str, range(30))), "b c "):
        assert own.encode(text).tolist() == library.encode(text)


def compiled(table: dict[str, str]) -> bytes:
    """A double-array trie of ``table``, written plainly: each node's children sit at its base xor the byte."""
    trie: dict = {}
    texts = b""
    for key, value in table.items():
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = len(texts)
        texts += value.encode() + b"\0"
    units, taken = {0: 0}, {0}
    todo = [(0, trie)]
    while todo:
        at, node = todo.pop()
        labels = [0 if b is None else b for b in node]
        base = next(b for b in range(256, 100_000, 256) if not any(b ^ x in taken for x in labels) and b not in taken)
        taken.update(base ^ x for x in labels)
        taken.add(base)
        units[at] = units.get(at, 0) | (at ^ base) << 10 | (256 if None in node else 0)
        for b, child in node.items():
            if b is None:
                units[base] = child | 1 << 31
            else:
                units[base ^ b] = b
                todo.append((base ^ b, child))
    flat = [units.get(i, 0) for i in range(max(taken) + 1)]
    return struct.pack("<I", 4 * len(flat)) + struct.pack(f"<{len(flat)}I", *flat) + texts


def test_longest_prefixes_of_a_character_map():
    table = {"ﬁ": "fi", "①": "1", "é": "é", "éx": "!", "\t": " ", "ab": "c", "abcd": ""}
    m = pieces.CharacterMap(compiled(table))
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["ﬁ", "①", "e", "́", "x", "\t", "a", "b", "c", "d", "中", "😀"]) for _ in range(rng.randrange(0, 12)))
        out, begins, at = "", [], 0
        while at < len(text):
            key = max((k for k in table if text.startswith(k, at)), key=len, default=text[at])
            shown = table.get(key, key)
            begins += [len(text[:at].encode())] * len(shown)
            out += shown
            at += len(key)
        found, aligned = m.apply(text)
        assert found == out and aligned.tolist() == [*begins, len(text.encode())]


def test_extra_white_space_goes_where_the_model_says_so(both):
    own = pieces.Pieces(pieces.default_model())
    own.squeeze = True
    shown, begins = own.normalised("  a  b ")
    assert shown == "▁a▁b" and begins.tolist() == [2, 2, 3, 5, 6]
    assert own.normalised("   ")[0] == "" and own.normalised("")[0] == ""


def test_documents(spark, both):
    library = both[1]
    texts = [None, "", "one two", "one two", "\0▁ <s>", "中" * 3000, "é " * 20]
    rows = [(i if i != 3 else 2, t, "x", 1) for i, t in enumerate(texts)] + [(None, "z", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = [tuple(r)[:4] for r in pieces.op12_sentencepiece(docs).collect()]

    def of(key, text):
        ids = [*library.encode(text or ""), 2]
        return key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    assert sorted(found, key=str) == sorted((of(r[0], r[1]) for r in rows), key=str)
    encoded = pieces.encode_documents(docs)
    assert encoded.columns == ["doc_id", "ids", "begins", "ends"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded.where("doc_id <> 2")).collect()}
    assert back[4] == "\0  <s>" and back[5] == texts[5] and back[1] == ""
    assert pieces.op12_sentencepiece(docs.limit(0)).count() == 0
