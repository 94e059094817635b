"""SentencePiece BPE encoding with source offsets, and decoding.

A text is normalised by longest prefixes of the model's compiled character map (a double-array
trie over UTF-8), white space becomes U+2581, and every character of the result keeps the byte of
the source where it began. Pieces are spans of the normalised text, so the same alignment projects
them to byte spans of the source. A model without a map leaves characters as they are.

Merges take the highest score, then the leftmost pair. Where no piece of the vocabulary has
U+2581 after another character, no merge crosses the start of a word, so texts fall into words
that are looked up in a table of bounded size; any other vocabulary is merged text by text. Words
new to the table are merged by the installed library where the model has no character map, since
that is 20 times faster; ``merged`` gives the same.
Characters that are no piece become the byte pieces of their UTF-8 form, or the unknown id.

Null texts are empty: the end id alone. Texts are encoded whole. Null and repeated ids are
documents of their own; other columns of the input play no part. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
#: Words that a process keeps with their pieces; the table starts anew when it is full.
WORDS = 300_000
#: Up to this length, looking through all pairs is faster than a heap.
SHORT = 24
LAST = float("inf")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = found = 0
        while True:
            byte = data[at]
            at += 1
            found |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return found

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: the size of a double-array trie, the trie, and
    replacement texts that end with a zero byte."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that ``data`` has at ``at``."""
        units, found = self.units, None
        node = self._offset(units[0]) if units else 0
        for end in range(at, len(data) if units else at):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """The text with replacements, and the source byte where each of its characters begins (one
        more entry: the end). A replacement's characters all begin where its key does."""
        if not self.units:
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            return text, np.concatenate([[0], np.cumsum(width)])
        data = text.encode()
        out, begins, at = [], [], 0
        while at < len(data):
            match = self.longest(data, at)
            if match is None:
                head = data[at]
                match = (1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4), b""
                shown = data[at : at + match[0]].decode()
            else:
                shown = match[1].decode()
            out.append(shown)
            begins += [at] * len(shown)
            at += match[0]
        return "".join(out), np.array([*begins, len(data)], np.int64)


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("kernloom-one-each", _one_each)


class Pieces:
    """The model of a file: ``encode``, ``spans`` and ``decode``."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(_message(f.read()))
        pieces = [dict(_message(v)) for k, v in parts if k == 1]
        trainer = dict(_message(next((v for k, v in parts if k == 2), b"")))
        rules = dict(_message(next((v for k, v in parts if k == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        self.texts = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        if any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        self.rank = {t: -self.scores[i] for t, i in self.ids.items()}  # the least is merged first
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = next(i for i, t in enumerate(self.texts) if t == "</s>" and self.kinds[i] == CONTROL)
        self.control = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        # does any piece hold the start of a word inside?
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        self.words: dict[str, bytes] = {}
        self.library = None
        if self.by_word and self.prefix and self.escape and not self.squeeze and not self.map.units:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # characters that a piece takes up, and for byte pieces the number of bytes that it begins (-1: it goes on)
        self.steps = np.array([len(t) if k == NORMAL else int(k == UNKNOWN) for t, k in zip(self.texts, self.kinds)], np.int64)
        self.of = np.zeros(len(self.texts), np.int64)
        for byte, i in self.bytes.items():
            self.of[i] = -1 if 0x80 <= byte < 0xC0 else 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            self.steps[i] = self.of[i] > 0
        spoken = {NORMAL: lambda i: self.texts[i].replace(SPACE, " ").encode(), BYTE: lambda i: bytes([int(self.texts[i][1:-1], 16)]), UNKNOWN: lambda i: " ⁇ ".encode(), CONTROL: lambda i: b""}
        self.spoken = [spoken[k](i) for i, k in enumerate(self.kinds)]

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and the alignment: source byte of each character, and of the end."""
        out, begins = self.map.apply(text)
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != " " or i and out[i - 1] != " "]
            if keep and out[keep[0]] == " ":
                keep = keep[1:]
            if keep and out[keep[-1]] == " ":
                keep = keep[:-1]
            begins = begins[[*keep, keep[-1] + 1 if keep else len(out)]]
            out = "".join([out[i] for i in keep])
        if self.prefix and out:
            out, begins = " " + out, np.concatenate([begins[:1], begins])
        return (out.replace(" ", SPACE) if self.escape else out), begins

    def merged(self, text: str) -> list[str]:
        """The text's characters after all merges: the pair of the highest score, then the leftmost."""
        rank = self.rank
        symbols = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        after[-1:] = [-1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = symbols[left] + symbols[right]
                found = rank.get(both)
                if found is not None:
                    heapq.heappush(heap, (found, left, right, len(both)))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def _merged_short(self, text: str) -> list[str]:
        """``merged`` by looking through all pairs each time."""
        symbols, rank = list(text), self.rank
        while len(symbols) > 1:
            ranks = [rank.get(a + b, LAST) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == LAST:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _word(self, word: str) -> bytes:
        """Ids (int32) of a word or a whole text."""
        ids = array("i")
        for s in self._merged_short(word) if len(word) <= SHORT else self.merged(word):
            own = self.ids.get(s)
            if own is not None:
                ids.append(own)
            elif all(b in self.bytes for b in s.encode()):
                ids.extend(self.bytes[b] for b in s.encode())
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _of_words(self, words: list[str]) -> bytes:
        kept = self.words
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            pass
        missing = set(words).difference(kept)
        if len(kept) + len(missing) > WORDS:
            kept.clear()
            missing = set(words)
        if self.library is None:
            kept.update((w, self._word(w)) for w in missing)
        else:
            new = [w for w in missing if w != SPACE]  # the library puts nothing before an empty text
            kept.update(zip(new, [array("i", ids).tobytes() for ids in self.library.encode([w[1:] for w in new], num_threads=1)]))
            kept[SPACE] = self._word(SPACE)
        return b"".join([kept[w] for w in words])

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32) of the whole text, without an end id."""
        return np.frombuffer(self._encoded(self.normalised(text)[0]), np.int32)

    def _encoded(self, shown: str) -> bytes:
        if not shown:
            return b""
        if not self.by_word:
            return self._word(shown)
        if shown[0] == SPACE and SPACE * 2 not in shown:
            return self._of_words([SPACE + w for w in shown[1:].split(SPACE)])
        words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", shown)
        if shown[0] == SPACE:
            return self._of_words(words)
        return self._word(words[0]) + self._of_words(words[1:])

    def encode_with_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): each piece with the bytes of the source it stands for. A character's
        byte pieces share its bytes in order; what the model itself puts before a text is empty."""
        shown, begins = self.normalised(text)
        ids = np.frombuffer(self._encoded(shown), np.int32)
        steps = self.steps[ids]
        stop = np.cumsum(steps)  # in characters of the normalised text
        a, b = begins[stop - steps], begins[stop]
        split = np.flatnonzero(self.of[ids])  # byte pieces: at the first of each character, the number of its pieces
        if len(split):
            first = split[self.of[ids[split]] > 0]
            lead = first[np.searchsorted(first, split, side="right") - 1]
            nth, of = split - lead, self.of[ids[lead]]
            at, width = a[lead], (b - a)[lead]
            a[split], b[split] = at + width * nth // of, at + width * (nth + 1) // of
        return ids, a, b

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces: without the space that encoding puts first, bytes that are no UTF-8
        as U+FFFD each."""
        spoken, parts, at = self.spoken, [], 0
        for i, k in enumerate(ids):
            if k in self.control:  # bytes on both sides of it make no character
                parts.append(b"".join([spoken[x] for x in ids[at:i]]))
                at = i + 1
        parts.append(b"".join([spoken[x] for x in ids[at:]]))
        if self.prefix or self.squeeze:
            first = next((i for i in ids if spoken[i]), None)
            if first is not None and self.texts[first].startswith(SPACE):
                n = next(n for n, p in enumerate(parts) if p)
                parts[n] = parts[n].lstrip(b" ") if self.squeeze else parts[n][1:]
        return "".join([p.decode("utf-8", "kernloom-one-each") for p in parts])


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ids, begins and ends (array<int>, array<long>; the last piece is the end
    id, an empty span after the text)."""
    path = path or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids, begins, ends = m.encode_with_spans(text)
                size = len(text.encode())
                rows.append(([*ids.tolist(), m.end], [*begins.tolist(), size], [*ends.tolist(), size]))
            columns = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "ids", "begins", "ends"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, begins array<long>, ends array<long>")


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per row of (id, ids array<int>): its id and the decoded text; null ids are empty."""
    path = path or default_model()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def op12_sentencepiece(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_crc32: of all begins, then all ends, as
    little-endian 64-bit numbers."""
    path = path or default_model()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        shown = [str(i) for i in range(len(m.texts))]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found, begins, ends = m.encode_with_spans(text)
                ids = [*found.tolist(), m.end]
                digest = hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest()
                back = hashlib.sha256(m.decode(ids).encode()).hexdigest()
                spans = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes()))
                rows.append((len(ids), digest, back, spans))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
