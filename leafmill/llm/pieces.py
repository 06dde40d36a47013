"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The file gives pieces with scores, which are taken as log scores.  Encoding finds, for each pre-token, the
split with the largest sum; no piece crosses the place before a space marker, so pre-tokens are independent and
each distinct one is split once per worker.  Characters that no piece covers become byte pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, table, tokenizer_file

MARKER = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: An uncovered character costs this much more than the rarest piece.
UNKNOWN_PENALTY = 10.0
#: Distinct pre-tokens kept per worker, characters split at once, words in one matrix, and the length in bytes beyond
#: which words go one by one.  They bound what a worker holds, besides the rows of one slice.
MEMO, CHUNK, WORDS, LONG = 120_000, 300_000, 4000, 96
#: Rows encoded and handed on at once.
SLICE = 100
_PRE = re.compile("\n| *[^ \n]+| +")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message: numbers and raw values."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return n, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_pieces(file: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in the order of their ids."""
    out = []
    with open(file, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie of byte strings as two arrays: from state s, byte b leads to t = base[s] + b + 1 if check[t] = s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for b in key:
                node = children[node].setdefault(b, len(children))
                if node == len(children):
                    children.append({})
            ends[node] = value
        # nodes with many children first; each class of sizes goes on looking where it last found room
        used, look, bases = bytearray(4 * len(children) + 4096), {}, [0] * len(children)
        for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
            if kids := sorted(children[node]):
                at = used.find(0, max(look.get(len(kids), 1), kids[0] + 1))
                while any(used[at - kids[0] + k] for k in kids):
                    at = used.find(0, at + 1)
                look[len(kids)] = max(at - 512, 0)
                bases[node] = base = at - kids[0] - 1
                for k in kids:
                    used[base + k + 1] = 1
        self.base, self.check, self.value = np.zeros(len(used), np.int64), np.full(len(used), -1, np.int64), np.full(len(used), -1, np.int64)
        todo = [(0, 0)]
        while todo:
            node, s = todo.pop()
            self.base[s], self.value[s] = bases[node], ends.get(node, -1)
            for k, child in children[node].items():
                self.check[t := bases[node] + k + 1] = s
                todo.append((child, t))


class Unigram:
    def __init__(self, file: str):
        pieces = read_pieces(file)
        self.bytes_of = [p.replace(MARKER, " ").encode() for p, _, _ in pieces]
        self.byte_ids = [0] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif kind != NORMAL:
                self.bytes_of[i] = b""
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        normal = {p.replace(MARKER, " ").encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(b" " in k.lstrip(b" ") or b"\n" in k for k in normal):
            raise ValueError("pieces cross words or lines")
        self.scores = np.array([s for _, s, _ in pieces])
        self.unknown = min(self.scores[i] for i in normal.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(normal)
        self.lists = None
        self.memo: dict[str, bytes] = {}

    def _ids(self, word: bytes, back: list[int], piece: list[int]) -> bytes:
        out: list[int] = []
        end = len(word)
        while end:
            start = back[end]
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out += [self.byte_ids[b] for b in reversed(word[start:end])]
            end = start
        return np.array(out[::-1], "<i4").tobytes()

    def _split_long(self, word: bytes) -> bytes:
        """Viterbi over one word."""
        if self.lists is None:
            self.lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, value, scores = self.lists
        n, never = len(word), float("-inf")
        best, back, piece = [0.0] + [never] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            if (here := best[i]) == never:
                continue
            b = word[i]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            s, alone = 0, False
            for j in range(i, n):
                t = base[s] + word[j] + 1
                if check[t] != s:
                    break
                s = t
                if (v := value[s]) >= 0:
                    alone |= j + 1 - i == width
                    if (total := here + scores[v]) > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = total, i, v
            if not alone and (total := here + self.unknown) > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = total, i, -1
        return self._ids(word, back, piece)

    def _split_many(self, encoded: list[bytes]) -> list[bytes]:
        """The same over many short words at once, a column of bytes at a time."""
        n, wide = len(encoded), max(map(len, encoded))
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in encoded), np.uint8).reshape(n, wide).astype(np.int64) + 1
        length = np.fromiter(map(len, encoded), np.int64, n)
        text[np.arange(wide) >= length[:, None]] = 0  # no piece goes on beyond the end
        best = np.full((n, wide + 5), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, wide + 5), np.int32), np.full((n, wide + 5), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(wide):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (i < length))
            if not len(rows):
                continue
            here, first = best[rows, i], text[rows, i] - 1
            width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            alone = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, wide):
                c = text[rows[live], j]
                t = base[state] + c
                ok = (c > 0) & (check[t] == state)
                live, state = live[ok], t[ok]
                if not len(live):
                    break
                hit = (v := value[state]) >= 0
                at, v = live[hit], v[hit]
                alone[at] |= width[at] == j + 1 - i
                total, r = here[at] + self.scores[v], rows[at]
                up = total > best[r, j + 1]
                best[r[up], j + 1], back[r[up], j + 1], piece[r[up], j + 1] = total[up], i, v[up]
            at = np.flatnonzero(~alone)
            r, to, total = rows[at], i + width[at], here[at] + self.unknown
            up = total > best[r, to]
            best[r[up], to[up]], back[r[up], to[up]], piece[r[up], to[up]] = total[up], i, -1
        return [self._ids(w, b, p) for w, b, p in zip(encoded, back.tolist(), piece.tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        """Puts the splits of words into the memo."""
        if len(self.memo) + len(words) > MEMO:
            self.memo = {}
        by_length = sorted((w.encode("utf-8", "replace"), w) for w in words)
        by_length.sort(key=lambda x: len(x[0]))
        i = 0
        while i < len(by_length) and len(by_length[i][0]) <= LONG:
            j = min(len(by_length), i + WORDS)
            while len(by_length[j - 1][0]) > min(LONG, len(by_length[i][0]) + 8):
                j -= max(1, (j - i) // 8) if j - i > 1 else 0
                if j - i <= 1:
                    break
            j = max(j, i + 1)
            for (_, w), ids in zip(by_length[i:j], self._split_many([b for b, _ in by_length[i:j]]), strict=True):
                self.memo[w] = ids
            i = j
        for b, w in by_length[i:]:
            self.memo[w] = self._split_long(b)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as int32; a text is read with a space before it, an empty one has none."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            split, chars = [], 0
            while i < len(texts) and chars < CHUNK:
                split.append(_PRE.findall(" " + texts[i].replace(MARKER, " ")) if texts[i] else [])
                chars += len(texts[i])
                i += 1
            seen = set().union(*split)
            if new := [w for w in seen if w not in self.memo]:
                if len(self.memo) + len(new) > MEMO:
                    self.memo, new = {}, list(seen)
                self.learn(new)
            found = self.memo.__getitem__
            out += [np.frombuffer(b"".join(map(found, s)), "<i4") for s in split]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text: bytes of byte pieces joined, markers to spaces, the first of them taken away."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def model(file: str) -> Unigram:
    return Unigram(file)


def encode(docs: DataFrame, file: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array of int) per row; null and empty texts have none.  Other columns are left out;
    equal rows are encoded each.  Literal markers in a text count as spaces."""
    path = tokenizer_file(file, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), SLICE):
                part = b.iloc[i : i + SLICE]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": m.encode(part["text"].tolist())})

    d = columns_of(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, file: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """doc_id and ``text`` from doc_id and ``ids``; null ids give a null text, ids outside the file an error."""
    path = tokenizer_file(file, folder)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for ids in batches:
            yield pd.Series([None if i is None else m.decode(i) for i in ids], dtype=object)

    return columns_of(encoded, doc_id="doc_id", ids="ids").select("doc_id", F.pandas_udf(texts, "string")("ids").alias("text"))


def digests(docs: DataFrame, file: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """Encodes, decodes and compares each text inside one task: doc_id, n_pieces, n_byte_pieces, ids_crc32
    (of the ids as little-endian 32-bit integers), decoded_crc32, round_trip (equal to the text, in which
    literal markers count as spaces)."""
    path = tokenizer_file(file, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            rows = []
            for i in range(0, len(b), SLICE):
                texts = b["text"].iloc[i : i + SLICE].tolist()
                for text, ids in zip(texts, m.encode(texts), strict=True):
                    back = m.decode(ids.tolist())
                    rows.append((len(ids), int(m.is_byte[ids].sum()), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode()), back == text.replace(MARKER, " ")))
            out = pd.DataFrame(rows, columns=["n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip"])
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), out], axis=1)

    d = columns_of(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInPandas(run, f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op8_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
