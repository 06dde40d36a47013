"""Byte-level BPE encoding and decoding for rank files.

Pre-tokens are found without a regular expression.  Every character gets a class from an array over all code points, and
a symbol that also knows what follows (the last white space before other text, an apostrophe before a contraction).  A
small automaton over these symbols says where pre-tokens begin.  Its transitions compose, and their compositions are
finitely many, so a text is cut into stretches whose transition functions are composed side by side and then joined: an
associative scan over table look-ups, over many texts at once.

The slices go through a cached pair merging; each distinct one is merged once per worker while the cache has room.
Encoding keeps the byte offset of each token, so that decoding can begin and end anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, table, tokenizer_file

FILE = "byte_bpe_multi_50k.tiktoken"
#: Characters scanned at once, and the length of the stretches of the scan.
CHUNK, STRETCH = 400_000, 128
#: Bytes of words that the cache holds (with about 150 for each entry).
MEMO_BYTES = 60_000_000
#: Words of up to SHORT_WORD bytes are merged side by side, ROWS at once; those of over LONG bytes are merged with a heap and not cached.
SHORT_WORD, ROWS, LONG = 40, 4000, 200

NEVER = 2**31 - 1

# symbols: what a character is, with what follows it
END, LETTER, NUMBER, OTHER, SPACE, LAST_SPACE, BLANK, LAST_BLANK, SHORT, LONGER = range(10)
# states: what the characters so far mean for the next one
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINED, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins), both by state and symbol."""
    to, begins = np.zeros((8, 10), np.uint8), np.ones((8, 10), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        to[:, symbol] = run
        begins[[run, JOINED], symbol] = False
    for symbol, rest in ((SHORT, ONE_MORE), (LONGER, TWO_MORE)):  # a contraction, unless the apostrophe goes on a run
        to[:, symbol] = rest
        to[[IN_OTHER, JOINED], symbol] = IN_OTHER
        begins[[IN_OTHER, JOINED], symbol] = False
    to[ONE_MORE, LETTER], to[TWO_MORE, LETTER] = FRESH, ONE_MORE
    begins[[ONE_MORE, TWO_MORE], LETTER] = False
    for symbol in (SPACE, BLANK):
        to[:, symbol] = IN_BLANKS
        begins[IN_BLANKS, symbol] = False
    to[:, LAST_SPACE], to[:, LAST_BLANK], to[:, END] = JOINED, FRESH, FRESH
    return to, begins


def monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the transition functions: (of each symbol, product table, the functions themselves);
    number 0 changes nothing."""
    known = {tuple(range(len(to))): 0}
    maps = list(known)
    todo = [tuple(int(s) for s in to[:, c]) for c in range(to.shape[1])]
    while todo:
        f = todo.pop()
        if f not in known:
            known[f] = len(maps)
            maps.append(f)
            todo += [tuple(g[s] for s in f) for g in maps] + [tuple(f[s] for s in g) for g in maps]
    product = np.array([[known[tuple(g[s] for s in f)] for g in maps] for f in maps], np.int16)
    return np.array([known[tuple(int(s) for s in to[:, c])] for c in range(to.shape[1])], np.int16), product, np.array(maps, np.uint8)


TO, BEGINS = automaton()
ELEMENT, PRODUCT, MAPS = monoid(TO)


def states_before(symbols: np.ndarray, start: int = FRESH) -> np.ndarray:
    """The state before each symbol, by an associative scan: stretches side by side, then their products."""
    n = len(symbols)
    if n <= 4 * STRETCH:
        out, s, to = [], start, TO.tolist()
        for c in symbols.tolist():
            out.append(s)
            s = to[s][c]
        return np.array(out, np.uint8)
    width = -(-n // STRETCH)
    padded = np.zeros(width * STRETCH, np.int16)
    padded[:n] = ELEMENT[symbols]
    steps = np.ascontiguousarray(padded.reshape(width, STRETCH).T)
    before = np.zeros((STRETCH, width), np.int16)
    flat, size = PRODUCT.ravel(), len(PRODUCT)
    total = steps[0]
    for j in range(1, STRETCH):
        before[j] = total
        total = flat[total.astype(np.int32) * size + steps[j]]
    first = np.zeros(width, np.uint8)  # of each stretch, by the scan of the totals
    s = start
    rows = MAPS.tolist()
    for i, f in enumerate(total.tolist()):
        first[i] = s
        s = rows[f][s]
    return MAPS.ravel()[before.astype(np.int32) * MAPS.shape[1] + first].T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other for each code point, as the library that defines the encoding sees them."""
    import tiktoken

    table_ = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        own = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
        table_[np.frombuffer(bytes(own).decode().encode("utf-32-le"), np.uint32)] = symbol
    table_[32] = SPACE
    return table_


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; those at ``ends`` only part texts."""
    s = classes()[points]
    s[ends] = END
    blank = (s == SPACE) | (s == BLANK)
    solid_next = np.r_[(~blank & (s != END))[1:], False]
    s[blank & solid_next] += 1
    quotes = np.flatnonzero((points == 39) & (s == OTHER))
    if len(quotes):
        after = np.r_[np.where(s == END, 0, points), 0, 0].astype(np.uint32)
        one, two = after[quotes + 1], after[quotes + 2]
        s[quotes[np.isin(one, np.array([*map(ord, "stmd")], np.uint32))]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        s[quotes[pair]] = LONGER
    return s


def pre_tokens(texts: list[str]) -> list[list[str]]:
    """The slices of each text, in order; together they are the text."""
    joined = "\n".join([*texts, ""])
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols = symbols_of(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends)
    at = np.flatnonzero(BEGINS.ravel()[states_before(symbols).astype(np.int16) * 10 + symbols])  # the ends begin slices too
    cuts = at.tolist()
    parts = list(map(joined.__getitem__, map(slice, cuts, cuts[1:])))
    stop = np.searchsorted(at, ends).tolist()
    return [parts[a:b] for a, b in zip([0, *(x + 1 for x in stop)], stop, strict=False)]


class ByteBPE:
    def __init__(self, file: str):
        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.sizes = np.zeros(max(self.bytes_of, default=-1) + 1, np.int32)
        for b, rank in self.ranks.items():
            self.sizes[rank] = len(b)
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("the file doesn't hold all bytes")
        self.byte_ranks = [self.ranks[bytes([i])] for i in range(256)]
        #: rank of two tokens side by side, for each way to part a token in two
        self.pair_ranks = {self.ranks[b[:i]] << 32 | self.ranks[b[i:]]: rank for b, rank in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks}
        self._hashed()
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _hashed(self) -> None:
        """``pair_ranks`` as an array of slots, for look-ups of many pairs at once."""
        keys, ranks = np.array(list(self.pair_ranks), np.uint64), np.array(list(self.pair_ranks.values()), np.int32)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slot_keys, self.slot_ranks = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, NEVER, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slot_keys[slot[todo]] == np.uint64(2**64 - 1)
            self.slot_keys[slot[todo[free]]], self.slot_ranks[slot[todo[free]]] = keys[todo[free]], ranks[todo[free]]
            todo = todo[self.slot_keys[slot[todo]] != keys[todo]]  # of several for one slot the last has it
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NEVER where they don't merge."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out, todo, slot = np.full(len(keys), NEVER, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self.slot_keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.slot_ranks[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _merged_rows(self, words: list[bytes]) -> list[bytes]:
        """The merges of many short words at once: in each round every word that has a pair left merges its lowest."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(n.max())
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        ids, inside = np.array(self.byte_ranks, np.int32)[text], np.arange(wide) < n[:, None]
        pairs = np.full(ids.shape, NEVER, np.int32)
        row, col = np.nonzero(inside[:, 1:])
        pairs[row, col] = self._ranks_of(ids[row, col], ids[row, col + 1])
        after, before = np.tile(np.arange(1, wide + 1), (len(words), 1)), np.tile(np.arange(-1, wide - 1), (len(words), 1))
        r = np.arange(len(words))
        while True:
            i = pairs[r].argmin(1)
            low = pairs[r, i]
            go = low < NEVER
            r, i, low = r[go], i[go], low[go]
            if not len(r):
                break
            j = after[r, i]
            k = after[r, j]
            ids[r, i], inside[r, j], pairs[r, j], pairs[r, i], after[r, i] = low, False, NEVER, NEVER, k
            on = k < n[r]
            before[r[on], k[on]] = i[on]
            pairs[r[on], i[on]] = self._ranks_of(low[on], ids[r[on], k[on]])
            p = before[r, i]
            on = p >= 0
            pairs[r[on], p[on]] = self._ranks_of(ids[r[on], p[on]], low[on])
        flat, ends = ids[inside].astype("<u4").tobytes(), (4 * inside.sum(1).cumsum()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merged(self, word: bytes) -> list[int]:
        """Ranks of a word: the pair of the lowest rank merges first, of equals the leftmost."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        if len(word) > LONG:
            return self._merged_long(word)
        parts = list(map(self.byte_ranks.__getitem__, word))
        get = self.pair_ranks.get
        pairs = [get(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < NEVER:
            i = pairs.index(low)
            parts[i] = low
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] << 32 | low, NEVER)
            if i < len(pairs):
                pairs[i] = get(low << 32 | parts[i + 1], NEVER)
        return parts

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words of any length."""
        ranks, n = self.ranks, len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n))  # where the part from i ends; where the one before begins
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = stop[i]
            if mid < 0 or mid >= n or stop[mid] != end:
                continue  # one of the two parts has been merged meanwhile
            stop[i], stop[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : stop[i]]])
            i = stop[i]
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Puts words into the cache; gives back those that are too long for it."""
        big, short = {}, []
        for w in words:
            b = w.encode("utf-8", "replace")
            if (rank := self.ranks.get(b)) is not None:
                self.memo[w] = rank.to_bytes(4, "little")
            elif len(b) <= SHORT_WORD:
                short.append((len(b), b, w))
            elif len(b) <= LONG:
                self.memo[w] = np.array(self.merged(b), "<u4").tobytes()
            else:
                big[w] = np.array(self.merged(b), "<u4").tobytes()
            self.held += min(len(b), LONG) + 190
        short.sort()
        for i in range(0, len(short), ROWS):
            part = short[i : i + ROWS]
            self.memo.update(zip([w for _, _, w in part], self._merged_rows([b for _, b, _ in part]), strict=True))
        return big

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= CHUNK):
                chars += len(texts[j])
                j += 1
            split = pre_tokens(texts[i:j])
            if self.held > MEMO_BYTES:  # costs time, not results
                self.memo, self.held = {}, 0
            big = self._learn({p for parts in split for p in parts if p not in self.memo})
            for parts in split:
                found = list(map(self.memo.get, parts))
                if big and None in found:
                    found = [self.memo.get(p) or big[p] for p in parts]
                out.append(b"".join(found))
            i = j
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def model(file: str) -> ByteBPE:
    return ByteBPE(file)


def encode(docs: DataFrame, file: str = FILE, folder: str | None = None) -> DataFrame:
    """doc_id, ``ids`` and ``offsets`` (arrays of int) per row: an offset is the byte of the UTF-8 text at which a token
    begins.  Null and empty texts have none.  Other columns are left out; equal rows are encoded each."""
    path = tokenizer_file(file, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.iloc[i : i + 200]
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in m.encode(part["text"].tolist())]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": ids, "offsets": [np.r_[0, np.cumsum(m.sizes[x])[:-1]][: len(x)].astype(np.int32) for x in ids]})

    d = columns_of(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, begin: int = 0, end: int | None = None, file: str = FILE, folder: str | None = None) -> DataFrame:
    """doc_id and ``bytes`` (binary) from doc_id, ids and offsets: the bytes from ``begin`` up to ``end`` (left out: all);
    only the tokens that meet that range are looked at.  Null ids give null; an id outside the file is an error."""
    path = tokenizer_file(file, folder)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = model(path)
        for ids, offsets in batches:
            out: list[bytes | None] = []
            for x, at in zip(ids, offsets, strict=True):
                if x is None or not len(x):
                    out.append(None if x is None else b"")
                    continue
                if not begin and end is None:
                    out.append(m.decode(x.tolist()))
                    continue
                a = max(0, int(np.searchsorted(at, begin, "right")) - 1)
                z = len(x) if end is None else int(np.searchsorted(at, end, "left"))
                part, base = m.decode(x[a:z].tolist()), int(at[a])
                out.append(part[max(0, begin - base) : None if end is None else max(0, end - base)])
            yield pd.Series(out, dtype=object)

    return columns_of(encoded, doc_id="doc_id", ids="ids", offsets="offsets").select("doc_id", F.pandas_udf(run, "binary")("ids", "offsets").alias("bytes"))


def digests(docs: DataFrame, file: str = FILE, folder: str | None = None) -> DataFrame:
    """Encodes and decodes each text inside one task: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes), round_trip (they are the text's).  Null texts count as empty."""
    path = tokenizer_file(file, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            rows = []
            for i in range(0, len(b), 200):
                texts = b["text"].iloc[i : i + 200].tolist()
                for text, ids in zip(texts, m.encode(texts), strict=True):
                    back = m.decode(np.frombuffer(ids, "<u4").tolist())
                    rows.append((len(ids) // 4, sha(ids), sha(back), back == text.encode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), out], axis=1)

    d = columns_of(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op13_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
