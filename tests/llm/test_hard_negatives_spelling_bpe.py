"""Hard negatives, spelling variants and byte-level BPE against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import byte_bpe, hard_negatives, registry, spelling
from leafmill.llm.common import table, tokenizer_file
from tests.helpers import SMALL

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("key", "cell", "known", "which", "gram", "word", "n", "ids", "offsets", "lang", "_asks")


# ---- hard negatives


def mined(rows, asks, positives=5, negatives=3):
    """rows: (id, label, vector); asks: which are anchors.  By comparing all pairs."""
    null_last = lambda i: (i is None, i or 0)
    rows = [(i, lab, [int(v) for v in vec], a) for (i, lab, vec), a in zip(rows, asks, strict=True) if lab is not None and vec is not None and None not in vec]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for at, (anchor, label, q, asked) in enumerate(rows):
        if not asked:
            continue
        by = sorted(((-dot(q, v), null_last(i), i, lab) for j, (i, lab, v, _) in enumerate(rows) if j != at), key=lambda t: t[:2])
        for p, _, pid, _ in [t for t in by if t[3] == label][:positives]:
            fit = [t for t in by if t[3] != label and 50 * -p <= 100 * -t[0] <= 95 * -p][:negatives]
            out += [(anchor, pid, k + 1, t[2], -p, -t[0]) for k, t in enumerate(fit)]
    return Counter(out)


def mine(spark, rows, asks):
    d = spark.createDataFrame([(*r, a) for r, a in zip(rows, asks, strict=True)], "vec_id long, label long, vector array<long>, asked boolean")
    for name in CLASHING:
        d = d.withColumn(name, F.lit("clash"))
    got = hard_negatives.mine(d, F.col("asked")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, block", [(1, 8192), (2, 40)])
def test_hard_negatives(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    monkeypatch.setattr(hard_negatives, "LEAST", 8)
    rng = random.Random(seed)
    centres = [[rng.randint(-40, 40) for _ in range(6)] for _ in range(8)]
    rows = [(rng.randrange(150), rng.choice([0, 1, 2, None]), [c + rng.randint(-6, 6) for c in rng.choice(centres)]) for _ in range(250)]
    rows += [(1000 + i, i % 2, centres[0]) for i in range(90)]  # copies: ties, and more than a block holds
    rows += [(None, 0, centres[1]), (None, 1, centres[1]), (7, 0, None), (8, 1, [1, None, 2]), (9, 0, []), (10, 1, [30, -20]), (11, 0, [0] * 6)]
    asks = [bool(i is not None and i % 11 == 0) or i is None for i, _, _ in rows]
    assert mine(spark, rows, asks) == mined(rows, asks)


def test_hard_negatives_of_little(spark):
    assert not mine(spark, [], [])
    assert not mine(spark, [(1, 0, [1, 2])], [True])
    rows = [(1, 0, [2**20, 5]), (2, 0, [2**21, 1]), (3, 1, [2**20, 3]), (4, 1, [2**30, 2**30]), (5, 0, [-3, 1])]
    assert mine(spark, rows, [True] * 5) == mined(rows, [True] * 5)
    assert mine(spark, rows, [False] * 5) == mine(spark, rows, [None] * 5) == Counter()


def test_hard_negatives_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(np.float64(v) * 256)) for v in r.embedding]) for r in table(spark, SMALL, "embeddings").collect()]
    got = registry.QUERIES["op11_hard_negatives"](spark, SMALL).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert Counter(map(tuple, got.collect())) == mined(rows, [r[0] % 50 == 0 for r in rows])


def test_ranges_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (600, 5))
    space = hard_negatives.Space(5, float((x * x).sum(1).max()))
    tree = hard_negatives.Tree(space.stored(x), 20)
    assert sorted(np.concatenate(tree.leaves)) == list(range(600))
    low, high = space.score_bounds(tree, x[:40])
    for leaf, own in enumerate(tree.leaves):
        s = space.scores(x[:40], x[own])
        assert (s.min(1) >= low[:, leaf]).all() and (s.max(1) <= high[:, leaf]).all()
    assert (high < space.scores(x[:40], x).max(1)[:, None] * 0.9).any()  # some leaves are ruled out


# ---- spelling variants


def counted(docs, altered=True, shortest=5, least=3):
    total = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            if altered and (h := zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_apart(w, v)] for w in words}
    form = {w: b for w, n in words.items() if near[w] and words[b := min(near[w], key=lambda v: (-words[v], v))] >= 2 * n}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), words.get(form.get(w)), root)
    return out


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("common", [1, 24])
def test_variants(spark, monkeypatch, common):
    monkeypatch.setattr(spelling, "COMMON", common)
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))): rng.choice([3, 4, 7, 20, 50]) for _ in range(700)}
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "b" * 3000: 3, "b" * 3001: 6, "b" * 1500 + "a" + "b" * 1500: 9, "ÀÿÀÿÀ": 4, "x^$yz": 3}
    d = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("gram", F.lit("clash")).withColumn("root", F.lit(1))
    assert result(spelling.variants(d)) == grouped(words)
    assert spelling.variants(d.limit(0)).count() == 0


def test_bounds_hold():
    """However a word is edited, it keeps all but ``bound`` of its grams."""
    rng = random.Random(5)
    common = {"".join(g): 30 for q in (2, 3, 4) for g in (rng.choices("^ab$", k=q) for _ in range(40))}
    for _ in range(300):
        w = "".join(rng.choices("abc", k=rng.randint(5, 9)))
        grams, bound = spelling.decomposed(w, common, 5)
        i = rng.randrange(len(w) + 1)
        for v in (w[:i] + "a" + w[i:], w[:i] + w[i + 1 :], w[:i] + "c" + w[i + 1 :]):
            left = Counter(g for _, g, _ in grams) & Counter(g for _, g, _ in spelling.decomposed(v, common, 5)[0])
            assert left.total() >= len(grams) - bound > 0


def test_word_counts(spark):
    texts = ["Straße STRASSE strasse strasse", None, "", "ab1cdefgh×ijk÷lm", "Ωmega alphaΩbetas", "word-word wordsy wordsy wordsy", "é" * 7000, "ábcdefg" * 3, "hello_hello hello"]
    docs = list(enumerate(texts)) * 2 + [(None, "hello hello hello"), (3, "hello")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    assert {r.word: r.n for r in spelling.count_words(d, spelling.planted).collect()} == counted(docs)
    assert {r.word: r.n for r in spelling.count_words(d).collect()} == counted(docs, altered=False)


def test_variants_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert result(registry.QUERIES["op12_spelling_variants"](spark, SMALL)) == grouped(counted(docs))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def library():
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = byte_bpe.model(tokenizer_file(byte_bpe.FILE)).ranks
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(6)
    out = ["".join(rng.choices(" \n\t 　'strevlmdSTab1²٣é日🙂-._<|\x1c\x85", k=rng.randint(0, 25))) for _ in range(3000)]
    out += ["".join(rng.choices(" '\nslrevmtd-", k=rng.randint(0, 12))) for _ in range(6000)]
    return [*out, "", "x" * 5000, "ab " * 10000, " " * 3000, "'" * 999, "日本" * 2000, "<|endoftext|>", "\x00", "".join(rng.choices("abcdefgh", k=20000))]


def test_ids_equal_the_library(library):
    m, texts = byte_bpe.model(tokenizer_file(byte_bpe.FILE)), odd_texts()
    for text, parts, ids in zip(texts, byte_bpe.pre_tokens(texts), m.encode(texts), strict=True):
        assert "".join(parts) == text
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_scan_equals_the_automaton():
    rng = np.random.default_rng(7)
    symbols = rng.integers(0, 10, 5000)
    state, want = byte_bpe.FRESH, []
    for c in symbols:
        want.append(state)
        state = byte_bpe.TO[state, c]
    assert byte_bpe.states_before(symbols).tolist() == want


def test_memo_is_no_cap(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "CHUNK", 50)
    texts = odd_texts()[:400]
    m = byte_bpe.ByteBPE(tokenizer_file(byte_bpe.FILE))
    assert [np.frombuffer(i, "<u4").tolist() for i in m.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode(spark, library):
    texts = [None, "", "naïve café 🙂 ok", "a" * 900, "same", "same"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in CLASHING:
        d = d.withColumn(name, F.lit("clash"))
    encoded = byte_bpe.encode(d).cache()
    got = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(t or "")
        assert [(t or "").encode()[a:b] for a, b in zip(got[i].offsets, [*got[i].offsets[1:], None], strict=False)] == [library.decode_single_token_bytes(x) for x in got[i].ids]
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for a, b in ((3, 9), (0, 1), (5, None), (100, 200)):
        assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded, a, b).collect()} == {i: (t or "").encode()[a:b] for i, t in enumerate(texts)}
    assert byte_bpe.encode(d.limit(0)).count() == byte_bpe.digests(d.limit(0)).count() == 0


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}
    for r in registry.QUERIES["op13_byte_bpe"](spark, SMALL).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
