"""Spelling variant grouping over a variable-length gram index.

Words that differ by one inserted, deleted or replaced code point are near.  To find them without comparing all pairs:

- A gram dictionary is counted over the words (framed by ``^`` and ``$``) and pruned by frequency: grams of up to ``longest``
  code points that occur more than a threshold of times.  The threshold grows with the words so that the dictionary has
  DICTIONARY entries at most; only that is broadcast.
- A word is decomposed into one gram per place: the shortest of at least two code points that the dictionary doesn't
  hold, so common beginnings go on until they are rare.  A gram depends on its own characters alone.
- An edit can only affect the grams over its place, so a word's bound is the largest number of grams over one place.
  A near word shares all but that many.  Lists are therefore merged on the ``bound + 1`` rarest grams of each word; the
  longest lists are never read.
- Shared grams keep their place before the edit and move with it behind, so a list is keyed by gram, place and word length, and a
  word looks into three: equal length, and one more with the place kept or moved.  Candidates are verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, stage, table

#: Entries of the gram dictionary at most, the least count of a gram that is in it, and words counted together in a task.
DICTIONARY, COMMON, PART = 120_000, 24, 150_000
#: Words that are decomposed in one task, about.
WORDS = 10_000
#: Letters as bytes: A to Z lower-cased, everything but letters a space.  No letter lies beyond U+00FF.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def planted(doc_id: object, run: bytes) -> bytes:
    """The run with a code point deleted where 97 divides the checksum of ``<doc_id>:<run>``."""
    h = zlib.crc32(run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    return run[: (at := h % len(run))] + run[at + 1 :] if h % 97 == 0 else run


def count_words(docs: DataFrame, altered: Callable[[object, bytes], bytes] | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, A to Z lower-cased, of at least ``shortest``
    code points and ``least`` occurrences.  ``altered`` (doc_id, run as Latin-1) may change a run, the same way wherever it
    stands in the text.  Null texts have none; for ``altered`` a null id is the empty string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        frame = lambda c: pd.DataFrame({"word": [w.decode("latin-1") for w in c], "n": list(c.values())})
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                for w, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(w) >= shortest and (not altered or len(w := altered(doc_id, w)) >= shortest):
                        total[w] += n
                if len(total) > PART:
                    yield frame(total)
                    total.clear()
        if total:
            yield frame(total)

    d = columns_of(docs, doc_id="doc_id", text="text").where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return d.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame, longest: int) -> dict[str, int]:
    """Counts of the grams of 2 to ``longest`` code points that are common; DICTIONARY at most, whatever the words."""
    framed = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    places = framed.agg(F.sum(F.length("w"))).first()[0] or 0
    # every length has at most places / common grams above the threshold
    common = max(COMMON, -(-places * (longest - 1) // DICTIONARY))
    grams = F.expr(f"flatten(transform(sequence(2, {longest}), q -> transform(sequence(1, greatest(length(w) - q + 1, 1)), i -> substring(w, i, q))))")
    return {r.gram: r["count"] for r in framed.select(F.explode(grams).alias("gram")).groupBy("gram").count().where(F.col("count") > common).collect()}


def decomposed(word: str, common: dict[str, int], longest: int) -> tuple[list[tuple[int, str, int]], int]:
    """(count, gram, place) of each gram, rarest first, and how many grams one edit can affect at most."""
    w = f"^{word}$"
    n, out, over = len(w), [], [0] * (len(w) + 1)
    for i in range(n - 1):
        j = i + 2
        while j < n and j - i < longest and w[i:j] in common:
            j += 1
        out.append((common.get(w[i:j], 0), w[i:j], i))
        over[i] += 1
        over[j] -= 1
    most = here = over[0]
    for i in range(1, n - 1):
        here += over[i]
        most = max(most, here) if i > 1 else here
    return sorted(out), most


def near_words(words: DataFrame, longest: int = 5) -> DataFrame:
    """word, n, other, other_n: each pair of words (distinct, of at least ``longest`` code points) one edit apart, both ways."""
    common = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, longest))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for word, n in zip(b["word"], b["n"], strict=True):
                grams, bound = decomposed(word, common.value, longest)
                letters = 0  # a bit for each letter that occurs; an edit changes two at most
                for c in word:
                    letters |= 1 << (ord(c) & 31)
                rows += [(gram, at, len(word), word, n, letters) for _, gram, at in grams[: bound + 1]]
            yield pd.DataFrame(rows, columns=["gram", "at", "length", "word", "n", "letters"])

    # small rows, much work: more parts than their bytes call for
    lists = stage(words.repartition(max(1, words.count() // WORDS), "word").mapInPandas(post, "gram string, at int, length int, word string, n long, letters long"), "grams")
    # a gram at a place is shared with words as long (at the same place) and one longer (there or one further)
    looks = F.array(*[F.struct((F.col("at") + a).alias("at"), (F.col("length") + b).alias("length")) for a, b in ((0, 0), (0, 1), (1, 1))])
    ask = lists.select("gram", F.explode(looks).alias("k"), F.col("length").alias("own"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters")).select("gram", "k.*", "own", "a", "a_n", "a_letters")
    there = lists.select("gram", "at", "length", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters"))
    close = (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2) & (F.levenshtein("a", "b", 1) == 1) & ((F.col("own") < F.col("length")) | (F.col("a") < F.col("b")))
    pairs = ask.join(there, ["gram", "at", "length"]).where(close).select("a", "a_n", "b", "b_n").distinct()
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return pairs.select(F.explode(sides).alias("x")).select("x.*")


def variants(words: DataFrame, times: int = 2, longest: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root from distinct words with counts (word, n), all of at least ``longest`` code points.

    ``form``: the near word of largest n (of equals the first in code-point order), if its n is at least ``times`` (over 1)
    the word's own; null otherwise.  ``root``: where following forms ends, the word itself without one.  No words: no rows."""
    words = stage(columns_of(words, word="word", n="n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    found = near_words(words, longest).groupBy("word").agg(F.count("*").alias("n_near"), best)
    formed = F.col("best").isNotNull() & (-F.col("best.less") >= times * F.col("n"))
    form = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    form = stage(form, "forms")
    # a form is at least ``times`` as common, so paths are short, and each round doubles the steps taken
    up = form.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stage(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = up.where("moved").limit(1).count()
        up = up.select("word", "root")
        if not moved:
            break
    return form.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir):
    return variants(count_words(table(spark, sf_dir, "documents"), planted))
