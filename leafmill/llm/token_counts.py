"""Token counts for a SentencePiece BPE vocabulary, with a shortcut for words that are one token.

No piece of such a vocabulary holds the space marker after another character, so no merge crosses the place
before a marker: a text's tokens are the tokens of its pre-tokens (markers, then other characters) one after
the other.  That is checked offline for the given file, as is which pieces, taken as a whole text, come back as
one token.  Pre-tokens among those count 1; only the others go through the merges, each distinct one once
per worker as long as the memo has room.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, table, tokenizer_file

MARKER = "▁"
#: Distinct pre-tokens kept per worker; beyond it the memo starts afresh, which costs time, not results.
MEMO = 500_000
_PRE = re.compile(" +[^ ]*")


class PieceCounter:
    """Counts as the library does, without begin, end or added special tokens."""

    def __init__(self, file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        if any(MARKER in p.lstrip(MARKER) for p in plain) or self.sp.encode("a b") != self.sp.encode("a") + self.sp.encode("b"):
            raise ValueError("pieces cross words: the shortcut doesn't hold for this vocabulary")
        marked = [p for p in plain if p[0] == MARKER and len(p) > 1]
        alone = self.sp.encode([p[1:].replace(MARKER, " ") for p in marked], num_threads=1)
        #: proven: alone they are one token
        self.single = {p.replace(MARKER, " "): 1 for p, ids in zip(marked, alone, strict=True) if len(ids) == 1} | {" ": len(self.sp.encode("a ")) - len(self.sp.encode("a"))}
        self.memo: dict[str, int] = dict(self.single)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARKER, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = _PRE.findall(" " + text)
        else:
            parts = (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else _PRE.findall(" " + text)
        memo = self.memo
        found = list(map(memo.get, parts))
        if None in found:
            new = list({p for p, n in zip(parts, found, strict=True) if n is None})
            if len(memo) + len(new) > MEMO:
                self.memo = memo = dict(self.single)
                new = list({p for p in parts if p not in memo})
            for p, ids in zip(new, self.sp.encode([p[1:] for p in new], num_threads=1), strict=True):
                memo[p] = len(ids)
            found = map(memo.__getitem__, parts)
        return sum(found)


@lru_cache(maxsize=2)
def counter(file: str) -> PieceCounter:
    return PieceCounter(file)


def token_counts(docs: DataFrame, file: str = "piece_bpe_32k.model", limit: int = 4096, folder: str | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.  Null texts count as empty, 0 tokens.
    Only doc_id and text are read; equal ids and texts are counted each."""
    path = tokenizer_file(file, folder)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    d = columns_of(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.pandas_udf(counted, "long")("text").alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
