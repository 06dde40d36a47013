"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per failed rule;
policies are versioned sets of rules, applied later with one bitwise AND, and ablations are counts over the
distinct bit patterns, never a second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a Boolean SQL expression over the measurements; null counts as passed."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        known = {r.name: r.bit for r in rules}
        return reduce(lambda m, n: m | 1 << known[n], self.rules, 0)


#: Integer arithmetic only, so that every engine decides alike.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_share", "100 * n_symbols > 2 * word_chars"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "no_text", "n_words = 0"),
)
BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
STRICT = Policy("web-1", tuple(r.name for r in RULES if r.name != "no_text"))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and the measurements, all long.

    Null and empty texts measure 0 throughout.  Repeated rows are measured each.  Columns besides the two
    named ones are left out, so none can clash."""
    d = columns_of(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select(
        "doc_id",
        words(F.col("text")).alias("_words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    window = lambda i: F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    d = d.select(
        "doc_id",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(window(i).alias("w"), i.alias("p"))))).alias("_windows"),
    )
    # sorted by window, a window found twice has an equal neighbour; what is kept is the place where it starts
    starts = F.filter(
        F.transform(
            "_windows",
            lambda x, i: F.when((x.w == F.get("_windows", i - 1).w) | (x.w == F.get("_windows", i + 1).w), x.p),
        ),
        lambda p: p.isNotNull(),
    )
    d = d.withColumn("_starts", F.sort_array(F.coalesce(starts, F.array().cast("array<int>"))))
    # each start covers three words, less what the next start covers too
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1), p + 3) - p)),
        F.lit(0),
        lambda a, x: a + x,
    )
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``fail_bits`` (long): bit ``r.bit`` is set where rule ``r`` fails."""
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    bits = [F.when(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return measure(docs, doc_id, text).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def failed(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row is rejected under the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return book.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~failed(policy, rules))


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per rule of the policy: documents that fail it, that fail it alone, and that would be kept
    without it.  The ledger is first summed by bit pattern, of which there are at most 2 to the rules."""
    mask = policy.mask(rules)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    mine = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1])
    each = patterns.select("bits", "n", F.explode(mine).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | alone, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def op1_quality_rules(spark, sf_dir):
    from leafmill.llm.common import table

    book = apply_policy(ledger(table(spark, sf_dir, "documents")), STRICT)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(BASE).alias("base_failed"), "kept", "fail_bits", "policy")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, rn, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3
  FROM (SELECT doc_id, rn, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
        FROM (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))
  WINDOW p AS (PARTITION BY rn ORDER BY i)),
g AS (SELECT rn, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rn, w, w2, w3) > 1 AS again, length(w) AS len FROM w),
c AS (SELECT rn, len, again OR coalesce(lag(again) OVER p, false) OR coalesce(lag(again, 2) OVER p, false) AS hit FROM g WINDOW p AS (PARTITION BY rn ORDER BY i)),
m AS (SELECT rn, count(*) AS n_words, sum(len) AS word_chars, count(*) FILTER (WHERE hit) AS n_repeat_words FROM c GROUP BY rn),
l AS (
  SELECT doc_id, rn, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM (SELECT doc_id, rn, t, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
        FROM (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS t FROM documents))),
r AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN m USING (rn)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 2 * word_chars THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words = 0 THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  fail_bits & 63 = 0 AS kept, fail_bits, 'web-1' AS policy
FROM f
"""
