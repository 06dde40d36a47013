"""Secret scans: candidates by patterns, false positives removed by a random forest.

All of it is DataFrame expressions and the JVM's own forest.  Candidates are cut out of whole texts by
regular expressions; features are counted with SQL functions, the dictionary from the corpus; the forest is trained on
labelled findings and then written out as one column expression, so scoring and redaction happen inside the row, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, shared_dir, stage, table


@dataclass(frozen=True)
class Kind:
    """Group 1 of ``pattern`` is the candidate; ``marked``: the pattern itself names a secret."""

    name: str
    pattern: str
    marked: bool


KINDS = (
    # the whole block; one without an end, as far as its lines look like a key's.  First, as it may be an assigned value
    Kind("private_key", r"(-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[^\-]*+(?:-(?!----)[^\-]*+)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n]*+)*+(?:(?:\s|\\[nr])*+(?:[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/=]++\z))*+))", True),
    Kind("access_key", r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])", True),
    # up to the closing quote, or else up to a space or delimiter, without the stop of a sentence
    # the password of an address: up to the last @ of its host part
    Kind("url", r"(?<=://)[^\s:/@\"'<>]{0,64}:([^\s/\"'<>]{3,})(?=@[A-Za-z0-9\[])", True),
    Kind("assigned", r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|credentials?)[\"']?\s{0,3}[=:]\s{0,3}[\"']?((?<=\")(?:[^\"\\\r\n]|\\.){8,}+(?=\")|(?<=')(?:[^'\\\r\n]|\\.){8,}+(?=')|[\x21-\x7E&&[^\"'`<>,;(){}\[\]|&\\]]{8,}(?<![.:?]))", True),
    Kind("prefixed", r"(?<![A-Za-z0-9])((?:ghp_|gho_|xoxb-|xoxp-|sk-|AIza|glpat-)[A-Za-z0-9_\-]{16,}+)", True),
    Kind("opaque", r"(?<![A-Za-z0-9+/_\-])((?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+)", False),
)
#: The most frequent words of the corpus that make up the dictionary; words have that many letters at least.
DICTIONARY_WORDS, WORD_LETTERS = 1000, 4
#: Documents whose words surround the planted findings, findings that train the forest, at most; code points that are
#: looked at on either side.
PLANT_DOCS, TRAIN_ROWS, AROUND = 1000, 20_000, 40
FEATURES = ("length", "digits", "uppers", "lowers", "transitions", "dictionary", "path_like", "in_path", "key_before", "assigned_before", "quoted", "word_before", "word_after")


def _span(k: int, kind: Kind) -> Column:
    """Array of the places of one kind, from the columns that ``located`` adds for it."""
    got, whole, between = F.col(f"_g{k}"), F.col(f"_w{k}"), F.col(f"_b{k}")
    total = lambda a, n: F.aggregate(F.transform(F.slice(a, F.lit(1), n), lambda x: F.length(x)), F.lit(0), lambda s, x: s + x)

    def place(g: Column, i: Column) -> Column:
        inside = F.instr(F.get(whole, i), g) - 1
        inside = F.length(F.get(whole, i)) - F.length(g) if kind.name in ("assigned", "url") else inside
        return F.struct(
            (total(between, i + 1) + total(whole, i) + inside).alias("start"),
            F.lit(k).alias("rank"),
            g.alias("candidate"),
            F.concat(F.right(F.get(between, i), F.lit(AROUND)), F.substring(F.get(whole, i), F.lit(1), inside)).alias("before"),
            F.left(F.get(between, i + 1), F.lit(AROUND)).alias("after"),
        )

    return F.when(got.isNotNull(), F.transform(got, place))


def located(d: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``found``: array of (start, rank, candidate, before, after) of the text, in order, none inside another
    (the earlier one stays, at one place the earlier kind); empty where there is none."""
    for k, kind in enumerate(kinds):
        hit, p = F.col("text").rlike(kind.pattern), F.lit(kind.pattern)
        d = d.withColumn(f"_g{k}", F.when(hit, F.regexp_extract_all("text", p, F.lit(1))))
    for k, kind in enumerate(kinds):
        hit = F.col(f"_g{k}").isNotNull()
        d = d.withColumn(f"_w{k}", F.when(hit, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))))
        d = d.withColumn(f"_b{k}", F.when(hit, F.split("text", kind.pattern)))
    d = d.withColumn("_all", F.array_compact(F.array(*[_span(k, kind) for k, kind in enumerate(kinds)])))
    nothing = F.slice(F.flatten("_all"), 1, 0)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    fits = lambda a, x: (F.size(a) == 0) | (last(a).start + F.length(last(a).candidate) <= x.start)
    kept = F.aggregate(F.sort_array(F.flatten("_all")), nothing, lambda a, x: F.when(fits(a, x), F.concat(a, F.array(x))).otherwise(a))
    empty = "array<struct<start:int,rank:int,candidate:string,before:string,after:string>>"
    d = d.withColumn("found", F.when(F.size("_all") > 0, kept).otherwise(F.array().cast(empty)))
    return d.drop("_all", *[f"_{c}{k}" for c in "gwb" for k in range(len(kinds))])


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The ``size`` most frequent words (WORD_LETTERS letters a to z or more, in lower case) of all texts; ties in order."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") >= WORD_LETTERS)
    return [r.word for r in words.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(size).collect()]


def features(x: Callable[[str], Column], words: list[str]) -> dict[str, Column]:
    """The features by name; ``x`` gives candidate, before, after, source as columns; ``words`` is the dictionary."""
    c, before, after = x("candidate"), x("before"), x("after")
    n = F.length(c).cast("double")
    word = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]*$", 1))
    next_ = F.regexp_extract(after, r"^[^A-Za-z]*([A-Za-z]+)", 1)
    covered = n - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(words, key=lambda w: (-len(w), w))) or r"\z", ""))
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    return {
        "length": n,
        "digits": _count(c, "[0-9]") / n,
        "uppers": _count(c, "[A-Z]") / n,
        "lowers": _count(c, "[a-z]") / n,
        "transitions": _count(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "dictionary": covered / n,
        "path_like": _count(c, "[/_\\-]") / n,
        "in_path": flag(F.coalesce(x("source"), F.lit("")).rlike("(?i)test|example|sample|doc")),
        "key_before": flag(word.rlike("pass|secret|token|key|auth|credential")),
        "assigned_before": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "word_before": F.length(word).cast("double"),
        "word_after": F.length(next_).cast("double"),
    }


def exploded(d: DataFrame, *with_: str) -> DataFrame:
    """A row ``f`` per element of ``found``.  (A plain explode has its non-empty test moved below the projections,
    where it computes ``found`` again.)"""
    return d.select(*with_, F.explode_outer("found").alias("f")).where(F.col("f").isNotNull())


def findings(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """A row per candidate: doc_id, source, start (code points, from 0), kind, marked, candidate, before, after."""
    d = located(columns_of(docs, doc_id="doc_id", text="text", source="source"), kinds)
    d = exploded(d, "doc_id", "source").select("doc_id", "source", "f.*")
    names, marks = F.array(*[F.lit(k.name) for k in kinds]), F.array(*[F.lit(k.marked) for k in kinds])
    return d.select("doc_id", "source", "start", F.get(names, F.col("rank")).alias("kind"), F.get(marks, F.col("rank")).alias("marked"), "candidate", "before", "after")


class Ready:
    """The columns of a finding whose features are counted already."""

    def __init__(self, x: Column):
        self.x = x

    def ready(self) -> list[Column]:
        return [self.x.features[n] for n in FEATURES]

    def __call__(self, name: str) -> Column:
        return self.x[name]


def planted(docs: DataFrame, rows: int = PLANT_DOCS, seed: int = 11) -> DataFrame:
    """Labelled findings: known secrets (1) and known harmless strings (0), planted among the words of ``rows``
    documents, those with the smallest hashes.

    Random strings are digests of seed and document, so reruns agree; the words are those of 120 code points at a hashed place of
    the whole text.  Harmless ones are card numbers, digests that a
    word names, paths, names with numbers, times, placeholders.  Documents without text plant nothing."""
    d = columns_of(docs, doc_id="doc_id", text="text", source="source").where("text is not null")
    d = d.select("source", "text", F.sha2(F.concat_ws(" ", F.lit(seed), F.col("doc_id"), "text"), 256).alias("hex")).select("source", "hex", F.substring("text", F.pmod(F.xxhash64("hex"), F.greatest(F.length("text") - 119, F.lit(1))).cast("int") + 1, F.lit(120)).alias("text"))
    d = d.orderBy("hex", "source").limit(rows)
    word = lambda i: F.coalesce(F.get(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 2), F.lit(i)), F.lit("name"))
    d = d.select("source", "text", "hex", F.translate(F.base64(F.unhex("hex")), "+/=", "qZ7").alias("mixed"), word(0).alias("u"), word(1).alias("v"), word(2).alias("w"))
    lines = "concat_ws('\\n', mixed, reverse(mixed), mixed)"
    true = (
        "'token = \"' || left(hex, 40) || '\"'", "'TOKEN = \"' || upper(left(hex, 40)) || '\"'", "'api_key=' || left(mixed, 32)", "'password: ' || left(mixed, 12)", "'AKIA' || upper(left(mixed, 16))", "'ghp_' || left(mixed, 36)",
        "'client_secret: ' || mixed", "left(mixed, 40)", "'Bearer ' || mixed || reverse(mixed)", "'\"password\": \"' || left(mixed, 9) || '.' || u || '!\"'", f"'-----BEGIN RSA PRIVATE KEY-----\\n' || {lines} || '\\n-----END RSA PRIVATE KEY-----'",
        "'token=' || repeat(mixed, 12)", "'ghp_' || repeat(mixed, 12)", "'pwd=' || u || left(translate(hex, 'abcdef', '012345'), 1) || v || left(translate(hex, 'abcdef', '678901'), 2)",
        "'passphrase: ' || u || '-' || v || '-' || left(translate(hex, 'abcdef', '123456'), 1) || '-' || w", "'postgres://' || u || ':' || left(mixed, 12) || '@' || v || '.internal:5432/' || w", "'https://' || u || ':' || v || left(translate(hex, 'abcdef', '012345'), 3) || '@' || w || '.org/'",
    )
    false = (
        "left(translate(hex, 'abcdef', '012345'), 16)", "left(translate(hex, 'abcdef', '678901'), 19)", "'commit ' || left(hex, 40)", "'sha256 ' || hex", "'docs/' || u || '/' || v || '/part-12/' || w", "u || '_' || v || '_' || w || '_2024'",
        "'password = example_' || u || '1'", "'token: your_' || v || '_token_here1'", "'secret=' || u || '-' || v || '-' || w", "u || '-' || v || '-release-2024-11-05'", "'2024110510' || left(translate(hex, 'abcdef', '012345'), 11)", "'api_key=' || u || v || w", "'ftp://' || u || ':password@' || v || '.org/'", "'https://' || u || ':your_' || v || '@' || w || '.org/'",
    )
    forms = F.array(*[F.struct(F.expr(f).alias("plant"), F.lit(label).alias("label")) for kind, label in ((true, 1), (false, 0)) for f in kind])
    d = d.select("source", "text", F.explode(forms).alias("f")).select("source", "f.*", F.concat_ws(" ", F.left("text", F.lit(60)), "f.plant", F.substring("text", 61, 60)).alias("text"))
    found = exploded(located(d), "source", "plant", "label").where(F.contains("plant", F.col("f.candidate")))
    return found.select("source", "f.candidate", "f.before", "f.after", "label")


def train(labelled: DataFrame, words: list[str], rows: int = TRAIN_ROWS, trees: int = 15, depth: int = 6, seed: int = 11) -> Callable[[Callable[[str], Column]], Column]:
    """A function from the columns of a finding to its probability of being a secret.

    ``labelled``: findings with ``label`` (0 or 1).  At most ``rows`` distinct ones train the forest, those with
    the smallest hash.  If they have one label alone the probability is that label; without any it is 1."""
    given = labelled.select("candidate", "before", "after", "source", F.col("label").cast("double").alias("label")).distinct()
    own = given.select("label", *[c.alias(n) for n, c in features(F.col, words).items()], F.xxhash64(F.lit(seed), "candidate", "before", "after", "source").alias("_h"))
    part = stage(own.orderBy("_h", *FEATURES).limit(rows).coalesce(1), "labelled")
    counts = {r.label: r["count"] for r in part.groupBy("label").count().collect()}
    if len(counts) < 2:
        constant = next(iter(counts), 1.0)
        return lambda x: F.lit(constant)
    prior = counts[1.0] / sum(counts.values())
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(part)
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(ready)
    path = f"{shared_dir(part.sparkSession)}/leafmill-{uuid.uuid4().hex}/forest"
    forest.save(path)  # its nodes are a table: at most 2 ** (depth + 1) rows a tree
    nodes = {(r.treeID, r.nodeData.id): r.nodeData for r in part.sparkSession.read.parquet(f"{path}/data").collect()}

    def written(tree: int, at: int, f: list[Column]) -> Column:
        node = nodes[tree, at]
        if node.leftChild < 0:
            total = sum(node.impurityStats)
            return F.lit(float(node.impurityStats[1] / total if total else prior))
        low = f[node.split.featureIndex] <= F.lit(float(node.split.leftCategoriesOrThreshold[0]))
        return F.when(low, written(tree, node.leftChild, f)).otherwise(written(tree, node.rightChild, f))

    def score(x: Callable[[str], Column]) -> Column:
        f = x.ready() if isinstance(x, Ready) else list(features(x, words).values())
        return reduce(lambda a, b: a + b, [written(t, 0, f) for t in range(trees)]) / trees

    return score


def scored(d: DataFrame, score: Callable, words: list[str], threshold: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``d`` (text, source, found) with ``found`` given ``p`` and ``secret``."""

    def with_features(x: Column) -> Column:
        get = lambda n: F.col("source") if n == "source" else x[n]
        return F.struct(x.start.alias("start"), x["rank"].alias("rank"), x.candidate.alias("candidate"), F.struct(*[c.alias(n) for n, c in features(get, words).items()]).alias("features"))

    d = d.withColumn("found", F.transform("found", with_features))
    d = d.withColumn("found", F.transform("found", lambda x: F.struct(x.start.alias("start"), x["rank"].alias("rank"), x.candidate.alias("candidate"), score(Ready(x)).alias("p"))))
    names = F.array(*[F.lit(k.name) for k in kinds])
    return d.withColumn("found", F.transform("found", lambda x: F.struct(x.start.alias("start"), F.length(x.candidate).alias("length"), F.get(names, x["rank"]).alias("kind"), x.p.alias("p"), (x.p >= threshold).alias("secret"))))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, text, source, and ``found``: array of (start, length, kind, p, secret) for each row of ``docs``.

    ``labelled`` are findings with a label; left out, those ``planted`` among the documents' words.  Null
    texts have no findings, repeated rows the same ones each; other columns are left out."""
    words = dictionary(docs)
    score = train(planted(docs) if labelled is None else labelled, words)
    return scored(located(columns_of(docs, doc_id="doc_id", text="text", source="source")), score, words, threshold)


def redacted(text: Column, found: Column) -> Column:
    """The text with ``[kind]`` in the place of each secret."""
    secrets = F.filter(found, lambda x: x.secret)
    done = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a.out, F.substring(text, a["at"] + 1, x.start - a["at"]), F.lit("["), x.kind, F.lit("]")).alias("out"), (x.start + x.length).alias("at")),
    )
    return F.when(F.size(secrets) > 0, F.concat(done.out, F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def op6_secret_scan(spark, sf_dir):
    found = exploded(scan(table(spark, sf_dir, "documents")), "doc_id")
    return found.select("doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.length").cast("long").alias("length"), "f.kind", F.round("f.p", 6).alias("score"), F.col("f.secret").alias("is_secret"))
