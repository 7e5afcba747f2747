"""Secret scans: a random forest over candidate features removes false positives.

Candidates are runs of 16 or more token characters (letters, digits, ``+/_-``,
and ``=`` at the end). Shorter secrets, and those with other characters, such
as most passwords people choose, are never seen: telling them from words needs
other features than these. Features describe a candidate's
length, its character transitions, how much of it dictionary words cover, its
path and the words around it. The forest is trained by Spark's own library on
labelled findings and then compiled into column expressions, so a scan is one
projection without shuffle or user functions.

Training takes at most ``TRAINING_ROWS`` labelled findings (a documented bound),
of a larger table those with the least hashes, so that the same findings give
the same forest whatever their order;
scanning covers every whole text. Findings can be given; otherwise a labelled
set is generated by SQL expressions from fixed templates.

Defined results: a null or empty text has no findings; offsets count code
points; a score equal to the threshold is a secret; repeated rows are scanned
one by one; documents without a path column
have an empty path; ``redact`` passes extra columns through.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
CONTEXT = 48
TRAINING_ROWS, TREES, DEPTH, SEED = 8000, 15, 6, 7
THRESHOLD = 0.5
MARK = "[SECRET]"

# Words that identifiers, paths and prose are made of.
DICTIONARY = (
    "access account action address admin api app array auth base bearer bin block body buffer build button cache call check "
    "class client close code col command common config connect content context control copy core count create data date db default "
    "delete dev dist doc done edit element email end entry error event example fetch field file filter find font form from function "
    "get goes group handle hash header help here home host http id image import index info input insert item job json key label lib "
    "line link list load local lock log login main make map match max media menu message meta method min mode model module name net "
    "new next node none number object open option order output package page param parse password path place port post print private "
    "process product project public python query queue read record redirect remove render replace report request reset resource result "
    "return role root route row run save scan script search secret select send server service session set share site size sort source "
    "start state static status stop store string style submit sync system table tag task template test text this time title token tool "
    "type update upload url user usr util value var version view web widget with word work write your"
).split()

_SECRET = r"(?i)(secret|token|passw|pwd|api[_-]?key|apikey|access[_-]?key|bearer|credential|private[_-]?key|auth)"
_HARMLESS = r"(?i)(commit|checksum|sha\d*|md5|digest|uuid|guid|integrity|revision|etag|build|id\b|hash)"
_FIXTURE = r"(?i)(test|fixture|example|sample|mock|spec|docs?/)"

Features = dict[str, Column]


def features(candidate: Column, left: Column, right: Column, path: Column) -> Features:
    """The numbers that the forest sees, by name."""
    size = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    ratio = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / size
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    uncovered = F.length(F.regexp_replace(F.lower(candidate), words, ""))
    flag = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False)).cast("double")
    return {
        "length": size,
        "transitions": ratio(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "digits": ratio(r"[0-9]"),
        "upper": ratio(r"[A-Z]"),
        "letter_pairs": ratio(r"(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|le|ou|de|me|ve|co|ro|ri|ca|ta)"),
        "vowel_steps": ratio(r"(?i)(?<=[aeiou])[b-df-hj-np-tv-z]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / size,
        "not_hex": ratio(r"(?i)[^0-9a-f]"),
        "separators": ratio(r"[-_/=+]"),
        "dictionary": 1 - uncovered / size,
        "secret_word": flag(F.right(left, F.lit(24)), _SECRET),
        "secret_inside": flag(candidate, _SECRET),
        "harmless_word": flag(F.right(left, F.lit(24)), _HARMLESS),
        "assigned": flag(left, r"[=:]\s*[\"']?$"),
        "quoted": flag(left, r"[\"']$") * flag(right, r"^[\"']"),
        "fixture_path": flag(path, _FIXTURE),
    }


NAMES = ("length", "transitions", "digits", "upper", "letter_pairs", "vowel_steps", "distinct", "not_hex", "separators", "dictionary", "secret_word", "secret_inside", "harmless_word", "assigned", "quoted", "fixture_path")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """Findings (candidate, left, right, path, label) made by SQL expressions from fixed templates."""
    h = lambda k: F.sha2(F.concat_ws(":", F.col("id"), F.lit(seed), F.lit(k)), 256)
    pick = lambda k, options: F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(options))).cast("int") + 1)
    word = lambda k: pick(k, DICTIONARY)
    b64 = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + 1)))), "=", "A"), 1, n)
    hexes = lambda k, n: F.substring(h(k), 1, n)
    prose = F.concat_ws(" ", word(1), word(2), word(3))
    cat = F.concat
    lit = F.lit
    name = pick(4, ("token", "api_key", "secret", "password", "auth_token", "access_key", "apiKey", "client_secret", "GITHUB_TOKEN", "AWS_SECRET_ACCESS_KEY"))
    sep = pick(5, (" = ", "=", ": ", ":"))
    quote = pick(6, ('"', "'", '"', ""))
    src, fixture = ("src/app.py", "config/settings.yml", "deploy/env", "lib/client.js", "src0", ""), ("tests/fixtures/a.json", "test/unit.py", "examples/demo.py", "spec/mock.rb")
    key = cat(prose, lit(" "), name, sep, quote)
    plain = cat(prose, lit(" "))
    kinds: list[tuple[Column, Column, Column, tuple[str, ...], int]] = [
        (key, hexes(10, 40), quote, src, 1),
        (key, hexes(11, 32), quote, src, 1),
        (key, hexes(12, 64), quote, src, 1),
        (key, F.upper(hexes(13, 40)), quote, src, 1),
        (key, b64(14, 24), quote, src, 1),
        (key, b64(16, 40), quote, src, 1),
        (cat(plain, lit("Authorization: Bearer ")), b64(18, 43), lit(""), src, 1),
        (key, cat(lit("sk_live_"), F.regexp_replace(b64(20, 28), "[+/=]", "x")), quote, src, 1),
        (cat(plain, lit("aws_access_key_id"), sep, quote), cat(lit("AKIA"), F.substring(F.upper(F.regexp_replace(b64(22, 40), "[^A-Za-z2-7]", "")), 1, 16)), quote, src, 1),
        (cat(plain, pick(7, ("commit ", "revision ", "build ", "etag: "))), hexes(24, 40), lit(" "), src, 0),
        (cat(plain, pick(8, ("sha256:", "checksum ", "digest: ", "md5 = "))), hexes(25, 64), lit(""), src, 0),
        (cat(plain, pick(9, ("uuid ", "id: ", "guid="))), cat(hexes(26, 8), lit("-"), hexes(27, 4), lit("-"), hexes(28, 4), lit("-"), hexes(29, 4), lit("-"), hexes(30, 12)), lit(" "), src, 0),
        (plain, cat(word(31), word(32), word(33), word(34), lit("ing")), lit(" "), src, 0),
        (key, cat(word(35), lit("_"), word(36), lit("_"), word(37), lit("_"), word(38)), quote, src, 0),
        (cat(plain, lit("/")), cat(word(39), lit("/"), word(40), lit("/"), word(41), lit("/"), word(42)), lit("."), src, 0),
        (plain, cat(word(43), F.initcap(word(44)), F.initcap(word(45)), F.initcap(word(46))), lit("("), src, 0),
        (key, pick(47, ("xxxxxxxxxxxxxxxxxxxxxxxx", "your_api_key_goes_here", "0000000000000000000000", "your-token-goes-here", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa")), quote, src, 0),
        (plain, F.regexp_replace(hexes(48, 24), "[a-f]", "7"), lit(" "), src, 0),
        (plain, pick(49, ("----------------------", "======================", "____________________", "////////////////////")), lit(""), src, 0),
        (cat(plain, lit('integrity="sha512-')), b64(50, 64), lit('"'), src, 0),
        (key, hexes(52, 40), quote, fixture, 0),
        (key, b64(53, 32), quote, fixture, 0),
        (plain, cat(F.upper(word(58)), lit("_"), F.upper(word(59)), lit("_"), F.upper(word(60)), lit("_"), pick(61, ("KEY", "TOKEN", "NAME", "PATH")), pick(62, ("=", ""))), hexes(63, 6), src, 0),
        (plain, F.translate(hexes(55, 22), "0123456789abcdef", "thernaoistledhnu"), lit(" "), src, 0),
        (key, F.translate(hexes(56, 22), "0123456789abcdef", "thernaoistledhnu"), quote, src, 0),
    ]
    made = [
        F.struct(F.coalesce(c, lit("")).alias("candidate"), F.coalesce(left, lit("")).alias("left"), F.coalesce(right, lit("")).alias("right"), pick(57, paths).alias("path"), lit(float(label)).alias("label"))
        for left, c, right, paths, label in kinds
    ]
    parts = [spark.range(k, rows, len(made), 1).select("id", made[k].alias("f")).select("id", "f.*") for k in range(len(made))]
    return reduce(DataFrame.unionByName, parts).where(F.length("candidate") >= 16)


@dataclass(frozen=True)
class Forest:
    """Trees as flat tables of nodes; a leaf has feature -1 and leads to itself."""

    roots: tuple[int, ...]
    feature: tuple[int, ...]
    bound: tuple[float, ...]  # of a leaf: its vote
    low: tuple[int, ...]
    high: tuple[int, ...]
    depth: int


def train(findings: DataFrame, rows: int = TRAINING_ROWS) -> Forest:
    """A forest from at most ``rows`` labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    f = features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path"))
    own = ("candidate", "left", "right", "path", "label")
    picked = findings.select(*own).orderBy(F.xxhash64(*own), *own).limit(rows)
    numbers = picked.select("label", *[f[n].alias(n) for n in NAMES])
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(numbers)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors)
    return compiled([_tree(t.toDebugString) for t in forest.trees])


def _tree(text: str) -> tuple:
    """Nested (feature, bound, low, high), or (vote,)."""
    lines = iter(x.strip() for x in text.splitlines()[1:] if x.strip())

    def node() -> tuple:
        line = next(lines)
        if line.startswith("Predict:"):
            return (float(line.split()[1]),)
        feature, op, bound = re.fullmatch(r"If \(feature (\d+) (<=|>) (\S+)\)", line).groups()
        first = node()
        next(lines)  # the Else of the same test
        second = node()
        return (int(feature), float(bound), first, second) if op == "<=" else (int(feature), float(bound), second, first)

    return node()


def compiled(trees: list[tuple]) -> Forest:
    feature, bound, low, high, deepest = [], [], [], [], 0

    def add(t: tuple, depth: int) -> int:
        nonlocal deepest
        deepest = max(deepest, depth)
        k = len(feature)
        feature.append(-1 if len(t) == 1 else t[0])
        bound.append(t[0] if len(t) == 1 else t[1])
        low.append(k)
        high.append(k)
        if len(t) > 1:
            low[k], high[k] = add(t[2], depth + 1), add(t[3], depth + 1)
        return k

    roots = tuple(add(t, 0) for t in trees)
    return Forest(roots, tuple(feature), tuple(bound), tuple(low), tuple(high), deepest)


def score(forest: Forest, values: Column) -> Column:
    """The share of trees that vote for a secret; ``values`` is an array of the features in order."""
    feature, bound, low, high = (F.lit(list(x)) for x in (forest.feature, forest.bound, forest.low, forest.high))

    def descend(n: Column, _: Column) -> Column:
        below = F.when(F.get(values, F.get(feature, n)) <= F.get(bound, n), F.get(low, n)).otherwise(F.get(high, n))
        return F.when(F.get(feature, n) < 0, n).otherwise(below)

    steps = F.lit(list(range(forest.depth)) or [0])
    vote = lambda root: F.get(bound, F.aggregate(steps, root, descend))
    total = F.aggregate(F.lit(list(forest.roots)), F.lit(0.0), lambda acc, root: acc + vote(root))
    return total / F.lit(float(len(forest.roots)))


@cache
def _default_forest(application: str) -> Forest:
    return train(labelled_findings(SparkSession.getActiveSession()))


def default_forest(spark: SparkSession) -> Forest:
    """The forest of the generated findings, trained once per application."""
    return _default_forest(spark.sparkContext.applicationId)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, path: Column, forest: Forest) -> Column:
    """An array of (start, candidate, score) of every candidate in a text."""
    source = F.coalesce(text, F.lit(""))
    where = F.coalesce(path, F.lit(""))

    def scored(candidate: Column, left: Column, right: Column) -> Column:
        f = features(candidate, left, right, where)
        return _let(F.array(*[f[n] for n in NAMES]), lambda v: score(forest, v))

    def each(parts: Column, hits: Column) -> Column:
        # the text is parts[0] hits[0] parts[1] hits[1] ... parts[n]
        def one(hit: Column, i: Column) -> Column:
            before = F.get(parts, i)
            left = F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), before)
            return F.struct(F.length(before).alias("gap"), hit.alias("candidate"), scored(hit, F.right(left, F.lit(CONTEXT)), F.left(F.get(parts, i + 1), F.lit(CONTEXT))).alias("score"))

        return F.transform(hits, one)

    def placed(items: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,candidate:string,score:double>>")
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["candidate"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["candidate"].alias("candidate"), x["score"].alias("score")))).alias("out"),
        )
        return F.aggregate(items, start, step, lambda acc: acc["out"])

    return _let(
        F.regexp_extract_all(source, F.lit(CANDIDATE), 0),
        lambda hits: F.when(F.size(hits) > 0, _let(F.split(source, CANDIDATE, -1), lambda parts: placed(each(parts, hits)))),
    )


def scan(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, candidate_sha256, score and is_secret of every candidate; documents without any are absent."""
    forest = default_forest(docs.sparkSession) if forest is None else forest
    where = docs[path].cast("string") if path in docs.columns else F.lit("")
    each = docs.select(docs["doc_id"], F.explode(found(docs["text"].cast("string"), where, forest)).alias("f"))
    return each.select(
        "doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.candidate").cast("long").alias("length"), F.sha2("f.candidate", 256).alias("candidate_sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("is_secret")
    )


def redact(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a mark in place of every secret in ``text``."""
    forest = default_forest(docs.sparkSession) if forest is None else forest
    where = docs[path].cast("string") if path in docs.columns else F.lit("")
    text = docs["text"].cast("string")

    def rebuilt(findings: Column) -> Column:
        secrets = F.filter(findings, lambda f: f["score"] >= threshold)

        def cut(items: Column) -> Column:
            start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
            step = lambda acc, x: F.struct(
                (x["start"] + F.length(x["candidate"]) + 1).alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"], x["start"] + 1 - acc["at"]), F.lit(MARK)).alias("out"),
            )
            return F.aggregate(items, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))

        return _let(secrets, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(text))

    return docs.withColumn("text", F.coalesce(_let(found(text, where, forest), rebuilt), text))
