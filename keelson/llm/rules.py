"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a column expression (JVM-side; no user functions, no shuffle).
``let`` binds an intermediate value to a lambda variable, so that an array is
computed once for a text however often the expressions refer to it.

Defined results: a null text counts as an empty one; an empty text has no
words, fails the base rule (fewer words than ``min_words``) and is rejected.
Repeated rows are judged one by one. Extra columns are ignored by
``judge`` and passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 8

# Frequent function words of the corpus' four languages.
STOP_WORDS = (
    "the of and to in that is for it with as was on be at by this from or an",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "de la le et les des en un du une que est pour qui dans par sur pas au plus",
    "de la que el en y a los se del las un por con no una su para es al lo",
)


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: ``scale * numerator`` must lie within [low, high] x ``denominator``."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The method's verdict: generous bounds that clean prose of any length stays well inside.
THRESHOLDS = (
    Rule("length", "n_words", None, 20, 10_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 2, 30),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop", "n_words", 0.005, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def _window_hashes(words: Column) -> Column:
    """A hash for each window of eight words, from those of its halves: every word is hashed once, however long the window."""

    def doubled(hashes: Column, step: int) -> Column:
        def of(h: Column) -> Column:
            many = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, 1, many), F.slice(h, step + 1, many), lambda x, y: F.xxhash64(x, y))

        return let(hashes, of)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < WINDOW:
        hashes, step = doubled(hashes, step), 2 * step
    return hashes


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    Most texts have no such window, which shows in the number of distinct
    hashes. In the others, windows with equal hashes are neighbours once they
    are sorted, and their words are compared.
    """

    def covered(starts: Column) -> Column:
        # starts is ascending: each window adds what the one before it leaves uncovered
        return F.aggregate(
            F.sequence(F.lit(1), F.size(starts)),
            F.lit(0).cast("long"),
            lambda acc, k: acc
            + F.when(k == 1, F.lit(WINDOW)).otherwise(
                F.least(F.lit(WINDOW), F.element_at(starts, k) - F.element_at(starts, F.greatest(k - 1, F.lit(1))))
            ),
        )

    def repeated(keys: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (F.slice(words, x["i"], WINDOW) == F.slice(words, y["i"], WINDOW)), F.lit(False))

        hits = F.filter(keys, lambda x, k: same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1)))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def total(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("i"))))
        whole = let(keys, lambda x: let(repeated(x), lambda s: F.when(F.size(s) > 0, covered(s)).otherwise(F.lit(0).cast("long"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), whole).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, let(_window_hashes(words), total)).otherwise(F.lit(0).cast("long"))


def _features(text: Column) -> Column:
    """All measures of a text, as one struct."""
    stop = list(dict.fromkeys(" ".join(STOP_WORDS).split()))

    def of(words: Column) -> Column:
        joined = F.array_join(words, "")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))
        stops = F.size(F.filter(F.split(F.lower(text), SPACE), lambda w: w.isin(stop)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            stops.cast("long").alias("n_stop"),
        )

    return let(words_of(text), of)


def _holds(rule: Rule, f: Callable[[str], Column]) -> Column:
    value, base = f(rule.numerator), F.lit(1) if rule.denominator is None else f(rule.denominator)
    tests = [F.lit(True)]
    if rule.low is not None:
        tests.append(value >= F.lit(float(rule.low)) * base)
    if rule.high is not None:
        tests.append(value <= F.lit(float(rule.high)) * base)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def measured(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """A struct column of measures and verdicts for the text column of ``docs``."""
    source = F.coalesce(docs[text], F.lit(""))

    def verdict(x: Column) -> Column:
        def f(name: str) -> Column:
            return {"n_dup_lines": x["lines"]["dup"], "n_lines": x["lines"]["n"]}[name] if name in ("n_dup_lines", "n_lines") else x[name]

        failed = (f("n_words") < 20) | (100 * f("n_repeat_words") > 30 * f("n_words"))
        kept = ~failed
        for r in rules:
            kept = kept & _holds(r, f)
        fields = [f(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop")]
        return F.struct(*fields, failed.alias("base_failed"), kept.alias("kept"))

    return let(let(source, _features), verdict)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """doc_id with every measure, ``base_failed`` and ``kept``."""
    m = docs.select(docs["doc_id"], measured(docs, rules=rules).alias("_m"))
    return m.select("doc_id", "_m.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.where(measured(docs, rules=rules)["kept"])
