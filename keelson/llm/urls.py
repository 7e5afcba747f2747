"""URL filters by rules and by trust that flows along links between hosts.

A rule names a host (and its subdomains) and a path prefix; the longest rule
that fits a url decides. For the rest the method decides per host: personalised
PageRank from trusted hosts along links, and distrust from blocked hosts
against them (a host that links to distrusted hosts is distrusted), on the
host graph in Spark. A host is blocked if its distrust passes ``threshold``
times the share that a uniform walk would give it, and its trust.

Trusted and blocked seeds are the hosts given, and the hosts all of whose ruled
pages are allowed or blocked and that have no page without a rule against
it; so a seed never blocks a page of its own.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is allowed; repeated rows are judged one by one; pages
without html have no links; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import apart
from .session import cut

DAMPING, ROUNDS, THRESHOLD, CHECKPOINT_EVERY = 0.85, 12, 0.5, 4  # ROUNDS: of the SQL only
PRECISION = 1e-3  # of a score, as a part of the share that blocks a host
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


# The rules of the query.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as (rule, verdict), else null: one CASE, longest first."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+|//[^"'\s>]+)"""), 1)
    each = pages.select(host_of(F.col("url")).alias("src"), F.explode(hrefs).alias("href"))
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    return each.select("src", host_of(target).alias("dst")).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, error: float = 1e-6, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind of seed over the edges of its kind.

    edges: (kind, src, dst, weight). seeds: (kind, host, mass). What reaches a
    host without links of its own kind leaves the walk. The walk ends once no
    score can be off by more than ``error``: after k rounds that is damping^k
    at most, or less by what the last rounds have changed.
    """
    total = apart(edges, ["kind", "src"], F.sum("weight").alias("total"))
    step = cut(edges.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    share = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = cut(seeds.join(F.broadcast(share), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass")))  # one row per kind
    score = start.withColumnRenamed("mass", "score")
    if step.isEmpty():
        return score
    before, shrink = score, damping**CHECKPOINT_EVERY
    for k in range(math.ceil(math.log(error) / math.log(damping))):
        moved = score.join(step, (score["kind"] == step["kind"]) & (score["host"] == step["src"])).select(score["kind"], F.col("dst").alias("host"), (F.col("score") * F.col("p") * F.lit(damping)).alias("score"))
        kept = start.select("kind", "host", (F.col("mass") * F.lit(1 - damping)).alias("score"))
        score = apart(moved.unionByName(kept), ["kind", "host"], F.sum("score").alias("score"))  # the next join can split a hub's links
        if (k + 1) % CHECKPOINT_EVERY == 0:
            score = cut(score)
            both = score.unionByName(before.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("change"))
            if (both.agg(F.sum(F.abs("change"))).first()[0] or 0.0) * shrink / (1 - shrink) <= error:
                break
            before = score
    return score


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, trusted: tuple[str, ...] = (), blocked: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    each = pages.select(pages["page_id"], pages["url"].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    each = each.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    per_host = each.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_rule.verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("_rule.verdict") == "block", 1)).alias("block")
    )
    per_host = cut(per_host)
    good = per_host.where((F.col("block") == 0) & ((F.col("allow") > 0) | F.col("host").isin(list(trusted)))).select(F.lit("trust").alias("kind"), "host", F.greatest("allow", F.lit(1)).alias("mass"))
    bad = per_host.where((F.col("block") == F.col("n")) | F.col("host").isin(list(blocked))).select(F.lit("distrust").alias("kind"), "host", F.greatest("block", F.lit(1)).alias("mass"))
    found = cut(links(pages))
    edges = found.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(found.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    hosts = per_host.count()
    even = 1.0 / max(hosts, 1)
    score = propagate(edges, good.unionByName(bad), max(PRECISION * threshold * even, 1e-12))
    verdicts = score.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    distrusted = cut(verdicts.where((F.col("distrust") > threshold * even) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("_host"), F.lit("block").alias("_by_host")))  # apart from the join, which can then split a hot host
    joined = each.join(distrusted, each["host"] == distrusted["_host"], "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.col("_by_host"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def keep(pages: DataFrame, **kwargs) -> DataFrame:
    """Rows of ``pages`` whose verdict is allow, by page_id and url."""
    wanted = judge(pages, **kwargs).where("verdict = 'allow'").select(F.col("host").alias("_h"), F.col("path").alias("_p")).distinct()
    keyed = pages.withColumns({"_h": host_of(pages["url"]), "_p": path_of(pages["url"])})
    return keyed.join(wanted, ["_h", "_p"], "left_semi").select(*pages.columns)
