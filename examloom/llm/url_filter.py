"""Operator 8, URL filters: rules first, link-graph propagation for what no rule covers.

Pages that rules allow make their hosts trusted seeds, pages that rules block make them blocked seeds. Trust follows
links forwards (personalised PageRank from the trusted seeds); distrust follows them backwards, from a blocked host to
those that link to it, until no further host is reached and next to nothing is on its way. Each host's balance of the two is
held against a threshold.

Hosts are rows: every step is a join of the scores with the host edges and a sum per host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Propagation ends when what is still on its way is less than this share of all trust, and of all distrust, and no further host is reached.
TOLERANCE = 1e-6
#: Steps between two written tables: lineage and plans stay short.
STRIDE = 5
#: Decimals of a balance: the order in which a host's sums are added is no difference.
DECIMALS = 9
#: So many hosts or fewer are broadcast to the pages (some 100 bytes each); more are joined by a shuffle.
FEW_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one, and for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, and the longest fitting rule with its verdict (null without one)."""
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return out.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links): the pages of one host with a link to another host."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""), 1)
    # A link may leave out the scheme.
    target = F.translate(F.regexp_extract("link", r"//(.*)$", 1), UPPER, LOWER)
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.array_distinct(found)).alias("link")).select("source", target.alias("target"))
    return links.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds of the same columns, each summing to 1 (or 0), over (source, target, links).

    Personalised PageRank as a series: a step passes on what the step before has brought, and a host's score is the sum of what
    came by. What is on its way shrinks with every step, whatever the graph. What reaches a host without links returns to the seeds;
    that makes all scores larger by one factor, so it is done once, at the end, by scaling each kind to its sum.
    """
    sent = links.groupBy("source").agg(F.sum("links").alias("sent"))
    got = links.groupBy("target").agg(F.sum("links").alias("got"))
    edges = links.join(sent, "source").join(got, "target")
    forth = edges.select(F.col("source").alias("host"), F.col("target").alias("next"), (F.col("links") / F.col("sent")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.select(F.col("target").alias("host"), F.col("source").alias("next"), F.lit(0.0).alias("t"), (F.col("links") / F.col("got")).alias("d"))
    edges = materialize(forth.unionByName(back))
    now = seeds.select("host", "trust", "distrust", F.col("trust").alias("t"), F.col("distrust").alias("d"))
    names, sums = ("trust", "distrust"), [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("trust", "distrust", "t", "d")]
    reached = [F.count_if(F.col(c) > 0).alias(f"with_{c}") for c in names]
    totals, going, before = None, bool(edges.take(1)), None
    while going:
        for _ in range(STRIDE):
            moving = now.filter((F.col("t") > 0) | (F.col("d") > 0)).select("host", F.col("t").alias("has_t"), F.col("d").alias("has_d"))
            brought = moving.join(edges, "host").select(F.col("next").alias("host"), (F.col("has_t") * F.col("t") * damping).alias("t"), (F.col("has_d") * F.col("d") * damping).alias("d"))
            kept = now.select("host", "trust", "distrust", F.lit(0.0).alias("t"), F.lit(0.0).alias("d"))
            both = kept.unionByName(brought.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), "t", "d"))
            now = both.groupBy("host").agg((F.sum("trust") + F.sum("t")).alias("trust"), (F.sum("distrust") + F.sum("d")).alias("distrust"), F.sum("t").alias("t"), F.sum("d").alias("d"))
        now = materialize(now)
        totals = now.agg(*sums, *reached).first()
        hosts = totals["with_trust"], totals["with_distrust"]
        going = hosts != before or totals["t"] > tolerance * totals["trust"] or totals["d"] > tolerance * totals["distrust"]
        before = hosts
    totals = totals or now.agg(*sums).first()
    return now.select("host", *((F.col(c) / F.lit(totals[c] or 1.0)).alias(c) for c in names))


def filter_urls(pages: DataFrame, rules: list[Rule], threshold: float = 0.0, unknown: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Without a fitting rule, a host with (trust - distrust) / (trust + distrust) below ``threshold`` is blocked; a host that
    neither reaches is ``unknown``. Null urls and those without ``://`` have an empty host and are unknown. Repeated pages are
    judged each and count each as seeds; an empty table gives an empty result; only page_id, url and html are read.
    """
    ruled = materialize(judged(pages, rules))
    counts = ruled.filter((F.col("host") != "") & F.col("ruled").isNotNull()).groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    seeds = materialize(counts.select("host", (F.col("a") / F.lit(float(max(1, total["a"])))).alias("trust"), (F.col("b") / F.lit(float(max(1, total["b"])))).alias("distrust")))
    scores = propagate(seeds, materialize(host_links(pages)))
    both = F.col("trust") + F.col("distrust")
    verdicts = materialize(scores.filter(both > 0).select("host", F.when(F.round((F.col("trust") - F.col("distrust")) / both, DECIMALS) < threshold, "block").otherwise("allow").alias("reached")))
    verdicts = F.broadcast(verdicts) if verdicts.count() <= FEW_HOSTS else verdicts
    return ruled.join(verdicts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "reached", F.lit(unknown)).alias("verdict"))
