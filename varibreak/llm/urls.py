"""URL filter: rules first, link-graph propagation for the rest.

Hosts of pages under allowing rules are trusted seeds and hosts of pages under blocking rules are blocked seeds,
each weighing the number of such pages.  Personalised PageRank carries trust along host edges (links from one
host's pages to another host) and, with all edges reversed, distrust back to the hosts that link to blocked ones.
Both are kept in units of pages.  A page no rule fits is blocked when its host's distrust is over ``threshold`` of
trust, distrust and the host's pages without a rule together.  Everything is made of built-in column functions.

Defined cases: a NULL url or one without ``://`` has empty host and path, no rule and verdict allow; relative
links stay on the host and make no edge; rows may repeat, a repeated page weighs again; NULL html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

# The rules of the query, as (rule, verdict); a rule is host, then path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-6
ROUNDS = 400


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, or NULL."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        under = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits.append(F.when(under, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts of ``host, html``."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]+)"), F.lit(1))
    out = pages.select(F.col("host").alias("src"), F.explode(links).alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    out = out.select("src", host_of(full).alias("dst")).filter("src <> dst AND src <> '' AND dst <> ''")
    return out.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``kind, host, mass``: personalised PageRank of the seeds ``kind, host, mass`` over ``kind, src, dst, share``.

    The mass of a seed without edges is its own.  All later rounds together move at most ``damping / (1 - damping)``
    of what a round has moved; ends when that is ``tolerance`` pages or less, however large the corpus is (a host has
    one page at least).  Not to get there in ``rounds`` is an error.
    """
    seeds = cut_lineage(seeds)
    edges = cut_lineage(edges)
    if not edges.limit(1).count():
        return seeds
    current = seeds
    for _ in range(rounds):
        flow = edges.join(current.withColumnRenamed("host", "src"), ["kind", "src"])
        flow = flow.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share") * damping).alias("mass"))
        following = seeds.unionByName(flow).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        following = cut_lineage(following)
        change = following.withColumnRenamed("mass", "now").join(current, ["kind", "host"], "full")
        moved = change.agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0))))).first()[0] or 0.0
        current = following
        if moved * damping <= tolerance * (1 - damping):
            return current
    raise ValueError(f"trust has not settled in {rounds} rounds")


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``page_id, url, html``."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = ruled.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("allowed"),
        F.count_if(F.col("fit.verdict") == "block").cast("double").alias("blocked"),
        F.count_if(F.col("fit").isNull()).cast("double").alias("open"),
    )
    hosts = cut_lineage(hosts)
    seeds = hosts.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("mass")),
        F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("mass")),
    ))).filter("mass > 0").select("kind", "host", "mass")
    links = cut_lineage(host_edges(parsed))
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    reverse = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    edges = forward.unionAll(reverse)
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    mass = propagate(seeds, edges).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"),
    )
    known = hosts.join(mass, "host", "left").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "open")
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust") + F.col("open"))
    known = cut_lineage(known.withColumn("judged", F.when(bad, "block").otherwise("allow")))
    slim = ruled.select("page_id", "host", "path", "fit")
    return slim.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "judged", F.lit("allow")).alias("verdict"), "trust", "distrust",
    )
