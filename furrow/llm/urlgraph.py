"""URL filters: rules first, then personalised PageRank over the graph of links between hosts.

Trust flows from trusted seeds along the links, distrust from blocked seeds against them. Each host is judged by two shares in [0, 1]:
the trust it got, in links of trusted hosts, which no link from elsewhere lowers; and the distrust that its own links brought back, which
does not thin out in farms of any size. A host whose bad share exceeds both its good share and a threshold is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an anchor's absolute or scheme-relative link. Relative links stay on their host and are no edge, whatever a <base> says;
#: <link> and other elements name resources, not pages, and do not count.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s"'<>/?#]+)"""


def url_host(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z lower-cased; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or #; empty if there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, rule) that fits; null if none does. A rule is a host, then a path from its first slash."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. The counts are combined before they move."""
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = 12, follow: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(host, trust, distrust, good, bad) for all hosts of links (src, dst, n) and seeds (host, trusted, blocked: 0 or 1).

    trust is the personalised PageRank of walks from trusted seeds along the links, distrust that of walks from blocked seeds against
    them; a seed's own start is 1 - follow, or 1 for a graph without links, and weight at hosts without onward links returns to the seeds.
    These masses rank hosts. good and bad, in [0, 1], are what verdicts compare:

    good: 1 at trusted hosts, else the trust that came in over that of an average link of a trusted host, at most follow. Links from hosts
    without trust add nothing to it and take nothing away.
    bad: 1 at blocked hosts, else the distrust that came back along the host's own links, each host's links sharing 1: follow times the
    mean of bad over them. It says something of one host's links alone, however many others link to the same seed.

    `rounds` rounds; with a tolerance, on until neither good nor bad changes by more. Each round ends in a written table in the shared folder.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("out")).withColumnRenamed("src", "host")
    into = links.groupBy("dst").agg(F.sum("n").alias("into")).withColumnRenamed("dst", "host")
    hosts = links.select(F.col("src").alias("host")).union(links.select("dst")).union(seeds.select("host")).distinct()
    nodes = hosts.join(seeds, "host", "left").join(out, "host", "left").join(into, "host", "left").na.fill(0)
    trusted, blocked = F.col("trusted").cast("double"), F.col("blocked").cast("double")
    nodes = checkpointed(nodes.select("host", "trusted", "blocked", "out", "into", trusted.alias("trust"), blocked.alias("distrust"), trusted.alias("flow"), trusted.alias("good"), blocked.alias("bad")))
    total = nodes.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b"), F.max("out").alias("links")).first()
    if not total["links"]:
        return nodes.select("host", "trust", "distrust", "good", "bad")
    shares = checkpointed(
        links.join(out.withColumnRenamed("host", "src"), "src")
        .join(into.withColumnRenamed("host", "dst"), "dst")
        .select("src", "dst", (F.col("n") / F.col("out")).alias("of_out"), (F.col("n") / F.col("into")).alias("of_into"))
    )
    trust, none = F.col("trust"), F.lit(0.0)
    sums = (
        F.sum(F.when(F.col("out") == 0, trust).otherwise(0.0)).alias("t"),
        F.sum(F.when(F.col("into") == 0, F.col("distrust")).otherwise(0.0)).alias("b"),
        (F.sum(F.col("flow") * F.col("trusted")) / F.nullif(F.sum(F.col("out") * F.col("trusted")), F.lit(0))).alias("a_link"),
    )
    seen, done = nodes.agg(*sums).first(), 0
    while True:
        rank = nodes.select("host", "trust", "distrust", "flow", "bad")
        forward = shares.join(rank, shares["src"] == rank["host"]).select(F.col("dst").alias("h"), (trust * F.col("of_out")).alias("t"), (F.col("flow") * F.col("of_out")).alias("f"), none.alias("b"), none.alias("own"))
        backward = shares.join(rank, shares["dst"] == rank["host"]).select(
            F.col("src").alias("h"), none.alias("t"), none.alias("f"), (F.col("distrust") * F.col("of_into")).alias("b"), (F.col("bad") * F.col("of_out")).alias("own")
        )
        moved = forward.union(backward).groupBy("h").agg(*(F.sum(c).alias(c) for c in ("t", "f", "b", "own")))
        back_t, back_b = seen["t"] / max(1, total["t"]), seen["b"] / max(1, total["b"])
        new_trust = (1 - follow + follow * back_t) * F.col("trusted") + follow * F.coalesce("t", none)
        new_bad = F.when(F.col("blocked") == 1, 1.0).otherwise(follow * F.coalesce("own", none))
        # flow is trust without returned weight: the same up to a factor in the end, and settled after as many rounds as trust has steps to go.
        came = follow * F.coalesce("f", none)
        new_good = F.when(F.col("trusted") == 1, 1.0).otherwise(F.least(F.lit(follow), came / F.lit(seen["a_link"])) if seen["a_link"] else 0.0)
        change = F.greatest(F.abs(new_bad - F.col("bad")), F.abs(new_good - F.col("good")))
        nodes = checkpointed(
            nodes.join(moved, nodes["host"] == moved["h"], "left").select(
                "host",
                "trusted",
                "blocked",
                "out",
                "into",
                new_trust.alias("trust"),
                ((1 - follow + follow * back_b) * F.col("blocked") + follow * F.coalesce("b", none)).alias("distrust"),
                (F.col("trusted") + came).alias("flow"),
                new_good.alias("good"),
                new_bad.alias("bad"),
                change.alias("change"),
            )
        )
        done += 1
        seen = nodes.agg(*sums, F.max("change").alias("change")).first()
        if done >= rounds and (tolerance is None or seen["change"] <= tolerance):
            return nodes.select("host", "trust", "distrust", "good", "bad")


def walk_shares(links: DataFrame, seeds: DataFrame, rounds: int = 12, follow: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, good, bad) of propagate(), after at least `rounds` rounds and until no share changes by more than tolerance."""
    return propagate(links, seeds, rounds, follow, tolerance).select("host", "good", "bad")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], rounds: int = 12, follow: float = 0.85, threshold: float = 0.02) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, by_graph.

    pages needs page_id, url and html; other columns are ignored. A null url or one without :// has empty host and path, and is
    allowed, as is a host that nothing is known of. A null html has no links. The longest fitting rule decides;
    without one the host's good and bad shares do (propagate(), of which rounds and follow are parameters). Seeds are the hosts with pages that a rule allows but none that one blocks, and the other
    way round. Repeated rows are judged alike. No rows give no rows.
    """
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).drop("url")
    said = F.lit(None).cast("string")
    for verdict, rule in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    ruled = ruled.withColumn("said", said)
    seeds = (
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(F.max(F.when(F.col("said") == "allow", 1).otherwise(0)).alias("a"), F.max(F.when(F.col("said") == "block", 1).otherwise(0)).alias("b"))
        .select("host", F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0).alias("trusted"), F.when((F.col("b") == 1) & (F.col("a") == 0), 1).otherwise(0).alias("blocked"))
    )
    scores = walk_shares(checkpointed(host_links(pages)), seeds, rounds, follow)
    bad = scores.where((F.col("bad") > F.col("good")) & (F.col("bad") >= threshold)).select(F.col("host").alias("bad_host"))
    open_pages = ruled.where("said is null").join(bad, F.col("host") == F.col("bad_host"), "left")
    judged = open_pages.select("page_id", "host", "path", "rule", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow").alias("verdict"), F.lit(True).alias("by_graph"))
    return ruled.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(False).alias("by_graph")).unionByName(judged)
