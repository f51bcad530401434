"""URL filters: rules by host and path, and for the rest trust that spreads over the link graph of hosts.

A rule fits its host and all subdomains, where the path begins with the rule's. The longest fitting rule decides. Pages
without one are judged by their host: personalised PageRank spreads trust along links from the hosts of allowed pages,
and distrust against them from the hosts of blocked pages (who links to a blocked host is suspect). A host is blocked
when its distrust is more than ``threshold`` of its distrust and trust together.

Everything is DataFrame expressions. Masses are whole numbers (``UNIT`` in all), every share is rounded down, so sums are
exact whatever their order and a step that changes nothing ends the iteration early. Html stays where it is read: only
distinct host pairs and their counts are shuffled, after a partial sum. Intermediate masses are written tables.

Defined cases. Url NULL or without ``://``: empty host and path, no rule, no links; allowed, as is any host that neither
trust nor distrust reaches. Html NULL or empty: no links. Links inside a host, and those without a host (``mailto:``),
are no edges; a page counts once for each host that it links to. Repeated rows count, and are returned, as often as they
occur. Fitting rules of one length: the longer host decides, and of two equal rules ``block``. Very long hosts: only as many
labels as the longest rule has are looked up. Empty tables and no rules: everything is allowed. Other columns, whatever
their names, take no part. Hosts without links keep no mass beyond their own share of the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
UNIT = 10**15  # below 2**53, so that masses are exact as doubles
DAMPING, ITERATIONS, THRESHOLD = 0.85, 20, 0.5
BLANKS = r"\x20\x09-\x0D"
#: the target of a link: tags that hold angle brackets in their attributes are passed over, so that a scan stays linear
LINK = rf"(?i)<a[{BLANKS}][^<>]*?href[{BLANKS}]*=[{BLANKS}]*[\"']?([^\"'<>{BLANKS}]+)"
RULE = "struct<host:string,path:string,verdict:string>"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def linked_hosts(html: Column) -> Column:
    """The distinct hosts of the links of a page that name one."""
    named = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda u: u.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    hosts = F.transform(named, lambda u: lower_ascii(F.regexp_extract(u, r"^[^/]*//([^/?#]*)", 1)))
    return F.array_distinct(F.filter(hosts, lambda h: h != ""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table; one with these columns can be given instead."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast(f"array<{RULE}>")))


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) -> host, rules: those of the host and of the domains above it, longest first."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is above allow
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    # the names of the last 1, 2, ... labels
    tails = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    domains = hosts.where(F.lit(most > 0)).select(F.col("host"), F.explode(tails).alias("domain"))
    fitting = domains.join(rules.withColumnRenamed("host", "domain"), "domain")
    longest = [(-F.length("domain") - F.length("path")).alias("order"), (-F.length("domain")).alias("by_host")]
    entry = F.struct(*longest, "domain", "path", "verdict")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("rules"))


def by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict; the last two NULL where no rule fits."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # written, so that Spark knows its size and, where it is large, can split the host that most pages have
    found = parts.join(cut_lineage(_host_rules(parts.select("host").distinct(), rules)), "host", "left")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return found.select("page_id", "host", "path", first.alias("r")).select(
        "page_id", "host", "path", F.concat("r.domain", "r.path").alias("rule"), F.col("r.verdict").alias("verdict")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(url, html) -> from_host, to_host, n: how many pages of a host link to another."""
    own = host_of(F.col("url"))
    links = pages.select(own.alias("from_host"), F.explode(linked_hosts(F.col("html"))).alias("to_host"))
    return links.where("from_host <> '' AND from_host <> to_host").groupBy("from_host", "to_host").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """Seeds (host, trusted, blocked: numbers of pages) and links -> host, trust, distrust, ``UNIT`` in all at most.

    A page is worth as much in either, so a host without links and with as many allowed as blocked pages has as much of both.

    Each step: (1 - damping) of the seeds' own share and, rounded down, ``damping`` of what neighbours hand on in
    proportion to their links; distrust goes from the target of a link to its source.
    """
    total = seeds.agg(F.sum(F.col("trusted") + F.col("blocked"))).first()[0] or 1
    of_kind = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("weight")) for k, c in (("trust", "trusted"), ("distrust", "blocked"))]
    listed = seeds.select("host", F.inline(F.array(*of_kind))).where("weight > 0")
    base = F.floor(F.lit(float(UNIT)) * (F.lit(1.0 - damping) * F.col("weight") / F.lit(float(total))))
    own = cut_lineage(listed.select("kind", "host", base.alias("mass")))

    def ways_of(kind: str, source: str, target: str) -> DataFrame:
        return links.select(F.lit(kind).alias("kind"), F.col(source).alias("host"), F.col(target).alias("next"), "n")

    ways = ways_of("trust", "from_host", "to_host").unionByName(ways_of("distrust", "to_host", "from_host"))
    out = ways.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    share = F.lit(float(damping)) * F.col("n") / F.col("total")
    ways = cut_lineage(ways.join(out, ["kind", "host"]).select("kind", "host", "next", share.alias("share")))

    masses, mark = own, None
    for _ in range(iterations if not ways.isEmpty() else 0):
        moved = masses.join(ways, ["kind", "host"]).select("kind", F.col("next").alias("host"), F.floor(F.col("mass") * F.col("share")).alias("mass"))
        masses = cut_lineage(own.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass")))
        now = tuple(masses.agg(F.count("*"), F.bit_xor(F.xxhash64("kind", "host", "mass"))).first())
        if now == mark:
            break
        mark = now
    of = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")}
    return masses.groupBy("host").agg(of["trust"], of["distrust"])


def judge_pages(
    pages: DataFrame,
    rules: DataFrame,
    damping: float = DAMPING,
    iterations: int = ITERATIONS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(page_id, url, html) -> page_id, host, path, rule, verdict of every page."""
    ruled = cut_lineage(by_rules(pages.select("page_id", "url"), rules))
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    seeds = ruled.where("verdict IS NOT NULL").groupBy("host").agg(count(ALLOW).alias("trusted"), count(BLOCK).alias("blocked"))
    links = cut_lineage(host_links(pages.select("url", "html")))
    masses = propagate(cut_lineage(seeds), links, damping, iterations)
    suspect = F.col("distrust") > F.lit(float(threshold)) * (F.col("trust") + F.col("distrust"))
    blocked = cut_lineage(masses.where(suspect).select("host", F.lit(BLOCK).alias("by_links")))
    judged = ruled.join(blocked, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_links", F.lit(ALLOW)).alias("verdict"))
