"""URL filter: rules on hosts and paths, and for the urls that no rule fits a verdict from the link graph of the hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import attach, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links to another host, in quotes or bare, with a scheme or without.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
#: Rules are a list in code and become one expression; longer lists are an error.
MAX_RULES = 1000
#: One page that a rule judges puts this much mass on its host. Masses are whole numbers, so the order of additions changes nothing.
PAGE_MASS = 1 << 20
#: Per cent of a host's mass that goes on along its links, and how often: what is still under way after ROUNDS is below 0.2 %.
DAMPING, ROUNDS = 85, 40
#: A host's links are met in parts of about this many.
EDGE_ROWS = 1 << 16
#: A host is blocked if over this per cent of what reaches it is distrust.
THRESHOLD = 50


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z lower-cased, and the path up to `?`, `#` or the end; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule (verdict, host, path) that fits: same host or a subdomain of it, and the
    path starts with the rule's. Of rules of one length that of the longer host; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    fits = []
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        same = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(same & path.startswith(start), F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): how often the pages of a host link to another host, of which the url must be known. pages: host, html."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass): personalised PageRank of the seeds (kind, host, mass) over edges (kind, src, dst, links).

    In each round a host keeps 100 - damping per cent of the mass that has reached it and sends the rest along its links
    in proportion to their number; what a host without links would send is gone. Kinds have edges of their own: trust
    goes along the links, distrust against them. The loop ends after `rounds`, or when nothing is under way."""
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("all_links"), F.ceil(F.count("*") / EDGE_ROWS).cast("int").alias("side"), F.count("*").alias("n"))
    out = stage(out, "outlinks")
    part = F.pmod(F.xxhash64("dst"), F.col("side")).cast("int").alias("part")
    edges = stage(attach(edges, out, ["kind", "src"], "n").select("kind", "src", part, "dst", "links", "all_links"), "edges")
    parts = out.select("kind", "src", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("part"))
    share = F.expr(f"cast(cast(cast(mass as decimal(38,0)) * {damping} * links as decimal(38,0)) div (all_links * 100) as bigint)")
    moving, kept = seeds, None
    for _ in range(rounds):
        moving = stage(moving, "moving")
        if moving.isEmpty():
            break
        here = moving.withColumn("mass", F.expr(f"mass - mass * {damping} div 100"))
        kept = here if kept is None else kept.unionByName(here)
        paid = parts.join(moving.withColumnRenamed("host", "src"), ["kind", "src"])
        sent = edges.join(paid, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), share.alias("mass"))
        moving = sent.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0")
    kept = seeds if kept is None else kept
    return kept.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: int = THRESHOLD, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A rule that fits decides. For other urls the host does: pages that rules allow are seeds of trust on their host, pages that
    rules block seeds of distrust. Personalised PageRank takes trust along the links between hosts (who is linked by trusted
    hosts is trusted) and distrust against them (who links to blocked hosts is not). A host is blocked if over `threshold` per
    cent of the mass that reaches it is distrust; one that neither reaches is allowed. trust and distrust are in pages.

    Null urls and urls without `://` have empty host and path, fit no rule and are allowed. Null and empty html has no links;
    links with userinfo or a port name a host of that spelling. Repeated rows give repeated rows and count as often. Columns
    other than page_id, url and html are not read. An empty table gives no rows."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    rows = stage(judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict")), "urls")
    links = stage(host_edges(judged), "links")
    trust, distrust = F.lit("trust").alias("kind"), F.lit("distrust").alias("kind")
    edges = links.select(trust, "src", "dst", "links").unionByName(links.select(distrust, F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    seeds = rows.where("rule is not null").groupBy(F.when(F.col("verdict") == "block", "distrust").otherwise("trust").alias("kind"), "host")
    mass = propagate(seeds.agg((F.count("*") * PAGE_MASS).alias("mass")), edges, damping, rounds)
    split = mass.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0)).alias(k) for k in ("trust", "distrust")])
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n")).join(split, "host", "left"), "hosts")
    told = attach(rows, hosts, ["host"], "n").fillna(0, ["trust", "distrust"])
    total = (F.col("trust") + F.col("distrust")).cast("decimal(38,0)")
    bad = F.col("distrust").cast("decimal(38,0)") * 100 > total * threshold
    pages_of = lambda c: (F.col(c) / PAGE_MASS).alias(c)
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), pages_of("trust"), pages_of("distrust"))
