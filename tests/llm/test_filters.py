"""The URL filter against its SQL, on pages that link to each other."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.llm import linkgraph
from alertloom.llm.queries import ORACLES, QUERIES, URL_RULES
from compare import connect, difference

PAGES = "page_id bigint, url string, html string, host string, dst string, mass bigint"


def link(*hosts):
    return "".join(f'<A HREF = "https://{h}/x?y">t</a><img src=//{h}>' for h in hosts)


AWKWARD = [
    (1, "https://good.org/a", link("friend.net", "other.net")),
    (2, "https://good.org/b", link("friend.net")),
    (3, "http://friend.net/x", link("far.net", "friend.net")),
    (4, "http://far.net/", ""),
    (5, "http://bad.com/de/1", link("friend.net")),
    (6, "http://farm.net/1", link("bad.com", "bad.com", "good.org")),
    (7, "http://farm.net/2#x", link("bad.com")),
    (8, "http://feeder.net?q=/de/", link("farm.net")),
    (9, "HTTP://WWW.Example.ORG/en/17.html?x=http://y/", None),
    (10, "http://example.org/es/", ""),
    (11, "http://notexample.org/es/", ""),
    (12, "http://org", ""),
    (13, "http://org/", ""),
    (14, None, link("bad.com")),
    (15, "no scheme/de/", link("bad.com")),
    (16, "", ""),
    (16, "http://com/de/", "href=//"),
    (None, "ftp://É.com:80/fr/" + "x" * 100_000 + "://", "href='//a.b:80/'" * 20_000),
    (17, "x://y://com/de/", link("É.COM", "com")),
    (17, "x://y://com/de/", link("É.COM", "com")),
    (18, "http://hub.com/fr/", link(*[f"h{i}.net" for i in range(300)])),
    *[(100 + i, f"http://h{i}.net/en/", link(f"h{(7 * i) % 300}.net", "hub.com", *["farm.net"] * (i % 3))) for i in range(300)],
]


def staged(spark, folder, rows, schema=PAGES):
    import duckdb

    frame = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], schema)
    frame.coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["linked", "empty"])
def test_urls_equal_their_sql(spark, tmp_path, rows):
    con = staged(spark, tmp_path, rows)
    found = QUERIES["op13_url_filter"](spark, str(tmp_path)).cache()
    assert difference(found, con, ORACLES["op13_url_filter"]) == ""
    if rows:
        told = found.where("rule is null").groupBy("host").agg(F.max("verdict").alias("v"), F.max("trust").alias("t"), F.max("distrust").alias("d")).toPandas().set_index("host")
        assert told.loc["far.net", "v"] == "allow" and told.loc["far.net", "t"] > 0
        assert told.loc["feeder.net", "v"] == "block" and told.loc["farm.net", "v"] == "block"
        assert told.loc["", "v"] == "allow" and told.loc["", "t"] == 0
    found.unpersist()


def test_whole_table_equals_its_sql(spark, sf):
    assert difference(QUERIES["op13_url_filter"](spark, sf), connect(sf), ORACLES["op13_url_filter"]) == ""


def test_mass_is_that_of_dense_pagerank(spark):
    """Against plain matrix powers: same masses but for the units that whole numbers lose."""
    import numpy as np

    rng = np.random.default_rng(3)
    hosts = [f"h{i}" for i in range(12)]
    links = rng.integers(0, 4, (12, 12)) * (rng.random((12, 12)) < 0.4)
    links[4] = 0
    edges = pd.DataFrame([("trust", hosts[i], hosts[j], int(links[i, j])) for i in range(12) for j in range(12) if links[i, j]], columns=["kind", "src", "dst", "links"])
    seeds = pd.DataFrame([("trust", hosts[i], int(1 << 30) * (i + 1)) for i in (0, 4, 7)], columns=["kind", "host", "mass"])
    got = linkgraph.propagate(spark.createDataFrame(seeds), spark.createDataFrame(edges)).toPandas().set_index("host")["mass"]
    step = links / np.maximum(links.sum(1, keepdims=True), 1)
    moving, kept = np.array([float(1 << 30) * (i + 1) * (i in (0, 4, 7)) for i in range(12)]), np.zeros(12)
    for _ in range(linkgraph.ROUNDS):
        kept += 0.15 * moving
        moving = 0.85 * moving @ step
    for i, h in enumerate(hosts):
        assert got.get(h, 0) == pytest.approx(kept[i], abs=2000)


def test_longest_rule_wins_and_long_lists_are_refused(spark):
    rules = [("allow", "b.c", "/"), ("block", "c", "/xyz"), ("allow", "a.b.c", "/xy"), ("block", "b.c", "/x")]
    urls = spark.createDataFrame([("http://a.b.c/xyz",), ("http://b.c/xyz",), ("http://b.c/",), ("http://z.c/xy",)], "url string")
    host, path = linkgraph.host_and_path(F.col("url"))
    got = [tuple(r[0]) if r[0] else None for r in urls.select(linkgraph.fitting(host, path, rules)).collect()]
    assert got == [("a.b.c/xy", "allow"), ("b.c/x", "block"), ("b.c/", "allow"), None]
    with pytest.raises(ValueError):
        linkgraph.fitting(host, path, URL_RULES * 300)
