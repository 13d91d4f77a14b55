"""The prefix trie against its SQL, and the z-fast search on its own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from alertloom.llm import prefixes
from alertloom.llm.queries import ORACLES, QUERIES
from compare import connect, difference

TURNS = "conv_id bigint, turn bigint, role string, text string, pos int, hi string, end int"


def staged(spark, folder, rows):
    frame = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], TURNS)
    frame.coalesce(2).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


def awkward():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"{'hello' if t < 2 else ''}{(c * 7 // (3 if t < 4 else 1)) % (t + 2)}") for c in range(40) for t in range(c % 12)]
    rows += [(100 + 5 * c, t, "user", f"same{t}") for c in range(30) for t in range(6)]  # a third of all are equal
    rows += [(1000, t, "a", f"line {t}") for t in range(300)]  # one long conversation, and others that stop or turn off on its way
    rows += [(1000 + 5 * k, t, "a", f"line {t}" if t < 9 * k or k % 2 else "off") for k in range(1, 12) for t in range(10 * k)]
    rows += [(-3, None, None, None), (-3, 1, None, "x"), (-3, 1, None, "x"), (-3, 1, "", "w"), (-4, 0, "r", "é" * 50_000), (None, 0, "r", "lost"), (-5, 2, "ab", "c"), (-10, 2, "a", "bc")]
    return rows


@pytest.mark.parametrize("small", [False, True], ids=["whole", "in_blocks"])
def test_awkward_rows_equal_their_sql(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(prefixes, "BLOCK_TURNS", 7)
        monkeypatch.setattr(prefixes, "ID_RANGE", 3)
    con = staged(spark, tmp_path, awkward())
    assert difference(QUERIES["op12_conversation_prefix_trie"](spark, str(tmp_path)), con, ORACLES["op12_conversation_prefix_trie"]) == ""


@pytest.mark.parametrize("rows", [[], [(7, 0, "u", "x")], [(None, 0, "u", "x")]], ids=["empty", "turnless", "no_id"])
def test_small_tables(spark, tmp_path, rows):
    con = staged(spark, tmp_path, rows)
    assert difference(QUERIES["op12_conversation_prefix_trie"](spark, str(tmp_path)), con, ORACLES["op12_conversation_prefix_trie"]) == ""


def test_whole_table_equals_its_sql(spark, sf):
    assert difference(QUERIES["op12_conversation_prefix_trie"](spark, sf), connect(sf), ORACLES["op12_conversation_prefix_trie"]) == ""


def test_fattest_number(spark):
    def plain(a, b):
        return max(range(a + 1, b + 1), key=lambda x: (x & -x, x))

    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", prefixes.fattest("a", "b").alias("f")).collect()
    assert all(plain(r.a, r.b) & -plain(r.a, r.b) == r.f & -r.f and r.a < r.f <= r.b for r in got)


def test_search_finds_where_strings_leave(spark):
    """Locate every string in a trie of others, against plain comparison."""
    import random

    draw = random.Random(5)
    strings = sorted({tuple(draw.choice("ab") for _ in range(draw.randint(1, 20))) for _ in range(120)})
    rows = [(i, d, ch, "", len(ch)) for i, s in enumerate(strings) for d, ch in enumerate(s, 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, depth bigint, t1 string, t2 string, bytes bigint")
    paths = prefixes.running(turns).withColumnRenamed("conv_id", "sid").cache()
    all_rows = spark.createDataFrame([(i, len(s)) for i, s in enumerate(strings)], "sid bigint, len bigint")
    known, asked = all_rows.where("sid % 2 = 0"), all_rows.where("sid % 2 = 1")
    trie = prefixes.zfast_trie(known, paths)
    found = {r.sid: r.at for r in prefixes.locate(asked, trie, paths, 5).collect()}
    common = lambda s, t: next((k for k, (x, y) in enumerate(zip(s, t)) if x != y), min(len(s), len(t)))
    assert found == {i: max(common(s, t) for t in strings[::2]) for i, s in enumerate(strings) if i % 2}
    paths.unpersist()
