"""Hard negatives against their SQL and against plain inner products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import negatives
from alertloom.llm.queries import ORACLES, QUERIES
from compare import connect, difference

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, q int, planes string, side int"


def staged(spark, folder, rows):
    frame = spark.createDataFrame([(*r, "clash", 0, "clash", 1) for r in rows], VECTORS)
    frame.coalesce(2).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return con


def awkward():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 21))
    vectors = [centres[i % 4] + 0.4 * rng.normal(size=21) for i in range(420)]
    rows = [(i, [float(x) for x in v], i % 4) for i, v in enumerate(vectors)]
    hot = [float(x) for x in vectors[0]]
    rows += [(1000 + i, hot, i % 3) for i in range(300)]  # a vector that a third of all rows have
    rows += [(2000, None, 1), (2100, hot, None), (2200, [*hot[:-1], None], 1), (2300, [*hot[:-1], float("nan")], 1), (2400, [*hot[:-1], float("inf")], 1)]
    rows += [(None, hot, 1), (None, hot, 2), (3000, hot, 7), (-100, [-x for x in hot], 2), (-101, [0.0] * 21, 2), rows[0], rows[0], (200, hot, 3)]
    return rows


@pytest.mark.parametrize("small", [False, True], ids=["one_block", "many_blocks"])
def test_awkward_rows_equal_their_sql(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(negatives, "CANDIDATE_ROWS", 50)
        monkeypatch.setattr(negatives, "ANCHOR_ROWS", 2)
        monkeypatch.setattr(negatives, "SCORED_AT_ONCE", 60)
    con = staged(spark, tmp_path, awkward())
    found = QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert found.count() > 50
    assert difference(found, con, ORACLES["op11_hard_negatives"]) == ""


def test_no_rows(spark, tmp_path):
    con = staged(spark, tmp_path, [])
    assert difference(QUERIES["op11_hard_negatives"](spark, str(tmp_path)), con, ORACLES["op11_hard_negatives"]) == ""


def test_vectors_of_unlike_length_and_huge_components(spark):
    rows = [(0, [2.0, 1.0], 1), (1, [2.0], 1), (2, [], 2), (3, [3e38, -3e38], 1), (4, [1.8, 0.0, 9.0], 2), (5, [1.0, 3.0], 2)]
    frame = spark.createDataFrame([(*r, "", 0, "", 0) for r in rows], VECTORS)
    got = [tuple(r) for r in negatives.mine(frame, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 4, 512 * 512, 460 * 512)]  # the huge row is a positive, to which no negative comes near
    close = spark.createDataFrame([(*r, "", 0, "", 0) for r in [*rows, (6, [2e38, -1e38], 2)]], VECTORS)
    got = {tuple(r) for r in negatives.mine(close, F.col("vec_id") == 0).collect()}
    assert got == {(0, 1, 1, 4, 512 * 512, 460 * 512), (0, 3, 1, 6, 256 * negatives.LARGEST, 256 * negatives.LARGEST)}


def test_scores_are_inner_products():
    rng = np.random.default_rng(2)
    for low, high in ((-3, 4), (-70000, 50000), (0, 1), (-1, 0)):
        q, a = rng.integers(low, high, (40, 24)), rng.integers(low, high, (7, 24))
        planes = max(int(high).bit_length(), int(~low).bit_length()) + 1
        assert (negatives.scores(negatives.bit_planes(q, planes), negatives.subset_sums(a)) == q @ a.T).all()


def test_whole_table_equals_its_sql(spark, sf):
    assert difference(QUERIES["op11_hard_negatives"](spark, sf), connect(sf), ORACLES["op11_hard_negatives"]) == ""
