"""Draws of replacements from all good rows."""

import hashlib

import pytest
from pyspark.sql import functions as F
from samplemill.operators import control as oc


def drawn(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52


@pytest.mark.parametrize("good", [1, 700, 5000])
def test_every_good_row_can_replace_a_failed_one(spark, good):
    # at most 1,024 good rows were ever drawn
    n = 20_000
    rows = spark.range(n).repartition(7).select("id", (F.col("id") * 10).alias("v"), F.create_map(F.lit("k"), "id").alias("m"))
    got = {r.id: r for r in oc.replace_failed(F.col("id") >= good, seed=3, key="id")(rows).collect()}
    want = {i: i if i < good else int(drawn("3/bad", i) * good) for i in range(n)}
    assert {i: r.v for i, r in got.items()} == {i: 10 * w for i, w in want.items()}
    assert all(r.m == {"k": want[i]} for i, r in got.items())
    assert len({r.v for i, r in got.items() if i >= good}) > 0.9 * good


def test_good_rows_of_one_id_are_candidates_of_their_own(spark):
    rows = spark.createDataFrame([(None, 1.0, 0), (7, 2.0, 0), (7, 3.0, 0), (7, 4.0, 0)] + [(i, None, 1) for i in range(100, 160)] + [(None, None, 1)], "id long, v double, bad int")
    out = oc.replace_failed(F.col("bad") == 1, seed="s", key="id")(rows)
    got = out.collect()
    assert len(got) == 65 and {r.bad for r in got} == {0} and sum(r.id is None for r in got) == 2
    assert {r.v for r in got if (r.id or 0) >= 100} == {1.0, 2.0, 3.0, 4.0}
    assert sorted(got, key=str) == sorted(oc.replace_failed(F.col("bad") == 1, seed="s", key="id")(rows.repartition(5)).collect(), key=str)


def test_without_good_rows_or_rows_nothing_is_replaced(spark):
    rows = spark.range(5).select("id", F.lit(1).alias("v"))
    assert oc.replace_failed(F.lit(None).cast("boolean"), seed=3, key="id")(rows).count() == 0
    assert oc.replace_failed(F.lit(True), seed=3, key="id")(rows.limit(0)).count() == 0
    assert sorted(oc.replace_failed(F.lit(False), seed=3, key="id")(rows).collect()) == sorted(rows.collect())
