"""Readers, writers, reports, folds and small texts that no query reaches."""

import math

import pytest
from pyspark.sql import functions as F
from samplemill.functions.columns import tree_text
from samplemill.metrics import classification as mc
from samplemill.metrics import masks as mm
from samplemill.operators import events as ev
from samplemill.operators import samples as so
from samplemill.operators.control import ID
from samplemill.plans.crossval import cross_validate, group_folds
from samplemill.plans.dataset import from_count
from samplemill.plans.evaluator import markdown, report
from samplemill.sources import tables as st


def test_sources_by_their_kind(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind in ("csv", "tsv", "json", "orc", "parquet"):
        if kind != "tsv":
            st.write_table(rows, f"{tmp_path}/t.{kind}")
            assert sorted(tuple(r) for r in st.autodetect(spark, f"{tmp_path}/t.{kind}").select("k", "v").collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "ids.txt").write_text(" one \ntwo\n")
    assert [r.sample_desc for r in st.autodetect(spark, str(tmp_path / "ids.txt")).collect()] == ["one", "two"]
    assert [r.sample_desc for r in st.autodetect(spark, [3, 5]).collect()] == [3, 5] and st.autodetect(spark, []).count() == 0 and st.autodetect(spark, rows) is rows
    with pytest.raises(ValueError, match="no reader"):
        st.read_table(spark, "x.unknown")
    (tmp_path / "set").mkdir()
    for name in ("p1", "p2"):
        (tmp_path / "set" / f"{name}.txt").write_text("t,x\n1,2\n3,4\n")
    assert sorted(tuple(r) for r in st.read_folder(spark, str(tmp_path / "set")).select("sample_id", "t").collect()) == [("p1", 1), ("p1", 3), ("p2", 1), ("p2", 3)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("auc", "auc", 0.5), ("_hidden", "x", 1.0)], "metric string, name string, value double")
    report(rows, str(tmp_path / "out"))
    assert [r.metric for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["auc"]
    assert markdown([{"a": 1, "b": "x"}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 | x |"
    frame = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `a.c` int, d int")
    assert tree_text(frame) == "a\n---b\n---c\nd"
    assert [r[ID] for r in from_count(spark, 3).collect()] == [0, 1, 2]


def test_temperature_of_the_least_loss(spark):
    rows = spark.createDataFrame([([2.0 * t, 0.0], 0 if i < 8 else 1) for t in (1, 2) for i in range(10)], "logits array<double>, target int")
    best = mc.find_temperature(rows, "logits", "target")
    loss = lambda t: sum(-math.log(1 / (1 + math.exp(-2 * s / t))) * 8 - math.log(1 / (1 + math.exp(2 * s / t))) * 2 for s in (1, 2))
    assert loss(best) <= min(loss(best * 0.99), loss(best * 1.01)) + 1e-9


def test_groups_stay_in_one_fold(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 7 != 0, (F.col("id") % 23).cast("string")).alias("g"))
    got = group_folds(rows, "g", 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add(r.fold)
    assert len(got) == 400 and all(len(f) == 1 for f in by.values()) and {f for s in by.values() for f in s} == set(range(5)) and None in by


def test_models_do_not_see_their_fold(spark):
    rows = group_folds(spark.range(60).select("id", (F.col("id") % 12).alias("g")), "g", 3)

    def fit(train):
        folds = [r.fold for r in train.select("fold").distinct().collect()]
        return lambda df: df.withColumn("prediction", F.lit(float(sum(folds))))

    held, test = cross_validate(rows, 3, fit, spark.range(2))
    assert {(r.fold, r.prediction) for r in held.collect()} == {(0, 3.0), (1, 2.0), (2, 1.0)} and held.count() == 60
    assert [r.prediction for r in test.collect()] == [2.0, 2.0]
    assert cross_validate(rows, 3, fit)[1] is None


def test_vectors_by_percentiles_and_places(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 2.0, 100.0], 50.0), ([3.0, 3.0], 0.0), (None, 1.0), ([], 1.0)], "v array<double>, top double")
    own = [r.v for r in so.normalise_percentile("v", (0.0, 10.0), 0, 50)(rows).collect()]
    assert own[0] == pytest.approx([0, 10 / 1.5, 10, 10]) and own[1] is None and own[2] is None
    top = [r.v for r in so.normalise_percentile("v", (0.0, 10.0), 0, 50, "top")(rows).collect()]
    assert top[0] == pytest.approx([0, 0.2, 0.3, 0.3]) and top[1] is None
    vectors = spark.createDataFrame([(["a", "|", "b", "|", "|", None],), (None,), ([],), (["|"],)], "x array<string>")
    assert [r.p for r in vectors.select(ev.positions(F.col("x"), "|").alias("p")).collect()] == [[0, 0, 1, 1, 2, 3], None, [], [0]]


def test_masks_of_images_without_a_partner(spark):
    preds = spark.createDataFrame([(1, [1, 1, 0, 0]), (3, [1, 0, 0, 0])], "image int, mask array<int>")
    targets = spark.createDataFrame([(1, 7, [1, 1, 1, 0], False), (1, 8, [1, 1, 1, 1], True), (2, 9, [1, 0, 0, 0], False)], "image int, target_id int, mask array<int>, crowd boolean")
    assert sorted((r.image, r.target_id, round(r.iou, 4)) for r in mm.mask_matches(preds, targets).collect()) == [(1, 7, 0.6667), (1, 8, 1.0), (2, 9, 0.0)]
    got = mm.detection(preds, targets, 0.5, matches=mm.mask_matches).first()
    assert (round(got.mean_iou, 4), got.precision, got.recall) == (0.8333, 1.0, 0.5)


def test_hot_keys_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(st, "HOT_KEYS", 5)
    many = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 40)).alias("token"))
    one = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i + 10) for i in range(0, 40, 2)], "token string, n int")
    want = sorted(((r.id, r.token, r.n) for r in many.join(one, "token", "left").collect()), key=str)
    for limit in (1000, 3):
        assert sorted(((r.id, r.token, r.n) for r in st.look_up_in(many, one, ["token"], limit).collect()), key=str) == want
    assert st.look_up_in(many, one.where("n > 1"), ["token"], 3).where("token = 'hot' and n is null").count() == 100
