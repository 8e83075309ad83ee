"""Key slices, failures as values and growing datasets on small tables."""

import json

import pytest
from pyspark.sql import functions as F
from samplemill.functions.columns import KeyPathError, col
from samplemill.operators import attempts as at
from samplemill.operators import control as oc
from samplemill.operators import samples as so
from samplemill.operators.control import ID, INITIAL
from samplemill.plans.dataset import Growing
from samplemill.plans.pipeline import Pipeline


def names(pipeline, keys, until=None):
    part, inputs = pipeline.slice(keys, until)
    return [i.split(".")[1] for i, _ in part.steps], inputs


def test_slices_keep_what_the_wanted_keys_need(spark):
    steps = Pipeline.of("p", so.copy("a", "b"), so.copy("b", "c.x"), so.set_value("d", 1), so.clip("e"), so.concat(["c.x", "d"], "f"), so.delete("a"))
    assert names(steps, ["f"]) == (["0", "1", "2", "4"], ["a"])
    assert names(steps, ["c"]) == (["0", "1"], ["a", "c"])
    assert names(steps, ["e"]) == (["3"], ["e"]) and names(steps, ["d"]) == (["2"], []) and names(steps, ["z"]) == ([], ["z"])
    assert names(steps, ["f"], "p.2") == ([], ["f"])
    with pytest.raises(KeyPathError, match="p.5 takes away"):
        steps.slice(["a"])
    any_column = Pipeline.of("q", so.copy("a", "b"), so.set_value("c", F.col("b") + 1), so.set_value("d", 1))
    assert names(any_column, ["c"]) == (["0", "1"], None) and names(any_column, ["d"]) == (["2"], [])
    barrier = Pipeline.of("r", so.set_value("c", 1), oc.drop_if(F.col("x") > 1), so.set_value("d", 1))
    assert names(barrier, ["x"]) == (["0", "1"], None)


def test_a_key_that_no_step_makes(spark):
    with pytest.raises(KeyPathError, match="does not make"):
        Pipeline.of("p", so.copy("a", "b")).only(spark.range(1).select(F.lit(1).alias("a")), ["c"])


def failing(spark):
    def half(x):
        if x % 2:
            raise ValueError("odd")
        return x // 2

    rows = spark.range(6).select("id", F.col("id").alias("x"))
    return Pipeline("p", [("half", at.python_step(half, ["x"], "h", "long", "id")), ("again", at.python_step(half, ["h"], "q", "long", "id")), ("safe", at.checked(so.apply(lambda q: F.when(q == 0, F.raise_error("zero").cast("long")).otherwise(q), ["q"], "q"), F.col("q") == 0, F.lit("zero"), "id"))])(rows)


def test_failures_name_step_and_sample(spark):
    rows = {r.id: r for r in at.settle(failing(spark), "keep").collect()}
    said = {i: (r[at.ERROR].step, r[at.ERROR].sample, r[at.ERROR].message) if r[at.ERROR] else None for i, r in rows.items()}
    assert said == {0: ("p.safe", "0", "zero"), 1: ("p.half", "1", "ValueError: odd"), 2: ("p.again", "2", "ValueError: odd"), 3: ("p.half", "3", "ValueError: odd"), 4: None, 5: ("p.half", "5", "ValueError: odd")}
    assert rows[4].q == 1 and rows[0].q == 0 and rows[1].h is None and rows[2].h == 1


def test_policies(spark):
    out = failing(spark)
    assert [(r.id, r.q) for r in at.settle(out, "drop").collect()] == [(4, 1)]
    assert {r.id: r.q for r in at.settle(out, "replace", {"q": -1}).collect()} == {i: 1 if i == 4 else -1 for i in range(6)}
    with pytest.raises(Exception, match=r"step p\.\w+, sample \d: "):
        at.settle(out).collect()
    with pytest.raises(ValueError, match="no policy"):
        at.settle(out, "ignore")
    plain = spark.range(2)
    assert at.settle(plain).count() == 2


def ids(spark, *values):
    return spark.createDataFrame([(v, v) for v in values], f"`{ID}` long, `{INITIAL}` long")


def test_growing_adds_new_ids_only(spark, tmp_path):
    steps, own = Pipeline.of("g", so.set_value("v", 1), oc.split(2)), str(tmp_path / "own")
    store = Growing(spark, own)
    with pytest.raises(ValueError, match="nothing is stored"):
        store.read()
    assert (store.add(steps, ids(spark, 1, 2))["ids"], store.add(steps, ids(spark, 2, 3, 4))["rows"]) == (2, 4)
    assert store.add(steps, ids(spark, 1, 4)) is None
    assert sorted(r[0] for r in store.read().select(col(INITIAL)).collect()) == [1, 1, 2, 2, 3, 3, 4, 4]
    with pytest.raises(ValueError, match="another pipeline"):
        store.add(Pipeline.of("g", so.set_value("v", 2), oc.split(2)), ids(spark, 9))
    # a part that was not finished does not count, and its number is used again
    store.read(part=0).write.parquet(f"{own}/data/part=2")
    assert store.read().count() == 8 and store.add(steps, ids(spark, 7))["part"] == 2 and store.read().count() == 10
    other = Growing(spark, str(tmp_path / "next"), own)
    assert other.add(steps, ids(spark, 1, 8))["ids"] == 1 and other.read().count() == 12 and [m["part"] for m in other.parts()] == [0, 0, 1, 2]
    with pytest.raises(Exception, match="a sample has no id"):
        other.add(steps, ids(spark, None))


def test_an_audit_finds_a_changed_part(spark, tmp_path):
    steps, own = Pipeline.of("g", so.copy(INITIAL, "v")), str(tmp_path / "own")
    store = Growing(spark, own)
    store.add(steps, ids(spark, 1, 2))
    store.add(steps, ids(spark, 3, 4, 5))
    audit = lambda: {r.part: (r.checked, r.differing) for r in store.audit(steps, ids(spark, 1, 2, 3, 4, 5)).collect()}
    assert audit() == {0: (2, 0), 1: (3, 0)}
    changed = store.read(part=1).withColumn("v", F.when(col(ID) == 4, 0).otherwise(col("v")))
    rows = spark.createDataFrame(changed.collect(), changed.schema)
    rows.write.mode("overwrite").parquet(f"{own}/data/part=1")
    assert audit() == {0: (2, 0), 1: (3, 2)}
    assert json.loads(spark.read.text(f"{own}/manifests/part=1").first()[0])["columns"][0].startswith(ID)
