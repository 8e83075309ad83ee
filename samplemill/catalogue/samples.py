"""Queries of sources and of the steps on samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import col, digitize, nest, round_signed, sub_tree
from ..functions.storage import shared_folder
from ..operators.control import ID, INITIAL
from ..operators import attempts as oa
from ..operators import control as oc
from ..operators import samples as so
from ..plans.dataset import Growing, audit, export, from_ids, get_multi, with_final_ids
from ..plans.evaluator import resolve
from ..plans.pipeline import Pipeline, summary
from ..sources import tables as st
from .base import query, rounded, rounded_vector, uniform_sql


@query("SELECT l_orderkey, l_linenumber, p_name AS title, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def read_lookup(read):
    samples = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return st.lookup(samples, read("part"), key="l_partkey", key_column="sample_id", columns=["p_partkey", "p_name", "p_size"], rename={"p_partkey": "sample_id", "p_name": "title"}).drop("l_partkey")


@query('SELECT c_custkey, n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey" FROM customer JOIN nation ON n_nationkey = c_nationkey')
def read_lookup_prefix(read):
    out = st.lookup(read("customer").select("c_custkey", "c_nationkey"), read("nation"), key="c_nationkey", key_column="n_nationkey", columns=["n_nationkey", "n_name", "n_regionkey"], prefix="nation")
    return out.drop("c_nationkey")


@query('SELECT CAST(o_orderkey % 25 AS VARCHAR) || \'@SEP@\' || CAST(o_custkey % 25 AS VARCHAR) AS id, count(*) AS n, max(a.n_name) AS "n_name.0", max(b.n_name) AS "n_name.1" FROM orders JOIN nation a ON a.n_nationkey = o_orderkey % 25 JOIN nation b ON b.n_nationkey = o_custkey % 25 GROUP BY 1')
def read_multi_key(read):
    ids = read("orders").groupBy(F.concat_ws("@SEP@", F.col("o_orderkey") % 25, F.col("o_custkey") % 25).alias("id")).agg(F.count("*").alias("n"))
    return st.lookup_many(ids, read("nation"), ["n_name"], 2, key="id", key_column="n_nationkey")


@query('SELECT d.doc_id, lang AS "docs.lang", CAST(quality AS BIGINT) AS "labels.quality" FROM documents d JOIN labels l ON l.doc_id = d.doc_id')
def eval_dict_sources(read):
    labels = read("labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    docs = read("documents").select("doc_id", "lang").join(labels, "doc_id", "left_semi")
    return resolve({"docs": docs, "labels": labels}, "doc_id")


@query('SELECT d.doc_id, lang AS "docs.lang", CAST(quality AS BIGINT) AS "labels.quality" FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id')
def eval_dict_sources_lenient(read):
    labels = read("labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return resolve({"docs": read("documents").select("doc_id", "lang"), "labels": labels}, "doc_id", strict=False)


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 3 AS BIGINT) AS evaluator_fold FROM orders")
def eval_fold_union(read):
    o = read("orders").select("o_orderkey", "o_totalprice")
    return resolve([o.where(F.col("o_orderkey") % 3 == i) for i in range(3)], "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def eval_restrict_ids(read):
    return resolve(read("customer").select("c_custkey", "c_name"), "c_custkey", read("orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def eval_missing_ids(read):
    return st.missing_ids(read("labels"), read("documents"), "doc_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def eval_duplicate_ids(read):
    return st.duplicates(read("lineitem"), "l_orderkey")


@query("SELECT c_custkey AS k, c_mktsegment, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def outer_merge_recode(read):
    o = read("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"))
    return st.merge_outer(read("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), o, ["k"], required=["c_mktsegment", "top"])


@query('SELECT s_suppkey AS "data.sample_id", s_name AS "data.name" FROM supplier')
def export_keys(read):
    s = read("supplier").select(F.col("s_suppkey").alias("data.sample_id"), F.col("s_name").alias("data.name"), F.col("s_acctbal").alias("data.balance"))
    return export(s, ["data.name"])


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE -1 END AS code FROM customer")
def lookup_recode(read):
    steps = Pipeline.of("recode", so.set_value("code", -1), so.recode("c_mktsegment", "code", {"BUILDING": 1, "MACHINERY": 2}, strict=False), so.keep("c_custkey", "code"))
    return steps(read("customer"))


@query("SELECT vec_id, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1e0 ELSE 0e0 END) AS hot, CAST(label AS BIGINT) AS back FROM embeddings")
def one_hot(read):
    steps = Pipeline.of("hot", so.one_hot("label", "hot", 10), so.copy("hot", "back"), so.from_one_hot("back", 10), so.keep("vec_id", "hot", "back"))
    return steps(read("embeddings"))


@query("SELECT vec_id, list_concat([CAST(vec_id AS DOUBLE)], list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE))) AS joined FROM embeddings")
def concat_vectors(read):
    rows = read("embeddings").select(F.col("vec_id"), F.col("vec_id").cast("double").alias("a"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("b"))
    return Pipeline.of("join", so.concat(["a", "b"], "joined"), so.delete("a", "b"))(rows)


@query("SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN -1e0 ELSE value END, 6) AS value, round((CASE WHEN event_id % 5 = 0 THEN -1e0 ELSE value END - 10) / 4e0, 6) AS z FROM events")
def fill_and_zscore(read):
    rows = read("events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("double")).alias("value"))
    return rounded(Pipeline.of("scale", so.fill_nan("value", -1.0), so.copy("value", "z"), so.zscore("z", 10.0, 4.0))(rows))


@query("SELECT p_partkey, replace(p_name, 'a', 'XY') AS one, regexp_replace(p_name, '[ae]', '_', 'g') AS any, list_transform([p_size, 7, p_partkey % 5], lambda x: CASE WHEN x = 7 THEN 0 ELSE x END) AS v, list_transform([p_size, 7, p_partkey % 5], lambda x: CASE WHEN x IN (1, 2, 7) THEN -1 ELSE x END) AS w FROM part")
def replace_elements(read):
    rows = read("part").select("p_partkey", "p_name", F.array(F.col("p_size").cast("long"), F.lit(7).cast("long"), (F.col("p_partkey") % 5).cast("long")).alias("v"))
    steps = Pipeline.of("swap", so.replace("p_name", "a", "XY", "one"), so.replace_any("p_name", "ae", "_", "any"), so.replace_any("v", [1, 2, 7], -1, "w"), so.replace("v", 7, 0), so.delete("p_name"))
    return steps(rows)


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS price, CAST(l_partkey AS VARCHAR) AS part FROM lineitem")
def cast_types(read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_partkey").alias("part"))
    return Pipeline.of("cast", so.cast("price", "int"), so.cast("part", "str"))(rows)


@query("SELECT r_regionkey, r_name, 5 AS added FROM region")
def set_and_keep(read):
    return Pipeline.of("set", so.set_if_absent("r_name", "x"), so.set_if_absent("added", 5), so.keep("r_regionkey", "r_name", "added"))(read("region"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 3 ELSE o_orderkey END AS k FROM orders")
def cond_apply(read):
    steps = Pipeline.of("cond", so.set_value("flag", 0), oc.when(so.set_value("flag", 1), F.col("o_orderstatus") == "F"), oc.when(so.apply(lambda x: x + 3, ["k"], "k"), F.col("o_orderkey") % 2 == 0), so.keep("o_orderkey", "flag", "k"))
    return steps(read("orders").withColumn("k", F.col("o_orderkey")))


@query("SELECT n_nationkey + 1 AS n_nationkey, n_regionkey + 1 AS n_regionkey, upper(n_name) AS n_name FROM nation")
def apply_patterns(read):
    steps = oc.by_pattern({r".*key$": lambda c: so.apply(lambda x: x + 1, [c], c), r"n_name": lambda c: so.apply(F.upper, [c], c), ".*": None})
    return steps(read("nation").select("n_nationkey", "n_regionkey", "n_name"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'click_' || CAST(CAST(value >= 5 AS INT) + CAST(value >= 20 AS INT) AS VARCHAR) WHEN 'view' THEN 'view_' || CAST(CAST(value >= 1 AS INT) AS VARCHAR) ELSE 'UNK' END AS word, CAST(CAST(value >= 3 AS INT) + CAST(value >= 30 AS INT) AS BIGINT) AS bin FROM events")
def categorise(read):
    out = so.categorise("event_type", "value", "word", {"click": [5, 20], "view": [1]})(read("events"))
    return out.select("event_id", "word", digitize(F.col("value"), F.array(F.lit(3.0), F.lit(30.0))).alias("bin"))


@query("SELECT p_partkey, round(10000e0 * CAST(p_retailprice AS DOUBLE) / (CAST(p_size AS DOUBLE) * p_size), 6) AS bmi, list_transform(range(7), lambda i: CASE WHEN i = CASE WHEN p_size * 3 > 0 AND p_size * 3 < 120 THEN p_size * 3 // 20 ELSE 6 END THEN 1e0 ELSE 0e0 END) AS age, round(CASE WHEN p_size > 0 AND p_size < 40 THEN p_size / 40e0 ELSE -1e0 END, 6) AS scaled FROM part")
def tabular_encoding(read):
    rows = read("part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("w"), (F.col("p_size") * 3).alias("a"))
    steps = Pipeline.of("encode", so.bmi("p_size", "w", "bmi"), so.encode_age("a", "age"), so.scale_checked("p_size", "scaled", 0, 40, 40), so.keep("p_partkey", "bmi", "age", "scaled"))
    return rounded(steps(rows))


@query("SELECT s_suppkey, [CASE WHEN s_nationkey = 3 THEN 1e0 ELSE 0e0 END, CASE WHEN s_nationkey = 7 THEN 1e0 ELSE 0e0 END] AS site, CAST(CASE WHEN s_nationkey % 3 = 0 THEN 2 WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS label, '/data/' || CAST(s_suppkey AS VARCHAR) || '/' || s_name || '.nii' AS path FROM supplier")
def encode_and_compose(read):
    rows = read("supplier").withColumns({"f0": F.lit(0), "f1": (F.col("s_nationkey") % 2 == 0).cast("int"), "f2": (F.col("s_nationkey") % 3 == 0).cast("int")})
    return Pipeline.of("ids", so.encode_category("s_nationkey", "site", [3, 7]), so.label_from_flags(["f0", "f1", "f2"], "label"), so.compose("path", "/data/{}/{}.nii", "s_suppkey", "s_name"), so.keep("s_suppkey", "site", "label", "path"))(rows)


@query("""WITH a AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(least(greatest(x, -0.1e0), 0.1e0), 6)) AS clipped, list_transform(e, lambda x: round((x - list_min(e)) / nullif(list_max(e) - list_min(e), 0), 6)) AS own, list_transform(e, lambda x: round((x + 1e0) * 5e0 + 10e0, 6)) AS ranged FROM a""")
def array_ranges(read):
    e = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double"))
    rows = read("embeddings").select("vec_id", e.alias("clipped"), e.alias("own"), e.alias("ranged"))
    out = Pipeline.of("ranges", so.clip("clipped", -0.1, 0.1), so.normalise_self("own"), so.to_range("ranged", (-1, 1), (10, 20)))(rows)
    short = lambda n: F.transform(n, lambda x: round_signed(x, 6)).alias(n)
    return out.select("vec_id", *map(short, ("clipped", "own", "ranged")))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: least(greatest((CAST(x AS DOUBLE) + 0.5e0) * 1.5e0, 0e0), 1e0)) AS e FROM (SELECT vec_id, list_transform(embedding, lambda y: least(greatest(CAST(y AS DOUBLE) + 0.5e0, 0e0), 1e0) - 0.5e0) AS embedding FROM embeddings)),
g AS (SELECT vec_id, list_transform(e, lambda x: pow(x, 2e0)) AS e FROM a)
SELECT vec_id, list_transform(e, lambda x: round(least(greatest((x - list_avg(e)) * 1.2e0 + list_avg(e), 0e0), 1e0), 6)) AS e FROM g""")
def augment_colour(read):
    rows = read("embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("e"))
    return so.augment_colour("e", add=0.5, mul=1.5, gamma=2.0, contrast=1.2)(rows).select("vec_id", rounded_vector("e"))


@query("""SELECT vec_id, list_transform([2, 3, 4], lambda r: list_transform(embedding[r * 8 + 2 : r * 8 + 5], lambda x: round(CAST(x AS DOUBLE), 6))) AS block, list_transform(list_reverse(embedding[1:8]), lambda x: round(CAST(x AS DOUBLE), 6)) AS flipped, list_concat(list_concat([0e0], list_transform(embedding[57:64], lambda x: round(CAST(x AS DOUBLE), 6))), [0e0, 0e0]) AS padded FROM embeddings""")
def crop_flip_pad(read):
    rows = so.matrix("embedding", "m", 8)(read("embeddings").withColumn("embedding", F.transform("embedding", lambda x: round_signed(x.cast("double"), 6))))
    steps = Pipeline.of("shape", so.copy("m", "block"), so.crop("block", [2, 1], [3, 4]), so.copy("m", "flipped"), so.flip("flipped", 1), so.select_slice("flipped", 0), so.copy("m", "padded"), so.select_slice("padded", 7), so.pad_vector("padded", 1, 2), so.keep("vec_id", "block", "flipped", "padded"))
    return steps(rows)


@query("SELECT 'supplier.' || column_name AS key, CAST(n AS BIGINT) AS rows FROM (SELECT unnest(['s_suppkey', 's_name']) AS column_name), (SELECT count(*) AS n FROM supplier)")
def key_paths(read):
    s = read("supplier").select(F.col("s_suppkey").alias("data.supplier.s_suppkey"), F.col("s_name").alias("data.supplier.s_name"), F.col("s_acctbal").alias("other"))
    return summary(sub_tree(s, "data")).select("key", "rows")


@query("SELECT {'suppkey': s_suppkey, 'name': s_name}.suppkey AS id, s_name AS name FROM supplier")
def nested_samples(read):
    s = nest(read("supplier").select(F.col("s_suppkey").alias("data.suppkey"), F.col("s_name").alias("data.name")))
    return s.select(F.col("data.suppkey").alias("id"), F.col("data.name").alias("name"))


@query("SELECT o_orderkey AS id, CAST(k AS BIGINT) AS at, o_custkey + k AS v FROM orders, (SELECT unnest(range(3)) AS k) WHERE o_custkey % 10 <> 9 AND o_custkey % 10 <> 8 AND o_custkey % 10 <> 7")
def split_and_drop(read):
    rows = read("orders").select(F.col("o_orderkey").alias(oc.ID), F.col("o_orderkey").alias(oc.INITIAL), "o_custkey")
    steps = Pipeline.of("morph", oc.split(3), so.apply(lambda c, k: c + k, ["o_custkey", "data.piece"], "v"), oc.drop_if(F.col("v") % 10 == 9))
    return steps(rows).select(col(oc.INITIAL).alias("id"), col(oc.ID)["at"].cast("long").alias("at"), "v")


@query("SELECT o_orderkey AS id, o_custkey + 1 AS v FROM orders")
def until_op(read):
    steps = Pipeline("chain", [("first", so.apply(lambda x: x + 1, ["v"], "v")), ("second", so.apply(lambda x: x * 100, ["v"], "v"))])
    return steps(read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), until="second")


@query("SELECT o_orderkey AS id, o_custkey AS v, o_custkey + 8 AS w FROM orders")
def reverse_ops(read):
    plus = so.apply(lambda x: x + 8, ["v"], "v")
    steps = Pipeline("undo", [("plus", plus)])
    rows = steps(read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), undo=["plus"]).withColumn("w", F.col("v"))
    return Pipeline.without_undo(steps.reverse(rows, "v"))


@query("SELECT count(*) AS rows, count(*) AS ids, count(*) - (SELECT count(*) FROM part WHERE p_size <= 5) - (SELECT count(*) FROM part WHERE p_size > 5) AS bad FROM part")
def retry_replacement(read):
    rows = read("part").select(F.col("p_partkey").alias("id"), "p_size")
    out = oc.replace_failed(F.col("p_size") > 5, seed=3, key="id")(rows)
    return out.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("p_size") > 5).alias("bad"))


@query(f"SELECT o_orderkey AS id, CASE WHEN {uniform_sql('a', 'o_orderkey')} <= 0.3e0 THEN o_custkey + 1 ELSE o_custkey END AS v, ['x', 'y', 'z'][CAST(floor({uniform_sql('b', 'o_orderkey')} * 3) AS INT) + 1] AS pick FROM orders")
def rand_apply(read):
    rows = read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))
    steps = Pipeline.of("rand", oc.rand_apply(so.apply(lambda x: x + 1, ["v"], "v"), 0.3, "a", key="id"), oc.sample(lambda value: so.set_value("pick", value), "c", key="id", value="w"))
    out = steps(rows)
    return out.withColumn("pick", F.get(F.array(*map(F.lit, "xyz")), F.floor(oc.uniform("b", "id") * 3).cast("int")))


@query(f"SELECT p_partkey AS id, substr(p_name, 1, length(p_name) - CAST(floor(length(p_name) * {uniform_sql('s', 'p_partkey')} * 0.3e0) AS INT)) AS cropped FROM part")
def crop_text(read):
    return oc.crop_text("p_name", "cropped", 0.3, "s", key="id")(read("part").select(F.col("p_partkey").alias("id"), "p_name")).select("id", "cropped")


@query(f"SELECT vec_id AS id, list_transform(range(10), lambda i: CASE WHEN i = least(greatest(CASE WHEN label IN (0) THEN label WHEN {uniform_sql('m', 'vec_id')} < 0.5e0 THEN label - 1 ELSE label + 1 END, 0), 9) THEN 1e0 ELSE 0e0 END) AS hot FROM embeddings")
def augment_one_hot(read):
    rows = so.one_hot("label", "hot", 10)(read("embeddings").select(F.col("vec_id").alias("id"), "label"))
    return oc.augment_one_hot("hot", frozen=[0], seed="m", id_key="id")(rows).select("id", "hot")


D1, D2 = uniform_sql("r/.value/u", "o_orderkey"), [uniform_sql(f"r/{i}/.value/u", "o_orderkey") for i in range(2)]


@query(f"SELECT o_orderkey AS id, round({D1} * 10e0 + 5e0, 6) AS a, round({D1} * 10e0 + 5e0, 6) AS b, round({D2[0]} * 10e0 + 5e0, 6) AS c, round({D2[1]} * 10e0 + 5e0, 6) AS d FROM orders")
def sample_and_repeat(read):
    rows = read("orders").select(F.col("o_orderkey").alias("id"))
    u = oc.Uniform(5, 15)
    shared = oc.sample_and_repeat(_named, [{"name": "a"}, {"name": "b"}], "r", "id", value=u)
    own = oc.repeat_and_sample(_named, [{"name": "c"}, {"name": "d"}], "r", "id", value=u)
    return rounded(Pipeline.of("draws", shared, own)(rows))


def _named(name, value):
    return so.set_value(name, value)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS x, CASE WHEN k = 0 THEN 'stored' ELSE 'fresh' END AS side FROM nation, (SELECT unnest(range(2)) AS k) WHERE n_nationkey % 5 = 0 AND k = 0 UNION ALL SELECT n_nationkey, n_name, 1, 'fresh' FROM nation WHERE n_nationkey % 5 = 0")
def audit_diff(read):
    rows = read("nation").select("n_nationkey", "n_name")
    stored = rows.withColumn("x", F.when(F.col("n_nationkey") % 5 == 0, 2).otherwise(1))
    return audit(stored, Pipeline.of("same", so.set_value("x", 1)), rows, 1.0, key="n_nationkey").select("n_nationkey", "n_name", "x", "side")


@query("SELECT i, p_partkey, p_name FROM (SELECT unnest(range(200)) AS i) JOIN part ON p_partkey = (i * 37) % (SELECT count(*) FROM part)")
def get_multi_ordered(read):
    parts = read("part").select("p_partkey", "p_name", "p_size")
    n = parts.count()
    items = parts.sparkSession.range(200).select(F.col("id").alias("i"), ((F.col("id") * 37) % n).alias("item"))
    return get_multi(parts, items, ["p_name"], key="p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def final_ids(read):
    good = read("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return with_final_ids(read("orders"), good, key="o_custkey").select("o_orderkey", "o_custkey")


# -- key slices, failures as values, growing datasets ------------------------------------------


def sliced_steps() -> Pipeline:
    """Steps of which the wanted keys need some; one would stop any query that ran it."""
    stop = so.apply(lambda x: F.raise_error(F.lit("this step is not wanted")).cast("double"), ["b"], "stopped")
    return Pipeline.of("sliced", so.matrix("embedding", "m", 8), so.transpose("m"), stop, so.normalise_self("embedding", 2.0), so.copy("embedding", "n"), so.set_value("flag", 1), so.delete("b"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) - list_min(embedding)) * 2 / (CAST(list_max(embedding) AS DOUBLE) - list_min(embedding)), 6) + 0e0) AS n FROM embeddings")
def key_slice(read):
    rows = read("embeddings").withColumn("b", F.lit(1.0))
    return sliced_steps().only(rows, ["vec_id", "n"]).select("vec_id", rounded_vector("n"))


def brand_number(brand: str) -> int:
    n = int(brand.split("#")[1])
    if n > 20:
        raise ValueError(f"{n} is too large")
    return n


def failing_steps() -> Pipeline:
    """A Python step that fails for some brands, then a checked one that fails for sizes under 5."""
    ratio = oa.checked(so.apply(lambda n, s: n / s, ["number", "p_size"], "ratio"), F.col("p_size") < 5, F.lit("small"), "p_partkey")
    return Pipeline("part", [("number", oa.python_step(brand_number, ["p_brand"], "number", "long", "p_partkey")), ("ratio", ratio)])


FAILED = """WITH p AS (SELECT p_partkey, p_size, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS b FROM part)"""


@query(f"""{FAILED} SELECT p_partkey, CASE WHEN b <= 20 THEN b END AS number, CASE WHEN b <= 20 AND p_size >= 5 THEN round(b / CAST(p_size AS DOUBLE), 6) END AS ratio, CASE WHEN b > 20 THEN 'part.number' WHEN p_size < 5 THEN 'part.ratio' END AS step,
CASE WHEN b > 20 OR p_size < 5 THEN CAST(p_partkey AS VARCHAR) END AS sample, CASE WHEN b > 20 THEN 'ValueError: ' || b || ' is too large' WHEN p_size < 5 THEN 'small' END AS message FROM p""")
def step_failures(read):
    out = oa.settle(failing_steps()(read("part").select("p_partkey", "p_brand", "p_size")), "keep")
    e = col(oa.ERROR)
    return rounded(out.select("p_partkey", "number", "ratio", e["step"].alias("step"), e["sample"].alias("sample"), e["message"].alias("message")))


@query(f"{FAILED} SELECT p_partkey, CASE WHEN b > 20 OR p_size < 5 THEN -1e0 ELSE round(b / CAST(p_size AS DOUBLE), 6) END AS ratio FROM p")
def step_failures_replaced(read):
    out = oa.settle(failing_steps()(read("part").select("p_partkey", "p_brand", "p_size")), "replace", {"ratio": -1.0})
    return rounded(out.select("p_partkey", "ratio"))


@query("SELECT CAST(k AS INTEGER) AS part, CAST(count(*) AS BIGINT) AS ids, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS checked, CAST(0 AS BIGINT) AS differing FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 1 END AS k FROM orders) GROUP BY k")
def growing_dataset(read):
    """Two additions of overlapping samples to a dataset whose pipeline drops a third of them and splits the others in two."""
    table = read("orders")
    orders = from_ids(table, "o_orderkey").join(table.select(col("o_orderkey").alias(ID), col("o_custkey").alias("customer")), ID)
    steps = Pipeline.of("orders", oc.drop_if(col(ID) % 3 == 0, siblings=False), oc.split(2))
    store = Growing(orders.sparkSession, f"{shared_folder(orders.sparkSession)}/orders-{uuid.uuid4().hex}")
    store.add(steps, orders.where("customer % 4 = 0"))
    store.add(steps, orders)
    sizes = orders.sparkSession.createDataFrame([(m["part"], m["ids"], m["rows"]) for m in store.parts()], "part int, ids long, rows long")
    return sizes.join(store.audit(steps, orders).drop("folder"), "part")
