"""Queries of folds, samplers, batches and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.running import numbered
from ..operators import batches as ob
from ..operators import splits as sp
from ..plans.dataset import chunk_ranges, subset
from .base import query, uniform_sql

ARRAY_SPLIT = "CASE WHEN rn < (n % 5) * (n // 5 + 1) THEN rn // (n // 5 + 1) ELSE n % 5 + (rn - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END"
FOLDS = f"""WITH k AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kind, {uniform_sql('1357', 'o_custkey')} AS u FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY u, o_custkey) - 1 AS rn, count(*) OVER (PARTITION BY kind) AS n FROM k), f AS (SELECT o_custkey, CAST({ARRAY_SPLIT} AS BIGINT) AS fold FROM r)"""


@query(f"{FOLDS} SELECT o_orderkey, o_custkey, fold FROM orders JOIN f USING (o_custkey)")
def balanced_folds(read):
    return sp.balanced_folds(read("orders"), "o_custkey", ["o_orderstatus"], 5).select("o_orderkey", "o_custkey", "fold")


@query(f"{FOLDS} SELECT fold, o_orderstatus, count(*) AS n FROM orders JOIN f USING (o_custkey) GROUP BY 1, 2")
def fold_stats(read):
    return sp.fold_counts(sp.balanced_folds(read("orders"), "o_custkey", ["o_orderstatus"], 5), "o_orderstatus")


@query(f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {uniform_sql('1234', 'c_custkey')}, c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer) SELECT c_custkey, CAST({ARRAY_SPLIT} AS BIGINT) AS fold FROM r")
def kfold(read):
    return sp.kfold(read("customer").select("c_custkey"), "c_custkey", 5).select("c_custkey", "fold")


SHARES = "CASE label % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END"


@query(f"""WITH z AS (SELECT label, count(*) AS n, {SHARES} AS s FROM embeddings GROUP BY label), b AS (SELECT max(CAST(ceil(n / CAST(s AS DOUBLE)) AS BIGINT)) AS b FROM z),
e AS (SELECT label, n, s, b.b AS b, unnest(range(CAST(ceil(b.b * s / CAST(n AS DOUBLE)) AS BIGINT))) AS epoch FROM z, b),
o AS (SELECT vec_id, e.*, epoch * n + row_number() OVER (PARTITION BY e.label, epoch ORDER BY {uniform_sql('5', 'epoch', 'vec_id')}, vec_id) - 1 AS pos FROM embeddings v JOIN e ON e.label = v.label)
SELECT pos // s AS batch, pos % s AS slot, vec_id, CAST(label AS BIGINT) AS label FROM o WHERE pos // s < b""")
def batch_exact(read):
    rows = read("embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return sp.balanced_batches(rows, "vec_id", "label", {k: 4 - k % 3 for k in range(10)}, seed=5)


CLASS = " ".join(f"WHEN u < {sum(1 + j % 2 for j in range(k + 1))}e0 / 15e0 THEN {k}" for k in range(9))


@query(f"""WITH i AS (SELECT unnest(range(4000)) AS id), c AS (SELECT id, CASE {CLASS} ELSE 9 END AS label FROM (SELECT id, {uniform_sql('0/class', 'id')} AS u FROM i)),
t AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS turn FROM c),
o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql('0', 'vec_id')}, vec_id) - 1 AS turn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT id // 40 AS batch, id % 40 AS slot, vec_id, CAST(t.label AS BIGINT) AS label FROM t JOIN o ON o.label = t.label AND o.turn = t.turn % o.n""")
def batch_approx(read):
    rows = read("embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return sp.drawn_batches(rows, "vec_id", "label", {k: 1.0 + k % 2 for k in range(10)}, 40, 100)


@query("SELECT l_orderkey AS b, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l_partkey, list(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY 1")
def collate(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("b"), "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"))
    return ob.collate("b", "l_linenumber", ["l_partkey", "q"])(rows)


@query("SELECT l_orderkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place, l_partkey FROM lineitem")
def uncollate(read):
    rows = ob.collate("b", "l_linenumber", ["l_partkey"])(read("lineitem").select(F.col("l_orderkey").alias("b"), "l_linenumber", "l_partkey"))
    return ob.uncollate(["l_partkey"])(rows)


@query("""WITH l AS (SELECT l_orderkey AS o, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1), b AS (SELECT o // 8 AS b, max(len(v)) AS m FROM l GROUP BY 1)
SELECT CAST(b AS BIGINT) AS b, list(list_concat(v, list_transform(range(m - len(v)), lambda i: 0)) ORDER BY o) AS v FROM l JOIN b ON b.b = l.o // 8 GROUP BY 1""")
def pad_batch(read):
    rows = ob.collate("o", "l_linenumber", ["v"])(read("lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", F.col("l_partkey").cast("long").alias("v")))
    rows = rows.withColumn("b", F.floor(F.col("o") / 8).cast("long"))
    padded = ob.pad_batch("v", fill=0)(ob.collate("b", "o", ["v"])(rows))
    return padded.select("b", F.transform("v", lambda x: F.transform(x, lambda y: y.cast("long"))).alias("v"))


@query("SELECT l_orderkey // 8 AS b, max(n) AS n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def crop_padding(read):
    rows = ob.collate("o", "l_linenumber", ["v"])(read("lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", (F.col("l_partkey") + 1).cast("long").alias("v")))
    rows = rows.withColumns({"b": F.floor(F.col("o") / 8).cast("long"), "v": F.concat("v", F.array_repeat(F.lit(0).cast("long"), 12))})
    # cropping takes padded vectors of one length
    cropped = ob.crop_padding("v", fill=0)(ob.pad_batch("v", fill=0)(ob.collate("b", "o", ["v"])(rows)))
    return cropped.select("b", F.size(F.get("v", F.lit(0))).cast("long").alias("n"))


@query("SELECT i, n_name FROM (SELECT 0 AS i, 3 AS pos UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 3) p JOIN nation ON n_nationkey = pos")
def subset_positions(read):
    n = read("nation").select(F.col("n_nationkey").alias("data.place"), "n_name")
    places = n.sparkSession.createDataFrame([(0, 3), (1, 1), (2, 3)], "i long, at long")
    return subset(n, places).select("i", "n_name")


@query("SELECT CAST(k * 40 AS BIGINT) AS start, CAST(least(k * 40 + 40, n) AS BIGINT) AS end, rows FROM (SELECT unnest(range(CAST(ceil(n / 40e0) AS BIGINT))) AS k, n FROM (SELECT count(*) AS n FROM part)) JOIN (SELECT c, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 40 AS c FROM part) GROUP BY c) ON c = k")
def chunks(read):
    parts = read("part")
    ranges = chunk_ranges(parts.sparkSession, parts.count(), 40)
    rows = numbered(parts, "p_partkey").groupBy((F.floor(F.col("place") / 40) * 40).cast("long").alias("start")).agg(F.count("*").alias("rows"))
    return ranges.join(rows, "start")
