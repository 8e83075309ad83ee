"""Queries of event logs and token texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import digitize
from ..operators import events as ev
from ..operators import tokens as tk
from ..operators import tries as tr
from .base import query, rounded, uniform_sql


def daily(read):
    return read("events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "event_type", F.col("value").cast("double").alias("value"))


D = "WITH v AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, event_type, CAST(value AS DOUBLE) AS value FROM events)"


@query(f"{D} SELECT event_id FROM v WHERE NOT (event_type = 'click' AND value < 5) AND NOT (event_type = 'view' AND value < 2)")
def drop_bad_records(read):
    return ev.clean(daily(read), "event_type", "value", {"click": 5, "view": 2}).select("event_id")


@query(f"{D} SELECT event_id FROM v WHERE user_id IN (SELECT user_id FROM v GROUP BY user_id HAVING max(hour) >= 20 AND count(DISTINCT day) >= 5)")
def drop_bad_users(read):
    return ev.cohort(daily(read), "user_id", F.col("hour"), F.col("day"), 20, 5).select("event_id")


@query(f"{D} SELECT user_id, count(*) AS n, round(max(value), 6) AS top, min(day) AS first FROM v GROUP BY user_id")
def combine_by_user(read):
    rows = ev.combine(daily(read), "user_id", {"top": F.max("value"), "n": F.count("*")}, "day", ["event_id", "event_type"])
    return rounded(rows.select("user_id", F.size("visits").cast("long").alias("n"), F.element_at("details", "top").alias("top"), F.get("visits", F.lit(0))["time"].alias("first")))


@query(f"{D} SELECT event_type AS parameter, list_transform(quantile_cont(value, [0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]), lambda x: round(x, 6)) AS edges FROM v GROUP BY 1")
def percentile_bins(read):
    return ev.bin_edges(daily(read), "event_type", "value", 4, 3).select("parameter", F.transform("edges", lambda x: F.round(x, 6)).alias("edges"))


@query(f"{D}, p AS (SELECT event_type, quantile_cont(value, [0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS e FROM v GROUP BY 1) SELECT event_id, event_type || '_' || CAST(len(list_filter(e, lambda x: x <= value)) AS VARCHAR) AS word FROM v JOIN p USING (event_type)")
def digitise_events(read):
    rows = daily(read)
    return ev.binned(rows, ev.bin_edges(rows, "event_type", "value", 4, 3), "event_type", "value", "word").select("event_id", "word")


@query(f"{D} SELECT user_id, day, string_agg(event_type, ' ' ORDER BY event_id) || ' SEP' AS sentence FROM v GROUP BY 1, 2")
def visit_sentences(read):
    return ev.sentences(daily(read), "user_id", "day", "event_type", "event_id").select("user_id", "day", F.array_join("tokens", " ").alias("sentence"))


W = "w AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM w WHERE token NOT IN ('', 'PAD', 'UNK') GROUP BY 1 HAVING count(*) >= 2), o AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM n UNION ALL SELECT 'PAD', 0 UNION ALL SELECT 'UNK', 1)"


def words(read):
    w = read("documents").select(F.explode(F.split("text", " ")).alias("token")).where("token != ''")
    return ev.vocabulary(w, "token", ["PAD", "UNK"], least=2)


@query(f"WITH {W} SELECT token, CAST(id AS BIGINT) AS id FROM o")
def vocabulary(read):
    return words(read)


@query(f"WITH {W}, t AS (SELECT conv_id, turn, string_split(text, ' ') AS ts FROM conversations), x AS (SELECT conv_id, turn, unnest(range(len(ts))) AS i, ts FROM t), y AS (SELECT conv_id, turn, list(coalesce(id, 1) ORDER BY i) AS ids FROM x LEFT JOIN o ON o.token = ts[i + 1] GROUP BY 1, 2) SELECT conv_id, turn, list_transform(range(16), lambda i: CAST(coalesce(ids[i + 1], 0) AS BIGINT)) AS ids FROM y")
def seq_translate_pad(read):
    rows = read("conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("k"), F.split("text", " ").alias("tokens"))
    out = ev.translate(rows, "k", "tokens", words(read), "ids", 1)
    return out.select("conv_id", "turn", ev.fit(F.col("ids"), 16, 0).alias("ids"))


@query(f"{D}, s AS (SELECT user_id, event_id, event_type, day FROM v), p AS (SELECT user_id, list(CAST(k AS BIGINT) ORDER BY event_id) AS places FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM s) GROUP BY 1) SELECT user_id, places FROM p")
def position_index(read):
    seq = daily(read).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("x"))
    return seq.select("user_id", ev.positions(F.col("x"), "purchase").alias("places"))


TRAJ = f"""{D}, g AS (SELECT user_id, day, list(event_type ORDER BY event_id) AS t FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k, len(t) + 1 AS n FROM g),
q AS (SELECT *, 1 + sum(CASE WHEN k > 1 THEN n ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS s FROM r)"""


@query(f"{TRAJ} SELECT user_id, rtrim('CLS ' || coalesce(string_agg(CASE WHEN k > 1 AND s < 24 THEN array_to_string(t, ' ') || ' SEP' END, ' ' ORDER BY day), '')) AS trajectory, max(CASE WHEN k = 1 THEN array_to_string(t, ' ') || ' SEP' END) AS next FROM q GROUP BY user_id")
def trajectory(read):
    out = ev.trajectory(ev.sentences(daily(read), "user_id", "day", "event_type", "event_id"), "user_id", "day", "tokens", 24)
    return out.select("user_id", F.array_join("trajectory", " ").alias("trajectory"), F.array_join("next", " ").alias("next"))


@query(f"{TRAJ} SELECT user_id, [CASE WHEN list_contains(t, 'click') THEN 1e0 ELSE 0e0 END, CASE WHEN list_contains(t, 'view') THEN 1e0 ELSE 0e0 END] AS hot FROM q WHERE k = 1")
def next_visit_multi_hot(read):
    out = ev.trajectory(ev.sentences(daily(read), "user_id", "day", "event_type", "event_id"), "user_id", "day", "tokens", 24)
    return out.select("user_id", ev.multi_hot(F.col("next"), ["click", "view"]).alias("hot"))


def hinted():
    return F.concat(F.lit("<@TOKENIZER-TYPE=TYPE@MAX-LEN=1>"), F.col("event_type"), F.lit("<@TOKENIZER-TYPE=WORD@MAX-LEN=3@TRUNC-MODE=RIGHT>"), F.lit("a <B> "), F.col("user_id").cast("string"), F.lit(" d"), F.lit("<@TOKENIZER-TYPE=SCALARS_LITERALS>1.5,2"))


@query("SELECT event_id, kind, max_len, trunc_mode, text FROM (SELECT event_id, 'TYPE' AS kind, 1 AS max_len, NULL AS trunc_mode, event_type AS text FROM events UNION ALL SELECT event_id, 'WORD', 3, 'RIGHT', 'a <B> ' || CAST(user_id AS VARCHAR) || ' d' FROM events UNION ALL SELECT event_id, 'SCALARS_LITERALS', NULL, NULL, '1.5,2' FROM events)")
def parse_typed_segments(read):
    return read("events").select("event_id", F.inline(tk.parse(hinted())))


@query("""WITH k AS (SELECT event_id, [CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 1 END, 10, 11, 1] AS ids FROM events)
SELECT event_id, list_transform(range(6), lambda i: CAST(coalesce(ids[i + 1], 0) AS BIGINT)) AS ids, [true, true, true, true, false, false] AS attention_mask, CAST(len(list_filter(ids, lambda x: x = 1)) AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS overflow FROM k""")
def encode_segments(read):
    rows = read("events").select("event_id", F.slice(tk.parse(hinted()), 1, 2).alias("s"))
    vocab = rows.sparkSession.createDataFrame([("TYPE", "click", 2), ("TYPE", "view", 3), ("WORD", "a", 10), ("WORD", "<B>", 11), ("WORD", "d", 12)], "kind string, token string, id long")
    return tk.encode(rows, "event_id", "s", vocab, 6, 0, 1).drop("s")


@query("SELECT event_id, [-1000e0, -1000e0, -1000e0, -1000e0, -1000e0, 1.5e0, 2e0] AS scalars FROM events")
def inject_scalars(read):
    return read("events").select("event_id", tk.scalars(tk.parse(hinted())).alias("scalars"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'click' ELSE '<@TOKEN_MISSING-9>' END || 'b' AS text FROM events")
def decode_ids(read):
    rows = read("events").select("event_id", F.array(F.when(F.col("event_type") == "click", 1).otherwise(9).cast("long"), F.lit(2).cast("long")).alias("ids"))
    vocab = rows.sparkSession.createDataFrame([("click", 1), ("b", 2)], "token string, id long")
    return tk.decode(rows, "event_id", "ids", vocab, "text").select("event_id", "text")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_property(read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"{D} SELECT event_id, CAST(CAST(hour >= 6 AS INT) + CAST(hour >= 12 AS INT) + CAST(hour >= 18 AS INT) AS BIGINT) AS part FROM v")
def hour_bins(read):
    return daily(read).select("event_id", digitize(F.col("hour"), F.array(F.lit(6), F.lit(12), F.lit(18))).alias("part"))


# -- sub-tokenizers and injected values ------------------------------------------------------

SPECIAL = ["<PAD>", "<UNK>", "<SCALAR>", "<EMBEDDINGS>"]
VOCABULARIES = f"""WITH RECURSIVE n0 AS (SELECT unnest([substr(p_name, 1, 3), substr(p_name, 4, 1), substr(p_name, 5, 2), 'e', ' ', substr(p_name, 1, 2)]) AS token FROM part), n AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS id FROM n0 WHERE token <> '' GROUP BY token),
b0 AS (SELECT unnest([substr(p_brand, 1, 6), substr(p_brand, 7, 1), '1', '2']) AS token FROM part), b AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 + (SELECT count(*) FROM n) AS id FROM b0 WHERE token <> '' GROUP BY token),
v AS (SELECT 'NAME' AS kind, token, id FROM n UNION ALL SELECT 'BRAND', token, id FROM b UNION ALL SELECT k, {SPECIAL}[i + 1], i FROM (SELECT unnest(['NAME', 'BRAND']) AS k), (SELECT unnest(range(4)) AS i)),
g AS (SELECT p_partkey, 0 AS s, 'NAME' AS kind, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, 'BRAND', p_brand FROM part),
w AS (SELECT p_partkey, s, kind, text, CAST(1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS was, CAST(NULL AS BIGINT) AS id FROM g UNION ALL SELECT w.p_partkey, w.s, w.kind, w.text, w.pos + coalesce(max(len(token)), 1), w.pos, coalesce(arg_max(v.id, len(token)), 1) FROM w LEFT JOIN v ON v.kind = w.kind AND starts_with(substr(w.text, w.pos), v.token) WHERE w.pos <= len(w.text) GROUP BY w.p_partkey, w.s, w.kind, w.text, w.pos),
t AS (SELECT p_partkey, s, list(id ORDER BY was) AS ids FROM w WHERE was IS NOT NULL GROUP BY 1, 2)"""


def part_vocabularies(read):
    """(kind, token, id): pieces of names and of brands, in one space of ids behind the shared special tokens."""
    piece = lambda c, *at: F.substring(c, *at)
    n = read("part").select(F.explode(F.array(piece("p_name", 1, 3), piece("p_name", 4, 1), piece("p_name", 5, 2), F.lit("e"), F.lit(" "), piece("p_name", 1, 2))).alias("token"))
    b = read("part").select(F.explode(F.array(piece("p_brand", 1, 6), piece("p_brand", 7, 1), F.lit("1"), F.lit("2"))).alias("token"))
    own = lambda df: ev.vocabulary(df.where("token != ''"), "token")
    return tk.merged_vocabulary({"NAME": own(n), "BRAND": own(b)}, SPECIAL)


@query(f"{VOCABULARIES} SELECT kind, token, CAST(id AS BIGINT) AS id FROM v")
def merged_vocabulary(read):
    return part_vocabularies(read)


@query(f"""{VOCABULARIES}, c AS (SELECT p_partkey, ids[1:5] AS a, len(ids) AS n FROM t WHERE s = 0), r AS (SELECT p_partkey, a || ids AS ids, n, len(a) AS na, len(ids) AS nb FROM c JOIN t USING (p_partkey) WHERE s = 1)
SELECT p_partkey, list_transform(range(12), lambda i: coalesce(ids[i + 1], 0)) AS ids, CAST(len(list_filter(ids, lambda x: x = 1)) AS BIGINT) AS n_unknown, [na, nb] AS segment_sizes, CASE WHEN n > 5 THEN 'NAME:' || n || '=>5|' ELSE '' END || CASE WHEN na + nb > 12 THEN 'OVERALL:' || (na + nb) || '=>12|' ELSE '' END AS overflow FROM r""")
def sub_tokenizers(read):
    text = F.concat(F.lit("<@TOKENIZER-TYPE=NAME@MAX-LEN=5>"), "p_name", F.lit("<@TOKENIZER-TYPE=BRAND>"), "p_brand")
    rows = read("part").select("p_partkey", tk.parse(text).alias("segments"))
    return tr.tokenise(rows, "p_partkey", "segments", part_vocabularies(read), 12, 0, 1).select("p_partkey", "ids", "n_unknown", "segment_sizes", "overflow")


@query(f"""{VOCABULARIES}, c AS (SELECT p_partkey, len(ids) AS n FROM t WHERE s = 0), x AS (SELECT c.p_partkey, n, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, vec_id, embedding FROM c JOIN part USING (p_partkey) LEFT JOIN embeddings ON vec_id = c.p_partkey)
SELECT p_partkey, list_transform(range(20), lambda i: CASE i - n WHEN 0 THEN size WHEN 1 THEN 1.5e0 WHEN 5 THEN price WHEN 6 THEN size ELSE -1000e0 END) AS scalars, list_transform(range(20), lambda i: i - n IN (0, 1, 5, 6)) AS scalars_valid,
list_transform(range(20), lambda i: CASE WHEN i - n BETWEEN 2 AND 4 AND i - n - 2 <= vec_id % 4 THEN round(CAST(embedding[(i - n - 2) * 4 + 1] AS DOUBLE), 6) + 0e0 ELSE -9e0 END) AS first, n + 2 AS location FROM x""")
def inject_embeddings(read):
    text = F.concat(
        F.lit("<@TOKENIZER-TYPE=NAME>"), "p_name", F.lit("<@TOKENIZER-TYPE=SCALARS_LITERALS>"), F.col("p_size").cast("string"), F.lit(",1.5<@TOKENIZER-TYPE=EXTERNAL_EMBEDDINGS_FROM_DICT>m1:"), F.col("p_partkey").cast("string"),
        F.lit(":3<@TOKENIZER-TYPE=SCALARS_FROM_DICT>price<@TOKENIZER-TYPE=BRAND>"), "p_brand",
    )
    values = {"price": F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"))}
    rows = read("part").withColumn("segments", tk.parse(text)).withColumn("held", tr.placeholders(F.col("segments"), "NAME", values))
    rows = tr.tokenise(rows, "p_partkey", "held", part_vocabularies(read), 20, 0, 1)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 4)).alias("at")
    vectors = read("embeddings").select(F.lit("m1").alias("model"), F.col("vec_id").cast("string").alias("name"), "embedding", at).withColumn("vector", F.slice("embedding", (F.col("at") * 4 + 1).cast("int"), 4))
    out = tr.inject(rows, "p_partkey", "segments", vectors, values)
    first = F.transform("embeddings", lambda v: F.coalesce(F.round(F.get(v, F.lit(0)).cast("double"), 6) + F.lit(0.0), F.lit(-9.0)))
    return out.select("p_partkey", "scalars", "scalars_valid", first.alias("first"), F.get("external", F.lit(0))["location"].alias("location"))


DRAWN = f"""{D}, g AS (SELECT user_id, day, list(event_type ORDER BY event_id) || ['SEP'] AS t, ['u' || user_id % 3, 'v'] AS s FROM v GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g, (SELECT unnest([true, false]) AS every)),
h AS (SELECT o.*, floor({uniform_sql("4/start", "user_id")} * greatest((n - 1) // 2, 1)) AS a, n - 1 - floor({uniform_sql("4/stop", "user_id")} * greatest((n - 1) // 2, 1)) AS b FROM (SELECT user_id, day, t, s, every, row_number() OVER (PARTITION BY user_id, every ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id, every) AS n FROM o) o),
c AS (SELECT *, CASE WHEN every THEN s || t ELSE t END AS x, sum(CASE WHEN i >= a AND i < b THEN len(t) + CASE WHEN every THEN 2 ELSE 0 END ELSE 0 END) OVER (PARTITION BY user_id, every ORDER BY day DESC) AS total FROM h),
k AS (SELECT user_id, every, ['CLS'] || CASE WHEN every THEN [] ELSE any_value(s) || ['SEP_STATIC'] END || coalesce(flatten(list(x ORDER BY day) FILTER (WHERE i >= a AND i < b AND total < 30)), []) AS t, any_value(CASE WHEN i = b THEN array_to_string(t, ' ') END) AS next FROM c GROUP BY 1, 2)"""


@query(f"{DRAWN} SELECT user_id, every, array_to_string(list_transform(range(30), lambda i: coalesce(t[i + 1], 'PAD')), ' ') AS tokens, next FROM k")
def sampled_trajectories(read):
    visits = ev.sentences(daily(read), "user_id", "day", "event_type", "event_id").withColumn("static", F.array(F.concat(F.lit("u"), F.col("user_id") % 3), F.lit("v")))
    parts = [ev.sampled_trajectory(visits, "user_id", "day", "tokens", 30, seed=4, static="static", in_all=x).withColumn("every", F.lit(x)) for x in (True, False)]
    return parts[0].unionByName(parts[1]).select("user_id", "every", F.array_join("tokens", " ").alias("tokens"), F.array_join("next", " ").alias("next"))
