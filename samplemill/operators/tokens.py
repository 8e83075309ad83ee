"""Texts of typed segments to ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, uniform
from ..functions.running import numbered
from ..sources.tables import look_up_in
from .events import fit

#: Fixed format of the hint before a segment.
HINT = r"<@TOKENIZER-TYPE=([^@>]+)(?:@MAX-LEN=(\d+))?(?:@TRUNC-MODE=(RIGHT|RAND))?>"
MARK = "\x01"


def parse(text: Column) -> Column:
    """array<struct<kind, max_len, trunc_mode, text>>; a text that does not begin with a hint stops the query."""
    parts = F.slice(F.split(F.regexp_replace(text, HINT, MARK + "$1" + "\x02" + "$2" + "\x02" + "$3" + "\x02"), MARK), F.lit(2), F.greatest(F.size(F.split(F.regexp_replace(text, HINT, MARK), MARK)) - 1, F.lit(0)))
    made = F.transform(parts, lambda p: F.struct(F.get(F.split(p, "\x02"), F.lit(0)).alias("kind"), F.nullif(F.get(F.split(p, "\x02"), F.lit(1)), F.lit("")).cast("int").alias("max_len"), F.nullif(F.get(F.split(p, "\x02"), F.lit(2)), F.lit("")).alias("trunc_mode"), F.get(F.split(p, "\x02"), F.lit(3)).alias("text")))
    return F.when(text.rlike("^" + HINT), made).when(text.isNotNull(), F.raise_error(F.lit("a segment needs a hint")))


def unparse(segments: Column) -> Column:
    """The text of segments, as `parse` reads it."""
    one = lambda s: F.concat(F.lit("<@TOKENIZER-TYPE="), s["kind"], F.coalesce(F.concat(F.lit("@MAX-LEN="), s["max_len"].cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("@TRUNC-MODE="), s["trunc_mode"]), F.lit("")), F.lit(">"), s["text"])
    return F.array_join(F.transform(segments, one), "")


def encode(df: DataFrame, key: str, segments: str, words: DataFrame, length: int, pad: int, unknown: int, seed: object = 0) -> DataFrame:
    """Adds `ids` (cut and padded to `length`), `attention_mask` and `n_unknown`.

    Words of each segment (by white space) are looked up in `words` (kind, token, id). A segment over its max_len loses its
    end, or keeps a drawn window if its mode is RAND."""
    segs = df.select(col(key).alias("__k"), F.posexplode(col(segments)).alias("s", "seg"))
    tokens = F.filter(F.split(F.col("seg.text"), r"\s+"), lambda t: t != "")
    segs = segs.select("__k", "s", "seg.kind", tokens.alias("tokens"), "seg.max_len", "seg.trunc_mode")
    most = F.coalesce("max_len", F.size("tokens"))
    spare = F.greatest(F.size("tokens") - most, F.lit(0))
    start = F.when(F.col("trunc_mode") == "RAND", F.floor(uniform(seed, F.col("__k"), F.col("s")) * (spare + 1)).cast("int")).otherwise(0)
    segs = segs.withColumn("tokens", F.slice("tokens", start + 1, F.least(most, F.size("tokens"))))
    long = look_up_in(segs.select("__k", "s", "kind", F.posexplode("tokens").alias("at", "token")), words.select("kind", "token", "id"), ["kind", "token"])
    ids = long.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "at", F.coalesce("id", F.lit(unknown)).alias("id")))), lambda x: x["id"]).alias("__ids"))
    out = df.join(ids, col(key) == F.col("__k"), "left").drop("__k")
    raw = F.coalesce("__ids", F.array().cast("array<long>"))
    return out.withColumns({"ids": fit(raw, length, pad), "attention_mask": F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < F.size(raw)), "n_unknown": F.size(F.filter(raw, lambda x: x == unknown)).cast("long"), "overflow": F.greatest(F.size(raw) - length, F.lit(0)).cast("long")}).drop("__ids")


def decode(df: DataFrame, key: str, ids: str, words: DataFrame, to: str, special: Sequence[str] = (), skip: bool = False) -> DataFrame:
    """The tokens of ids joined; <@TOKEN_MISSING-id> for unknown ids. `words`: token, id."""
    long = look_up_in(df.select(col(key).alias("__k"), F.posexplode_outer(col(ids)).alias("at", "id")), words.select("id", "token"), ["id"])
    token = F.coalesce("token", F.concat(F.lit("<@TOKEN_MISSING-"), F.col("id").cast("string"), F.lit(">")))
    if skip and special:
        token = F.when(~F.coalesce(F.col("token").isin(list(special)), F.lit(False)), token)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", token.alias("t")))), lambda x: x["t"]), "")
    return df.join(long.groupBy("__k").agg(text.alias(to)), col(key) == F.col("__k")).drop("__k")


def scalars(segments: Column, values: Mapping[str, Column] | None = None, default: float = -1000.0) -> Column:
    """The injected numbers of segments of kind SCALARS_LITERALS (comma-joined) and SCALARS_FROM_DICT (a key of `values`),
    the default for others' words, end to end."""
    table = values or {}

    def one(s):
        words = F.filter(F.split(s["text"], r"\s+"), lambda t: t != "")
        out = F.transform(words, lambda _: F.lit(default))
        out = F.when(s["kind"] == "SCALARS_LITERALS", F.transform(F.split(s["text"], ","), lambda t: F.trim(t).cast("double"))).otherwise(out)
        for k, v in table.items():
            out = F.when((s["kind"] == "SCALARS_FROM_DICT") & (F.trim(s["text"]) == k), v.cast("array<double>")).otherwise(out)
        return out

    return F.flatten(F.transform(segments, one))


def merged_vocabulary(parts: Mapping[str, DataFrame], special: Sequence[str]) -> DataFrame:
    """(kind, token, id) of several vocabularies (token, id): the special tokens are shared and keep the first ids; each
    vocabulary's others follow in their order, in a range of their own. Vocabularies must fit on the driver as sizes only."""
    spark = next(iter(parts.values())).sparkSession
    first = spark.createDataFrame([(t, i) for i, t in enumerate(special)], "token string, id long")
    out, start = None, len(special)
    for kind, words in parts.items():
        own = words.where(~F.col("token").isin(list(special)))
        placed = own.join(numbered(own, "id"), "id").select(F.lit(kind).alias("kind"), "token", (F.col("place") + start).alias("id"))
        start += own.select("id").distinct().count()
        both = first.select(F.lit(kind).alias("kind"), "token", "id").unionByName(placed)
        out = both if out is None else out.unionByName(both)
    return out


def diagnose(words: DataFrame, special: Sequence[str]) -> DataFrame:
    """(check, bad): of vocabularies (kind, token, id), how many special tokens do not have one id everywhere, ids that a vocabulary
    gives twice, and ids that regular tokens of two vocabularies share."""
    is_special = F.col("token").isin(list(special))
    kinds = words.agg(F.count_distinct("kind").alias("k"))
    apart = words.where(is_special).groupBy("token").agg(F.count_distinct("id").alias("ids"), F.count_distinct("kind").alias("in")).crossJoin(F.broadcast(kinds)).where("ids > 1 or in < k")
    twice = words.groupBy("kind", "id").agg(F.count_distinct("token").alias("n")).where("n > 1")
    shared = words.where(~is_special).groupBy("id").agg(F.count_distinct("kind").alias("n")).where("n > 1")
    parts = [df.agg(F.lit(name).alias("check"), F.count("*").alias("bad")) for name, df in (("special", apart), ("duplicate", twice), ("collision", shared))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def look_up(rows: DataFrame, words: DataFrame, by: str, to: str, kind: str = "kind") -> DataFrame:
    """Tokens to ids (by="token", to="id") or back; rows without an entry get null."""
    return rows.join(words.select(col("kind").alias(kind), by, col(to)), [kind, by], "left")


def sentinels(words: DataFrame, prefix: str = "SENTINEL_ID_") -> DataFrame:
    """(least, most, max_id): the smallest and largest number among tokens `<prefix><n>` in angle brackets, and the largest id."""
    number = F.regexp_extract("token", f"^<{prefix}(\\d+)>$", 1)
    return words.agg(F.min(F.when(number != "", number.cast("long"))).alias("least"), F.max(F.when(number != "", number.cast("long"))).alias("most"), F.max("id").alias("max_id"))


def wrap(name: Column) -> Column:
    return F.concat(F.lit("<"), name, F.lit(">"))


def unwrap(name: Column) -> Column:
    return F.regexp_replace(name, "^<(.*)>$", "$1")
