"""Small Spark helpers of this subpackage: shared checkpoints, columns with safe
names, Arrow stages and connected components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv

#: Bits of a block of a key filter; bits for each key, and of a filter at most (32 MB).
FILTER_BLOCK, FILTER_SHARE, FILTER_BITS = 1 << 16, 16, 1 << 28
#: Rows of a key from which a join deals it out, and over how many places.
HEAVY, DEAL = 2048, 64
#: Rows of an Arrow batch: texts of some 4 MB at a few KB each.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where the session names none, a local
    master gets a local one (tests), and on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder or (folder := tempfile.mkdtemp(prefix="samplemill-")))
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a reliable checkpoint: later stages neither
    repeat the work nor depend on executors that are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def documents(docs: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text (null: empty) and the columns in `more`, whatever else the table holds."""
    small_batches(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), *(docs[c] for c in more))


def carry(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with every column but doc_id and text under a name that no operator uses, and
    {that name: the column's own}."""
    names = {f"carried_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = {c: n for n, c in names.items()}
    return docs.toDF(*(own.get(c, c) for c in docs.columns)), names


def give_back() -> None:
    """Returns freed memory to the system: idle workers keep it otherwise."""
    tv.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What drops the large tables that some stages keep between their tasks.
_KEPT: list[Callable[[], None]] = []


def kept_between_tasks(drop: Callable[[], None]) -> None:
    """Registers `drop`: a worker calls it when it begins a stage that does not keep the table."""
    _KEPT.append(drop)


def _drop_kept() -> None:
    for drop in _KEPT:
        drop()


def released(func: Callable, keeps: bool = False) -> Callable:
    """func for mapInArrow, after whose end its worker gives memory back. With `keeps`, tables that are kept between tasks stay;
    else they go before and after, so that only workers at work hold them."""

    def each(it):
        if not keeps:
            _drop_kept()
        try:
            yield from func(it)
        finally:
            if not keeps:
                _drop_kept()
            give_back()

    return each


def arrow_stage(df: DataFrame, func: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str | StructType, keeps: bool = False) -> DataFrame:
    """mapInArrow with a function of one batch; `keeps` as in released()."""

    def each(it):
        for batch in it:
            if batch.num_rows:
                out = func(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(released(each, keeps), schema)


class KeyFilter:
    """A Bloom filter of 64-bit keys in blocks: False is certain, True may be chance."""

    def __init__(self, blocks: int) -> None:
        self.bits = np.zeros((blocks, FILTER_BLOCK // 8), dtype=np.uint8)

    def probes(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.int64) % len(self.bits), [((h >> np.uint64(s)) & np.uint64(FILTER_BLOCK - 1)).astype(np.int64) for s in (0, 16)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        block, places = self.probes(keys)
        out = np.ones(len(keys), dtype=bool)
        for p in places:
            out &= (self.bits[block, p >> 3] >> (p & 7) & 1).astype(bool)
        return out


def key_filter(keys: DataFrame) -> Broadcast:
    """A filter of the one column of longs in `keys` (a table that is cheap to read again), of bounded size. It only
    saves work: with more keys than it has room for, more rows pass."""
    blocks = 1
    while blocks * FILTER_BLOCK < min(keys.count() * FILTER_SHARE, FILTER_BITS):
        blocks *= 2
    out = KeyFilter(blocks)
    shape = KeyFilter(0)
    shape.bits = np.zeros((blocks, 0), dtype=np.uint8)

    def place(batch):
        k = batch.column(0).drop_null().to_numpy()
        yield pa.record_batch([pa.array(shape.probes(k)[0]), pa.array(k)], ["block", "key"])

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, block = np.zeros(FILTER_BLOCK, dtype=bool), None
        for batch in it:
            block = batch.column(0)[0].as_py() if block is None else block
            for p in shape.probes(batch.column(1).to_numpy())[1]:
                bits[p] = True
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    rows = arrow_stage(keys, place, "block long, key long").groupBy("block").applyInArrow(fill, "block long, bits binary").toArrow()
    for block, bits in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        out.bits[block] = np.frombuffer(bits.as_buffer(), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def within(shared: Broadcast, key: Column) -> Column:
    """Whether a filter may hold a column of longs; null keys are not held."""

    def has(k: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(k.to_numpy()))

    return F.arrow_udf(has, "boolean")(F.coalesce(key, F.lit(0))) & key.isNotNull()


def join_heavy(many: DataFrame, one: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of `many` with `one`, which has one row a key and the number of its rows in `weight`
    (dropped): a key of more than HEAVY rows is dealt over DEAL places instead of one task."""
    key = F.xxhash64(*keys)
    heavy = key_filter(one.where(F.col(weight) > HEAVY).select(key.alias("key")))
    hot = within(heavy, key)
    deal = F.pmod(F.xxhash64(*many.columns), F.lit(DEAL)).cast("int")
    many = many.withColumn("__place", F.when(hot, deal).otherwise(0))
    places = F.when(hot, F.sequence(F.lit(0), F.lit(DEAL - 1))).otherwise(F.array(F.lit(0)))
    return many.join(one.drop(weight).withColumn("__place", F.explode(places)), [*keys, "__place"]).drop("__place")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star steps; each step is an aggregation with
    map-side combine and a join on the node (which AQE splits where a hub has very many
    edges), and the edges are checkpointed, so that a long chain takes few rounds. Nulls and loops are
    ignored; nodes without edges are not returned.
    """
    edges = cut(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.groupBy("b").agg(F.first("b").alias("component")).select(F.col("b").alias("node"), "component")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(tops)
