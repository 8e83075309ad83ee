"""Merkle manifest of a dataset: every row is a leaf, the leaves of a source make its tree, and the
sources' roots make the tree of the whole.

Leaves are digests made where the rows are read; from there on only ids and digests move. A
range sort gives each leaf its place within its source, whatever the source's size. Places are
cut into aligned blocks of FANOUT ** DEPTH leaves, so a block is a whole subtree: its task holds the
leaves' hex digests as one contiguous matrix, reshapes it by the fanout and hashes the rows, level after
level. Blocks' roots are nodes of the next, far smaller table, and so on up. A leaf's siblings are
found by arithmetic on its place; those above its block are the same for the whole block.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import arrow_stage, cut, released, small_batches

#: Children of a node, and levels within a block of FANOUT ** DEPTH leaves.
FANOUT, DEPTH = 3, 8
#: Characters of a digest in hex.
HEX = 64
#: Columns of a row that its leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_SQL = "array<struct<left:string,right:string>>"


def canonical(*columns: Column) -> Column:
    """The columns as one text: each its UTF-8 byte count, a colon and its value, or - where it is null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts))


def _hex(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level of a matrix of hex digests; the last run may be short."""
    whole = len(nodes) // FANOUT * FANOUT
    out = [hashlib.sha256(r).hexdigest() for r in nodes[:whole].reshape(-1, HEX * FANOUT)]
    if whole < len(nodes):
        out.append(hashlib.sha256(nodes[whole:]).hexdigest())
    return _hex(out)


def levels(nodes: np.ndarray, block: int, depth: int) -> list[np.ndarray]:
    """A block's levels up to its root. A block that others follow or precede has `depth` levels above its nodes,
    however few these are; one that is its whole group has as many as lead to one node."""
    out = [nodes]
    while len(out) <= depth if block else len(out[-1]) > 1:
        out.append(parents(out[-1]))
    return out


def siblings(tree: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, there): of each leaf the others of its runs, left to right, level by level."""
    at, digests, there = np.arange(len(tree[0])), [], []
    slot = np.arange(FANOUT - 1)
    for nodes in tree[:-1]:
        own = (at % FANOUT)[:, None]
        place = at[:, None] - own + slot + (slot >= own)
        there.append(place < len(nodes))
        digests.append(nodes[np.minimum(place, len(nodes) - 1)])
        at = at // FANOUT
    if not digests:
        return np.zeros((len(at), 0, HEX), np.uint8), np.zeros((len(at), 0), bool)
    return np.concatenate(digests, axis=1), np.concatenate(there, axis=1)


def fold(digests: np.ndarray, tree: list[np.ndarray]) -> np.ndarray:
    """The block's root recomputed from each leaf's digest (which may not be the tree's) and the tree's siblings."""
    at = np.arange(len(digests))
    for nodes in tree[:-1]:
        first = at - at % FANOUT
        size = np.minimum(FANOUT, len(nodes) - first) * HEX
        runs = nodes[np.minimum(first[:, None] + np.arange(FANOUT), len(nodes) - 1)]
        runs[np.arange(len(at)), at % FANOUT] = digests
        digests = _hex([hashlib.sha256(r[:n]).hexdigest() for r, n in zip(runs.reshape(len(at), -1), size.tolist(), strict=True)])
        at = at // FANOUT
    return digests


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` (with a text column g, never null) and `place`, from 0 by `order` within each g.

    A range sort deals g's rows over as many tasks as they need. The driver learns two groups' counts of each
    sorted partition, no more than the partitions themselves."""
    rows = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    rows = cut(rows.withColumn("pid", F.spark_partition_id()))
    group = F.struct("g", "n")
    ends = rows.groupBy("pid", "g").agg(F.count("*").alias("n")).groupBy("pid").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.count("*").alias("groups")).collect()
    offsets, name, carried = {}, None, 0
    for e in sorted(ends, key=lambda e: e.pid):
        offsets[e.pid] = carried if e.first.g == name else 0
        carried = e.last.n + (offsets[e.pid] if e.groups == 1 else 0)
        name = e.last.g

    def number(it):
        last, at = None, 0
        for batch in it:
            n, g = batch.num_rows, batch.column("g")
            if not n:
                continue
            if last is None:
                last, at = g[0], offsets[batch.column("pid")[0].as_py()]
            new = np.append(not g[0].equals(last), pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False))
            heads = np.flatnonzero(new)
            before = np.searchsorted(heads, np.arange(n), side="right")
            place = np.arange(n) - np.append(-at, heads)[before]
            last, at = g[n - 1], int(place[-1]) + 1
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(place)], [*names, "place"])

    names = [c for c in rows.columns if c != "pid"]
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(released(number), ", ".join(f"{c} {kinds[c]}" for c in names) + ", place long")


def climb(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(g, place, path, root): of each node (g, place, digest in hex) the siblings up to its g's root, as what
    stands left and right of it on each level. One step for `depth` levels."""

    size = FANOUT**depth

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block = key[1].as_py()
        tree = levels(_hex(table["digest"].to_pylist()), block, depth)
        paths = []
        for at in range(len(tree[0])):
            path = []
            for level in tree[:-1]:
                first = at - at % FANOUT
                path.append({"left": level[first:at].tobytes().decode(), "right": level[at + 1 : first + FANOUT].tobytes().decode()})
                at //= FANOUT
            paths.append(path)
        n, root = len(paths), tree[-1].tobytes().decode()
        return pa.table([table["g"], table["place"], pa.array([block] * n, pa.int64()), pa.array(paths, _PATH), pa.array([root] * n)], ["g", "place", "block", "path", "root"])

    steps = []
    while True:
        grouped = nodes.withColumn("block", F.floor(F.col("place") / size).cast("long"))
        # a group of many blocks has none that is its whole: its first is full
        t = cut(grouped.groupBy("g", "block").applyInArrow(one, f"g string, place long, block long, path {_PATH_SQL}, root string"))
        steps.append(t)
        if t.where("block > 0").isEmpty():
            break
        nodes = t.where(F.col("place") % size == 0).select("g", F.col("block").alias("place"), F.col("root").alias("digest"))
    out = steps.pop().drop("block")
    while steps:
        above = out.select("g", F.col("place").alias("block"), F.col("path").alias("above"), "root")
        out = steps.pop().drop("root").join(above, ["g", "block"]).select("g", "place", F.concat("path", "above").alias("path"), "root")
    return out


def manifest(docs: DataFrame, presented: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row a block of leaves: g (the source behind a =; empty for null), block, ids, leaves and presented (32 bytes each,
    by place), path (the block's own siblings up to the root of all), subroot, root
    and depth (levels within blocks; the results do not depend on it).

    `presented` is the text that is shown for a row when its proof is checked, the row's own if not given. Leaves of
    one source ascend by doc_id (null first), equal ids by their leaf; equal rows are leaves of their own. Null
    columns count as - in a leaf, a null source is a source, an empty table has no blocks. Further columns are
    ignored, whatever their names."""
    small_batches(docs.sparkSession, 10_000)
    *head, text = (docs[c] for c in FIELDS)
    shown = text if presented is None else presented
    leaf, other = F.sha2(canonical(*head, text), 256), F.sha2(canonical(*head, shown), 256)
    g = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("presented"), F.monotonically_increasing_id().alias("tie"))
    rows = placed(cut(rows), "doc_id", "leaf", "tie").withColumn("block", F.floor(F.col("place") / FANOUT**depth).cast("long"))

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        raw = b"".join(table["leaf"].to_pylist())
        root = levels(np.frombuffer(hexlify(raw), np.uint8).reshape(-1, HEX), key[1].as_py(), depth)[-1].tobytes().decode()
        ids = pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64()))
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([root]), ids, pa.array([raw]), pa.array([b"".join(table["presented"].to_pylist())])], ["g", "block", "digest", "ids", "leaves", "presented"])

    blocks = cut(rows.groupBy("g", "block").applyInArrow(one, "g string, block long, digest string, ids array<long>, leaves binary, presented binary"))
    within = cut(climb(blocks.select("g", F.col("block").alias("place"), "digest"), depth).withColumnRenamed("root", "subroot"))
    tops = within.where("place = 0").select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("subroot").alias("digest"))
    tops = cut(placed(tops, "source"))
    above = climb(tops.select("g", "place", "digest"), depth).select("place", F.col("path").alias("above"), "root")
    above = tops.select("place", F.col("source").alias("g")).join(above, "place").drop("place")
    paths = within.join(above, "g").select("g", F.col("place").alias("block"), F.concat("path", "above").alias("path"), "subroot", "root", F.lit(depth).alias("depth"))
    return blocks.drop("digest").join(paths, ["g", "block"])


def proofs(blocks: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf of a manifest; with `whole`, also
    proof, its siblings as hex digests, level by level, left to right.

    proof_sha256 is the digest of all siblings in that order; folded_root is recomputed from the presented row and the
    siblings; verified says that it is the root."""
    more = ", proof array<string>" if whole else ""

    def each(batch):
        for row in batch.to_pylist():
            leaves, shown = (np.frombuffer(hexlify(row[c]), np.uint8).reshape(-1, HEX) for c in ("leaves", "presented"))
            tree = levels(leaves, row["block"], row["depth"])
            digests, there = siblings(tree)
            path = [(p["left"].encode(), p["right"].encode()) for p in row["path"]]
            above = b"".join(x for p in path for x in p)
            proof, folded, whole_proofs = [], [], []
            for d, ok, top in zip(digests, there, fold(shown, tree), strict=True):
                own = d[ok].tobytes() + above
                proof.append(hashlib.sha256(own).hexdigest())
                if whole:
                    whole_proofs.append([own[i : i + HEX].decode() for i in range(0, len(own), HEX)])
                top = top.tobytes()
                for left, right in path:
                    top = hashlib.sha256(left + top + right).hexdigest().encode()
                folded.append(top.decode())
            n = len(leaves)
            columns = [pa.array(row["ids"], pa.int64()), pa.array([x.tobytes().decode() for x in leaves]), pa.array([row["subroot"]] * n), pa.array([row["root"]] * n), pa.array(proof), pa.array(folded), pa.array([f == row["root"] for f in folded])]
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            yield pa.record_batch(columns + ([pa.array(whole_proofs, pa.list_(pa.string()))] if whole else []), names + (["proof"] if whole else []))

    # a row is a block of thousands of leaves
    small_batches(blocks.sparkSession, 16)
    return arrow_stage(blocks.select("block", "ids", "leaves", "presented", "path", "subroot", "root", "depth"), each, f"doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{more}")


def without_newlines(docs: DataFrame) -> Column:
    """The text that is presented for rows whose id has an even CRC-32: theirs without newlines."""
    text = docs["text"].cast("string")
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
