"""Sub-tokenizers by segment kind: greedy longest match along one trie that holds the vocabularies of all kinds.

The trie is a few flat arrays: sorted edges (node, byte) with their children, the id that ends at a node, and a root for each
kind. Segments of all kinds are encoded in one pass: each place of a batch's bytes walks the trie at
once, a byte deeper at each step, and then all segments hop from token to token together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, uniform
from .events import fit

#: Fixed names of the kinds whose segments are injected, and of their placeholders.
LITERALS, FROM_DICT, EXTERNAL = "SCALARS_LITERALS", "SCALARS_FROM_DICT", "EXTERNAL_EMBEDDINGS_FROM_DICT"
SCALAR_TOKEN, EMBEDDING_TOKEN = "<SCALAR>", "<EMBEDDINGS>"
#: Tokens of all vocabularies together that may travel to the tasks.
MOST_TOKENS = 1 << 20


@dataclass
class Trie:
    """Roots by kind, edges sorted by node * 256 + byte, their children, and the id at each node (-1: none)."""

    roots: dict[str, int]
    edges: np.ndarray
    children: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, words: Sequence[tuple[str, str, int]]) -> Trie:
        """From (kind, token, id); of a token that a kind lists twice the smaller id counts; empty tokens are left out."""
        kinds = sorted({k for k, _, _ in words})
        table = sorted((kinds.index(k), t.encode(), i) for k, t, i in words if t)
        lens = np.array([len(t) for _, t, _ in table], np.int64)
        data = np.frombuffer(b"".join(t for _, t, _ in table), np.uint8)
        starts = np.cumsum(lens) - lens
        node, values = np.array([k for k, _, _ in table], np.int64), np.array([i for _, _, i in table], np.int64)
        made, edges, children, ends = len(kinds), [], [], []
        # level by level: tokens that agree so far share a node, and distinct next bytes of a node are its new edges
        for depth in range(int(lens.max(initial=0))):
            live = np.flatnonzero(lens > depth)
            keys, at = np.unique(node[live] * 256 + data[starts[live] + depth], return_inverse=True)
            edges.append(keys)
            children.append(made + np.arange(len(keys)))
            node[live] = made + at
            made += len(keys)
        ids = np.full(made, -1, np.int64)
        ids[node[::-1]] = values[::-1]
        keys, below = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (edges, children))
        order = np.argsort(keys, kind="stable")
        return cls({k: i for i, k in enumerate(kinds)}, keys[order], below[order].astype(np.int64), ids)

    def longest(self, data: np.ndarray, root: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, id) of the longest token at each place, whose walk begins at its root and has so many bytes before it."""
        length, found = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
        at, node, depth = np.flatnonzero((root >= 0) & (room > 0)), root[(root >= 0) & (room > 0)], 0
        while len(at) and len(self.edges):
            keys = node * 256 + data[at + depth]
            slot = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            hit = self.edges[slot] == keys
            at, node, depth = at[hit], self.children[slot[hit]], depth + 1
            ended = self.ids[node] >= 0
            length[at[ended]], found[at[ended]] = depth, self.ids[node[ended]]
            more = room[at] > depth
            at, node = at[more], node[more]
        return length, found

    def encode(self, kinds: Sequence[str], texts: pa.Array, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text): greedy longest matches; a character where none begins is an unknown token."""
        absent = sorted({k for k in kinds if k not in self.roots})
        if absent:
            raise ValueError(f"no vocabulary for kinds {absent}")
        raw = [t.encode() for t in texts.to_pylist()]
        lens = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        offsets = np.append(0, np.cumsum(lens))
        ends = np.repeat(offsets[1:], lens)
        root = np.repeat(np.array([self.roots[k] for k in kinds], np.int64), lens)
        length, found = self.longest(data, root, ends - np.arange(len(data)))
        # bytes of the character at each place, by its first byte
        char = np.select([data >= 0xF0, data >= 0xE0, data >= 0xC0], [4, 3, 2], 1)
        step = np.where(found >= 0, length, np.minimum(char, ends - np.arange(len(data))))
        at, row = offsets[:-1].copy(), np.arange(len(raw))
        places, rows = [], []
        live = lens > 0
        at, row = at[live], row[live]
        while len(at):
            places.append(at)
            rows.append(row)
            at = at + step[at]
            more = at < offsets[row + 1]
            at, row = at[more], row[more]
        if not places:
            return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
        place, owner = np.concatenate(places), np.concatenate(rows)
        order = np.argsort(place, kind="stable")
        ids = np.where(found >= 0, found, unknown)[place[order]]
        return ids, np.append(0, np.cumsum(np.bincount(owner, minlength=len(raw))))


def trie(words: DataFrame, most: int = MOST_TOKENS) -> Trie:
    """The trie of vocabularies (kind, token, id), which is sent to every task: counted first, and refused beyond `most` tokens."""
    words = words.where("kind is not null and token is not null and id is not null").select("kind", "token", F.col("id").cast("long").alias("id"))
    rows = words.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabularies hold more than {most} tokens")
    return Trie.of([tuple(r) for r in rows])


def tokenise(df: DataFrame, key: str, segments: str, words: DataFrame, length: int | None, pad: int, unknown: int, seed: object = 0, on_unknown: str = "keep") -> DataFrame:
    """Adds `ids` (cut and padded to `length`, if one is given), `attention_mask`, `n_unknown`, `segment_sizes` and `overflow`.

    `segments` is what tokens.parse() gives. A segment over its max_len loses its end or, in mode RAND, keeps a window drawn by seed and
    `key`; `overflow` names each cut as kind:before=>after|, the whole's as OVERALL. segment_sizes are the tokens that each
    segment has after its own cut. With on_unknown="raise" an unknown token stops the query. Null segments count as none."""
    shared = df.sparkSession.sparkContext.broadcast(trie(words))
    draws = F.transform(col(segments), lambda s, i: F.when(s["trunc_mode"] == "RAND", uniform(seed, col(key), i)).otherwise(0.0))
    kind = "struct<ids:array<long>,sizes:array<long>,cuts:string>"

    def run(parts: pa.Array, u: pa.Array) -> pa.Array:
        lens = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, draws = parts.flatten(), u.flatten().to_numpy(zero_copy_only=False)
        kinds = flat.field("kind").to_pylist()
        ids, at = shared.value.encode(kinds, pc.fill_null(flat.field("text"), ""), unknown)
        most, modes = flat.field("max_len").to_pylist(), flat.field("trunc_mode").to_pylist()
        sizes, starts, cuts = np.diff(at), at[:-1].copy(), [""] * len(kinds)
        for i in np.flatnonzero([m is not None and n > m for m, n in zip(most, sizes.tolist(), strict=True)]).tolist():
            cuts[i] = f"{kinds[i]}:{sizes[i]}=>{most[i]}|"
            if modes[i] == "RAND":
                starts[i] += int(draws[i] * (sizes[i] - most[i] + 1))
            sizes[i] = most[i]
        keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        heads = np.append(0, np.cumsum(lens))
        rows = np.append(0, np.cumsum(sizes))[heads]
        joined = ["".join(cuts[a:b]) for a, b in zip(heads[:-1], heads[1:], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int64())) for o, v in ((rows, ids[keep]), (heads, sizes))]
        return pa.StructArray.from_arrays([*lists, pa.array(joined, pa.string())], ["ids", "sizes", "cuts"])

    out = df.withColumn("__t", F.arrow_udf(run, kind)(col(segments), draws))
    raw, n = F.col("__t.ids"), F.size("__t.ids")
    cut = F.when(n > (length if length is not None else n), F.concat(F.lit("OVERALL:"), n.cast("string"), F.lit(f"=>{length}|"))).otherwise("")
    bad = F.size(F.filter(raw, lambda x: x == unknown)).cast("long")
    if on_unknown == "raise":
        bad = F.when(bad > 0, F.raise_error(F.concat(bad.cast("string"), F.lit(" unknown tokens in sample "), col(key).cast("string"))).cast("long")).otherwise(bad)
    elif on_unknown != "keep":
        raise ValueError(f"on_unknown is keep or raise, not {on_unknown!r}")
    ids = raw if length is None else fit(raw, length, pad)
    mask = F.transform(ids, lambda x, i: i < n)
    return out.withColumns({"ids": ids, "attention_mask": mask, "n_unknown": bad, "segment_sizes": F.col("__t.sizes"), "overflow": F.concat(F.col("__t.cuts"), cut)}).drop("__t")


def placeholders(segments: Column, kind: str, values: dict[str, Column] | None = None) -> Column:
    """The segments with injected ones replaced by as many placeholder tokens of the vocabulary `kind` as they will hold: one for each
    comma-joined number of SCALARS_LITERALS and each number of the column that SCALARS_FROM_DICT names, and as many as the
    third part of `model:key:length` says (one, if there is none). An unknown column or a broken form stops the query."""
    given = values or {}

    def one(s: Column) -> Column:
        parts = F.split(s["text"], ":")
        literal = F.size(F.split(s["text"], ","))
        numbers = F.transform(F.split(s["text"], ","), lambda t: F.trim(t).try_cast("double"))
        literal = F.when(F.exists(numbers, lambda x: x.isNull()), F.raise_error(F.concat(F.lit("not numbers: "), s["text"])).cast("int")).otherwise(literal)
        named = F.raise_error(F.concat(F.lit("no column for scalars: "), s["text"])).cast("int")
        for name, value in given.items():
            named = F.when(F.trim(s["text"]) == name, F.size(value)).otherwise(named)
        external = F.when(F.size(parts) == 3, F.get(parts, F.lit(2)).cast("int")).when(F.size(parts) == 2, 1).otherwise(F.raise_error(F.concat(F.lit("not model:key or model:key:length: "), s["text"])).cast("int"))
        count = F.when(s["kind"] == LITERALS, literal).when(s["kind"] == FROM_DICT, named).when(s["kind"] == EXTERNAL, external)
        token = F.when(s["kind"] == EXTERNAL, EMBEDDING_TOKEN).otherwise(SCALAR_TOKEN)
        return F.struct(F.when(count.isNotNull(), kind).otherwise(s["kind"]).alias("kind"), F.when(count.isNull(), s["max_len"]).alias("max_len"), F.when(count.isNull(), s["trunc_mode"]).alias("trunc_mode"), F.when(count.isNotNull(), F.repeat(token, count)).otherwise(s["text"]).alias("text"))

    return F.transform(segments, one)


def inject(df: DataFrame, key: str, segments: str, vectors: DataFrame, values: dict[str, Column] | None = None, default: float = -1000.0) -> DataFrame:
    """Adds scalars (one number an id, `default` where there is none), scalars_valid, external (array of model, name,
    location, length) and embeddings (a vector an id, null where there is none) to samples tokenised with placeholders().

    `vectors` (model, name, at, vector) holds ragged embeddings, one row a vector; those of a segment `model:name:length` lie at the
    ids of its placeholders in the order of `at`, as far as both reach. `values` gives array columns by name. Vectors are
    joined by model and name after the distinct pairs of each sample are known; placeholders beyond the cut of the ids are
    left out, and a name without vectors has nulls."""
    given = values or {}
    n = F.size("ids")
    sizes = F.col("segment_sizes")
    starts = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y))
    pairs = F.zip_with(F.zip_with(col(segments), sizes, lambda s, c: F.struct(s.alias("s"), c.alias("c"))), starts, lambda x, p: F.struct(x["s"].alias("s"), x["c"].alias("c"), p.alias("p")))

    def numbers(x: Column) -> Column:
        s = x["s"]
        out = F.array_repeat(F.lit(None).cast("double"), x["c"].cast("int"))
        for name, value in given.items():
            out = F.when((s["kind"] == FROM_DICT) & (F.trim(s["text"]) == name), value.cast("array<double>")).otherwise(out)
        return F.when(s["kind"] == LITERALS, F.transform(F.split(s["text"], ","), lambda t: F.trim(t).cast("double"))).otherwise(out)

    def external(x: Column) -> Column:
        parts = F.split(x["s"]["text"], ":")
        return F.struct(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("name"), x["p"].alias("location"), x["c"].alias("length"))

    made = F.flatten(F.transform(pairs, numbers))
    # bound once for all ids, not computed anew at each
    fitted = F.get(F.transform(F.array(made), lambda m: F.transform(F.col("ids"), lambda _, i: F.get(m, i))), F.lit(0))
    out = df.withColumns({"scalars_valid": F.transform(fitted, lambda x: x.isNotNull()), "scalars": F.transform(fitted, lambda x: F.coalesce(x, F.lit(default)))})
    out = out.withColumn("external", F.transform(F.filter(pairs, lambda x: x["s"]["kind"] == EXTERNAL), external))
    wanted = out.select(col(key).alias("__k"), n.alias("__n"), F.explode("external").alias("e")).select("__k", "__n", "e.*")
    joined = wanted.join(vectors.select("model", "name", "at", "vector").hint("merge"), ["model", "name"])
    # a vector's place is that of its rank among the name's; ranks come with `at`, which counts from 0
    laid = joined.withColumn("i", F.col("location") + F.col("at")).where("at >= 0 and at < length and i < __n")
    laid = laid.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("i", "vector"))).alias("__v"))
    # neither side is small: the planner must not send one to all tasks
    out = out.join(laid.hint("shuffle_hash"), col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumn("embeddings", F.transform("ids", lambda _, i: F.try_element_at("__v", i.cast("long")))).drop("__v")
