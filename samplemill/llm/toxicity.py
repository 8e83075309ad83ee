"""Toxic passages by maximum-scoring segments.

A bounded sample of labelled documents gives, for every word and its 4-, 5- and
6-byte beginnings (hashed), how many toxic and clean documents hold it. A word's
log-odds come from a chain of Dirichlet (Beta) priors: the label's base rate
is the prior of the shortest beginning, each beginning's posterior mean is the
prior of the next longer one, and the last is the prior of the whole word. Less
a fixed cost per token, these scores have a negative mean in clean text; one
linear scan then finds all maximal-scoring segments of a text. Segment scores
are calibrated as extreme values: lambda solves sum p(s) exp(lambda s) = 1 over clean
tokens and K is fitted to the best segments of clean documents, so that a segment of score S
in n tokens is expected K n exp(-lambda S) times by chance. A logistic curve
over the best and the summed significance, fitted on documents that the
counts did not see, gives the score from 0 to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, cut, documents, small_batches

#: Labelled documents learned from, at most: those of the smallest hashed ids.
SAMPLE_DOCS = 30_000
#: Beginnings in bytes (0: the whole word) and the logarithm of each hash table's size.
LEVELS = ((4, 18), (5, 18), (6, 18), (0, 20))
#: Weight of a prior, in documents; cost of a token; documents with a feature for it to count.
PRIOR, COST, LEAST = 3.0, 0.5, 2
#: No word is surer than this of either label.
CERTAIN = 1e-4
#: A segment counts as significant if fewer than so many are expected by chance.
EXPECTED = 0.05


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, ends, first, slot of each level) of a piece's words."""
    low = tv.LOWER[data]
    starts, ends, first = tv.words(low, offs, tv.ALNUM)
    sums = tv.prefix_hash(low)
    slots = [(tv.span_hash(sums, starts, np.minimum(ends, starts + n) if n else ends) >> np.uint64(64 - bits)).astype(np.int64) for n, bits in LEVELS]
    return starts, ends, first, slots


@dataclass
class Model:
    """What is learned; all sizes are fixed by LEVELS."""

    toxic: list[np.ndarray]
    total: list[np.ndarray]
    rate: float
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def scores(self, slots: list[np.ndarray]) -> np.ndarray:
        q = self.rate
        for at, t, n in zip(slots, self.toxic, self.total, strict=True):
            q = (t[at] + PRIOR * q) / (n[at].astype(np.float64) + PRIOR)
        q = np.clip(q, CERTAIN, 1 - CERTAIN)
        return np.log(q / (1 - q)) - np.log(self.rate / (1 - self.rate)) - COST

    def significance(self, score: float, n: int) -> float:
        """Minus the natural logarithm of the number expected by chance."""
        return self.lam * score - np.log(self.k * max(n, 1))

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(best, total) @ np.array(self.weights), -40, 40)))


def segments(positive: list[int], values: list[float], sums: list[float], base: float = 0.0) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first token, last token, score).

    positive: places of the tokens above zero; values: the running sums up to
    and with each; sums: those before each. Linear time: each candidate is pushed
    once and merged at most once."""
    held: list[list] = []  # first, last, sum before, sum after
    for p, r, l in zip(positive, values, sums, strict=True):
        first, low = p, l
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= r:
                held.append([first, p, low, r, j])
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
    return [(h[0], h[1], h[3] - h[2]) for h in held]


def passages(model: Model, data: np.ndarray, offs: np.ndarray):
    """Per text (tokens, best significance, summed significance, [(start, end, score, significance)])
    with places in bytes; a text without positive tokens has significance -ln(1 + tokens)."""
    starts, ends, first, slots = _tokens(data, offs)
    s = model.scores(slots) if len(starts) else np.zeros(0)
    sums = np.append(0.0, np.cumsum(s))
    positive = np.flatnonzero(s > 0)
    at = np.searchsorted(positive, first)
    for i in range(len(offs) - 1):
        n = int(first[i + 1] - first[i])
        p = positive[at[i] : at[i + 1]]
        if not len(p):
            yield n, -float(np.log1p(n)), 0.0, []
            continue
        found = segments(p.tolist(), sums[p + 1].tolist(), sums[p].tolist())
        worth = [(int(starts[a] - offs[i]), int(ends[b] - offs[i]), x, float(model.significance(x, n))) for a, b, x in found]
        limit = -np.log(EXPECTED)
        yield n, max(w[3] for w in worth), sum(w[3] for w in worth if w[3] > limit), [w for w in worth if w[3] > limit]


def _counts(sample: DataFrame) -> DataFrame:
    """(level, slot, toxic, total) of documents that hold a feature."""

    def each(batch):
        label = batch.column(2).to_numpy()
        for a, b, data, offs in tv.batches(batch.column(1)):
            _, _, first, slots = _tokens(data, offs)
            owner = np.repeat(np.arange(b - a), np.diff(first))
            for level, at in enumerate(slots):
                pair = np.unique(at * (b - a) + owner) if len(at) else at
                u, back = np.unique(pair // (b - a), return_inverse=True)
                n = np.bincount(back, minlength=len(u))
                t = np.bincount(back, weights=label[pair % (b - a) + a], minlength=len(u)).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(u), level, np.int32)), pa.array(u), pa.array(t), pa.array(n)], ["level", "slot", "toxic", "total"])

    return arrow_stage(sample, each, "level int, slot long, toxic long, total long").groupBy("level", "slot").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))


def _tables(rows: pa.Table, rate: float) -> Model:
    level, slot, t, n = (rows.column(c).to_numpy() for c in ("level", "slot", "toxic", "total"))
    toxic, total = ([np.zeros(1 << bits, np.float32) for _, bits in LEVELS] for _ in range(2))
    for k in range(len(LEVELS)):
        toxic[k][slot[level == k]], total[k][slot[level == k]] = t[level == k], n[level == k]
    return Model(toxic, total, rate)


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Constant, best significance within bounds beyond which it says nothing more, logarithm of the sum."""
    return np.stack([np.ones(len(best)), np.clip(best, -15, 25), np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's steps, halved until they lower the loss."""

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w[1:] ** 2).sum()

    w, eye = np.zeros(x.shape[1]), np.diag([1e-9, *[ridge] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (p - y) + eye @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from at most `sample_docs` labelled rows for which keep(doc_id) holds.

    Rows without a label or id are not used; of several labels of a document the
    largest counts. Without any usable row every text scores the same low value."""
    spark = docs.sparkSession
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).dropna()
    if keep is not None:
        chosen = chosen.where(keep(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # a quarter (fold 1) calibrates what the other three (fold 0) have counted
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).cast("int").alias("fold")
    sample = cut(documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", fold))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = (toxic + 1) / (n + 10)
    model = _tables(_counts(sample.where("fold = 0")).where(f"total >= {LEAST}").toArrow(), rate)
    held = sample.where("fold = 1")
    shared = spark.sparkContext.broadcast(model)

    def each(batch):
        label = batch.column(2).to_numpy()
        m, rows = shared.value, []
        for a, b, data, offs in tv.batches(batch.column(1)):
            _, _, first, slots = _tokens(data, offs)
            s = m.scores(slots) if len(slots[0]) else np.zeros(0)
            owner = np.repeat(np.arange(a, b), np.diff(first))
            bins, count = np.unique(np.round(s[label[owner] == 0], 2), return_counts=True)
            for x, c in zip(bins.tolist(), count.tolist(), strict=True):
                rows.append((0, x, float(c), 0))
            for i in range(b - a):
                rows.append((1, best_of(s[first[i] : first[i + 1]]), float(first[i + 1] - first[i]), int(label[a + i])))
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "x", "n", "label"]) if rows else None

    def best_of(s: np.ndarray) -> float:
        """The best segment's score: the largest rise of the running sum."""
        if not len(s):
            return 0.0
        c = np.append(0.0, np.cumsum(s))
        return float((c - np.minimum.accumulate(c)).max())

    seen = arrow_stage(held, each, "kind long, x double, n double, label long")
    tokens = seen.where("kind = 0").groupBy("x").agg(F.sum("n").alias("n")).toArrow()
    best = seen.where("kind = 1").select("x", "n", "label").toArrow()
    if best.num_rows and tokens.num_rows:
        x, p = tokens.column("x").to_numpy(), tokens.column("n").to_numpy()
        p = p / p.sum()
        lo, hi = 1e-3, 20.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * x, 500))).sum() > 1 else (mid, hi)
        lam = lo
        s, length, y = best.column("x").to_numpy(), best.column("n").to_numpy(), best.column("label").to_numpy()
        clean = y == 0
        k = 1 / max(float(np.mean(length[clean] * np.exp(-lam * s[clean]))), 1e-9) if clean.any() else 1.0
        model.lam, model.k = float(lam), float(k)
    shared.unpersist()
    again = spark.sparkContext.broadcast(model)

    def features(batch):
        label = batch.column(2).to_numpy()
        rows = []
        for a, _, data, offs in tv.batches(batch.column(1)):
            rows += [(b, t, int(label[i])) for i, (_, b, t, _) in enumerate(passages(again.value, data, offs), a)]
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["best", "total", "label"])

    points = arrow_stage(held, features, "best double, total double, label long").toArrow()
    if points.num_rows:
        b, t, y = (points.column(c).to_numpy() for c in ("best", "total", "label"))
        model.weights = tuple(_logistic(_features(b, t), y.astype(float)).tolist())
    again.unpersist()
    return model


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, score, passages array<struct<start, end, score, significance>>):
    every document's score and its significant passages, places in bytes of the UTF-8 text.

    Null and empty texts have no tokens and a low score. Repeated rows are scored
    as they stand; an empty table gives an empty result; further columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("significance", pa.float64())]))

    def each(batch):
        for a, b, data, offs in tv.batches(batch.column(1)):
            rows = list(passages(shared.value, data, offs))
            score = shared.value.probability(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
            found = pa.array([[dict(zip(("start", "end", "score", "significance"), w, strict=True)) for w in r[3]] for r in rows], kind)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), pa.array(score), found], ["doc_id", "n_tokens", "score", "passages"])

    return arrow_stage(documents(docs), each, "doc_id long, n_tokens long, score double, passages array<struct<start:long,end:long,score:double,significance:double>>")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores under `threshold`, with all their columns.

    Null and empty texts stay unless the model scores every text high; a row's other columns
    play no part, so repeated rows go or stay together. An empty table gives an empty result."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    small_batches(docs.sparkSession)

    def each(batch):
        for a, b, data, offs in tv.batches(batch.column(at)):
            rows = list(passages(shared.value, data, offs))
            score = shared.value.probability(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
            yield batch.slice(a, b - a).filter(pa.array(score < threshold))

    return arrow_stage(docs, each, docs.schema)


def held_out(doc_id):
    """The rows that are not learned from: crc32 of the id as text divides by 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, n_passages) of every document, by a model of the labelled ones that are not held out.

    Null and empty texts have the score of no tokens; a null doc_id is not held out and has no label; repeated rows are scored
    alike; labels that contradict each other count each; an empty table of documents has no scores. Further columns are ignored."""
    model = fit(docs, labels, keep=lambda c: ~held_out(c))
    return detect(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", F.size("passages").alias("n_passages"))
