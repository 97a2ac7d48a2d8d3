"""Approximate nearest neighbours with learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, and a small network learns to tell from a
vector the parts in which its neighbours lie. It puts every row into its most probable part, and sends a query
to several. Parts that are still large are cut again in the same way, each by a network of its own; so the rows
that a query meets grow slower than the table. In the last parts its distances to all rows are computed in full.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import CROWD, cut, table

#: A partition is learned from so many rows at most; a level has no more parts than that.
SAMPLE, MOST_PARTS = 8192, 64
#: Parts of more rows than this are cut again, at most so many times; what is larger then is dealt in blocks.
LEAF, LEVELS = 4096, 6
#: Neighbours in the graph; recall among the sample for which the number of probed parts is set.
DEGREE, AIM = 10, 0.98
#: Larger parts, and more queries to a part, are dealt in blocks of this many rows.
ROW_BLOCK, QUERY_BLOCK = 16384, 2048
#: A list of parts, 12 bytes each, is broadcast up to this length.
LISTED = 100_000


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others."""
    norm, out = (x * x).sum(1), []
    for a in range(0, len(x), 1024):
        d = norm[a : a + 1024, None] + norm[None] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row of the graph, none larger than slack times the mean.

    Halving along principal axes gives balanced parts to start from; then rows move, most gain first, to the part
    that holds most of their neighbours, as far as it has room.
    """
    part, groups = np.zeros(len(x), np.int64), [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        own = groups.pop()
        y = x[own] - x[own].mean(0)
        axis = np.linalg.svd(y.T @ y)[0][:, 0]
        order = own[np.argsort(y @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for k, own in enumerate(groups):
        part[own] = k
    room = int(np.ceil(slack * len(x) / parts))
    back = np.concatenate([near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])])
    front = np.concatenate([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()])
    for _ in range(rounds):
        votes = np.bincount(front * parts + part[back], minlength=len(x) * parts).reshape(-1, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < room:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; scores are logarithms of parts' probabilities, up to a constant."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def learn(x: np.ndarray, parts: int, seed: int = 0, hidden: int = 128, epochs: int = 40) -> Router:
    """Fit a router to a sample: near rows' parts are the target, and the probes follow from the recall reached."""
    dim, k = x.shape[1], min(DEGREE, len(x) - 1)
    mean, scale = x.mean(0), float(x.std() + 1e-12)
    if parts < 2 or k < 1:
        return Router(mean, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = graph(x, k)
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    for j in range(k):
        np.add.at(target, (np.arange(len(x)), part[near[:, j]]), 1 / (k + 2))
    target[np.arange(len(x)), part] += 2 / (k + 2)
    rng, z = np.random.default_rng(seed), (x - mean) / scale
    p = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(z[own] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            e = np.exp(s - s.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - target[own]) / len(own)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((z[own].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *p, probes=parts)
    ranks = np.argsort(np.argsort(-router.scores(x), axis=1, kind="stable"), axis=1)
    home = router.scores(x).argmax(1)
    needed = np.take_along_axis(ranks, home[near], axis=1)  # the probe that finds each neighbour
    probes = next(q for q in range(1, parts + 1) if (needed < q).mean() >= AIM)
    return Router(mean, scale, *p, probes=min(parts, probes + 1))


def usable(column: str) -> F.Column:
    c = F.col(column)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(whole, F.lit(False)) & F.coalesce(F.exists(c, lambda v: v != 0), F.lit(False))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _thinned(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that no query can have among its k nearest: of a vector of more than max(CROWD, a thousandth)
    of all rows the k + 1 smallest ids stay, each k times at most. Fewer than 1000 vectors are that common."""
    key = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    counts = rows.select(*key).groupBy("h", "g").agg(F.count("*").alias("of")).where(F.col("of") > CROWD)
    counts = cut(counts)
    if counts.isEmpty():
        return rows
    hot = F.broadcast(counts.where(F.col("of") > max(CROWD, rows.count() // 1000)).select("h", "g"))
    own = rows.select("id", "v", *key)
    few = own.join(hot, ["h", "g"]).groupBy("h", "g", "id").agg(F.count("*").alias("n"), F.any_value("v").alias("v"))
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("rank") <= k + 1)
    again = first.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long")))))
    return own.join(hot, ["h", "g"], "left_anti").select("id", "v").unionByName(again.select("id", "v"))


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """part and number of blocks, of parts that have several."""
    several = cut(df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("long").alias(name)).where(F.col(name) > 1))
    return F.broadcast(several) if several.count() <= LISTED else several


def _dealt(df: DataFrame, several: DataFrame, name: str) -> DataFrame:
    return df.join(several, "part", "left").withColumn(name, F.coalesce(name, F.lit(1).cast("long")))


def _block(n: str) -> F.Column:
    return F.pmod(F.xxhash64("id", "v"), F.col(n))


def _every(n: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


_ROUTED = "part long, id long, v array<double>"


def _parted(router: Router, probes: int, v: np.ndarray, part: np.ndarray, ids: pa.Array, column: pa.Array) -> pa.Table:
    """A row for each probed part of each vector; a part's number is a hash of its path."""
    best = np.argsort(-router.scores(v), axis=1, kind="stable")[:, :probes]
    at = pa.array(np.repeat(np.arange(len(v)), best.shape[1]))
    below = (part.astype(np.int64) * 1000003 + best.ravel().astype(np.int64) + 1) if len(v) else np.zeros(0, np.int64)
    return pa.table({"part": pa.array(below), "id": ids.take(at), "v": column.take(at)})


def _split(rows: DataFrame, models: DataFrame, all_probes: bool, dim: int) -> DataFrame:
    """Rows of parts that have a model, put into that part's parts, blocks of a part in tasks of their own."""
    several = _blocks(rows, ROW_BLOCK, "blocks")
    left = _dealt(rows, several, "blocks").withColumn("block", _block("blocks")).select("part", "block", "id", "v")
    right = _dealt(models, several, "blocks").select("part", _every("blocks").alias("block"), "model")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        router, column = pickle.loads(b.column("model")[0].as_py()), a.column("v").combine_chunks()
        probes = router.probes if all_probes else 1
        part = np.repeat(a.column("part").to_numpy(), min(probes, router.w2.shape[1]))
        return _parted(router, probes, _vectors(column, dim), part, a.column("id").combine_chunks(), column)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, _ROUTED)


def _models(rows: DataFrame, dim: int, leaf: int) -> DataFrame:
    """part, model: a router for each part, learned from a sample of its rows by a hash of their ids."""
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("part").orderBy(F.xxhash64("id", F.lit(5)), "id", "v")
    sample = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).join(sizes, "part")

    def fit(t: pa.Table) -> pa.Table:
        x, n = _vectors(t.sort_by("rank").column("v").combine_chunks(), dim), t.column("n")[0].as_py()
        parts = int(min(MOST_PARTS, max(2, 2 * n // leaf), max(2, len(x) // 64)))
        return pa.table({"part": t.column("part").slice(0, 1), "model": pa.array([pickle.dumps(learn(x, parts))], pa.binary())})

    return sample.select("part", "rank", "v", "n").groupBy("part").applyInArrow(fit, "part long, model binary")


def _first_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The commonest number of dimensions of a sample, and a router learned from its vectors of that many."""
    held = [b.column(0) for b in batches if b.num_rows]
    if not held:
        return
    column = pa.chunked_array(held).combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values, counts = np.unique(sizes, return_counts=True)
    dim = int(values[np.lexsort((values, counts))[-1]])
    x = _vectors(column.filter(pa.array(sizes == dim)), dim)
    model = pickle.dumps(learn(x, int(min(MOST_PARTS, max(1, len(x) // 128)))))
    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([model], pa.binary())], ["dim", "model"])


def _searched(index: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest rows of each query in each block of its parts."""
    filled, wanted = _blocks(index, ROW_BLOCK, "blocks"), _blocks(asked, QUERY_BLOCK, "batches")
    both = lambda df: _dealt(_dealt(df, filled, "blocks"), wanted, "batches")
    left = both(index).select("part", _block("blocks").alias("block"), "id", "v", _every("batches").alias("queries"))
    right = both(asked).select("part", _every("blocks").alias("block"), "id", "v", _block("batches").alias("queries"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asked_ids = a.column("id").to_numpy(), b.column("id").to_numpy()
        if not len(ids) or not len(asked_ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = (_vectors(t.column("v").combine_chunks(), dim) for t in (a, b))
        norm, got = (x * x).sum(1), ([], [], [])
        top = 2.0 * float(norm.max())
        for s in range(0, len(y), 256):
            part = y[s : s + 256]
            far = norm[None] + (part * part).sum(1)[:, None] - 2 * part @ x.T
            far[asked_ids[s : s + 256, None] == ids[None]] = np.inf
            kth = np.partition(far, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            slack = 1e-9 * (top + (part * part).sum(1))  # beyond the rounding of this form of the distance
            for i in range(len(part)):
                near = np.flatnonzero((far[i] <= kth[i] + slack[i]) & np.isfinite(far[i]))
                score = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
                order = np.lexsort((ids[near], score))[:k]
                got[0].append(np.full(len(order), asked_ids[s + i]))
                got[1].append(ids[near][order])
                got[2].append(score[order])
        return pa.table({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), got, strict=True)})

    keys = ["part", "block", "queries"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by Euclidean distance in doubles.

    Rows with the query's id are no candidates. Ties go to the smaller id; a query with fewer candidates than k gets
    them all, and one whose parts hold fewer is compared with all rows, in blocks. Vectors that are null, empty, zero,
    or hold null or non-finite components take no part, nor do rows without id or with another number of dimensions
    than most of the sample. Of queries with equal ids the first by vector counts; a row that occurs twice is found
    once for each. Every row is indexed; of very common vectors those that can be found (see ``_thinned``). An empty
    table gives an empty result. Samples are chosen by a hash of the id, so reruns agree.
    """
    pick = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    rows, queries = pick(rows), pick(queries)
    first_model = rows.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(SAMPLE).select("v").mapInArrow(_first_model, "dim int, model binary").first()
    if first_model is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, router = first_model["dim"], pickle.loads(first_model["model"])
    rows, queries = (df.where(F.size("v") == dim) for df in (rows, queries))

    def routed(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _vectors(batch.column(1), dim)
                zero = np.zeros(len(v) * min(probes, router.w2.shape[1]), np.int64)
                yield from _parted(router, probes, v, zero, batch.column(0), batch.column(1)).to_batches()

        return run

    index = cut(_thinned(rows, k).mapInArrow(routed(1), _ROUTED))
    first = queries.groupBy("id").agg(F.min("v").alias("v"))
    asked = cut(first.mapInArrow(routed(router.probes), _ROUTED))
    done, seen = [], []
    for _ in range(LEVELS):
        large = cut(index.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("part"))
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= LISTED else large
        models = cut(_models(index.join(large, "part"), dim, leaf))
        done.append(index.join(large, "part", "left_anti"))
        seen.append(asked.join(large, "part", "left_anti"))
        index, asked = cut(_split(index.join(large, "part"), models, False, dim)), cut(_split(asked.join(large, "part"), models, True, dim))
    for more in done:
        index = index.unionByName(more)
    for more in seen:
        asked = asked.unionByName(more)
    found = cut(_searched(index, asked, k, dim))
    short = cut(first.join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), F.col("id") == F.col("query_id"), "left_anti"))
    if not short.isEmpty():
        whole = lambda df: df.withColumn("part", F.lit(0).cast("long"))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_searched(whole(index), whole(short), k, dim))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found of each row of embeddings whose vec_id is divisible by 100; odd vectors as in ``nearest``."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op3_nearest": op3_nearest}
ORACLES: dict[str, str] = {}
