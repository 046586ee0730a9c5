"""Approximate nearest neighbours with learned partitions.

* On a bounded sample the exact neighbour graph is cut into balanced parts: halves along principal directions,
  then vertices move to the part that holds most of their neighbours, as long as it has room.
* A small network learns the part from the vector. It indexes every row (its most probable part) and routes every
  query to its most probable parts; how many is calibrated for the target recall on rows held out of the fitting.
* A task holds a bounded group of a part's queries with their best rows so far and streams the part's rows past them, so it
  hands on ``k`` rows per query and part. A part of very many rows (or one vector with a third of all rows) is streamed in
  stretches of ``STRETCH_ROWS`` by several tasks. The best of all parts are merged.
* A query probes on beyond the calibrated number of parts until they hold ``k`` rows of other ids.

Scores are exactly rounded double-precision inner products of the original vectors, so equal vectors tie exactly.

Defined results for odd inputs: vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components, and rows without an id, take no part; of several rows of a query id the least vector asks; rows of a
query's own id are no candidates; repeated rows of another id are candidates each; without queries or candidates the result is empty; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backglot.session import ship_package
from backglot.sources.tables import hand_over, scan

SAMPLE_ROWS = 8_000  # vectors that parts and network are fitted on
HELD_SHARE = 5  # one drawn vector of so many is held out of the fitting, for the calibration
PART_SAMPLE = 500  # vectors of the sample that a part is learned from
GROUP_QUERIES = 2_048  # queries that a task holds
STRETCH_ROWS = 1 << 18  # rows that a task streams past them
BLOCK_ROWS = 2_048  # rows ranked at once
TARGET_RECALL = 0.95  # of the calibration
NEIGHBOURS = 10


def usable(vector: Column) -> Column:
    """Whether a vector has finite components throughout, and one that is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of every row, by blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for i in range(0, len(x) if k > 0 else 0, 1024):
        score = x[i : i + 1024] @ x.T
        score[np.arange(len(score)), np.arange(i, i + len(score))] = -np.inf
        out[i : i + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of every vertex; no part gets over 1.1 times its share."""
    part = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), 0, parts)]
    while groups:
        rows, first, share = groups.pop()
        part[rows] = first
        if share > 1:
            y = x[rows] - x[rows].mean(0)
            direction = np.linalg.svd(y[:2000], full_matrices=False)[2][0]
            order = rows[np.argsort(y @ direction, kind="stable")]
            cut = len(rows) * (share // 2) // share
            groups += [(order[:cut], first, share // 2), (order[cut:], first + share // 2, share - share // 2)]
    room = math.ceil(1.1 * len(x) / parts)
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        held = np.zeros((len(x), parts))
        np.add.at(held, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        gain = held - held[np.arange(len(x)), part][:, None]
        best = gain.argmax(1)
        moved = 0
        for v in np.argsort(-gain.max(1), kind="stable"):
            if gain[v, best[v]] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Network with one hidden layer: vector to probabilities of parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, rounds: int = 25):
        draw = np.random.RandomState(4)
        size = x.shape[1]
        self.scale = 1 / (np.sqrt((x**2).mean()) + 1e-12)
        weights = [draw.randn(size, hidden) / np.sqrt(size), np.zeros(hidden), draw.randn(hidden, parts) / np.sqrt(hidden), np.zeros(parts)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        self.weights = weights
        for _ in range(rounds):
            order = draw.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                inner = x[rows] * self.scale
                middle = np.maximum(inner @ weights[0] + weights[1], 0)
                error = self._softmax(middle @ weights[2] + weights[3])
                error[np.arange(len(rows)), part[rows]] -= 1
                error /= len(rows)
                back = (error @ weights[2].T) * (middle > 0)
                step += 1
                for w, a, b, g in zip(weights, first, second, (inner.T @ back, back.sum(0), middle.T @ error, error.sum(0))):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of every row, most probable first."""
        middle = np.maximum(x * self.scale @ self.weights[0] + self.weights[1], 0)
        return np.argsort(-(middle @ self.weights[2] + self.weights[3]), axis=1, kind="stable")


def calibrate(router: Router, x: np.ndarray, k: int, target: float) -> int:
    """Least number of parts that finds ``target`` of the nearest ``k`` among ``x``, by at most 1,000 of its rows."""
    ranked = router.ranked(x)
    place = np.argsort(ranked, axis=1)  # part -> its rank for a row
    asked = np.arange(0, len(x), max(1, len(x) // 1000))
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return ranked.shape[1]
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    needed = np.take_along_axis(place[asked], ranked[top, 0], axis=1).ravel()
    share = np.cumsum(np.bincount(needed, minlength=ranked.shape[1])) / len(needed)
    return int(np.searchsorted(share, target) + 1)


def fit_router(x: np.ndarray, k: int) -> tuple[Router, int, int]:
    """Router, number of parts, and parts to probe: fitted on most of the drawn rows, calibrated on the others alone."""
    held = np.arange(len(x)) % HELD_SHARE == HELD_SHARE - 1
    own = x[~held]
    parts = max(1, len(own) // PART_SAMPLE)
    router = Router(own, balanced_parts(own, nearest(own, NEIGHBOURS), parts), parts)
    return router, parts, calibrate(router, x[held], k, TARGET_RECALL)


def exact(q: np.ndarray, v: np.ndarray) -> float:
    return math.fsum((q * v).tolist())


class BestRows:
    """The nearest rows so far of a group of queries, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-score, id), ascending
        self.least = np.full(len(ids), -np.inf)
        self.reach = np.abs(queries).max(axis=1, initial=0) * queries.shape[1]

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rank a block of rows: by matrix product first, those that may be among the best by exact products."""
        score = self.queries @ rows.T
        score[self.ids[:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (1 + np.abs(rows).max() * self.reach)
        low = self.least.copy()
        if len(ids) > self.k:
            low = np.maximum(low, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        near = (score >= (low - slack)[:, None]) & np.isfinite(score)
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            known: dict[bytes, float] = {}  # equal rows have equal scores: compute each once
            new = []
            for i in np.flatnonzero(near[q]).tolist():
                mark = rows[i].tobytes()
                if mark not in known:
                    known[mark] = exact(self.queries[q], rows[i])
                new.append((-known[mark], int(ids[i])))
            self.found[q] = sorted(self.found[q] + new)[: self.k]
            if len(self.found[q]) == self.k:
                self.least[q] = -self.found[q][-1][0]

    def table(self) -> pa.RecordBatch:
        rows = [(int(q), i, -negative) for q, found in zip(self.ids, self.found) for negative, i in found]
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for every row that satisfies ``is_query``."""
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = given.where(F.col("id").isNotNull() & usable(F.col("v")))
    sample = given.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE_ROWS * HELD_SHARE // (HELD_SHARE - 1)).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return spark.createDataFrame([], schema)
    size = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.array([s for s in sample if len(s) == size], np.float64)
    router, parts, probes = fit_router(x, k)
    shared = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked = shared.value.ranked(_matrix(batch.column("v"))).astype(np.int32)
            routed = pa.array([r if a else r[:0] for r, a in zip(ranked, batch.column("asks").to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(ranked[:, 0]), routed], ["id", "v", "part", "routes"]
            )

    kind = dict(given.dtypes)["v"]
    fit = given.where(F.size("v") == size).withColumn("v", F.col("v").cast("array<double>") if kind != "array<double>" else F.col("v"))
    routed = hand_over(fit.mapInArrow(route, "id long, v array<double>, part int, routes array<int>"), "routed")

    def per_part(rows: DataFrame, of: int) -> tuple[Column, Column]:
        """Counts of rows by part, and how many pieces of ``of`` rows they make, as columns; at most as many as parts."""
        counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        numbered = [F.lit(x) for p in range(parts) for x in (p, counts.get(p, 0))]
        pieces = [F.lit(x) for p in range(parts) for x in (p, max(1, math.ceil(counts.get(p, 0) / of)))]
        return F.create_map(*numbered), F.create_map(*pieces)

    sizes, stretches = per_part(routed, STRETCH_ROWS)
    one = routed.where(F.size("routes") > 0).groupBy("id").agg(F.min(F.struct("v", "routes")).alias("q"), F.count(F.lit(1)).alias("own"))
    upto = lambda m: F.aggregate(F.slice("routes", 1, m), F.lit(0).cast("long"), lambda total, p: total + sizes[p])
    short = F.filter(F.sequence(F.lit(1), F.size("routes")), lambda m: upto(m) < k + F.col("own"))
    probed = F.slice("routes", F.lit(1), F.greatest(F.lit(probes), F.size(short) + 1))
    asks = one.select("id", "q.*", "own").select("id", "v", F.explode(probed).alias("part"))
    asks = hand_over(asks, "asks")
    _, groups = per_part(asks, GROUP_QUERIES)

    every = lambda pieces: F.explode(F.sequence(F.lit(0), pieces[F.col("part")] - 1))
    piece = lambda pieces: F.pmod(F.xxhash64("id", "v"), pieces[F.col("part")]).cast("int")
    asking = asks.select("part", piece(groups).alias("group"), every(stretches).alias("stretch"), "id", "v", F.lit(0).alias("side"))
    rows = routed.select("part", every(groups).alias("group"), piece(stretches).alias("stretch"), "id", "v", F.lit(1).alias("side"))
    # A vector of very many rows falls into stretches by its ids, so stretches stay near STRETCH_ROWS.
    dealt = asking.union(rows).repartition("part", "group", "stretch").sortWithinPartitions("part", "group", "stretch", "side")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, ids, held = None, None, [], []
        for batch in batches:
            v = _matrix(batch.column("v"))
            own, side = batch.column("id").to_numpy(), batch.column("side").to_numpy()
            mark = np.stack([batch.column(c).to_numpy() for c in ("part", "group", "stretch")], axis=1)
            new = np.r_[True, (mark[1:] != mark[:-1]).any(axis=1) | (side[1:] != side[:-1])]
            edges = np.flatnonzero(new)
            for a, b in zip(edges, [*edges[1:], len(mark)]):
                if tuple(mark[a]) != current:
                    if best:
                        yield best.table()
                    current, best, ids, held = tuple(mark[a]), None, [], []
                if side[a] == 0:
                    ids.append(own[a:b])
                    held.append(v[a:b])
                elif ids:
                    best = best or BestRows(np.concatenate(ids), np.concatenate(held), k)
                    for i in range(a, b, BLOCK_ROWS):
                        best.meet(own[i : min(b, i + BLOCK_ROWS)], v[i : min(b, i + BLOCK_ROWS)])
        if best:
            yield best.table()

    found = dealt.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(scan(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
