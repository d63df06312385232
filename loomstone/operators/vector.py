"""Exact and approximate nearest neighbours, kNN and range joins, and the vector table's upkeep."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.vectors import metric, vector_literal
from loomstone.session import shared_folder

#: Queries of a batch join that go to all executors at once.
QUERY_BLOCK = 4096
#: Vectors, and queries, of a tile: a task of a join holds TILE x TILE distances at a time, whatever the sizes of blocks and batches.
TILE = 512


def search(vectors: DataFrame, query, k: int, name: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest: id, distance, score (1 - distance), nearest first, ties by id."""
    d = metric(name)(F.col(vector_col), vector_literal(query))
    keep = [c for c in vectors.columns if c not in ("distance", "score")]
    return vectors.select(*keep, d.alias("distance")).where("distance IS NOT NULL").withColumn("score", 1 - F.col("distance")).orderBy("distance", id_col).limit(k)


def _metric_block(name: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    if name in ("l2", "euclidean"):
        return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * v @ q.T))
    if name in ("dot", "dotproduct"):
        return -(v @ q.T)
    norms = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
    return np.where(norms == 0, 1.0, 1 - np.divide(v @ q.T, norms, out=np.zeros_like(norms), where=norms != 0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with that row of b, summed in the order of components: unlike those of a matrix product the last bits do not depend on the shape, so equal vectors are equally far."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _metric_pairs(name: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of v to that row of q."""
    out = np.empty(len(v))
    step = max(1, TILE * TILE // max(1, v.shape[1]))
    for at in range(0, len(v), step):
        a, b = v[at : at + step], q[at : at + step]
        if name in ("l2", "euclidean"):
            x = np.sqrt(_dots(a - b, a - b))
        elif name in ("dot", "dotproduct"):
            x = -_dots(a, b)
        else:
            norms = np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b))
            x = np.where(norms == 0, 1.0, 1 - np.divide(_dots(a, b), norms, out=np.zeros_like(norms), where=norms != 0))
        out[at : at + step] = x
    return out


def _noise(name: str, v: np.ndarray, q: np.ndarray, d):
    """How far a distance d of _metric_block may be off that of _metric_pairs, generously: for each query."""
    vv, qq = (v * v).sum(1).max(initial=0), (q * q).sum(1)
    if name in ("l2", "euclidean"):
        return np.sqrt(np.square(d) + 1e-10 * (vv + qq)) - d
    return 1e-10 * np.sqrt(vv * qq) if name in ("dot", "dotproduct") else np.full(len(q), 1e-10)


def _first(group: np.ndarray) -> np.ndarray:
    """The place of each row within its group, of sorted groups."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))


class _Best:
    """The k nearest of each query so far, in arrays of queries by k."""

    def __init__(self, name: str, q: np.ndarray, k: int):
        self.name, self.q, self.k = name, q, k
        self.dist, self.ids, self.n = np.full((len(q), k), np.inf), np.empty((len(q), k), object), np.zeros(len(q), int)

    def add(self, at: np.ndarray, v: np.ndarray, who: np.ndarray) -> None:
        """A tile of vectors, v of ids at, for a tile of queries."""
        d = _metric_block(self.name, v, self.q[who])
        # Of each query only what is no farther than the k-th of these rows and of those before can be among its k.
        limit = np.nan_to_num(self.dist[who, -1], nan=np.inf, posinf=np.inf, neginf=-np.inf)
        if len(d) > self.k:
            limit = np.fmin(limit, np.partition(d, self.k - 1, axis=0)[self.k - 1])
        known = np.isfinite(limit)
        limit[known] += _noise(self.name, v, self.q[who[known]], limit[known])
        r, c = np.nonzero(~(d > limit))
        if len(r):
            # A query that meets very many candidates (vectors of one direction) takes them piece by piece.
            step = TILE * TILE // 4
            for i in range(0, len(r), step):
                self._merge(at, v, r[i : i + step], who[c[i : i + step]])

    def _merge(self, at: np.ndarray, v: np.ndarray, r: np.ndarray, j: np.ndarray) -> None:
        x = np.concatenate([_metric_pairs(self.name, v[r[i : i + TILE]], self.q[j[i : i + TILE]]) for i in range(0, len(r), TILE)])
        old = np.unique(j)
        before = np.arange(self.k) < self.n[old][:, None]
        j = np.concatenate([np.repeat(old, self.n[old]), j])
        x, ids = np.concatenate([self.dist[old][before], x]), np.concatenate([self.ids[old][before], at[r]])
        order = np.lexsort((ids.astype(at.dtype), x, j))
        j = j[order]
        rank = _first(j)
        keep = rank < self.k
        j, rank, order = j[keep], rank[keep], order[keep]
        self.dist[j, rank], self.ids[j, rank] = x[order], ids[order]
        self.n[old] = np.bincount(j, minlength=len(self.n))[old]


def _few_of_equals(at: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows beyond the k smallest ids of each vector, which are as far as those from any query."""
    if not v.shape[1]:
        return at, v
    same = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((at, same))
    keep = order[_first(same[order]) < k]
    return at[keep], v[keep]


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, name: str = "cosine", id_col: str = "id", vector_col: str = "vector", probed=None) -> DataFrame:
    """For each query its k nearest vectors: query_id, id, distance, rank.

    Queries are a stated set; blocks of QUERY_BLOCK go to all executors, each partition keeps its k best for each query, and only those are shuffled.
    A task holds a tile of distances at a time.
    probed: from the matrix of queries to a truth table (query, cell); then a query meets only the vectors whose column cell it marks."""
    spark = queries.sparkSession
    numbered = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).cast("array<double>").alias("q")).where("q IS NOT NULL")
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    kind = dict(queries.dtypes)[id_col]
    schema = f"query_id {kind}, id {dict(vectors.dtypes)[id_col]}, distance double"
    out = None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = part.orderBy("qid").toPandas()
        q = np.array(rows["q"].tolist(), dtype=np.float64)
        shared = spark.sparkContext.broadcast((rows["qid"].to_numpy(), q, probed(q) if probed and len(q) else None))

        def best(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, q, asks = shared.value
            found = _Best(name, q, k)
            for pdf in frames:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf) or not len(qid):
                    continue
                for cell, some in pdf.groupby("cell") if asks is not None else [(None, pdf)]:
                    who = np.arange(len(qid)) if cell is None else np.flatnonzero(asks[:, cell])
                    for i in range(0, len(some) if len(who) else 0, TILE):
                        rows = some[i : i + TILE]
                        at, v = _few_of_equals(rows["id"].to_numpy(), np.array(rows["v"].tolist(), dtype=np.float64), k)
                        for c in range(0, len(who), TILE):
                            found.add(at, v, who[c : c + TILE])
            for i in range(0, len(qid), TILE):
                j, rank = np.nonzero(np.arange(k) < found.n[i : i + TILE, None])
                yield pd.DataFrame({"query_id": qid[i + j], "id": found.ids[i + j, rank], "distance": found.dist[i + j, rank]})

        found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *["cell"] * bool(probed)).mapInPandas(best, schema)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def range_join(queries: DataFrame, vectors: DataFrame, limit: float, name: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """All (query_id, id, distance) within a distance, for a stated set of queries sent out in blocks. A task holds a tile of distances at a time."""
    spark = queries.sparkSession
    numbered = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).cast("array<double>").alias("q")).where("q IS NOT NULL")
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    schema = f"query_id {dict(queries.dtypes)[id_col]}, id {dict(vectors.dtypes)[id_col]}, distance double"
    out = None
    for b in range(blocks):
        rows = (numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toPandas()
        shared = spark.sparkContext.broadcast((rows["qid"].to_numpy(), np.array(rows["q"].tolist(), dtype=np.float64)))

        def near(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            for pdf in frames:
                pdf = pdf[pdf["v"].notna()]
                for at in range(0, len(pdf) if len(qid) else 0, TILE):
                    some = pdf[at : at + TILE]
                    ids, v = some["id"].to_numpy(), np.array(some["v"].tolist(), dtype=np.float64)
                    for c in range(0, len(q), TILE):
                        d = _metric_block(name, v, q[c : c + TILE])
                        i, j = np.nonzero(d <= limit)
                        if len(i):
                            yield pd.DataFrame({"query_id": qid[c + j], "id": ids[i], "distance": d[i, j]})

        found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(near, schema)
        out = found if out is None else out.unionByName(found)
    return out


def upsert(vectors: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of new, and those of vectors whose id new does not have."""
    return vectors.join(new.select(id_col), id_col, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(vectors: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    return vectors.where(~F.col(id_col).isin(ids))


def check_dimension(vectors: DataFrame, dim: int, vector_col: str = "vector") -> None:
    bad = vectors.where(F.size(vector_col) != dim).limit(1).collect()
    if bad:
        raise ValueError(f"dimension mismatch: {dim} expected, {len(bad[0][vector_col])} given")


class IvfIndex:
    """Approximate search: k-means cells fitted on a bounded sample, every vector stored in the folder of its nearest cell, nearest cells probed and ranked exactly.

    A search reads the folders of the cells it probes and no others. Vectors that are null are in no cell."""

    #: Vectors that the fit uses at most: those of smallest hash.
    SAMPLE = 20_000

    def __init__(self, vectors: DataFrame, cells: int = 32, name: str = "cosine", id_col: str = "id", vector_col: str = "vector", rounds: int = 8, path: str | None = None):
        """path: where the cells are stored, by default in the shared folder."""
        self.name, self.id_col, self.vector_col = name, id_col, vector_col
        sample = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("v")).limit(self.SAMPLE).toPandas()
        v = np.array(sample["v"].tolist(), dtype=np.float64)
        if name == "cosine":
            v = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None]
        centers = v[: min(cells, len(v))].copy()
        for _ in range(rounds):
            own = _metric_block("l2", v, centers).argmin(1)
            for c in range(len(centers)):
                if (own == c).any():
                    centers[c] = v[own == c].mean(0)
        self.centers = centers
        spark = vectors.sparkSession
        self.path = path or f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
        points = F.array(*[F.struct(cell.alias("d"), F.lit(i).alias("cell")) for i, cell in enumerate(metric(name)(F.col(vector_col), vector_literal(c)) for c in centers)])
        cell = F.array_min(points)["cell"] if len(centers) else F.lit(0)
        placed = vectors.where(F.col(vector_col).isNotNull()).withColumn("cell", cell)
        placed.write.partitionBy("cell").parquet(self.path)
        self.table = spark.read.schema(placed.schema).parquet(self.path)

    def _nearest(self, q: np.ndarray, probes: int) -> np.ndarray:
        """For each query the cells to probe, nearest first."""
        return _metric_block(self.name, self.centers, q).argsort(axis=0, kind="stable")[:probes].T

    def search(self, query, k: int, probes: int = 8) -> DataFrame:
        near = self._nearest(np.array([query], dtype=np.float64), probes)[0] if len(self.centers) else []
        return search(self.table.where(F.col("cell").isin([int(c) for c in near])), query, k, self.name, self.id_col, self.vector_col).drop("cell")

    def join(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """knn_join in the probed cells: query_id, id, distance, rank."""

        def probed(q: np.ndarray) -> np.ndarray:
            out = np.zeros((len(q), len(self.centers)), dtype=bool)
            np.put_along_axis(out, self._nearest(q, probes), True, axis=1)
            return out

        return knn_join(queries, self.table, k, self.name, self.id_col, self.vector_col, probed if len(self.centers) else None)

    def recall(self, queries: DataFrame, k: int, probes: int = 8) -> float:
        """The share of the k nearest by brute force that the index finds."""
        exact = knn_join(queries, self.table, k, self.name, self.id_col, self.vector_col).select("query_id", "id")
        found = exact.join(self.join(queries, k, probes).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
        return found.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
