"""Exact metric range join of embeddings.

The distance is the chord between unit vectors, so cosine >= t is distance <= r = sqrt(2 - 2 t). Each large label draws pivots from its own
vectors, one for every CELL vectors or so; a small one is a single cell. A vector's home is the cell of its nearest pivot; by the triangle inequality a partner of
a vector at home in cell i is at distance d(p_i) <= d(p_home) + 2 r, and, as chords are lengths in space, it is no farther than r behind the plane
between p_i and p_home. It is sent as a guest to every cell i that both bounds allow. Cells join independently. A cell of many vectors is cut into blocks that meet in pairs, so no task gets a whole one; within
a meeting, vectors are ordered by their distance to the pivot and only slices that lie within r of each other are multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components, forest

#: Fixed value: the least cosine of a link.
COSINE = 0.98
#: Vectors for each pivot, pivots of a label at most, and vectors of a block.
CELL, PIVOTS, BLOCK = 2000, 256, 1500
#: Bounds of what goes to the driver and all executors: labels with pivots (the largest), bytes of all pivots, rows of a table of cells. Labels beyond are one cell each, and a larger table is shuffled.
LABELS, PIVOT_BYTES, CELLS = 10_000, 1 << 24, 200_000
#: Bytes of vectors that a batch takes or gives.
BATCH_BYTES = 1 << 23
#: Room for rounding in the bounds (of a root near zero above all); the test itself has none.
SLACK = 1e-7


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    v = np.array(rows, dtype=np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v, n


def usable(embedding: str) -> F.Column:
    """Vectors that link with others: not null, of finite components, not zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)


def _pivots(rows: DataFrame) -> dict:
    """label and dimension -> unit pivots, of the largest labels: drawn from the vectors of smallest hash, as many as the label's size asks for, PIVOTS at most and PIVOT_BYTES of all."""
    size = rows.groupBy("label", "dim").agg(F.count("*").alias("size"))
    asked, left = [], PIVOT_BYTES
    for r in size.where(F.col("size") >= 2 * CELL).orderBy(F.desc("size"), "label", "dim").limit(LABELS).collect():
        n = min(PIVOTS, r["size"] // CELL, left // (8 * r["dim"]))
        if n > 1:
            left -= 8 * r["dim"] * n
            asked.append((r["label"], r["dim"], n, max(1, r["size"] // (8 * n))))
    if not asked:
        return {}
    # About 8 n vectors of each label, by hash, of which the 2 n of smallest hash are looked at.
    wanted = F.broadcast(rows.sparkSession.createDataFrame(asked, "label string, dim int, n int, every long"))
    sampled = rows.join(wanted, ["label", "dim"]).where(F.pmod(F.xxhash64("id"), F.col("every")) == 0)
    top = sampled.select("label", "dim", "n", F.struct(F.xxhash64("id").alias("h"), "id", "v").alias("x")).groupBy("label", "dim", "n").agg(F.array_sort(F.collect_list("x")).alias("x"))
    out = {}
    for r in top.select("label", "dim", "n", F.slice("x", F.lit(1), 2 * F.col("n")).alias("x")).collect():
        v, norm = _unit([x["v"] for x in r["x"]])
        v = v / norm[:, None]
        # Farthest-first, so that near copies do not take several pivots.
        chosen = [0]
        far = 2 - 2 * v @ v[0]
        while len(chosen) < min(r["n"], len(v)):
            nxt = int(far.argmax())
            if far[nxt] <= 1e-12:
                break
            chosen.append(nxt)
            far = np.minimum(far, 2 - 2 * v @ v[nxt])
        out[r["label"], r["dim"]] = v[chosen]
    return out


def _cells_of(batches, pivots: dict, r: float):
    """For vectors of one label and length at a time: batch, label, dim, their rows in it, and row, cell, whether at home there, distance to its pivot, for each cell they go to."""
    gaps: dict = {}
    for whole in batches:
        if not whole.num_rows:
            continue
        step = max(1, min(2000, BATCH_BYTES * whole.num_rows // (8 * max(1, pc.sum(whole.column("dim")).as_py()))))
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            keys: dict = {}
            for i, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                keys.setdefault(k, []).append(i)
            for (label, dim), rows in keys.items():
                take = pa.array(rows)
                v, norm = _unit(batch.column("v").take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
                p = pivots.get((label, dim))
                if p is None:  # one cell; its pivot may be any unit vector
                    p = np.full((1, dim), dim**-0.5)
                if (label, dim) not in gaps:
                    if len(gaps) > 1000:
                        gaps.clear()
                    gaps[label, dim] = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                d2 = np.maximum(0, 2 - 2 * (v / norm[:, None]) @ p.T)
                d, home = np.sqrt(d2), d2.argmin(axis=1)
                near = d[np.arange(len(rows)), home]
                goes = d <= near[:, None] + 2 * r + SLACK
                # The distance behind the plane between two pivots is (d_i^2 - d_home^2) / (2 gap).
                goes &= d2 - (near**2)[:, None] <= 2 * r * gaps[label, dim][home] + SLACK
                row, cell = np.nonzero(goes)
                yield batch, label, dim, take, row, cell, home[row] == cell, d[row, cell]


def linked(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs reach the cosine, in double precision; what rounding could turn is worked out anew, one pair at a time."""
    cos = (a @ b.T) / np.outer(na, nb)
    ok = cos >= cosine
    for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):
        ok[i, j] = float(np.dot(a[i], b[j])) / (float(na[i]) * float(nb[j])) >= cosine
    return ok


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) of linked vectors, and links (a, b) that join the same vectors as all links do."""
    spark = vectors.sparkSession
    r = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col)).select(
        F.xxhash64(id_col, vector_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.size(vector_col).alias("dim"), F.col(vector_col).cast("array<double>").alias("v")
    )
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["row", "label"])
    rows = checkpointed(rows)
    pivots = spark.sparkContext.broadcast(_pivots(rows))

    def place(batches):
        for batch, label, dim, take, row, cell, own, far in _cells_of(batches, pivots.value, r):
            step = max(1, BATCH_BYTES // (8 * dim))
            for at in range(0, len(row), step):
                part = slice(at, at + step)
                out, n = take.take(pa.array(row[part])), len(row[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * n, pa.string()), pa.array([dim] * n, pa.int32()), pa.array(cell[part], pa.int32()), pa.array(own[part]), pa.array(far[part]), batch.column("id").take(out), batch.column("v").take(out)],
                    names=["label", "dim", "cell", "own", "far", "id", "v"],
                )

    def sizes(batches):
        for _, label, dim, _, _, cell, own, _ in _cells_of(batches, pivots.value, r):
            cells, n = np.unique(cell, return_counts=True)
            at_home = np.bincount(cell[own], minlength=cells[-1] + 1)[cells]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(cells), pa.string()), pa.array([dim] * len(cells), pa.int32()), pa.array(cells, pa.int32()), pa.array(at_home, pa.int64()), pa.array(n, pa.int64())], names=["label", "dim", "cell", "home", "n"])

    placed = rows.mapInArrow(place, "label string, dim int, cell int, own boolean, far double, id long, v array<double>")
    # Blocks of a cell's own vectors (x) and of all that are there (y): ranges of the distance to the pivot would be uneven, so a hash of the id deals them out. Cells not listed are one block.
    blocks = lambda n: F.ceil(F.sum(n) / BLOCK).cast("int")
    big = checkpointed(rows.mapInArrow(sizes, "label string, dim int, cell int, home long, n long").groupBy("label", "dim", "cell").agg(blocks("home").alias("xs"), blocks("n").alias("ys")).where("ys > 1"))
    placed = placed.join(F.broadcast(big) if big.count() <= CELLS else big, ["label", "dim", "cell"], "left").withColumns({"xs": F.greatest(F.lit(1), "xs"), "ys": F.greatest(F.lit(1), "ys")})
    # Meeting (x, y): the vectors at home in block x of the cell against all of block y; a vector is sent to all meetings of its blocks.
    x, y = F.pmod(F.hash("id"), F.col("xs")), F.pmod(F.hash("id"), F.col("ys"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: F.struct(i.alias("x"), y.alias("y"), F.lit(False).alias("first")))
    as_own = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda i: F.struct(x.alias("x"), i.alias("y"), F.lit(True).alias("first")))
    met = placed.withColumn("m", F.explode(F.when(F.col("own"), F.concat(as_any, as_own)).otherwise(as_any))).select("label", "dim", "cell", "m.x", "m.y", "m.first", "far", "id", "v")
    met = met.groupBy("label", "dim", "cell", "x", "y").applyInArrow(_meeting(r, cosine), "kind int, a long, b long")
    met = checkpointed(met)
    counts = met.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n_links"))
    return counts, met.where("kind = 1").select("a", "b")


def _meeting(r: float, cosine: float):
    def run(key, table):
        table = table.combine_chunks().sort_by("far")
        first = table["first"].to_numpy(zero_copy_only=False).astype(bool)
        ids, far = table["id"].to_numpy(), table["far"].to_numpy()
        dim = key[1].as_py()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        out_kind, out_a, out_b = [], [], []
        tally: dict[int, int] = {}
        links_a: list[int] = []
        links_b: list[int] = []
        for at in range(0, len(a), 256):
            rows = a[at : at + 256]
            lo = np.searchsorted(far[b], far[rows[0]] - r - SLACK)
            hi = np.searchsorted(far[b], far[rows[-1]] + r + SLACK, side="right")
            cols = b[lo:hi]
            if not len(cols):
                continue
            ok = linked(v[rows], norm[rows], v[cols], norm[cols], cosine)
            # Every vector at home meets each of its partners in its own cell just once, as the partner is there at home or as a guest.
            ok &= ids[rows][:, None] != ids[cols][None, :]
            n = ok.sum(axis=1)
            for i in np.flatnonzero(n):
                tally[int(ids[rows[i]])] = tally.get(int(ids[rows[i]]), 0) + int(n[i])
            i, j = np.nonzero(ok)
            if len(i):
                x, y = forest(ids[rows[i]].tolist() + links_a, ids[cols[j]].tolist() + links_b)
                links_a, links_b = x, y
        out_kind = [0] * len(tally) + [1] * len(links_a)
        out_a, out_b = [*tally, *links_a], [*tally.values(), *links_b]
        return pa.table({"kind": pa.array(out_kind, pa.int32()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept.

    Vectors of different labels or lengths never link; null, zero or not finite vectors and null labels stand alone. Rows that repeat an id count as one vector
    if they are equal, and rows of one id are never partners; ids are long numbers, and rows of a null id stand alone (no component, kept). Other columns are not read."""
    counts, links = embedding_links(vectors, id_col, vector_col, label_col, cosine)
    groups = components(links)
    out = vectors.select(id_col).join(counts.withColumnRenamed("id", "_n"), F.col(id_col) == F.col("_n"), "left").join(groups, F.col(id_col) == F.col("node"), "left")
    component = F.coalesce("component", F.col(id_col).cast("long"))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))
