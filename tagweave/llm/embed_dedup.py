"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Only vectors of one label (and dimension) are compared. Equal vectors become
one before anything else. A label with many vectors is divided into cells by
spherical k-means, a cell that is still large again, level by level, for as long
as that saves work: the number of cells follows the number of vectors. Each
cell's centroids are fitted on a bounded sample of it; every vector is assigned.

Two unit vectors with cosine >= t differ by at most sqrt(2 - 2 t). A vector
whose neighbour may live in another cell lies within that distance of the
hyperplane between the two centroids, so it visits that cell too: each vector
meets all its links in its own cell, and nothing is lost, whatever the level.
How many cells a cell is divided into is chosen on its sample, where the visits
are counted. Cells are compared in blocks of bounded size, each pair of blocks
being a task's work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import components, cut, small_batches, star_forest

#: Vectors of one cell that its centroids are fitted on, centroids of one division, rows of a block, rows that aren't divided any more.
SAMPLE, MAX_CELLS, BLOCK_ROWS, CELL_ROWS = 20_000, 256, 2000, 2000
#: Bytes of centroids that are broadcast at once.
SHARED_BYTES = 64 << 20


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(row_id, vec_id, part, key, unit): label and dimension, digest, and the unit vector as doubles; null where nothing can link."""

    def run(batches):
        for batch in batches:
            part, key, unit = [], [], []
            for vec, label in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = np.array([np.nan if v is None else v for v in vec or []], float)
                largest = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if label is None or not largest:
                    part.append(None), key.append(None), unit.append(None)
                    continue
                if not 1e-100 < largest < 1e100:  # squares would be lost or overflow
                    x = x / largest
                raw = (x / np.linalg.norm(x)).astype("<f8").tobytes()
                part.append(f"{label}|{len(x)}")
                key.append(hashlib.md5(raw).hexdigest())
                unit.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(part, pa.string()), pa.array(key, pa.string()), pa.array(unit, pa.binary())],
                ["row_id", "vec_id", "part", "key", "unit"],
            )

    return rows.mapInArrow(run, "row_id long, vec_id long, part string, key string, unit binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k unit centroids of the unit rows of x; an empty cell is given the row that is farthest from its centroid."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        sim = x @ c.T
        own = sim.argmax(1)
        c = np.zeros_like(c)
        np.add.at(c, own, x)
        norm = np.linalg.norm(c, axis=1)
        empty = np.flatnonzero(norm == 0)
        if len(empty):
            c[empty] = x[np.argsort(sim.max(1), kind="stable")[: len(empty)]]
            norm[empty] = 1
        c /= norm[:, None]
    return c


def gaps(c: np.ndarray) -> np.ndarray:
    """Distances between unit centroids."""
    return np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))


def visits(x: np.ndarray, c: np.ndarray, reach: float, gap: np.ndarray | None = None, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home): each row's nearest cell, and those it comes within ``reach`` of; rows are taken ``step`` at a time."""
    gap, out = gaps(c) if gap is None else gap, []
    for at in range(0, len(x), step):
        sim = x[at : at + step] @ c.T
        own = np.arange(len(sim))
        home = sim.argmax(1)
        go = sim[own, home][:, None] - sim <= (reach + 1e-9) * gap[home] + 1e-12
        go[own, home] = True
        row, cell = np.nonzero(go)
        out.append((row + at, cell, cell == home[row]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def centroids_of(x: np.ndarray, n: int, reach: float) -> np.ndarray | None:
    """Centroids that make comparing cheapest for each row of a cell, of which ``x`` is a sample; None if dividing saves nothing.

    A row is compared with those at home in its cell, ``n`` of them before.
    """
    best, k = (n + 500.0, None), 2
    while k <= MAX_CELLS and k * 16 <= len(x):
        c = spherical_kmeans(x, k)
        rate = len(visits(x, c, reach)[0]) / len(x)
        # compared vectors a row and visit, and what it costs to send a row
        cost = rate * n / k + 500 * rate
        if cost < best[0]:
            best = (cost, c)
        elif k > 16 and cost > 1.5 * best[0]:
            break
        k *= 2
    return best[1]


CELLS = "cell string, home boolean, rep long, n long, unit binary"


def _fitted(rows: DataFrame, reach: float, cell_rows: int) -> DataFrame:
    """(cell, centroids) of the cells of ``rows`` that are worth dividing, each from a sample of its own."""
    large = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("every"), F.count_if("home").alias("many")).where(F.col("many") > cell_rows)
    share = F.lit(SAMPLE) / F.col("every") * (1 << 30)
    sample = rows.select("cell", "rep", "unit").join(large, "cell").where(F.pmod(F.xxhash64("rep", F.length("cell")), F.lit(1 << 30)) < share)

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        x = np.frombuffer(b"".join(part.column("unit").to_pylist()), "<f8").reshape(part.num_rows, -1)
        c = centroids_of(x, part.column("many")[0].as_py(), reach)
        return pa.table({"cell": part.column("cell").slice(0, 0 if c is None else 1), "centroids": pa.array([] if c is None else [c.astype("<f8").tobytes()], pa.binary())})

    return sample.groupBy("cell").applyInArrow(fit, "cell string, centroids binary")


def _assigned(rows: DataFrame, centroids: dict[str, bytes], reach: float) -> DataFrame:
    """CELLS and ``more``: the rows of cells with centroids in the cells below, one at home and one for each visit; others as they are."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), object)
            old = np.array(batch.column(1).to_pylist(), bool)
            units = batch.column(4).to_pylist()
            cell, row, home, more = [], [], [], []
            for name in dict.fromkeys(cells.tolist()):
                at = np.flatnonzero(cells == name)
                if name not in shared.value:
                    row.append(at)
                    cell += [name] * len(at)
                    home.append(old[at])
                    more.append(np.zeros(len(at), bool))
                    continue
                x = np.array([np.frombuffer(units[i], "<f8") for i in at])
                r, k, h = visits(x, np.frombuffer(shared.value[name], "<f8").reshape(-1, x.shape[1]), reach)
                row.append(at[r])
                cell += [f"{name}/{j}" for j in k.tolist()]
                home.append(h & old[at[r]])
                more.append(np.ones(len(r), bool))
            row = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.string()), pa.array(np.concatenate(home)), *(batch.column(i).take(row) for i in (2, 3, 4)), pa.array(np.concatenate(more))],
                ["cell", "home", "rep", "n", "unit", "more"],
            )

    return rows.mapInArrow(run, CELLS + ", more boolean")


def divided(reps: DataFrame, threshold: float, cell_rows: int = CELL_ROWS, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """CELLS of (part, rep, n, unit): each row at home in one cell, and a visitor of those that a link of it could be at home in."""
    reach, names = float(np.sqrt(2 - 2 * threshold)), [c.split()[0] for c in CELLS.split(", ")]
    rows, done = reps.select(F.col("part").alias("cell"), F.lit(True).alias("home"), "rep", "n", "unit"), []
    while True:
        fitted = cut(_fitted(rows, reach, cell_rows), "centroids")
        size = fitted.agg(F.coalesce(F.sum(F.octet_length("centroids")), F.lit(0))).first()[0]
        if not size:
            break
        waves = -(-size // shared_bytes)
        wave, parts = F.pmod(F.xxhash64("cell"), F.lit(waves)), []
        for w in range(waves):  # about shared_bytes of centroids each
            centroids = {r["cell"]: r["centroids"] for r in fitted.where(wave == w).collect()}
            parts.append(_assigned(rows.where(wave == w), centroids, reach))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        out = cut(out, "cells")
        done.append(out.where("not more").select(*names))
        rows = out.where("more").select(*names)
    for part in done:
        rows = rows.union(part)
    return rows


def _compare(threshold: float):
    def run(part: pa.Table) -> pa.Table:
        """Links of the rows at home in one block with all rows of another: counts, and stars that connect them."""
        side = part.column("side").to_numpy()
        rep, n = part.column("rep").to_numpy(), part.column("n").to_numpy()
        x = np.frombuffer(b"".join(part.column("unit").to_pylist()), "<f8").reshape(part.num_rows, -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, left, right = [np.zeros(0, np.int64)], [], []
        for at in range(0, len(a), 512):
            some = a[at : at + 512]
            near = x[some] @ x[b].T >= threshold
            near &= rep[some][:, None] != rep[b][None, :]
            links.append(near @ n[b])
            i, j = np.nonzero(near)
            p, q = star_forest(rep[some][i], rep[b][j])
            left.append(p), right.append(q)
        p, q = star_forest(np.concatenate(left), np.concatenate(right)) if left else (rep[:0], rep[:0])
        links = np.concatenate(links)
        got = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(np.concatenate([rep[a][got], p]), pa.int64()),
                "b": pa.array([*[None] * len(got), *q.tolist()], pa.int64()),
                "n": pa.array([*links[got].tolist(), *[None] * len(p)], pa.int64()),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are null, zero or hold null or non-finite components, and
    those without a label, link with nothing. A row that repeats another one
    counts as a vector of its own, and so do different vectors with one id:
    rows are told apart by themselves, ids only name them. Vectors without an
    id link others all the same; a component without any id has a null one.
    Vectors equal up to length tie and link. Other columns, whatever their
    names, are left aside; an empty table gives an empty one.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("string").alias("label"),
    )
    units = cut(unit_vectors(rows), "units")
    # of equal vectors the first row stands for all
    reps = cut(
        units.where("key is not null")
        .groupBy("part", "key")
        .agg(F.min("row_id").alias("rep"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")),
        "reps",
    )
    sent = cut(divided(reps, threshold, cell_rows), "sent")
    blocks = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    placed = sent.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cols = ["cell", "rep", "n", "unit"]
    home = placed.where("home").select(*cols, F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(every).alias("j"))
    all_ = placed.select(*cols, F.lit(1).alias("side"), F.explode(every).alias("i"), F.col("own").alias("j"))
    found = home.union(all_).groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "a long, b long, n long")
    found = cut(found, "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    classes = (
        reps.select("part", "key", "rep", "low", "n")
        .join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    classes = cut(classes.select("part", "key", "low", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes")
    # components are named by their smallest vec_id
    names = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(names, "root").select("part", "key", "n_links", "component_id")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        units.select("vec_id", "part", "key")
        .join(classes, ["part", "key"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )
