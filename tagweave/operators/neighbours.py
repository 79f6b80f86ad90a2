"""Exact nearest neighbours by a pruned join: cells around pivots, and triangle-inequality bounds on which a query has to visit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.session import drop_stage, stage_table

#: Base rows of a block and queries of a chunk, which make one product; the most pivots.
BLOCK_ROWS, CHUNK_ROWS, MAX_PIVOTS = 1000, 500, 1024


def find_pivots(base: DataFrame, n: int, key: str, vec: str, rounds: int = 3) -> np.ndarray:
    """At most ``n`` pivots: means of a bounded sample (16 rows a pivot, by hash of their key) around rows of it."""
    sample = base.orderBy(F.xxhash64(key)).select(F.col(vec).cast("array<double>").alias("v")).limit(16 * n).collect()
    x = np.array([r.v for r in sample], float)
    if not len(x):
        return np.zeros((0, 0))
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    p = x[:n].copy()
    for _ in range(rounds):
        near = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, 1)
        n_own = np.bincount(near, minlength=len(p))
        sums = np.zeros_like(p)
        np.add.at(sums, near, x)
        p = np.where(n_own[:, None] > 0, sums / np.maximum(n_own, 1)[:, None], p)
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :], 0))


def _wide(tau: np.ndarray, scale: float) -> np.ndarray:
    """A little more than a distance between vectors of lengths up to ``scale``: squares are told apart to nine digits and rounded in the last, so nothing that may tie is pruned."""
    return np.sqrt(tau * tau + 1e-8) * (1 + 1e-9) + 1e-7 * (1 + scale)


def nearest_pruned(
    queries: DataFrame, base: DataFrame, k: int, qid: str = "q_id", bid: str = "b_id", vec: str = "vec", n_pivots: int | None = None
) -> tuple[DataFrame, int]:
    """((q_id, b_id, dist, place), pairs compared): the ``k`` nearest base rows of each query by squared distance; equal ones by id.

    Base rows lie in the cell of their nearest pivot. A query first visits the
    nearest cells that hold k rows together, which bounds its k-th distance;
    then every other cell that could hold a nearer row: not those whose ball is
    farther than the bound, nor those beyond the middle between their pivot and
    the query's nearest. Cells are cut into blocks and a cell's visitors into
    chunks, and each pair of these is one product, in which rows whose distance
    to the pivot differs too much from the query's are left out. Nothing is left
    out that could be among the k, so the result is that of all pairs. Rows
    whose vector is null are no one's neighbours and have none.

    Only pivots (at most ``MAX_PIVOTS``) and a few numbers a cell are broadcast.
    """
    spark = base.sparkSession
    q_kind, b_kind = dict(queries.dtypes)[qid], dict(base.dtypes)[bid]
    rows = base.select(F.col(bid), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")
    asked = queries.select(F.col(qid), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")
    schema = f"{qid} {q_kind}, {bid} {b_kind}, dist double, place int"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema), 0
    pivots = find_pivots(rows, n_pivots or max(1, min(MAX_PIVOTS, round(total**0.5))), bid, "vec")
    shared = spark.sparkContext.broadcast(pivots)

    def home(batches):
        p = shared.value
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf.vec.map(np.asarray)).astype(float), p)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell, d=d[np.arange(len(pdf)), cell])

    placed = stage_table(rows.mapInPandas(home, f"{bid} {b_kind}, vec array<double>, cell int, d double"), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far"), F.min("d").alias("close")).collect()  # at most MAX_PIVOTS rows
    size, far, close = np.zeros(len(pivots), np.int64), np.full(len(pivots), -1.0), np.zeros(len(pivots))
    for r in stats:
        size[r["cell"]], far[r["cell"]], close[r["cell"]] = r["n"], r["far"], r["close"]
    cells = spark.sparkContext.broadcast((size, far, close, distances(pivots, pivots)))
    scale = float(np.linalg.norm(pivots, axis=1).max())
    n_blocks = np.maximum(1, -(-size // BLOCK_ROWS))
    many = F.array(*(F.lit(int(b)) for b in n_blocks))
    blocks = placed.withColumn("block", F.pmod(F.xxhash64(bid), F.get(many, F.col("cell"))).cast("int"))
    blocks = stage_table(blocks.groupBy("cell", "block").agg(F.collect_list(F.struct(F.col(bid).alias("id"), "vec", "d")).alias("xs")), "blocks")  # about BLOCK_ROWS each

    def first_cells(d: np.ndarray) -> np.ndarray:
        """For each query which cells it visits first: the nearest, until they hold k rows."""
        size = cells.value[0]
        order = np.argsort(np.where(size > 0, d, np.inf), 1, kind="stable")
        before = np.cumsum(size[order], 1) - size[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (before < k) & (size[order] > 0), 1)
        return out

    def visits(batches, second: bool):
        p = shared.value
        size, far, close, between = cells.value
        for pdf in batches:
            if not len(pdf):
                continue
            d = distances(np.stack(pdf.vec.map(np.asarray)).astype(float), p)
            go = first_cells(d)
            if second:
                tau = _wide(pdf.tau.to_numpy(float), float(np.abs(d).max() + far.max()) + scale)[:, None]
                own = d.argmin(1)
                gap = between[own]
                middle = np.where(gap > 0, (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)
                # rows of a cell are at least as near to its pivot as to any other, so beyond the middle
                could = (size > 0) & (d - far <= tau) & (close - d <= tau) & (middle <= tau)
                go = could & ~go
            q, c = np.nonzero(go)
            if len(q):
                out = pdf.iloc[q].reset_index(drop=True).assign(cell=c, dq=d[q, c])
                yield out if second else out.assign(tau=np.inf)

    visit = f"{qid} {q_kind}, vec array<double>, tau double, cell int, dq double"
    one = visits
    opened = stage_table(asked.mapInPandas(lambda b: (x[[qid, "vec", "tau", "cell", "dq"]] for x in one(b, False)), visit), "visits")
    found, pairs = _products(opened, blocks, n_blocks, k, qid, bid, q_kind, b_kind)
    found = stage_table(found, "found")
    place = F.row_number().over(Window.partitionBy(qid).orderBy("dist", bid))
    tau = found.withColumn("place", place).where(F.col("place") == k).select(qid, F.sqrt("dist").alias("tau"))
    bounded = asked.join(tau, qid, "left").select(qid, "vec", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    again = stage_table(bounded.mapInPandas(lambda b: (x[[qid, "vec", "tau", "cell", "dq"]] for x in one(b, True)), visit), "visits")
    more, others = _products(again, blocks, n_blocks, k, qid, bid, q_kind, b_kind)
    out = stage_table(found.union(more).withColumn("place", place).where(F.col("place") <= k), "nearest")
    for t in (placed, blocks, opened, found, again):
        drop_stage(t)
    return out, pairs + others


def _products(visits: DataFrame, blocks: DataFrame, n_blocks: np.ndarray, k: int, qid: str, bid: str, q_kind: str, b_kind: str) -> tuple[DataFrame, int]:
    """((q_id, b_id, dist) of at least the k nearest in each block, pairs compared) of all visits."""
    spark = visits.sparkSession
    per = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a cell
    chunks = F.array(*(F.lit(max(1, -(-per.get(c, 0) // CHUNK_ROWS))) for c in range(len(n_blocks))))
    many = F.array(*(F.lit(int(b)) for b in n_blocks))
    packed = visits.withColumn("chunk", F.pmod(F.xxhash64(qid), F.get(chunks, F.col("cell"))).cast("int"))
    packed = packed.groupBy("cell", "chunk").agg(F.collect_list(F.struct(F.col(qid).alias("id"), "vec", "dq", "tau")).alias("qs"))  # about CHUNK_ROWS each
    sent = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(many, F.col("cell")) - 1)))
    pairs = sent.select("cell", "block", F.size("qs").alias("a")).join(blocks.select("cell", "block", F.size("xs").alias("b")), ["cell", "block"]).agg(F.sum(F.col("a").cast("long") * F.col("b"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            qs, xs = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                q, x = qs[i].values, xs[i].values
                a, b = (s.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1) for s in (q, x))
                tau = _wide(q.field("tau").to_numpy(zero_copy_only=False), float(np.sqrt(max((a * a).sum(1).max(), (b * b).sum(1).max()))))
                ring = np.abs(q.field("dq").to_numpy(zero_copy_only=False)[:, None] - x.field("d").to_numpy(zero_copy_only=False)[None, :]) <= tau[:, None]
                d = np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0).round(9)
                d[~ring] = np.inf
                kth = min(k, d.shape[1]) - 1
                limit = np.partition(d, kth, axis=1)[:, kth]  # all that tie with the k-th stay
                row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                if len(row):
                    yield pa.RecordBatch.from_arrays([q.field("id").take(pa.array(row)), x.field("id").take(pa.array(col)), pa.array(d[row, col])], [qid, bid, "dist"])

    met = sent.join(blocks, ["cell", "block"]).select("qs", "xs")
    return met.mapInArrow(run, f"{qid} {q_kind}, {bid} {b_kind}, dist double"), pairs
