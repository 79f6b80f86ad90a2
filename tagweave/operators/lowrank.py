"""Low-rank factors of a sparse matrix by randomised block power iteration.

The matrix stays a table of entries. A block of a few hundred columns goes
through it by joins and grouped sums; what the driver sees are the small
products of the block with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.session import drop_stage, stage_table

#: Columns of a block beyond the rank, and entries that a pair of blocks of the similarity has a side.
EXTRA, BLOCK = 10, 1024


def unit_rows(matrix: DataFrame, row: str = "concept", col: str = "feat", value: str = "value") -> DataFrame:
    """(r, c, v): entries divided by the norm of their row; rows of zeros are left out, entries of one place are added."""
    m = matrix.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("v")).where("v <> 0")
    norm = m.groupBy("r").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return m.join(norm, "r").select("r", "c", (F.col("v") / F.col("n")).alias("v"))


def _signs(key: Column, q: int) -> list[Column]:
    """``q`` columns of 1 and -1 that depend on the key alone."""
    words = [F.xxhash64(key, F.lit(i)) for i in range(-(-q // 64))]
    return [F.when(F.shiftright(words[j // 64], j % 64).bitwiseAND(1) == 1, 1.0).otherwise(-1.0) for j in range(q)]


def _through(entries: DataFrame, block: DataFrame, key: str, to: str, q: int) -> DataFrame:
    """(k, y): the matrix (or its transpose) times a block (k, y): one join and ``q`` partial sums."""
    j = entries.join(block.withColumnRenamed("k", key), key)
    sums = j.groupBy(F.col(to).alias("k")).agg(*(F.sum(F.col("v") * F.get("y", F.lit(i))).alias(f"s{i}") for i in range(q)))
    return sums.select("k", F.array(*(f"s{i}" for i in range(q))).alias("y"))


def gram(block: DataFrame, q: int) -> np.ndarray:
    """y'y of a block: a q x q matrix from each task, added up by place."""

    def part(batches):
        g = np.zeros((q, q))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, q)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(q * q)), pa.array(g.ravel())], ["at", "g"])

    got = block.select("y").mapInArrow(part, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()  # q * q rows
    out = np.zeros(q * q)
    for r in got:
        out[r["at"]] = r["g"]
    return out.reshape(q, q)


def times(block: DataFrame, small: np.ndarray) -> DataFrame:
    """(k, y) with each y multiplied by a small matrix, which is broadcast."""
    shared, kind = block.sparkSession.sparkContext.broadcast(np.ascontiguousarray(small)), dict(block.dtypes)["k"]

    def run(batches):
        m = shared.value
        for batch in batches:
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[0]) @ m
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * m.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["k", "y"])

    return block.select("k", "y").mapInArrow(run, f"k {kind}, y array<double>")


def orthonormal(block: DataFrame, q: int) -> tuple[DataFrame, int]:
    """A block with orthonormal columns that span those of ``block``, and how many they are: twice by the eigenvectors of y'y, since once loses digits."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(block, q))
        keep = values > max(values.max(initial=0), 0) * 1e-13
        if not keep.any():
            return times(block, np.zeros((q, 1))), 0
        block = stage_table(times(block, vectors[:, keep] / np.sqrt(values[keep])), "block")
        q = int(keep.sum())
    return block, q


def factors(matrix: DataFrame, rank: int, row: str = "concept", col: str = "feat", value: str = "value", extra: int = EXTRA, powers: int = 4) -> tuple[DataFrame, np.ndarray]:
    """((k, y), values): left singular vectors of the matrix with unit rows, and its largest ``rank`` singular values, descending.

    Random signs of every column give the first block; ``powers`` rounds send
    it through the matrix and back, orthonormal again after each half, and the
    last one is solved as a small eigenvalue problem. With s the singular
    values, the part of the matrix that is missed is at most about
    s[rank + 1] * (1 + tail ** (1 / (2 * powers + 1))), so the rounds make it
    the best for its rank wherever values fall. Fewer values than ``rank`` come
    back where the matrix has fewer. Signs follow the hashes of column names,
    so a result repeats.
    """
    entries = stage_table(unit_rows(matrix, row, col, value), "entries")
    q = rank + extra
    first = entries.groupBy(F.col("r").alias("k")).agg(*(F.sum(F.col("v") * s).alias(f"s{i}") for i, s in enumerate(_signs(F.col("c").cast("string"), q))))
    block, q = orthonormal(stage_table(first.select("k", F.array(*(f"s{i}" for i in range(q))).alias("y")), "block"), q)
    for _ in range(powers):
        if not q:
            break
        back, q = orthonormal(stage_table(_through(entries, block, "r", "c", q), "block"), q)
        drop_stage(block)
        block, q = orthonormal(stage_table(_through(entries, back, "c", "r", q), "block"), q)
        drop_stage(back)
    if not q:
        return block.limit(0), np.zeros(0)
    values, vectors = np.linalg.eigh(gram(_through(entries, block, "r", "c", q), q))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-13 * values.max()]
    out = stage_table(times(block, vectors[:, order]), "factors")
    for t in (block, entries):
        drop_stage(t)
    return out, np.sqrt(values[order])


def similarities(vectors: DataFrame, floor: float = 1e-12) -> DataFrame:
    """(c1, c2, sim), c1 < c2, for the pairs of rows (k, y) whose product is above ``floor``.

    Rows are dealt to blocks of about ``BLOCK``; each pair of blocks is one
    task's product. All pairs are what is asked for, so their number is the
    square of the rows'; ``floor`` says which are written.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    kind = dict(vectors.dtypes)["k"]
    own = vectors.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    packed = own.groupBy("b").agg(F.collect_list(F.struct("k", "y")).alias("rows"))  # about BLOCK rows each
    sides = packed.select(F.col("b").alias("i"), F.col("rows").alias("x")), packed.select(F.col("b").alias("j"), F.col("rows").alias("z"))
    pairs = vectors.sparkSession.range(blocks * blocks).select((F.col("id") / blocks).cast("int").alias("i"), (F.col("id") % blocks).cast("int").alias("j")).where("i <= j").repartition(min(blocks * blocks, 10_000), "i", "j")
    both = pairs.join(sides[0], "i").join(sides[1], "j")

    def run(batches):
        for batch in batches:
            for i, j, x, z in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "z"))):
                a, b = (np.array([r["k"] for r in s]) for s in (x, z))
                s = np.array([r["y"] for r in x]) @ np.array([r["y"] for r in z]).T
                at = (s > floor) & (np.triu(np.ones(s.shape, bool), 1) if i == j else True)
                p, q = np.nonzero(at)
                left, right = a[p], b[q]
                turn = left > right
                low, high = np.where(turn, right, left), np.where(turn, left, right)
                yield pa.RecordBatch.from_arrays([pa.array(low.tolist(), batch.schema.field("x").type.value_type.field("k").type), pa.array(high.tolist(), batch.schema.field("x").type.value_type.field("k").type), pa.array(s[p, q])], ["c1", "c2", "sim"])

    return both.select("i", "j", "x", "z").mapInArrow(run, f"c1 {kind}, c2 {kind}, sim double")


def svd_similarity(matrix: DataFrame, rank: int, row: str = "concept", col: str = "feat", value: str = "value", powers: int = 4) -> DataFrame:
    """(c1, c2, sim), c1 < c2, sim > 0: similarity U S U' from a rank-limited SVD of the row-normalised matrix."""
    u, s = factors(matrix, rank, row, col, value, powers=powers)
    if not len(s):
        return u.select(F.col("k").alias("c1"), F.col("k").alias("c2"), F.lit(0.0).alias("sim"))
    return similarities(times(u, np.diag(np.sqrt(s))))
