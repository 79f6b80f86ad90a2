"""Shared plumbing: stage tables in the shared folder, text helpers, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every byte that is not part of a word becomes a blank, A-Z become a-z.
#: Words are runs of 0-9, a-z and bytes of characters from U+0080 on.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of one Arrow batch; documents can be long, so batches are kept small.
BATCH_BYTES = 8 << 20


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; null has none."""
    if not text:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.translate(WORD_BYTES).split()


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that one Arrow batch holds; the session keeps the limit, which no other query minds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        spark.conf.set("spark.checkpoint.dir", where) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the
    stages before, and whatever reads the table twice computes it once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tagweave_path = path
    _WRITTEN.append(out)
    return out


#: Tables that ``cut`` wrote and nobody has deleted yet.
_WRITTEN: list[DataFrame] = []


def written() -> int:
    """A mark for ``release``: how many tables there are."""
    return len(_WRITTEN)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since a mark but ``keep``: once a result is stored, what it was made from can go."""
    for df in _WRITTEN[since:]:
        if df is not keep:
            drop(df)


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more."""
    path = getattr(df, "_tagweave_path", None)
    _WRITTEN[:] = [d for d in _WRITTEN if d is not df]
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_in(keys: DataFrame, group: str, cell_rows: int) -> DataFrame:
    """``keys`` with ``rank`` from 0 within each ``group``, by all columns in their order (the group comes first).

    Rows are range-partitioned by all columns, so neither a group that holds
    most rows nor equal values meet in one task; ranks are the rows of a group
    in the ranges before and a row number within the range.
    """
    total = keys.count()
    parts = max(1, -(-total // cell_rows))
    ranged = cut(keys.repartitionByRange(parts, *keys.columns).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy(group, "range").orderBy(*keys.columns)
    return ranged.withColumn("rn", F.row_number().over(own)).join(counts, [group, "range"]).select(
        *keys.columns, (F.col("before") + F.col("rn") - 1).cast("long").alias("rank")
    )


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the same components as the edges (a, b)."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, root), root the least node.

    Alternates large-star and small-star rounds (Kiveris et al. 2014): every
    round is two grouped minima and two joins, so no node's neighbours are ever
    gathered in one place, and each round's edges are written to the shared
    folder. Nodes without edges aren't returned. Nulls are ignored.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        stat = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if stat == seen or not stat[0]:
            break
        seen = stat
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).union(now.select("v", "u"))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        large = cut(large, "large")
        root = large.groupBy("u").agg(F.min("v").alias("r"))
        moved = large.join(root, "u").where("v <> r").select(F.col("v").alias("u"), F.col("r").alias("v"))
        new = cut(moved.union(root.select("u", F.col("r").alias("v"))).distinct(), "edges")
        drop(large)
        drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
