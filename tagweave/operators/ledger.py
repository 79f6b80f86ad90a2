"""Counts that shards are merged into once, however often they arrive.

A store is a folder of numbered versions; each holds the counts so far and a
ledger with a digest of every shard in them. A merge leaves out shards that the
ledger has, writes the next version whole, and names it in the file ``CURRENT``
by one rename. A merge that is cut short leaves the version before in force, and
a repeated one finds its shards in the ledger, so counts are the same whether a
shard is merged once, again, or by a job that was run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions behind the current one that are kept for readers.
KEEP = 2


def digests(shards: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, digest): equal for shards with the same rows, in whatever order and files; repeated rows count.

    The number of rows and two sums of 64-bit hashes of each row, so that a
    shard is digested by partial sums and never gathered.
    """
    rows = F.struct(*sorted(c for c in shards.columns if c != shard))
    one = lambda salt: F.sum(F.xxhash64(rows, F.lit(salt)).cast("decimal(38,0)"))
    text = F.concat_ws(":", F.count(F.lit(1)).cast("string"), one(1).cast("string"), one(2).cast("string"))
    return shards.groupBy(F.col(shard).alias("shard")).agg(text.alias("digest"))


class CountStore:
    """Counts by ``keys`` in a folder that all machines share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], count: str = "freq", kinds: list[str] | None = None):
        self.spark, self.path, self.keys, self.count = spark, path.rstrip("/"), keys, count
        kinds = kinds or ["string"] * len(keys)
        self.schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds)) + f", `{count}` long"

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first merge."""
        at, files = self._at("CURRENT")
        if not files.exists(at):
            return 0
        stream = files.open(at)
        try:
            return int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def counts(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}/counts") if v else self.spark.createDataFrame([], self.schema)

    def ledger(self) -> DataFrame:
        """(digest, shard, merged_in) of every shard in the counts."""
        v, schema = self.version(), "digest string, shard string, merged_in long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{v}/ledger") if v else self.spark.createDataFrame([], schema)

    def merge(self, shards: DataFrame, shard: str = "shard") -> int:
        """Add the counts of the shards (shard, keys, count) that aren't in yet; returns how many these are.

        Of shards with the same rows one is merged, under its least name. Rows
        without a shard name are one shard. Null counts add nothing.
        """
        rows = shards.select(F.coalesce(F.col(shard).cast("string"), F.lit("")).alias("shard"), *self.keys, F.col(self.count).cast("long").alias(self.count))
        version = self.version()
        new = digests(rows).groupBy("digest").agg(F.min("shard").alias("shard")).join(self.ledger().select("digest"), "digest", "left_anti")
        old, old_ledger = self.counts(), self.ledger()
        folder = f"{self.path}/v{version + 1}"
        # an earlier merge that was cut short may have left files here
        new.select("digest", "shard", F.lit(version + 1).cast("long").alias("merged_in")).write.mode("overwrite").parquet(f"{folder}/new")
        new = self.spark.read.schema("digest string, shard string, merged_in long").parquet(f"{folder}/new")
        n = new.count()
        if not n:
            return 0
        added = rows.join(new.select("shard"), "shard", "left_semi").select(*self.keys, self.count)
        merged = old.union(added).groupBy(*self.keys).agg(F.coalesce(F.sum(self.count), F.lit(0)).alias(self.count))
        merged.write.mode("overwrite").parquet(f"{folder}/counts")
        old_ledger.union(new).write.mode("overwrite").parquet(f"{folder}/ledger")
        self._point_at(version + 1)
        return n

    def _point_at(self, version: int) -> None:
        temporary, files = self._at(f"CURRENT.{version}")
        stream = files.create(temporary, True)
        stream.write(bytearray(str(version).encode()))
        stream.close()
        current, _ = self._at("CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(temporary, current, options)
        at, files = self._at(f"v{version - KEEP}")
        if version > KEEP:
            files.delete(at, True)


def merge_stream(stream: DataFrame, store: CountStore, checkpoint: str, shard: str = "shard"):
    """Merge the shards of a stream as they come; a batch that is run again, or a shard sent again, changes nothing.

    A shard has to arrive within one batch, as the rows of one file do.
    """
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.merge(batch, shard)).start()
