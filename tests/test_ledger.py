import pytest
from pyspark.sql import functions as F

from tagweave.operators import ledger

ROWS = [("s1", "a", "b", 2), ("s1", "a", "c", 1), ("s2", "a", "b", 5), ("s3", "x", None, 1), ("s3", "x", None, 1)]
SCHEMA = "shard string, w1 string, w2 string, freq long"


def store(spark, path):
    return ledger.CountStore(spark, f"file://{path}", ["w1", "w2"])


def counts(s):
    return sorted((tuple(r) for r in s.counts().collect()), key=repr)


def test_shards_count_once(spark, tmp_path):
    s = store(spark, tmp_path / "store")
    assert s.version() == 0 and counts(s) == [] and s.ledger().collect() == []
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert s.merge(df) == 3
    want = [("a", "b", 7), ("a", "c", 1), ("x", None, 2)]
    assert counts(s) == want
    # again: as it was, in another order and other files, under another name, and next to a new one
    assert s.merge(df) == 0 and s.merge(df.orderBy(F.desc("freq")).repartition(3)) == 0
    assert s.merge(df.withColumn("shard", F.concat("shard", F.lit("-copy")))) == 0 and counts(s) == want and s.version() == 1
    more = df.union(spark.createDataFrame([("s4", "a", "b", 1), ("s5", "a", "b", 1), (None, "n", "n", None)], SCHEMA))
    assert s.merge(more) == 2 and counts(s) == [("a", "b", 8), ("a", "c", 1), ("n", "n", 0), ("x", None, 2)]
    assert sorted((r.shard, r.merged_in) for r in s.ledger().collect()) == [("", 2), ("s1", 1), ("s2", 1), ("s3", 1), ("s4", 2)]


def test_a_merge_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path / "store")
    s.merge(spark.createDataFrame(ROWS[:2], SCHEMA))
    before = counts(s)

    def fail(version):
        raise RuntimeError("lost")

    monkeypatch.setattr(s, "_point_at", fail)
    with pytest.raises(RuntimeError):
        s.merge(spark.createDataFrame(ROWS, SCHEMA))
    assert counts(s) == before and s.version() == 1
    monkeypatch.undo()
    assert s.merge(spark.createDataFrame(ROWS, SCHEMA)) == 2 and counts(s) == [("a", "b", 7), ("a", "c", 1), ("x", None, 2)]


def test_old_versions_go(spark, tmp_path):
    s = store(spark, tmp_path / "store")
    for i in range(5):
        s.merge(spark.createDataFrame([(f"s{i}", "a", "b", i + 1)], SCHEMA))
    assert counts(s) == [("a", "b", 15)] and sorted(p.name for p in (tmp_path / "store").glob("v*")) == ["v4", "v5"]


def test_streams_merge_once(spark, tmp_path):
    s, inbox = store(spark, tmp_path / "store"), f"file://{tmp_path}/inbox"
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    df.write.parquet(inbox)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        ledger.merge_stream(stream, s, f"file://{tmp_path}/{checkpoint}").awaitTermination()

    want = [("a", "b", 7), ("a", "c", 1), ("x", None, 2)]
    run("c1")
    assert counts(s) == want
    df.write.mode("append").parquet(inbox)  # the same shards once more
    run("c1")
    run("c2")  # and everything from the beginning
    assert counts(s) == want and s.version() == 1
