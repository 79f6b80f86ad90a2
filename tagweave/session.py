"""Session settings for tests, benchmarks and small runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tagweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of a task where tables are dealt by their size.
PART_ROWS = 150_000


def parts_for(spark: SparkSession, rows: int, per: int = PART_ROWS) -> int | None:
    """How many parts ``rows`` make; None where the session's shuffle partitions are enough.

    Of these only as many count as there are cores: adaptive execution joins the others again.
    """
    n = -(-rows // per)
    return n if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else None


def spread(df, parts: int | None, *keys):
    """``df`` dealt to ``parts`` by ``keys``, so that a task's rows don't grow with the table; as it is without ``parts``."""
    return df if parts is None else df.repartition(parts, *keys)


_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one temporary folder of the process in local mode and an error on a cluster."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _FOLDER.setdefault("local", "file://" + tempfile.mkdtemp(prefix="tagweave-"))
    return where.rstrip("/")


def stage_table(df, name: str):
    """Write ``df`` to the shared folder and read it again: iterations start from a short plan."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tagweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tagweave_path = path
    _STAGES.append(path)
    return out


#: Paths that ``stage_table`` wrote and nobody has deleted yet.
_STAGES: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_stage(df) -> None:
    """Delete a table that ``stage_table`` wrote and nothing reads any more."""
    path = getattr(df, "_tagweave_path", None)
    if path in _STAGES:
        _STAGES.remove(path)
        _delete(df.sparkSession, path)


def stages_written() -> int:
    """A mark for ``release_stages``: how many tables there are."""
    return len(_STAGES)


def release_stages(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written since a mark: once a result is stored, what it was made from can go."""
    gone, _STAGES[since:] = _STAGES[since:], []
    for path in gone:
        _delete(spark, path)
