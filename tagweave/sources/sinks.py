"""Writers. Order within files is presentation: it costs one range sort and is left to the writer that needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_lines(df: DataFrame, freq: str, *words: str) -> DataFrame:
    """(value): ``count<TAB>word...`` lines, counts padded to five places at least, in word order."""
    return df.orderBy(*words).select(F.concat_ws("\t", F.format_string("%5d", F.col(freq).cast("long")), *words).alias("value"))


def write_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    w = df.select("value").write.mode("overwrite")
    (w.option("compression", "gzip") if compress else w).text(path)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str], freq: str = "freq") -> DataFrame:
    """Counts of both added: new keys are inserted, known ones updated."""
    return old.select(*keys, freq).union(new.select(*keys, freq)).groupBy(*keys).agg(F.sum(freq).cast("long").alias(freq))


def overwrite_table(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """Replace a table's rows at once; partitions and buckets stand in for indexes."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.bucketBy(*bucket_by).sortBy(bucket_by[1]) if bucket_by else w).saveAsTable(name)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the table hasn't got, one for each key (the least row)."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti")
    if not rest:
        return fresh.distinct()
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def concept_lines(counts: DataFrame) -> DataFrame:
    """(wnid, line, json): ``tag:cnt tag:cnt`` by falling count, and a JSON object of the same."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("k"), "tag")))
    g = counts.groupBy("wnid").agg(listed.alias("l"))
    line = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["tag"], (-x["k"]).cast("string"))), " ")
    js = F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["tag"], -x["k"]))))
    return g.select("wnid", line.alias("line"), js.alias("json"))


def write_graphs(triples: DataFrame, path: str) -> None:
    """One folder a relation."""
    triples.write.mode("overwrite").partitionBy("rel").parquet(path)


def graphml(triples: DataFrame, rel: str) -> DataFrame:
    """(value): lines of a GraphML document of one relation, nodes and edges in order."""
    t = triples.where(F.col("rel") == rel)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    nodes = t.select(F.col("w1").alias("n")).union(t.select("w2")).distinct().select(F.lit(1).alias("k"), F.col("n").alias("o"), F.concat(F.lit('<node id="'), esc(F.col("n")), F.lit('"/>')).alias("value"))
    edges = t.select(F.lit(2), F.concat_ws("\t", "w1", "w2"), F.concat(F.lit('<edge source="'), esc(F.col("w1")), F.lit('" target="'), esc(F.col("w2")), F.lit('"/>')))
    spark = triples.sparkSession
    head = '<graphml xmlns="http://graphml.graphdrafting.org/xmlns"><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "k int, o string, value string")
    return ends.union(nodes).union(edges.toDF("k", "o", "value")).orderBy("k", "o").select("value")


def score_json(scores: DataFrame, x1: str, x2: str, count: str, infm: str) -> DataFrame:
    """(value): one JSON object a tag: word, x, cnt, ifm."""
    return scores.select(F.to_json(F.struct(F.col("tag").alias("word"), F.array(x1, x2).alias("x"), F.col(count).alias("cnt"), F.col(infm).alias("ifm"))).alias("value"))


def subgraph_blocks(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(graph_id, value): a text block for each subgraph: header, edges in order, dashes.

    ``edges`` has (graph_id, src, dst, weight), ``heads`` (graph_id, gtype, rel, root, size).
    """
    line = F.concat_ws("\t", F.col("weight").cast("long").cast("string"), "src", "dst")
    body = edges.select("graph_id", "src", "dst", line.alias("line")).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "line"))).alias("l"))
    head = F.concat(F.lit("#"), F.concat_ws(",", "graph_id", "gtype", "rel", "root", F.col("size").cast("string")))
    return heads.join(body, "graph_id").select("graph_id", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("----")).alias("value"))


def write_sparse_vectors(df: DataFrame, path: str, label: str = "label", vec: str = "vec") -> None:
    """libsvm lines: label, then 1-based index:value of what isn't 0."""
    items = F.transform(F.col(vec), lambda v, i: F.when(v != 0, F.concat_ws(":", (i + 1).cast("string"), v.cast("string"))))
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(F.filter(items, lambda x: x.isNotNull()), " ")).alias("value")).write.mode("overwrite").text(path)
