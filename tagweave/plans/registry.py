"""Queries by name, the tables they read, and the SQL that they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.normalize import small
from tagweave.session import parts_for, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The library's inputs, made from the driver's tables.
FIXTURES = {
    "fx_doc_tags": "SELECT DISTINCT l_orderkey AS doc_id, o_custkey AS user_id, p_name AS raw_tag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "fx_words": "SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part",
    "fx_dict": "SELECT word AS string, word, 1 AS is_base, CASE WHEN length(word) = 3 THEN 1 ELSE 0 END AS is_stopword FROM fx_words UNION ALL SELECT word || 's', word, 0, 0 FROM fx_words WHERE length(word) > 3",
    "fx_addl": "SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part WHERE length(split_part(p_name, ' ', 1)) = 3",
    "fx_raw": "SELECT doc_id, user_id, 1 AS pos, split_part(raw_tag, ' ', 1) AS raw_tag FROM fx_doc_tags UNION ALL SELECT doc_id, user_id, 2, split_part(raw_tag, ' ', 2) || 's' FROM fx_doc_tags",
    "fx_images": "SELECT n_name AS wnid, o_orderkey AS img_id, o_custkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "fx_img_tags": "SELECT wnid, img_id, i.user_id, raw_tag AS tag FROM fx_images i JOIN fx_doc_tags ON img_id = doc_id",
    "fx_counts": "SELECT wnid, tag, count(DISTINCT user_id) AS cnt FROM fx_img_tags GROUP BY ALL",
    "fx_sizes": "SELECT wnid, count(*) AS n_images FROM fx_images GROUP BY ALL",
    "fx_edges": "SELECT 'ROOT' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "fx_triples": "SELECT p_type AS rel, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, CAST(count(*) AS DOUBLE) AS weight FROM part GROUP BY ALL",
    "fx_known": "SELECT DISTINCT p_type AS rel, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part WHERE p_size <= 25",
    "fx_all": "SELECT DISTINCT p_type AS rel, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part WHERE p_size > 10",
    "fx_graph": "SELECT s_nationkey AS src, p_size % 25 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "fx_scored": "SELECT doc_id AS id, quality AS label, (doc_id * 7919) % 1000 AS score FROM labels",
    "fx_detect": "SELECT l_orderkey AS img_id, p_brand AS obj, l_linenumber AS det_no, l_discount AS conf FROM lineitem JOIN part ON l_partkey = p_partkey",
    "fx_ngram": "SELECT p_brand AS word, CAST(year(l_shipdate) AS INT) AS yr, CAST(l_quantity AS BIGINT) AS \"match\", CAST(l_linenumber AS BIGINT) AS page, CAST(1 AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey",
    "fx_uni": "SELECT raw_tag AS tag, count(*) AS freq FROM (SELECT DISTINCT user_id, raw_tag FROM fx_doc_tags) GROUP BY ALL",
    "fx_pairs": "SELECT a.raw_tag AS w1, b.raw_tag AS w2, count(*) AS freq FROM (SELECT DISTINCT user_id, raw_tag FROM fx_doc_tags) a JOIN (SELECT DISTINCT user_id, raw_tag FROM fx_doc_tags) b ON a.user_id = b.user_id AND a.raw_tag < b.raw_tag GROUP BY ALL",
    "fx_scores": "SELECT w.word AS w1, v.word AS w2, CAST((ascii(w.word) * 31 + ascii(v.word) * 17 + length(w.word) * 7 + length(v.word) * 3) % 101 AS DOUBLE) AS score FROM fx_words w JOIN fx_words v ON w.word <> v.word",
}


class Tables:
    """The driver's tables and the inputs made from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parts(self):
        """How many parts hold the lines of orders (Parquet footers have their number); None for few."""
        return parts_for(self.spark, self.lineitem.count())

    def _look_up(self, df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
        """A join with a table that is broadcast if small; else both are dealt to parts."""
        if self.parts is not None:
            look = small(other)
            df, other = (df, look) if look is not other else (spread(df, self.parts, key), spread(other, self.parts, other_key))
        return df.join(other, F.col(key) == F.col(other_key))

    @cached_property
    def doc_tags(self):
        """Dealt to parts by document, which the steps behind it keep."""
        j = self._look_up(self.lineitem.select("l_orderkey", "l_partkey"), self.part.select("p_partkey", "p_name"), "l_partkey", "p_partkey")
        j = spread(j, self.parts, "l_orderkey").join(spread(self.orders.select("o_orderkey", "o_custkey"), self.parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select(F.col("l_orderkey").alias("doc_id"), F.col("o_custkey").alias("user_id"), F.col("p_name").alias("raw_tag")).distinct()

    @cached_property
    def tags(self):
        return self.doc_tags.withColumnRenamed("raw_tag", "tag")

    @cached_property
    def words(self):
        p = F.split("p_name", " ")
        return self.part.select(F.explode(F.array(p[0], p[1])).alias("word")).distinct()

    @cached_property
    def dictionary(self):
        w = self.words
        base = w.select(F.col("word").alias("string"), "word", F.lit(1).alias("is_base"), (F.length("word") == 3).cast("int").alias("is_stopword"))
        return base.union(w.where(F.length("word") > 3).select(F.concat("word", F.lit("s")), "word", F.lit(0), F.lit(0)))

    @cached_property
    def addl(self):
        return self.part.select(F.split("p_name", " ")[0].alias("word")).where(F.length("word") == 3).distinct()

    @cached_property
    def raw(self):
        p = F.split("raw_tag", " ")
        both = F.array(F.struct(F.lit(1).alias("pos"), p[0].alias("raw_tag")), F.struct(F.lit(2).alias("pos"), F.concat(p[1], F.lit("s")).alias("raw_tag")))
        return self.doc_tags.select("doc_id", "user_id", F.explode(both).alias("x")).select("doc_id", "user_id", "x.*")

    @cached_property
    def images(self):
        j = self._look_up(self.orders.select("o_orderkey", "o_custkey"), self.customer.select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey").join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return j.select(F.col("n_name").alias("wnid"), F.col("o_orderkey").alias("img_id"), F.col("o_custkey").alias("user_id"))

    @cached_property
    def img_tags(self):
        return spread(self.images, self.parts, "img_id").join(self.doc_tags.select(F.col("doc_id").alias("img_id"), F.col("raw_tag").alias("tag")), "img_id").select("wnid", "img_id", "user_id", "tag")

    @cached_property
    def counts(self):
        from tagweave.operators import cooc

        return cooc.distinct_user_counts(self.img_tags, parts=self.parts)

    @cached_property
    def sizes(self):
        return self.images.groupBy("wnid").agg(F.count(F.lit(1)).alias("n_images"))

    @cached_property
    def edges(self):
        r, n, s = self.region, self.nation, self.supplier
        a = r.select(F.lit("ROOT").alias("parent"), F.col("r_name").alias("child"))
        b = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
        return a.union(b).union(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name"))

    def _triples(self, where: str):
        p = F.split("p_name", " ")
        return self.part.where(where).select(F.col("p_type").alias("rel"), p[0].alias("w1"), p[1].alias("w2"))

    @cached_property
    def triples(self):
        return self._triples("true").groupBy("rel", "w1", "w2").agg(F.count(F.lit(1)).cast("double").alias("weight"))

    @cached_property
    def known(self):
        return self._triples("p_size <= 25").distinct()

    @cached_property
    def all_triples(self):
        return self._triples("p_size > 10").distinct()

    @cached_property
    def graph(self):
        j = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return j.groupBy(F.col("s_nationkey").alias("src"), (F.col("p_size") % 25).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))

    @cached_property
    def scored(self):
        return self.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), ((F.col("doc_id") * 7919) % 1000).alias("score"))

    @cached_property
    def detect(self):
        j = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return j.select(F.col("l_orderkey").alias("img_id"), F.col("p_brand").alias("obj"), F.col("l_linenumber").alias("det_no"), F.col("l_discount").alias("conf"))

    @cached_property
    def ngram(self):
        j = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return j.select(
            F.col("p_brand").alias("word"), F.year("l_shipdate").alias("yr"), F.col("l_quantity").cast("long").alias("match"),
            F.col("l_linenumber").cast("long").alias("page"), F.lit(1).cast("long").alias("volume"),
        )

    @cached_property
    def uni(self):
        from tagweave.operators import cooc

        return cooc.unigrams(self.tags, "user_id", parts=self.parts)

    @cached_property
    def pairs(self):
        from tagweave.operators import cooc

        return cooc.bigrams(self.tags, "user_id")

    @cached_property
    def n_users(self):
        return self.doc_tags.agg(F.count_distinct("user_id").alias("n_users"))

    @cached_property
    def scores(self):
        w, v = self.words.select(F.col("word").alias("w1")), self.words.select(F.col("word").alias("w2"))
        s = F.ascii("w1") * 31 + F.ascii("w2") * 17 + F.length("w1") * 7 + F.length("w2") * 3
        return w.join(v, F.col("w1") != F.col("w2")).select("w1", "w2", (s % 101).cast("double").alias("score"))


def _with_fixtures(sql: str) -> str:
    """Put the definitions of all fixtures that the text names, and of those that they name, in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in FIXTURES and name not in need:
                add(FIXTURES[name])
                if name not in need:
                    need.append(name)

    add(sql)
    if not need:
        return sql
    body = ", ".join(f"{n} AS MATERIALIZED ({FIXTURES[n]})" for n in need)
    sql = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", sql, re.I):
        return f"WITH RECURSIVE {body}, {sql[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"WITH\b", sql, re.I):
        return f"WITH {body}, {sql[4:].strip()}"
    return f"WITH {body} {sql}"


def query(name: str, sql: str | None = None):
    """Register a function of Tables; ``sql`` may name the fixtures."""

    def keep(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = _with_fixtures(sql)
        return f

    return keep
