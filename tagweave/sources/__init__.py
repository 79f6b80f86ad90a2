"""Readers of the file formats that tag collections come in. Every reader takes any path that Spark reads;
those of archives any that Python or Arrow opens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave import functions as fn
from tagweave.sources.archives import archive_lines

_TEXT = T.StructType([T.StructField("_content", T.StringType())])
PHOTO = T.StructType(
    [
        T.StructField("stat", T.StringType()),
        T.StructField(
            "photo",
            T.StructType(
                [
                    *(T.StructField(c, T.StringType()) for c in ("id", "farm", "server", "secret")),
                    T.StructField("owner", T.StructType([T.StructField("nsid", T.StringType())])),
                    T.StructField("dates", T.StructType([T.StructField("taken", T.StringType())])),
                    T.StructField("title", _TEXT),
                    T.StructField("description", _TEXT),
                    T.StructField("tags", T.StructType([T.StructField("tag", T.ArrayType(_TEXT))])),
                ]
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def raw_photos(spark: SparkSession, path: str) -> DataFrame:
    """PHOTO documents below ``path``, one file each, with their file name; unreadable ones have ``_corrupt``."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt").schema(PHOTO).json(path).withColumn("file", F.col("_metadata.file_name"))
    )


def photos_of(raw: DataFrame) -> DataFrame:
    """(img_id, user_id, taken, title, description, tags) of documents whose stat is ok."""
    ident = F.coalesce("photo.id", F.regexp_extract("file", r"([^/]*?)\.json", 1)) if "file" in raw.columns else F.col("photo.id")
    return raw.where("stat = 'ok'").select(
        ident.alias("img_id"),
        F.nullif(F.col("photo.owner.nsid"), F.lit("")).alias("user_id"),
        F.col("photo.dates.taken").alias("taken"),
        F.col("photo.title._content").alias("title"),
        F.col("photo.description._content").alias("description"),
        F.coalesce(F.transform("photo.tags.tag", lambda t: t["_content"]), F.array().cast("array<string>")).alias("tags"),
    )


def photo_counters(raw: DataFrame) -> DataFrame:
    """(read, failed, not_ok, empty): documents, those that can't be read, those with another stat, those without tags."""
    n = F.size(F.coalesce(F.col("photo.tags.tag"), F.array().cast("array<struct<_content:string>>")))
    return raw.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(F.col("_corrupt").isNotNull()).alias("failed"),
        F.count_if(F.col("_corrupt").isNull() & ~(F.coalesce(F.col("stat"), F.lit("")) == "ok")).alias("not_ok"), F.count_if((F.col("stat") == "ok") & (n == 0)).alias("empty"),
    )


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value) of text files, gz too, globs too."""
    return spark.read.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines in their order within each file; the numbers rise but have gaps."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def tokens(text: DataFrame) -> DataFrame:
    """(parts): lines split at white space; blank ones are skipped."""
    return text.where(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), r"\s+").alias("parts"))


def tag_cache(text: DataFrame, with_user: bool = False) -> DataFrame:
    """(img_id[, user_id], tags) from ``id<TAB>[user<TAB>]tag,tag``."""
    p = F.split("value", "\t")
    tags = F.filter(F.split(F.coalesce(F.get(p, 2 if with_user else 1), F.lit("")), ","), lambda t: t != "")
    cols = [p[0].alias("img_id")] + ([F.nullif(F.get(p, 1), F.lit("")).alias("user_id")] if with_user else [])
    return text.where(F.length("value") > 0).select(*cols, tags.alias("tags"))


def unigram_counts(text: DataFrame, word_first: bool = False) -> DataFrame:
    """(word, freq) from ``count word`` (or ``word count``) lines, words that repeat added up."""
    p = F.split(F.trim("value"), r"\s+")
    n, w = (1, 0) if word_first else (0, 1)
    return text.where(F.size(p) == 2).select(p[w].alias("word"), p[n].try_cast("long").alias("freq")).where("freq is not null").groupBy("word").agg(F.sum("freq").alias("freq"))


def bigram_counts(text: DataFrame, vocab: DataFrame | None = None, min_count: float | None = None, number: str = "long") -> DataFrame:
    """(w1, w2, freq), w1 < w2, from ``count word word`` lines; both orders added; within a vocabulary and from a count on."""
    p = F.split(F.trim("value"), r"\s+")
    d = text.where(F.size(p) == 3).select(F.least(p[1], p[2]).alias("w1"), F.greatest(p[1], p[2]).alias("w2"), p[0].try_cast(number).alias("freq")).where("freq is not null")
    if vocab is not None:
        v = vocab.select("word").distinct()
        d = d.join(v.withColumnRenamed("word", "w1"), "w1", "left_semi").join(v.withColumnRenamed("word", "w2"), "w2", "left_semi").select("w1", "w2", "freq")
    d = d.groupBy("w1", "w2").agg(F.sum("freq").alias("freq"))
    return d if min_count is None else d.where(F.col("freq") >= min_count)


def ngrams(text: DataFrame) -> DataFrame:
    """(word, yr, match, page, volume) from tab-separated lines."""
    p = F.split("value", "\t")
    return text.where(F.size(p) == 5).select(p[0].alias("word"), *(p[i].try_cast("int" if i == 1 else "long").alias(c) for i, c in enumerate(("yr", "match", "page", "volume"), 1)))


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(member, value): lines of the files within zip archives; members are dealt to tasks and read as streams."""
    return archive_lines(spark, path).select("member", "value")


def tar_members(spark: SparkSession, path: str, wanted: str = "") -> DataFrame:
    """(member, value): lines of the members of tar archives (compressed too) whose name holds ``wanted``."""
    literal = "".join(f"[{c}]" if c in "*?[" else c for c in wanted)
    return archive_lines(spark, path, f"*{literal}*").select("member", "value")


def lemma_list(text: DataFrame) -> DataFrame:
    """(string, word, is_base) from a list (file, line_no, value): a line without indent is a base word, an indented one lists its forms."""
    base = F.when(~F.col("value").rlike(r"^\s"), F.trim(F.split(F.split("value", "->")[0], ",")[0]))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = text.where(F.length(F.trim("value")) > 0).withColumn("word", F.last(base, ignorenulls=True).over(w)).withColumn("own", base)
    bases = d.where("own is not null").select(F.col("word").alias("string"), "word", F.lit(1).alias("is_base"))
    forms = d.where("own is null").select(F.explode(F.split("value", ",")).alias("f"), "word")
    forms = forms.select(fn.alpha_prefix(F.trim(F.split("f", "->")[0])).alias("string"), "word", F.lit(0).alias("is_base")).where("string <> ''")
    return bases.union(forms).where("string is not null and word is not null").groupBy("string").agg(F.min_by("word", F.struct(1 - F.col("is_base"), "word")).alias("word"), F.max("is_base").alias("is_base"))


def word_list(text: DataFrame) -> DataFrame:
    """(word): lower case, letters only, two at least."""
    return text.select(F.lower(F.trim("value")).alias("word")).where(F.col("word").rlike("^[a-z]{2,}$")).distinct()


def synset_words(words: DataFrame, glosses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wnid, word1, words, gloss) and (wnid, word) from ``wnid<TAB>word, word`` and ``wnid<TAB>gloss`` lines.

    Raises if an identifier has two lines of words.
    """
    p = F.split("value", "\t")
    w = words.where(F.length("value") > 0).select(p[0].alias("wnid"), F.transform(F.split(p[1], ","), lambda w: F.trim(w)).alias("words"))
    twice = w.groupBy("wnid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['wnid']} has several lines")
    g = glosses.where(F.length("value") > 0).select(p[0].alias("wnid"), p[1].alias("gloss"))
    both = w.join(g, "wnid", "left").select("wnid", F.element_at("words", 1).alias("word1"), "words", "gloss")
    return both, w.select("wnid", F.explode("words").alias("word")).distinct()


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, framename, labels array<struct<name, start, end>>) of annotation XML, one row a frame."""
    label = T.StructType([T.StructField("_name", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType())])
    layer = T.StructType([T.StructField("labels", T.StructType([T.StructField("label", T.ArrayType(label))]))])
    sets = T.StructType([T.StructField("_frameName", T.StringType()), T.StructField("layers", T.StructType([T.StructField("layer", T.ArrayType(layer))]))])
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("annotationSets", T.StructType([T.StructField("annotationSet", T.ArrayType(sets))]))])
    d = spark.read.format("xml").option("rowTag", "sentence").schema(schema).load(path)
    d = d.select(F.input_file_name().alias("file"), "text", F.explode("annotationSets.annotationSet").alias("s"))
    flat = F.flatten(F.transform("s.layers.layer", lambda x: x["labels"]["label"]))
    return d.select("file", "text", F.col("s._frameName").alias("framename"), F.transform(flat, lambda x: F.struct(x["_name"].alias("name"), x["_start"].alias("start"), x["_end"].alias("end"))).alias("labels"))


def graph_blocks(text: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph_id, gtype, rel, root, src, dst, weight) and (skipped): blocks of ``#id,type,rel,root,size``, ``w<TAB>u<TAB>v`` and dashes.

    ``text`` has file, line_no and value. Edges with an unknown label are
    skipped and counted. A graph stays if it has over two edges, two different
    starts and two different ends.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").startswith("#"), F.col("value"))
    d = text.withColumn("head", F.last(head, ignorenulls=True).over(w)).where(~F.col("value").startswith("#") & ~F.col("value").startswith("----"))
    h, p = F.split(F.expr("substring(head, 2)"), ","), F.split("value", "\t")
    e = d.where(F.size(p) == 3).select(h[0].alias("graph_id"), h[1].alias("gtype"), h[2].alias("rel"), h[3].alias("root"), p[1].alias("src"), p[2].alias("dst"), p[0].try_cast("double").alias("weight"))
    skipped = None
    if labels is not None:
        k = labels.select("word").distinct()
        good = e.join(k.withColumnRenamed("word", "src"), "src", "left_semi").join(k.withColumnRenamed("word", "dst"), "dst", "left_semi").select(*e.columns)
        skipped = e.join(good.select("graph_id", "src", "dst").distinct(), ["graph_id", "src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("skipped"))
        e = good
    keep = e.groupBy("graph_id").agg(F.count_distinct("src", "dst").alias("n"), F.count_distinct("src").alias("s"), F.count_distinct("dst").alias("t")).where("n > 2 and s >= 2 and t >= 2")
    return e.join(keep.select("graph_id"), "graph_id", "left_semi").select(*e.columns), skipped


def concept_counts(text: DataFrame) -> DataFrame:
    """(wnid, tag, cnt) from ``wnid<TAB>tag:cnt tag:cnt`` lines."""
    p = F.split("value", "\t")
    return text.select(p[0].alias("wnid"), F.explode(fn.counts_of(F.get(p, 1))).alias("c")).select("wnid", "c.tag", "c.cnt")


def detector_values(text: DataFrame) -> DataFrame:
    """(img_id, pos, value): one number a line, by file; the file's name without its ending is the image."""
    w = Window.partitionBy("file").orderBy("line_no")
    name = F.regexp_extract("file", r"([^/]*?)(\.[^/.]*)?$", 1)
    return text.where(F.length(F.trim("value")) > 0).select(name.alias("img_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.trim("value").try_cast("double").alias("value"))


def triples_csv(spark: SparkSession, path: str) -> DataFrame:
    """(rel, w1, w2) of comma-separated lines; malformed ones are left out."""
    return spark.read.option("mode", "DROPMALFORMED").schema("rel string, w1 string, w2 string").csv(path).where("w2 is not null")


def relation_list(text: DataFrame) -> DataFrame:
    """(rel): lines but for blank ones and those that start with #."""
    return text.where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#")).select(F.trim("value").alias("rel"))


def sparse_vectors(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(label, features) of libsvm files."""
    r = spark.read.format("libsvm")
    return (r.option("numFeatures", n_features) if n_features else r).load(path)


def job_status(ledger: DataFrame) -> DataFrame:
    """(n, working, done) of a work ledger."""
    return ledger.agg(F.count(F.lit(1)).alias("n"), F.sum("working").cast("long").alias("working"), F.sum("done").cast("long").alias("done"))


def pack_jobs(sizes: DataFrame, limit: int, name: str = "dir", size: str = "n", chunk: int = 100_000) -> DataFrame:
    """(name, size, job): directories in order, dealt to jobs of at most ``limit`` images where one directory allows it.

    Sequential by nature: a running total that starts anew when it would pass
    the limit. The directories are numbered and cut into chunks; each chunk is
    packed by a task that is told what the one before it left, so no task and no
    driver ever holds more than a chunk. The ledger has one row a directory.
    """
    from tagweave.operators.stats import numbered
    from tagweave.session import stage_table

    kind = dict(sizes.dtypes)[name]
    rows = numbered(sizes.select(name, F.col(size).cast("long").alias("_size")), name, "_size", name="_at").drop("n")
    rows = stage_table(rows.withColumn("_chunk", F.floor(F.col("_at") / chunk)), "ledger")
    starts = {0: (0, 0)}

    def pack(pdf: pd.DataFrame) -> tuple[list[int], int]:
        job, total = starts[int(pdf["_chunk"].iloc[0])]
        out = []
        for n in pdf.sort_values("_at")["_size"]:
            if total and total + n > limit:
                job, total = job + 1, 0
            total += n
            out.append(job)
        return out, total

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        jobs, total = pack(pdf)
        return pd.DataFrame({"job": [jobs[-1]], "total": [total]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        return pd.DataFrame({name: pdf[name], size: pdf["_size"], "job": pack(pdf)[0]})

    chunks = rows.agg(F.coalesce(F.max("_chunk"), F.lit(0))).first()[0] + 1
    for k in range(chunks - 1):
        left = rows.where(F.col("_chunk") == k).groupBy("_chunk").applyInPandas(last, "job long, total long").first()
        starts[k + 1] = (left["job"], left["total"])
    return rows.groupBy("_chunk").applyInPandas(run, f"{name} {kind}, {size} long, job long")
