"""Readers and writers over files made from the driver's tables (S, K).

Each query writes its lines to the shared folder in the format of its source,
reads them with the library's reader and returns the rows.
"""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from tagweave import sources as src
from tagweave import streaming
from tagweave.plans.registry import query
from tagweave.session import shared_folder
from tagweave.sources import sinks


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/tagweave-files-{uuid.uuid4().hex}"


def _lines(t, df, compress: bool = False):
    path = _folder(t)
    sinks.write_lines(df, path, compress)
    return path


_PHOTO = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'fail' ELSE 'ok' END AS stat, CAST(event_id AS VARCHAR) AS img_id, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events"""


def _photo_files(t):
    e = t.events
    tags = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<struct<_content:string>>")).otherwise(F.array(F.struct(F.col("event_type").alias("_content"))))
    photo = F.struct(
        F.col("event_id").cast("string").alias("id"), F.lit("1").alias("farm"), F.struct(F.col("user_id").cast("string").alias("nsid")).alias("owner"),
        F.struct(F.concat(F.lit("title "), "event_type").alias("_content")).alias("title"), F.struct(F.lit("a. b").alias("_content")).alias("description"), F.struct(tags.alias("tag")).alias("tags"),
    )
    doc = F.to_json(F.struct(F.when(F.col("event_id") % 11 == 0, "fail").otherwise("ok").alias("stat"), photo.alias("photo")))
    path = _folder(t)
    e.select(F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(doc).alias("value")).write.text(path)
    # the driver's files are many documents each: one a line
    return t.spark.read.option("columnNameOfCorruptRecord", "_corrupt").schema(src.PHOTO).json(path)


@query("s01_photo_documents", f"SELECT img_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS tags FROM ({_PHOTO}) WHERE stat = 'ok' AND event_id % 13 <> 0")
def _(t):
    return src.photos_of(_photo_files(t)).select("img_id", F.array_join("tags", ",").alias("tags"))


@query("s01_photo_counters", "SELECT count(*) AS read, count(*) FILTER (event_id % 13 = 0) AS failed, count(*) FILTER (event_id % 13 <> 0 AND event_id % 11 = 0) AS not_ok, count(*) FILTER (event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 3 = 0) AS empty FROM events")
def _(t):
    # corrupt records can't be counted over a pruned JSON scan: the parsed rows are written once
    from tagweave.session import stage_table

    return src.photo_counters(stage_table(_photo_files(t).select("*"), "photos"))


@query("s02_photo_texts", f"SELECT img_id, user_id, 'title ' || event_type AS title, 'a. b' AS description FROM ({_PHOTO}) WHERE stat = 'ok' AND event_id % 13 <> 0")
def _(t):
    return src.photos_of(_photo_files(t)).select("img_id", "user_id", "title", "description")


@query("s03_tag_cache", "SELECT CAST(doc_id AS VARCHAR) AS img_id, string_agg(raw_tag, ',' ORDER BY raw_tag) AS tags FROM fx_doc_tags GROUP BY doc_id")
def _(t):
    g = t.doc_tags.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("raw_tag")), ",").alias("tags"))
    path = _lines(t, g.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "tags").alias("value")))
    return src.tag_cache(src.lines(t.spark, path)).select("img_id", F.array_join("tags", ",").alias("tags"))


@query("s04_split_lines", "SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part")
def _(t):
    v = F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit("\t "), F.replace("p_name", F.lit(" "), F.lit("   ")))
    path = _lines(t, t.part.select(F.when(F.col("p_partkey") % 2 == 0, v).otherwise(v).alias("value")).union(t.spark.createDataFrame([("",), ("   ",)], "value string")), True)
    p = src.tokens(src.lines(t.spark, path))
    return p.select(F.col("parts")[0].cast("long").alias("k"), F.col("parts")[1].alias("a"), F.col("parts")[2].alias("b"))


@query("s05_unigram_counts", "SELECT word, CAST(sum(n) AS BIGINT) AS freq FROM (SELECT split_part(p_name, ' ', 1) AS word, p_size AS n FROM part) GROUP BY ALL")
def _(t):
    path = _lines(t, t.part.select(F.concat_ws("\t", F.lpad(F.col("p_size").cast("string"), 5, " "), F.split("p_name", " ")[0]).alias("value")))
    return src.unigram_counts(src.lines(t.spark, path))


@query("s05_bigram_counts", "SELECT least(a, b) AS w1, greatest(a, b) AS w2, CAST(sum(n) AS BIGINT) AS freq FROM (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size AS n FROM part) WHERE a IN (SELECT word FROM fx_words WHERE word > 'h') AND b IN (SELECT word FROM fx_words WHERE word > 'h') GROUP BY ALL HAVING sum(n) >= 100")
def _(t):
    w = F.split("p_name", " ")
    path = _lines(t, t.part.select(F.concat_ws(" ", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, w[1]).otherwise(w[0]), F.when(F.col("p_partkey") % 2 == 0, w[0]).otherwise(w[1])).alias("value")))
    return src.bigram_counts(src.lines(t.spark, path), t.words.where("word > 'h'"), 100)


@query("s06_many_files", "SELECT event_type AS word, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    a, b = (_lines(t, t.events.where(f"event_id % 2 = {k}").select(F.col("event_type").alias("value"))) for k in (0, 1))
    return src.lines(t.spark, [a, b]).groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("s08_ngram_lines", 'SELECT word, yr, "match", page, volume FROM fx_ngram')
def _(t):
    path = _lines(t, t.ngram.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("word", "yr", "match", "page", "volume")]).alias("value")))
    return src.ngrams(src.lines(t.spark, path))


@query("s08_zipped_ngrams", "SELECT p_name AS word, CAST(2000 + p_size AS INT) AS yr, CAST(p_partkey AS BIGINT) AS \"match\" FROM part")
def _(t):
    lines: dict[int, list[str]] = {}
    for r in t.part.select("p_name", "p_size", "p_partkey").toLocalIterator():  # the archive's writer; what is tested reads it
        lines.setdefault(r.p_partkey % 5, []).append(f"{r.p_name}\t{2000 + r.p_size}\t{r.p_partkey}\t1\t1\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, part in sorted(lines.items()):
            z.writestr(f"{k}.tsv", "".join(part), zipfile.ZIP_STORED if k % 2 else None)
    return src.ngrams(src.zipped_lines(t.spark, _bytes(t, out.getvalue(), "zip"))).select("word", "yr", "match")


@query("s07_tar_members", "SELECT s_name AS value FROM supplier")
def _(t):
    import tarfile

    out = io.BytesIO()
    data = "\n".join(r.s_name for r in t.supplier.select("s_name").toLocalIterator()).encode()
    with tarfile.open(fileobj=out, mode="w:gz") as z:
        for name in ("urls_x.txt", "other.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            z.addfile(info, io.BytesIO(data))
    return src.tar_members(t.spark, _bytes(t, out.getvalue(), "tgz"), "urls").select("value")


def _bytes(t, data: bytes, ending: str) -> str:
    """Put one small file into the shared folder through Hadoop's file systems."""
    path = f"{_folder(t)}/file.{ending}"
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).create(at)
    stream.write(bytearray(data))
    stream.close()
    return path


@query("s09_lemma_list", "SELECT string, word, is_base FROM fx_dict")
def _(t):
    # one line of forms below each base word, in one file
    d = t.dictionary
    text = d.select("word", F.when(F.col("is_base") == 1, F.col("word")).otherwise(F.concat(F.lit("    "), "string", F.lit(" -> ["), "word", F.lit("]"))).alias("value"), "is_base")
    path = _lines(t, text.coalesce(1).orderBy("word", F.desc("is_base")).select("value").coalesce(1))
    return src.lemma_list(src.numbered_lines(t.spark, path)).select("string", "word", "is_base")


@query("s10_flagged_word_lists", "WITH a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part), b AS (SELECT DISTINCT lower(p_type) AS w FROM part UNION SELECT 'red') SELECT w AS string, (w IN (SELECT w FROM a))::INT AS from_one, (w IN (SELECT w FROM b))::INT AS from_two FROM (SELECT w FROM a UNION SELECT w FROM b) WHERE regexp_matches(w, '^[a-z]{2,}$')")
def _(t):
    from tagweave.operators.normalize import flag_words

    one = t.part.select(F.upper(F.split("p_name", " ")[0]).alias("word"))
    return flag_words({"one": one, "two": t.part.select(F.col("p_type").alias("word")).union(t.spark.createDataFrame([("red",), ("x1",), ("a",)], "word string"))})


@query("s11_synset_words", "SELECT n_name AS wnid, 'w' || CAST(n_nationkey AS VARCHAR) AS word1, 'gloss ' || n_name AS gloss, 2 AS n FROM nation")
def _(t):
    n = t.nation
    w = _lines(t, n.select(F.concat_ws("\t", "n_name", F.concat(F.lit("w"), F.col("n_nationkey").cast("string"), F.lit(", second"))).alias("value")))
    g = _lines(t, n.select(F.concat_ws("\t", "n_name", F.concat(F.lit("gloss "), "n_name")).alias("value")))
    return src.synset_words(src.lines(t.spark, w), src.lines(t.spark, g))[0].select("wnid", "word1", "gloss", F.size("words").alias("n"))


@query("s12_table_views", "SELECT word, count(*) AS n FROM fx_dict WHERE is_base = 0 GROUP BY ALL")
def _(t):
    name = f"dict_{uuid.uuid4().hex[:8]}"
    t.dictionary.createOrReplaceTempView(name)
    return t.spark.sql(f"SELECT word, count(*) AS n FROM {name} WHERE is_base = 0 GROUP BY word")


@query("s13_annotation_xml", "SELECT conv_id, 'Frame' || CAST(turn AS VARCHAR) AS framename, turn AS first, turn + 4 AS last FROM conversations")
def _(t):
    c = t.conversations
    x = F.format_string(
        '<sentence><text>%s</text><annotationSets><annotationSet frameName="Frame%s"><layers><layer><labels><label name="Target" start="%s" end="%s"/><label name="Theme" start="%s" end="%s"/></labels></layer></layers></annotationSet></annotationSets></sentence>',
        F.col("conv_id").cast("string"), F.col("turn").cast("string"), *[F.col("turn").cast("string")] * 2, (F.col("turn") + 2).cast("string"), (F.col("turn") + 4).cast("string"),
    )
    # one document with one root, as annotation tools write it
    path = _lines(t, c.select(x.alias("x")).agg(F.concat(F.lit("<corpus>"), F.array_join(F.collect_list("x"), "\n"), F.lit("</corpus>")).alias("value")))
    a = src.annotations(t.spark, path)
    return a.select(F.col("text").cast("long").alias("conv_id"), "framename", F.array_min(F.transform("labels", lambda v: v["start"])).alias("first"), F.array_max(F.transform("labels", lambda v: v["end"])).alias("last"))


@query("s14_graph_blocks", "WITH e AS (SELECT DISTINCT rel, w1, w2 FROM fx_known) SELECT rel AS graph_id, w1 AS src, w2 AS dst, CAST(1 AS DOUBLE) AS weight FROM e WHERE w2 IN (SELECT word FROM fx_words WHERE word > 'b') AND w1 IN (SELECT word FROM fx_words WHERE word > 'b')")
def _(t):
    e = t.known.select(F.col("rel").alias("graph_id"), F.col("w1").alias("src"), F.col("w2").alias("dst"), F.lit(1.0).alias("weight"))
    heads = e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")).select("graph_id", F.lit("star").alias("gtype"), F.col("graph_id").alias("rel"), F.lit("root").alias("root"), "size")
    path = _lines(t, sinks.subgraph_blocks(e, heads))
    return src.graph_blocks(src.numbered_lines(t.spark, path), t.words.where("word > 'b'"))[0].select("graph_id", "src", "dst", "weight")


@query("s15_concept_count_lines", "SELECT wnid, tag, cnt FROM (SELECT wnid, replace(tag, ' ', '_') AS tag, cnt FROM fx_counts)")
def _(t):
    c = sinks.concept_lines(t.counts.withColumn("tag", F.translate("tag", " ", "_")))
    path = _lines(t, c.select(F.concat_ws("\t", "wnid", "line").alias("value")))
    return src.concept_counts(src.lines(t.spark, path))


@query("s17_triples_csv", "SELECT rel, w1, w2 FROM fx_known")
def _(t):
    path = _lines(t, t.known.select(F.concat_ws(",", "rel", "w1", "w2").alias("value")).union(t.spark.createDataFrame([("broken",), ("also,broken",)], "value string")))
    return src.triples_csv(t.spark, path)


@query("s18_sparse_vectors", "SELECT CAST(label AS DOUBLE) AS label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def _(t):
    path = _folder(t)
    sinks.write_sparse_vectors(t.embeddings.where("label is not null").select("label", F.transform("embedding", lambda v: F.round(v.cast("double"), 3)).alias("vec")), path)
    return src.sparse_vectors(t.spark, path, 64).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("s19_relation_list", "SELECT DISTINCT p_type AS rel FROM part WHERE p_type > 'L'")
def _(t):
    v = F.when(F.col("p_type") > "L", F.col("p_type")).otherwise(F.concat(F.lit("#"), "p_type"))
    path = _lines(t, t.part.select(v.alias("value")).distinct().union(t.spark.createDataFrame([("",)], "value string")))
    return src.relation_list(src.lines(t.spark, path))


@query("s21_job_status", "SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS working, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders")
def _(t):
    return src.job_status(t.orders.select((F.col("o_orderstatus") == "O").cast("int").alias("working"), (F.col("o_orderstatus") == "F").cast("int").alias("done")))


@query(
    "s21_pack_jobs",
    """WITH RECURSIVE o AS (SELECT wnid AS dir, n_images AS n, row_number() OVER (ORDER BY wnid) AS rn FROM fx_sizes),
 r(rn, job, total) AS (SELECT rn, CAST(0 AS BIGINT), n FROM o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN total + n > 1500 THEN job + 1 ELSE job END, CASE WHEN total + n > 1500 THEN n ELSE total + n END FROM r JOIN o ON o.rn = r.rn + 1)
 SELECT dir, n, job FROM r JOIN o USING (rn)""",
)
def _(t):
    return src.pack_jobs(t.sizes.select(F.col("wnid").alias("dir"), F.col("n_images").alias("n")), 1500)


# ---- sinks ----
@query("k01_count_lines", "SELECT format('{:>5}', freq) || chr(9) || tag AS value FROM (SELECT tag, freq FROM fx_uni UNION ALL SELECT tag || ' total', freq * 100003 FROM fx_uni)")
def _(t):
    """Counts of up to five digits, and much larger ones."""
    large = t.uni.select(F.concat("tag", F.lit(" total")).alias("tag"), (F.col("freq") * 100003).alias("freq"))
    return sinks.count_lines(t.uni.select("tag", "freq").union(large), "freq", "tag")


@query("k02_upsert_counts", "SELECT tag, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT tag, freq FROM fx_uni UNION ALL SELECT tag, freq FROM fx_uni WHERE tag > 'n' UNION ALL SELECT 'brand new', 3) GROUP BY tag")
def _(t):
    new = t.uni.where("tag > 'n'").select("tag", "freq").union(t.spark.createDataFrame([("brand new", 3)], "tag string, freq long"))
    return sinks.upsert_counts(t.uni, new, ["tag"])


@query("k03_overwrite_table", "SELECT wnid, tag, cnt FROM fx_counts")
def _(t):
    path = _folder(t)
    c = t.counts
    for _ in range(2):  # the second run replaces the first one's rows
        c.write.mode("overwrite").partitionBy("wnid").parquet(path)
    return t.spark.read.schema("tag string, cnt long, wnid string").parquet(path).select("wnid", "tag", "cnt")


@query("k04_insert_absent", "SELECT img_id, user_id FROM fx_images WHERE wnid >= 'NATION_2'")
def _(t):
    i = t.images.select("img_id", "user_id")
    return sinks.insert_absent(t.images.where("wnid < 'NATION_2'"), i.union(i), ["img_id"])


@query("k05_concept_lines", "SELECT wnid, string_agg(tag || ':' || CAST(cnt AS VARCHAR), ' ' ORDER BY cnt DESC, tag) AS line, '{' || string_agg('\"' || tag || '\":' || CAST(cnt AS VARCHAR), ',' ORDER BY cnt DESC, tag) || '}' AS json FROM fx_counts GROUP BY wnid")
def _(t):
    return sinks.concept_lines(t.counts)


@query("k06_relation_folders", "SELECT rel, w1, w2, weight FROM fx_triples")
def _(t):
    path = _folder(t)
    sinks.write_graphs(t.triples, path)
    return t.spark.read.schema("w1 string, w2 string, weight double, rel string").parquet(path).select("rel", "w1", "w2", "weight")


@query("k06_graphml_lines", "WITH t AS (SELECT rel, w1, w2 FROM fx_triples), r AS (SELECT DISTINCT rel FROM t) SELECT rel, '<graphml xmlns=\"http://graphml.graphdrafting.org/xmlns\"><graph edgedefault=\"directed\">' AS value FROM r UNION ALL SELECT rel, '<node id=\"' || n || '\"/>' FROM (SELECT rel, w1 AS n FROM t UNION SELECT rel, w2 FROM t) UNION ALL SELECT rel, '<edge source=\"' || w1 || '\" target=\"' || w2 || '\"/>' FROM t UNION ALL SELECT rel, '</graph></graphml>' FROM r")
def _(t):
    """A graph for each relation, of which there are a handful."""
    out = None
    for r in sorted(r.rel for r in t.triples.select("rel").distinct().collect()):
        one = sinks.graphml(t.triples, r).select(F.lit(r).alias("rel"), "value")
        out = one if out is None else out.union(one)
    return out


@query("k07_export_triples", "SELECT rel || ',' || w1 || ',' || w2 AS value FROM fx_triples")
def _(t):
    return t.triples.select(F.concat_ws(",", "rel", "w1", "w2").alias("value"))


@query("k08_score_json", "SELECT '{\"word\":\"' || tag || '\",\"x\":[' || CAST(freq AS VARCHAR) || ',' || CAST(freq % 7 AS VARCHAR) || '],\"cnt\":' || CAST(freq AS VARCHAR) || ',\"ifm\":' || CAST(freq % 7 AS VARCHAR) || '}' AS value FROM fx_uni")
def _(t):
    return sinks.score_json(t.uni.withColumn("ifm", F.col("freq") % 7), "freq", "ifm", "freq", "ifm")


@query("k09_subgraph_blocks", "SELECT rel AS graph_id, '#' || rel || ',c,' || rel || ',r,' || CAST(count(*) AS VARCHAR) || chr(10) || string_agg(CAST(CAST(weight AS BIGINT) AS VARCHAR) || chr(9) || w1 || chr(9) || w2, chr(10) ORDER BY w1, w2) || chr(10) || '----' AS value FROM fx_triples GROUP BY rel")
def _(t):
    e = t.triples.select(F.col("rel").alias("graph_id"), F.col("w1").alias("src"), F.col("w2").alias("dst"), "weight")
    heads = e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")).select("graph_id", F.lit("c").alias("gtype"), F.col("graph_id").alias("rel"), F.lit("r").alias("root"), "size")
    return sinks.subgraph_blocks(e, heads)


@query("k10_pair_statistics_table", "SELECT w1, w2, freq FROM fx_pairs")
def _(t):
    from tagweave.session import stage_table

    return stage_table(t.pairs, "pairs")


@query("k11_top_report", "SELECT tag, freq FROM fx_uni WHERE freq >= 5 ORDER BY freq DESC, tag LIMIT 20")
def _(t):
    return t.uni.where("freq >= 5").orderBy(F.desc("freq"), "tag").limit(20)


# ---- counts that grow ----
@query("st_streaming_bigrams", "SELECT a.raw_tag AS w1, b.raw_tag AS w2, count(*) AS freq FROM fx_doc_tags a JOIN fx_doc_tags b ON a.doc_id = b.doc_id AND a.raw_tag < b.raw_tag GROUP BY ALL")
def _(t):
    """Documents arrive as files, one part at a time; the counts are those of the batch."""
    path = _folder(t)
    g = t.doc_tags.groupBy("doc_id").agg(F.collect_set("raw_tag").alias("tags"))
    g.repartition(4).write.parquet(path)
    stream = t.spark.readStream.schema("doc_id long, tags array<string>").option("maxFilesPerTrigger", 2).parquet(path)
    return streaming.run_available(streaming.streaming_bigrams(stream), ["w1", "w2"], _folder(t), _folder(t))


@query("st_streaming_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    path = _folder(t)
    t.events.select("ts", "event_type").write.parquet(path)
    stream = t.spark.readStream.schema("ts timestamp, event_type string").parquet(path)
    return streaming.run_available(streaming.streaming_windows(stream, "ts", "event_type", "1 hour"), ["start", "event_type"], _folder(t), _folder(t))
