"""Commands over files: python -m tagweave COMMAND ... ; each reads text formats and writes one folder of text or Parquet.

Every command is a plan over the library's readers, operators and writers; run it with spark-submit on a cluster.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import sources as src
from tagweave.operators import cooc, graph, normalize, stats
from tagweave.sources import sinks


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(string, word, is_stopword) from ``string<TAB>word<TAB>flag`` lines."""
    p = F.split("value", "\t")
    return src.lines(spark, path).where(F.size(p) >= 2).select(p[0].alias("string"), p[1].alias("word"), F.coalesce(F.get(p, 2).try_cast("int"), F.lit(0)).alias("is_stopword"))


def tagged(spark: SparkSession, args) -> DataFrame:
    """(img_id, user_id, tag) of photo documents or a tag cache, normalised if there is a dictionary."""
    if args.format == "photos":
        d = src.photos_of(src.raw_photos(spark, args.input)).select("img_id", "user_id", "tags")
    else:
        d = src.tag_cache(src.lines(spark, args.input), args.format == "user-cache")
        d = d if "user_id" in d.columns else d.withColumn("user_id", F.lit(None).cast("string"))
    d = d.select("img_id", "user_id", F.explode("tags").alias("raw_tag"))
    if not args.dictionary:
        return d.withColumnRenamed("raw_tag", "tag")
    extra = src.word_list(src.lines(spark, args.extra)) if args.extra else None
    return normalize.norm_tags(d, dictionary(spark, args.dictionary), extra, filter_stopword=not args.keep_stopwords)


def bigrams(spark, args):
    """Tag counts and pair counts by image, or by user."""
    t = tagged(spark, args).where(F.length("tag") > 1)
    key = "user_id" if args.by_user else "img_id"
    t = t.where(F.col(key).isNotNull())
    sinks.write_lines(sinks.count_lines(cooc.unigrams(t, key), "freq", "tag"), f"{args.output}/unigram")
    sinks.write_lines(sinks.count_lines(cooc.bigrams(t, key), "freq", "w1", "w2"), f"{args.output}/bigram")


def reduce_counts(spark, args):
    """Pair counts of several runs added up."""
    paths = args.input.split(",")
    sinks.write_lines(sinks.count_lines(src.bigram_counts(src.lines(spark, paths)), "freq", "w1", "w2"), args.output)


def collect_tags(spark, args):
    """A tag cache of photo documents."""
    t = tagged(spark, args).groupBy("img_id").agg(F.array_join(F.collect_list("tag"), ",").alias("tags"))
    sinks.write_lines(t.select(F.concat_ws("\t", "img_id", "tags").alias("value")), args.output)


def make_vocab(spark, args):
    """Words above a count, less those of an exclusion list."""
    v = normalize.vocabulary(src.unigram_counts(src.lines(spark, args.input)), args.min_count, "word")
    if args.extra:
        v = v.join(src.word_list(src.lines(spark, args.extra)), "word", "left_anti")
    sinks.write_lines(v.orderBy("word").select(F.col("word").alias("value")), args.output)


def concept_tags(spark, args):
    """Users of each tag by concept, from ``wnid<TAB>img_id`` lines and a user cache."""
    p = F.split("value", "\t")
    images = src.lines(spark, args.concepts).select(p[0].alias("wnid"), p[1].alias("img_id"))
    t = images.join(tagged(spark, args), "img_id")
    c = sinks.concept_lines(cooc.distinct_user_counts(t))
    sinks.write_lines(c.select(F.concat_ws("\t", "wnid", "line").alias("value")), args.output)


def rank_tags(spark, args):
    """Tags of each image by a score file ``score word``, best first."""
    p = F.split(F.trim("value"), r"\s+")
    scores = src.lines(spark, args.scores).select(p[1].alias("tag"), p[0].try_cast("double").alias("score"))
    t = tagged(spark, args).select(F.col("img_id").alias("doc_id"), "tag").distinct()
    stats.rank_document_tags(t, scores, score="score", min_tags=args.min_count).write.mode("overwrite").parquet(args.output)


def filter_triples(spark, args):
    """Triples of listed relations whose words occur together."""
    rel = [r["rel"] for r in src.relation_list(src.lines(spark, args.relations)).collect()]
    kept = graph.filter_triples(src.triples_csv(spark, args.input), rel, src.bigram_counts(src.lines(spark, args.pairs)))
    sinks.write_lines(kept.select(F.concat_ws(",", "rel", "w1", "w2").alias("value")), args.output)


def ngram_totals(spark, args):
    """Totals of n-gram lines from a year on."""
    t = cooc.ngram_totals(src.ngrams(src.zipped_lines(spark, args.input) if args.input.endswith(".zip") else src.lines(spark, args.input)), args.min_count)
    t.write.mode("overwrite").parquet(args.output)


def run_query(spark, args):
    """A registered query over a folder of tables."""
    from tagweave.plans import QUERIES

    QUERIES[args.name](spark, args.input).write.mode("overwrite").parquet(args.output)


COMMANDS = {
    "bigrams": bigrams, "reduce": reduce_counts, "collect-tags": collect_tags, "make-vocab": make_vocab, "concept-tags": concept_tags,
    "rank-tags": rank_tags, "filter-triples": filter_triples, "ngrams": ngram_totals, "query": run_query,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tagweave", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", choices=("photos", "cache", "user-cache"), default="cache")
    p.add_argument("--dictionary", help="string, word and stop flag, tab-separated")
    p.add_argument("--extra", help="further words, one a line")
    p.add_argument("--keep-stopwords", action="store_true")
    p.add_argument("--by-user", action="store_true")
    p.add_argument("--min-count", type=int, default=5)
    for name in ("concepts", "scores", "relations", "pairs", "name"):
        p.add_argument(f"--{name}")
    args = p.parse_args(argv)
    COMMANDS[args.command](spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
