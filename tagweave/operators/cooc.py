"""Co-occurrence counts: by document, by user, merged over shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave import functions as fn
from tagweave.session import spread


def unigrams(df: DataFrame, doc: str = "doc_id", tag: str = "tag", parts: int | None = None) -> DataFrame:
    """(tag, freq): documents of each tag; rows are dealt to ``parts`` if given."""
    return spread(df.select(doc, tag), parts, doc, tag).distinct().groupBy(tag).agg(F.count(F.lit(1)).alias("freq"))


#: Tags of a document (or user) whose pairs are made within one row.
MAX_TAGS = 1000


def bigrams(df: DataFrame, doc: str = "doc_id", tag: str = "tag", max_tags: int | None = MAX_TAGS) -> DataFrame:
    """(w1, w2, freq), w1 < w2: documents of each pair of tags.

    Pairs are made within the row of a document's distinct tags, so the only
    shuffles are by document and of partial counts. Tags of a document above
    ``max_tags`` are dealt to parts of that size, and each pair of parts is
    joined by itself, so no task makes more than ``max_tags`` squared pairs of it.
    """
    max_tags = max_tags or MAX_TAGS
    tags = df.where(F.col(tag).isNotNull()).select(doc, tag)
    lists = tags.groupBy(doc).agg(F.collect_set(tag).alias("tags"))
    pairs = lists.where(F.size("tags") <= max_tags).select(F.explode(fn.pairs_of("tags")).alias("p")).select("p.w1", "p.w2")
    last = F.floor((F.size("tags") - 1) / max_tags).cast("int").alias("last")
    wide = lists.where(F.size("tags") > max_tags).select(doc, last, F.posexplode("tags").alias("at", "t"))
    wide = wide.withColumn("part", F.floor(F.col("at") / max_tags).cast("int"))
    left = wide.select(doc, F.col("t").alias("a"), F.col("part").alias("i"), F.explode(F.sequence("part", "last")).alias("j"))
    right = wide.select(doc, F.col("t").alias("b"), F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    more = left.join(right, [doc, "i", "j"]).where("i < j or a < b").select(F.least("a", "b").alias("w1"), F.greatest("a", "b").alias("w2"))
    return pairs.union(more).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("freq"))


def canonical_pairs(df: DataFrame, a: str = "w1", b: str = "w2", freq: str = "freq") -> DataFrame:
    """Pairs with their smaller word first, counts of both orders added."""
    return df.groupBy(F.least(a, b).alias("w1"), F.greatest(a, b).alias("w2")).agg(F.sum(freq).alias("freq"))


def merge_counts(*parts: DataFrame, keys: list[str], freq: str = "freq") -> DataFrame:
    """Counts of several shards added; associative, so it also adds shards to an earlier result."""
    every = parts[0].select(*keys, freq)
    for p in parts[1:]:
        every = every.union(p.select(*keys, freq))
    return every.groupBy(*keys).agg(F.sum(freq).cast("long").alias(freq))


def distinct_user_counts(df: DataFrame, group: str = "wnid", user: str = "user_id", tag: str = "tag", unknown: str = "drop", parts: int | None = None) -> DataFrame:
    """(group, tag, cnt): users of each tag; images without a user are dropped or belong to one user ``unk``. Rows are dealt to ``parts`` if given."""
    d = df.where(F.col(user).isNotNull()) if unknown == "drop" else df.withColumn(user, F.coalesce(F.col(user).cast("string"), F.lit("unk")))
    return spread(d.select(group, tag, user), parts, group, tag, user).distinct().groupBy(group, tag).agg(F.count(F.lit(1)).alias("cnt"))


def user_tag_usage(df: DataFrame, user: str = "user_id", tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """(user, tag, uses) and (tag, users)."""
    uses = df.groupBy(user, tag).agg(F.count(F.lit(1)).alias("uses"))
    return uses, uses.groupBy(tag).agg(F.count(F.lit(1)).alias("users"))


def user_presence(df: DataFrame, user: str = "user_id", tag: str = "tag", min_users: int = 2) -> DataFrame:
    """(user, tag) of tags that at least ``min_users`` users have."""
    once = df.select(user, tag).distinct()
    kept = once.groupBy(tag).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_users).select(tag)
    return once.join(kept, tag, "left_semi").select(user, tag)


def group_stats(images: DataFrame, tags: DataFrame, group: str = "wnid", img: str = "img_id", user: str = "user_id") -> DataFrame:
    """(group, n_images, n_tagged, n_users, avg_tags) of each group of images."""
    size = tags.groupBy(img).agg(F.count(F.lit(1)).alias("n"))
    j = images.join(size, img, "left")
    return j.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(F.col("n") > 0).alias("n_tagged"),
        F.count_distinct(user).alias("n_users"),
        F.avg(F.coalesce("n", F.lit(0))).alias("avg_tags"),
    )


def percentages(counts: DataFrame, sizes: DataFrame, group: str = "wnid", min_count: int = 1) -> DataFrame:
    """Counts above ``min_count`` and their share of the group's images."""
    return counts.where(F.col("cnt") > min_count).join(sizes.select(group, "n_images"), group).withColumn("pct", F.col("cnt") / F.col("n_images")).drop("n_images")


def ngram_totals(lines: DataFrame, min_year: int = 2004, min_match: int = 2) -> DataFrame:
    """(word, match, page, volume) summed over years from ``min_year`` on; words start with a letter and match more than ``min_match`` times."""
    return (
        lines.where((F.col("yr") >= min_year) & fn.starts_alpha("word"))
        .groupBy("word")
        .agg(*(F.sum(c).cast("long").alias(c) for c in ("match", "page", "volume")))
        .where(F.col("match") > min_match)
    )


def symmetric(df: DataFrame, a: str = "w1", b: str = "w2", freq: str = "freq") -> DataFrame:
    """Both orders of each pair."""
    return df.select(a, b, freq).union(df.select(F.col(b), F.col(a), F.col(freq)))


def conditional(pairs: DataFrame, uni: DataFrame) -> DataFrame:
    """(a, b, p): pair counts divided by the first word's count, both orders."""
    u = uni.select(F.col("tag").alias("a"), F.col("freq").alias("n"))
    return symmetric(pairs).toDF("a", "b", "freq").join(u, "a").select("a", "b", (F.col("freq") / F.col("n")).alias("p"))


def bigram_matrix(pairs: DataFrame, counts: DataFrame, n_users: int, min_count: int = 3, cap: int | None = None) -> DataFrame:
    """(a, b, w): symmetric pair counts per user, among tags of at least ``min_count`` users and under a strict cap."""
    from tagweave.operators.normalize import strict_cap

    kept = counts.where(F.col("freq") >= min_count)
    kept = (strict_cap(kept, cap) if cap else kept).select("tag")
    p = pairs.join(kept.withColumnRenamed("tag", "w1"), "w1", "left_semi").join(kept.withColumnRenamed("tag", "w2"), "w2", "left_semi")
    return symmetric(p).toDF("a", "b", "freq").select("a", "b", (F.col("freq") / n_users).alias("w"))
