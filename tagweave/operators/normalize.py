"""Tag normalisation, vocabularies and numeric normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dictionary is broadcast below this many rows; beyond, Spark chooses the join.
SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (a limited count decides)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def norm_dictionary(dictionary: DataFrame, extra: DataFrame | None = None, filter_stopword: bool = True) -> DataFrame:
    """(string, lemma): one row for each string that a tag may be.

    Stop words are left out if asked; words of ``extra`` that then have no row
    stand for themselves, stop words among them too.
    """
    base = dictionary.select("string", F.col("word").alias("lemma"), "is_stopword")
    if filter_stopword:
        base = base.where(F.coalesce("is_stopword", F.lit(0)) == 0)
    base = base.select("string", "lemma").where("lemma is not null and lemma <> ''")
    if extra is None:
        return base
    more = extra.select(F.col("word").alias("string")).where("string is not null").distinct()
    return base.unionByName(more.join(base, "string", "left_anti").select("string", F.col("string").alias("lemma")))


def norm_tags(
    df: DataFrame,
    dictionary: DataFrame,
    extra: DataFrame | None = None,
    tag: str = "raw_tag",
    filter_stopword: bool = True,
    min_len: int = 1,
    keys: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``tag``: the lemma of the raw tag by exact, case-sensitive look-up; unknown tags go.

    With ``keys``, each lemma stays once for each key.
    """
    look = small(norm_dictionary(dictionary, extra, filter_stopword)).withColumnRenamed("string", tag)
    out = df.join(look, tag).withColumn("tag", F.col("lemma")).drop("lemma")
    out = out.drop(tag) if tag != "tag" else out
    out = out.where(F.length("tag") >= min_len)
    return out.select(*keys, "tag").distinct() if keys else out


def norm_terms(terms: DataFrame, dictionary: DataFrame, extra: DataFrame | None = None, term: str = "term") -> DataFrame:
    """(term, words): the normalised words of each multi-word term in order; empty where none is known."""
    parts = terms.select(term).distinct().select(term, F.posexplode(F.split(term, " ")).alias("pos", "raw_tag"))
    normal = norm_tags(parts, dictionary, extra)
    listed = normal.groupBy(term).agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("w"))
    return terms.select(term).distinct().join(listed, term, "left").select(
        term, F.coalesce(F.transform("w", lambda x: x["tag"]), F.array().cast("array<string>")).alias("words")
    )


def vocabulary(counts: DataFrame, min_count: int, word: str = "tag", freq: str = "freq") -> DataFrame:
    """Words above a frequency."""
    return counts.where(F.col(freq) > min_count).select(word)


def strict_cap(counts: DataFrame, n: int, word: str = "tag", freq: str = "freq") -> DataFrame:
    """Words with a count above that of the n-th: fewer than n where counts tie."""
    last = counts.orderBy(F.desc(freq), word).limit(n).agg(F.count(F.lit(1)).alias("have"), F.min(freq).alias("floor"))
    # one row
    return counts.crossJoin(F.broadcast(last)).where((F.col("have") < n) | (F.col(freq) > F.col("floor"))).select(word, freq)


def row_normalize(edges: DataFrame, src: str = "src", w: str = "w") -> DataFrame:
    """Weights divided by their row's sum; rows that sum to 0 keep 0."""
    total = edges.groupBy(src).agg(F.sum(w).alias("_total"))
    return edges.join(total, src).withColumn("p", F.coalesce(F.col(w) / F.nullif("_total", F.lit(0)), F.lit(0.0))).drop("_total")


def normalize_by(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Values divided by their group's sum (a sum of 0 counts as 1): whole, by row or by column."""
    total = df.groupBy(*(by or [])).agg(F.sum(value).alias("_total"))
    joined = df.join(total, by) if by else df.crossJoin(F.broadcast(total))  # one row without groups
    return joined.withColumn("normal", F.col(value) / F.coalesce(F.nullif("_total", F.lit(0)), F.lit(1))).drop("_total")


def max_scale(df: DataFrame, value: str) -> DataFrame:
    """log(x + 1) and that divided by its largest value."""
    top = df.agg(F.max(F.log1p(value)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("logged", F.log1p(value)).withColumn("scaled", F.col("logged") / F.col("_top")).drop("_top")


def box_normalize(train: DataFrame, other: DataFrame, dim: str, value: str, eps: float = 1e-12) -> DataFrame:
    """Values of ``other`` scaled by the training set's least and largest value of each dimension; no range counts as 1."""
    box = train.groupBy(dim).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span: Column = F.when(F.col("hi") - F.col("lo") < eps, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    return other.join(box, dim).withColumn("boxed", (F.col(value) - F.col("lo")) / span).drop("lo", "hi")


def fallback_keys(names: DataFrame, table: DataFrame, by_hand: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """(name, key, how): the key of a name as it is, without its last letter, by a hand-made list, or none."""
    keys = table.select(key).distinct()
    exact = keys.select(F.col(key).alias("k1"))
    shorter = keys.select(F.col(key).alias("k2"))
    hand = by_hand.join(keys.withColumnRenamed(key, "target"), "target", "left_semi").select(F.col("name").alias("h"), F.col("target").alias("k3"))
    out = (
        names.select(name)
        .distinct()
        .join(exact, F.col(name) == F.col("k1"), "left")
        .join(shorter, F.expr(f"substring({name}, 1, length({name}) - 1)") == F.col("k2"), "left")
        .join(hand, F.col(name) == F.col("h"), "left")
    )
    how = F.when(F.col("k1").isNotNull(), "exact").when(F.col("k2").isNotNull(), "shorter").when(F.col("k3").isNotNull(), "hand").otherwise("none")
    return out.select(name, F.coalesce("k1", "k2", "k3").alias(key), how.alias("how"))


def exclude_plurals(tags: DataFrame, known: DataFrame, tag: str = "tag") -> DataFrame:
    """Tags that are not known, nor known with an s, nor known without their last letter."""
    k = known.select(F.col(tag).alias("k"))
    forms = k.union(k.select(F.concat("k", F.lit("s")))).union(k.select(F.expr("substring(k, 1, length(k) - 1)"))).distinct()
    return tags.select(tag).distinct().join(forms.withColumnRenamed("k", tag), tag, "left_anti")


def flag_words(lists: dict[str, DataFrame]) -> DataFrame:
    """(string, from_NAME...): words of several lists, lower-cased, letters only, two at least, with a flag for each list."""
    every = None
    for name, df in lists.items():
        own = df.select(F.lower(F.trim("word")).alias("string")).where(F.col("string").rlike("^[a-z]{2,}$")).select("string", F.lit(name).alias("list"))
        every = own if every is None else every.union(own)
    flags = [F.max((F.col("list") == n).cast("int")).alias(f"from_{n}") for n in lists]
    return every.groupBy("string").agg(*flags)


def last_seen(lines: DataFrame, order: str, value: Column, by: list[str] | None = None) -> Column:
    """The last non-null value up to each row: base words of a list, blocks of a file."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)
