"""Document fingerprints: bottom-k sketches of hashed word shingles, in DataFrame functions alone.

A sketch is the sorted array of the k least distinct 64-bit hashes of a text's
shingles of five words. Sketches of parts merge into the sketch of the whole
(the k least of their union), and two of them estimate resemblance (Jaccard),
containment and the number of distinct shingles. Below k distinct shingles all
of these are exact.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle, and hashes that a sketch keeps.
SHINGLE, K = 5, 128
#: Bytes of text that a range of neighbouring documents should hold, and the most ranges (their bounds are one literal).
RANGE_BYTES, MAX_RANGES = 8 << 20, 1 << 14
_LAST = (1 << 63) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles, in the text's order, repeats included; a text of fewer words is one shingle, one of none has none.

    Words are runs of ASCII letters and digits and of all characters from
    U+0080 on, in lower case. Null texts have no words.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def hashes(w: Column) -> Column:
        # a text that begins or ends with other characters has an empty first or last word
        first = F.when(w[0] == "", 1).otherwise(0)
        last = F.size(w) - F.when(F.element_at(w, -1) == "", 2).otherwise(1)
        starts = F.when(last >= first, F.sequence(first, F.greatest(first, last - (size - 1))))
        one = lambda i: F.xxhash64(*(F.when(i + j <= last, F.get(w, i + j)) for j in range(size)))  # noqa: E731  nulls leave a hash as it is
        return F.coalesce(F.transform(starts, one), F.array().cast("array<bigint>"))

    return _let(words, hashes)


def sketch(text: Column, size: int = SHINGLE, k: int = K) -> Column:
    """array<bigint>: the ``k`` least distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together. Commutative, associative, and merging a part again changes nothing."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; two texts without words are alike (1)."""

    def of(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return _let(merge(a, b, k), of)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (double): exact below ``k``, else (k - 1) / the share of hashes up to the k-th least."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; a text without words is within any."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, group: str, column: str, k: int = K) -> DataFrame:
    """(group, column): the merged sketch of each group's rows.

    Equal hashes meet in partial aggregates, and of each group's hashes only the
    ``k`` least of every task travel (a row-number limit is pushed below the
    exchange), so a group of any size sends ``k`` rows a task. Null sketches and
    empty ones add nothing; a group of these alone has an empty sketch. Null is
    a group like any other.
    """
    one = df.select(F.col(group).alias("_g"), F.explode_outer(column).alias("_h")).distinct()
    least = one.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_n") <= k)
    return least.groupBy("_g").agg(F.sort_array(F.collect_list("_h")).alias(column)).select(F.col("_g").alias(group), column)


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 lowercase hex digits a hash, in order. Equal sketches have equal strings."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def from_text(s: Column) -> Column:
    """The sketch of a string that ``as_text`` made."""
    one = lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    return F.when(F.length(s) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(s) / 16).cast("int") - 1), one))


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the first ``n`` sorted ``bounds`` are at most ``key``, less one: a binary search by halving steps."""
    steps = F.array(*(F.lit(1 << p) for p in reversed(range(n.bit_length()))))
    more = lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), more) - 1


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, *carry, next_text, next_*): each document beside the one that follows it in descending order of ids.

    After the last comes the first. Rows without an id come last (beside the least
    64-bit id, should that occur); rows of one id
    follow each other by a hash of their text and then by it. Texts are shuffled
    once, to ranges of neighbouring ids whose bounds come from a sample of keys
    (at most 16 for each of at most 16,384 ranges). A bound is a row's key, so
    a range's first row is known beforehand, and travels to the range before as
    well: no window spans the table.
    """
    carry = carry or {}
    order = F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(_LAST))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), order.alias("_o"), F.xxhash64(text).alias("_h"))
    key = F.struct("_o", "_h")
    n, size, first = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text")), F.min(key)).first()
    n_ranges = min(n, MAX_RANGES, max(64, (size or 0) // RANGE_BYTES))
    # a sample decides how even ranges are, never what is compared
    picked = sorted(tuple(r) for r in rows.select("_o", "_h").sample(min(1.0, 16 * n_ranges / max(n, 1)), seed=7).collect())
    cuts = sorted({tuple(first), *(picked[i * len(picked) // n_ranges] for i in range(1, n_ranges) if picked)}) if n else []
    bounds = F.from_json(F.lit(json.dumps([{"_o": o, "_h": h} for o, h in cuts])), "array<struct<_o:bigint,_h:bigint>>")
    own = _range_of(key, bounds, len(cuts))
    places = _let(
        own,
        lambda r: F.when(
            F.get(bounds, r) == key,
            F.array(F.struct(r.alias("range"), F.lit(False).alias("guest")), F.struct(F.pmod(r - 1, F.lit(max(1, len(cuts)))).alias("range"), F.lit(True).alias("guest"))),
        ).otherwise(F.array(F.struct(r.alias("range"), F.lit(False).alias("guest")))),
    )
    dealt = rows.select("*", F.explode(places).alias("_p")).select("doc_id", "text", "_o", "_h", "_p.range", "_p.guest")
    dealt = dealt.repartition("range").select("*", *(c.alias(a) for a, c in carry.items()))
    after = Window.partitionBy("range").orderBy("guest", "_o", "_h", "text")
    kept = ["text", *carry]
    return dealt.select("*", *(F.lead(c).over(after).alias(f"next_{c}") for c in kept)).where("not guest").select("doc_id", *kept, *(f"next_{c}" for c in kept))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, edited_contained).

    The edited text is the document with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document in descending
    order of ids. ``near_*`` estimate the resemblance of the document with its
    edited text and with the next document, ``n_shingles`` its distinct
    shingles, ``edited_contained`` the share of its shingles that the edited
    text has.

    Null texts are empty. Equal texts have equal fingerprints; a text without
    words has an empty one, and two of these resemble each other fully. Repeated
    rows follow each other, a single row follows itself, an empty table gives an
    empty one. Long texts are read whole. Other columns are left aside.
    """
    near = with_next(docs, id_col, text_col, {"own": sketch(F.col("text"), size, k)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    wide = near.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    wide = wide.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), size, k).alias("new"))
    own, new = F.col("own"), F.col("new")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(new).alias("edited_fingerprint"),
        resemblance(own, new, k).alias("near_edited"), resemblance(own, F.col("next_own"), k).alias("near_next"),
        distinct_shingles(own, k).alias("n_shingles"), containment(own, new, k).alias("edited_contained"),
    )
