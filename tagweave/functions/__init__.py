"""Column builders: everything here stays inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "alpha_only", "alpha_prefix", "ascii_printable", "binary_mi", "bracket_canonical", "counts_of", "entropy_term", "frame_elements",
    "frame_id_parts", "hash_dir", "html_to_text", "lemma_name", "log10_renorm", "logistic_renorm", "nearest_bin", "pairs_of", "photo_id",
    "photo_url", "relative_name", "sentences", "smooth_hinge", "smooth_hinge_slope", "starts_alpha", "strip_count", "substring_count", "truncate_words", "words",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- names and identifiers ----
def alpha_prefix(s) -> Column:
    """The letters that a string starts with."""
    return F.regexp_extract(_c(s), "^([a-zA-Z]*)", 1)


def alpha_only(s) -> Column:
    return _c(s).rlike("^[a-zA-Z]*$")


def starts_alpha(s) -> Column:
    return _c(s).rlike("^[a-zA-Z]")


def lemma_name(s) -> Column:
    """Lower case, with underscores as blanks."""
    return F.lower(F.translate(_c(s), "_", " "))


def hash_dir(ident, levels: int = 2, chars: int = 2, suffix: str = ".json") -> Column:
    """Directory of an identifier: its first characters, ``chars`` at a time, then the whole of it."""
    c = _c(ident)
    return F.concat_ws("/", *[F.substring(c, 1 + k * chars, chars) for k in range(levels)], F.concat(c, F.lit(suffix)))


def photo_id(url, pattern: str = r"/(\d+)(?:[_.?#/]|$)") -> Column:
    """The identifier within a URL, null where there is none."""
    return F.nullif(F.regexp_extract(_c(url), pattern, 1), F.lit(""))


def photo_url(farm, server, ident, secret) -> Column:
    return F.format_string("http://farm%s.example.net/%s/%s_%s.jpg", *(_c(x).cast("string") for x in (farm, server, ident, secret)))


def relative_name(path) -> Column:
    """struct(name, id) of a path with backslashes: the part from the second last folder on, and what stands after the last underscore."""
    parts = F.split(F.translate(_c(path), "\\", "/"), "/")
    name = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return F.struct(
        name.alias("name"), F.element_at(F.split(F.element_at(F.split(F.element_at(parts, -1), r"\."), 1), "_"), -1).alias("id")
    )


def frame_id_parts(frame_id) -> Column:
    """struct(img_id, sent_id, frame_no) as strings, so that leading zeros stay."""
    p = F.split(_c(frame_id), "_")
    return F.struct(p[0].alias("img_id"), p[1].alias("sent_id"), p[2].alias("frame_no"))


def strip_count(token) -> Column:
    """A token without its count ``:1``; other trailing digits stay."""
    return F.regexp_replace(_c(token), ":1$", "")


# ---- text ----
def html_to_text(page) -> Column:
    """Text of a page by rule: script, style and comments go, tags become blanks, five entities are resolved, blanks are collapsed."""
    c = F.regexp_replace(_c(page), r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ascii_printable(s) -> Column:
    """Line feeds become `` . ``, returns blanks, and all but printable ASCII goes."""
    c = F.replace(F.replace(_c(s), F.lit("\n"), F.lit(" . ")), F.lit("\r"), F.lit(" "))
    return F.regexp_replace(c, r"[^\x20-\x7E\t]", "")


def sentences(s) -> Column:
    """Sentences by rule: they end at . ! or ? before white space."""
    return F.filter(F.split(F.trim(_c(s)), r"(?<=[.!?])\s+"), lambda x: x != "")


def words(s) -> Column:
    """Lower-cased runs of a-z."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit("([a-z]+)"), 1)


def truncate_words(s, limit: int = 1000) -> Column:
    """Texts longer than ``limit`` end with the word that first passes it, and start with a blank."""
    c = _c(s)
    head = F.substring(c, 1, limit)
    rest = F.regexp_extract(F.expr("''") if limit < 0 else F.substring(c, limit + 1, 1 << 30), r"^(\S*)", 1)
    return F.when(F.length(c) > limit, F.concat(F.lit(" "), head, rest)).otherwise(c)


def bracket_canonical(s) -> Column:
    """One form for brackets and quotes."""
    c = _c(s)
    for a, b in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("``", '"'), ("''", '"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "‘’“”", "''\"\"")


def substring_count(s, part: str) -> Column:
    """Occurrences of a string that don't overlap."""
    c = _c(s)
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def frame_elements(tokens) -> Column:
    """A frame's name, then its elements from the third token on in lower case."""
    t = F.transform(_c(tokens), strip_count)
    return F.concat(F.slice(t, 1, 1), F.transform(F.slice(t, 3, 1 << 20), F.lower))


# ---- arrays and maps ----
def pairs_of(tags) -> Column:
    """All pairs (w1 < w2) of an array's distinct strings, within the row."""
    t = F.sort_array(F.array_distinct(_c(tags)))
    return F.flatten(
        F.transform(t, lambda a, i: F.transform(F.slice(t, i + 2, F.greatest(F.size(t), F.lit(0))), lambda b: F.struct(a.alias("w1"), b.alias("w2"))))
    )


def counts_of(line, sep: str = " ") -> Column:
    """``tag:count tag:count`` as an array of struct(tag, cnt)."""
    part = lambda x: F.split(x, ":")
    return F.transform(
        F.filter(F.split(_c(line), sep), lambda x: x.rlike(r"^.+:\d+$")),
        lambda x: F.struct(part(x)[0].alias("tag"), part(x)[1].cast("long").alias("cnt")),
    )


# ---- numbers ----
def logistic_renorm(x) -> Column:
    """0.5 (1 - e^-x) / (1 + e^-x)."""
    e = F.exp(-_c(x))
    return F.lit(0.5) * (1 - e) / (1 + e)


def log10_renorm(x) -> Column:
    return F.log10(1 + _c(x))


def smooth_hinge(x) -> Column:
    c = _c(x)
    return F.when(c <= 0, F.lit(0.5) - c).when(c < 1, F.lit(0.5) * (1 - c) * (1 - c)).otherwise(F.lit(0.0))


def smooth_hinge_slope(x) -> Column:
    c = _c(x)
    return F.when(c <= 0, F.lit(-1.0)).when(c < 1, c - 1).otherwise(F.lit(0.0))


def entropy_term(p) -> Column:
    """-p log2 p, 0 for p = 0."""
    c = _c(p)
    return F.when(c > 0, -c * F.log2(c)).otherwise(F.lit(0.0))


def binary_mi(n, x, y, xy) -> Column:
    """Mutual information in bits of two binary events from counts: n trials, x and y hits, xy joint hits.

    Cells whose probability is 0 add nothing.
    """
    n, x, y, xy = (_c(v).cast("double") for v in (n, x, y, xy))

    def cell(joint, a, b):
        p, pa, pb = joint / n, a / n, b / n
        return F.when((p > 0) & (pa > 0) & (pb > 0), p * F.log2(p / (pa * pb))).otherwise(F.lit(0.0))

    return cell(xy, x, y) + cell(x - xy, x, n - y) + cell(y - xy, n - x, y) + cell(n + xy - x - y, n - x, n - y)


def nearest_bin(x, low: float, width: float, n: int) -> Column:
    """Index of the nearest of ``n`` bin centres low, low + width, ...; the outer bins take all beyond."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((_c(x) - low) / width + 0.5).cast("int")))
