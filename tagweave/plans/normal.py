"""Normalisation, filters, text and scalar functions (X, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import functions as fn
from tagweave.operators import normalize as nz
from tagweave.operators import cooc
from tagweave.plans.registry import Tables, query

_NORM = """norm AS (SELECT string, word AS lemma FROM fx_dict WHERE is_stopword = 0
 UNION ALL SELECT word, word FROM fx_addl WHERE word NOT IN (SELECT string FROM fx_dict WHERE is_stopword = 0))"""


@query("x01_norm_tags", f"WITH {_NORM} SELECT doc_id, pos, lemma AS tag FROM fx_raw JOIN norm ON raw_tag = string")
def _(t: Tables):
    return nz.norm_tags(t.raw, t.dictionary, t.addl).select("doc_id", "pos", "tag")


@query("x02_norm_dictionary", f"WITH {_NORM} SELECT string, lemma FROM norm")
def _(t):
    return nz.norm_dictionary(t.dictionary, t.addl)


@query("x01_norm_keep_stopwords", "SELECT lemma AS tag, count(*) AS n FROM fx_raw JOIN (SELECT string, word AS lemma FROM fx_dict) ON raw_tag = string GROUP BY ALL")
def _(t):
    return nz.norm_tags(t.raw, t.dictionary, None, filter_stopword=False).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("x03_min_length", f"WITH {_NORM} SELECT doc_id, lemma AS tag FROM fx_raw JOIN norm ON raw_tag = string WHERE length(lemma) > 4")
def _(t):
    return nz.norm_tags(t.raw, t.dictionary, t.addl, min_len=5).select("doc_id", "tag")


@query("x04_distinct_in_document", f"WITH {_NORM} SELECT DISTINCT doc_id, lemma AS tag FROM fx_raw JOIN norm ON raw_tag = string")
def _(t):
    return nz.norm_tags(t.raw, t.dictionary, t.addl, keys=["doc_id"])


@query("x05_vocabulary_membership", "SELECT doc_id, pos, raw_tag FROM fx_raw WHERE raw_tag IN (SELECT word FROM fx_words)")
def _(t):
    return t.raw.join(nz.small(t.words.withColumnRenamed("word", "raw_tag")), "raw_tag", "left_semi").select("doc_id", "pos", "raw_tag")


@query("x06_frequency_threshold", "SELECT tag FROM fx_uni WHERE freq > 500")
def _(t):
    return nz.vocabulary(t.uni, 500)


@query("x07_strict_cap", "SELECT tag, freq FROM fx_uni WHERE freq > (SELECT min(freq) FROM (SELECT freq FROM fx_uni ORDER BY freq DESC, tag LIMIT 10))")
def _(t):
    return nz.strict_cap(t.uni, 10)


@query(
    "x08_terms_to_words",
    f"""WITH {_NORM}, p AS (SELECT DISTINCT raw_tag AS term FROM fx_doc_tags),
 w AS (SELECT term, unnest(string_split(term, ' ')) AS x, generate_subscripts(string_split(term, ' '), 1) AS i FROM p)
 SELECT term, coalesce(string_agg(lemma, ',' ORDER BY i), '') AS words FROM p LEFT JOIN (SELECT term, i, lemma FROM w JOIN norm ON x = string) USING (term) GROUP BY term""",
)
def _(t):
    return nz.norm_terms(t.doc_tags.select(F.col("raw_tag").alias("term")), t.dictionary, t.addl).select("term", F.array_join("words", ",").alias("words"))


@query("x09_lemma_names", "SELECT DISTINCT lower(replace(n_name, '_', ' ')) AS name FROM nation")
def _(t):
    return t.nation.select(fn.lemma_name("n_name").alias("name")).distinct()


@query(
    "x10_letter_patterns",
    "SELECT p_partkey, regexp_extract(p_brand, '^([a-zA-Z]*)', 1) AS prefix, regexp_matches(p_type, '^[a-zA-Z]*$') AS whole, regexp_matches(p_brand, '^[a-zA-Z]') AS begins FROM part",
)
def _(t):
    return t.part.select("p_partkey", fn.alpha_prefix("p_brand").alias("prefix"), fn.alpha_only("p_type").alias("whole"), fn.starts_alpha("p_brand").alias("begins"))


@query("x11_hash_directory", "SELECT o_orderkey, substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 1, 2) || '/' || substr(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 3, 2) || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.json' AS path FROM orders")
def _(t):
    return t.orders.select("o_orderkey", fn.hash_dir(F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"))


@query("x12_identifier_from_url", r"SELECT page_id, nullif(regexp_extract(url, '/(\d+)(?:[_.?#/]|$)', 1), '') AS photo FROM pages")
def _(t):
    return t.pages.select("page_id", fn.photo_id("url").alias("photo"))


@query("x13_url_filter_counts", "SELECT count(*) AS n_all, count(*) FILTER (contains(url, '/en/')) AS n_kept FROM pages")
def _(t):
    return t.pages.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("url").contains("/en/")).alias("n_kept"))


@query("x14_photo_url", "SELECT o_orderkey, 'http://farm' || CAST(o_custkey % 9 AS VARCHAR) || '.example.net/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '_' || o_orderstatus || '.jpg' AS url FROM orders")
def _(t):
    return t.orders.select("o_orderkey", fn.photo_url(F.col("o_custkey") % 9, "o_custkey", "o_orderkey", "o_orderstatus").alias("url"))


@query(
    "x15_windows_paths",
    r"WITH p AS (SELECT s_suppkey, 'C:\img\' || s_name || '\00_' || CAST(s_suppkey AS VARCHAR) || '.jpg' AS path FROM supplier) SELECT s_suppkey, split_part(replace(path, '\', '/'), '/', 3) || '/' || split_part(replace(path, '\', '/'), '/', 4) AS name, CAST(s_suppkey AS VARCHAR) AS id FROM p",
)
def _(t):
    path = F.concat(F.lit("C:\\img\\"), "s_name", F.lit("\\00_"), F.col("s_suppkey").cast("string"), F.lit(".jpg"))
    return t.supplier.select("s_suppkey", fn.relative_name(path).alias("r")).select("s_suppkey", "r.name", "r.id")


@query(
    "x16_frame_identifiers",
    "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS img_id, lpad(CAST(turn AS VARCHAR), 2, '0') AS sent_id, '02' AS frame_no FROM conversations",
)
def _(t):
    ident = F.concat_ws("_", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("02"))
    return t.conversations.select("conv_id", "turn", fn.frame_id_parts(ident).alias("p")).select("conv_id", "turn", "p.*")


@query("x17_strip_counts", "SELECT p_partkey, regexp_replace(p_brand || ':1', ':1$', '') AS a, regexp_replace(p_brand, ':1$', '') AS b FROM part")
def _(t):
    return t.part.select("p_partkey", fn.strip_count(F.concat("p_brand", F.lit(":1"))).alias("a"), fn.strip_count("p_brand").alias("b"))


_HAND = (("hotter", "hot"), ("colder", "cold"), ("golden", "gold"))


@query(
    "x18_key_fallbacks",
    """WITH n AS (SELECT DISTINCT raw_tag AS name FROM fx_raw UNION SELECT 'hotter' UNION SELECT 'golden'), h(name, target) AS (VALUES ('hotter', 'hot'), ('colder', 'cold'), ('golden', 'gold')),
 k AS (SELECT word AS key FROM fx_words)
 SELECT n.name, coalesce(k1.key, k2.key, k3.key) AS key, CASE WHEN k1.key IS NOT NULL THEN 'exact' WHEN k2.key IS NOT NULL THEN 'shorter' WHEN k3.key IS NOT NULL THEN 'hand' ELSE 'none' END AS how
 FROM n LEFT JOIN k k1 ON n.name = k1.key LEFT JOIN k k2 ON substr(n.name, 1, length(n.name) - 1) = k2.key LEFT JOIN h ON n.name = h.name LEFT JOIN k k3 ON h.target = k3.key""",
)
def _(t):
    names = t.raw.select(F.col("raw_tag").alias("name")).union(t.spark.createDataFrame([("hotter",), ("golden",)], "name string"))
    return nz.fallback_keys(names, t.words.withColumnRenamed("word", "key"), t.spark.createDataFrame(list(_HAND), "name string, target string"))


@query("x19_exclude_plurals", "SELECT DISTINCT raw_tag AS tag FROM fx_raw WHERE raw_tag NOT IN (SELECT word FROM fx_addl UNION SELECT word || 's' FROM fx_addl UNION SELECT substr(word, 1, length(word) - 1) FROM fx_addl)")
def _(t):
    return nz.exclude_plurals(t.raw.select(F.col("raw_tag").alias("tag")), t.addl.select(F.col("word").alias("tag")))


@query("x20_log_and_max_scale", "SELECT tag, round(ln(freq + 1), 6) AS logged, round(ln(freq + 1) / max(ln(freq + 1)) OVER (), 6) AS scaled FROM fx_uni")
def _(t):
    return nz.max_scale(t.uni, "freq").select("tag", F.round("logged", 6).alias("logged"), F.round("scaled", 6).alias("scaled"))


@query("x21_saturating_renorm", "SELECT src, dst, round(5e-1 * (1 - exp(-w / 10)) / (1 + exp(-w / 10)), 6) AS logistic, round(log10(1 + w), 6) AS log10 FROM fx_graph")
def _(t):
    return t.graph.select("src", "dst", F.round(fn.logistic_renorm(F.col("w") / 10), 6).alias("logistic"), F.round(fn.log10_renorm("w"), 6).alias("log10"))


@query("x22_row_normalize", "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM fx_graph")
def _(t):
    return nz.row_normalize(t.graph).select("src", "dst", F.round("p", 6).alias("p"))


@query("x23_normalize_all_ways", "SELECT src, dst, round(w / sum(w) OVER (), 9) AS whole, round(w / sum(w) OVER (PARTITION BY dst), 6) AS col FROM fx_graph")
def _(t):
    a = nz.normalize_by(t.graph, "w").select("src", "dst", F.round("normal", 9).alias("whole"))
    return a.join(nz.normalize_by(t.graph, "w", ["dst"]).select("src", "dst", F.round("normal", 6).alias("col")), ["src", "dst"])


@query(
    "x24_box_normalize",
    """WITH b AS (SELECT o_orderstatus AS dim, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL)
 SELECT o_orderkey, round((o_totalprice - lo) / CASE WHEN hi - lo < 1e-12 THEN 1 ELSE hi - lo END, 6) AS boxed FROM orders JOIN b ON o_orderstatus = dim WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("dim"), F.col("o_totalprice").alias("value"))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    got = nz.box_normalize(o.where(early), o.where(~early), "dim", "value")
    return got.select("o_orderkey", F.round("boxed", 6).alias("boxed"))


@query(
    "x25_smooth_hinge",
    """WITH v AS (SELECT c_custkey, c_acctbal / 5000 - 5e-1 AS z FROM customer)
 SELECT c_custkey, round(CASE WHEN z <= 0 THEN 5e-1 - z WHEN z < 1 THEN 5e-1 * (1 - z) * (1 - z) ELSE 0 END, 6) AS loss, round(CASE WHEN z <= 0 THEN -1 WHEN z < 1 THEN z - 1 ELSE 0 END, 6) AS slope FROM v""",
)
def _(t):
    z = F.col("c_acctbal") / 5000 - 0.5
    return t.customer.select("c_custkey", F.round(fn.smooth_hinge(z), 6).alias("loss"), F.round(fn.smooth_hinge_slope(z), 6).alias("slope"))


# ---- text ----
@query(
    "t01_html_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(h, '<[^>]*>', ' ', 'g') AS h FROM a),
 c AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS h FROM b)
 SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM c""",
)
def _(t):
    return t.pages.select("page_id", fn.html_to_text("html").alias("text"))


@query("t01_printable_ascii", r"SELECT doc_id, md5(regexp_replace(replace(replace(text, chr(10), ' . '), chr(13), ' '), '[^\x20-\x7E\t]', '', 'g')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(fn.ascii_printable("text")).alias("digest"))


_SENT = r"""s0 AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
 sent AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM s0)"""


@query("t02_sentences", f"WITH {_SENT} SELECT doc_id, CAST(i - 1 AS INT) AS i, md5(sentence) AS digest FROM sent")
def _(t):
    d = t.documents.select("doc_id", F.posexplode(fn.sentences("text")).alias("i", "sentence"))
    return d.select("doc_id", "i", F.md5("sentence").alias("digest"))


@query("t03_caption_filter", f"WITH {_SENT} SELECT doc_id, count(*) AS n FROM sent WHERE regexp_matches(sentence, '[A-Za-z]') AND len(string_split_regex(trim(sentence), '\\s+')) >= 3 GROUP BY ALL")
def _(t):
    d = t.documents.select("doc_id", F.explode(fn.sentences("text")).alias("sentence"))
    d = d.where(F.col("sentence").rlike("[A-Za-z]") & (F.size(F.split(F.trim("sentence"), r"\s+")) >= 3))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t04_truncate_sentences",
    r"SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN ' ' || substr(text, 1, 1000) || regexp_extract(substr(text, 1001), '^(\S*)', 1) ELSE text END) AS digest FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.md5(fn.truncate_words("text")).alias("digest"))


@query("t05_bag_of_words", f"WITH {_NORM}, w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || 's'), '[a-z]+')) AS x FROM part) SELECT p_partkey, lemma AS word, count(*) AS n FROM w JOIN norm ON x = string GROUP BY ALL")
def _(t):
    w = t.part.select("p_partkey", F.explode(fn.words(F.concat("p_name", F.lit("s")))).alias("raw_tag"))
    return nz.norm_tags(w, t.dictionary, t.addl).groupBy("p_partkey", F.col("tag").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("t06_bracket_forms", r"""SELECT conv_id, turn, md5(replace(replace('-LRB- ' || text || ' -RRB- ``x''''', '-LRB-', '('), '-RRB-', ')')) AS lone FROM conversations""")
def _(t):
    c = F.concat(F.lit("-LRB- "), "text", F.lit(" -RRB- ``x''"))
    plain = F.replace(F.replace(fn.bracket_canonical(c), F.lit('"x"'), F.lit("``x''")), F.lit("-"), F.lit("-"))
    return t.conversations.select("conv_id", "turn", F.md5(plain).alias("lone"))


_PREPS = ("in front of", "on", "of", "in", "at", "with")


@query(
    "t07_phrase_counts",
    "SELECT doc_id, " + ", ".join(f"CAST((length(text) - length(replace(text, '{p}', ''))) / {len(p)} AS BIGINT) AS {p.replace(' ', '_')}_n" for p in _PREPS) + " FROM documents",
)
def _(t):
    return t.documents.select("doc_id", *[fn.substring_count("text", p).alias(f"{p.replace(' ', '_')}_n") for p in _PREPS])


@query(
    "t08_word_pairs",
    """WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM conversations),
 k AS (SELECT * FROM w WHERE length(x) = 3)
 SELECT least(a.x, b.x) AS w1, greatest(a.x, b.x) AS w2, count(*) AS n FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i < a.i WHERE a.x <> b.x GROUP BY ALL""",
)
def _(t):
    w = F.filter(fn.words("text"), lambda x: F.length(x) == 3)
    pairs = F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, 1 << 20), lambda b: F.struct(F.least(a, b).alias("w1"), F.greatest(a, b).alias("w2")))))
    d = t.conversations.select(F.explode(pairs).alias("p")).where("p.w1 <> p.w2")
    return d.groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t09_frame_spans",
    """WITH l AS (SELECT conv_id, turn, 3 + (turn * 2) AS a, 12 + (turn * 3) AS z, text FROM conversations UNION ALL SELECT conv_id, turn, 1 + turn, 5 + turn, text FROM conversations),
 s AS (SELECT conv_id, turn, min(a) AS a, max(z) AS z, any_value(text) AS text FROM l GROUP BY conv_id, turn)
 SELECT conv_id, turn, substr(text, CAST(a AS BIGINT) + 1, CAST(z - a + 1 AS BIGINT)) AS span FROM s""",
)
def _(t):
    c = t.conversations
    lab = c.select("conv_id", "turn", F.explode(F.array(F.struct((3 + F.col("turn") * 2).alias("a"), (12 + F.col("turn") * 3).alias("z")), F.struct((1 + F.col("turn")).alias("a"), (5 + F.col("turn")).alias("z")))).alias("l"))
    s = lab.groupBy("conv_id", "turn").agg(F.min("l.a").alias("a"), F.max("l.z").alias("z"))
    return c.join(s, ["conv_id", "turn"]).select("conv_id", "turn", F.substring(F.col("text"), F.col("a").cast("int") + 1, (F.col("z") - F.col("a") + 1).cast("int")).alias("span"))


@query("t10_frame_bags", "WITH w AS (SELECT conv_id, turn, role, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS x FROM conversations) SELECT conv_id, turn, x || ':1' AS feat FROM w WHERE length(x) > 1 UNION ALL SELECT conv_id, turn, role || ':1' FROM conversations")
def _(t):
    c = t.conversations
    w = c.select("conv_id", "turn", F.explode(F.array_distinct(fn.words("text"))).alias("x")).where(F.length("x") > 1)
    return w.union(c.select("conv_id", "turn", "role")).select("conv_id", "turn", F.concat("x", F.lit(":1")).alias("feat"))


@query("t11_frame_elements", "SELECT p_partkey, p_type || '|' || lower(p_brand) || '|' || lower(p_name) AS elements FROM part")
def _(t):
    tok = F.array(F.concat("p_type", F.lit(":1")), F.lit("Target:1"), F.concat("p_brand", F.lit(":1")), F.concat("p_name", F.lit(":1")))
    return t.part.select("p_partkey", F.array_join(fn.frame_elements(tok), "|").alias("elements"))


@query(
    "t12_tags_of_concepts",
    f"WITH {_NORM}, w AS (SELECT DISTINCT raw_tag AS wnid, unnest(string_split_regex(lower(raw_tag), '[ ,]+')) AS x FROM fx_doc_tags) SELECT lemma AS tag, string_agg(wnid, '|' ORDER BY wnid) AS concepts FROM (SELECT DISTINCT wnid, lemma FROM w JOIN norm ON x = string) GROUP BY ALL",
)
def _(t):
    w = t.doc_tags.select(F.col("raw_tag").alias("wnid")).distinct().select("wnid", F.explode(F.split(F.lower("wnid"), "[ ,]+")).alias("raw_tag"))
    n = nz.norm_tags(w, t.dictionary, t.addl, keys=["wnid"])
    return n.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("wnid")), "|").alias("concepts"))


@query("t13_normalise_documents", f"WITH {_NORM} SELECT doc_id, coalesce(string_agg(lemma, ',' ORDER BY lemma), '') AS tags FROM fx_raw LEFT JOIN norm ON raw_tag = string GROUP BY doc_id")
def _(t):
    n = nz.norm_tags(t.raw, t.dictionary, t.addl).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return t.raw.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("tags", F.lit("")).alias("tags"))


@query("t14_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x10_unigrams_of_alpha_words", "SELECT raw_tag AS tag, count(*) AS freq FROM (SELECT DISTINCT doc_id, raw_tag FROM fx_raw WHERE regexp_matches(raw_tag, '^[a-z]+$')) GROUP BY ALL")
def _(t):
    return cooc.unigrams(t.raw.where(F.col("raw_tag").rlike("^[a-z]+$")).withColumnRenamed("raw_tag", "tag"))
