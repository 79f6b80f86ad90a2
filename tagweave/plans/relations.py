"""Joins, set operations, windows, orders (J, E, W, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import cooc, features, graph, neighbours, stats
from tagweave.operators.normalize import small
from tagweave.plans.registry import query
from tagweave.session import stage_table


@query("j01_dictionary_left_join", "SELECT doc_id, pos, word AS lemma FROM fx_raw LEFT JOIN fx_dict ON raw_tag = string")
def _(t):
    return t.raw.join(small(t.dictionary.select(F.col("string").alias("raw_tag"), F.col("word").alias("lemma"))), "raw_tag", "left").select("doc_id", "pos", "lemma")


@query("j02_unknown_users", "SELECT o_orderkey, coalesce(CAST(c_custkey AS VARCHAR), 'unk') AS user_id FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey")
def _(t):
    u = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").cast("string").alias("u"))
    return t.orders.join(u, "o_custkey", "left").select("o_orderkey", F.coalesce("u", F.lit("unk")).alias("user_id"))


@query("j03_images_with_tags", "SELECT img_id, coalesce(tags, '') AS tags FROM fx_images LEFT JOIN (SELECT doc_id, string_agg(raw_tag, ',' ORDER BY raw_tag) AS tags FROM fx_doc_tags WHERE raw_tag < 'n' GROUP BY doc_id) ON img_id = doc_id")
def _(t):
    g = t.doc_tags.where("raw_tag < 'n'").groupBy(F.col("doc_id").alias("img_id")).agg(F.array_join(F.array_sort(F.collect_list("raw_tag")), ",").alias("tags"))
    return t.images.join(g, "img_id", "left").select("img_id", F.coalesce("tags", F.lit("")).alias("tags"))


@query("j04_concepts_with_counts", "SELECT n_name AS wnid FROM nation WHERE n_name IN (SELECT wnid FROM fx_counts WHERE cnt > 5)")
def _(t):
    return t.nation.select(F.col("n_name").alias("wnid")).join(t.counts.where("cnt > 5"), "wnid", "left_semi")


@query("j05_pairs_in_document", "SELECT a.doc_id, a.raw_tag AS w1, b.raw_tag AS w2 FROM fx_doc_tags a JOIN fx_doc_tags b ON a.doc_id = b.doc_id AND a.raw_tag < b.raw_tag")
def _(t):
    from tagweave import functions as fn

    g = t.doc_tags.groupBy("doc_id").agg(F.collect_set("raw_tag").alias("tags"))
    return g.select("doc_id", F.explode(fn.pairs_of("tags")).alias("p")).select("doc_id", "p.w1", "p.w2")


@query(
    "j06_index_pairs",
    """WITH r AS (SELECT wnid, tag, row_number() OVER (PARTITION BY tag ORDER BY cnt DESC, wnid) AS rn FROM fx_counts)
 SELECT a.tag, a.wnid AS wi, b.wnid AS wj FROM r a JOIN r b ON a.tag = b.tag AND a.rn > b.rn WHERE a.rn <= 6""",
)
def _(t):
    r = stats.top_in_group(t.counts, ["tag"], 6, F.desc("cnt"), "wnid").select("tag", "wnid", "place")
    return r.toDF("tag", "wi", "pi").join(r.toDF("tag", "wj", "pj"), "tag").where("pi > pj").select("tag", "wi", "wj")


@query(
    "j07_pairs_with_similarity",
    "SELECT p.w1, p.w2, p.freq, coalesce(s.weight, -1) AS sim FROM fx_pairs p LEFT JOIN (SELECT split_part(raw_tag, ' ', 1) || ' x' AS a, raw_tag AS w2, CAST(length(raw_tag) AS DOUBLE) AS weight FROM (SELECT DISTINCT raw_tag FROM fx_doc_tags)) s ON p.w2 = s.w2 AND p.w1 > s.a",
)
def _(t):
    s = t.doc_tags.select("raw_tag").distinct().select(F.concat(F.split("raw_tag", " ")[0], F.lit(" x")).alias("a"), F.col("raw_tag").alias("w2"), F.length("raw_tag").cast("double").alias("weight"))
    p = t.pairs
    return p.join(s, (p["w2"] == s["w2"]) & (p["w1"] > s["a"]), "left").select(p["w1"], p["w2"], "freq", F.coalesce("weight", F.lit(-1.0)).alias("sim"))


@query("j08_triples_in_vocabulary", "SELECT rel, w1, w2, weight FROM fx_triples t WHERE EXISTS (SELECT 1 FROM fx_scores s WHERE s.score > 50 AND least(s.w1, s.w2) = least(t.w1, t.w2) AND greatest(s.w1, s.w2) = greatest(t.w1, t.w2)) AND lower(rel) IN ('economy', 'small')")
def _(t):
    return graph.filter_triples(t.triples, ["Economy", "small"], t.scores.where("score > 50"))


_FRAMES = "f AS (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS frame_id, role, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations)"


def _frames(t):
    from tagweave import functions as fn

    return t.conversations.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("frame_id"), "role", F.array_distinct(fn.words("text")).alias("w"))


@query("j09_frame_pairs_with_words", f"WITH {_FRAMES} SELECT frame_id, x AS feat, role FROM (SELECT frame_id, role, unnest(w) AS x FROM f) WHERE length(x) = 4")
def _(t):
    f = _frames(t)
    pairs = f.select("frame_id", "role")
    words = f.select("frame_id", F.explode("w").alias("feat")).where(F.length("feat") == 4)
    return pairs.join(words, "frame_id").select("frame_id", "feat", "role")


@query("j10_relations_with_features", "SELECT rel, tr.w1, tr.w2, score FROM fx_triples tr JOIN fx_scores s ON tr.w1 = s.w1 AND tr.w2 = s.w2")
def _(t):
    return t.triples.join(t.scores, ["w1", "w2"]).select("rel", "w1", "w2", "score")


@query(
    "j11_terms_to_word_pairs",
    """WITH i AS (SELECT DISTINCT raw_tag AS term, split_part(raw_tag, ' ', 1) AS word FROM fx_doc_tags UNION SELECT DISTINCT raw_tag, split_part(raw_tag, ' ', 2) FROM fx_doc_tags)
 SELECT a.word AS w1, b.word AS w2, count(*) AS n FROM i a JOIN i b ON a.term = b.term AND a.word < b.word GROUP BY ALL""",
)
def _(t):
    i = t.doc_tags.select(F.col("raw_tag").alias("term")).distinct().select("term", F.explode(F.split("term", " ")).alias("word")).distinct()
    return i.toDF("term", "w1").join(i.toDF("term", "w2"), "term").where("w1 < w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


@query("j12_align_vocabularies", "SELECT a.w1, a.w2, a.weight AS x, s.score AS y FROM (SELECT w1, w2, sum(weight) AS weight FROM fx_triples GROUP BY ALL) a JOIN fx_scores s USING (w1, w2)")
def _(t):
    a = t.triples.groupBy("w1", "w2").agg(F.sum("weight").alias("x"))
    return a.join(t.scores.withColumnRenamed("score", "y"), ["w1", "w2"]).select("w1", "w2", "x", "y")


@query(
    "j13_ordinal_join",
    """WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
 b AS (SELECT conv_id, substr(text, 1, 5) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
 SELECT a.conv_id, a.turn FROM a JOIN b USING (conv_id, rn) WHERE starts_with(a.text, b.head)""",
)
def _(t):
    from pyspark.sql import Window

    c = t.conversations.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    heads = c.select("conv_id", "rn", F.substring("text", 1, 5).alias("head"))
    return c.join(heads, ["conv_id", "rn"]).where(F.col("text").startswith(F.col("head"))).select("conv_id", "turn")


@query("j14_unique_match", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation GROUP BY n_name HAVING count(*) = 1)")
def _(t):
    once = t.nation.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("s_nationkey")).where("n = 1")
    return t.supplier.join(small(once.select("n_name", "s_nationkey")), "s_nationkey").select("s_suppkey", "n_name")


_KNN = """q AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 100 = 0),
 b AS (SELECT vec_id AS b_id, embedding::DOUBLE[] AS y, label FROM embeddings),
 d AS (SELECT q_id, b_id, label, round(greatest(list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), 0), 9) AS dist FROM q, b WHERE q_id <> b_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS place FROM d)"""


def _knn(t, k):
    e = t.embeddings
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("vec"))
    # all rows are searched; a query's own row is one of its k + 1 nearest, or as many others are as near
    others = neighbours.nearest_pruned(q, b, k + 1)[0].where("q_id <> b_id").drop("place")
    return stats.top_in_group(others, ["q_id"], k, "dist", "b_id")


@query("j15_nearest_neighbours", f"WITH {_KNN} SELECT q_id, b_id, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def _(t):
    return _knn(t, 5).select("q_id", "b_id", "place")


@query("j16_anti_join", "SELECT DISTINCT raw_tag FROM fx_raw WHERE raw_tag NOT IN (SELECT string FROM fx_dict WHERE is_base = 1)")
def _(t):
    return t.raw.select("raw_tag").distinct().join(t.dictionary.where("is_base = 1").select(F.col("string").alias("raw_tag")), "raw_tag", "left_anti")


# ---- set operations ----
@query("e01_vocabulary_intersection", "SELECT word FROM fx_words INTERSECT SELECT DISTINCT raw_tag FROM fx_raw")
def _(t):
    return t.words.intersect(t.raw.select("raw_tag"))


@query("e02_vocabulary_difference", "SELECT DISTINCT raw_tag AS tag FROM fx_raw EXCEPT SELECT word FROM fx_addl")
def _(t):
    return t.raw.select(F.col("raw_tag").alias("tag")).distinct().exceptAll(t.addl)


@query("e03_triple_set_operations", "SELECT 'core' AS part, * FROM (SELECT * FROM fx_known INTERSECT SELECT * FROM fx_all) UNION ALL SELECT 'old', * FROM (SELECT * FROM fx_known EXCEPT SELECT * FROM fx_all) UNION ALL SELECT 'new', * FROM (SELECT * FROM fx_all EXCEPT SELECT * FROM fx_known)")
def _(t):
    a, b = t.known, t.all_triples
    parts = [d.select(F.lit(n).alias("part"), "rel", "w1", "w2") for n, d in (("core", a.intersect(b)), ("old", a.subtract(b)), ("new", b.subtract(a)))]
    return parts[0].union(parts[1]).union(parts[2])


@query("e04_new_edges_exclude_known", "SELECT w1 AS src, w2 AS dst, sum(weight) AS weight FROM fx_triples WHERE (w1, w2) NOT IN (SELECT w1, w2 FROM fx_known WHERE rel = 'SMALL') GROUP BY ALL")
def _(t):
    known = t.known.where("rel = 'SMALL'").select(F.col("w1").alias("src"), F.col("w2").alias("dst")).distinct()
    return graph.collapse(t.triples).join(known, ["src", "dst"], "left_anti")


@query("e05_concept_split", "SELECT wnid, CASE WHEN wnid IN (SELECT n_name FROM nation WHERE n_regionkey < 2) THEN 'train' ELSE 'test' END AS part FROM fx_sizes WHERE n_images > 20")
def _(t):
    tr = t.nation.where("n_regionkey < 2").select(F.col("n_name").alias("wnid"), F.lit("train").alias("p"))
    return t.sizes.where("n_images > 20").join(small(tr), "wnid", "left").select("wnid", F.coalesce("p", F.lit("test")).alias("part"))


@query("e06_tags_outside_hierarchy", "SELECT DISTINCT raw_tag AS tag FROM fx_doc_tags WHERE raw_tag NOT IN (SELECT p_name FROM part WHERE p_size < 2)")
def _(t):
    return t.doc_tags.select(F.col("raw_tag").alias("tag")).distinct().join(t.part.where("p_size < 2").select(F.col("p_name").alias("tag")), "tag", "left_anti")


@query("e07_union_of_concepts", "SELECT img_id, user_id FROM fx_images WHERE wnid IN ('NATION_1', 'NATION_7', 'NATION_9')")
def _(t):
    return t.images.where(F.col("wnid").isin("NATION_1", "NATION_7", "NATION_9")).select("img_id", "user_id")


@query(
    "e08_overlap_of_top_tags",
    """WITH r AS (SELECT wnid, tag, row_number() OVER (PARTITION BY wnid ORDER BY cnt DESC, tag) AS rn FROM fx_counts), g AS (SELECT tag FROM (SELECT tag, sum(cnt) AS c FROM fx_counts GROUP BY ALL) ORDER BY c DESC, tag LIMIT 10)
 SELECT wnid, round(count(g.tag) / 5.0, 6)::DOUBLE AS overlap FROM r LEFT JOIN g USING (tag) WHERE rn <= 5 GROUP BY wnid""",
)
def _(t):
    top = stats.top_in_group(t.counts, ["wnid"], 5, F.desc("cnt"), "tag")
    g = t.counts.groupBy("tag").agg(F.sum("cnt").alias("c")).orderBy(F.desc("c"), "tag").limit(10).select("tag", F.lit(1).alias("g"))
    return top.join(F.broadcast(g), "tag", "left").groupBy("wnid").agg(F.round(F.count("g") / 5, 6).alias("overlap"))


# ---- windows ----
_SIMS = "sims AS (SELECT least(w1, w2) AS w1, greatest(w1, w2) AS w2, max(score) AS score FROM fx_scores GROUP BY ALL)"
_WORDPAIRS = "wp AS (SELECT least(w1, w2) AS w1, greatest(w1, w2) AS w2, CAST(sum(weight) AS BIGINT) AS freq FROM fx_triples GROUP BY ALL)"


def _word_pairs(t):
    return t.triples.groupBy(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.sum("weight").cast("long").alias("freq"))


def _sims(t):
    return t.scores.groupBy(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).agg(F.max("score").alias("score"))


@query(
    "w01_rank_fusion",
    f"""WITH {_SIMS}, {_WORDPAIRS}, a AS (SELECT w1, w2, row_number() OVER (ORDER BY freq DESC, w1, w2) - 1 AS ia, count(*) OVER () AS la FROM wp),
 b AS (SELECT w1, w2, row_number() OVER (ORDER BY score DESC, w1, w2) - 1 AS ib, count(*) OVER () AS lb FROM sims WHERE score > 20)
 SELECT a.w1, a.w2, ia, coalesce(ib, -1) AS ib, round(CASE WHEN ib IS NULL THEN -1 ELSE 5e-1 * ((la - ia) / la + (lb - ib) / lb) END, 6) AS r,
 round(CASE WHEN ib IS NULL THEN -1 ELSE 5e-1 * (ia / la + (lb - ib) / lb) END, 6) AS novelty FROM a LEFT JOIN b USING (w1, w2)""",
)
def _(t):
    f = stats.rank_fusion(_word_pairs(t), _sims(t).where("score > 20"), ["w1", "w2"], "freq", "score")
    return f.select("w1", "w2", "ia", "ib", F.round("r", 6).alias("r"), F.round("novelty", 6).alias("novelty"))


@query("w02_rank_percent", "SELECT tag, freq, round(1 - (row_number() OVER (ORDER BY freq DESC, tag) - 1) / count(*) OVER (), 6) AS cnt_prc, round(row_number() OVER (ORDER BY md5(tag), tag) / count(*) OVER (), 6) AS infm_prc FROM fx_uni")
def _(t):
    d = stats.rank_percent(t.uni.withColumn("h", F.md5("tag")), "tag", "freq", "h")
    return d.select("tag", "freq", F.round("cnt_prc", 6).alias("cnt_prc"), F.round("infm_prc", 6).alias("infm_prc"))


@query(
    "w03_surprise_regions",
    f"""WITH {_SIMS}, {_WORDPAIRS}, j AS (SELECT wp.w1, wp.w2, freq, score FROM wp JOIN sims USING (w1, w2)),
 r AS (SELECT w1, w2, row_number() OVER (ORDER BY freq, w1, w2) / count(*) OVER () AS p, row_number() OVER (ORDER BY score, w1, w2) / count(*) OVER () AS q FROM j),
 v AS (SELECT 'A' AS region, w1, w2, round(p + q, 9) AS value FROM r UNION ALL SELECT 'B', w1, w2, round(q - p, 9) FROM r UNION ALL SELECT 'C', w1, w2, round(p - q, 9) FROM r UNION ALL SELECT 'D', w1, w2, round(-p - q, 9) FROM r)
 SELECT region, w1, w2, value FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY value DESC, w1, w2) AS rn FROM v) WHERE rn <= 10""",
)
def _(t):
    return stats.surprise_regions(_word_pairs(t).join(_sims(t), ["w1", "w2"]), ["w1", "w2"], "freq", "score", 10)


@query(
    "w04_rank_sums",
    f"""WITH {_SIMS}, {_WORDPAIRS}, j AS (SELECT wp.w1, wp.w2, freq, score FROM wp JOIN sims USING (w1, w2) WHERE score > 0)
 SELECT w1, w2, row_number() OVER (ORDER BY freq, w1, w2) + row_number() OVER (ORDER BY score, w1, w2) AS ranks FROM j""",
)
def _(t):
    j = _word_pairs(t).join(_sims(t), ["w1", "w2"]).where("score > 0")
    a = stats.numbered(j, "freq", "w1", "w2", name="pa").select("w1", "w2", "pa")
    b = stats.numbered(j, "score", "w1", "w2", name="pb").select("w1", "w2", "pb")
    return a.join(b, ["w1", "w2"]).select("w1", "w2", (F.col("pa") + F.col("pb") + 2).alias("ranks"))


@query(
    "w05_polar_sectors",
    f"""WITH {_SIMS}, {_WORDPAIRS}, j AS (SELECT wp.w1, wp.w2, log10(freq) / max(log10(freq)) OVER () AS x, score / max(score) OVER () AS y FROM wp JOIN sims USING (w1, w2)),
 p AS (SELECT w1, w2, sqrt(x * x + y * y) AS r0, degrees(atan2(y, x)) AS th FROM j),
 s AS (SELECT w1, w2, round(r0, 9) AS r, r0, th, CASE WHEN th BETWEEN 37.5 AND 52.5 THEN 'both' WHEN th < 15 THEN 'count' WHEN th > 68 THEN 'similarity' END AS sector FROM p)
 SELECT sector, CAST(place AS INT) AS place, w1, w2, r, round(th, 6) AS theta FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY r DESC, w1, w2) AS place FROM s WHERE sector IS NOT NULL AND r0 > 35e-2) WHERE place <= 20""",
)
def _(t):
    return stats.polar_sectors(_word_pairs(t).join(_sims(t), ["w1", "w2"]), ["w1", "w2"], "freq", "score")


@query("w09_top_k_in_group", "SELECT wnid, tag, cnt FROM (SELECT *, row_number() OVER (PARTITION BY wnid ORDER BY cnt DESC, tag) AS rn FROM fx_counts) WHERE rn <= 3")
def _(t):
    return stats.top_in_group(t.counts, ["wnid"], 3, F.desc("cnt"), "tag").select("wnid", "tag", "cnt")


@query("w10_forward_fill", "SELECT l_orderkey, l_linenumber, l_partkey, last_value(CASE WHEN l_quantity > 25 THEN l_quantity END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)")
def _(t):
    from tagweave.operators.normalize import last_seen

    one = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("l_quantity"))
    one = one.withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return one.select("l_orderkey", "l_linenumber", "l_partkey", last_seen(one, "o", F.when(F.col("l_quantity") > 25, F.col("l_quantity")), ["l_orderkey"]).alias("seen"))


# ---- orders and limits ----
@query("o01_pairs_by_count", "SELECT w1, w2, freq, CAST(row_number() OVER (ORDER BY freq DESC, w1, w2) - 1 AS BIGINT) AS pos FROM fx_pairs")
def _(t):
    return stats.numbered(t.pairs, F.desc("freq"), "w1", "w2").select("w1", "w2", "freq", "pos")


@query("o02_top_tags_of_concepts", "SELECT wnid, string_agg(tag || ':' || CAST(cnt AS VARCHAR), ' ' ORDER BY cnt DESC, tag) AS line FROM (SELECT *, row_number() OVER (PARTITION BY wnid ORDER BY cnt DESC, tag) AS rn FROM fx_counts) WHERE rn <= 10 GROUP BY wnid")
def _(t):
    from tagweave.sources.sinks import concept_lines

    return concept_lines(stats.top_in_group(t.counts, ["wnid"], 10, F.desc("cnt"), "tag")).select("wnid", "line")


@query("o03_rank_document_tags", "WITH s AS (SELECT tag, round(freq / max(freq) OVER (), 6) AS score FROM fx_uni), m AS (SELECT doc_id FROM fx_doc_tags GROUP BY doc_id HAVING count(*) > 5) SELECT doc_id, raw_tag AS tag, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, raw_tag) AS INT) AS place FROM fx_doc_tags JOIN s ON raw_tag = tag WHERE doc_id IN (SELECT doc_id FROM m)")
def _(t):
    uni = stage_table(t.uni, "uni")
    top = uni.agg(F.max("freq").alias("m"))
    s = uni.crossJoin(F.broadcast(top)).select("tag", F.round(F.col("freq") / F.col("m"), 6).alias("score"))
    return stats.rank_document_tags(t.tags.select("doc_id", "tag"), small(s), score="score")


@query("o04_top_fused_pairs", f"WITH {_WORDPAIRS} SELECT w1, w2, freq FROM wp ORDER BY freq DESC, w1, w2 LIMIT 15")
def _(t):
    return _word_pairs(t).orderBy(F.desc("freq"), "w1", "w2").limit(15)


@query(
    "o05_common_pairs_common_features",
    """WITH c AS (SELECT split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_brand AS feat, count(*) AS n FROM part GROUP BY ALL),
 p AS (SELECT w1, w2, sum(n) AS s FROM c GROUP BY ALL ORDER BY s DESC, w1, w2 LIMIT 50)
 SELECT w1, w2, string_agg(feat, ',' ORDER BY feat) AS feats FROM (SELECT c.*, row_number() OVER (PARTITION BY c.w1, c.w2 ORDER BY n DESC, feat) AS rn FROM c JOIN p USING (w1, w2)) WHERE rn <= 6 GROUP BY ALL""",
)
def _(t):
    p = F.split("p_name", " ")
    c = t.part.groupBy(p[0].alias("w1"), p[1].alias("w2"), F.col("p_brand").alias("feat")).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("w1", "w2").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "w1", "w2").limit(50).select("w1", "w2")
    six = stats.top_in_group(c.join(F.broadcast(top), ["w1", "w2"]), ["w1", "w2"], 6, F.desc("n"), "feat")
    return six.groupBy("w1", "w2").agg(F.array_join(F.array_sort(F.collect_list("feat")), ",").alias("feats"))


@query(
    "o06_top_pairs_with_status",
    f"""WITH {_SIMS}, k AS (SELECT DISTINCT least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM fx_known WHERE rel = 'SMALL'), n AS (SELECT DISTINCT least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM fx_all WHERE rel = 'LARGE')
 SELECT sims.w1, sims.w2, score, CASE WHEN k.w1 IS NOT NULL THEN 'known' WHEN n.w1 IS NOT NULL THEN 'new-hit' ELSE '-' END AS status
 FROM sims LEFT JOIN k ON sims.w1 = k.w1 AND sims.w2 = k.w2 LEFT JOIN n ON sims.w1 = n.w1 AND sims.w2 = n.w2 ORDER BY score DESC, sims.w1, sims.w2 LIMIT 25""",
)
def _(t):
    pair = lambda d, c: d.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).distinct().withColumn(c, F.lit(True))
    top = _sims(t).orderBy(F.desc("score"), "w1", "w2").limit(25)
    j = top.join(pair(t.known.where("rel = 'SMALL'"), "k"), ["w1", "w2"], "left").join(pair(t.all_triples.where("rel = 'LARGE'"), "n"), ["w1", "w2"], "left")
    return j.select("w1", "w2", "score", F.when(F.col("k"), "known").when(F.col("n"), "new-hit").otherwise("-").alias("status"))


@query(
    "o07_neighbours_of_concepts",
    """WITH r AS (SELECT s.w1 AS concept, s.w2 AS other, score, row_number() OVER (PARTITION BY s.w1 ORDER BY score DESC, s.w2) AS rn FROM fx_scores s),
 k AS (SELECT DISTINCT w1, w2 FROM fx_known WHERE rel = 'SMALL')
 SELECT concept, string_agg(CASE WHEN k.w1 IS NOT NULL THEN 'o' ELSE '-' END || other, ' ' ORDER BY rn) AS line FROM r LEFT JOIN k ON concept = k.w1 AND other = k.w2 WHERE rn <= 5 GROUP BY concept""",
)
def _(t):
    top = stats.top_in_group(t.scores, ["w1"], 5, F.desc("score"), "w2")
    j = top.join(t.known.where("rel = 'SMALL'").select("w1", "w2").distinct().withColumn("k", F.lit(True)), ["w1", "w2"], "left")
    item = F.struct("place", F.concat(F.when(F.col("k"), "o").otherwise("-"), F.col("w2")).alias("x"))
    return j.groupBy(F.col("w1").alias("concept")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), " ").alias("line"))


@query("o08_top_images_of_a_tag", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], list_transform(range(64), lambda i: ((i % 7) - 3) / 10.0)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def _(t):
    import numpy as np

    m = (((np.arange(64) % 7) - 3) / 10.0)[:, None]
    s = features.predict(t.embeddings.select(F.col("vec_id").alias("img_id"), F.col("embedding").alias("vec")), m, ["tag"])
    return s.select(F.col("img_id").alias("vec_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("o09_select_features", "SELECT 'count' AS how, tag FROM (SELECT tag FROM fx_uni ORDER BY freq DESC, tag LIMIT 12) UNION ALL SELECT 'random', tag FROM (SELECT tag FROM fx_uni ORDER BY (freq * 2654435761) % 4294967296, tag LIMIT 12)")
def _(t):
    a = features.select_dims(t.uni, 12, "freq").select(F.lit("count").alias("how"), "tag")
    b = features.select_dims(t.uni.withColumn("key_id", F.col("freq")), 12, "random").select(F.lit("random").alias("how"), "tag")
    return a.union(b)


@query("o10_distance_to_known", f"WITH {_KNN} SELECT q_id, round(avg(dist) FILTER (place <= 1), 6) AS d1, round(avg(dist) FILTER (place <= 3), 6) AS d3, round(avg(dist) FILTER (place <= 5), 6) AS d5, round(avg(dist) FILTER (place <= 10), 6) AS d10 FROM r GROUP BY q_id")
def _(t):
    d = features.mean_nearest(_knn(t, 10))
    return d.select("q_id", *[F.round(c, 6).alias(c) for c in ("d1", "d3", "d5", "d10")])


@query("l04_knn_vote", f"WITH {_KNN} SELECT q_id, CAST(label AS VARCHAR) AS tag, count(*) AS vote FROM r WHERE place <= 5 GROUP BY ALL")
def _(t):
    labels = t.embeddings.select(F.col("vec_id").alias("b_id"), F.col("label").cast("string").alias("tag"), F.lit(1).alias("r"))
    return features.knn_vote(_knn(t, 5), labels)


@query("l05_hidden_labels", f"WITH {_KNN}, n AS (SELECT q_id, label FROM r WHERE place <= 3), v AS (SELECT q_id, label, count(*) AS c FROM n GROUP BY ALL) SELECT q_id, label FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, label) AS rn FROM v) WHERE rn = 1")
def _(t):
    labels = t.embeddings.select(F.col("vec_id").alias("b_id"), F.col("label").alias("tag"), F.lit(1).alias("r"))
    v = features.knn_vote(_knn(t, 3), labels)
    return stats.top_in_group(v, ["q_id"], 1, F.desc("vote"), "tag").select("q_id", F.col("tag").alias("label"))


@query("n23_pair_distances", "WITH q AS (SELECT vec_id AS a_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT q.a_id, p.a_id AS b_id, round(list_inner_product(q.x, q.x) + list_inner_product(p.x, p.x) - 2 * list_inner_product(q.x, p.x), 6) + 0.0 AS dist FROM q, q p WHERE q.a_id <> p.a_id AND p.a_id % 100 = 0")
def _(t):
    e = t.embeddings
    d = features.pair_distances(e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("vec")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("vec")))
    return d.where("a_id <> b_id").select("a_id", "b_id", F.round("dist", 6).alias("dist"))


@query("d17_symmetric_bigrams", "SELECT w1 AS a, w2 AS b, freq FROM fx_pairs UNION ALL SELECT w2, w1, freq FROM fx_pairs")
def _(t):
    return cooc.symmetric(t.pairs).toDF("a", "b", "freq")
