"""Counts, percentages, pools, features (A, D16, D18, L06)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagweave import functions as fn
from tagweave.operators import cooc, features, graph, stats
from tagweave.plans.registry import query


@query("a01_unigrams", "SELECT raw_tag AS tag, count(*) AS freq FROM fx_doc_tags GROUP BY ALL")
def _(t):
    return cooc.unigrams(t.tags)


@query("a02_bigrams", "SELECT a.raw_tag AS w1, b.raw_tag AS w2, count(*) AS freq FROM fx_doc_tags a JOIN fx_doc_tags b ON a.doc_id = b.doc_id AND a.raw_tag < b.raw_tag GROUP BY ALL")
def _(t):
    return cooc.bigrams(t.tags)


@query("a02_bigrams_of_wide_documents", "SELECT a.raw_tag AS w1, b.raw_tag AS w2, count(*) AS freq FROM fx_doc_tags a JOIN fx_doc_tags b ON a.doc_id = b.doc_id AND a.raw_tag < b.raw_tag GROUP BY ALL")
def _(t):
    return cooc.bigrams(t.tags, max_tags=4)


@query("a03_merge_shards", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS freq FROM events GROUP BY ALL")
def _(t):
    e = t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    shards = [e.where(F.col("event_id") % 4 == s).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("freq")) for s in range(4)]
    return cooc.merge_counts(*shards, keys=["event_type", "k"])


@query("a03_merge_once", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS freq FROM events GROUP BY ALL")
def _(t):
    """Four shards, two of them twice and one under two names: counts are those of all rows once."""
    from tagweave.operators.ledger import CountStore
    from tagweave.session import shared_folder

    e = t.events.select((F.col("event_id") % 4).cast("string").alias("shard"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    shards = e.groupBy("shard", "event_type", "k").agg(F.count(F.lit(1)).alias("freq"))
    store = CountStore(t.spark, f"{shared_folder(t.spark)}/tagweave-store-{uuid.uuid4().hex}", ["event_type", "k"], kinds=["string", "long"])
    store.merge(shards.where("shard < 2"))
    store.merge(shards.union(shards.where("shard = 3").withColumn("shard", F.lit("again"))))
    store.merge(shards)
    return store.counts()


@query("a04_users_of_tags", "SELECT wnid, tag, cnt FROM fx_counts")
def _(t):
    return t.counts


@query("a04_users_with_unknown", "SELECT wnid, tag, count(DISTINCT CASE WHEN user_id % 5 = 0 THEN 'unk' ELSE CAST(user_id AS VARCHAR) END) AS cnt FROM fx_img_tags GROUP BY ALL")
def _(t):
    d = t.img_tags.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    return cooc.distinct_user_counts(d, unknown="unk", parts=t.parts)


@query("a05_user_tag_usage", "SELECT user_id, raw_tag AS tag, count(*) AS uses FROM fx_doc_tags GROUP BY ALL")
def _(t):
    return cooc.user_tag_usage(t.tags)[0]


@query("a05_tag_users", "SELECT tag, freq AS users FROM fx_uni")
def _(t):
    return cooc.user_tag_usage(t.tags)[1]


@query("a06_user_presence", "SELECT DISTINCT user_id, raw_tag AS tag FROM fx_doc_tags WHERE raw_tag IN (SELECT tag FROM fx_uni WHERE freq >= 550)")
def _(t):
    return cooc.user_presence(t.tags, min_users=550)


@query("a07_user_bigrams", "SELECT w1, w2, freq FROM fx_pairs")
def _(t):
    return t.pairs


@query("a08_concept_stats", "WITH n AS (SELECT doc_id, count(*) AS n FROM fx_doc_tags GROUP BY ALL) SELECT wnid, count(*) AS n_images, count(*) FILTER (n > 0) AS n_tagged, count(DISTINCT user_id) AS n_users, round(avg(coalesce(n, 0)), 6) AS avg_tags FROM fx_images LEFT JOIN n ON img_id = doc_id GROUP BY wnid")
def _(t):
    s = cooc.group_stats(t.images, t.doc_tags.select(F.col("doc_id").alias("img_id"), "raw_tag"))
    return s.withColumn("avg_tags", F.round("avg_tags", 6))


@query("a09_percentages", "SELECT wnid, tag, cnt, round(cnt / n_images, 6) AS pct FROM fx_counts JOIN fx_sizes USING (wnid) WHERE cnt > 1")
def _(t):
    return cooc.percentages(t.counts, t.sizes).select("wnid", "tag", "cnt", F.round("pct", 6).alias("pct"))


@query("a10_flag_summary", "SELECT count(*) AS n, CAST(sum(is_base) AS BIGINT) AS base, CAST(sum(is_stopword) AS BIGINT) AS stop FROM fx_dict")
def _(t):
    return t.dictionary.agg(F.count(F.lit(1)).alias("n"), F.sum("is_base").alias("base"), F.sum("is_stopword").alias("stop"))


@query("a11_ngram_totals", "SELECT word, CAST(sum(\"match\") AS BIGINT) AS \"match\", CAST(sum(page) AS BIGINT) AS page, CAST(sum(volume) AS BIGINT) AS volume FROM fx_ngram WHERE yr >= 1998 AND regexp_matches(word, '^[a-zA-Z]') GROUP BY word HAVING sum(\"match\") > 2")
def _(t):
    return cooc.ngram_totals(t.ngram, 1998)


_FR = """fw AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS frame_id, raw_tag AS x FROM fx_raw),
 pr AS (SELECT a.frame_id, a.x AS w1, b.x AS w2 FROM fw a JOIN fw b ON a.frame_id = b.frame_id AND a.x < b.x),
 bag AS (SELECT CAST(o_orderkey AS VARCHAR) AS frame_id, o_orderpriority AS feat FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders)"""


def _frame_inputs(t):
    """An order is a frame: its parts' words, and its priority and status as features."""
    w = t.raw.groupBy(F.col("doc_id").cast("string").alias("frame_id")).agg(F.array_sort(F.collect_set("raw_tag")).alias("w"))
    pairs = w.select("frame_id", F.explode(fn.pairs_of(F.col("w"))).alias("p")).select("frame_id", "p.w1", "p.w2")
    key = F.col("o_orderkey").cast("string").alias("frame_id")
    return pairs, t.orders.select(key, F.col("o_orderpriority").alias("feat")).union(t.orders.select(key, "o_orderstatus"))


@query("a12_pair_features", f"WITH {_FR} SELECT w1, w2, feat, count(*) AS cnt FROM pr JOIN bag USING (frame_id) GROUP BY ALL")
def _(t):
    return features.pair_features(*_frame_inputs(t))[0]


@query("a12_pair_frequencies", f"WITH {_FR} SELECT w1, w2, count(*) AS freq FROM pr GROUP BY ALL")
def _(t):
    return features.pair_features(*_frame_inputs(t))[1]


_PF = "pf AS (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_brand AS feat, count(*) AS cnt FROM part GROUP BY ALL), pf2 AS (SELECT least(a, b) AS w1, greatest(a, b) AS w2, feat, CAST(sum(cnt) AS BIGINT) AS cnt FROM pf GROUP BY ALL), tr AS (SELECT DISTINCT rel, least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM fx_known), j AS (SELECT rel, w1, w2, feat, cnt FROM tr JOIN pf2 USING (w1, w2)), nn AS (SELECT rel, count(*) AS n FROM (SELECT DISTINCT rel, w1, w2 FROM j) GROUP BY rel), prof AS (SELECT rel, feat, CAST(sum(cnt) AS BIGINT) AS cnt, sum(cnt) / any_value(n) AS share FROM j JOIN nn USING (rel) GROUP BY ALL)"


def _profile(t):
    p = F.split("p_name", " ")
    f = t.part.groupBy(F.least(p[0], p[1]).alias("w1"), F.greatest(p[0], p[1]).alias("w2"), F.col("p_brand").alias("feat")).agg(F.count(F.lit(1)).alias("cnt"))
    return features.relation_profile(t.known, f)


@query("a13_relation_profiles", f"WITH {_PF} SELECT rel, feat, cnt, round(share, 6) AS share FROM prof")
def _(t):
    return _profile(t).withColumn("share", F.round("share", 6))


@query(
    "a14_profile_matrix",
    f"""WITH {_PF}, top AS (SELECT DISTINCT feat FROM (SELECT rel, feat, row_number() OVER (PARTITION BY rel ORDER BY cnt DESC, feat) AS rn FROM prof) WHERE rn <= 5),
 c AS (SELECT feat, row_number() OVER (ORDER BY round(s, 9) DESC, feat) AS col FROM (SELECT feat, sum(share) AS s FROM prof WHERE feat IN (SELECT feat FROM top) GROUP BY feat))
 SELECT r.rel, c.feat, round(coalesce(share, 0), 6) AS share, col FROM (SELECT DISTINCT rel FROM prof) r CROSS JOIN c LEFT JOIN prof ON prof.rel = r.rel AND prof.feat = c.feat""",
)
def _(t):
    return features.profile_matrix(_profile(t), 5).select("rel", "feat", F.round("share", 6).alias("share"), "col")


@query("a15_merge_labels", "SELECT doc_id AS img_id, CASE WHEN k IN ('quality', 'good') THEN 'q' ELSE k END AS label, max(v) AS value FROM (SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'good', 1 - toxic FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) GROUP BY ALL")
def _(t):
    s = F.array(F.struct(F.lit("quality").alias("raw"), F.col("quality").alias("value")), F.struct(F.lit("good").alias("raw"), (1 - F.col("toxic")).alias("value")), F.struct(F.lit("toxic").alias("raw"), F.col("toxic").alias("value")))
    rows = t.labels.select(F.col("doc_id").alias("img_id"), F.explode(s).alias("x")).select("img_id", "x.*")
    return features.merge_labels(rows, t.spark.createDataFrame([("quality", "q"), ("good", "q"), ("toxic", "toxic")], "raw string, label string"))


@query("a16_label_cooccurrence", "SELECT least(a.obj, b.obj) AS w1, greatest(a.obj, b.obj) AS w2, count(*) AS freq FROM (SELECT DISTINCT img_id, obj FROM fx_detect) a JOIN (SELECT DISTINCT img_id, obj FROM fx_detect) b ON a.img_id = b.img_id AND a.obj < b.obj GROUP BY ALL")
def _(t):
    return cooc.bigrams(t.detect, "img_id", "obj")


_POOL = "r AS (SELECT *, row_number() OVER (PARTITION BY img_id, obj ORDER BY conf DESC, det_no) AS rn FROM fx_detect), pl AS (SELECT img_id, obj, count(*) AS n, max(conf) AS top, CASE WHEN count(*) >= 3 THEN avg(conf) FILTER (rn <= 3) ELSE max(conf) END AS pooled FROM r GROUP BY ALL)"


@query("a17_pool_detections", f"WITH {_POOL} SELECT img_id, obj, n, top, round(pooled, 6) AS pooled FROM pl")
def _(t):
    return features.pool_detections(t.detect).withColumn("pooled", F.round("pooled", 6))


@query("a17_detection_grid", f"WITH {_POOL} SELECT i.img_id, o.obj, round(coalesce(pooled, -1), 6) AS value FROM (SELECT DISTINCT img_id FROM fx_detect) i CROSS JOIN (SELECT DISTINCT obj FROM fx_detect) o LEFT JOIN pl ON pl.img_id = i.img_id AND pl.obj = o.obj")
def _(t):
    g = features.fill_grid(features.pool_detections(t.detect), t.detect, t.detect)
    return g.withColumn("value", F.round("value", 6))


@query("s16_max_pool", "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id AS img_id, CAST(pos // 8 AS BIGINT) AS dim, round(max(value), 6) AS value FROM v GROUP BY ALL")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "v")).select("img_id", "pos", F.col("v").cast("double").alias("value"))
    return features.max_pool(v, 8).withColumn("value", F.round("value", 6))


@query("s16_max_pool_stride", "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id AS img_id, CAST(pos % 8 AS BIGINT) AS dim, round(max(value), 6) AS value FROM v GROUP BY ALL")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "v")).select("img_id", "pos", F.col("v").cast("double").alias("value"))
    return features.max_pool(v, 8, "stride").withColumn("value", F.round("value", 6))


@query(
    "a18_tag_vectors",
    """WITH tc AS (SELECT DISTINCT tag, wnid FROM fx_counts WHERE cnt >= 24),
 m AS (SELECT tc.tag, c.tag AS feat, CAST(sum(cnt) AS DOUBLE) AS value FROM tc JOIN fx_counts c USING (wnid) GROUP BY ALL),
 b AS (SELECT w1 AS tag, w2 AS feat, CAST(freq AS DOUBLE) AS value FROM fx_pairs UNION ALL SELECT w2, w1, CAST(freq AS DOUBLE) FROM fx_pairs)
 SELECT tag, feat, value FROM m UNION ALL SELECT * FROM b WHERE tag NOT IN (SELECT tag FROM tc)""",
)
def _(t):
    return features.tag_vectors(t.counts, t.counts.where("cnt >= 24").select("tag", "wnid").distinct(), t.pairs)


@query("a19_trial_means", "SELECT o_orderpriority AS config, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("config")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std"))


@query("a20_column_maxima", "SELECT img_id, 'B' || substr(obj, 7, 1) AS label, max(conf) AS value FROM fx_detect GROUP BY ALL")
def _(t):
    m = t.detect.select(F.col("obj").alias("raw")).distinct().withColumn("label", F.concat(F.lit("B"), F.substring("raw", 7, 1)))
    return features.merge_labels(t.detect.select("img_id", F.col("obj").alias("raw"), F.col("conf").alias("value")), m)


@query("a21_add_matrices", "SELECT src, dst, sum(weight) AS weight FROM (SELECT w1 AS src, w2 AS dst, weight FROM fx_triples UNION ALL SELECT w2, w1, weight FROM fx_triples) GROUP BY ALL")
def _(t):
    return graph.collapse(t.triples, symmetric=True)


@query("a22_graph_counts", "SELECT rel, count(*) AS n_edges, count(DISTINCT w1) AS n_src, count(DISTINCT w2) AS n_dst FROM fx_triples GROUP BY ALL")
def _(t):
    return graph.graph_counts(t.triples)


@query("a22_edge_recall", "WITH r AS (SELECT DISTINCT w1, w2 FROM fx_known), e AS (SELECT DISTINCT w1, w2 FROM fx_all WHERE rel <> 'SMALL') SELECT count(*) AS n_ref, count(e.w1) AS n_hit, count(e.w1) / count(*) AS recall FROM r LEFT JOIN e USING (w1, w2)")
def _(t):
    f = lambda d: d.select(F.col("w1").alias("src"), F.col("w2").alias("dst"))
    return graph.edge_recall(f(t.all_triples.where("rel <> 'SMALL'")), f(t.known))


@query("a24_histogram", "SELECT greatest(0, least(5, CAST(floor(l_discount * 50 / 2 + 5e-1) AS INT))) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy(fn.nearest_bin(F.col("l_discount") * 50, 0.0, 2.0, 6).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_percentile_threshold", "WITH p AS (SELECT quantile_cont(CAST(freq AS DOUBLE), 98e-2) AS th FROM fx_pairs) SELECT w1, w2, freq FROM fx_pairs, p WHERE freq > th")
def _(t):
    th = t.pairs.agg(F.percentile("freq", 0.98).alias("th"))
    return t.pairs.crossJoin(F.broadcast(th)).where("freq > th").select("w1", "w2", "freq")


@query("a26_tag_and_image_counts", "SELECT 'image' AS kind, CAST(img_id AS VARCHAR) AS id, count(*) AS n FROM fx_img_tags GROUP BY img_id UNION ALL SELECT 'tag', tag, count(*) FROM fx_img_tags GROUP BY tag")
def _(t):
    d = t.img_tags
    a = d.groupBy("img_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("image").alias("kind"), F.col("img_id").cast("string").alias("id"), "n")
    return a.union(d.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select(F.lit("tag"), "tag", "n"))


@query("a26_label_balance", "SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM fx_scored")
def _(t):
    return t.scored.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


@query("d16_bigram_matrix", "WITH k AS (SELECT tag FROM fx_uni WHERE freq >= 3 AND freq > (SELECT min(freq) FROM (SELECT freq FROM fx_uni ORDER BY freq DESC, tag LIMIT 30))), p AS (SELECT w1, w2, freq FROM fx_pairs WHERE w1 IN (SELECT tag FROM k) AND w2 IN (SELECT tag FROM k)) SELECT w1 AS a, w2 AS b, round(freq / 100, 6) AS w FROM p UNION ALL SELECT w2, w1, round(freq / 100, 6) FROM p")
def _(t):
    return cooc.bigram_matrix(t.pairs, t.uni, 100, 3, 30).withColumn("w", F.round("w", 6))


@query("d18_conditional", "SELECT w1 AS a, w2 AS b, round(p.freq / u.freq, 6) AS p FROM fx_pairs p JOIN fx_uni u ON w1 = tag UNION ALL SELECT w2, w1, round(p.freq / u.freq, 6) FROM fx_pairs p JOIN fx_uni u ON w2 = tag")
def _(t):
    return cooc.conditional(t.pairs, t.uni).withColumn("p", F.round("p", 6))


_FEAT = "base AS (SELECT tag, wnid AS feat, CAST(cnt AS DOUBLE) AS value FROM fx_counts), gr AS (SELECT tag, wnid AS feat, CAST(cnt AS DOUBLE) AS value FROM fx_counts WHERE tag < 'o' AND cnt > 20), gs AS (SELECT tag, feat, value / max(value) OVER () AS value FROM gr)"


def _feature_inputs(t):
    b = t.counts.select("tag", F.col("wnid").alias("feat"), F.col("cnt").cast("double").alias("value"))
    return b, b.where("tag < 'o' and value > 20")


@query("l06_features_added", f"WITH {_FEAT} SELECT tag, feat, round(sum(value), 6) AS value FROM (SELECT * FROM base UNION ALL SELECT * FROM gs) GROUP BY ALL")
def _(t):
    return features.combine_features(*_feature_inputs(t), "add").withColumn("value", F.round("value", 6))


@query(
    "l06_features_side_by_side",
    f"""WITH {_FEAT}, mn AS (SELECT feat, sum(value) / (SELECT count(DISTINCT tag) FROM gs) AS value FROM gs GROUP BY feat),
 miss AS (SELECT DISTINCT tag FROM base WHERE tag NOT IN (SELECT tag FROM gs))
 SELECT tag, 'b:' || feat AS feat, round(value, 6) AS value FROM base UNION ALL SELECT tag, 'g:' || feat, round(value, 6) FROM gs UNION ALL SELECT miss.tag, 'g:' || mn.feat, round(mn.value, 6) FROM miss, mn""",
)
def _(t):
    return features.combine_features(*_feature_inputs(t), "concat").withColumn("value", F.round("value", 6))


@query("n06_entropy", "WITH s AS (SELECT wnid, cnt / sum(cnt) OVER (PARTITION BY wnid) AS p, count(*) OVER (PARTITION BY wnid) AS n FROM fx_counts) SELECT wnid, round(sum(-p * log2(p)), 6) AS entropy, round(CASE WHEN max(n) > 1 THEN sum(-p * log2(p)) / log2(max(n)) ELSE 0 END, 6) AS scaled FROM s GROUP BY wnid")
def _(t):
    e = stats.entropies(t.counts, "wnid", "cnt")
    return e.select("wnid", F.round("entropy", 6).alias("entropy"), F.round("scaled", 6).alias("scaled"))


@query("n24_other_tags", "WITH o AS (SELECT wnid, tag, cnt, tag NOT IN (SELECT p_name FROM part WHERE p_size < 3) AS oth FROM fx_counts), r AS (SELECT *, row_number() OVER (PARTITION BY wnid ORDER BY cnt DESC, tag) AS rn FROM o WHERE oth) SELECT s.wnid, s.other_share, coalesce(x.other_tags, '') AS other_tags FROM (SELECT wnid, round(sum(cnt) FILTER (oth) / sum(cnt), 6) AS other_share FROM o GROUP BY wnid) s LEFT JOIN (SELECT wnid, string_agg(tag, ',' ORDER BY rn) AS other_tags FROM r WHERE rn <= 10 GROUP BY wnid) x USING (wnid)")
def _(t):
    d = stats.outside_share(t.counts, t.part.where("p_size < 3").select(F.col("p_name").alias("word")))
    return d.withColumn("other_share", F.round("other_share", 6))
