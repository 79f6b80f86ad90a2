"""Registered queries of the operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans")
    )


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 1 that SQL can express."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of op 3 fixes: rows, slots and distinct slots of each shard, and the sizes of all rows."""
    got = op3_balanced_sharding(spark, sf_dir).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"), F.sum("size").alias("bytes")
    )
    total = Window.partitionBy()  # one row a shard
    return got.select("n_rows", "first_slot", "last_slot", "n_slots", F.sum("bytes").over(total).alias("bytes_of_all"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: What the caller knows of tools; system turns declare others.
TOOL_SCHEMAS = {
    "lookup": {
        "type": "object",
        "properties": {"limit": {"type": "integer", "minimum": 0, "maximum": 40}, "query": {"type": "string"}},
        "required": ["query"],
    }
}
_MERGE = '<tools>[{"name":"merge","parameters":{"type":"object","properties":{"of":{"type":"array"}},"required":["of"],"additionalProperties":false}}]</tools>'


def with_tool_traffic(turns: DataFrame) -> DataFrame:
    """All turns, and tool calls and results derived from them, since the tables hold none.

    Every assistant turn t without calls gets two, ``c<t>a`` of tool lookup and
    ``c<t>b`` of merge (or of the unknown tool guess), and results for most of
    them, some before their call, some for no call at all. The text's length n
    decides about references (to the same turn, to later and earlier ones, so
    that there are chains and cycles) and about arguments that break a schema.
    System turns without a declaration declare merge.
    """
    n = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    plain = ~F.coalesce(F.col("text").contains("<tool_call>"), F.lit(False))
    t = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = turns.select("conv_id", t.alias("t"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), n.alias("n"), plain.alias("plain"))
    lookup = F.expr(
        """CASE WHEN n % 7 = 0 THEN concat('{"limit":"many","query":"q', n, '"}') WHEN n % 11 = 0 THEN concat('{"limit":', n % 50, '}')
        WHEN n % 5 = 0 THEN concat('{"after":"$ref:c', t - 2, 'b","limit":', n % 50, ',"query":"q', n, '"}')
        ELSE concat('{"limit":', n % 50, ',"query":"q', n, '"}') END"""
    )
    merge = F.expr("""concat('{"of":["$ref:c', IF(n % 3 = 0, t + 2, t), 'a"]', IF(n % 23 = 0, ',"rest":1', ''), '}')""")
    calls = F.concat(
        F.lit('<tool_call>{"arguments":'), lookup, F.expr("""concat(',"id":"c', t, 'a","name":"lookup"}</tool_call><tool_call>{"arguments":')"""), merge,
        F.expr("""concat(',"id":"c', t, 'b","name":"', IF(n % 4 = 1, 'guess', 'merge'), '"}</tool_call>')"""),
    )
    asks = F.expr("coalesce(role = 'assistant', false) AND plain")
    text = (
        F.when(asks, F.concat("text", calls))
        .when(F.expr("role = 'system' AND NOT contains(text, '<tools>')"), F.concat("text", F.lit(_MERGE)))
        .otherwise(F.col("text"))
    )
    own = F.struct(F.col("t").alias("turn"), F.col("role").alias("role"), text.alias("text"))
    answers = F.expr(
        """filter(array(
        IF(n % 17 <> 0, named_struct('turn', t + 1, 'role', 'tool', 'text', concat('{"content":{"n":', n, '},"tool_call_id":"c', t, 'a"}')), NULL),
        IF(n % 2 = 0, named_struct('turn', t - 1, 'role', 'tool', 'text', concat('{"content":"ok","tool_call_id":"c', t, 'b"}')), NULL),
        IF(n % 19 = 0, named_struct('turn', t, 'role', 'tool', 'text', concat('{"content":null,"tool_call_id":"x', t, '"}')), NULL)), r -> r IS NOT NULL)"""
    )
    every = F.concat(F.array(own), F.when(asks, answers).otherwise(F.expr("array()").cast("array<struct<turn: bigint, role: string, text: string>>")))
    return rows.select("conv_id", F.explode(every).alias("r")).select("conv_id", "r.turn", "r.role", "r.text")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.chat import format_chats

    out = format_chats(with_tool_traffic(table(spark, sf_dir, "conversations")), TOOL_SCHEMAS)
    return out.select(
        "conv_id", "position", "turn", "message", "n_calls", "n_answered", "linked", F.array_join("errors", "; ").alias("errors")
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 11 that SQL can express: the order of documents and their edited texts."""
    return op11_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tagweave.llm.align import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagweave.llm.repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_balanced_sharding": op3_balanced_sharding,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_conversation_repair": op13_conversation_repair,
    "license_base_phrases": license_base_phrases,
    "shard_counts": shard_counts,
    "fingerprint_edits": fingerprint_edits,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_PHRASES = (("['gnu', 'general', 'public', 'license']", "gpl"), ("['apache', 'license']", "apache"), ("['cc', 'by']", "cc-by"), ("['mit', 'license']", "mit"))
_AT = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i : i + len({p}) - 1] = {p}) AS p{k}" for k, (p, _) in enumerate(_PHRASES))

SQL: dict[str, str] = {
    "license_base_phrases": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, {_AT} FROM d),
a AS (SELECT doc_id, n, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS spot,
      list_sort(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(_PHRASES))}], lambda x: x IS NOT NULL)) AS l FROM p)
SELECT doc_id, n AS n_words, len(spot) AS n_base, list_min(spot) - 1 AS first_word, list_max(spot) - 1 AS last_word, coalesce(array_to_string(l, ','), '') AS base_labels FROM a""",
    "shard_counts": """
WITH d AS (SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 16) AS b FROM documents)
SELECT n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END AS n_rows, 0 AS first_slot, n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END - 1 AS last_slot,
       n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END AS n_slots, b::BIGINT AS bytes_of_all
FROM d, range(40) r(s) WHERE n // 40 + CASE WHEN s < n % 40 THEN 1 ELSE 0 END > 0""",
    "op9_chat_formatting": f"""
WITH RECURSIVE src AS (SELECT conv_id AS c, coalesce(turn, -1)::BIGINT AS t, coalesce(role, '') AS role, coalesce(text, '') AS text,
      length(coalesce(text, '')) AS n FROM conversations),
declared AS (SELECT DISTINCT c FROM src WHERE role = 'system'),
ask AS (SELECT * FROM src WHERE role = 'assistant'),
-- calls: place k in their message, and the call that each names
ref AS (SELECT a.c, a.t, 1 AS k, 'c' || CASE WHEN n % 3 = 0 THEN t + 2 ELSE t END || 'a' AS need FROM ask a
        UNION ALL SELECT a.c, a.t, 0, 'c' || (t - 2) || 'b' FROM ask a WHERE n % 5 = 0 AND n % 7 <> 0 AND n % 11 <> 0),
call AS (SELECT c, t, 0 AS k, 'c' || t || 'a' AS id FROM ask UNION ALL SELECT c, t, 1, 'c' || t || 'b' FROM ask),
edge AS (SELECT ref.c, ref.t, ref.k, call.t AS t2, call.k AS k2 FROM ref JOIN call ON ref.c = call.c AND ref.need = call.id),
-- nodes are messages (k = -1) and calls; what each waits for
wait AS (SELECT c, t, CASE WHEN t = t2 THEN k ELSE -1 END AS k, t2, k2 FROM edge UNION SELECT c, t, k, t, -1 FROM call),
reach AS (SELECT * FROM wait UNION SELECT r.c, r.t, r.k, w.t2, w.k2 FROM reach r JOIN wait w ON r.c = w.c AND r.t2 = w.t AND r.k2 = w.k),
cyclic AS (SELECT DISTINCT c, t, k FROM reach WHERE t = t2 AND k = k2),
stuck AS (SELECT * FROM cyclic UNION SELECT r.c, r.t, r.k FROM reach r JOIN cyclic y ON r.c = y.c AND r.t2 = y.t AND r.k2 = y.k),
linked AS (SELECT c, t, k FROM edge UNION SELECT c, t2, k2 FROM edge),
waits AS (SELECT DISTINCT c, t FROM stuck SEMI JOIN linked USING (c, t, k)),
-- a message comes after those whose calls it uses: the longest way to each, over calls that can be placed
free AS (SELECT c, t, t2 FROM edge WHERE t <> t2 AND (c, t2, k2) NOT IN (SELECT (c, t, k) FROM stuck)),
way AS (SELECT c, t AS m, t AS spot FROM ask UNION SELECT f.c, f.t, way.spot + 1 FROM way JOIN free f ON f.c = way.c AND f.t2 = way.m),
place AS (SELECT c, m AS t, max(spot) AS spot FROM way GROUP BY ALL),
deep AS (SELECT call.*, CASE WHEN (call.c, call.t, call.k) IN (SELECT (c, t, k) FROM edge WHERE t = t2 AND (c, t2, k2) NOT IN (SELECT (c, t, k) FROM stuck)) THEN 1 ELSE 0 END AS depth
         FROM call),
args AS (SELECT *, CASE WHEN n % 7 = 0 THEN '{{"limit":"many","query":"q' || n || '"}}' WHEN n % 11 = 0 THEN '{{"limit":' || (n % 50) || '}}'
           WHEN n % 5 = 0 THEN '{{"after":"$ref:c' || (t - 2) || 'b","limit":' || (n % 50) || ',"query":"q' || n || '"}}'
           ELSE '{{"limit":' || (n % 50) || ',"query":"q' || n || '"}}' END AS one,
         '{{"of":["$ref:c' || (CASE WHEN n % 3 = 0 THEN t + 2 ELSE t END) || 'a"]' || (CASE WHEN n % 23 = 0 THEN ',"rest":1' ELSE '' END) || '}}' AS two,
         CASE WHEN n % 4 = 1 THEN 'guess' ELSE 'merge' END AS tool FROM ask),
result AS (SELECT c, t + 1 AS turn, 'c' || t || 'a' AS id, '{{"content":{{"n":' || n || '}},"role":"tool","tool_call_id":"c' || t || 'a"}}' AS message FROM ask WHERE n % 17 <> 0
  UNION ALL SELECT c, t - 1, 'c' || t || 'b', '{{"content":"ok","role":"tool","tool_call_id":"c' || t || 'b"}}' FROM ask WHERE n % 2 = 0
  UNION ALL SELECT c, t, 'x' || t, '{{"content":null,"role":"tool","tool_call_id":"x' || t || '"}}' FROM ask WHERE n % 19 = 0),
told AS (SELECT c, turn, r.id, message, d.t AS of_turn, d.k, d.depth, p.spot FROM result r LEFT JOIN deep d USING (c, id) LEFT JOIN place p ON p.c = r.c AND p.t = d.t),
msg AS (
  SELECT c, turn, coalesce(spot, turn) AS anchor, CASE WHEN spot IS NULL THEN 0 ELSE 1 END AS after, coalesce(depth, 0) AS depth, coalesce(k, 0) AS k, message,
         0 AS n_calls, 0 AS n_answered, spot IS NOT NULL AS linked, '' AS errors FROM told
  UNION ALL
  SELECT a.c, a.t, p.spot, 0, 0, 0, '{{"content":' || to_json(a.text) || ',"role":"assistant","tool_calls":[{{"arguments":' || one || ',"id":"c' || a.t || 'a","name":"lookup"}},'
         || '{{"arguments":' || two || ',"id":"c' || a.t || 'b","name":"' || tool || '"}}]}}', 2,
         CASE WHEN n % 17 <> 0 THEN 1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END, NULL,
         array_to_string(list_filter([
           CASE WHEN n % 7 = 0 THEN 'lookup $.limit: not of type integer' END,
           CASE WHEN n % 7 <> 0 AND n % 11 = 0 THEN 'lookup $.query: missing' END,
           CASE WHEN n % 7 <> 0 AND n % 50 > 40 THEN 'lookup $.limit: out of bounds' END,
           CASE WHEN tool = 'guess' OR a.c NOT IN (SELECT c FROM declared) THEN tool || ': unknown tool'
                WHEN n % 23 = 0 THEN 'merge $.rest: unknown' END,
           CASE WHEN (a.c, a.t) IN (SELECT (c, t) FROM waits) THEN 'calls wait for each other' END], lambda x: x IS NOT NULL), '; ')
  FROM args a JOIN place p USING (c, t)
  UNION ALL
  SELECT c, t, t, 0, 0, 0, '{{"content":' || to_json(text || CASE WHEN role = 'system' THEN '{_MERGE}' ELSE '' END) || ',"role":"' || role || '"}}', 0, 0, NULL, ''
  FROM src WHERE role <> 'assistant')
SELECT c AS conv_id, row_number() OVER (PARTITION BY c ORDER BY anchor, after, depth, k, turn, md5(message)) - 1 AS position, turn, message,
       n_calls::BIGINT AS n_calls, n_answered::BIGINT AS n_answered, linked, errors FROM msg""",
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 98e-2),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id""",
    "op10_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS n, least(len(w), 10) AS k, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dp.doc_id, dp.i, dp.k, win.item_id FROM dp JOIN win ON dp.k = win.k AND dp.s = win.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "fingerprint_edits": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC)) AS x FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(x, 1, length(t) // 2)) AS edited_sha256 FROM n""",
    # CRC-32 by bits: each byte is added, then eight shifts (-1) follow
    "op13_conversation_repair": r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 20 AS f FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE f <> 0),
las AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM dam),
flt AS (SELECT *, CASE WHEN z = '' THEN 1 WHEN nth > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM las),
num AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS step FROM flt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, fault)),
agg AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM num GROUP BY conv_id),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after a; rows inserted, and the row that is due
ins(g, l, c, o, h) AS (VALUES (0, '', 0, '', 0), (0, 'I', 5, E'user:\n', 2), (0, 'II', 10, E'user:\nassistant:\n', 3), (1, '', 0, '', 1), (1, 'I', 5, E'user:\n', 2), (1, 'II', 10, E'user:\nassistant:\n', 3),
        (2, '', 0, '', 2), (2, 'I', 5, E'assistant:\n', 3), (3, '', 0, '', 3), (3, 'I', 5, E'user:\n', 2)),
due(h, t, name, g2) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
st AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS g, {'c': 0, 'a': '', 'o': ''} AS best FROM agg
  UNION ALL
  SELECT conv_id, i, g, min(x) FROM (
    SELECT num.conv_id, num.i, ins.h AS g, {'c': best.c + ins.c + 2, 'a': best.a || ins.l || 'D', 'o': best.o || ins.o} AS x
    FROM st JOIN num ON num.conv_id IS NOT DISTINCT FROM st.conv_id AND num.i = st.i + 1 JOIN ins ON ins.g = st.g
    UNION ALL
    SELECT num.conv_id, num.i, due.g2, {'c': best.c + ins.c + CASE fault WHEN 3 THEN 5 ELSE 0 END + e.c, 'a': best.a || ins.l || e.l, 'o': best.o || ins.o || CASE e.l WHEN 'K' THEN role ELSE due.name END || ':' || text || chr(10)}
    FROM st JOIN num ON num.conv_id IS NOT DISTINCT FROM st.conv_id AND num.i = st.i + 1 JOIN ins ON ins.g = st.g JOIN due ON due.h = ins.h, (VALUES ('K', 0), ('R', 1)) e(l, c)
    WHERE fault IN (0, 3) AND CASE e.l WHEN 'K' THEN due.t = left(role, 1) ELSE due.name IS NOT NULL END) GROUP BY conv_id, i, g),
fin AS (SELECT st.conv_id, min({'c': best.c + ins.c, 'a': best.a || ins.l, 'o': best.o || ins.o}) AS x FROM st JOIN agg ON agg.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = n JOIN ins ON ins.g = st.g WHERE ins.h IN (0, 3) GROUP BY st.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(CASE WHEN coalesce(x.o, '') = '' THEN '' ELSE left(x.o, -1) END) AS repaired_sha256
FROM ids LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
