"""Hierarchies, subgraphs and PageRank (G, D09-D12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import functions as fn
from tagweave.operators import graph, hierarchy, pagerank
from tagweave.operators.learn import edges
from tagweave.plans.metrics import _CLOS
from tagweave.plans.registry import query

_FEATS = "ft AS (SELECT p_name AS concept, CASE WHEN p_partkey % 4 = 0 THEN 'left' ELSE 'right' END || '|' || p_type || '|' || p_brand AS feature, CAST(p_size - 10 AS DOUBLE) AS value FROM part)"


def _signed(t):
    f = F.concat_ws("|", F.when(F.col("p_partkey") % 4 == 0, "left").otherwise("right"), "p_type", "p_brand")
    return t.part.select(F.col("p_name").alias("concept"), f.alias("feature"), (F.col("p_size") - 10).cast("double").alias("value"))


_EDG = f"{_FEATS}, e AS (SELECT split_part(feature, '|', 2) AS rel, split_part(feature, '|', 3) AS src, concept AS dst, value AS weight FROM ft WHERE value >= 0 AND starts_with(feature, 'right|'))"


@query("g01_edges_from_features", f"WITH {_EDG} SELECT * FROM e WHERE rel IN (SELECT rel FROM e GROUP BY rel HAVING count(*) >= 195)")
def _(t):
    return graph.from_features(_signed(t), 195)[0].select("rel", "src", "dst", "weight")


@query("g01_relation_sizes", f"WITH {_EDG} SELECT rel, count(*) AS n_edges FROM e GROUP BY rel")
def _(t):
    return graph.from_features(_signed(t))[1]


@query("g02_filter_counters", "SELECT count(*) AS scanned, count(*) FILTER (rel IN ('ECONOMY', 'SMALL')) AS in_relation, count(*) FILTER (rel IN ('ECONOMY', 'SMALL') AND (w1, w2) IN (SELECT w1, w2 FROM fx_scores WHERE score > 50 UNION SELECT w2, w1 FROM fx_scores WHERE score > 50)) AS in_vocab FROM fx_triples")
def _(t):
    return graph.filter_counters(t.triples, ["economy", "Small"], t.scores.where("score > 50"))


@query("g02_filter_without_places", "SELECT rel, w1, w2, weight FROM fx_triples WHERE (w1, w2) IN (SELECT w1, w2 FROM fx_scores) AND w1 NOT IN (SELECT word FROM fx_addl) AND w2 NOT IN (SELECT word FROM fx_addl)")
def _(t):
    return graph.filter_triples(t.triples, ["economy", "small", "medium", "promo", "standard", "large"], t.scores, t.addl)


_STAR = """tr AS (SELECT DISTINCT rel, w1, w2 FROM fx_known),
 pr AS (SELECT w1, w2, row_number() OVER (ORDER BY score DESC, w1, w2) AS rank FROM fx_scores WHERE w1 < w2), po(rel, dir) AS (VALUES ('SMALL', 'out'), ('PROMO', 'in'), ('ECONOMY', 'out'), ('LARGE', 'in'), ('MEDIUM', 'out'), ('STANDARD', 'in')),
 bo AS (SELECT rank, 0 AS turned, w1, w2 FROM pr UNION ALL SELECT rank, 1, w2, w1 FROM pr),
 ro AS (SELECT rank, turned, rel, dir, bo.w1 AS root FROM bo JOIN tr USING (w1, w2) JOIN po USING (rel)),
 sd AS (SELECT rel, 'out' AS dir, w1 AS root, w2 AS leaf FROM tr UNION ALL SELECT rel, 'in', w2, w1 FROM tr),
 lv AS (SELECT rel, dir, root, list_sort(list(DISTINCT leaf)) AS leaves FROM sd GROUP BY ALL HAVING count(DISTINCT leaf) > 1),
 o1 AS (SELECT *, row_number() OVER (PARTITION BY rel, dir, root ORDER BY rank, turned, rel, dir, root) AS n1 FROM ro JOIN lv USING (rel, dir, root)),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY list_sort(list_distinct(list_append(leaves, root))) ORDER BY rank, turned, rel, dir, root) AS n2 FROM o1 WHERE n1 = 1)"""


def _stars(t):
    pairs = t.scores.where("w1 < w2").select("w1", "w2", F.row_number().over(_order()).alias("rank"))  # at most the square of 16 words
    ways = [("SMALL", "out"), ("PROMO", "in"), ("ECONOMY", "out"), ("LARGE", "in"), ("MEDIUM", "out"), ("STANDARD", "in")]
    return graph.stars(t.known, pairs, t.spark.createDataFrame(ways, "rel string, dir string"))


def _order():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "w1", "w2")


@query("g03_star_subgraphs", f"WITH {_STAR} SELECT 's:' || rel || ':' || dir || ':' || root AS graph_id, rel, root, dir, len(leaves) + 1 AS size, unnest(leaves) AS leaf FROM o2 WHERE n2 = 1")
def _(t):
    return _stars(t)


@query(
    "g04_expand_to_words",
    f"""WITH {_STAR}, s AS (SELECT 's:' || rel || ':' || dir || ':' || root AS g, root, unnest(leaves) AS leaf FROM o2 WHERE n2 = 1),
 ed AS (SELECT g, root AS src, leaf AS dst FROM s UNION ALL SELECT g, leaf, root FROM s UNION ALL SELECT DISTINCT g, root, root FROM s UNION ALL SELECT DISTINCT g, leaf, leaf FROM s WHERE leaf <> root OR (SELECT false)),
 wd AS (SELECT word AS term, unnest([word, word || 's']) AS w FROM fx_words)
 SELECT g AS graph_id, a.w AS src, b.w AS dst, CAST(count(*) AS DOUBLE) AS weight FROM ed JOIN wd a ON src = a.term JOIN wd b ON dst = b.term GROUP BY ALL""",
)
def _(t):
    words = t.words.select(F.col("word").alias("term"), F.array("word", F.concat("word", F.lit("s"))).alias("words"))
    return graph.expand_to_words(graph.star_edges(_stars(t)), words)


_NAT = "ne AS (SELECT DISTINCT 'R' || CAST(c_nationkey % 3 AS VARCHAR) AS rel, 'v' || CAST(c_nationkey AS VARCHAR) AS w1, 'v' || CAST(c_custkey % 25 AS VARCHAR) AS w2 FROM customer)"


def _nation_triples(t):
    v = lambda c: F.concat(F.lit("v"), c.cast("string"))
    c = t.customer
    return c.select(F.concat(F.lit("R"), (F.col("c_nationkey") % 3).cast("string")).alias("rel"), v(F.col("c_nationkey")).alias("w1"), v(F.col("c_custkey") % 25).alias("w2")).distinct()


@query("g05_triangles", f"WITH {_NAT}, e AS (SELECT DISTINCT rel, least(w1, w2) AS a, greatest(w1, w2) AS b FROM ne WHERE w1 <> w2) SELECT x.rel, x.a, x.b, y.b AS c FROM e x JOIN e y ON x.rel = y.rel AND x.b = y.a JOIN e z ON x.rel = z.rel AND z.a = x.a AND z.b = y.b")
def _(t):
    return graph.triangles(_nation_triples(t))


@query(
    "g05_largest_cliques",
    f"""WITH RECURSIVE {_NAT}, e AS (SELECT rel, w1 AS a, w2 AS b FROM ne WHERE w1 <> w2 UNION SELECT rel, w2, w1 FROM ne WHERE w1 <> w2),
 pr AS (SELECT DISTINCT least(w1, w2) AS w1, greatest(w1, w2) AS w2 FROM ne), sd AS (SELECT rel, w1, w2 FROM pr JOIN e ON w1 = a AND w2 = b),
 cm AS (SELECT sd.rel, w1, w2, x.b AS c FROM sd JOIN e x ON x.rel = sd.rel AND x.a = w1 JOIN e y ON y.rel = sd.rel AND y.a = w2 AND y.b = x.b),
 nb AS (SELECT rel, a AS c, list(b) AS near FROM e GROUP BY ALL),
 cl AS (SELECT rel, w1, w2, [c] AS top FROM cm UNION ALL SELECT cl.rel, cl.w1, cl.w2, list_append(cl.top, cm.c) FROM cl JOIN cm ON cm.rel = cl.rel AND cm.w1 = cl.w1 AND cm.w2 = cl.w2 AND cm.c > cl.top[-1]
        JOIN nb ON nb.rel = cm.rel AND nb.c = cm.c WHERE list_has_all(nb.near, cl.top)),
 best AS (SELECT *, row_number() OVER (PARTITION BY rel, w1, w2 ORDER BY len(top) DESC, top) AS rn FROM cl)
 SELECT rel, w1, w2, len(top) + 2 AS size, array_to_string(list_sort(list_append(list_append(top, w1), w2)), ',') AS members FROM best WHERE rn = 1""",
)
def _(t):
    n = _nation_triples(t)
    return graph.cliques(n, n.select("w1", "w2").distinct())


@query("g06_relation_policy", "WITH po(rel, dir) AS (VALUES ('SMALL', 'out'), ('SMALL', 'in'), ('PROMO', 'c')) SELECT w1, w2, rel, dir FROM fx_known JOIN po USING (rel)")
def _(t):
    p = t.spark.createDataFrame([("SMALL", "out"), ("SMALL", "in"), ("PROMO", "c")], "rel string, dir string")
    return t.known.join(F.broadcast(p), "rel").select("w1", "w2", "rel", "dir")  # a fixed list


@query("g07_known_nodes", "SELECT parent, child FROM fx_edges WHERE parent IN (SELECT n_name FROM nation UNION SELECT 'ROOT' UNION SELECT r_name FROM region WHERE r_regionkey < 3) AND child IN (SELECT n_name FROM nation UNION SELECT r_name FROM region WHERE r_regionkey < 3)")
def _(t):
    n = t.nation.select(F.col("n_name").alias("wnid")).union(t.region.where("r_regionkey < 3").select("r_name")).union(t.spark.createDataFrame([("ROOT",)], "wnid string"))
    return hierarchy.restrict_nodes(t.edges, n)


@query("g07_isolated_nodes", "SELECT c_name AS wnid FROM customer UNION SELECT 'lone'")
def _(t):
    n = t.customer.select(F.col("c_name").alias("wnid")).union(t.spark.createDataFrame([("lone",), ("ROOT",)], "wnid string"))
    return hierarchy.isolated(n, t.edges)


@query("g08_closure", "WITH RECURSIVE cl(top, node, depth) AS (SELECT parent, child, 1 FROM fx_edges UNION SELECT cl.top, e.child, cl.depth + 1 FROM cl JOIN fx_edges e ON cl.node = e.parent) SELECT top, node, depth FROM cl")
def _(t):
    return hierarchy.closure(t.edges)


_NODEWORDS = "nw AS (SELECT wnid, unnest(string_split(lower(replace(replace(wnid, '_', ' '), '#', ' ')), ' ')) AS word FROM (SELECT DISTINCT child AS wnid FROM fx_edges))"


def _node_words(t):
    n = t.edges.select(F.col("child").alias("wnid")).distinct()
    return n.select("wnid", F.explode(F.split(fn.lemma_name(F.translate("wnid", "#", " ")), " ")).alias("word"))


@query("g09_words_by_depth", f"WITH {_CLOS}, {_NODEWORDS} SELECT wnid, depth, string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM (SELECT top AS wnid, depth, word FROM cl JOIN nw ON node = nw.wnid UNION ALL SELECT node, -depth, word FROM cl JOIN nw ON top = nw.wnid) GROUP BY ALL")
def _(t):
    return hierarchy.words_by_depth(hierarchy.closure(t.edges), _node_words(t)).select("wnid", "depth", F.array_join("words", ",").alias("words"))


@query(
    "g10_concept_records",
    f"""WITH {_CLOS}, n AS (SELECT n_name AS wnid FROM nation UNION SELECT r_name FROM region), nw AS (SELECT n_name AS wnid, p_name AS word FROM nation JOIN part ON n_nationkey = p_size),
 u AS (SELECT node AS wnid, max(depth) AS depth, count(DISTINCT top) AS a FROM cl GROUP BY node), d AS (SELECT top AS wnid, count(DISTINCT node) AS b FROM cl GROUP BY top),
 k AS (SELECT parent AS wnid, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM fx_edges WHERE child IN (SELECT wnid FROM n) GROUP BY parent),
 near AS (SELECT top AS wnid, node FROM cl UNION SELECT node, top FROM cl UNION SELECT wnid, wnid FROM n), own AS (SELECT DISTINCT near.wnid, word AS tag FROM near JOIN nw ON node = nw.wnid),
 t AS (SELECT wnid, count(*) AS c FROM fx_counts GROUP BY wnid), o AS (SELECT wnid, count(*) AS c FROM fx_counts WHERE (wnid, tag) NOT IN (SELECT wnid, tag FROM own) GROUP BY wnid)
 SELECT n.wnid, CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(coalesce(a, 0) AS BIGINT) AS n_ancestors, CAST(coalesce(b, 0) AS BIGINT) AS n_descendants, coalesce(children, '') AS children, CAST(coalesce(t.c, 0) AS BIGINT) AS n_tags, CAST(coalesce(o.c, 0) AS BIGINT) AS n_other
 FROM n LEFT JOIN u USING (wnid) LEFT JOIN d USING (wnid) LEFT JOIN k USING (wnid) LEFT JOIN t USING (wnid) LEFT JOIN o USING (wnid)""",
)
def _(t):
    nodes = t.nation.select(F.col("n_name").alias("wnid")).union(t.region.select("r_name"))
    words = t.nation.join(t.part, F.col("n_nationkey") == F.col("p_size")).select(F.col("n_name").alias("wnid"), F.col("p_name").alias("word"))
    return hierarchy.concept_records(nodes, t.edges, hierarchy.closure(t.edges), words, t.counts)


@query("g11_map_by_words", "WITH c AS (SELECT DISTINCT p_name AS wnid, unnest(string_split(p_name, ' ')) AS word FROM part), k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, p_brand AS cand FROM part WHERE p_size < 4), s AS (SELECT wnid, count(DISTINCT word) AS n FROM c GROUP BY wnid), f AS (SELECT wnid, cand, count(*) AS h FROM c JOIN k USING (word) GROUP BY ALL) SELECT s.wnid, min(cand) AS cand FROM s LEFT JOIN f ON s.wnid = f.wnid AND f.h = s.n GROUP BY s.wnid")
def _(t):
    w = lambda c: F.explode(F.split("p_name", " ")).alias("word")
    return hierarchy.map_by_words(t.part.select(F.col("p_name").alias("wnid"), w(0)), t.part.where("p_size < 4").select(w(0), F.col("p_brand").alias("cand")))


@query("g12_depth_range", f"WITH {_CLOS}, dp AS (SELECT node AS wnid, max(depth) AS depth FROM cl GROUP BY node) SELECT s_name AS tag, CASE WHEN s_suppkey % 2 = 0 THEN 'n' ELSE 'v' END AS pos, min(depth) AS min_depth, max(depth) AS max_depth FROM (SELECT s_name, s_suppkey, s_name AS wnid FROM supplier UNION ALL SELECT s_name, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) JOIN dp USING (wnid) GROUP BY ALL")
def _(t):
    d = hierarchy.closure(t.edges).groupBy(F.col("node").alias("wnid")).agg(F.max("depth").alias("depth"))
    pos = F.when(F.col("s_suppkey") % 2 == 0, "n").otherwise("v").alias("pos")
    s = t.supplier
    tn = s.select(F.col("s_name").alias("tag"), pos, F.col("s_name").alias("wnid")).union(s.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", pos, "n_name"))
    return hierarchy.depth_range(tn, d)


@query("g13_name_query", "SELECT p_partkey FROM part WHERE lower(p_name) = 'small ring'")
def _(t):
    return hierarchy.name_query(t.part.select("p_partkey", F.concat("p_name", F.lit(".n.01")).alias("name")), "Small Ring").select("p_partkey")


@query("g14_relation_adjacency", "SELECT p_type AS rel, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, count(*) AS n FROM part GROUP BY ALL")
def _(t):
    return t._triples("true").groupBy("rel", "w1", "w2").agg(F.count(F.lit(1)).alias("n"))


@query("g15_collapse_relations", "SELECT w1 AS src, w2 AS dst, sum(weight) AS weight FROM fx_triples GROUP BY ALL")
def _(t):
    return graph.collapse(t.triples)


@query("g16_restrict_graph", "SELECT src, dst, w FROM fx_graph WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(t):
    return graph.restrict(t.graph, t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("word")))


def _ppr_sql(n: int, alpha: str, edges: str, restarts: str) -> str:
    steps = ["p0 AS (SELECT r.restart, nd.node, 1 / (SELECT count(*) FROM nd) AS p FROM rs r CROSS JOIN nd)"]
    for i in range(1, n + 1):
        steps.append(
            f"p{i} AS MATERIALIZED (SELECT g.restart, g.node, coalesce(f.q, 0) + CASE WHEN g.node = g.restart THEN 1 - {alpha} ELSE 0 END + {alpha} * coalesce(dg.q, 0) / (SELECT count(*) FROM nd) AS p FROM p0 g"
            f" LEFT JOIN (SELECT restart, dst AS node, sum(p * t * {alpha}) AS q FROM p{i - 1} JOIN tr ON node = src GROUP BY ALL) f ON g.restart = f.restart AND g.node = f.node"
            f" LEFT JOIN (SELECT restart, sum(p) AS q FROM p{i - 1} WHERE node NOT IN (SELECT src FROM tr) GROUP BY restart) dg ON g.restart = dg.restart)"
        )
    return f"WITH ed AS ({edges}), nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), rs AS ({restarts}), tr AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS t FROM ed WHERE w > 0), {', '.join(steps)} SELECT restart, node, round(p, 6) AS p FROM p{n}"


@query("d09_personalised_pagerank", _ppr_sql(5, "5e-1", "SELECT src, dst, w FROM fx_graph", "SELECT DISTINCT src AS restart FROM fx_graph"))
def _(t):
    return graph.ppr(t.graph, t.graph.select(F.col("src").alias("restart"))).withColumn("p", F.round("p", 6))


@query("d09_pagerank_dangling", _ppr_sql(4, "5e-1", "SELECT parent AS src, child AS dst, CAST(1 AS DOUBLE) AS w FROM fx_edges", "SELECT 'ROOT' AS restart UNION ALL SELECT r_name FROM region"))
def _(t):
    """The hierarchy: its leaves have no edges."""
    e = t.edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("w"))
    tops = t.region.select(F.col("r_name").alias("restart")).union(t.spark.createDataFrame([("ROOT",)], "restart string"))
    return graph.ppr(e, tops, max_iter=4).withColumn("p", F.round("p", 6))


@query("d10_pagerank_exact", _ppr_sql(30, "5e-1", "SELECT src, dst, w FROM fx_graph", "SELECT node AS restart FROM nd WHERE node < 4"))
def _(t):
    return graph.ppr_exact(t.graph, t.spark.createDataFrame([(i,) for i in range(4)], "restart int")).withColumn("p", F.round("p", 6))


@query("d09_residual_push", _ppr_sql(14, "15e-2", "SELECT src, dst, w FROM fx_graph", "SELECT DISTINCT src AS restart FROM fx_graph").replace("round(p, 6)", "round(p, 5)"))
def _(t):
    """Pushes until no residual reaches the threshold: as far from the fixed point as the mass that is left."""
    placed, _ = pagerank.push(t.graph, t.graph.select(F.col("src").alias("restart")), alpha=0.15, threshold=1e-11)
    return placed.withColumn("p", F.round("p", 5))


@query("d11_pagerank_saturated", _ppr_sql(25, "5e-1", "SELECT src, dst, 5e-1 * (1 - exp(-w / 40)) / (1 + exp(-w / 40)) AS w FROM fx_graph", "SELECT DISTINCT src AS restart FROM fx_graph UNION SELECT DISTINCT dst FROM fx_graph"))
def _(t):
    from tagweave.operators.graph import renormalized_ppr

    return renormalized_ppr(t.graph.withColumn("w", F.col("w") / 40), max_iter=25, tol=None).withColumn("p", F.round("p", 6))


def _eigen_sql(n: int) -> str:
    """Power steps, normalised each time, on weights that needn't sum to 1."""
    steps = ["p0 AS (SELECT r.node AS restart, nd.node, 1 / (SELECT count(*) FROM nd) AS p FROM nd r CROSS JOIN nd)"]
    for i in range(1, n + 1):
        steps.append(
            f"p{i} AS MATERIALIZED (SELECT restart, node, q / sum(q) OVER (PARTITION BY restart) AS p FROM (SELECT g.restart, g.node, coalesce(f.q, 0) + CASE WHEN g.node = g.restart THEN 5e-1 ELSE 0 END AS q"
            f" FROM p0 g LEFT JOIN (SELECT restart, dst AS node, sum(p * w * 5e-1) AS q FROM p{i - 1} JOIN ed ON node = src GROUP BY ALL) f ON g.restart = f.restart AND g.node = f.node))"
        )
    return f"WITH ed AS (SELECT src, dst, log10(1 + w) AS w FROM fx_graph), nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), {', '.join(steps)} SELECT restart, node, round(p, 6) AS p FROM p{n}"


_OBSERVED = "o AS (SELECT dst AS restart, src AS node, w / sum(w) OVER (PARTITION BY dst) AS o FROM fx_graph)"
_ALL_RESTARTS = _ppr_sql(30, "5e-1", "SELECT src, dst, w FROM fx_graph", "SELECT node AS restart FROM nd")


def _observed(t):
    total = t.graph.groupBy("dst").agg(F.sum("w").alias("s"))
    return t.graph.join(total, "dst").select(F.col("dst").alias("restart"), F.col("src").alias("node"), (F.col("w") / F.col("s")).alias("o"))


@query("d12_pagerank_loss", f"WITH p AS ({_ALL_RESTARTS}), {_OBSERVED} SELECT p.restart, round(sum(5e-1 * pow(p.p - coalesce(o.o, 0), 2)), 4) AS loss FROM p LEFT JOIN o ON p.restart = o.restart AND p.node = o.node WHERE p.restart <> p.node GROUP BY p.restart")
def _(t):
    nodes = t.graph.select(F.col("src").alias("restart")).union(t.graph.select("dst")).distinct()
    return edges.pagerank_losses(graph.ppr_exact(t.graph, nodes), _observed(t)).select("restart", F.round("loss", 4).alias("loss"))


@query("d13_edge_objective", f"WITH p AS ({_ALL_RESTARTS}), {_OBSERVED}, l AS (SELECT sum(5e-1 * pow(p.p - coalesce(o.o, 0), 2)) AS loss FROM p LEFT JOIN o ON p.restart = o.restart AND p.node = o.node WHERE p.restart <> p.node) SELECT 1 AS wnid, round(5e-1 * 1e-6 * (SELECT sum(w * w) FROM fx_graph) + loss, 3) AS value FROM l")
def _(t):
    one = F.lit(1).alias("wnid")
    got = edges.objective_of(t.graph.select(one, "src", "dst", "w"), _observed(t).select(one, "restart", "node", "o"), ridge=1e-6)
    return got.select("wnid", F.round("value", 3).alias("value"))


def _gradient_sql(n: int) -> str:
    """The adjoint of each restart's misfit by power steps along turned edges, and the chain rule through the sums of rows."""
    steps = ["l0 AS (SELECT restart, node, m AS l FROM mi)"]
    for i in range(1, n + 1):
        steps.append(
            f"l{i} AS MATERIALIZED (SELECT mi.restart, mi.node, m + coalesce(q, 0) AS l FROM mi LEFT JOIN (SELECT restart, src AS node, sum(l * t * 5e-1) AS q FROM l{i - 1} JOIN ar ON node = dst GROUP BY ALL) f ON f.restart = mi.restart AND f.node = mi.node)"
        )
    return f"""WITH p AS ({_ALL_RESTARTS.replace('round(p, 6)', 'p')}), {_OBSERVED}, mi AS (SELECT p.restart, p.node, CASE WHEN p.restart = p.node THEN 0 ELSE p.p - coalesce(o.o, 0) END AS m FROM p LEFT JOIN o ON p.restart = o.restart AND p.node = o.node),
 sm AS (SELECT src, sum(w) AS s FROM fx_graph GROUP BY src), tr AS (SELECT src, dst, w, s, w / s AS t FROM fx_graph JOIN sm USING (src)),
 nn AS (SELECT src AS node FROM fx_graph UNION SELECT dst FROM fx_graph), ar AS (SELECT src, dst, t FROM tr UNION ALL SELECT a.node, b.node, 1 / (SELECT count(*) FROM nn) FROM nn a, nn b WHERE a.node NOT IN (SELECT src FROM tr)), {', '.join(steps)},
 d AS (SELECT src, dst, any_value(w) AS w, any_value(s) AS s, 5e-1 * sum(p.p * l.l) AS d FROM tr JOIN p ON p.node = src JOIN l{n} l ON l.restart = p.restart AND l.node = dst GROUP BY src, dst)
 SELECT src, dst, round((d - sum(d * w) OVER (PARTITION BY src) / s) / s * 1e6 + 1e-3 * w, 2) AS slope FROM d"""


@query("d12_pagerank_gradient", _gradient_sql(30))
def _(t):
    """How the losses of all restarts change with the weight of each edge, by the adjoint iteration; in millionths, with a ridge of a thousandth of these."""
    one = F.lit(1).alias("graph")
    _, slopes = pagerank.loss_and_gradient(t.graph.select(one, "src", "dst", "w"), _observed(t).select(one, "restart", "node", "o"), ridge=1e-9, tol=1e-9)
    return slopes.select("src", "dst", F.round(F.col("slope") * 1e6, 2).alias("slope"))


@query("d11_pagerank_eigenvector", _eigen_sql(25))
def _(t):
    return graph.renormalized_ppr(t.graph, renorm="log10", row_normalize=False).withColumn("p", F.round("p", 6))
