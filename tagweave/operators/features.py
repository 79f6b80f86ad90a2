"""Pair features, relation profiles, pooled detections, feature matrices and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_features(pairs: DataFrame, bags: DataFrame, key: str = "frame_id") -> tuple[DataFrame, DataFrame]:
    """(w1, w2, feat, cnt) over frames, and (w1, w2, freq); pairs of frames without words are left out."""
    p = pairs.select(key, F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"))
    joined = p.join(bags.select(key, "feat"), key)
    freq = p.join(bags.select(key).distinct(), key, "left_semi").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("freq"))
    return joined.groupBy("w1", "w2", "feat").agg(F.count(F.lit(1)).alias("cnt")), freq


def relation_profile(triples: DataFrame, features: DataFrame) -> DataFrame:
    """(rel, feat, cnt, share): features of a relation's pairs, counted and divided by the pairs that have any."""
    t = triples.select("rel", F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2")).distinct()
    j = t.join(features, ["w1", "w2"])
    n = j.select("rel", "w1", "w2").distinct().groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    c = j.groupBy("rel", "feat").agg(F.sum("cnt").alias("cnt"))
    return c.join(n, "rel").select("rel", "feat", "cnt", (F.col("cnt") / F.col("n")).alias("share"))


def profile_matrix(profile: DataFrame, top: int = 25) -> DataFrame:
    """(rel, feat, share, col): each relation against the union of all relations' ``top`` features, zeros filled in.

    Columns are numbered by falling sum of shares. Relations and their top
    features are few, whatever the number of pairs.
    """
    w = Window.partitionBy("rel").orderBy(F.desc("cnt"), "feat")
    feats = profile.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("feat").distinct()
    kept = profile.join(feats, "feat", "left_semi")
    cols = kept.groupBy("feat").agg(F.sum("share").alias("_s"))
    # one row a column of the matrix
    cols = cols.withColumn("col", F.row_number().over(Window.orderBy(F.desc(F.round("_s", 9)), "feat")).cast("long")).drop("_s")
    grid = profile.select("rel").distinct().crossJoin(F.broadcast(cols))
    return grid.join(kept.select("rel", "feat", "share"), ["rel", "feat"], "left").select("rel", "feat", F.coalesce("share", F.lit(0.0)).alias("share"), "col")


def merge_labels(labels: DataFrame, mapping: DataFrame, img: str = "img_id") -> DataFrame:
    """(img, label, value): the largest value of the raw labels of one canonical label."""
    return labels.join(mapping, "raw").groupBy(img, "label").agg(F.max("value").alias("value"))


def pool_detections(dets: DataFrame, k: int = 3, img: str = "img_id") -> DataFrame:
    """(img, obj, n, top, pooled): mean of the ``k`` best confidences if there are so many, else the best; and the best."""
    w = Window.partitionBy(img, "obj").orderBy(F.desc("conf"), "det_no")
    r = dets.withColumn("_r", F.row_number().over(w))
    g = r.groupBy(img, "obj").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("top"), F.avg(F.when(F.col("_r") <= k, F.col("conf"))).alias("_m"))
    return g.select(img, "obj", "n", "top", F.when(F.col("n") >= k, F.col("_m")).otherwise(F.col("top")).alias("pooled"))


def fill_grid(pooled: DataFrame, images: DataFrame, objects: DataFrame, img: str = "img_id", missing: float = -1.0) -> DataFrame:
    """(img, obj, value): each image with each object class, ``missing`` where nothing was detected. Classes are a fixed list."""
    grid = images.select(img).distinct().crossJoin(F.broadcast(objects.select("obj").distinct()))
    return grid.join(pooled.select(img, "obj", "pooled"), [img, "obj"], "left").select(img, "obj", F.coalesce("pooled", F.lit(missing)).alias("value"))


def max_pool(values: DataFrame, size: int, layout: str = "block", key: str = "img_id") -> DataFrame:
    """(key, dim, value): maxima of ``size`` neighbours (``block``), or of every ``size``-th value (``stride``)."""
    dim = F.floor(F.col("pos") / size) if layout == "block" else F.pmod("pos", F.lit(size))
    return values.groupBy(key, dim.cast("long").alias("dim")).agg(F.max("value").alias("value"))


def tag_vectors(counts: DataFrame, tag_concepts: DataFrame, pairs: DataFrame, how: str = "sum") -> DataFrame:
    """(tag, feat, value): sum or mean of the count vectors of a tag's concepts; tags without concepts take their co-occurrence counts."""
    agg = F.sum if how == "sum" else F.avg
    mapped = tag_concepts.join(counts.select("wnid", F.col("tag").alias("feat"), "cnt"), "wnid").groupBy("tag", "feat").agg(agg("cnt").cast("double").alias("value"))
    both = pairs.select("w1", "w2", "freq").union(pairs.select("w2", "w1", "freq")).toDF("tag", "feat", "freq")
    rest = both.join(tag_concepts.select("tag").distinct(), "tag", "left_anti").select("tag", "feat", F.col("freq").cast("double").alias("value"))
    return mapped.union(rest).where("value <> 0")


def select_dims(scores: DataFrame, n: int, by: str, key: str = "tag", seed: int = 0) -> DataFrame:
    """The ``n`` features with the best score or count, or at random (by a multiplicative hash of ``key_id``)."""
    order = [F.desc(by), F.col(key)] if by != "random" else [F.pmod((F.col("key_id") + seed) * 2654435761, F.lit(1 << 32)), F.col(key)]
    return scores.orderBy(*order).limit(n).select(key)


def combine_features(base: DataFrame, graph: DataFrame, mode: str = "concat", key: str = "tag") -> DataFrame:
    """(tag, feat, value): base or graph features alone, both side by side, their sum, or the identity; absent values are 0.

    Graph features are divided by their largest value. With ``concat``, tags
    without graph features take the mean of each graph feature.
    """
    if mode == "identity":
        return base.select(key, F.col(key).alias("feat"), F.lit(1.0).alias("value")).distinct()
    b = base.select(key, "feat", F.col("value").cast("double").alias("value"))
    if mode == "base":
        return b
    top = graph.agg(F.max("value").alias("_m"))
    g = graph.crossJoin(F.broadcast(top)).select(key, "feat", (F.col("value") / F.col("_m")).alias("value"))
    if mode == "graph":
        return g
    if mode == "add":
        return b.union(g).groupBy(key, "feat").agg(F.sum("value").alias("value"))
    n = g.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    mean = g.groupBy("feat").agg(F.sum("value").alias("_s")).crossJoin(F.broadcast(n)).select("feat", (F.col("_s") / F.col("_n")).alias("value"))
    missing = b.select(key).distinct().join(g.select(key).distinct(), key, "left_anti")
    filled = missing.crossJoin(mean).select(key, "feat", "value")  # a dense row for each tag that lacks one
    name = F.concat(F.lit("g:"), "feat")
    return b.select(key, F.concat(F.lit("b:"), "feat").alias("feat"), "value").union(g.union(filled).select(key, name.alias("feat"), "value"))


def nearest(queries: DataFrame, base: DataFrame, k: int, qid: str = "q_id", bid: str = "b_id", vec: str = "vec", wave: int = 20_000, block: int = 2048) -> DataFrame:
    """(q_id, b_id, dist, place): the ``k`` nearest base rows of each query by squared distance; equal ones by id.

    About ``wave`` queries at a time are sent to all tasks; each keeps its k
    best by products of ``block`` rows over its own base rows, and a window
    merges them. Distances count to nine digits, here as in the merge, so ties
    are settled by id wherever they meet.
    """
    kinds = dict(queries.dtypes)[qid], dict(base.dtypes)[bid]
    schema = f"{qid} {kinds[0]}, {bid} {kinds[1]}, dist double"
    out = base.sparkSession.createDataFrame([], schema)
    waves = -(-queries.count() // wave)
    for n in range(waves):
        some = queries.select(qid, vec).where(F.pmod(F.xxhash64(qid), F.lit(waves)) == n).toPandas()
        if len(some):
            x = np.stack(some[vec].map(lambda v: np.asarray(v, float)))
            shared = base.sparkSession.sparkContext.broadcast((some[qid].to_numpy(), x))
            out = out.union(base.select(bid, vec).mapInPandas(_nearest_here(shared, k, qid, bid, vec, block), schema))
    w = Window.partitionBy(qid).orderBy("dist", bid)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _nearest_here(shared, k: int, qid: str, bid: str, vec: str, block: int):
    def best_of(row, dist, ids):
        """The k best entries of each query, by distance and id."""
        order = np.lexsort((ids, dist, row))
        row, dist, ids = row[order], dist[order], ids[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        return row[keep], dist[keep], ids[keep]

    def local(batches):
        names, x = shared.value
        best = None
        for pdf in batches:
            y = np.stack(pdf[vec].map(lambda v: np.asarray(v, float)))
            ids = pdf[bid].to_numpy()
            ids = ids.astype(str) if ids.dtype == object else ids
            for q in range(0, len(x), block):
                for at in range(0, len(y), block):
                    own, part = x[q : q + block], y[at : at + block]
                    d = np.maximum((own * own).sum(1)[:, None] - 2 * own @ part.T + (part * part).sum(1)[None, :], 0).round(9)
                    # all that tie with the k-th stay for now
                    limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                    row, col = np.nonzero(d <= limit[:, None])
                    found = best_of(row + q, d[row, col], ids[at + col])
                    best = found if best is None else best_of(*(np.concatenate(v) for v in zip(best, found)))
        if best is not None:
            row, dist, ids = best
            yield pd.DataFrame({qid: names[row], bid: ids, "dist": dist})

    return local


def knn_vote(neighbours: DataFrame, labels: DataFrame, qid: str = "q_id", bid: str = "b_id") -> DataFrame:
    """(q_id, tag, vote): labels of the neighbours added."""
    return neighbours.join(labels, bid).groupBy(qid, "tag").agg(F.sum("r").alias("vote"))


def mean_nearest(neighbours: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), qid: str = "q_id") -> DataFrame:
    """(q_id, d1, d3, ...): mean distance of the k nearest."""
    return neighbours.groupBy(qid).agg(*(F.avg(F.when(F.col("place") <= k, F.col("dist"))).alias(f"d{k}") for k in ks))


def _rows_of(v) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths) of a list array, shorter rows filled with 0; the length is -1 where a row or one of its components is null."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    n, flat = len(v), v.flatten()
    if n and not v.null_count and not flat.null_count:
        size = np.diff(v.offsets.to_numpy())
        if (size == size[0]).all():
            return flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1), size.astype(int)
    rows = v.to_pylist()
    size = np.array([-1 if r is None or None in r else len(r) for r in rows], int)
    out = np.zeros((n, max(size.max(initial=0), 0)))
    for i, r in enumerate(rows):
        if size[i] > 0:
            out[i, : size[i]] = r
    return out, size


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices, each summed from its first component on, so that all bits are those of a plain loop."""
    dim = min(x.shape[1], y.shape[1])
    out, term = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for d in range(dim):
        np.multiply(x[:, d, None], y[None, :, d], out=term)
        out += term
    return out


def pair_distances(a: DataFrame, b: DataFrame, vec: str = "vec", most: int = 10_000, task_pairs: int = 5_000_000) -> DataFrame:
    """(a_id, b_id, dist): squared distances as x.x + y.y - 2 x.y; null where a vector or a component is, or lengths differ.

    The second side has to be a small one: up to ``most`` rows are broadcast
    and compared in blocks, in tasks of about ``task_pairs`` pairs; more are joined one by one.
    """
    some = b.select("b_id", F.col(vec).cast("array<double>").alias("y")).limit(most + 1).toArrow()
    if some.num_rows > most:
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
        j = a.select("a_id", F.col(vec).alias("x")).crossJoin(b.select("b_id", F.col(vec).alias("y")))
        return j.select("a_id", "b_id", (dot(F.col("x"), F.col("x")) + dot(F.col("y"), F.col("y")) - 2 * dot(F.col("x"), F.col("y"))).alias("dist"))
    spark, (y, y_size) = a.sparkSession, _rows_of(some.column("y"))
    shared = spark.sparkContext.broadcast((some.column("b_id").combine_chunks(), y, y_size, (y * y).cumsum(1)[:, -1] if y.shape[1] else np.zeros(len(y))))

    def run(batches):
        ids, own, sizes, squares = shared.value
        for batch in batches:
            x, x_size = _rows_of(batch.column(1))
            xx = (x * x).cumsum(1)[:, -1] if x.shape[1] else np.zeros(len(x))
            for i in range(0, len(x), 128):
                for j in range(0, len(own), 512):
                    p, q = slice(i, i + 128), slice(j, j + 512)
                    dist = xx[p, None] + squares[None, q] - 2 * _dots(x[p], own[q])
                    no = (x_size[p, None] != sizes[None, q]) | (x_size[p, None] < 0)
                    m, k = dist.shape
                    mine, other = batch.column(0).slice(i, m).take(pa.array(np.repeat(np.arange(m), k))), ids.slice(j, k).take(pa.array(np.tile(np.arange(k), m)))
                    yield pa.RecordBatch.from_arrays([mine, other, pa.array(dist.ravel(), mask=no.ravel() if no.any() else None)], ["a_id", "b_id", "dist"])

    rows = a.select("a_id", F.col(vec).cast("array<double>").alias("x"))
    parts = -(-rows.count() * some.num_rows // task_pairs)
    if parts > 1:  # a file may be one task whatever its rows are compared with
        rows = rows.repartition(parts)
    return rows.mapInArrow(run, f"a_id {dict(a.dtypes)['a_id']}, b_id {dict(b.dtypes)['b_id']}, dist double")


def predict(features: DataFrame, matrix: np.ndarray, tags: list[str], key: str = "img_id", vec: str = "vec", cells: int = 1 << 19) -> DataFrame:
    """(key, tag, score): scores of each row against the columns of a matrix, which is broadcast; products of about ``cells`` scores at a time."""
    shared, kind = features.sparkSession.sparkContext.broadcast((np.ascontiguousarray(matrix, float), pa.array(tags, pa.string()))), dict(features.dtypes)[key]

    def run(batches):
        w, names = shared.value
        step = max(1, cells // max(1, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                n = pa.array(np.repeat(np.arange(part.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(n), pa.concat_arrays([names] * part.num_rows), pa.array((x @ w).ravel())], ["key", "tag", "score"])

    rows = features.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")
    return rows.mapInArrow(run, f"key {kind}, tag string, score double").withColumnRenamed("key", key)


def svd_similarity(matrix: DataFrame, rank: int, row: str = "concept", col: str = "feat", value: str = "value", max_rows: int = 2_000) -> DataFrame:
    """(c1, c2, sim), c1 < c2, sim > 0: similarity U S U' from a rank-limited SVD of the row-normalised matrix.

    Exact, for at most ``max_rows`` concepts: their Gram matrix is made by a
    join over shared features, its eigenvectors on the driver. Above that there
    is an error, before anything is multiplied; ``lowrank`` has no such bound.
    """
    norm = matrix.groupBy(row).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n")).where("_n > 0")
    m = matrix.join(norm, row).select(row, col, (F.col(value) / F.col("_n")).alias("v"))
    a, b = m.toDF("a", col, "x"), m.toDF("b", col, "y")
    gram = a.join(b, col).where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    ids = sorted(r[0] for r in norm.select(row).limit(max_rows + 1).collect())
    if len(ids) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    at, g = {x: i for i, x in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for p, q, v in gram.toPandas().itertuples(index=False):
        g[at[p], at[q]] = g[at[q], at[p]] = v
    values, vectors = np.linalg.eigh(g)
    keep = np.argsort(-values)[:rank]
    s = np.sqrt(np.maximum(values[keep], 0))
    sim = (vectors[:, keep] * s) @ vectors[:, keep].T
    i, j = np.nonzero(np.triu(sim > 1e-12, 1))
    pdf = pd.DataFrame({"c1": [ids[k] for k in i], "c2": [ids[k] for k in j], "sim": sim[i, j]})
    return matrix.sparkSession.createDataFrame(pdf, "c1 string, c2 string, sim double")
