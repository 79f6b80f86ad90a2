"""SimHash near-duplicates by anchor-point covering.

Fingerprints within ``threshold`` bits of each other have to meet somewhere.
They meet at anchors: the codewords of a covering code. The code is a product
of two perfect binary Golay codes [23, 12] (covering radius 3 each) on bits
0-22 and 23-45, and of the single word 0 on bits 46-63 (covering radius 18),
so 2**24 anchors cover all 64-bit words. A fingerprint x has one nearest
anchor; in each Golay block it lies within 3 bits. If y differs from x in e1
and e2 bits of the blocks, e1 + e2 <= threshold, that anchor lies within
3 + e1 and 3 + e2 bits of y. So each fingerprint is replicated to all anchors
within covering radius plus threshold, and at every anchor those nearest to it
are compared with all that came: no link can be lost, whatever the data.

The anchors around a word are the words of its coset with small weight, read
from a table by syndrome, so replication costs a few table look-ups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import components, cut, small_batches, star_forest

BLOCK, RADIUS = 23, 3
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEED = 42
#: Bytes of replicated fingerprints that one bucket of anchors should hold.
BUCKET_BYTES = 12 << 20
#: Fingerprints whose replicas are made and packed at once.
SPREAD_ROWS = 20_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # byte -> bits, most significant first
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over ``width``-word shingles; 0 for null, empty and blank texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return int.from_bytes(digest(joined, SEED), "big")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hashes = b"".join([digest(joined[a:z], SEED) for a, z in zip(starts, ends[width - 1 :].tolist())])
    flat = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _LANES
    ones = np.einsum("lb,bk->lk", np.bincount(flat.ravel(), minlength=2048).reshape(8, 256), _BITS)
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: str | None = None) -> DataFrame:
    """(doc_id, fp, carry): the fingerprint as a signed long, one row per input row; ``carry`` names a string column."""
    small_batches(docs.sparkSession)
    more = [] if carry is None else [carry]

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *more])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} string" for c in more)]))


def _syndromes() -> np.ndarray:
    one = []
    for i in range(BLOCK):
        v = 1 << i
        for k in range(BLOCK - 1, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        one.append(v)
    return np.array(one, np.int64)


class _Cosets:
    """Error patterns of weight up to RADIUS + extra by syndrome, lightest first."""

    def __init__(self, extra: int):
        self.one = _syndromes()
        pats, weights = [0], [0]
        for w in range(1, RADIUS + extra + 1):
            for c in combinations(range(BLOCK), w):
                pats.append(sum(1 << i for i in c))
                weights.append(w)
        pats, weights = np.array(pats, np.int64), np.array(weights)
        synd = self.syndrome(pats)
        order = np.lexsort((pats, weights, synd))
        self.pats = pats[order]
        self.weights = weights[order]
        self.start = np.searchsorted(synd[order], np.arange(2**11 + 1))
        #: number of patterns of weight <= RADIUS + e, for each syndrome
        self.upto = [
            np.bincount(synd[weights <= RADIUS + e], minlength=2**11) for e in range(extra + 1)
        ]

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        for i in range(BLOCK):
            out ^= np.where(v >> i & 1, self.one[i], 0)
        return out

    def around(self, v: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All codewords within RADIUS + extra of each v: (index into v, codeword, distance)."""
        s = self.syndrome(v)
        n = self.upto[extra][s]
        at = np.repeat(np.arange(len(v)), n)
        k = self.start[s][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, v[at] ^ self.pats[k], self.weights[k]


_CACHE: dict[int, _Cosets] = {}


def cosets(threshold: int) -> _Cosets:
    return _CACHE.setdefault(threshold, _Cosets(threshold)) if threshold not in _CACHE else _CACHE[threshold]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, nearest): the anchors that each fingerprint goes to; ``nearest`` marks its own one."""
    table = cosets(threshold)
    low = (fps & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    high = (fps >> np.uint64(BLOCK) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    ia, ca, wa = table.around(low, threshold)
    ib, cb, wb = table.around(high, threshold)
    # pair the two lists of each fingerprint, keep those whose excess weights fit the threshold
    nb = np.bincount(ib, minlength=len(fps))
    first = np.cumsum(nb) - nb
    rep = nb[ia]
    left = np.repeat(np.arange(len(ia)), rep)
    right = first[ia][left] + np.arange(len(left)) - np.repeat(np.cumsum(rep) - rep, rep)
    over = np.maximum(wa[left] - RADIUS, 0) + np.maximum(wb[right] - RADIUS, 0)
    ok = over <= threshold
    left, right = left[ok], right[ok]
    # a codeword has a data part of 12 bits: the upper 12 of its 23 bits name it
    key = (ca[left] >> 11) << 12 | cb[right] >> 11
    return ia[left], key, (wa[left] <= RADIUS) & (wb[right] <= RADIUS)


def links_at_anchors(key, own, fp, rep, threshold: int, chunk: int = 1 << 22):
    """Stars (node, least) that connect all linked fingerprints that met at these anchors."""
    order = np.lexsort((~own, key))
    key, own, fp, rep = key[order], own[order], fp[order], rep[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([new, [len(key)]]))
    owns = np.add.reduceat(own.astype(np.int64), new)
    a, b = [], []
    todo = np.flatnonzero((owns > 0) & (size > 1))
    # every own fingerprint of an anchor against all that came there, in slices of bounded size
    mine = np.repeat(new[todo], owns[todo]) + _ranges(owns[todo])
    begin, count = np.repeat(new[todo], owns[todo]), np.repeat(size[todo], owns[todo])
    done, total = 0, np.concatenate([[0], np.cumsum(count)])
    while done < len(mine):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + chunk, "right")) - 1)
        i = np.repeat(mine[done:upto], count[done:upto])
        j = np.repeat(begin[done:upto], count[done:upto]) + _ranges(count[done:upto])
        near = (rep[i] != rep[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= threshold)
        x, y = star_forest(rep[i[near]], rep[j[near]])
        a.append(x)
        b.append(y)
        if len(a) > 32:
            x, y = star_forest(np.concatenate(a), np.concatenate(b))
            a, b = [x], [y]
        done = upto
    return star_forest(np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])


def _ranges(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def near_fingerprints(reps: DataFrame, threshold: int = 2) -> DataFrame:
    """Components of distinct fingerprints (fp, rep): (node, root) by the ids in ``rep``.

    Replicas travel packed, one row per source batch and bucket of anchors.
    The number of buckets follows the number of fingerprints, so a bucket's
    size doesn't grow with the corpus.
    """
    n = reps.count()
    buckets = max(4, -(-n * 61 * 20 // BUCKET_BYTES))
    small_batches(reps.sparkSession)

    def parts(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SPREAD_ROWS:
                yield held
                held = []
        if held:
            yield held

    def spread(batches):
        for held in parts(batches):
            fp = np.concatenate([b.column(0).to_numpy() for b in held]).view(np.uint64)
            rep = np.concatenate([b.column(1).to_numpy() for b in held])
            at, key, own = anchors(fp, threshold)
            bucket = (key.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                o = order[cuts[k] : cuts[k + 1]]
                if len(o):
                    packed = [
                        ((key[o] << 1) | own[o]).astype("<u4").tobytes(), fp[at[o]].tobytes(), rep[at[o]].tobytes()
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)],
                        ["bucket", "key", "fp", "rep"],
                    )

    def meet(part: pa.Table) -> pa.Table:
        key, fp, rep = (
            np.frombuffer(b"".join(part.column(c).to_pylist()), t)
            for c, t in (("key", "<u4"), ("fp", "<u8"), ("rep", "<i8"))
        )
        a, b = links_at_anchors((key >> 1).astype(np.int64), (key & 1).astype(bool), fp, rep, threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = reps.select("fp", "rep").mapInArrow(spread, "bucket int, key binary, fp binary, rep binary")
    edges = sent.groupBy("bucket").applyInArrow(meet, "a long, b long")
    return components(edges)


def _classes(fps: DataFrame, threshold: int) -> DataFrame:
    """(fp, root): the group of each distinct fingerprint, named by its least fingerprint."""
    distinct = cut(fps.select("fp").distinct(), "reps")
    roots = near_fingerprints(distinct.withColumn("rep", F.col("fp")), threshold)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, width: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups, one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``threshold`` differing bits. Documents with equal fingerprints form one
    class before anything is compared, so large groups of copies cost no more
    than one. Null and empty texts have fingerprint 0 and are linked like any
    other. Repeated rows stay repeated; rows without an id link others and get
    the component of those that have one. Whole texts count, however long, and
    other columns, whatever their names, are left aside; an empty table gives
    an empty one.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width), "fps")
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = cut(_classes(fps, threshold).join(low, "fp"), "classes")
    names = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(classes.join(names, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does.

    That is the one with the smallest id, of several with that id the one whose
    text has the least digest, and one without an id only if all are. Of rows
    that agree in both, one stays: the least by its other columns.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary")))
    fps = fingerprints(docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text")), "id", "text", width, carry="key")
    fps = cut(fps, "fps")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    kept = fps.join(_classes(fps, threshold), "fp").groupBy("root").agg(first).select(F.col("first.key").alias("_key"))
    own = F.min(F.struct(*docs.columns)).alias("_row")
    return docs.withColumn("_key", key).join(kept, "_key", "left_semi").groupBy("_key").agg(own).select("_row.*")
