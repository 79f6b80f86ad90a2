"""Benchmark decontamination over a positional inverted index in segments.

The corpus is tokenised once into index segments: a segment holds some
documents' ids and sizes, its distinct words and, for each word, the sorted
list of its places. Segments are rows of a table in the shared folder that
knows nothing of any test set; nothing is shuffled, and any number of test sets
or blocks of one can be searched in it.

Searching: one pass over the words of all segments counts how often the corpus
has each test word. A window of test words without a word that the corpus lacks
is looked for at its rarest one. In a segment, only the words that it holds are
looked up among those rarest words; a hit's list of places, moved by the word's
offset, gives the alignments, which are intersected with the neighbours' lists,
moved likewise, until the run of matching words around it is known. A run as
long as the window is an exact phrase. The same lists give proximity matches:
most of a window's words near the places where the phrase would have them.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import cut, small_batches, words_of

WINDOW = 10
#: Words of documents in one index segment.
SEGMENT_WORDS = 1_000_000
#: Bytes of test texts that are searched at once (they are broadcast); larger test sets are searched block by block.
BLOCK_BYTES = 16 << 20
SEGMENT = "segment long, docs binary, has_id binary, sizes binary, words binary, counts binary, places binary"
RESULT = T.StructType(
    [
        T.StructField("segment", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)


class _Numbers(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Index segments of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        seg, number = _Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seg.add(doc, words_of(text))
                if seg.words >= segment_words:
                    yield seg.flush(number)
                    seg, number = _Segment(), number + 1
        if seg.docs:
            yield seg.flush(number)

    return docs.mapInArrow(run, SEGMENT)


class _Segment:
    def __init__(self):
        self.docs, self.sizes, self.ids, self.known, self.words = [], [], [], _Numbers(), 0

    def add(self, doc, words):
        self.docs.append(doc)
        self.sizes.append(len(words))
        self.ids.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.words += len(words) + 1

    def flush(self, number: int) -> pa.RecordBatch:
        sizes = np.array(self.sizes, np.int64)
        ids = np.concatenate(self.ids)
        # one place between documents stays free
        at = (np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)).astype("<u4")
        counts = np.bincount(ids, minlength=len(self.known)).astype("<u4")
        places = at[np.argsort(ids, kind="stable")]
        gaps = np.diff(places, prepend=np.uint32(0))
        starts = np.cumsum(counts) - counts
        gaps[starts] = places[starts]
        has = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        squeeze = zstandard.ZstdCompressor(level=1).compress
        # bytes of one rank together: most gaps are small
        parts = [docs.tobytes(), has.tobytes(), sizes.astype("<u4").tobytes(), squeeze(b" ".join(self.known)), counts.tobytes(), squeeze(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], [c.split()[0] for c in SEGMENT.split(", ")])


def _words(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


class Items:
    """Test items as word numbers, and at which of their words to look for each window."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.vocabulary, self.names, self.window = _Numbers(), [], window
        seqs = []
        for name, text in rows:
            words = words_of(text)
            if words:
                seqs.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
                self.names.append("null" if name is None else str(name))
        self.vocabulary = dict(self.vocabulary)
        size = np.array([len(s) for s in seqs], np.int32)
        self.words = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
        self.of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.end = np.cumsum(size, dtype=np.int32)
        self.begin = self.end - size
        self.need = np.minimum(size, window)

    def choose(self, df: np.ndarray, near_share: float) -> None:
        """Pivots by the corpus counts of all words: for exact matches the rarest word of each window.

        A proximity match may lack some words of a window, so it is looked for at
        as many of the rarest ones that the corpus has as at least one remains.
        """
        exact, near = [], []
        spare = self.window - int(np.ceil(near_share * self.window)) + 1
        for a in range(0, len(self.words), 1 << 18):  # starts of windows, some at a time
            start = np.arange(a, min(a + (1 << 18), len(self.words)), dtype=np.int64)
            item = self.of[start]
            start = start[start + self.need[item] <= self.end[item]]
            where = start[:, None] + np.minimum(np.arange(self.window)[None, :], self.need[self.of[start]][:, None] - 1)
            freq = df[self.words[where]]
            rarest = np.take_along_axis(where, freq.argmin(1)[:, None], 1)[:, 0]
            exact.append(np.unique(rarest[freq.min(1) > 0]))
            order = np.argsort(np.where(freq > 0, freq, 1 << 60), 1, kind="stable")[:, :spare]
            some = np.take_along_axis(where, order, 1)
            near.append(np.unique(some[np.take_along_axis(freq, order, 1) > 0]))
        self.exact, self.near = (self._by_word(np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64)) for x in (exact, near))

    def _by_word(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first of each word's, positions by word)."""
        word = self.words[at]
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1)).astype(np.int32), at[order].astype(np.int32)


def corpus_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often the corpus has each word of ``vocabulary``; reads the words and counts of the index alone."""
    known = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total, get = np.zeros(len(known.value), np.int64), known.value.get
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.fromiter((get(w, -1) for w in _words(words)), np.int64)
                total[ids[ids >= 0]] += np.frombuffer(counts, "<u4")[ids >= 0]
        if total.any():
            at = np.flatnonzero(total)
            for a in range(0, len(at), 1 << 16):
                some = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    # at most one row for each word of the block, whose bytes are bounded
    for batch in index.select("words", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def search_segment(items: Items | None, segment, docs, has, sizes, words, counts, places, slop: int, near_share: float, all_rows: bool):
    """Rows of RESULT for one segment; without ``all_rows`` those with matches."""
    docs, has = np.frombuffer(docs, "<i8"), np.frombuffer(has, np.uint8)
    sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    total = int(sizes.sum() + len(sizes))
    hits, found, near = [], [], []
    ids = np.zeros(0, np.int64)
    if items is not None:
        ids = np.fromiter((items.vocabulary.get(w, -1) for w in _words(words)), np.int64)
    if (ids >= 0).any():
        counts = np.frombuffer(counts, "<u4").astype(np.int64)
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), np.uint8).reshape(4, -1)
        run = np.cumsum(np.ascontiguousarray(flat.T).view("<u4").ravel().astype(np.int64))
        begin = np.cumsum(counts) - counts
        before = np.where(begin > 0, run[begin - 1], 0)  # gaps go on over words; each list starts anew
        # the lists of words that the tests have, in the order of their numbers there
        own = np.flatnonzero(ids >= 0)
        own = own[np.argsort(ids[own])]
        n = counts[own]
        first = np.cumsum(n) - n
        at = np.repeat(begin[own] - first, n) + np.arange(int(n.sum()))
        place = run[at] - np.repeat(before[own], n)
        post = (np.repeat(ids[own], n) << 40) | place
        for (start, pivots), exact in ((items.exact, True), (items.near, False)):
            many = (start[ids[own] + 1] - start[ids[own]]).astype(np.int64)
            used = np.flatnonzero(many)
            pairs = many[used] * n[used]
            for a, z in _slices(pairs, 1 << (20 if exact else 18)):
                w, k = used[a:z], pairs[a:z]
                i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                wide = np.repeat(n[w], k)
                p = pivots[np.repeat(start[ids[own[w]]], k) + i // wide].astype(np.int64)
                q = place[np.repeat(first[w], k) + i % wide]
                item = items.of[p]
                if exact:
                    left, right = _extent(items, post, p, q, item)
                    ok = left + right + 1 >= items.need[item]
                    hits.append((q[ok] - left[ok], q[ok] + right[ok]))
                    found.append((item[ok], q[ok]))
                else:
                    ok = _nearby(items, post, p, q, item, slop, near_share)
                    near.append((item[ok], q[ok]))
    mark = np.zeros(total + 1, np.int32)
    for a, z in hits:
        np.add.at(mark, a, 1)
        np.add.at(mark, z + 1, -1)
    hit = np.cumsum(mark[:total]) > 0
    exact, close = _by_doc(items, base, found), _by_doc(items, base, near)
    for d in range(len(docs)) if all_rows else sorted({*exact, *close}):
        names = exact.get(d, [])
        yield (
            segment,
            d,
            int(docs[d]) if has[d] else None,
            int(sizes[d]),
            np.flatnonzero(hit[base[d] : base[d] + sizes[d]]).tolist() if names else [],
            names,
            [x for x in close.get(d, []) if x not in names],
        )


def _slices(n: np.ndarray, most: int):
    total, at = np.cumsum(n), 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def _has(post, key):
    i = np.searchsorted(post, key)
    return post[np.minimum(i, len(post) - 1)] == key


def _extent(items, post, p, place, item):
    """How many words to the left and right of the rarest one match without a break, within the item and a window."""
    out = []
    for step in (-1, 1):
        length = np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        for k in range(1, items.window):
            q, at = p[live] + step * k, place[live] + step * k
            ok = (q >= items.begin[item[live]]) & (q < items.end[item[live]]) & (at >= 0)
            ok[ok] = _has(post, (items.words[q[ok]].astype(np.int64) << 40) | at[ok])
            live = live[ok]
            if not len(live):
                break
            length[live] += 1
        out.append(length)
    return out


def _nearby(items, post, p, place, item, slop, near_share) -> np.ndarray:
    """Whether some window with the pivot has ``near_share`` of its words within ``slop`` of their places."""
    w = items.window
    have = np.zeros((len(p), 2 * w), np.int32)  # running sums from w - 1 words before the pivot on
    for j, k in enumerate(range(1 - w, w)):
        q, at = p + k, place + k
        ok = (q >= items.begin[item]) & (q < items.end[item])
        key = items.words[q[ok]].astype(np.int64) << 40
        low = key | np.maximum(at[ok] - slop, 0)
        i = np.minimum(np.searchsorted(post, low), len(post) - 1)
        ok[ok] = (post[i] >= low) & (post[i] <= (key | np.maximum(at[ok] + slop, 0)))
        have[:, j + 1] = have[:, j] + ok
    out, need, row = np.zeros(len(p), bool), items.need[item].astype(np.int64), np.arange(len(p))
    for j in range(w):  # the window starts j words before the pivot
        start = p - j
        ok = (j < need) & (start >= items.begin[item]) & (start + need <= items.end[item])
        first = w - 1 - j
        out |= ok & (have[row, first + need] - have[:, first] >= np.ceil(near_share * need))
    return out


def _by_doc(items, base, found) -> dict[int, list[str]]:
    if not found:
        return {}
    item, place = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    doc = np.searchsorted(base, place, "right") - 1
    out: dict[int, set[str]] = {}
    for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
        out.setdefault(d, set()).add(items.names[i])
    return {d: sorted(names) for d, names in out.items()}


def search(index: DataFrame, items: Items | None, slop: int = 3, near_share: float = 0.8, all_rows: bool = True) -> DataFrame:
    """RESULT of one block of items, or of none: all documents, or those with matches."""
    shared = index.sparkSession.sparkContext.broadcast(items)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(search_segment(shared.value, *row, slop, near_share, all_rows))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], RESULT.names)

    return index.mapInArrow(run, RESULT)


def _blocks(tests: DataFrame, block_bytes: int) -> list[DataFrame]:
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    # hashed blocks are about even; twice as many as needed leaves room for the uneven ones
    n = 1 if n == 1 else 2 * n
    return [tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    slop: int = 3,
    near_share: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items, hit_places), one row per document row.

    ``tests`` has item_id and text. An item with fewer words than the window
    is one window; items without words match nothing. Null texts have no
    words. Rows that repeat are answered each, items with one id count once, and
    a null one is named "null". Long texts are whole in one segment. Other
    columns are left aside; without documents there are no rows, without items
    no matches. ``near_items`` are items without an exact match of which a window
    has ``near_share`` of its words within ``slop`` of their places, seen from one of its rarest words.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = tests.select("item_id", F.col("text").cast("string").alias("text"))
    index, parts = cut(build_index(docs), "index"), []
    for block in _blocks(tests, block_bytes):
        items = Items([tuple(r) for r in block.collect()], window)  # bounded: block_bytes of text at most
        items.choose(corpus_counts(index, items.vocabulary), near_share)
        if len(items.exact[1]) or len(items.near[1]):
            parts.append(search(index, items, slop, near_share, not parts))
    out = parts[0] if parts else search(index, None)
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("segment", "row", "doc_id", "n_words").agg(*map(merged, ("hits", "items", "near_items")))
        out = out.withColumn("near_items", F.array_except("near_items", "items"))
    n_hit = F.size("hits").cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "items",
        "near_items",
        F.col("hits").alias("hit_places"),
    )
