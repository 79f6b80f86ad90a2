"""Sequence packing by patterns, fitted to the histogram of lengths.

Tokenising turns documents into pieces of at most ``size`` tokens; only their
lengths, digests and places travel on. The histogram of lengths has ``size``
entries at most, however many documents there are. From it:

1. patterns are enumerated: up to three lengths that fill a sequence exactly;
2. non-negative least squares fits how often each is repeated so that the
   lengths used add up to the histogram (projected accelerated gradient steps);
3. counts are rounded down, and within the histogram;
4. what is left is packed by best fit on the histogram, longest first.

Each piece then finds its place from its rank among those of its length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import cut, small_batches

SIZE = 2048
#: Distinct words whose ids a worker remembers.
MEMORY = 400_000
#: Steps of the fit; residual packing takes what they leave.
STEPS = 250

# Characters whose splitting is the same whatever Unicode version: ASCII without ' and < (contractions and special
# tokens), and the letters of Latin-1. A text of these alone is split here into the pre-tokens that the tokenizer
# would make; each distinct one is given to the tokenizer once.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:;=-@\[-`{-~"
_UNSAFE = re.compile(f"[^{_LETTERS}0-9{_MARKS} \\t\\n\\r\\f\\v]")
_SPLIT = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


# The steps of a tokenizer file that the splitting above repeats. Texts for any other file are encoded as they are.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_alike(spec: dict) -> bool:
    """Whether the splitting above is that of a tokenizer file; tokens that are looked for before it have to hold ``<`` or ``'``."""
    added = all(_UNSAFE.search(t["content"]) for t in spec.get("added_tokens") or [])
    return spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER and added and spec["model"]["type"] == "BPE"


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, by ``tokenizers``, remembering distinct words where the file allows it."""

    def __init__(self, path: str, end_id: int = 0, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_alike(json.load(f))
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memory = memory
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for word, i in vocabulary.items():
            self.closes[i] = word.endswith("</w>")
        # words are told apart by the ids that close one; without such ids each word is encoded by itself
        self.marked = self.by_words and bool(self.closes.any()) and self.tok.model.end_of_word_suffix == "</w>"

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.memory:
            self.old, self.known = self.known, {}
        todo = []
        for w in words:
            got = self.old.get(w)
            if got is None:
                todo.append(w)
            else:
                self.known[w] = got
        for at in range(0, len(todo), 2000):
            some = todo[at : at + 2000]
            if self.marked:
                ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(some) and (not len(ends) or ends[-1] == len(ids)):
                    raw = ids.tobytes()
                    for w, a, z in zip(some, [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist()):
                        self.known[w] = raw[a:z]
                    continue
            for w, e in zip(some, self.tok.encode_batch(some, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, then the end id."""
        if not self.by_words:
            got = self.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() + self.end for e in got]
        split = [None if t and _UNSAFE.search(t) else _SPLIT.findall((t or "").lower()) for t in texts]
        missing = set().union(*(s for s in split if s)) - self.known.keys()
        if missing:
            before = len(self.known)
            self.learn(sorted(missing))
            if len(self.known) < before:  # forgotten words of this batch come back
                self.learn(sorted(set().union(*(s for s in split if s)) - self.known.keys()))
        out, get = [], self.known.__getitem__
        for text, words in zip(texts, split):
            if words is None:
                out.append(self._unusual(text) + self.end)
            else:
                out.append(b"".join(map(get, words)) + self.end)
        return out

    def _unusual(self, text: str) -> bytes:
        """White space always ends a word, so a text with other characters is encoded by parts between ASCII blanks."""
        parts = [p for p in re.split("[ \t\n\r\f\v]+", text) if p]
        usual = [None if _UNSAFE.search(p) else _SPLIT.findall(p.lower()) for p in parts]
        need = set().union(*(u for u in usual if u)) - self.known.keys()
        if need:
            held = {}
            self.learn(sorted(need))
            held.update(self.known)
            get = lambda w: held[w] if w in held else np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            get = self.known.__getitem__
        odd = iter(self.tok.encode_batch([p for p, u in zip(parts, usual) if u is None], add_special_tokens=False))
        return b"".join(np.array(next(odd).ids, "<u4").tobytes() if u is None else b"".join(map(get, u)) for u in usual)


_IDS: dict[tuple[str, int], Ids] = {}


def ids_of(path: str, end_id: int) -> Ids:
    """One for each worker process, so that tasks use the tokenizer and the words that the ones before them loaded."""
    if (path, end_id) not in _IDS:
        _IDS.clear()
        _IDS[path, end_id] = Ids(path, end_id)
    return _IDS[path, end_id]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part long, rank long"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """PIECES of (doc_id, text): ``part`` and ``rank`` number the pieces of one length within a task."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, ids = TaskContext.get().partitionId(), ids_of(path, end_id)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist())):
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    own = raw[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in PIECES.split(", ")]
            )

    return docs.mapInArrow(run, PIECES)


def enumerate_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), longest first, that add up to ``size``; the lengths that occur only.

    There are about ``size`` squared / 12 of them at most, all are fitted.
    """
    has = np.zeros(size + 1, bool)
    has[lengths] = True
    lengths = np.flatnonzero(has)
    lengths = lengths[lengths > 0]
    out = [np.array([[size, 0, 0]])] if has[size] else []
    two = lengths[(lengths * 2 >= size) & (lengths < size)]
    two = two[has[size - two]]
    out.append(np.stack([two, size - two, np.zeros_like(two)], 1))
    triples = []
    for c in lengths[::-1]:
        b = lengths[(lengths >= c) & (lengths * 2 <= size - c)]
        a = size - c - b
        ok = (a > 0) & has[np.maximum(a, 0)]
        triples.append(np.stack([a[ok], b[ok], np.full(int(ok.sum()), c)], 1))
    return np.concatenate([*out, *triples]).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - histogram|^2, A the uses of each length by each pattern."""
    size = len(histogram)
    flat = patterns.ravel()
    weight = (flat > 0).astype(float)

    def uses(x):
        return np.bincount(flat, np.repeat(x, patterns.shape[1]) * weight, size)

    def back(r):
        return (r[flat] * weight).reshape(patterns.shape).sum(1)

    # columns are scaled by the uses of their lengths: short lengths are in many patterns
    scale = 1 / np.sqrt(np.maximum(back(np.bincount(flat, weight, size)), 1))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = scale * back(uses(scale * v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    step = 1 / (1.05 * norm) if norm else 1
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * scale * back(uses(scale * y) - histogram), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def round_down(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats within the histogram, largest first, and the lengths that are left."""
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(x), np.int64)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.3:
            break
        own, n = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        r = min(int(np.floor(x[i] + 0.7)), int((left[own] // n).min()))
        if r > 0:
            repeats[i] = r
            left[own] -= r * n
    # then whatever exact fillings the rest still allows
    for i in np.argsort(-patterns.max(1, initial=0), kind="stable") if len(patterns) else []:
        own = patterns[i][patterns[i] > 0]
        if (left[own] > 0).all():
            own, n = np.unique(own, return_counts=True)
            r = int((left[own] // n).min())
            repeats[i] += r
            left[own] -= r * n
    return repeats, left


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): longest first, each into the fullest sequences that still have room."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        for room in sorted(r for r in open_ if r >= length):
            if not n:
                break
            for fill in list(open_[room]):
                # a sequence that took one piece is the fullest now, so it takes as many as fit
                while n and open_[room].get(fill):
                    per = min(room // length, n)
                    take = min(n // per, open_[room][fill])
                    open_[room][fill] -= take
                    if not open_[room][fill]:
                        del open_[room][fill]
                    new = open_.setdefault(room - per * length, {})
                    more = fill + (length,) * per
                    new[more] = new.get(more, 0) + take
                    n -= take * per
                if not n:
                    break
            if not open_[room]:
                del open_[room]
        while n:  # new sequences take as many of this length as fit
            per = min(size // length, n)
            many = n // per
            fill = (length,) * per
            new = open_.setdefault(size - per * length, {})
            new[fill] = new.get(fill, 0) + many
            n -= many * per
    return [(fill, k) for fills in open_.values() for fill, k in fills.items()]


def plan(histogram: np.ndarray, size: int = SIZE) -> dict[str, np.ndarray]:
    """Where pieces go by length and rank: columns length, first rank, offset, first sequence; sorted by the first two.

    Pieces of ``length`` with ranks from ``rank`` on lie at ``offset`` of
    sequences ``sequence``, ``sequence`` + 1 and so on.
    """
    lengths = np.flatnonzero(histogram)
    patterns = enumerate_patterns(lengths, size)
    repeats, left = round_down(patterns, fit_repeats(patterns, histogram), histogram) if len(patterns) else (np.zeros(0, np.int64), histogram.copy())
    used = [(tuple(p[p > 0].tolist()), int(r)) for p, r in zip(patterns[repeats > 0], repeats[repeats > 0])]
    rows, rank, sequence = [], np.zeros(size + 1, np.int64), 0
    for fill, n in [*used, *best_fit(left, size)]:
        offset = 0
        for length in fill:
            rows.append((length, rank[length], offset, sequence))
            rank[length] += n
            offset += length
        sequence += n
    rows = np.array(rows or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return {"length": rows[:, 0], "rank": rows[:, 1], "offset": rows[:, 2], "sequence": rows[:, 3], "n": np.int64(sequence)}


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``tokenizer`` is the path of a ``tokenizers`` file of any kind on every machine. Null
    texts are empty: one piece that holds the end id alone. Repeated rows are
    packed each; rows without an id keep a null one. Long texts are tokenised
    whole and cut into pieces of ``size``; pieces of one length tie, by task and
    order of reading. Other columns are left aside; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut_up = cut(pieces(rows, tokenizer, size, end_id), "pieces")
    counts = cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_up.join(counts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")
    )
    small_batches(spark)

    def place(batches):
        p = shared.value
        key = p["length"] << 44 | p["rank"]
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(length),
                    batch.column(4),
                    pa.array(p["sequence"][at] + rank - p["rank"][at]),
                    pa.array(p["offset"][at]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
