"""Document quality by gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage of the whole
text is described by the mean of learned embeddings of its hashed words, pairs of
words, and first and last three bytes of words, and by counts of its bytes and
words; a tanh layer encodes it, and gated attention (Ilse et al. 2018) weights
it: weights come from w . (tanh(V h) * sigmoid(U h)), learned from document
labels alone. The weighted mean of the encodings is scored by a logistic layer.

Fitting happens on a bounded sample of labelled documents (at most
``TRAIN_DOCS``, of ``TRAIN_BYTES`` of text), each with all its passages; scoring
reads every passage of every document and shuffles nothing.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import cut, drop, small_batches

PASSAGE = 64
TRAIN_DOCS, TRAIN_BYTES = 6000, 32 << 20
THRESHOLD = 0.7
#: Rows of the embedding table, numbers in one, and n-grams of a word: itself, with the next one, first and last three bytes.
ROWS, WIDTH, GRAMS = 1 << 13, 12, 4
#: Passages in one step of the fit.
STEP_PASSAGES = 4096
_KINDS = {
    "blank": b" \t\r\x0b\x0c", "line": b"\n", "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "stop": b".;:",
    "comma": b",", "shout": b"!?", "sign": b"#$%&*@^~+=<>\\_", "bar": b"|/[]{}()", "quote": b"'\"-`",
}
_CLASS = np.zeros(256, np.int64)  # 0: letters and all other bytes
for _i, _name in enumerate(_KINDS, 1):
    _CLASS[list(_KINDS[_name])] = _i
_N = len(_KINDS) + 1
N_FEATURES = _N + 11


class Bag(NamedTuple):
    """Passages of one document: counts, rows of the embedding table of each word, and words of each passage."""

    x: np.ndarray
    grams: np.ndarray = np.zeros((0, GRAMS), np.uint16)
    words: np.ndarray | None = None


def passages(text: str | None) -> Bag:
    """One row of features for each passage; a text without words has one row of zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return Bag(np.zeros((1, N_FEATURES), np.float32), words=np.zeros(1, np.int64))
    count = -(-n // PASSAGE)
    flat = np.frombuffer(raw, np.uint8)
    kind = _CLASS[flat]
    blank = (kind == 1) | (kind == 2)
    starts = ~blank
    starts[1:] &= blank[:-1]
    own = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    bytes_ = np.bincount(own * _N + kind, minlength=count * _N)[: count * _N].reshape(count, _N).astype(np.float32)
    size = np.fromiter(map(len, words), np.float32, n)
    code = np.fromiter(map(zlib.crc32, words), np.int64, n)
    at = np.arange(0, n, PASSAGE)
    per = np.diff(np.append(at, n)).astype(np.float32)
    same = [np.add.reduceat(np.append(code[k:] == code[:-k], np.zeros(min(k, n), bool))[:n].astype(np.float32), at) for k in (1, 2)]
    grid = np.arange(count * PASSAGE, dtype=np.int64)  # the last passage is filled up with numbers of their own
    grid[:n] = code
    grid = np.sort(grid.reshape(count, PASSAGE), 1)
    distinct = 1 + (grid[:, 1:] != grid[:, :-1]).sum(1) - (PASSAGE - per)
    mean = np.add.reduceat(size, at) / per
    total = bytes_.sum(1)
    more = [
        same[0] / per, same[1] / per, distinct / per, mean / 8, np.add.reduceat((size <= 3).astype(np.float32), at) / per,
        np.add.reduceat((size >= 12).astype(np.float32), at) / per, np.sqrt(np.maximum(np.add.reduceat(size * size, at) / per - mean * mean, 0)) / 6,
        np.log1p(per) / 4, np.full(count, np.log1p(n) / 8), np.arange(count) / max(count - 1, 1), np.sqrt(bytes_[:, 2] / per),
    ]
    x = np.concatenate([np.sqrt(bytes_ / total[:, None]), np.stack(more, 1)], 1).astype(np.float32)
    begin, end = np.flatnonzero(starts), np.flatnonzero(~blank & np.append(blank[1:], True))
    flat = np.concatenate([flat, np.zeros(2, np.uint8)]).astype(np.int64)
    head = flat[begin] << 16 | np.where(size > 1, flat[begin + 1], 0) << 8 | np.where(size > 2, flat[begin + 2], 0)
    tail = flat[end] << 16 | np.where(size > 1, flat[end - 1], 0) << 8 | np.where(size > 2, flat[end - 2], 0)
    grams = np.stack([code, code + 7 * np.append(code[1:], 0), head + (1 << 40), tail + (2 << 40)], 1)
    grams = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ROWS.bit_length() + 1)
    return Bag(x, grams.astype(np.uint16), per.astype(np.int64))


class AttentionModel:
    """Embeddings, encoder, gated attention and score; plain arrays, so that it can be broadcast."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "T": (r.standard_normal((ROWS, WIDTH)) * 0.1).astype(np.float32), "E": init(N_FEATURES + WIDTH, hidden), "e": np.zeros(hidden, np.float32),
            "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0], "c": init(hidden, 1)[:, 0], "b": np.zeros(1, np.float32),
        }
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.constant: float | None = None

    def _joined(self, bags: list[Bag]):
        """Inputs of all passages, first passage of each bag, all grams, words of each passage."""
        grams = np.concatenate([b.grams for b in bags])
        words = np.concatenate([np.zeros(len(b.x), np.int64) if b.words is None else b.words for b in bags])
        lexical = np.zeros((len(words), WIDTH), self.p["T"].dtype)
        has = words > 0
        if len(grams):
            each = self.p["T"][grams[:, 0]]
            for k in range(1, GRAMS):
                each += self.p["T"][grams[:, k]]
            first = np.cumsum(words[has]) - words[has]
            lexical[has] = np.add.reduceat(each, first, axis=0) / words[has][:, None] ** 0.5
        x = np.concatenate([(np.concatenate([b.x for b in bags]) - self.mean) * self.scale, lexical], 1)
        return x, np.cumsum([0, *(len(b.x) for b in bags[:-1])]), grams, words

    def _forward(self, x, at):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        n = np.diff(np.append(at, len(x)))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
        a /= np.repeat(np.add.reduceat(a, at), n)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return h, v, u, a, z, n, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def fit(self, bags: list[Bag], labels: np.ndarray, steps: int = 250, batch: int = 192, rate: float = 0.01):
        if not len(bags) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(bags) else 0.5
            return self
        every = np.concatenate([b.x for b in bags])
        self.mean, self.scale = every.mean(0), 1 / (every.std(0) + 1e-3)
        size = np.array([len(b.x) for b in bags])
        r, m, q = np.random.default_rng(11), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(bags), batch)
            # whole bags, as many as a step may hold, one at least
            pick = pick[: max(1, int(np.searchsorted(np.cumsum(size[pick]), STEP_PASSAGES, "right")))]
            y = labels[pick].astype(np.float32)
            x, at, grams, words = self._joined([bags[i] for i in pick])
            h, v, u, a, z, n, out = self._forward(x, at)
            d = (out - y) / len(pick)
            p, g = self.p, {}
            g["c"], g["b"] = z.T @ d, np.array([d.sum()])
            dz = np.repeat(d[:, None] * p["c"], n, axis=0)
            da = (dz * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
            dvu = ds[:, None] * p["w"]
            g["w"] = (v * u).T @ ds
            dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
            g["V"], g["U"] = h.T @ dv, h.T @ du
            dh = (dz * a[:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            g["E"], g["e"] = x.T @ dh, dh.sum(0)
            dt = (dh @ p["E"][N_FEATURES:].T) / np.maximum(words, 1)[:, None] ** 0.5
            own = np.repeat(np.arange(len(words)), words)
            g["T"] = np.zeros((ROWS, WIDTH), np.float32)
            if len(grams):
                for j in range(WIDTH):
                    g["T"][:, j] = np.bincount(grams.ravel(), np.repeat(dt[own, j], GRAMS), ROWS)
            lr = rate * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
            for k in p:
                grad = g[k] + (1e-4 if k == "T" else 1e-5) * p[k]
                m[k], q[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * q[k] + 0.01 * grad * grad
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def exact(self) -> AttentionModel:
        """The same model in double precision, for scores that don't depend on what else is in a batch."""
        self.p = {k: v.astype(float) for k, v in self.p.items()}
        self.mean, self.scale = self.mean.astype(float), self.scale.astype(float)
        return self

    def score(self, bags: list[Bag]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        out, at = [], 0
        size = np.cumsum([0, *(len(b.x) for b in bags)])
        while at < len(bags):  # whole bags, of a bounded number of passages
            upto = max(at + 1, int(np.searchsorted(size, size[at] + STEP_PASSAGES, "right")) - 1)
            x, first, _, _ = self._joined(bags[at:upto])
            out.append(self._forward(x, first)[-1])
            at = upto
        # the last digits would depend on the batch
        return np.round(np.concatenate(out).astype(float), 6) if out else np.zeros(0)


def held_out(id_col) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS
) -> AttentionModel:
    """Fit on at most ``train_docs`` labelled documents that aren't held out, chosen by a hash of their ids.

    Of these, as many as have ``TRAIN_BYTES`` of features together. Labels that
    are null or without an id are left aside; an id with several labels has the
    largest, one with several texts the least. Without labels, or with equal
    ones, the score is a constant.
    """
    small_batches(docs.sparkSession)
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_docs)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most train_docs rows of two numbers are broadcast; an id that repeats is learned once, with its least text
    rows = rows.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches):
        for batch in batches:
            bags = [passages(t) for t in batch.column(1).to_pylist()]
            parts = [pa.array([p.tobytes() for p in x], pa.binary()) for x in zip(*bags)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *parts], ["doc_id", "label", "x", "grams", "words"])

    kept = cut(rows.mapInArrow(run, "doc_id long, label int, x binary, grams binary, words binary"), "bags")
    turn = F.xxhash64("doc_id")
    sizes = kept.select(turn.alias("turn"), (F.octet_length("grams") + F.octet_length("x")).alias("n")).collect()  # at most train_docs
    total, last = 0, None
    for turn_, n in sorted((r["turn"], r["n"]) for r in sizes):
        total += n
        if total > TRAIN_BYTES and last is not None:
            break
        last = turn_
    got = kept.where(turn <= F.lit(last)).collect() if last is not None else []
    drop(kept)
    got = sorted(got, key=lambda r: r["doc_id"])
    read = lambda r: Bag(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["grams"], np.uint16).reshape(-1, GRAMS), np.frombuffer(r["words"], np.int64))
    return AttentionModel().fit([read(r) for r in got], np.array([r["label"] for r in got])).exact()


def score_quality(docs: DataFrame, model: AttentionModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, one row per input row; null texts are scored as empty.

    A column of that name in ``docs`` is an error, not overwritten.
    """
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(shared.value.score([passages(t) for t in text]))

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row: predicted is 1 from ``threshold`` on.

    Null and empty texts are scored as one passage without words, rows without
    an id are never held out, repeated rows stay repeated, whole texts count,
    other columns are left aside, and an empty table gives an empty one. Scores
    have six digits, so they don't depend on which rows share a batch.
    """
    model = fit_quality(docs, labels)
    got = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return got.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
