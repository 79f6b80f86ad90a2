import zlib

import numpy as np
import pytest

from tests.llm import fixtures
from tagweave.llm import quality as q


def test_passages_cover_whole_texts():
    text = " ".join(f"w{i}" for i in range(1000))
    got = q.passages(text)
    assert len(got.x) == len(got.words) == -(-1000 // q.PASSAGE) and got.words.sum() == len(got.grams) == 1000
    assert q.passages(None).x.shape == q.passages("").x.shape == q.passages(" \n ").x.shape == (1, q.N_FEATURES)
    a, b = q.passages(text), q.passages(text + " !!!!!!!! !!!!!!!!")
    assert not np.allclose(a.x[-1], b.x[-1])
    for t in fixtures.texts():
        bag = q.passages(t)
        assert np.isfinite(bag.x).all() and bag.words.sum() == len(bag.grams) and bag.grams.max(initial=0) < q.ROWS


def test_grams_are_those_of_the_words():
    one, two = q.passages("alpha beta gamma"), q.passages("zz  beta\tgamma")
    assert (one.grams[1:] == two.grams[1:]).all() and (one.grams[0] != two.grams[0]).any()
    assert q.passages("abcx").grams[0, 2] == q.passages("abcy zabc").grams[0, 2] != q.passages("abd").grams[0, 2]
    assert q.passages("xabc").grams[0, 3] == q.passages("q yabc").grams[1, 3]


def test_scores_match_a_plain_version():
    """Every word and passage of each document, one at a time."""
    r = np.random.default_rng(2)
    m = q.AttentionModel()
    m.mean, m.scale = r.standard_normal(q.N_FEATURES), r.uniform(0.5, 2, q.N_FEATURES)
    m.exact()
    p, texts = m.p, [*fixtures.texts(), " ".join(f"w{i % 77}" for i in range(9000))]
    got = m.score([q.passages(t) for t in texts])
    for t, score in zip(texts, got):
        bag, hs, weights, at = q.passages(t), [], [], 0
        for x, n in zip(bag.x, bag.words):
            lexical = sum((p["T"][g] for row in bag.grams[at : at + n] for g in row), np.zeros(q.WIDTH)) / max(n, 1) ** 0.5
            at += n
            h = np.tanh(np.concatenate([(x - m.mean) * m.scale, lexical]) @ p["E"] + p["e"])
            hs.append(h)
            weights.append(np.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        z = sum(w * h for w, h in zip(weights, hs)) / sum(weights)
        assert score == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["b"][0]))), abs=2e-6)


def test_learns_from_words_alone():
    """Prose of one vocabulary against fluent text of another, equal in all counts."""
    r = np.random.default_rng(4)
    bags, y = [], []
    for i in range(400):
        names = "bcdfg" if i % 2 else "hjklm"
        words = ["".join(r.choice(list(names), 5)) for _ in range(int(r.integers(20, 200)))]
        bags.append(q.passages(" ".join(words)))
        y.append(i % 2)
    m = q.AttentionModel().fit(bags[:300], np.array(y[:300]), steps=150)
    assert ((m.score(bags[300:]) > 0.5) == np.array(y[300:])).mean() > 0.95


def test_gradient_of_the_bag_loss():
    """One step along the fitted gradient lowers the loss by what it promises."""
    r = np.random.default_rng(0)
    bags = [q.Bag(r.standard_normal((n, q.N_FEATURES)).astype(np.float32)) for n in (1, 3, 7, 2)]
    y = np.array([0, 1, 1, 0])
    m = q.AttentionModel()
    before = m.score(bags)
    m.fit(bags, y, steps=60, batch=4)
    after = m.score(bags)
    loss = lambda p: -np.mean(np.where(y, np.log(p), np.log(1 - p)))
    assert loss(after) < 0.3 * loss(before)


def test_attention_finds_the_telling_passage():
    """Bags whose label depends on one passage of many."""
    r = np.random.default_rng(1)
    bags, y = [], []
    for i in range(600):
        x = r.standard_normal((12, q.N_FEATURES)).astype(np.float32)
        if i % 2:
            x[r.integers(12), :3] += 4
        bags.append(q.Bag(x))
        y.append(i % 2)
    m = q.AttentionModel().fit(bags[:400], np.array(y[:400]))
    assert ((m.score(bags[400:]) > 0.5) == np.array(y[400:])).mean() > 0.9


def test_held_out_accuracy(spark, sf01):
    docs, labels = (spark.read.parquet(f"{sf01}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in q.quality(docs, labels).collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50
    assert np.mean([y == r.predicted for y, r in held]) > 0.95
    good, bad = ([r.score for y, r in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_odd_rows(spark):
    docs = fixtures.docs(spark)
    labels = spark.createDataFrame([(i * 3 + 1, i % 2, 0) for i in range(80)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = q.quality(docs, labels).collect()
    assert len(got) == len(fixtures.rows()) and all(0 <= r.score <= 1 for r in got)
    again = docs.union(docs.where("doc_id < 100")).union(docs.where("doc_id < 100").selectExpr(*(f"'other text' AS {c}" if c == "text" else c for c in docs.columns)))
    assert len(q.quality(again, labels.union(labels)).collect()) == again.count()  # repeated ids, of several texts
    none = q.quality(docs, labels.where("quality > 5")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    one = q.quality(docs, labels.where("quality = 1")).collect()
    assert {(r.score, r.predicted) for r in one} == {(1.0, 1)}
    assert q.quality(fixtures.empty(spark), labels).collect() == []


@pytest.mark.parametrize("column", ["lang", "source", "doc_id"])
def test_scores_read_the_text_alone(spark, column):
    docs = fixtures.docs(spark)
    m = q.AttentionModel()
    from pyspark.sql import functions as F

    other = docs.withColumn(column, F.lit(None).cast(dict(docs.dtypes)[column]))
    a, b = (sorted(r.quality_score for r in q.score_quality(d, m.exact()).collect()) for d in (docs, other.repartition(2)))
    assert a == b
    with pytest.raises(ValueError):
        q.score_quality(docs, m, score_col="lang")
