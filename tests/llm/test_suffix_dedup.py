import hashlib
import random

import numpy as np
import pytest

from tests.llm import fixtures
from tagweave.llm import suffix_dedup as sd


def slow(rows, length=50):
    first = {}
    key = lambda d: sd.LAST if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, sd.LAST), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("text", [b"banana", b"mississippi", b"aaaaaaa", b"abcabcabcabca", b"zyx", b"a", b"", b"\x00\x01\x00\x01\x02\x00", bytes(range(255, -1, -1)) * 3])
def test_two_stage_order(text):
    got = sd.two_stage_order(np.frombuffer(text, np.uint8), 300)
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_two_stage_order_of_random_bytes():
    r = np.random.default_rng(0)
    for alphabet in (2, 3, 200):
        t = r.integers(1, alphabet + 1, 900).astype(np.uint8)
        raw = t.tobytes()
        order = sd.two_stage_order(t, 50)
        assert sorted(order.tolist()) == list(range(900))
        cut = [raw[i : i + 50] for i in order]
        assert cut == sorted(cut)
        got = sd.adjacent_prefixes(raw, order, 50)
        for k in range(1, 900):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if min(len(a), len(b)) >= 50:
                assert got[k] == min(n, 50)


def test_minima_are_the_least_of_each_string():
    raw = fixtures.texts()[3].encode() * 3
    v = sd.minima(raw)
    assert len(v) == max(0, len(raw) - 49)
    for s in range(0, len(v), 7):
        assert sd.minima(raw[s : s + 50])[0] == v[s]


@pytest.mark.parametrize("block", [400, 4 << 20])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    monkeypatch.setattr(sd, "SORT_BYTES", 2000)
    got = sd.repeated_passages(fixtures.docs(spark), carry=("lang", "n_chars")).collect()
    want = slow([(r[0], r[1]) for r in fixtures.rows()])
    assert sorted([tuple(r)[:5] for r in got], key=str) == want
    assert {r.doc_id: (r.lang, r.n_chars) for r in got} == {r[0]: (r[2], r[4]) for r in fixtures.rows()}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted([tuple(r)[:5] for r in sd.repeated_passages(docs).collect()], key=str)
    assert got == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in got) > 0


def test_empty(spark):
    assert sd.repeated_passages(fixtures.empty(spark)).collect() == []


def boilerplate(n, seed=4):
    """Texts with one common line, each in its own surroundings; some runs of one byte, some copies."""
    r = random.Random(seed)
    line = "".join(r.choice("abcdefghij klmnop") for _ in range(200))
    own = lambda k: "".join(r.choice("qrstuvwxyz 0123456789") for _ in range(k))
    rows = [(i, own(r.randint(0, 90)) + line + own(r.randint(0, 90))) for i in range(n)]
    rows += [(n + 1, "a" * 700), (n + 2, "b" + "a" * 300), (n + 3, rows[3][1]), (n + 4, rows[5][1] + "tail"), (n + 5, (own(60) + "xyz") * 9), (None, rows[7][1])]
    return rows


@pytest.mark.parametrize("hot_bytes, hot_blocks, block", [(300, 2000, 700), (300, 3, 700), (300, 2000, 1 << 20), (5000, 3, 2500)])
def test_hot_minima_match_brute_force(spark, monkeypatch, hot_bytes, hot_blocks, block):
    """Strings of hot minima are dealt one by one, reduced at once or in stages; results are the same."""
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    rows = boilerplate(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sd.repeated_passages(docs, hot_bytes=hot_bytes, hot_blocks=hot_blocks)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == slow(rows)


def test_what_is_sent_does_not_grow_with_copies():
    """A block sends a hot line's inner segments once and its edges' distinct strings, however many texts hold it."""
    def sent(n):
        raw = [t.encode() for _, t in boilerplate(n)[:n]]
        return sd._Inventory(np.arange(n), np.arange(n), raw, [], 8, 50, 20_000)

    few, many = sent(400), sent(1600)
    assert (~few.is_hot).sum() < 400 and (~many.is_hot).sum() < 400  # ten a text if each sent its own
    assert len(few.strings) and len(many.strings) < 1600 * 2 * 34


def test_minima_of_long_texts_in_chunks(monkeypatch):
    raw = [("".join(t or "" for t in fixtures.texts())).encode(), b"a" * 5000, b"short"]
    want = sd._segments(raw, 50)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 137)
    for a, b in zip(sd._segments(raw, 50), want):
        assert (a == b).all()
