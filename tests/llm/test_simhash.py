import numpy as np
import xxhash

from tests.llm import fixtures
from tagweave.llm import simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, t=2):
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if bin(a ^ b).count("1") <= t:
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_counts_bits():
    for t in fixtures.texts():
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_native_hash_agrees(spark):
    h = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_anchors_cover():
    """Any two words within the threshold meet at the nearest anchor of either."""
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 400, dtype=np.uint64)
    y = x.copy()
    for k in range(2):
        y ^= np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)
    at, key, own = simhash.anchors(np.concatenate([x, y]), 2)
    everywhere = [set(key[at == i].tolist()) for i in range(800)]
    for i in range(400):
        home = key[(at == i) & own]
        assert len(home) == 1 and home[0] in everywhere[i + 400]
        back = key[(at == i + 400) & own]
        assert len(back) == 1 and back[0] in everywhere[i]


def test_groups_match_brute_force(spark):
    docs = fixtures.docs(spark)
    got = [tuple(r) for r in simhash.simhash_groups(docs).collect()]
    want_rows = fixtures.rows()
    assert len(got) == len(want_rows)
    known = {r[0]: slow_fingerprint(r[1]) for r in want_rows if r[0] is not None}
    comp = groups(list(known), list(known.values()))
    for doc, fp, c in got:
        if doc is not None:
            assert (int(fp, 16), c) == (known[doc], comp[doc])
            assert len(fp) == 16 and fp == fp.lower()


def test_chains_and_near_words(spark):
    """Fingerprints up to two bits apart, in chains, all in one hot neighbourhood."""
    r = np.random.default_rng(2)
    base = int(r.integers(0, 2**62))
    fps = {base}
    cur = base
    for _ in range(60):
        for _ in range(2):
            cur ^= 1 << int(r.integers(0, 64))
        fps.add(cur)
    fps = sorted(fps)
    ids = list(range(100, 100 + len(fps)))
    rows = [(int(np.uint64(f).view(np.int64)), i) for f, i in zip(fps, ids)]
    reps = spark.createDataFrame(rows, "fp long, rep long")
    roots = {x.node: x.root for x in simhash.near_fingerprints(reps).collect()}
    assert {i: roots.get(i, i) for i in ids} == groups(ids, fps)


def test_empty(spark):
    assert simhash.simhash_groups(fixtures.empty(spark)).collect() == []


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """a and c are three bits apart, b between them has no id; the group is still one."""
    base = 0x0123456789ABCDEF
    fps = spark.createDataFrame([(5, base), (None, base ^ 3), (3, base ^ 15), (None, base ^ (1 << 60 | 1 << 50 | 1 << 40))], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: fps)
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_groups(fps).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (None, 3), (3, 3), (None, None)], key=str)


def test_one_of_each_group(spark):
    rows = [(4, "one two three", "x"), (2, "one two three", "y"), (2, "one two three", "a"), (None, "one two three", "z"), (7, "p q r", "x")]
    rows += [(7, "other words here", "x"), (None, "lonely text", "x"), (None, None, "n"), (9, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted((tuple(r) for r in simhash.one_of_each_group(docs).collect()), key=str)
    assert got == sorted([(2, "one two three", "a"), (7, "p q r", "x"), (7, "other words here", "x"), (None, "lonely text", "x"), (9, "", "n")], key=str)
