import hashlib
import random
import re

from tests.llm import fixtures
from tagweave.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(rows, tests, window=10):
    wins = {}
    for item, t in tests:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item) if item is not None else "null")
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w, hit, items = words(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = wins.get(tuple(w[i : i + k]))
                if got:
                    hit |= set(range(i, i + k))
                    items |= got
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    r = random.Random(3)
    rows = [(x[0], x[1]) for x in fixtures.rows()]
    long_ = [t for _, t in rows if t and len(words(t)) > 40]
    tests = [(i, " ".join(words(t)[a : a + n])) for i, (t, a, n) in enumerate((r.choice(long_), r.randint(0, 20), r.randint(3, 30)) for _ in range(25))]
    tests += [(100, None), (101, "--"), (102, "z" * 3000), (103, "Gamma; ALPHA!"), (5, tests[5][1]), (7, tests[8][1]), (None, "béta mu")]
    rows += [(9000, tests[0][1] + " " + tests[0][1]), (9001, tests[1][1].upper().replace(" ", " -- "))]
    return rows, tests


def frames(spark, rows, tests):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string").repartition(3)
    return docs, spark.createDataFrame(tests, "item_id long, text string")


def answer(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


def test_matches_brute_force(spark, monkeypatch):
    rows, tests = case()
    docs, items = frames(spark, rows, tests)
    want = slow(rows, tests)
    assert answer(decontam.contamination(docs, items)) == want
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 50)
    assert answer(decontam.contamination(docs, items, block_bytes=900)) == want


def test_whole_table(spark, sf01):
    docs, tests = (spark.read.parquet(f"{sf01}/{n}.parquet") for n in ("documents", "benchmark"))
    got = answer(decontam.contamination(docs, tests))
    assert got == slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in tests.collect()])
    assert any(r[5] for r in got)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    near = "one two three four um five six seven eight well nine ten eleven twelve"
    docs = spark.createDataFrame([(1, near), (2, item), (3, "two nine one")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1].items == [] and got[1].near_items == ["7"]
    assert got[2].items == ["7"] and got[2].near_items == []
    assert got[3].items == [] and got[3].near_items == []


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert decontam.contamination(fixtures.empty(spark), items).collect() == []
    assert answer(decontam.contamination(docs, items.where("item_id < 0")))[0][2:4] == (0, 0)


def test_one_index_serves_blocks_and_unrelated_tests(spark, tmp_path):
    """The index knows no test set; a block without a word of the corpus isn't searched at all."""
    rows, tests = case()
    docs, items = frames(spark, rows, tests)
    index = decontam.build_index(docs.select("doc_id", "text"), 60)
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    strange = decontam.Items([(i, " ".join(f"none{i}x{k}" for k in range(40))) for i in range(50)])
    strange.choose(decontam.corpus_counts(index, strange.vocabulary), 0.8)
    assert not len(strange.exact[1]) and not len(strange.near[1])
    known = decontam.Items(tests)
    counts = decontam.corpus_counts(index, known.vocabulary)
    every = [w for _, t in rows for w in words(t)]
    assert {w.decode(): int(counts[i]) for w, i in known.vocabulary.items()} == {w.decode(): every.count(w.decode()) for w in known.vocabulary}
    known.choose(counts, 0.8)
    got = decontam.search(index, known).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, len(r.hits)) for r in got) == sorted((x[0] or 0, x[2]) for x in slow(rows, tests))


def test_lost_words_do_not_hide_a_near_match(spark):
    """Two words of each window may be missing, the rarest ones too."""
    item = " ".join(f"common{k}" for k in range(11))
    near = item.replace("common5", "other").replace("common2", "another")
    filler = " ".join(f"common{k}" for k in range(11) if k not in (2, 5)) + " x "
    docs = spark.createDataFrame([(1, near), (2, filler * 5 + " common2 y common5")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1].items == [] and got[1].near_items == ["7"]
