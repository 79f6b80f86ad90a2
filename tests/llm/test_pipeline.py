import importlib
import random

import pytest

from tests.llm import fixtures
from tests.llm.test_decontam import slow as slow_hits
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups, slow_fingerprint
from tests.llm.test_suffix_dedup import slow as slow_cut
from tagweave.llm import quality as q
from tagweave.llm.common import table

pipeline = importlib.import_module("corpus_pipeline")


def cut_text(rows):
    """Texts after the removal of repeated strings, by brute force."""
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 62), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        if kept or not b:
            out.append((d, kept.decode("utf-8", "ignore")))
    return out


def plain(spark, sf_dir, docs):
    """run() without Spark but for the classifier's fit."""
    model = q.fit_quality(docs, table(spark, sf_dir, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.score([q.passages(t) for _, t in rows])) if s >= q.THRESHOLD]
    rows = sorted(dict(rows).items())
    comp = groups([d for d, _ in rows], [slow_fingerprint(t) for _, t in rows])
    rows = cut_text([r for r in rows if comp[r[0]] == r[0]])
    tests = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {r[0] for r in slow_hits(rows, tests) if r[5]}
    return [r for r in rows if r[0] not in hit]


def test_run_matches_the_plain_version(spark, sf):
    got = [tuple(r) for r in pipeline.run(spark, sf).collect()]
    want = plain(spark, sf, table(spark, sf, "documents"))
    assert {r[0] for r in got} == {d for d, _ in want}
    check(got, want, 2048)
    assert 0 < len(want) < table(spark, sf, "documents").count()


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_stages_take_odd_rows(spark, sf, k):
    stage = pipeline.STAGES[k][1]
    docs = fixtures.docs(spark)
    out = stage(spark, docs, sf)
    if k < len(pipeline.STAGES) - 1:
        assert tuple(out.columns) == pipeline.COLUMNS
        assert [t for _, t in out.dtypes] == ["bigint", "string", "string", "string", "bigint"]
    assert out.collect()
    assert stage(spark, fixtures.empty(spark), sf).collect() == []


def test_rows_without_an_id_and_ids_of_several_texts(spark, sf):
    """No stage but the one whose rule says so drops them."""
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    bench = table(spark, sf, "benchmark").where("length(text) > 200").first().text
    rows = [(1, text()), (1, text()), (None, text()), (None, text()), (2, text() + " " + bench), (None, bench + " " + text())]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert key(stages["simhash near-dedup"](spark, docs, sf)) == sorted(rows, key=str)
    cut_rows = slow_cut(rows)
    assert sum(x[1] - x[2] for x in cut_rows) == sum(len(t.encode()) for _, t in key(stages["suffix-array dedup"](spark, docs, sf)))
    assert key(stages["benchmark decontamination"](spark, docs, sf)) == sorted(rows[:4], key=str)
    assert sorted({r.doc_id for r in stages["best-fit packing"](spark, docs, sf).collect()}, key=str) == [1, 2, None]
