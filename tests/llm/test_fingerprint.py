import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import fixtures
from tagweave.llm import fingerprint as fp
from tagweave.llm.common import words_of


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(text, size=5):
    """Chained XXH64 of each shingle's words, by another library."""
    w = [x.decode() for x in words_of((text or "").lower())]
    out = []
    for i in range(max(1, len(w) - size + 1) if w else 0):
        h = 42
        for x in w[i : i + size]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        out.append(signed(h))
    return out


def plain_sketch(text, k=128):
    return sorted(set(hashes(text)))[:k]


def plain_resemblance(a, b, k=128):
    u = sorted({*a, *b})[:k]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def expected(rows, k=128):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (2**63 - 1 if r[0] is None else ~r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42)), r[1]))
    out = []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, new, other = (plain_sketch(x, k) for x in (t, edited, after))
        out.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x % 2**64:016x}" for x in own), "".join(f"{x % 2**64:016x}" for x in new),
             round(plain_resemblance(own, new, k), 9), round(plain_resemblance(own, other, k), 9))
        )
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=repr)


@pytest.mark.parametrize("seed", [5, 6])
def test_every_row_is_that_of_plain_code(spark, seed):
    docs = fixtures.docs(spark, seed)
    assert got(fp.fingerprints(docs)) == expected([(r[0], r[1]) for r in fixtures.rows(seed)])


def test_few_rows_and_ranges(spark):
    for texts in ([], ["one"], ["a b c", ""], [f"w{i} x y z v u" for i in range(70)]):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(fp.fingerprints(df)) == (expected(rows) if rows else [])


def test_one_id_for_all_and_extreme_ids(spark):
    rows = [(7, f"text number {i} of many here") for i in range(150)] + [(-(2**63), "least"), (2**63 - 1, "most"), (None, "none")]
    assert got(fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == expected(rows)


def test_texts_are_shuffled_once_and_no_window_spans_the_table(spark, sf01):
    plan = fp.fingerprints(spark.read.parquet(f"{sf01}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and "SinglePartition" not in plan and "Python" not in plan and "Arrow" not in plan


def test_parts_merge_into_the_whole(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(400)}" for _ in range(6000)]
    parts = [" ".join(words[max(0, i - 4) : i + 500]) for i in range(0, 6000, 500)]
    df = spark.createDataFrame([("g", p) for p in parts] + [("g", parts[0]), ("empty", ""), ("none", None), (None, parts[1])], "g string, text string").repartition(6)
    merged = {r.g: r.s for r in fp.merge_groups(df.select("g", fp.sketch(F.col("text")).alias("s")), "g", "s").collect()}
    assert merged["g"] == plain_sketch(" ".join(words)) and merged["empty"] == merged["none"] == [] and merged[None] == plain_sketch(parts[1])
    pair = spark.createDataFrame([(plain_sketch(parts[0]), plain_sketch(parts[1]))], "a array<long>, b array<long>")
    assert pair.select(fp.merge(F.col("a"), F.col("b"))).first()[0] == plain_sketch(" ".join(words[:1000]))


def test_estimates_come_near_the_truth(spark):
    r = random.Random(2)
    rows, truth = [], []
    for overlap in (0, 300, 1500, 2900):
        a = [r.getrandbits(40) for _ in range(3000)]
        b = a[:overlap] + [r.getrandbits(40) for _ in range(3000 - overlap)]
        x, y = (" ".join(map(str, w)) for w in (a, b + b[:100]))
        rows.append((x, y))
        sx, sy = set(hashes(x)), set(hashes(y))
        truth.append((len(sx & sy) / len(sx | sy), len(sx & sy) / len(sx), len(sy)))
    df = spark.createDataFrame(rows, "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    out = df.select(fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.distinct_shingles(F.col("b")))
    for (j, c, n), (tj, tc, tn) in zip(out.collect(), truth):
        assert abs(j - tj) < 0.13 and abs(c - tc) < 0.2 and abs(n / tn - 1) < 0.3


def test_strings_hold_the_sketch(spark):
    s = plain_sketch(fixtures.words(random.Random(3), 300))
    df = spark.createDataFrame([(s,), ([],)], "s array<long>")
    assert [r[0] for r in df.select(fp.from_text(fp.as_text(F.col("s")))).collect()] == [s, []]
