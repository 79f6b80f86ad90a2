"""Documents that hold the odd cases: nulls, empty and long texts, ties, copies, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fp", T.StringType()),  # clashes with names used inside
        T.StructField("shard", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


def words(r, n):
    return " ".join(r.choice(["alpha", "béta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "漢字", "mu"]) + r.choice(["", "x", "yz", "q7"]) for _ in range(n))


def texts(seed=5, n=60):
    r = random.Random(seed)
    base = [words(r, r.randint(1, 120)) for _ in range(n)]
    passage = words(r, 40)
    out = list(base)
    out += [base[0]] * 6 + [base[1] + " end"] * 3  # copies
    out += [b[: len(b) // 2] + " " + passage + " " + b[len(b) // 2 :] for b in base[10:18]]  # a shared passage
    out += [b.replace("alpha", "omega", 1) for b in base[20:26]]  # near copies
    out += [None, "", "   \n ", "a", "aaaa " * 400, "z" * 3000, "z" * 2990, words(r, 6000), "A.B", "don't stop <|endoftext|> it's 3ª × ²"]
    r.shuffle(out)
    return out


def rows(seed=5):
    out = [(i * 3 + 1, t, "en", "src0", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts(seed))]
    out.append(out[4])  # a repeated row
    out.append((None, out[7][1], None, None, None, None, None, None, None, None, None))
    return out


def docs(spark, seed=5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
