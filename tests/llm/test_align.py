import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import fixtures
from tagweave.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
BYTES = align.byte_alphabet()
ODD = [
    "a\r\nb  c", "tab\tand  two   three\n\n  four", " lead", "trail ", "  ", " ", "\n", "x\n  y\n\n\n z ", "<|endoftext|> is text <s> </s> <unk> <0x41>",
    "naïve “quotes” – dash… 漢字かな 🙂👍🏽", "no break wide　space", "under▁score", "nul\x00l", "é İ ǅ ﬁ ½", "it's we'll I'VE 12345 3.14", "x" * 300, "ÀÉ ß × ÷",
    "﻿bom", "\x85next", "a b", "don't  stop", "--- === +++ \\n", "ａｂｃ １２",
]


def one(text):
    """(A ids, B ids, groups as (A places, B places), links) by plain loops; None without tokens."""
    if not text:
        return None
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    ab = [bytes(BYTES[c] for c in TOK.id_to_token(i)) for i in a]
    bb = [bytes([int(PIECES.id_to_piece(i)[1:-1], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    if b"".join(ab) != raw or b"".join(bb) != raw:
        return None
    ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        gi, gj = [], []
        while i < len(a) and ea[i] <= end:
            gi.append(i)
            i += 1
        while j < len(b) and eb[j] <= end:
            gj.append(j)
            j += 1
        groups.append((gi, gj))
    links = [(x, y) for gi, gj in groups for x in gi for y in gj if ea[x] - len(ab[x]) < eb[y] and eb[y] - len(bb[y]) < ea[x]]
    return a, b, groups, links


def expected(rows):
    made = [(i, one(t)) for i, t in rows]
    count = Counter((m[0][x], m[1][y]) for _, m in made if m for x, y in m[3])
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for i, m in made:
        if m is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = m
        pairs = [(a[x], b[y]) for x, y in links]
        text = ";".join(",".join(str(a[x]) for x in g) + "|" + ",".join(str(b[y]) for y in h) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize("broadcast_rows, memory", [(1_000_000, 600_000), (0, 50)])
def test_every_row_is_that_of_plain_code(spark, broadcast_rows, memory):
    rows = [(r[0], r[1]) for r in fixtures.rows()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, codes int").repartition(4)
    assert got(align.align_tokenizers(df, A, B, memory=memory, broadcast_rows=broadcast_rows)) == expected(rows)


def test_an_empty_table(spark):
    assert got(align.align_tokenizers(fixtures.empty(spark), A, B)) == []


def test_ids_are_the_tokenizers():
    own = align.Aligner(A, B)
    assert own.by_words and own.a.fast is not None
    texts = [t for t in [*fixtures.texts(), *ODD] if t]
    for memory in (600_000, 20):
        own.memory = memory
        for text, (sizes, groups, codes) in zip(texts, own.texts(texts)):
            want = one(text)
            if want is None:
                assert list(sizes) == [0, 0, 0] and groups == "" and not len(codes)
            else:
                a = [int(x) for g in groups.split(";") for x in g.split("|")[0].split(",")]
                b = [int(x) for g in groups.split(";") for x in g.split("|")[1].split(",")]
                assert (a, b) == (want[0], want[1]) and list(sizes) == [len(a), len(b), len(want[2])], text[:50]
                assert Counter(codes.tolist()) == Counter(want[0][x] << 32 | want[1][y] for x, y in want[3])


def test_texts_are_aligned_whole_where_words_cannot_be():
    own = align.Aligner(A, B)
    own.by_words = False
    for text in ODD:
        (_, groups, codes), want = own.texts([text])[0], one(text)
        assert (groups == "") == (want is None)
        if want:
            assert len(codes) == len(want[3]) and groups.count(";") + 1 == len(want[2])


def test_union_find_by_chance():
    r = np.random.default_rng(3)
    for _ in range(30):
        n, m = int(r.integers(1, 60)), int(r.integers(0, 80))
        x, y = r.integers(0, n, m), r.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for i, j in zip(x, y):
                label[i] = label[j] = min(label[i], label[j])
        assert align.union_find(n, x, y).tolist() == label


def test_counts_are_summed_before_they_are_shuffled(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = align.pair_counts(align.aligned(docs.select("doc_id", "text"), A, B))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_sum", plan)
