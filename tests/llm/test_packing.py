import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import fixtures
from tagweave.llm import packing
from tagweave.llm.queries import tokenizer_path

PATH = tokenizer_path()
TOK = Tokenizer.from_file(PATH)


def plain(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers():
    odd = ["it's <|endoftext|> fine", "naïve ÀÉß×÷ªº", "a_b-c (d) 've", "１２ ٣ x²", "é é", "\x1c\x1d a\x85b", "İstanbul ǅ", "co-op're", "!!!###'s", "<<a>>", "ñ'll 12'34", "🙂 ok"]
    for memory in (400_000, 3):
        ids = packing.Ids(PATH, 0, memory)
        for some in (fixtures.texts(), odd, odd + fixtures.texts(9)):
            assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(some)] == [plain(t) for t in some]


def test_fit_finds_an_exact_cover():
    size = 64
    h = np.zeros(size + 1, np.int64)
    h[40], h[24], h[20], h[22] = 1000, 400, 600, 0
    h[4] = 600
    p = packing.plan(h, size)
    assert p["n"] == 1000


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_is_close_to_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum((r.lognormal(5.5, 1.1, 20000)).astype(int) + 1, 2048)
    h = np.bincount(lengths, minlength=2049)
    p = packing.plan(h)
    bound = -(-int(lengths.sum()) // 2048)
    assert bound <= p["n"] <= 1.004 * bound + 2


def one_by_one(histogram, size):
    """Sequences that best fit by single pieces opens."""
    rooms = []
    for length in range(size, 0, -1):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else size) - length)
    return len(rooms)


@pytest.mark.parametrize("heavy, n", [({700: 1000, 100: 3000}, 500), ({1500: 400, 1: 50000}, 400), ({1100: 90, 300: 270, 7: 40}, 90)])
def test_few_heavy_lengths(heavy, n):
    h = np.zeros(2049, np.int64)
    h[list(heavy)] = list(heavy.values())
    p = packing.plan(h)
    assert p["n"] == n
    assert sum(k for _, k in packing.best_fit(h, 2048)) == n


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_piece_by_piece(seed):
    r = np.random.default_rng(seed)
    h = np.zeros(65, np.int64)
    h[r.choice(np.arange(1, 65), 6, replace=False)] = r.integers(1, 60, 6)
    fills = packing.best_fit(h, 64)
    assert sum(k for _, k in fills) == one_by_one(h, 64)
    assert all(sum(fill) <= 64 for fill, _ in fills)
    used = np.bincount([x for fill, k in fills for x in fill * k], minlength=65)
    assert (used == h).all()


def check(rows, docs, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, piece, start, length, crc, seq, offset in rows:
        by_doc[d].append((piece, start, length, crc))
        by_seq[seq].append((offset, length))
    for d, text in docs:
        ids = plain(text)
        want = [(k, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), size))]
        assert sorted(set(by_doc[d])) == want
    for s in by_seq.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s[:-1])]).tolist()
        assert sum(n for _, n in s) <= size
    return len(by_seq)


def test_pieces_and_places(spark):
    docs = fixtures.docs(spark)
    got = [tuple(r) for r in packing.pack_documents(docs, PATH, size=256).collect()]
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    n = check(got, rows, 256)
    assert sum(r[3] for r in got) == sum(len(plain(t)) for _, t in rows)
    assert n <= 1.1 * sum(r[3] for r in got) / 256 + 1


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in packing.pack_documents(docs, PATH).collect()]
    n = check(got, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= sum(r[3] for r in got) / 2048 * 1.05 + 1


def test_empty(spark):
    assert packing.pack_documents(fixtures.empty(spark), PATH).collect() == []


def test_any_tokenizer_file_is_honoured(tmp_path):
    """Cased words, another pre-tokenizer, and bytes: the ids are those of the file itself."""
    import public_tokenizers
    from tokenizers import AddedToken, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"?": 0, "The": 1, "the": 2, "cat": 3, ".": 4, "Cat.": 5}, unk_token="?"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "words.json"))
    blanks = Tokenizer(models.WordLevel({"?": 0, "The": 1, "Cat.": 2}, unk_token="?"))
    blanks.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    blanks.save(str(tmp_path / "blanks.json"))
    more = Tokenizer.from_file(PATH)
    more.add_tokens([AddedToken("cat food", normalized=False)])
    more.save(str(tmp_path / "more.json"))
    texts = ["The cat. The Cat.", None, "", "the cat food", "It's 12 <|endoftext|>", *fixtures.texts()[:40]]
    for path in (tmp_path / "words.json", tmp_path / "blanks.json", tmp_path / "more.json", public_tokenizers.path("byte_bpe_50k.json")):
        tok, ids = Tokenizer.from_file(str(path)), packing.Ids(str(path), 7)
        assert not ids.by_words
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == [[*tok.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert packing.Ids(PATH).by_words
