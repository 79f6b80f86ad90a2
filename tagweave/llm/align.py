"""Cross-tokenizer alignment: minimal groups of overlapping tokens, their links, and how often id pairs are linked.

Two tokenizers cut the same bytes. Tokens whose byte ranges overlap are linked;
the links are a bipartite graph whose connected components, found by
union-find, are the minimal groups that cover the same bytes in both. Pairs of
ids are counted over all links of all documents by a grouped sum, and the
counts go back to the links by a join.

No token of either kind reaches across the beginning of white space, so groups
don't either, and a word with the white space before it is aligned once, not
each time it occurs. The properties of the tokenizers that this rests on are
checked when they are loaded; without them texts are aligned as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import cut, small_batches

#: Distinct words that a worker remembers (about 300 bytes each), and characters of the texts that it aligns at a time.
MEMORY, RUN_CHARS = 600_000, 1 << 19
#: Rows of pair counts that are broadcast at most (about 32 bytes a row); more are joined by shuffling.
BROADCAST_ROWS = 1_000_000

_SPACE = " \\t\\n\\r\\f\\v"
_WORD = re.compile(f"[{_SPACE}]+[^{_SPACE}]+|[{_SPACE}]+")
#: Before a word that doesn't begin with a blank; such texts hold no such character.
_MARK = "\x00"
#: White space and format characters on which libraries may differ: such texts are aligned whole.
_ODD = re.compile("[" + "".join(map(chr, (0x00, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF))) + "]")
#: Words of these characters are the same to any version of Unicode.
_USUAL = re.compile(f"[{_SPACE}!-~À-ÖØ-öø-ÿ]+")


def byte_alphabet() -> dict[str, int]:
    """Byte-level characters and their bytes: printable ones stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids by a byte-level BPE file of ``tokenizers``; usual words by ``tiktoken`` where its merges are ordered by id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocabulary = byte_alphabet(), self.slow.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for word, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        self.fast = self._ranked(spec)
        kind = spec.get("pre_tokenizer") or {}
        self.by_words = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")

    def _ranked(self, spec: dict):
        import public_tokenizers
        import tiktoken

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"].get("merges", [])]
        own = spec["model"]["vocab"]
        merged = [own.get(a + b, -1) for a, b in pairs]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {self.bytes[i]: i for w, i in own.items() if w not in special}
        plain = not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        if not plain or merged != sorted(set(merged)) or -1 in merged or not all(bytes([b]) in ranks for b in range(256)) or max(ranks[bytes([b])] for b in range(256)) > min(merged, default=256):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]

    def encode_usual(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast is not None else self.encode([text])[0]


class PieceTokens:
    """Ids by a ``sentencepiece`` model, which puts a blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece has a blank after another character, so none reaches into the blanks after it; other white space that pieces have could be reached
        whole = not any(re.search("[^▁]▁", p) for p in pieces)
        self.reached = set("\t\n\r\f\v").intersection("".join(pieces))
        try:
            probe = " a  b É"
            self.by_words = whole and b"".join(self.bytes[i] for i in self.model.encode(probe[1:])) == probe.encode() and len(self.model.encode("a")) == 1
        except (IndexError, RuntimeError):
            self.by_words = False

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def encode_after(self, text: str) -> list[int]:
        """Ids of a text that begins with white space, as they are after a word."""
        return self.model.encode("a" + text, num_threads=1)[1:]


def union_find(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges (x, y) between nodes 0 to n - 1.

    Roots are hooked under lesser roots along the edges and paths halved, until
    no edge joins two roots.
    """
    parent = np.arange(n)
    while True:
        a, b = parent[x], parent[y]
        if np.array_equal(a, b):
            return parent
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def links_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (A token, B token) of all pairs whose byte ranges overlap, in order; tokens end at these bytes, the last ones together."""
    a_start = np.concatenate([[0], a_end[:-1]])
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_end, a_end, "left") - first + 1
    at = np.repeat(np.arange(len(a_end)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Alignments of texts; remembers those of up to ``memory`` distinct words, then begins anew."""

    def __init__(self, a_path: str, b_path: str, memory: int = MEMORY):
        self.a, self.b, self.memory = ByteTokens(a_path), PieceTokens(b_path), memory
        self.a_len = np.array([len(x) for x in self.a.bytes])
        self.b_len = np.array([len(x) for x in self.b.bytes])
        names = [str(i) for i in range(max(len(self.a_len), len(self.b_len)))]
        # token ids and what follows them: within a side, after the A side, after the B side of a group
        self.names = [n + c for c in ",|;" for n in names]
        self.name_len = np.array([len(n) for n in self.names])
        self.wide = len(names)
        self.by_words = self.a.by_words and self.b.by_words
        self.odd = re.compile("|".join([_ODD.pattern, *map(re.escape, sorted(self.b.reached))]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # of each word known
        self.sizes = np.zeros((1024, 3), np.int64)  # A tokens, B tokens, groups; -1: the bytes differ
        self.at = np.zeros(1025, np.int64)  # where its links begin in codes
        self.codes = np.zeros(4096, np.int64)

    def align(self, texts: list[bytes], a_ids: list[int], b_ids: list[int]):
        """(sizes, links, codes, groups) of ``texts``, whose tokens these are, one text after the other; None if the bytes differ.

        sizes has a row (A tokens, B tokens, groups) a text, links their numbers
        of links; codes holds A id << 32 | B id of each link; groups are written
        out with a semicolon after each.
        """
        raw = b"".join(texts)
        if b"".join(map(self.a.bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b.bytes.__getitem__, b_ids)) != raw:
            return None
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        x, y = links_of(a_end, b_end)
        root = union_find(len(a) + len(b), x, y + len(a))
        # components in order of their first A token, which is their least node
        of_a, of_b = root[: len(a)], root[len(a):]
        # the order written: of each group its A tokens, then its B tokens
        written = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        written[np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")] = a + self.wide * last_a
        written[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b + 2 * self.wide * last_b
        string = "".join(map(self.names.__getitem__, written.tolist()))
        # where each text's tokens, links and letters end
        ends = np.cumsum([len(t) for t in texts])
        to_a, to_b = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
        letters = np.concatenate([[0], np.cumsum(self.name_len[written])])[to_a + to_b].tolist()
        groups = np.concatenate([[0], np.cumsum(last_a)])[to_a]
        sizes = np.diff(np.stack([to_a, to_b, groups], 1), axis=0, prepend=0)
        links = np.diff(np.searchsorted(x, to_a, "left"), prepend=0)
        return sizes, links, a[x] << 32 | b[y], [string[i:j] for i, j in zip([0, *letters], letters)]

    def remember(self, words: list[str], got) -> None:
        sizes, links, codes, groups = got
        n, m = len(self.groups), int(self.at[len(self.groups)])
        while n + len(words) > len(self.sizes):
            self.sizes, self.at = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.at, np.zeros(len(self.sizes), np.int64)])
        while m + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.sizes[n : n + len(words)], self.codes[m : m + len(codes)] = sizes, codes
        self.at[n + 1 : n + 1 + len(words)] = m + np.cumsum(links)
        self.groups += groups
        self.known.update(zip(words, range(n, n + len(words))))

    def words(self, text: str | None) -> list[str]:
        """The words of a text after a blank, each without the blank that it begins with; the whole text where it can't be divided.

        Where blanks stand alone, a word ends before each of them: a tokenizer
        that leaves the last blank of a run to the next word cuts there too.
        Else words begin with all their white space.
        """
        if not text:
            return []
        if not self.by_words or self.odd.search(text):
            return [text]
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [w[1:] if w[0] == " " else _MARK + w for w in _WORD.findall(" " + text)]

    def learn(self, words: list[str]) -> None:
        """Align words, or whole texts."""
        many, single = [], []
        for w in words:
            (many if w and w[0] not in _NO_START else single).append(w)
        if not _USUAL.fullmatch("".join(many)):
            single += [w for w in many if not _USUAL.fullmatch(w)]
            many = [w for w in many if _USUAL.fullmatch(w)]
        for at in range(0, len(many), 4000):
            some = many[at : at + 4000]
            # merging takes longer in a long text, so pieces are asked for by a few hundred words
            b = [i for k in range(0, len(some), 250) for i in self.b.encode_after(" " + " ".join(some[k : k + 250]))]
            got = self.align([b" " + w.encode() for w in some], self.a.encode_usual(" " + " ".join(some)), b)
            if got is None:
                single += some
            else:
                self.remember(some, got)
        spelt = [w[1:] if self.by_words and w[:1] == _MARK and not self.odd.search(w[1:]) else " " + w for w in single]
        for w, text, ids in zip(single, spelt, self.a.encode(spelt)):
            b = self.b.encode_after(text) if self.by_words and not self.odd.search(text) else self.b.encode([text[1:]])[0]
            got = self.align([text.encode("utf-8", "surrogatepass")], ids, b)
            self.remember([w], got or (np.full((1, 3), -1), np.zeros(1, np.int64), np.zeros(0, np.int64), [""]))

    def texts(self, texts: list[str | None]):
        """(sizes, groups, codes) of each text with a blank before it: a row (A tokens, B tokens, groups), the groups written out, the links' codes."""
        words = list(map(self.words, texts))
        every = list(itertools.chain.from_iterable(words))
        at = list(map(self.known.get, every))
        missing = {w for w, i in zip(every, at) if i is None}
        if missing:
            if len(self.known) + len(missing) > self.memory:
                self.forget()
                missing = set(every)
            self.learn(list(missing))
            at = list(map(self.known.__getitem__, every))
        own = np.array(at, np.int64)
        ends = np.cumsum([len(w) for w in words])
        first = self.at[own]
        n = self.at[own + 1] - first
        link = np.concatenate([[0], np.cumsum(n)])
        codes = self.codes[np.repeat(first - link[:-1], n) + np.arange(link[-1])]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.sizes[own], axis=0)])
        bad = np.concatenate([[0], np.cumsum(self.sizes[own, 0] < 0)])
        begin, out = 0, []
        for end in ends.tolist():
            if begin == end or bad[end] > bad[begin]:
                out.append(((0, 0, 0), "", codes[:0]))
            else:
                string = "".join(map(self.groups.__getitem__, at[begin:end]))[:-1]
                out.append(((sums[end] - sums[begin]).tolist(), string, codes[link[begin] : link[end]]))
            begin = end
        if any(len(w) == 1 and len(w[0]) > 10_000 for w in words):  # long texts that were taken whole aren't kept
            self.forget()
        return out


_NO_START = frozenset(" \t\n\r\f\v" + _MARK)
_ALIGNERS: dict = {}


def aligner(a_path: str, b_path: str, memory: int) -> Aligner:
    """One for each worker process, so that tasks use what the ones before them learnt."""
    key = (a_path, b_path, memory)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_path, b_path, memory)
    return _ALIGNERS[key]


def _runs(texts: list[str | None]):
    """Bounds of runs of texts that hold about RUN_CHARS characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= RUN_CHARS or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str, memory: int = MEMORY) -> DataFrame:
    """ALIGNED of (doc_id, text): ``codes`` are the distinct linked pairs of a document, A id << 32 | B id, and ``times`` how often each is linked."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        own, row = aligner(a_path, b_path, memory), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, every = batch.column(0), batch.column(1).to_pylist()
            for begin, end in _runs(every):
                cols: list[list] = [[], [], [], [], []]
                codes, times, ends = [], [], [0]
                for sizes, groups, links in own.texts(every[begin:end]):
                    pair, n = np.unique(links, return_counts=True)
                    codes.append(pair)
                    times.append(n.astype(np.int32))
                    ends.append(ends[-1] + len(pair))
                    for c, v in zip(cols, (*sizes, len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")):
                        c.append(v)
                ends = pa.array(ends, pa.int32())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + end - begin)), ids[begin:end], *(pa.array(c, k) for c, k in zip(cols, kinds)),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(codes))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times)))],
                    [c.split()[0] for c in ALIGNED.split(", ")],
                )
                row += end - begin

    return docs.mapInArrow(run, ALIGNED)


def _pairs(rows: DataFrame) -> DataFrame:
    """(row, code, times): a row for each distinct pair of a document."""
    return rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))


def _b_id(code: str) -> Column:
    return F.col(code).bitwiseAND(0xFFFFFFFF)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, count, best): over all documents, how many links hold each pair, and whether no pair of the same B id has more.

    Summed within tasks before the shuffle. A B id has as many pairs at most as
    there are A ids.
    """
    n = _pairs(rows).groupBy("code").agg(F.sum("times").alias("count"))
    return n.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(_b_id("code"))))


def align_tokenizers(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a document.

    A is a byte-level file of ``tokenizers``, B a ``sentencepiece`` model, both
    at these paths on every machine; A gets the text after a blank, B puts one
    there itself. ``n_best`` counts links whose pair has its B id's highest
    count in the corpus, ``count_sum`` adds up the counts of all links.

    Texts that are null or empty, or that a tokenizer doesn't give back byte by
    byte, have no tokens: zeros and an empty string. Special tokens' strings are
    plain text. Repeated rows count each, rows without an id keep a null one;
    long texts are read whole; other columns are left aside; an empty table
    gives an empty one.

    Pair counts are broadcast up to ``broadcast_rows`` rows and joined by
    shuffling beyond. A pair that nearly every document has is then one key of
    many rows, which adaptive execution divides, since it is a join alone.
    """
    rows = cut(aligned(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), a_path, b_path, memory), "aligned")
    counts = cut(pair_counts(rows), "pairs")
    few = counts.count() <= broadcast_rows
    linked = _pairs(rows).join(F.broadcast(counts) if few else counts.hint("merge"), "code")
    n = F.col("times").cast("long")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
