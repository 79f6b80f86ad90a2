"""Repeated passages across documents by suffix sorting.

Every string of ``length`` bytes has a least 16-byte gram (by hash) among its
own; two equal strings have the same. So strings that share that minimum are
sorted together and all others never need to be:

1. Documents are packed into blocks of texts; runs of neighbouring strings with
   one minimum form a segment, and each block lists its minima.
2. Minima that occur in two places are told to their blocks (packed, by bucket
   of minima; a block lists a minimum once, however many copies it holds).
3. Blocks send the segments of those minima, packed, to buckets of minima: each
   distinct segment once a block, with the smallest and largest document that
   has it there. A bucket sorts the suffixes of its distinct segments in two
   stages: only suffixes smaller than their successor are sorted directly, the
   rest are induced by one scan over the buckets of first bytes. Common prefixes
   of neighbours then give the strings that repeat and the smallest document
   each starts in.
4. Runs of strings and their smallest documents go back to the blocks, which cut
   out what their own documents may not keep.

A minimum whose *distinct* segments would be too much for one sort (the edges of
a line that half of all documents have, each in its own surroundings) is split:
its strings are dealt one by one, by a digest of their own bytes, each distinct
one once a block, reduced in stages (a part of the blocks, then all), and the
answer goes back the same way. So no group holds more than a bucket, whatever
repeats how often. No text is compared with another as a whole, nothing is
capped.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import cut, small_batches

LENGTH, GRAM = 50, 16
#: Bytes of text in one block, of segments sorted at once, and of minima or segments in one bucket.
BLOCK_BYTES, SORT_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20, 12 << 20
SUBS = 64
#: Bytes of a usual segment: up to 35 strings share a minimum that lies in all of them.
SEGMENT_BYTES = 84
#: Bytes of distinct segments with one minimum beyond which its strings are dealt one by one; blocks whose strings are reduced at once.
HOT_BYTES, HOT_BLOCKS = 1 << 20, 2000
#: Bytes of text whose minima are held at once.
CHUNK_BYTES = 1 << 20
LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _words8(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers; zeros follow the end."""
    n, padded = len(raw), raw + b"\0" * 16
    out = np.empty(n + 8, "<u8")
    for k in range(8):
        out[k::8] = np.frombuffer(padded, "<u8", (n + 8 - k + 7) // 8, k)
    return out


def minima(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """For each place where a string of ``length`` bytes starts, the least hash of its 16-byte grams."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64)
    w = _words8(raw)
    h = w[: n - GRAM + 1] * _MIX
    h ^= h >> np.uint64(29)
    h += w[8 : n - GRAM + 9]
    h *= _MIX2
    h ^= h >> np.uint64(32)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def _mixed(v: np.ndarray) -> np.ndarray:
    x = v * _MIX2
    return x ^ (x >> np.uint64(31))


def _directly(text: bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by the ``depth`` bytes from each on: by eight bytes at a time, only ties going on."""
    words = np.concatenate([_words8(text), np.zeros(depth + 8, "<u8")]).byteswap()
    places = places[np.argsort(words[places])]
    key = words[places]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for k in range(8, depth, 8):
        tied = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]]))
        if not len(tied):
            break
        own, group = places[tied], np.cumsum(new)[tied]
        key = words[own + k]
        order = np.lexsort((key, group))
        key, places[tied] = key[order], own[order]
        new[tied[1:]] |= key[1:] != key[:-1]
    return places


def two_stage_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of ``text`` (bytes), ordered by their first ``depth`` bytes at least.

    Stage one sorts the suffixes that are smaller than their successor. Stage
    two scans the buckets of first bytes from the smallest on: the suffix
    before each one scanned, if it is larger than it, goes to the next free
    place of its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # the end is smaller than any byte
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    small = np.flatnonzero(step[known] > 0)
    small = _directly(text.tobytes(), small, depth)
    # sorted by first byte already: the part of each bucket
    part = np.searchsorted(text[small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        lists, todo = waiting[c], list(waiting[c])
        while todo:  # runs of one byte: each level comes after the one that it is induced from
            last = np.concatenate(todo) if len(todo) > 1 else todo[0]
            last = last[last > 0] - 1
            last = last[text[last] == c]
            todo = [last] if len(last) else []
            lists += todo
        bucket = np.concatenate([*lists, small[part[c] : part[c + 1]]])
        waiting[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        larger = first > c
        before, first = before[larger], first[larger]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for piece, byte in zip(np.split(before, cuts), first[np.concatenate([[0], cuts])] if len(first) else []):
            waiting[byte].append(piece)
    return np.concatenate(out)


def adjacent_prefixes(text: bytes, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it (0 for the first), up to ``most`` bytes."""
    w = np.concatenate([_words8(text), np.zeros(most + 8, "<u8")])
    lcp = np.zeros(max(len(order) - 1, 0), np.int64)
    live = np.arange(len(lcp))
    for at in range(0, most, 8):
        diff = w[order[live] + at] ^ w[order[live + 1] + at]
        same = diff == 0
        # trailing zero bytes of a little-endian difference are equal bytes
        low = diff[~same] & (~diff[~same] + np.uint64(1))
        lcp[live[~same]] = at + (np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        live = live[same]
        if not len(live):
            break
    lcp[live] = most
    return np.concatenate([[0], np.minimum(lcp, most)])[: len(order)]


def _first_holders(segments: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string start in ``segments`` the smallest document that holds that string; and each segment's first start."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    text = b"".join(segments)
    starts = sizes - length + 1
    first = np.cumsum(starts) - starts
    order = two_stage_order(np.frombuffer(text, np.uint8), length)
    seg = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    whole = ends[seg] - order >= length
    order, seg = order[whole], seg[whole]
    new = np.flatnonzero(adjacent_prefixes(text, order, length) < length)
    low = np.minimum.reduceat(least[seg], new)
    holder = np.empty(int(starts.sum()), np.int64)
    holder[first[seg] + order - (ends - sizes)[seg]] = np.repeat(low, np.diff(np.concatenate([new, [len(order)]])))
    return holder, first


def covered(raw: list[bytes], least: np.ndarray, most: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first start, last start, holder) of strings whose smallest document, ``holder``, lies below ``most``.

    ``least`` and ``most`` are the smallest and largest documents that a block
    has a segment in; ``raw`` are the segments of one bucket.
    """
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(s, len(seen)) for s in raw), np.int64, len(raw))
    lowest = np.full(len(seen), LAST, np.int64)
    np.minimum.at(lowest, which, least)
    holder, first = _first_holders(list(seen), lowest, length)
    high = np.maximum.reduceat(holder, first)
    low = np.minimum.reduceat(holder, first)
    size = np.diff(np.concatenate([first, [len(holder)]]))
    one = high[which] == low[which]
    all_of = np.flatnonzero(one & (most > low[which]))
    out = [(all_of, np.zeros(len(all_of), np.int64), size[which[all_of]] - 1, low[which[all_of]])]
    some = np.flatnonzero(~one & (most > low[which]))
    if len(some):
        n = size[which[some]]
        at = np.repeat(np.arange(len(some)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        own = holder[first[which[some]][at] + k]
        # a run ends where the segment or the holder changes
        begin = (k == 0) | np.concatenate([[True], own[1:] != own[:-1]])
        new = np.flatnonzero(begin)
        last = np.concatenate([new[1:], [len(at)]]) - 1
        hit = own[new] < most[some][at[new]]
        new, last = new[hit], last[hit]
        out.append((some[at[new]], k[new], k[last], own[new]))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---- blocks -------------------------------------------------------------------------------------------------------

TABLE = "block long, bucket int, docs binary, sizes binary, texts binary, carry binary, prints binary, marks binary, wide binary"


class _Block:
    """Documents of one block; equal texts are kept once, with all their documents."""

    def __init__(self):
        self.size, self.at, self.texts, self.docs, self.of, self.carry = 0, {}, [], [], [], []

    def add(self, doc, raw: bytes, carry):
        key = hashlib.md5(raw).digest()
        if key not in self.at:
            self.at[key] = len(self.texts)
            self.texts.append(raw)
            self.size += len(raw)
        self.docs.append(LAST if doc is None else doc)
        self.of.append(self.at[key])
        self.carry.append(carry)


def _segments(texts: list[bytes], length: int):
    """(minimum, text, first start, string starts) of all segments; texts are taken joined, a chunk at a time."""
    flat = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    values, starts, last = [], [], None
    for at in range(0, len(flat) - length + 1, CHUNK_BYTES):
        v = minima(flat[at : at + CHUNK_BYTES + length - 1], length)
        # strings that would cross the end of their text don't count
        a, z = np.searchsorted(ends, [at, at + len(v)], "right")
        upto = np.minimum(ends[a : z + 1], at + len(v)) - at
        own = np.repeat(ends[a : z + 1], np.diff(upto, prepend=0))
        whole = np.arange(at + length, at + length + len(v)) <= own
        before = np.concatenate([[last is None or not last[1] or v[0] != last[0]], (v[1:] != v[:-1]) | ~whole[:-1]])
        new = np.flatnonzero(whole & before)
        values.append(v[new])
        starts.append(new + at)
        last = v[-1], whole[-1]
    if not values:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    start = np.concatenate(starts)
    text = np.searchsorted(ends, start, "right")
    size = np.minimum(np.concatenate([start[1:], [len(flat)]]), ends[text] - length + 1) - start
    return np.concatenate(values), text, start - (ends - sizes)[text], size


def _gathered(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place of ``raw`` on as rows of little-endian numbers; ``raw`` must go on for them."""
    out = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    for k in range(width):
        out[:, k] = raw[at + k]
    return out.view("<u8")


def _digest(words: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit number for each row of numbers."""
    h = np.full(len(words), seed, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX2
        h ^= h >> np.uint64(32)
    return h


def _ends(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit number for segments from their first and last eight bytes and size: different numbers, different segments."""
    return _digest(np.concatenate([_gathered(flat, at, 8), _gathered(flat, at + n - 8, 8), n[:, None].astype(np.uint64)], 1), 1)


def _same(flat: np.ndarray, prints, at, n) -> np.ndarray:
    """For each segment, ``n`` bytes of ``flat`` from ``at`` on, the number of the first one with the same minimum and bytes."""
    first = np.arange(len(prints))
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    twin = np.zeros(len(p), bool)
    twin[1:] = p[1:] == p[:-1]
    twin[:-1] |= twin[1:]
    some = np.sort(order[twin])
    ends = _ends(flat, at[some], n[some])
    order = np.argsort(ends, kind="stable")
    twin = np.zeros(len(some), bool)
    twin[1:] = ends[order[1:]] == ends[order[:-1]]
    twin[:-1] |= twin[1:]
    some = np.sort(some[order[twin]])
    raw, seen = flat.tobytes(), {}
    spans = zip(some.tolist(), at[some].tolist(), (at[some] + n[some]).tolist())
    first[some] = np.fromiter((seen.setdefault(raw[a:z], i) for i, a, z in spans), np.int64, len(some))
    return first


class _Inventory:
    """What one block may have to send; the same each time it is made.

    Distinct segments of minima that occur elsewhere come first to last as in
    the block: ``flat[at : at + size]`` with documents from ``low`` to ``high``.
    ``text``, ``start`` and ``of`` are the places of all segments and the number
    of each one's distinct segment. ``hot`` numbers the segments of hot minima;
    ``strings`` are the digests of their distinct strings, ``string`` those of
    the segments in ``hot`` one after another.
    """

    def __init__(self, ids, of_text, raw: list[bytes], lists, buckets: int, length: int, hot_bytes: int):
        self.least = np.full(len(raw), LAST, np.int64)
        np.minimum.at(self.least, of_text, ids)
        value, text, start, size = _segments(raw, length)
        prints = _prints(value, buckets)
        told = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in lists])) if lists else np.zeros(0, np.uint64)
        hot = told[told >> np.uint64(63) == 1] & np.uint64((1 << 63) - 1)
        # minima that several texts of this block have
        order = np.lexsort((text, prints))
        p, t = prints[order], text[order]
        own = np.unique(p[1:][(p[1:] == p[:-1]) & (t[1:] != t[:-1])])
        known = np.unique(np.concatenate([own, told & np.uint64((1 << 63) - 1)]))
        keep = np.flatnonzero(_within(prints, known))
        self.text, self.start, prints = text[keep], start[keep], prints[keep]
        n = size[keep] + length - 1
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        base = np.cumsum([0, *map(len, raw)])
        at = base[self.text] + self.start
        first = _same(self.flat, prints, at, n)
        single = np.flatnonzero(first == np.arange(len(first)))
        self.of = np.searchsorted(single, first)
        self.at, self.size, self.prints = at[single], n[single], prints[single]
        self.low, self.high = np.full(len(single), LAST, np.int64), np.full(len(single), -LAST, np.int64)
        np.minimum.at(self.low, self.of, self.least[self.text])
        np.maximum.at(self.high, self.of, self.least[self.text])
        # a minimum that only this block has may be hot here
        heavy, which = np.unique(self.prints, return_inverse=True)
        heavy = heavy[np.bincount(which, self.size, len(heavy)) > hot_bytes]
        self.is_hot = _within(self.prints, np.unique(np.concatenate([hot, heavy])))
        self.hot = np.flatnonzero(self.is_hot)
        self.strings_of = self.size[self.hot] - length + 1
        which = np.repeat(np.arange(len(self.hot)), self.strings_of)
        places = self.at[self.hot][which] + np.arange(len(which)) - np.repeat(np.cumsum(self.strings_of) - self.strings_of, self.strings_of)
        raw, digest = self.flat.tobytes(), hashlib.blake2b
        digest = b"".join([digest(raw[a : a + length], digest_size=16).digest() for a in places.tolist()])
        digest = np.frombuffer(digest, "<u8").reshape(-1, 2)
        self.strings, self.string_low, self.string = _least_of(digest, self.low[self.hot][which])
        self.string_high = np.full(len(self.strings), -LAST, np.int64)
        np.maximum.at(self.string_high, self.string, self.high[self.hot][which])

    def runs(self, holder: np.ndarray) -> tuple[np.ndarray, ...]:
        """(segment, first start, last start, holder) of the segments in ``hot``, given the holder of each string (LAST: none)."""
        own = holder[self.string]
        n = self.strings_of
        seg = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        new = np.flatnonzero((k == 0) | np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([new[1:], [len(own)]]) - 1
        hit = own[new] < LAST
        new, last = new[hit], last[hit]
        return self.hot[seg[new]], k[new], k[last], own[new]


def _least_of(digest: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digests, least document of each, position of each entry's digest)."""
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    d = digest[order]
    new = (d[1:] != d[:-1]).any(1)
    new = np.concatenate([[True], new]) if len(d) else new
    which = np.empty(len(d), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return d[first], np.minimum.reduceat(low[order], first) if len(first) else low[:0], which


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _prints(value: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | print of minima; the highest bit is free."""
    x = _mixed(value)
    return ((x >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))


def _record(block, bucket, docs=None, sizes=None, texts=None, carry=None, prints=None, marks=None, wide=None) -> pa.RecordBatch:
    parts = (docs, sizes, texts, carry, prints, marks, wide)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)],
        [c.split()[0] for c in TABLE.split(", ")],
    )


def _by_bucket(order_key: np.ndarray):
    """(key, index slice) pairs of an array of keys."""
    order = np.argsort(order_key, kind="stable")
    keys, starts = np.unique(order_key[order], return_index=True)
    for k, a, z in zip(keys.tolist(), starts, [*starts[1:], len(order)]):
        yield k, order[a:z]


def _pack(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Blocks (bucket -1) and their minima (one row for each bucket)."""

    def run(batches):
        from pyspark import TaskContext

        number, block = 0, _Block()

        def flush():
            nonlocal number, block
            name = TaskContext.get().partitionId() << 32 | number
            squeeze = zstandard.ZstdCompressor(level=5).compress
            yield _record(
                name,
                -1,
                np.array([block.docs, block.of], "<i8").tobytes(),
                np.fromiter(map(len, block.texts), "<i8", len(block.texts)).tobytes(),
                squeeze(b"".join(block.texts)),
                squeeze(json.dumps(block.carry).encode()),
            )
            value, text, start, size = _segments(block.texts, length)
            every, n = _prints(value, buckets), size + length - 1
            base = np.cumsum([0, *map(len, block.texts)])
            mark = _ends(np.frombuffer(b"".join(block.texts), np.uint8), base[text] + start, n)
            order = np.lexsort((mark, every))
            every, mark, n = every[order], mark[order], n[order]
            single = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (mark[1:] != mark[:-1])])) if len(every) else order
            every, mark, n = every[single], mark[single], n[single]
            prints, first = np.unique(every, return_index=True)
            # one byte that tells the first segment from others, and the bytes that all distinct ones have beyond a usual one
            marks = mark[first].astype(np.uint8)
            total = np.add.reduceat(n, first) if len(first) else n
            more = (total - np.minimum(n[first], SEGMENT_BYTES)).astype("<u4")
            for k, o in _by_bucket((prints >> np.uint64(32)).astype(np.int64)):
                wide = o[more[o] > 0]
                packed = prints[wide].astype("<u4").tobytes() + more[wide].tobytes()
                yield _record(name, k, prints=prints[o].astype("<u4").tobytes(), marks=marks[o].tobytes(), wide=packed)
            number, block = number + 1, _Block()

        for batch in batches:
            for doc, text, *carry in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(doc, (text or "").encode("utf-8", "surrogatepass"), carry)
                if block.size >= BLOCK_BYTES or len(block.docs) >= 1 << 16:
                    yield from flush()
        if block.docs:
            yield from flush()

    return docs.mapInArrow(run, TABLE)


def _unpack(docs: bytes, sizes: bytes, texts: bytes):
    ids, of = np.frombuffer(docs, "<i8").reshape(2, -1)
    raw = zstandard.ZstdDecompressor().decompress(texts)
    ends = np.cumsum(np.frombuffer(sizes, "<i8"))
    return ids, of, [raw[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


TOLD = "block long, prints binary, hot long"


def _repeated(part: pa.Table, hot_bytes: int) -> pa.Table:
    """Minima of a bucket that several blocks have, by block; the highest bit marks hot ones, whose bytes ``hot`` counts (once)."""
    lists = [np.frombuffer(b, "<u4") for b in part.column("prints").to_pylist()]
    block = part.column("block").to_numpy()
    bucket = part.column("bucket")[0].as_py()
    none = {"block": pa.array([], pa.int64()), "prints": pa.array([], pa.binary()), "hot": pa.array([], pa.int64())}
    if len(lists) < 2:
        return pa.table(none)
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    values, first, count = np.unique(every[order], return_index=True, return_counts=True)
    marks = np.concatenate([np.frombuffer(b, np.uint8) for b in part.column("marks").to_pylist()])[order]
    weight = np.zeros(len(values))
    wide = [np.frombuffer(b, "<u4").reshape(2, -1) for b in part.column("wide").to_pylist()]
    wide = np.concatenate(wide, 1)
    np.add.at(weight, np.searchsorted(values, wide[0]), wide[1])
    often = np.flatnonzero(count * SEGMENT_BYTES + weight > hot_bytes)
    # many listings are many distinct segments only if their digests differ; equal ones are told apart from them by a byte
    differ = np.array([len(np.unique(marks[first[i] : first[i] + count[i]])) for i in often])
    size = np.where(differ * 3 > 256, count[often] * SEGMENT_BYTES, differ * SEGMENT_BYTES) + weight[often] if len(often) else np.zeros(0)
    hot = np.zeros(len(values), bool)
    hot[often[size > hot_bytes]] = True
    twice = count > 1
    mark = (hot.astype(np.uint64) << np.uint64(63)) | np.uint64(bucket << 32)
    rows = []
    for b, p in zip(block.tolist(), lists):
        i = np.searchsorted(values, p)
        i = i[twice[i]]
        if len(i):
            rows.append((b, (values[i].astype(np.uint64) | mark[i]).astype("<u8").tobytes()))
    if not rows:
        return pa.table(none)
    held = int(size[size > hot_bytes].sum())
    return pa.table(
        {
            "block": pa.array([r[0] for r in rows], pa.int64()),
            "prints": pa.array([r[1] for r in rows], pa.binary()),
            "hot": pa.array([held if i == 0 else 0 for i in range(len(rows))], pa.int64()),
        }
    )


SENT = "bucket int, block long, n int, packed binary"
#: What is sent of each segment besides its bytes: its number in the block, smallest and largest document, size, part of the bucket.
_HEAD = (("seg", "<u4"), ("low", "<i8"), ("over", "<i8"), ("size", "<u4"), ("sub", "u1"))
#: What is sent of each string of a hot minimum: number, smallest and largest document; its digest follows.
_HOT_HEAD = (("seg", "<u4"), ("low", "<i8"), ("over", "<i8"))


def _row(bucket: int, block: int, n: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([n], pa.int32()), pa.array([packed], pa.binary())],
        [c.split()[0] for c in SENT.split(", ")],
    )


def _read(part: pa.Table, head) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """(block of each entry, columns of ``head``, what follows in each row) of rows of SENT."""
    counts = part.column("n").to_pylist()
    heads, raw = [], []
    for n, packed in zip(counts, part.column("packed").to_pylist()):
        packed, at, own = zstandard.ZstdDecompressor().decompress(packed), 0, []
        for _, t in head:
            own.append(np.frombuffer(packed, t, n, at))
            at += n * own[-1].itemsize
        heads.append(own)
        raw.append(packed[at:])
    return np.repeat(part.column("block").to_numpy(), counts), [np.concatenate(x) for x in zip(*heads)], raw


def _send(told: DataFrame, buckets: int, out: int, hot_out: int, length: int, hot_bytes: int) -> DataFrame:
    """Distinct segments whose minimum occurs in several texts, packed by bucket; strings of hot minima in buckets from ``out`` on."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for block, docs, sizes, texts, _, lists in zip(*(c.to_pylist() for c in batch.columns)):
                ids, of, raw = _unpack(docs, sizes, texts)
                inv = _Inventory(ids, of, raw, lists, buckets, length, hot_bytes)
                seg, raw = np.flatnonzero(~inv.is_hot), inv.flat.tobytes()
                x = _mixed(inv.prints[seg])
                for k, o in _by_bucket((x % np.uint64(out)).astype(np.int64)):
                    i = seg[o]
                    cuts = zip(inv.at[i].tolist(), (inv.at[i] + inv.size[i]).tolist())
                    head = {"seg": i, "low": inv.low[i], "over": inv.high[i] - inv.low[i], "size": inv.size[i], "sub": (x[o] >> np.uint64(40)) % np.uint64(SUBS)}
                    packed = b"".join([*(head[c].astype(t).tobytes() for c, t in _HEAD), *(raw[a:z] for a, z in cuts)])
                    yield _row(k, block, len(o), squeeze(packed))
                for k, o in _by_bucket((inv.strings[:, 0] % np.uint64(hot_out)).astype(np.int64)):
                    head = {"seg": o, "low": inv.string_low[o], "over": inv.string_high[o] - inv.string_low[o]}
                    packed = b"".join([*(head[c].astype(t).tobytes() for c, t in _HOT_HEAD), inv.strings[o].astype("<u8").tobytes()])
                    yield _row(out + k, block, len(o), squeeze(packed))

    return told.mapInArrow(run, SENT)


COVER = "block long, hot boolean, cover binary"


def _covers(block, hot: bool, *columns) -> pa.Table:
    """COVER rows of entries (block, columns of whole numbers), packed by block."""
    keys, packed = [], []
    for k, i in _by_bucket(block):
        keys.append(k)
        packed.append(zstandard.ZstdCompressor(level=1).compress(np.stack([c[i] for c in columns]).astype("<i8").tobytes()))
    return pa.table({"block": pa.array(keys, pa.int64()), "hot": pa.array([hot] * len(keys), pa.bool_()), "cover": pa.array(packed, pa.binary())})


def _strings_of(part: pa.Table):
    block, (seg, low, over), raw = _read(part, _HOT_HEAD)
    return block, seg, low, over, np.concatenate([np.frombuffer(r, "<u8").reshape(-1, 2) for r in raw])


def _told_strings(block, seg, low, over, holder) -> pa.Table:
    hit = np.flatnonzero(holder < low + over)
    return _covers(block[hit], True, seg[hit].astype(np.int64), holder[hit])


def _sorted_out(length: int, out: int):
    def run(part: pa.Table) -> pa.Table:
        """Sort a bucket's segments, a bounded part at a time, and tell runs of strings and their holders by block."""
        if part.column("bucket")[0].as_py() >= out:
            block, seg, low, over, digest = _strings_of(part)
            _, least, which = _least_of(digest, low)
            return _told_strings(block, seg, low, over, least[which])
        block, (seg, low, over, size, sub), raw = _read(part, _HEAD)
        raw = b"".join(raw)
        ends = np.cumsum(size.astype(np.int64))
        begin = ends - size
        found = []
        order = np.argsort(sub, kind="stable")
        cuts = np.searchsorted(sub[order], np.arange(SUBS + 1))
        todo, held = [], 0
        for k in range(SUBS):
            todo.append(order[cuts[k] : cuts[k + 1]])
            held += int(size[todo[-1]].sum())
            after = int(size[order[cuts[k + 1] : cuts[k + 2]]].sum()) if k + 1 < SUBS else 0
            if k == SUBS - 1 or held + after > SORT_BYTES:
                s, todo, held = np.concatenate(todo), [], 0
                if len(s):
                    i, a, z, holder = covered([raw[x:y] for x, y in zip(begin[s].tolist(), ends[s].tolist())], low[s], (low + over)[s], length)
                    found.append((block[s[i]], seg[s[i]].astype(np.int64), a, z, holder))
        b, o, a, z, holder = (np.concatenate(x) for x in zip(*found))
        return _covers(b, False, o, a, z, holder)

    return run


PARTIAL = "bucket int, salt int, packed binary"


def _partial(part: pa.Table) -> pa.Table:
    """Distinct strings of some blocks, with their least documents."""
    digest, least, _ = _least_of(*_strings_of(part)[4:1:-2])
    packed = digest.astype("<u8").tobytes() + least.astype("<i8").tobytes()
    return pa.table(
        {
            "bucket": part.column("bucket").slice(0, 1),
            "salt": part.column("salt").slice(0, 1),
            "packed": pa.array([zstandard.ZstdCompressor(level=3).compress(packed)], pa.binary()),
        }
    )


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u8")
    n = len(raw) // 3
    return raw[: 2 * n].reshape(-1, 2), raw[2 * n :].astype(np.int64)


def _merged(part: pa.Table) -> pa.Table:
    """The partial rows of a bucket again, with least documents over all of them."""
    parts = [_unpacked(p) for p in part.column("packed").to_pylist()]
    _, least, which = _least_of(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    out, at = [], 0
    for digest, _ in parts:
        packed = digest.astype("<u8").tobytes() + least[which[at : at + len(digest)]].astype("<i8").tobytes()
        out.append(zstandard.ZstdCompressor(level=3).compress(packed))
        at += len(digest)
    return pa.table({"bucket": part.column("bucket"), "salt": part.column("salt"), "packed": pa.array(out, pa.binary())})


def _answered(sent: pa.Table, told: pa.Table) -> pa.Table:
    """Strings of some blocks with the least documents of all blocks."""
    block, seg, low, over, digest = _strings_of(sent)
    _, _, which = _least_of(digest, low)  # the order of ``_partial``
    return _told_strings(block, seg, low, over, _unpacked(told.column("packed")[0].as_py())[1][which])


def _reduced_in_stages(hot: DataFrame, salts: int) -> DataFrame:
    """COVER of strings of hot minima: by part of the blocks, then of all, and back."""
    hot = hot.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    partial = hot.groupBy("bucket", "salt").applyInArrow(_partial, PARTIAL)
    merged = partial.groupBy("bucket").applyInArrow(_merged, PARTIAL)
    return hot.groupBy("bucket", "salt").cogroup(merged.groupBy("bucket", "salt")).applyInArrow(_answered, COVER)


def _cut_out(rows: DataFrame, schema: T.StructType, buckets: int, length: int, hot_bytes: int) -> DataFrame:
    kinds = [f.dataType for f in schema.fields[6:]]

    def places(ids, of, raw, lists, covers):
        """Runs (text, first byte, end byte) that go, and the least document of each text."""
        if not covers:
            least = np.full(len(raw), LAST, np.int64)
            np.minimum.at(least, of, ids)
            return (np.zeros(0, np.int64),) * 3 + (least,)
        inv, out = _Inventory(ids, of, raw, lists, buckets, length, hot_bytes), []
        for hot in (False, True):
            got = [np.frombuffer(zstandard.ZstdDecompressor().decompress(c["cover"]), "<i8").reshape(2 if hot else 4, -1) for c in covers if c["hot"] == hot]
            if not got:
                continue
            entry, *a_z, holder = np.concatenate(got, 1)
            if hot:
                of_string = np.full(len(inv.strings), LAST, np.int64)
                of_string[entry] = holder
                entry, *a_z, holder = inv.runs(of_string)
            a, z = a_z
            # each entry's places in the block
            n = np.bincount(inv.of, minlength=len(inv.at))
            order, begin = np.argsort(inv.of, kind="stable"), np.cumsum(n) - n
            e = np.repeat(np.arange(len(entry)), n[entry])
            q = order[begin[entry[e]] + np.arange(len(e)) - np.repeat(np.cumsum(n[entry]) - n[entry], n[entry])]
            go = holder[e] < inv.least[inv.text[q]]
            e, q = e[go], q[go]
            out.append((inv.text[q], inv.start[q] + a[e], inv.start[q] + z[e] + length))
        return *(np.concatenate(x) for x in zip(*out)), inv.least

    def run(batches):
        for batch in batches:
            for _, docs, sizes, texts, carry, lists, covers in zip(*(c.to_pylist() for c in batch.columns)):
                ids, of, raw = _unpack(docs, sizes, texts)
                text, a, z, least = places(ids, of, raw, lists, covers)
                order = np.lexsort((a, text))
                text, a, z = text[order], a[order], z[order]
                cuts = np.searchsorted(text, np.arange(len(raw) + 1))
                results = []
                for t, own in enumerate(raw):
                    x, y = a[cuts[t] : cuts[t + 1]], np.maximum.accumulate(z[cuts[t] : cuts[t + 1]])
                    new = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1]])) if len(x) else np.zeros(0, np.int64)
                    kept, at = [], 0
                    for p, q in zip(x[new].tolist(), y[np.concatenate([new[1:] - 1, [len(y) - 1]])].tolist() if len(x) else ()):
                        kept.append(own[at:p])
                        at = q
                    kept = b"".join([*kept, own[at:]])
                    results.append((len(own), len(own) - len(kept), len(new), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
                whole = [(r[0], r[0], 1, hashlib.sha256(b"").hexdigest(), "") if r[0] >= length else r for r in results]
                own = json.loads(zstandard.ZstdDecompressor().decompress(carry))
                got = [(whole if d > least[t] else results)[t] for d, t in zip(ids.tolist(), of.tolist())]
                fields = [pa.array([None if d == LAST else d for d in ids.tolist()], pa.int64())]
                fields += [pa.array([g[k] for g in got], pa.int64() if k < 3 else pa.string()) for k in range(5)]
                fields += [pa.array([c[k] for c in own], pa.int64() if isinstance(t, (T.LongType, T.IntegerType)) else pa.string()) for k, t in enumerate(kinds)]
                whole_batch = pa.RecordBatch.from_arrays(fields, schema.names)
                for at in range(0, whole_batch.num_rows, 2048):
                    yield whole_batch.slice(at, 2048)

    return rows.mapInArrow(run, schema)


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    carry: tuple[str, ...] = (),
    hot_bytes: int = HOT_BYTES,
    hot_blocks: int = HOT_BLOCKS,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, ...carry), one row per input row.

    A byte goes if it lies in a ``length``-byte string that also starts in a
    document with a smaller id, judged on the input. ``kept`` is what is left,
    as text (a character that lost some of its bytes is left out there; the
    digest is over the bytes). ``carry`` names further columns, strings or
    whole numbers, to be passed on. Null texts are empty. Rows without an id
    come after all others, and rows with one id don't cut each other. Repeated
    rows stay repeated; other columns, whatever their names, are left aside. An
    empty table gives an empty one. Results don't depend on ``hot_bytes`` and
    ``hot_blocks``, which bound what one task takes.
    """
    if length <= GRAM:
        raise ValueError(f"length has to be above {GRAM}")
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())]
        + [T.StructField(c, T.LongType() if kinds[c] in ("bigint", "int", "smallint") else T.StringType()) for c in carry]
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *(F.col(c).cast(schema[c].dataType).alias(f"carry_{c}") for c in carry),
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # one minimum of four bytes for about 18 bytes of text; segments are at most four times the text
    buckets, out = max(4, -(-total * 4 // 18 // BUCKET_BYTES)), max(4, -(-total // BUCKET_BYTES))
    small_batches(spark)
    packed = cut(_pack(rows, buckets, length), "blocks")
    texts = packed.where("bucket = -1")
    prints = packed.where("bucket >= 0").select("block", "bucket", "prints", "marks", "wide")
    told = cut(prints.groupBy("bucket").applyInArrow(lambda part: _repeated(part, hot_bytes), TOLD), "told")
    blocks = texts.count()
    hot_total = told.agg(F.coalesce(F.sum("hot"), F.lit(0))).first()[0]
    # about 34 strings in a usual segment, 36 bytes each
    hot_out, salts = max(4, -(-hot_total * 34 * 36 // SEGMENT_BYTES // BUCKET_BYTES)), -(-blocks // hot_blocks)
    lists = told.groupBy("block").agg(F.collect_list("prints").alias("lists"))
    # both joins read the texts through one exchange: it has the same columns for both, so Spark reuses it
    whole = texts.select("block", "docs", "sizes", "texts", "carry").join(lists, "block", "left")
    sent = _send(whole, buckets, out, hot_out, length, hot_bytes)
    if salts > 1 and hot_total:
        sent = cut(sent, "sent")
        cover = sent.where(F.col("bucket") < out).groupBy("bucket").applyInArrow(_sorted_out(length, out), COVER)
        cover = cover.union(_reduced_in_stages(sent.where(F.col("bucket") >= out), salts))
    else:
        cover = sent.groupBy("bucket").applyInArrow(_sorted_out(length, out), COVER)
    cover = cover.groupBy("block").agg(F.collect_list(F.struct("hot", "cover")).alias("covers"))
    return _cut_out(whole.join(cover, "block", "left"), schema, buckets, length, hot_bytes)
