"""Scoring texts by an Elias-Fano n-gram trie in memory-mapped shards.

The vocabulary is sorted by 64-bit word hash; a word's id is its place.  Bigrams and trigrams are dealt to shards by the
hash of their first two words, so no single frequent word makes a large shard.  A shard file has these levels:

* ``two``: keys ``id1 * V + id2`` of its bigrams as an Elias-Fano sequence, with quantised maximum-likelihood probabilities
  and, as each bigram is the context of its successors, quantised back-off weights;
* ``ptr``: for each bigram the place of its first successor, as an Elias-Fano sequence (monotone pointers);
* ``three``: ids of successors relative to their context: each context counts on from where the one before it ended, which
  makes one Elias-Fano sequence; a successor is searched between its context's pointers only; with quantised smoothed
  probabilities.

Probabilities are quantised downwards, and the weights of shorter contexts are what the quantised ones leave of 1, so that
the probabilities of all words after a context sum to 1, but for the rounding of the weight itself.

All trigrams are stored (a KEEP above 1 leaves rarer ones out; their mass goes to the back-off weight).  Smoothing interpolates in the manner of Witten
and Bell: a context seen c times with T distinct successors gives K*T / (c + K*T) to the shorter context.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, crc_mod, grouped, map_arrow, mapped, mix64, shared_dir, table, write_file

#: Weight of distinct successors in the back-off, K above.
BACKOFF = 4.0
#: Trigrams need this count to be kept; at 1 all are.
KEEP = 1
#: Steps of the quantised logarithm of a probability (8 bits) and of a back-off weight (16 bits) to each factor of two.
STEPS, WEIGHT_STEPS = 8, 2048
#: Tokens to a shard of n-grams, and to one of the vocabulary.
SHARD_TOKENS, VOCABULARY_TOKENS = 2_500_000, 20_000_000
#: Up to so many words a task keeps a number for each while it counts (4 bytes).
LOCAL_WORDS = 50_000_000
#: The end of a text has the hash of no word's bytes.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))


# ---------------------------------------------------------------- arrays in few bytes


def squeeze(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""
    return struct.pack("<QB", len(x), x.itemsize) + zstandard.ZstdCompressor(level=1).compress(raw)


def expand(data: bytes, kind: str) -> np.ndarray:
    n, size = struct.unpack_from("<QB", data)
    if not n:
        return np.zeros(0, kind)
    raw = zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=n * size)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def bundle(arrays: list[np.ndarray]) -> bytes:
    parts = [squeeze(a) for a in arrays]
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def unbundle(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}Q", data), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(expand(data[at : at + size], kind))
        at += size
    return out


def quantise(p: np.ndarray) -> np.ndarray:
    """The largest level that is no larger than p, where there is one."""
    return np.clip(np.ceil(-np.log2(np.maximum(p, 1e-30)) * STEPS - 1e-9), 0, 255).astype(np.uint8)


def quantise_weight(w: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(-np.log2(np.maximum(w, 1e-30)) * WEIGHT_STEPS - 1e-9), 0, 65535).astype(np.uint16)


LEVELS = 2.0 ** (-np.arange(256) / STEPS)
WEIGHTS = 2.0 ** (-np.arange(65536) / WEIGHT_STEPS)


# ---------------------------------------------------------------- Elias-Fano


def _pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits one after the other, in 64-bit words (one more at the end)."""
    words = np.zeros(len(low) * bits // 64 + 2, np.uint64)
    if bits and len(low):
        place = np.arange(len(low), dtype=np.uint64) * np.uint64(bits)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        head = low << shift
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
        words[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
    return words


class EliasFano:
    """A sorted sequence of integers, distinct ones for ``find``: low bits packed, high bits in unary, zeros counted by 64-bit word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros
        self.ones: np.ndarray | None = None  # set bits before each word, once asked for

    @classmethod
    def build(cls, x: np.ndarray) -> EliasFano:
        x = x.astype(np.uint64)
        n = len(x)
        top = int(x[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(x & np.uint64((1 << bits) - 1), bits)
        ones = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) if n else 0) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64)))).astype(np.uint64)
        return cls(n, bits, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.uint64), self.low, self.high, self.zeros]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        place = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        both = (self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return both & np.uint64((1 << self.bits) - 1)

    def _starts(self, high: np.ndarray) -> np.ndarray:
        """Bit after the zero number ``high`` - 1, where the ones of that high part start; past the end where there is none."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        k = high[some] - np.uint64(1)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        beyond = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        left = k - self.zeros[word]
        bits, place = ~self.high[word], np.zeros(len(some), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> place) & np.uint64((1 << half) - 1)).astype(np.uint64)
            go = left >= count
            left = np.where(go, left - count, left)
            place = np.where(go, place + np.uint64(half), place)
        out[some] = np.where(beyond, 64 * len(self.high), word * 64 + place.astype(np.int64) + 1)
        return out

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each x in the sequence, or -1; with bounds, its place among those from ``first`` to before ``end``."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        high, low = x >> np.uint64(self.bits), x & np.uint64((1 << self.bits) - 1)
        lo = np.minimum(self._starts(high) - high.astype(np.int64), self.n)
        hi = np.minimum(self._starts(high + np.uint64(1)) - high.astype(np.int64) - 1, self.n)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        live = np.flatnonzero(lo < hi)
        while len(live):  # binary search among the low bits of one high part
            middle = (lo[live] + hi[live]) >> 1
            value = self._low(middle)
            want = low[live]
            hit = value == want
            out[live[hit]] = middle[hit]
            less = value < want
            lo[live] = np.where(less, middle + 1, lo[live])
            hi[live] = np.where(less, hi[live], middle)
            live = live[~hit & (lo[live] < hi[live])]
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at places."""
        if self.ones is None:
            self.ones = 64 * np.arange(len(self.zeros), dtype=np.int64) - self.zeros.astype(np.int64)
        ones = self.ones
        word = np.searchsorted(ones, at, side="right") - 1
        left, bits, place = (at - ones[word]).astype(np.uint64), self.high[word], np.zeros(len(at), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> place) & np.uint64((1 << half) - 1)).astype(np.uint64)
            go = left >= count
            left = np.where(go, left - count, left)
            place = np.where(go, place + np.uint64(half), place)
        high = word * 64 + place.astype(np.int64) - at
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(at)


def dump(arrays: list[np.ndarray]) -> list[bytes]:
    """A file of arrays: their number, then for each its kind and size, then the bytes, each from a multiple of 8."""
    head = struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<2sHIQ", a.dtype.str[1:].encode(), 0, 0, len(a)) for a in arrays)
    return [head, *(b for a in arrays for b in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]


def load(raw: np.ndarray) -> list[np.ndarray]:
    raw = raw.view(np.ndarray)
    n = int(raw[:8].view(np.uint64)[0])
    out, at = [], 8 + 16 * n
    for k in range(n):
        kind, _, _, size = struct.unpack_from("<2sHIQ", raw[8 + 16 * k : 24 + 16 * k].tobytes())
        nbytes = size * np.dtype(kind.decode()).itemsize
        out.append(raw[at : at + nbytes].view("<" + kind.decode()))
        at += nbytes + -nbytes % 8
    return out


# ---------------------------------------------------------------- tokens


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct token hashes in ascending order, number of each token, offsets of the texts); each text ends with END."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    lower = pc.ascii_lower(coded.dictionary).dictionary_encode()
    words = lower.dictionary.cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.append(h, END)
    distinct, back = np.unique(h, return_inverse=True)
    at = back[lower.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]] if len(words) else np.zeros(0, np.int64)
    full = np.array([bool(w) for w in words] + [True])
    mark = np.zeros(len(distinct), bool)
    mark[back] = full
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    keep = mark[at]  # splitting leaves empty strings at the edges of a text
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    at = np.insert(at[keep], kept[1:], back[-1])
    return distinct, at, kept + np.arange(len(kept))


# ---------------------------------------------------------------- building


@dataclass
class Trie:
    """Where a model's files are, and its totals; small, whatever the corpus."""

    folder: str
    tokens: int  # N
    words: int  # V
    firsts: list[int]  # of each vocabulary shard its first id
    shards: int  # of n-grams
    written: frozenset[int]  # those of them that have n-grams, and so a file


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _fold(keys: list, counts: list, limit: int) -> None:
    """Merge collected blocks in place once they hold more than ``limit`` entries."""
    if sum(map(len, keys)) > limit:
        k, c = _merge(keys, counts)
        keys[:], counts[:] = [k], [c]


def _binary_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])


def _vocabulary(texts: DataFrame, folder: str, shards: int) -> list[tuple[int, int, int]]:
    """Write the vocabulary shards, by ranges of hashes; (shard, words, tokens) of each."""
    edges = (np.arange(1, shards, dtype=np.float64) / shards * 2.0**64).astype(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in batches:
            distinct, at, _ = hashes(b.column("text"))
            keys.append(distinct)
            counts.append(np.bincount(at, minlength=len(distinct)))
            _fold(keys, counts, 3_000_000)
        k, c = _merge(keys, counts)
        k, c = k[c > 0], c[c > 0]
        cuts = [0, *np.searchsorted(k, edges), len(k)]
        for s in range(shards):
            if cuts[s + 1] > cuts[s]:
                part = slice(cuts[s], cuts[s + 1])
                yield _binary_rows([(s, bundle([np.diff(k[part], prepend=np.uint64(0)), c[part].astype(np.uint32)]))])

    def write(key, data):
        s, keys, counts = key[0].as_py(), [], []
        for block in data.column("block"):
            d, c = unbundle(block.as_py(), ["<u8", "<u4"])
            keys.append(np.cumsum(d, dtype=np.uint64))
            counts.append(c)
            _fold(keys, counts, 8_000_000)
        k, c = _merge(keys, counts)
        write_file(f"{folder}/words-{s:04d}", iter(dump([k, c.astype(np.uint64)])))
        return pa.table({"shard": pa.array([s], pa.int32()), "words": pa.array([len(k)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64())})

    blocks = map_arrow(texts, count, "shard int, block binary")
    done = blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(grouped(write), "shard int, words long, tokens long").collect()  # a row for each shard
    return sorted((r.shard, r.words, r.tokens) for r in done)


class Words:
    """Ids, counts and distinct successors of the vocabulary, memory-mapped."""

    def __init__(self, trie: Trie, successors: bool):
        self.firsts = trie.firsts
        parts = [load(mapped(f"{trie.folder}/words-{s:04d}")) if trie.firsts[s + 1] > trie.firsts[s] else [np.zeros(0, np.uint64)] * 2 for s in range(len(trie.firsts) - 1)]
        self.hashes, self.counts = [p[0] for p in parts], [p[1] for p in parts]
        after = [load(mapped(f"{trie.folder}/next-{s:04d}")) if trie.firsts[s + 1] > trie.firsts[s] else [np.zeros(0)] * 2 for s in range(len(parts))] if successors else []
        self.next, self.weight = [a[0] for a in after], [a[1] for a in after]

    def ids(self, distinct: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes, -1 where not in the vocabulary."""
        out = np.full(len(distinct), -1, np.int64)
        shards = len(self.hashes)
        edges = (np.arange(1, shards, dtype=np.float64) / shards * 2.0**64).astype(np.uint64)
        cuts = [0, *np.searchsorted(distinct, edges), len(distinct)]
        for s, h in enumerate(self.hashes):
            part = distinct[cuts[s] : cuts[s + 1]]
            if len(h) and len(part):
                k = np.minimum(np.searchsorted(h, part), len(h) - 1)
                out[cuts[s] : cuts[s + 1]] = np.where(h[k] == part, k + self.firsts[s], -1)
        return out

    def of(self, arrays: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Values of ascending ids from the arrays of all shards."""
        out = np.zeros(len(ids), np.float64)
        cuts = np.searchsorted(ids, self.firsts)
        for s, a in enumerate(arrays):
            out[cuts[s] : cuts[s + 1]] = a[ids[cuts[s] : cuts[s + 1]] - self.firsts[s]]
        return out


def _three(at: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of two tokens inside a text with the token after them, ``pad`` where the text ends."""
    last = np.zeros(len(at), bool)
    last[offsets[1:] - 1] = True
    i = np.flatnonzero(~last)
    third = np.full(len(i), pad, np.int64)
    more = np.flatnonzero(~last[i + 1])
    third[more] = at[i[more] + 2]
    return at[i], at[i + 1], third


def _group(key: np.ndarray, third: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (key, third), equal ones summed."""
    order = np.lexsort((third, key))
    key, third, count = key[order], third[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (third[1:] != third[:-1])))) if len(key) else np.zeros(0, np.int64)
    return key[new], third[new], np.add.reduceat(count, new) if len(key) else count


def _count(a: np.ndarray, b: np.ndarray, c: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_group`` of single trigrams, with keys a * words + b; where the words at hand fit, three to 64 bits, they are sorted as numbers."""
    if words <= LOCAL_WORDS:
        mark = np.zeros(words + 1, np.int32)
        for x in (a, b, c):
            mark[x] = 1
        names = np.flatnonzero(mark)
        bits = len(names).bit_length()
        if 3 * bits <= 64:
            np.cumsum(mark, out=mark)
            mark -= 1
            packed = mark[a].astype(np.uint64)
            for x in (b, c):
                packed = (packed << np.uint64(bits)) | mark[x].astype(np.uint64)
            packed.sort()
            new = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
            count = np.diff(np.append(new, len(packed)))
            packed, low = packed[new], np.uint64((1 << bits) - 1)
            one, two, three = (names[(packed >> np.uint64(k * bits)) & low] for k in (2, 1, 0))
            return one.astype(np.uint64) * np.uint64(words) + two.astype(np.uint64), three, count
    key = a.astype(np.uint64) * np.uint64(words) + b.astype(np.uint64)
    return _group(key, c, np.ones(len(key), np.int64))


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard, equal ones as they are, and where each shard starts in it."""
    small = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # sorted by digits
    order = np.argsort(small, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))


def build_shard(key: np.ndarray, third: np.ndarray, count: np.ndarray, words: int, firsts: np.ndarray, keep: int = KEEP, backoff: float = BACKOFF) -> list[np.ndarray]:
    """The arrays of a shard from its grouped trigrams; ``firsts`` has the count of each bigram's first word."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    two = key[start]
    total = np.add.reduceat(count, start) if len(key) else count
    kinds = np.diff(np.append(start, len(key)))
    owner = np.repeat(np.arange(len(two)), kinds)
    stay = np.flatnonzero((count >= keep) & (third < words))
    share = quantise(count[stay] / (total + backoff * kinds)[owner[stay]])
    held = np.bincount(owner[stay], LEVELS[share], len(two))
    context, third = owner[stay], third[stay].astype(np.uint64)
    pointers = np.searchsorted(context, np.arange(len(two) + 1))
    last = np.zeros(len(two), np.uint64)
    some = np.diff(pointers) > 0
    last[some] = third[pointers[1:][some] - 1] + np.uint64(1)
    base = np.cumsum(last) - last  # where the contexts before have ended
    out = []
    for ef in (two, pointers, base[context] + third):
        out += EliasFano.build(ef).arrays()
    return [*out, quantise(total / np.maximum(firsts, 1)), quantise_weight(1 - held), share]


def train(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", tokens_hint: int | None = None) -> Trie:
    """Count the n-grams of all texts and write the trie under ``folder``.

    Null texts are empty (their end is their one token); repeated rows count each time; other columns are not read; an empty
    table gives a trie without words, by which every token has probability 1.  Tasks sum up what they have read before they
    send it, as compressed blocks of sorted arrays.  Shards grow in number with the tokens, not in size.  Every file is
    written whole under a fixed name, so a retried task writes the same.
    """
    texts = docs.select(F.col(text).alias("text"))
    if tokens_hint is None:
        tokens_hint = texts.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
        tokens_hint //= 6
    v_shards = max(1, -(-tokens_hint // VOCABULARY_TOKENS))
    shards = max(1, -(-tokens_hint // SHARD_TOKENS))
    found = {s: (w, n) for s, w, n in _vocabulary(texts, folder, v_shards)}
    firsts = np.concatenate(([0], np.cumsum([found.get(s, (0, 0))[0] for s in range(v_shards)]))).tolist()
    trie = Trie(folder, sum(n for _, n in found.values()), int(firsts[-1]), [int(x) for x in firsts], shards, frozenset())
    if not trie.words:
        return trie

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pend = Words(trie, False), []

        def flush() -> Iterator[pa.RecordBatch]:
            if not pend:
                return
            a, b, c = (np.concatenate(x) for x in zip(*pend, strict=True))
            pend.clear()
            key, third, n = _count(a, b, c, trie.words)
            order, cuts = _by_shard((mix64(key) % np.uint64(shards)).astype(np.int64), shards)
            for s in range(shards):
                rows = order[cuts[s] : cuts[s + 1]]
                if len(rows):
                    k = key[rows]
                    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                    yield _binary_rows([(s, bundle([np.diff(k[new], prepend=np.uint64(0)), np.diff(np.append(new, len(k))).astype(np.uint32), third[rows].astype(np.uint32), n[rows].astype(np.uint32)]))])

        held = 0
        for b in batches:
            distinct, at, offsets = hashes(b.column("text"))
            part = _three(words.ids(distinct)[at], offsets, trie.words)
            pend.append(part)
            held += len(part[0])
            if held > 6_000_000:
                yield from flush()
                held = 0
        yield from flush()

    def write(key, data):
        s, parts = key[0].as_py(), []
        for block in data.column("block"):
            d, kinds, third, n = unbundle(block.as_py(), ["<u8", "<u4", "<u4", "<u4"])
            parts.append((np.repeat(np.cumsum(d, dtype=np.uint64), kinds), third.astype(np.int64), n.astype(np.int64)))
            if sum(len(p[0]) for p in parts) > 3 * SHARD_TOKENS:
                parts = [_group(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        key2, third, n = _group(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        two = key2[np.flatnonzero(np.concatenate(([True], key2[1:] != key2[:-1])))]
        first = (two // np.uint64(trie.words)).astype(np.int64)
        words = Words(trie, False)
        arrays = build_shard(key2, third, n, trie.words, words.of(words.counts, first))
        write_file(f"{folder}/grams-{s:04d}", iter(dump(arrays)))
        new = np.flatnonzero(np.diff(first, prepend=-1))
        ids, kinds, mass = first[new], np.diff(np.append(new, len(first))), np.add.reduceat(LEVELS[arrays[12]], new)
        cuts = np.searchsorted(ids, trie.firsts)
        out = [(v, bundle([x[cuts[v] : cuts[v + 1]].astype(kind) for x, kind in ((ids, np.uint64), (kinds, np.uint32), (mass, np.float32))])) for v in range(v_shards) if cuts[v + 1] > cuts[v]]
        return pa.Table.from_batches([_binary_rows(out)]).append_column("grams", pa.array([s] * len(out), pa.int32()))

    def successors(key, data):
        v = key[0].as_py()
        total, mass = np.zeros(trie.firsts[v + 1] - trie.firsts[v], np.uint32), np.zeros(trie.firsts[v + 1] - trie.firsts[v])
        for block in data.column("block"):
            ids, n, m = unbundle(block.as_py(), ["<u8", "<u4", "<f4"])
            at = ids.astype(np.int64) - trie.firsts[v]
            total[at] += n
            mass[at] += m
        save(v, total, mass)
        return pa.table({"shard": pa.array([v], pa.int32()), "grams": pa.array([data.column("grams").unique().to_pylist()], pa.list_(pa.int32()))})

    def save(v: int, total: np.ndarray, mass: np.ndarray) -> None:
        """Write of each word its distinct successors and the weight that its quantised bigrams leave."""
        lower = BACKOFF * total
        count = load(mapped(f"{folder}/words-{v:04d}"))[1].astype(np.float64)
        left = np.where(total > 0, 1 - count / np.maximum(count + lower, 1) * mass, 1)
        write_file(f"{folder}/next-{v:04d}", iter(dump([total, np.nextafter(left.astype(np.float32), np.float32(0))])))

    blocks = map_arrow(texts, count, "shard int, block binary").repartition(shards, "shard")
    kinds = blocks.groupBy("shard").applyInArrow(grouped(write), "shard int, block binary, grams int").repartition(v_shards, "shard")
    done = {r.shard: r.grams for r in kinds.groupBy("shard").applyInArrow(grouped(successors), "shard int, grams array<int>").collect()}  # numbers of shards only
    for v in range(v_shards):  # shards whose words all stand before the end of a text only
        size = trie.firsts[v + 1] - trie.firsts[v]
        if v not in done and size:
            save(v, np.zeros(size, np.uint32), np.zeros(size))
    return replace(trie, written=frozenset(g for grams in done.values() for g in grams))


# ---------------------------------------------------------------- scoring


class Shard:
    def __init__(self, raw: np.ndarray):
        a = load(raw)
        self.two, self.ptr, self.three = (EliasFano(int(a[k][0]), int(a[k][1]), *a[k + 1 : k + 4]) for k in (0, 4, 8))
        self.p2, self.back, self.p3 = a[12:15]

    def successor(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place in ``three`` of each word after each context (places in ``two``, ascending), or -1."""
        new = np.diff(context, prepend=-1) > 0
        distinct, which = context[new], np.cumsum(new) - 1
        first, end = (self.ptr.get(distinct + k).astype(np.int64) for k in (0, 1))
        base = np.zeros(len(distinct), np.uint64)
        later = first > 0
        base[later] = self.three.get(first[later] - 1) + np.uint64(1)  # the context counts on from there
        out = np.full(len(context), -1, np.int64)
        alone = end - first == 1  # one successor: it is the word or not
        own = np.zeros(len(distinct), np.uint64)
        own[alone] = self.three.get(first[alone]) - base[alone]
        hit = np.flatnonzero(alone[which] & (own[which] == word.astype(np.uint64)))
        out[hit] = first[which[hit]]
        rest = np.flatnonzero((end - first > 1)[which])
        w = which[rest]
        out[rest] = self.three.find(base[w] + word[rest].astype(np.uint64), first[w], end[w])
        return out


class Scorer:
    """A trie's files, memory-mapped, and the scores of texts by them."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.words = Words(trie, True) if trie.words else None
        self.shards: dict[int, Shard] = {}

    def shard(self, s: int) -> Shard | None:
        """A shard that has n-grams, or None; that the file of one is lost is an error."""
        if s not in self.trie.written:
            return None
        if s not in self.shards:
            self.shards[s] = Shard(mapped(f"{self.trie.folder}/grams-{s:04d}"))
        return self.shards[s]

    def _grams(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its probability after the token before (0: not seen), that after the two before, and their back-off."""
        n, v = len(ids), np.uint64(self.trie.words)
        p2, p3, back = np.zeros(n), np.zeros(n), np.ones(n)
        inner = np.ones(n, bool)
        inner[offsets[:-1]] = False
        i = np.flatnonzero(inner)
        i = i[(ids[i] >= 0) & (ids[i - 1] >= 0)]  # tokens with a known one before
        key = ids[i - 1].astype(np.uint64) * v + ids[i].astype(np.uint64)
        distinct, which = np.unique(key, return_inverse=True)
        shard = (mix64(distinct) % np.uint64(self.trie.shards)).astype(np.int64)
        order, cuts = _by_shard(shard, self.trie.shards)
        value, context = np.zeros(len(distinct)), np.full(len(distinct), -1, np.int64)
        rank = np.empty(len(distinct), np.int64)  # of each bigram by shard and, as they are sorted, place there
        rank[order] = np.arange(len(distinct))
        gamma = np.ones(len(distinct))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            one, rows = self.shard(s), order[cuts[s] : cuts[s + 1]]
            if one is None:
                continue
            at = one.two.find(distinct[rows])
            hit = np.flatnonzero(at >= 0)
            context[rows[hit]] = at = at[hit]
            value[rows[hit]] = LEVELS[one.p2[at]]
            gamma[rows[hit]] = WEIGHTS[one.back[at]]
        p2[i] = value[which]
        # a token's context is the bigram that ends before it
        ends = np.full(n, -1, np.int64)
        ends[i] = which
        j = np.flatnonzero(inner & (np.concatenate(([-1], ends[:-1])) >= 0))
        j = j[context[ends[j - 1]] >= 0]
        c = ends[j - 1]
        back[j] = gamma[c]
        known = j[ids[j] >= 0]
        c = ends[known - 1]
        at = rank[c]
        order = np.argsort(at)
        cuts = np.searchsorted(at[order], cuts)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            one, rows = self.shard(s), order[cuts[s] : cuts[s + 1]]
            at = one.successor(context[c[rows]], ids[known[rows]])
            hit = np.flatnonzero(at >= 0)
            p3[known[rows[hit]]] = LEVELS[one.p3[at[hit]]]
        return p2, p3, back

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the texts, and of each token whether it is known, its base probability and its probability."""
        distinct, at, offsets = hashes(texts)
        n, v = self.trie.tokens, self.trie.words
        ids = self.words.ids(distinct) if self.words else np.full(len(distinct), -1, np.int64)
        count = np.zeros(len(distinct))
        known = np.flatnonzero(ids >= 0)
        if len(known):
            count[known] = self.words.of(self.words.counts, ids[known])
        one = ((count + 1) / (n + v + 1))[at]
        p = one
        if len(known):
            successors, left = np.zeros(len(distinct)), np.ones(len(distinct))
            successors[known] = self.words.of(self.words.next, ids[known])
            left[known] = self.words.of(self.words.weight, ids[known])
            kept = np.where(successors > 0, count / np.maximum(count + BACKOFF * successors, 1e-9), 0)
            before = np.concatenate(([0], at[:-1]))
            first = np.zeros(len(at), bool)
            first[offsets[:-1]] = True
            p2, p3, back = self._grams(ids[at], offsets)
            p = p3 + back * (np.where(first, 0, kept[before]) * p2 + np.where(first, 1, left[before]) * one)
        return offsets, (count > 0)[at], one, p

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        offsets, known, one, p = self.probabilities(texts)
        total = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        return np.diff(offsets), total(known.astype(np.int64)), total(np.log10(one)), total(np.log10(p))


_SCORERS: dict[str, Scorer] = {}
CACHES.append(_SCORERS)


def scorer(trie: Trie) -> Scorer:
    """This worker's scorer of a trie; one is kept."""
    if trie.folder not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[trie.folder] = Scorer(trie)
    return _SCORERS[trie.folder]


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts are empty and have their end alone; null ids stay null; repeated rows are each scored; other columns are not
    read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, known, base, full = scorer(trie).score(b.column("text"))
            n = pa.array(np.full(len(size), trie.tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), n, pa.array(base), pa.array(full)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_arrow(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2
    return score(docs, train(docs.where(~out), shared_dir(spark, "grams")), held_out=out)
