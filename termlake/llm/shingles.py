"""Jaccard join of documents on word shingles by grouped prefixes.

A document's distinct shingles are put in one order for all documents, rare ones first.  Two sets that reach the
threshold share a shingle in their prefixes.  Documents with equal sets are one class, classes with equal size and prefix
one group; groups that share a prefix shingle and pass the length and position filters are paired, expanded to their
classes, and those are compared whole.

Only connection matters to the result, so pairs come in two steps.  First each posting list gives pairs with one leader,
the group that has the shingle earliest in its prefix: of a family of near copies that is the one with the fewest changes.
Then, with the components of the first links known, all pairs are formed whose classes are neither connected nor compared yet.  No link
is lost: a link between connected classes adds nothing, all others are tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, grouped, map_arrow, mix64, table
from .components import components
from .ngrams import bundle, unbundle

WORDS = 5
#: Jaccard similarity of at least PERCENT / 100.
PERCENT = 75
#: Slots of the sketch that orders shingles by frequency, and bits of the filter of classes to compare; fixed, 4 and 8 MB.
SKETCH, FILTER = 1 << 22, 1 << 26
#: Shingles after which a task sends on what it has counted.
FLUSH = 2_000_000
#: Prefix shingles of a bucket of posting lists, on average.
BUCKET = 1_000_000
#: Posting lists of up to so many groups are searched for postings that pass the filters with no other.
SHORT_RUN = 16
_FACTOR = 0x9E3779B97F4A7C15


def shingles(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, not yet distinct, and the document of each; shorter texts are one shingle as a whole."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    words = pc.ascii_lower(coded.dictionary).cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    full = np.fromiter(map(bool, words), bool, len(words))
    at = coded.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    keep = full[at] if len(at) else np.zeros(0, bool)
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    w = h[at[keep]] if len(at) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    size = np.minimum(n, width)[doc]
    out = size.astype(np.uint64)
    for k in range(width):
        more = start + k < len(w)
        word = np.where(more & (k < size), w[np.minimum(start + k, max(len(w) - 1, 0))], np.uint64(0)) if len(w) else out
        out = out * np.uint64(_FACTOR) + word
    return mix64(out), doc


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(5)) % np.uint64(SKETCH)).astype(np.int64)


def ordered_sets(texts: pa.Array, levels: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Of each document its distinct shingles in the common order, as ascending integers.

    An integer is the shingle's frequency level in the top 5 bits and 59 bits of its hash below, so it names the shingle
    and its place in the order at once, in all documents alike.
    """
    h, doc = shingles(texts, width)
    key = (np.minimum(levels[_slot(h)], 31).astype(np.uint64) << np.uint64(59)) | (h >> np.uint64(5))
    ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    out, at = [], 0
    for end in ends:
        s = np.sort(key[at:end])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if end - at > 1 else s)
        at = end
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def frequency_levels(texts: DataFrame, width: int = WORDS) -> np.ndarray:
    """For each slot of the sketch the binary logarithm of its most frequent shingle's count, 0 for rare ones.

    Tasks count exactly what they read between two flushes and send shingles seen twice or more; the rest cannot be
    frequent there.  The sketch only orders shingles, any order gives right results.  It is summed up in as many parts as
    shuffles have.
    """
    parts = min(SKETCH, 1 << max(4, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            k = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held.clear()
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(k)))
            k, n = k[first[n > 1]], n[n > 1]
            part = _slot(k) // (SKETCH // parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bundle([np.diff(k[mine], prepend=np.uint64(0)), n[mine].astype(np.uint32)])], pa.binary())], names=["part", "block"])

        size = 0
        for b in batches:
            held.append(shingles(b.column("text"), width)[0])
            size += len(held[-1])
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    def level(key, data):
        keys, counts = [], []
        for block in data.column("block"):
            d, n = unbundle(block.as_py(), ["<u8", "<u4"])
            keys.append(np.cumsum(d, dtype=np.uint64))
            counts.append(n.astype(np.int64))
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        total = np.add.reduceat(n, first)
        out = np.zeros(SKETCH // parts, np.uint8)
        np.maximum.at(out, _slot(k[first]) - key[0].as_py() * (SKETCH // parts), np.log2(total).astype(np.uint8))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})

    found = map_arrow(texts, count, "part int, block binary").repartition(parts, "part").groupBy("part").applyInArrow(grouped(level), "part int, levels binary").collect()
    out = np.zeros((parts, SKETCH // parts), np.uint8)
    for r in found:
        out[r.part] = np.frombuffer(r.levels, np.uint8)
    return out.ravel()


def _digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _group(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x[: prefix_length(len(x))].tobytes(), seed=len(x))


def signature(x: np.ndarray) -> bytes:
    """A bit for each shingle, at its hash modulo the power of two from 1.5 times the set's size on."""
    flags = np.zeros(max(8, 1 << (3 * len(x) // 2).bit_length()), bool)
    flags[(x & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def may_link(n: int, one: bytes, m: int, two: bytes, percent: int = PERCENT) -> bool:
    """Whether sets of these sizes and signatures can reach the threshold; never False for sets that do.

    A bit that one signature has alone stands for a shingle that the other set lacks.  The longer signature is folded
    to the length of the shorter, which is the signature that its set has at that length.
    """
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size)) for x in (a, b))
    common = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * common >= percent * (n + m - common)


def _members(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, n, cls (16 bytes that name the set), grp (16 that name size and prefix), sig (its signature) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = ordered_sets(b.column("text"), levels)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(list(map(f, sets)), pa.binary()) for f in (_digest, _group, signature))],
                names=["doc_id", "n", "cls", "grp", "sig"],
            )

    return map_arrow(texts, run, "doc_id long, n long, cls binary, grp binary, sig binary")


def _postings(texts: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """shingle, grp, n, pos of all prefix shingles that two groups or more have; postings that fit no other are left out of short lists."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        sizes, keys, owners, places = [], [], [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if keys:
                k, o, p = np.concatenate(keys), np.repeat(np.arange(len(keys)), list(map(len, keys))).astype(np.uint32), np.concatenate(places)
                names, n = np.frombuffer(b"".join(seen), "<u8").reshape(-1, 2), np.array(sizes, np.uint32)
                bucket = (mix64(k) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((k, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for s in range(buckets):
                    rows = order[cuts[s] : cuts[s + 1]]
                    if len(rows):
                        local, at = np.unique(o[rows], return_inverse=True)
                        block = bundle([np.diff(k[rows], prepend=np.uint64(0)), at.astype(np.uint32), p[rows].astype(np.uint32), n[local], np.ascontiguousarray(names[local, 0]), np.ascontiguousarray(names[local, 1])])
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])
            seen.clear(), sizes.clear(), keys.clear(), owners.clear(), places.clear()
            held = 0

        for b in batches:
            for s in ordered_sets(b.column("text"), levels):
                if len(s):
                    g = _group(s)
                    if g not in seen:
                        seen[g] = len(seen)
                        head = s[: prefix_length(len(s))]
                        sizes.append(len(s))
                        keys.append(head)
                        places.append(np.arange(len(head), dtype=np.uint32))
                        held += len(head)
            if held > FLUSH:
                yield from flush()
        yield from flush()

    def meet(key, data):
        parts = []
        for block in data.column("block"):
            d, at, p, n, a, c = unbundle(block.as_py(), ["<u8", "<u4", "<u4", "<u4", "<u8", "<u8"])
            parts.append((np.cumsum(d, dtype=np.uint64), p, n[at], a[at], c[at]))
        k, p, n, a, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((c, a, k))
        k, p, n, a, c = (x[order] for x in (k, p, n, a, c))
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])))  # one group may come from several tasks
        k, p, n, a, c = (x[fresh] for x in (k, p, n, a, c))
        order = np.lexsort((n, k))
        k, p, n, a, c = (x[order] for x in (k, p, n, a, c))
        n, p = n.astype(np.int64), p.astype(np.int64)
        run = np.cumsum(np.concatenate(([True], k[1:] != k[:-1]))) - 1
        long = np.bincount(run)[run] > SHORT_RUN
        many = long.copy()
        for step in range(1, SHORT_RUN):  # of short lists only postings that fit some other, in ascending size
            i = np.flatnonzero((run[step:] == run[:-step]) & ~long[step:])
            j = i + step
            fits = (100 * n[i] >= PERCENT * n[j]) & ((100 + PERCENT) * np.minimum(n[i] - p[i], n[j] - p[j]) >= PERCENT * (n[i] + n[j]))
            many[i[fits]] = True
            many[j[fits]] = True
        names = np.stack([a[many], c[many]], 1).astype("<u8")
        raw = names.tobytes()
        return pa.table({"shingle": pa.array(k[many].view(np.int64)), "grp": pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), "n": pa.array(n[many], pa.int64()), "pos": pa.array(p[many], pa.int64())})

    blocks = map_arrow(texts, split, "bucket int, block binary").repartition(buckets, "bucket")
    return blocks.groupBy("bucket").applyInArrow(grouped(meet), "shingle long, grp binary, n long, pos long")


def _sets(texts: DataFrame, levels: np.ndarray, pairs: DataFrame) -> DataFrame:
    """cls, set of the classes that stand in ``pairs``, and of few others: a filter of fixed size picks them while texts are read again."""
    place = F.pmod(F.conv(F.substring(F.hex("cls"), 1, 15), 16, 10).cast("long"), F.lit(FILTER))
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
    words = wanted.select(place.alias("p")).selectExpr("cast(p div 64 as int) AS w", "shiftleft(1L, cast(p % 64 as int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    bits = bits.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            names, sets = [], []
            for s in ordered_sets(b.column("text"), levels):
                cls = _digest(s)
                at = int(cls.hex()[:15], 16) % FILTER
                if int(bits[at >> 6]) >> (at & 63) & 1 and cls not in sent:
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(cls)
                    names.append(cls)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "set"])

    return map_arrow(texts.select("text"), run, "cls binary, set binary").groupBy("cls").agg(F.first("set").alias("set"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _fits(a: str, b: str) -> str:
    """Length filter and position filter of a shared prefix shingle, as SQL."""
    small, large = f"least({a}.n, {b}.n)", f"greatest({a}.n, {b}.n)"
    rest = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return f"100 * {small} >= {PERCENT} * {large} AND {100 + PERCENT} * {rest} >= {PERCENT} * ({a}.n + {b}.n)"


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that their signatures do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)
            chosen = pa.array([may_link(*r) for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    known = classes.select("cls", "n", "sig")
    both = pairs.join(known.toDF("b", "m", "y"), "b").join(known.toDF("a", "n", "x"), "a")
    return map_arrow(both.select("a", "b", "n", "x", "m", "y"), run, "a binary, b binary")


def _verify(pairs: DataFrame, texts: DataFrame, levels: np.ndarray, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold; whole sets are sent only of pairs that may."""
    if pairs.isEmpty():
        return pairs
    pairs = cut(_possible(pairs, classes), scratch)
    if pairs.isEmpty():
        return pairs
    sets = _sets(texts, levels, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((one, two))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(both) - common))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    whole = pairs.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a")
    return map_arrow(whole.select("a", "b", "x", "y"), run, "a binary, b binary", 256)


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id that links reach.

    Words are lower-cased in A-Z and stand between ASCII white space.  Null and blank texts have no shingles and link with
    nothing, not even each other.  Repeated rows and equal sets are one class and one component.  Null ids stay null and
    never are a component's id unless it has no other.  Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession)
    levels = frequency_levels(texts.select("text"))
    members = cut(_members(texts, levels))
    size = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(size) // (4 * BUCKET)))
    runs = cut(_postings(texts.select("text"), levels, buckets), scratch)
    classes = cut(members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("sig").alias("sig")), scratch)
    several = classes.groupBy("grp").agg(F.count("*").alias("c"), F.min("cls").alias("lead")).where("c > 1")

    # first links: each posting list with its leader, each group of several classes with its first
    lead = runs.groupBy("shingle").agg(F.min(F.struct("pos", "grp", "n")).alias("l")).select("shingle", F.col("l.grp").alias("grp"), F.col("l.n").alias("n"), F.col("l.pos").alias("pos"))
    near = runs.alias("a").join(lead.alias("b"), "shingle").where(f"a.grp <> b.grp AND {_fits('a', 'b')}").select(F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb")).distinct()
    firsts = classes.groupBy("grp").agg(F.min("cls").alias("first"))
    one = near.join(firsts.select(F.col("grp").alias("gb"), F.col("first").alias("b")), "gb").join(classes.select(F.col("grp").alias("ga"), F.col("cls").alias("a")), "ga").select("a", "b")
    own = classes.select("cls", "grp").join(several, "grp").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    tested = cut(_ordered(one.union(own)).distinct(), scratch)
    links = cut(_verify(tested, texts, levels, classes, scratch), scratch)
    parts = cut(components(links, "a", "b"), scratch)

    # the rest: pairs of groups, and of classes inside a group, that are not connected yet
    named = cut(classes.select("cls", "grp").join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "grp", F.coalesce("component", "cls").alias("label")), scratch)
    spans = named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    marked = runs.join(spans, "grp")
    mixed = marked.groupBy("shingle").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("shingle")
    marked = cut(marked.join(mixed, "shingle", "left_semi"), scratch)
    apart = "NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)"
    rest = marked.alias("a").join(marked.alias("b"), "shingle").where(f"a.grp < b.grp AND {apart} AND {_fits('a', 'b')}").select(F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb")).distinct()
    left, right = named.select(F.col("grp").alias("ga"), F.col("cls").alias("a"), F.col("label").alias("la")), named.select(F.col("grp").alias("gb"), F.col("cls").alias("b"), F.col("label").alias("lb"))
    cross = rest.join(left, "ga").join(right, "gb").where("la <> lb").select("a", "b")
    inside = named.join(spans.where("lo <> hi").select("grp"), "grp", "left_semi")
    inside = inside.alias("x").join(inside.alias("y"), "grp").where("x.cls < y.cls AND x.label <> y.label").select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    later = _ordered(cross.union(inside)).distinct().join(tested, ["a", "b"], "left_anti")
    links = links.union(_verify(cut(later, scratch), texts, levels, classes, scratch))
    parts = components(links, "a", "b").withColumnRenamed("node", "cls")

    grouped = classes.select("cls", "low").join(parts, "cls", "left").select("cls", "low", F.coalesce("component", "cls").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    found = cut(grouped.join(lowest, "component").select("cls", "component_id"))
    scratch.clear()
    some = members.where("n > 0").join(found, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
