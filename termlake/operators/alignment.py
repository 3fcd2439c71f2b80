"""Terms and chunks found in word alignments, a segment at a time.

An alignment has the rows seg, start, end, word, or one row for a segment that holds its words as an array.  Rows of words,
utterances and phrases of a segment meet in one shuffle by seg, sorted there; whole segments need none.  A task passes over them
once and holds the keys and times of one segment.  A place is looked up by a phrase's first two tokens, then by as many tokens
as a phrase that begins so has, so repeated texts cost no more than others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Kinds of a segment's rows, in the order in which they are read.
_WORD, _UTTERANCE, _PHRASE = 0, 1, 2
#: Words whose keys a worker remembers, and the letters of one at most.
_KNOWN, _LETTERS = 131_072, 64
_OTHER = re.compile("[^a-z0-9']+")


def word_key(word: str) -> str:
    """Lower case, without a final 's, of letters a-z, digits and apostrophes only."""
    if word.isascii() and word.isalnum():  # as most are
        return word.lower()
    return _OTHER.sub("", word.lower().replace("’", "'").strip().removesuffix("'s"))


class _Keys(dict):
    """The key of each word, computed once; emptied when it is full."""

    def __missing__(self, word: str) -> str:
        key = word_key(word)
        if len(word) <= _LETTERS:
            if len(self) >= _KNOWN:
                self.clear()
            self[word] = key
        return key

    def of(self, words: Iterable[str]) -> tuple[str, ...]:
        return tuple(filter(None, map(self.__getitem__, words)))


_keys = _Keys()


def phrase_keys(text: str | None) -> tuple[str, ...]:
    """Keys of the words of a text."""
    return _keys.of((text or "").split())


def phrase_variants(text: str | None) -> list[tuple[str, ...]]:
    """The keys of a text's words, then those of its parts between punctuation, if these differ; empty ones are none."""
    parts = _OTHER.split((text or "").lower().replace("’", "'"))
    return list(dict.fromkeys(v for v in (phrase_keys(text), _keys.of(parts)) if v))


def _places(keys: Sequence[str], phrases: Iterable[tuple[str, ...]]) -> dict[tuple[str, ...], list[int]]:
    """All places of each phrase among the keys, in order; one pass over the keys, whatever repeats."""
    out: dict[tuple[str, ...], list[int]] = {p: [] for p in phrases}
    ones, sizes = {p[0] for p in out if len(p) == 1}, {}
    for p in out:
        if len(p) > 1:
            sizes.setdefault(p[:2], set()).add(len(p))
    for i, pair in enumerate(zip(keys, [*keys[1:], None], strict=True)):
        if pair[0] in ones:
            out[pair[:1]].append(i)
        for n in sizes.get(pair, ()):
            places = out.get(tuple(keys[i : i + n]))
            if places is not None:
                places.append(i)
    return out


def _met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """seg, start, end and key of the words, keys of the utterances, and phrases of each segment that has words and phrases; rows sorted by seg and kind."""
    last, parts = None, ([], [], [], [], [])
    for b in batches:
        runs = pc.run_end_encode(b.column("seg"))
        kind = b.column("kind").to_numpy()
        start, end = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("start", "end"))
        key = ["" if w is None else _keys[w] for w in b.column("word").to_pylist()]
        lo = 0
        for seg, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if seg != last:
                if parts[2] and parts[4]:
                    yield last, *parts
                last, parts = seg, ([], [], [], [], [])
            words, said = (lo + int(i) for i in np.searchsorted(kind[lo:hi], (_UTTERANCE, _PHRASE)))
            keyed = [i for i in range(lo, words) if key[i]]  # words without a key have no number
            for own, column in zip(parts, (start, end, key), strict=False):
                own += [column[i] for i in keyed]
            parts[3].extend(phrase_keys(u) for u in b.column("utterance").slice(words, said - words).to_pylist())
            parts[4].extend(b.column("p").slice(said, hi - said).to_pylist())
            lo = hi
    if parts[2] and parts[4]:
        yield last, *parts


def _met_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The same of whole segments (seg, words, phrases, utterance), of which those of one seg follow each other."""
    last, parts = None, None

    def one():
        start, end, key, said, own = parts
        if len(start) == 1:
            return last, start[0], end[0], key[0], said, own
        start, end, key = np.concatenate(start), np.concatenate(end), [k for keys in key for k in keys]
        order = np.lexsort((end, start))
        return last, start[order], end[order], [key[i] for i in order], said, own

    for b in batches:
        words, phrases = b.column("words"), b.column("phrases")
        start, end = (words.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        coded = words.values.field("word").dictionary_encode()
        key = np.array([word_key(w) for w in coded.dictionary.to_pylist()] + [""], object)  # the last for null
        code = coded.indices.fill_null(len(key) - 1).to_numpy()
        has = np.array([k != "" for k in key])[code]
        word_at, phrase_at, said = words.offsets.to_pylist(), phrases.offsets.to_pylist(), b.column("utterance").to_pylist()
        for i, seg in enumerate(b.column("seg").to_pylist()):
            if parts is None or seg != last:
                if parts and any(map(len, parts[2])) and parts[4]:
                    yield one()
                last, parts = seg, ([], [], [], [], [])
            keyed = word_at[i] + np.flatnonzero(has[word_at[i] : word_at[i + 1]])  # words without a key have no number
            for own, values in zip(parts, (start[keyed], end[keyed], key[code[keyed]].tolist()), strict=False):
                own.append(values)
            parts[3].append(phrase_keys(said[i]))
            parts[4].extend(phrases.values.slice(phrase_at[i], phrase_at[i + 1] - phrase_at[i]).to_pylist())
    if parts and any(map(len, parts[2])) and parts[4]:
        yield one()


def _look(rows: DataFrame, met: Callable, seg: StructField, phrase: StructField, find: Callable[..., Iterator[tuple]], fields: str) -> DataFrame:
    """seg, phrase and the fields of the rows that ``find(start, end, key, utterances, phrases)`` gives of each segment met."""
    out = StructType([seg, phrase, *StructType.fromDDL(fields)])
    schema = to_arrow_schema(out)
    batch = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def look(batches):
        found = []
        for at, *segment in met(batches):
            found += [(at, *row) for row in find(*segment)]
            if len(found) >= 8192:
                yield batch(found)
                found = []
        if found:
            yield batch(found)

    return rows.mapInArrow(look, out)


def _by_segment(alignment: DataFrame, phrases: DataFrame, utterances: DataFrame | None, find: Callable[..., Iterator[tuple]], fields: str) -> DataFrame:
    """What ``find`` gives of rows of words, of phrases (seg, phrase and what it needs of them) and of utterances (seg, utterance)."""
    words = alignment.select("seg", F.lit(_WORD).alias("kind"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "word")
    p = F.struct(*[F.col(c) for c in phrases.columns if c != "seg"])
    rows = words.unionByName(phrases.select("seg", F.lit(_PHRASE).alias("kind"), p.alias("p")), allowMissingColumns=True)
    said = utterances if utterances is not None else phrases.select("seg", F.lit(None).cast("string").alias("utterance")).limit(0)
    rows = rows.unionByName(said.select("seg", F.lit(_UTTERANCE).alias("kind"), "utterance"), allowMissingColumns=True).where("seg IS NOT NULL")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seg").sortWithinPartitions("seg", "kind", "start", "end")
    return _look(rows, _met_rows, phrases.schema["seg"], phrases.schema["phrase"], find, fields)


def _whole(segments: DataFrame, find: Callable[..., Iterator[tuple]], fields: str) -> DataFrame:
    """What ``find`` gives of whole segments.

    They have seg, words (array of start, end, word in order of time), phrases (array of phrase and what ``find`` needs of
    them) and utterance; several rows of one seg follow each other in one partition.
    """
    phrase = segments.schema["phrases"].dataType.elementType["phrase"]
    return _look(segments.where("seg IS NOT NULL").select("seg", "words", "phrases", "utterance"), _met_whole, segments.schema["seg"], phrase, find, fields)


def term_spans(alignment: DataFrame, terms: DataFrame, utterances: DataFrame | None = None, expand: int = 8) -> DataFrame:
    """seg, phrase, how, first, last, start, end: where each term stands in its segment; terms (seg, phrase, term).

    The first place of the first variant of the term that has one counts (``words``).  With the columns chunk_text and
    chunk_idx, places within ``expand`` words of the chunk's text come before all others (``anchored``; of the text's places
    that of the chunk's number, or the last), and spans of no length do not count.  Failing that, with ``utterances`` (seg,
    utterance), a term's place among the utterance's words counts if they are as many as the segment's (``positional``).
    Terms without a place have no row, nor have null or empty ones; (seg, phrase) is one term.
    """
    anchored = {"chunk_text", "chunk_idx"} <= set(terms.columns)
    phrases = terms.select("seg", "phrase", "term", *(["chunk_text", "chunk_idx"] if anchored else []))
    return _by_segment(alignment, phrases, utterances, _spans(anchored, expand), _SPAN)


def term_spans_of(segments: DataFrame, expand: int = 8) -> DataFrame:
    """``term_spans`` of whole segments, without a shuffle; phrases of phrase, term and maybe chunk_text and chunk_idx."""
    fields = segments.schema["phrases"].dataType.elementType.fieldNames()
    return _whole(segments, _spans({"chunk_text", "chunk_idx"} <= set(fields), expand), _SPAN)


_SPAN = "how string, first int, last int, start double, end double"


def _spans(anchored: bool, expand: int) -> Callable[..., Iterator[tuple]]:
    def spans(start, end, key, spoken, own):
        tuples = [(phrase_variants(p["term"]), phrase_variants(p["chunk_text"]) if anchored else []) for p in own]
        places = _places(key, (v for both in tuples for side in both for v in side))
        counts = lambda at, n: not anchored or end[at + n - 1] > start[at]
        found, missed = {}, []  # how, first and number of words of each phrase
        for p, (variants, chunks) in enumerate(tuples):
            lo = hi = None
            for text in chunks:
                if at := places[text]:
                    lo = at[min(max(own[p]["chunk_idx"] or 0, 0), len(at) - 1)] - expand
                    hi = lo + len(text) + 2 * expand
                    break
            firsts = []  # how, variant, first, words
            for n, v in enumerate(variants):
                if at := places[v]:
                    firsts.append((1, n, at[0], len(v)))
                    near = bisect_left(at, lo) if lo is not None else len(at)
                    if near < len(at) and at[near] + len(v) <= hi:
                        firsts.append((0, n, at[near], len(v)))
            if best := min((f for f in firsts if counts(*f[2:])), default=None):
                found[p] = (("anchored", "words")[best[0]], *best[2:])
            else:
                missed.append(p)
        aloud = [_places(k, (v for p in missed for v in tuples[p][0])) for k in spoken if missed and len(k) == len(key)]
        for p in missed:
            firsts = [(n, k[v][0], len(v)) for k in aloud for n, v in enumerate(tuples[p][0]) if k[v]]
            if best := min((f for f in firsts if counts(*f[1:])), default=None):
                found[p] = ("positional", *best[1:])
        for p, (how, at, n) in found.items():
            yield own[p]["phrase"], how, at, at + n - 1, start[at], end[at + n - 1]

    return spans


def chunk_starts(alignment: DataFrame, chunks: DataFrame, seconds: float) -> DataFrame:
    """seg, phrase, chunk_start: chunks (seg, phrase, chunk_text) of so many seconds, whose words' middles lie within them.

    The middle of the times that this leaves for the start, from ``seconds`` before the last word's middle (0 at least) to
    the first word's middle; the former where that is later.  The first place of the text in its segment counts.
    """
    return _by_segment(alignment, chunks.select("seg", "phrase", "chunk_text"), None, _starts(seconds), "chunk_start double")


def chunk_starts_of(segments: DataFrame, seconds: float) -> DataFrame:
    """``chunk_starts`` of whole segments, without a shuffle; phrases of phrase and chunk_text."""
    return _whole(segments, _starts(seconds), "chunk_start double")


def _starts(seconds: float) -> Callable[..., Iterator[tuple]]:
    def starts(start, end, key, _, own):
        texts = [phrase_keys(p["chunk_text"]) for p in own]
        places = _places(key, filter(None, texts))
        for p, text in zip(own, texts, strict=True):
            if at := places.get(text):
                last = at[0] + len(text) - 1
                hi, lo = (start[at[0]] + end[at[0]]) / 2, max(0.0, (start[last] + end[last]) / 2 - seconds)
                yield p["phrase"], lo if lo > hi else (lo + hi) / 2

    return starts


def spans_in_chunks(spans: DataFrame, starts: DataFrame, seconds: float, slack: float = 0.1) -> DataFrame:
    """seg, phrase, duration, start_in_chunk, end_in_chunk: spans by their chunk's start, cut to it; null where it has none or they stand out by more than ``slack``."""
    a, z = F.col("start") - F.col("chunk_start"), F.col("end") - F.col("chunk_start")
    fits = (a >= -slack) & (z <= seconds + slack)
    place = [F.when(fits, F.round(F.greatest(F.lit(0.0), a), 4)).alias("start_in_chunk"), F.when(fits, F.round(F.least(F.lit(seconds), z), 4)).alias("end_in_chunk")]
    return spans.join(starts, ["seg", "phrase"], "left").select("seg", "phrase", F.round(F.col("end") - F.col("start"), 4).alias("duration"), *place)


def spread_evenly(rest: DataFrame, chunks: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rest`` with chunk_idx: of n rows of a key and c chunks, max(1, n // c) in a row go to each chunk, what is left to the last.

    ``chunks``: by, n_chunks; keys without chunks have no rows.
    """
    one = Window.partitionBy(*by)
    place, n = F.row_number().over(one.orderBy(order)) - 1, F.count("*").over(one)
    dealt = rest.join(chunks.select(*by, "n_chunks").where("n_chunks > 0"), by).withColumn("__k", place).withColumn("__n", n)
    each = F.greatest(F.floor(F.col("__n") / F.col("n_chunks")), F.lit(1))
    return dealt.withColumn("chunk_idx", F.least(F.floor(F.col("__k") / each), F.col("n_chunks") - 1).cast("int")).drop("__k", "__n", "n_chunks")
