"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Interner, map_arrow, table, texts_of

#: Documents on which cost and selectivity of the rules are estimated: those of the smallest id hashes.
SAMPLE = 400
_SPACE, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be at by this from or an",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y a los del se las por un para con no una su al lo es",
}
_STOP = {w.encode() for line in STOP_WORDS.values() for w in line.split()}


class Text:
    """A text's measures, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def copy(self) -> Text:
        """The same text with the measures computed so far."""
        out = Text(self.raw)
        out.__dict__.update(self.__dict__)
        return out

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        dense = self.raw.translate(None, _SPACE)
        return len(dense) if dense.isascii() else len(dense.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self._lines) - len(set(self._lines))

    @property
    def n_lines(self) -> int:
        return len(self._lines)

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids = np.fromiter(map(Interner().__getitem__, self.words), np.uint64, n)
        if n < 1 << 21:
            win = (ids[:-2] << np.uint64(42)) | (ids[1:-1] << np.uint64(21)) | ids[2:]
        else:  # pairs are numbered first, so that three ids of any size fit
            pair = np.unique((ids[:-1] << np.uint64(32)) | ids[1:], return_inverse=True)[1].astype(np.uint64)
            win = (pair[:-1] << np.uint64(32)) | ids[2:]
        order = np.argsort(win, kind="stable")
        same = win[order][1:] == win[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= twice
        return int(covered.sum())

    @cached_property
    def n_letter_words(self) -> int:
        return sum(w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in self.words)

    def stop_words(self, enough: int) -> int:
        found = 0
        for w in self.words:
            if w.lower() in _STOP:
                found += 1
                if found >= enough:
                    break
        return found


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


MEAN_LENGTH, MAX_SYMBOLS, MAX_DUP_LINES, MIN_LETTER_WORDS, MIN_STOP_WORDS = (2, 12), 0.1, 0.5, 0.6, 2

BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    Rule("word_length", lambda t: not MEAN_LENGTH[0] * t.n_words <= t.word_chars <= MEAN_LENGTH[1] * t.n_words),
    Rule("symbols", lambda t: t.n_symbols > MAX_SYMBOLS * t.n_words),
    Rule("repeated_lines", lambda t: t.n_dup_lines > MAX_DUP_LINES * t.n_lines),
    Rule("letter_words", lambda t: t.n_letter_words < MIN_LETTER_WORDS * t.n_words),
    Rule("stop_words", lambda t: t.stop_words(MIN_STOP_WORDS) < MIN_STOP_WORDS),
)


def order_rules(texts: list[bytes], rules: tuple[Rule, ...], clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """Greedy order: next comes the rule that rejects most of those still left, per second of its cost on them.

    A rule's cost counts only what the rules before it have not computed: a text keeps the measures of those in front.
    """
    left, todo, out = [Text(x) for x in texts], list(rules), []
    while todo:
        best = None
        for rule in todo:
            fresh = [t.copy() for t in left]
            began = clock()
            kept = [t for t in fresh if not rule.rejects(t)]
            cost = max(clock() - began, 1e-9)
            score = ((len(left) - len(kept)) / cost, -cost)
            if best is None or score > best[0]:
                best = (score, rule, kept)
        _, rule, left = best
        todo.remove(rule)
        out.append(rule)
    return out


def sample_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SAMPLE) -> list[bytes]:
    """Whole texts of ``size`` documents at most, those whose ids hash smallest; of several rows of an id the least text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = [r[0] for r in rows.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(size).collect()]
    found = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("text").alias("text")).collect() if ids else []
    return [r["text"].encode() for r in sorted(found, key=lambda r: r["id"])]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects; a row's rules run in the cascade's order until one rejects it.

    The order never changes what is kept, only what it costs.  Null texts count as empty (and have too few words); null ids,
    repeated rows and other columns pass through; an empty table stays empty.
    """
    ordered = order_rules(sample_texts(docs, id_col, text), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for raw in texts_of(b, text):
                t = Text(raw)
                keep.append(not any(r.rejects(t) for r in ordered))
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the base measures, whether a base rule fails, and the verdict of base rules and cascade.

    Null texts count as empty; a repeated row is measured each time; null ids stay null; other columns are not read; an
    empty table gives no rows.  A text that a base rule fails runs no other rule.
    """
    ordered = order_rules(sample_texts(docs, id_col, text), rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {n: [] for n in names}
            failed, kept = [], []
            for raw in texts_of(b, "text"):
                t = Text(raw)
                for n in names:
                    cols[n].append(getattr(t, n))
                failed.append(any(r.rejects(t) for r in BASE))
                kept.append(not failed[-1] and not any(r.rejects(t) for r in ordered))
            out = [b.column("doc_id"), *(pa.array(cols[n], pa.int64()) for n in names), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


_W = r"'[^\x20\x09-\x0D]+'"
_STOP_SQL = ", ".join(f"'{w.decode()}'" for w in sorted(_STOP))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
pos AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d),
win AS (SELECT doc_id, p, word AS a, lead(word) OVER x AS b, lead(word, 2) OVER x AS c FROM pos WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE n > 1) GROUP BY 1),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_W}) GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN lin ON d.doc_id = lin.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN {MEAN_LENGTH[0]} * n_words AND {MEAN_LENGTH[1]} * n_words
  AND n_symbols <= {MAX_SYMBOLS} * n_words AND n_dup_lines <= {MAX_DUP_LINES} * n_lines
  AND n_letter >= {MIN_LETTER_WORDS} * n_words AND n_stop >= {MIN_STOP_WORDS} AS kept
FROM f
"""
