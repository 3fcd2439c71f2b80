"""Toxicity of texts: a lexicon trie met by Levenshtein automata, hits weighed by the words around them."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, crc_mod, map_arrow, table

#: Labelled documents of each class that lexicon and weights are fitted on: those whose ids hash smallest.
TRAIN_DOCS = 2000
#: Lexicon terms at most (those of the highest odds; it bounds the automaton), and what a word needs to be one: toxic
#: documents with it, and smoothed log-odds.
TERMS, TERM_DOCS, TERM_ODDS = 400, 4, 2.0
#: States of the automaton that a worker keeps.
STATES = 100_000
#: Words on each side of a hit that belong to its context.
WINDOW = 8

#: Words beside which a term is mentioned, not used.
MENTIONS = frozenset("word words term terms said says quote quoted called slur definition wort begriff sagte zitat mot terme dit citation palabra dijo cita".split())
#: Marks that open or close a quotation.
_QUOTES = re.compile('["“”„«»]')


def edits(length: int) -> int:
    """Misspellings allowed in a term of this length: letters changed, left out or too many, and neighbours swapped."""
    return 0 if length < 5 else 1 if length < 8 else 2


# ---------------------------------------------------------------- the automaton


@dataclass
class Automaton:
    """The intersection of all terms' Levenshtein automata with their trie; its deterministic states are made as words meet them.

    A state is a set of (trie node, edits so far), ~node where a swap that ends there lacks its second letter.  It accepts
    the term of least distance (ties: the first term).  Only the trie travels to workers; a worker keeps the states that it
    has met, ``STATES`` at most, and starts again beyond that.
    """

    terms: list[str]
    may: list[int]  # edits allowed to each term
    swaps: bool
    letters: dict[str, int]
    children: list[dict[str, int]]
    ends: list[int]  # the term that ends at a node, or -1
    before: list[str]  # the last letter but one on the way to a node
    most: list[int]  # edits allowed to any term below

    def closed(self, best: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """A state with all nodes that are reached by leaving letters of a term out."""
        todo = deque(best.items())
        while todo:
            node, e = todo.popleft()
            if node < 0 or best[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < best.get(child, 99):
                    best[child] = e + 1
                    todo.append((child, e + 1))
        return tuple(sorted(best.items()))

    def after(self, state: tuple[tuple[int, int], ...], c: str | None) -> tuple[tuple[int, int], ...]:
        """The state after a letter; None stands for every letter that no term has."""
        best: dict[int, int] = {}
        for node, e in state:
            if node < 0:  # the second letter of a swap
                if c == self.before[~node] and e < best.get(~node, 99):
                    best[~node] = e
                continue
            if e + 1 <= self.most[node] and e + 1 < best.get(node, 99):  # a letter too many
                best[node] = e + 1
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < best.get(child, 99):
                    best[child] = cost
                over = self.children[child].get(c) if self.swaps and letter != c else None
                if over is not None and e + 1 <= self.most[over] and e + 1 < best.get(~over, 99):
                    best[~over] = e + 1
        return self.closed(best)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term number (or -1) and distance for each word; all words walk the automaton side by side."""
        n = len(words)
        if not self.terms or not n:
            return np.full(n, -1), np.zeros(n, np.int64)
        longest = max(map(len, self.terms)) + 2
        length = np.fromiter(map(len, words), np.int64, n)
        fits = np.flatnonzero((length <= longest) & (length > 0))
        codes = np.frombuffer("".join(words[i] for i in fits).encode("utf-32-le"), np.uint32)
        top = max(map(ord, self.letters), default=0) + 1
        column = np.zeros(top + 1, np.int64)
        for c, k in self.letters.items():
            column[ord(c)] = k
        columns = column[np.minimum(codes, top)]
        starts = np.cumsum(length[fits]) - length[fits]
        key = (tuple(self.terms), tuple(self.may), self.swaps)
        if key not in _STATES or len(_STATES[key].sets) > STATES:
            _STATES.clear()
            _STATES[key] = States(self)
        met = _STATES[key]
        state = np.ones(len(fits), np.int64)
        for t in range(longest):
            on = np.flatnonzero((length[fits] > t) & (state > 0))
            if not len(on):
                break
            here = state[on]
            for k in np.unique(here[~met.known[here]]).tolist():
                met.expand(k)
            state[on] = met.moves[here, columns[starts[on] + t]]
        term, distance = np.full(n, -1), np.zeros(n, np.int64)
        term[fits], distance[fits] = met.term[state], met.distance[state]
        return term, distance


class States:
    """The states that words have met: ``moves`` has a row for each and a column for each letter of the lexicon, column 0
    being all other letters; state 0 is dead, state 1 the start."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.sets: list[tuple] = []
        self.number: dict[tuple, int] = {}
        size = 1024
        self.moves = np.zeros((size, len(automaton.letters) + 1), np.int32)
        self.known, self.term, self.distance = np.zeros(size, bool), np.full(size, -1), np.zeros(size, np.int64)
        self._add(())
        self._add(automaton.closed({0: 0}))
        self.known[0] = True

    def _add(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.sets)
            self.sets.append(state)
            if k >= len(self.known):
                grown = lambda a, fill: np.concatenate((a, np.full_like(a, fill)))
                self.moves, self.known, self.term, self.distance = grown(self.moves, 0), grown(self.known, False), grown(self.term, -1), grown(self.distance, 0)
            a = self.automaton
            hits = [(e, a.ends[n]) for n, e in state if n >= 0 and a.ends[n] >= 0 and e <= a.may[a.ends[n]]]
            if hits:
                self.distance[k], self.term[k] = min(hits)
        return k

    def expand(self, k: int) -> None:
        """Find where a state leads; letters that none of its nodes looks for lead where unknown ones do."""
        a, state = self.automaton, self.sets[k]
        near = {c for node, _ in state for c in (a.children[node] if node >= 0 else a.before[~node])}
        if a.swaps:
            near |= {c for node, e in state if node >= 0 for child in a.children[node].values() if e < a.most[child] for c in a.children[child]}
        other = self._add(a.after(state, None))
        row = np.full(len(a.letters) + 1, other, np.int32)
        for c in near:
            row[a.letters[c]] = self._add(a.after(state, c))
        self.moves[k], self.known[k] = row, True


_STATES: dict[tuple, States] = {}
CACHES.append(_STATES)


def build_automaton(terms: list[str], allowed: Callable[[int], int] = edits, swaps: bool = False) -> Automaton:
    """The automaton of the terms; with ``swaps`` two neighbouring letters in each other's place are one edit."""
    children: list[dict[str, int]] = [{}]
    ends, before, most = [-1], [""], [0]
    may = [allowed(len(t)) for t in terms]
    for k, term in enumerate(terms):
        node = 0
        most[0] = max(most[0], may[k])
        for i, c in enumerate(term):
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
                before.append(term[i - 1] if i else "")
                most.append(0)
            node = children[node][c]
            most[node] = max(most[node], may[k])
        if ends[node] < 0:
            ends[node] = k
    letters = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t}))}
    return Automaton(terms, may, swaps, letters, children, ends, before, most)


# ---------------------------------------------------------------- hits and scores


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], list[str], np.ndarray]:
    """(chunk of each token, word of each chunk, chunks, words, offsets): words are the letters of chunks, in lower case."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL]+", "").dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), bare.indices.to_numpy(zero_copy_only=False), coded.dictionary, bare.dictionary.to_pylist(), offsets - offsets[0]


def hits_of(automaton: Automaton, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int, bool]]]]:
    """For each text: its place, its number of words, and its hits as (position, term, distance, mentioned)."""
    at, word, chunks, words, offsets = split_words(texts)
    term, distance = automaton.match(words)
    hit = term[word] >= 0
    places = np.flatnonzero(hit[at])
    first = np.searchsorted(places, offsets)
    for i in range(len(texts)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        found = []
        if first[i + 1] > first[i]:
            tokens = chunks.take(pa.array(at[lo:hi])).to_pylist()
            inside, open_now = [], False
            for t in tokens:
                marks = len(_QUOTES.findall(t)) if not t.isalpha() else 0
                inside.append(open_now or marks > 0)
                open_now ^= bool(marks % 2)
            if open_now:  # an unpaired mark: only words that touch a mark count as quoted
                inside = [bool(_QUOTES.search(t)) for t in tokens]
            for p in places[first[i] : first[i + 1]].tolist():
                k, w = p - lo, word[at[p]]
                near = at[max(lo, p - WINDOW) : min(hi, p + WINDOW + 1)]
                found.append((k, int(term[w]), int(distance[w]), inside[k] or any(words[word[x]] in MENTIONS for x in near)))
        yield i, hi - lo, found


@dataclass
class Model:
    automaton: Automaton
    weight: np.ndarray  # (terms, 2): of exact and of misspelled hits
    beta: np.ndarray
    kept: int = 0

    def features(self, n: int, found: list[tuple[int, int, int, bool]]) -> list[float]:
        """Used, misspelled and mentioned weight, the heaviest window of used hits, and weight per 100 words."""
        exact = fuzzy = mentioned = 0.0
        used: list[tuple[int, float]] = []
        for place, term, distance, quoted in found:
            w = float(self.weight[term, min(distance, 1)])
            if quoted:
                mentioned += w
            else:
                used.append((place, w))
                if distance:
                    fuzzy += w
                else:
                    exact += w
        heavy = total = 0.0
        lo = 0
        for hi, (place, w) in enumerate(used):
            total += w
            while used[lo][0] < place - 2 * WINDOW:
                total -= used[lo][1]
                lo += 1
            heavy = max(heavy, total)
        return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(mentioned), math.log1p(max(0.0, heavy)), math.log1p(100 * (exact + fuzzy) / max(n, 20))]

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = np.array([self.features(n, found) for _, n, found in hits_of(self.automaton, texts)]).reshape(-1, len(self.beta))
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _odds(t: float, c: float, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 30) -> np.ndarray:
    """Regularised logistic regression by Newton's method; all weights but the bias are penalised."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty * len(y) / 100] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge @ beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= step / max(1.0, np.abs(step).max() / 4)
    return beta


def train(texts: list[str], toxic: list[int]) -> Model:
    """Learn the lexicon, its weights and the score from labelled whole texts."""
    column = pa.array(texts, pa.string())
    y = np.array(toxic, float)
    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    seen = [Counter(), Counter()]
    if len(texts):
        at, word, _, words, offsets = split_words(column)
        for i in range(len(texts)):
            seen[int(toxic[i])].update(np.unique(word[at[offsets[i] : offsets[i + 1]]]).tolist())
    ranked = []
    for w, t in seen[1].items():
        odds = _odds(t, seen[0][w], n_toxic, n_clean)
        if words[w] and len(words[w]) > 2 and t >= max(TERM_DOCS, 0.005 * n_toxic) and odds >= TERM_ODDS:
            ranked.append((-odds, words[w]))
    terms = [w for _, w in sorted(ranked)[:TERMS]]
    automaton = build_automaton(terms, swaps=True)
    found = list(hits_of(automaton, column)) if len(texts) else []
    docs = np.zeros((len(terms), 2, 2))
    for i, _, hits in found:
        for term, fuzzy in {(h[1], min(h[2], 1)) for h in hits}:
            docs[term, fuzzy, int(toxic[i])] += 1
    weight = np.array([[max(0.0, _odds(docs[k, f, 1], docs[k, f, 0], n_toxic, n_clean)) for f in (0, 1)] for k in range(len(terms))]).reshape(-1, 2)
    model = Model(automaton, weight, np.zeros(6))
    if n_toxic and n_clean:
        model.beta = logistic(np.array([model.features(n, hits) for _, n, hits in found]), y)
    else:
        model.beta[0] = 5.0 if n_toxic else -5.0
    return model


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``per_label`` whole documents of each class, those whose ids hash smallest.

    Ids with both labels count as toxic; of several rows of an id the least text counts; labels without a document, and
    documents without a label, are left out.  Other columns are not read.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    chosen: dict = {}
    for y in (0, 1):  # an ordered limit of each class, which tasks apply before they send
        chosen |= {r[0]: y for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label).collect()}
    if not chosen:
        return train([], [])
    rows = docs.where(F.col(id_col).isin(list(chosen))).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text")).collect()
    rows.sort(key=lambda r: r[0])
    return train([r[1] for r in rows], [chosen[r[0]] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted of every row.

    Null texts score as empty ones; null ids stay null; repeated rows are each scored; of terms equally near to a word the
    first counts; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, 5) == 0).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return predict(docs, train_on(docs, labels))
