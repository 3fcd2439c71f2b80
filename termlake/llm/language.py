"""Language of each word by a linear-chain conditional random field, and of each document by its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, mix64, table

#: Labelled documents of each language that the model is fitted on: those whose ids hash smallest.
TRAIN_DOCS = 150
#: Words of each language's lexicon at most (the most frequent), the counts and the share of one language that they need.
LEXICON, LEXICON_COUNT, LEXICON_SHARE = 2000, 5, 0.9
#: Feature buckets, and cells of the weights (buckets times labels, 4 bytes each) at most: many labels get fewer buckets.
BUCKETS, CELLS = 1 << 18, 1 << 24
GRAM = 4
AFFIX = 4
STEPS = (25, 15)
BLOCK = 256
UNKNOWN = "und"
#: Documents whose language gets less than this share of their words' probability are rejected by ``keep``.
MIN_SCORE = 0.4
#: Bytes of text labelled at once with four labels or fewer; with more labels as much less.
BATCH_BYTES = 1 << 20


# ---------------------------------------------------------------- words


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the distinct word of each token, the distinct words, offsets of the texts).

    Words stand between ASCII white space; in lower case and without all that is no letter, so some are empty.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL]+", "").dictionary_encode()
    at = bare.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    offsets = split.offsets.to_numpy().astype(np.int64)
    return at, bare.dictionary.to_pylist(), offsets - offsets[0]


def buckets_for(labels: int) -> int:
    return min(BUCKETS, 1 << (CELLS // max(labels, 1)).bit_length() - 1)


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and affixes of the words, word after word, and each word's first place (plus the end)."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(length)
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes))
    first, last = (ends - length)[word], ends[word]
    marks, owners = [], []
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAM, AFFIX) + 1):
        gram = gram * np.uint64(0x100000001B3)
        gram[: len(codes) - n + 1] += codes[n - 1 :] + np.uint64(n)
        whole = place + n <= last
        inner = whole & (place > first) & (place + n < last)
        if n <= GRAM:
            marks.append(gram[inner])
            owners.append(word[inner])
        if 2 <= n <= AFFIX:
            edge = whole & ((place == first) | (place + n == last))
            marks.append(gram[edge] ^ np.uint64(0xA5A5 << 32))
            owners.append(word[edge])
    owner, mark = np.concatenate(owners), np.concatenate(marks)
    order = np.argsort(owner, kind="stable")
    bucket = (mix64(mark[order]) % np.uint64(buckets)).astype(np.int32)
    return bucket, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive starts."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


def word_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word the sum of its features' rows of ``table``, label by label; every word has a feature."""
    if len(starts) < 2:
        return np.zeros((0, table.shape[1]))
    return np.stack([np.add.reduceat(table[:, y][rows], starts[:-1], dtype=np.float64) for y in range(table.shape[1])], 1)


# ---------------------------------------------------------------- the chain


def forward_backward(potential: np.ndarray, step: np.ndarray, reset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward vectors of all words of all texts at once.

    ``potential`` (words, labels) and ``step`` (labels, labels) are positive; where ``reset``, a text starts, from any label
    alike.  The words are cut into blocks; each block's product of matrices comes first, over all blocks together, then the
    vectors between blocks, then those inside.  This is exact, and no long text makes a long loop.
    """
    n, k = potential.shape
    width = max(1, -(-n // BLOCK))
    size = min(BLOCK, n)
    total = width * size
    e = np.ones((total, k))
    e[:n] = potential
    r = np.ones(total, bool)
    r[:n] = reset
    e, r = e.reshape(width, size, k), r.reshape(width, size)
    product = np.broadcast_to(np.eye(k), (width, k, k)).copy()
    for t in range(size):
        go = np.where(r[:, t, None, None], product.sum(2, keepdims=True) / k, product @ step) * e[:, t, None, :]
        product = go / go.sum((1, 2), keepdims=True)
    enter, leave = np.empty((width, k)), np.empty((width, k))
    v = np.full(k, 1 / k)
    for b in range(width):
        enter[b] = v
        v = v @ product[b]
        v = v / v.sum()
    v = np.full(k, 1 / k)
    for b in range(width - 1, -1, -1):
        leave[b] = v
        v = product[b] @ v
        v = v / v.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = enter
    for t in range(size):
        v = np.where(r[:, t, None], 1 / k, v @ step) * e[:, t]
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    v = leave
    for t in range(size - 1, -1, -1):
        beta[:, t] = v
        w = e[:, t] * v
        v = np.where(r[:, t, None], w.sum(1, keepdims=True), w @ step.T)
        v = v / v.sum(1, keepdims=True)
    return alpha.reshape(total, k)[:n], beta.reshape(total, k)[:n]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels)
    lexicon: dict[str, int]  # word to the label of its lexicon
    lexical: np.ndarray  # (labels + 1, labels); the last row is for words of no lexicon
    moves: np.ndarray  # (labels, labels)
    kept: dict = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each label for distinct words; words without letters say nothing."""
        bucket, starts = features(words, len(self.weights))
        score = word_sums(self.weights, bucket, starts) / np.sqrt(np.maximum(np.diff(starts), 1))[:, None]
        none = len(self.labels)
        score = score + self.lexical[[self.lexicon.get(w, none) for w in words]]
        score[[not w for w in words]] = 0
        return score

    def marginals(self, at: np.ndarray, words: list[str], offsets: np.ndarray) -> np.ndarray:
        """Probability of each label for each word of the texts."""
        if not len(at):
            return np.zeros((0, len(self.labels)))
        score = self.emissions(words)
        score = np.exp(np.clip(score - score.max(1, keepdims=True), -40, 0))
        reset = np.zeros(len(at) + 1, bool)
        reset[offsets[:-1]] = True
        alpha, beta = forward_backward(score[at], np.exp(self.moves - self.moves.max()), reset[:-1])
        both = alpha * beta
        return both / both.sum(1, keepdims=True)


def train(texts: list[str], tags: list[str]) -> Model:
    """Fit on whole texts with one language each.

    Words first take their text's language; after a first fit they take the language that the model finds most likely,
    so that switches inside texts are learned, and the fit goes on.  Gradient steps are Adam's over all texts at once.
    """
    labels = sorted(set(tags))
    k = len(labels)
    at, words, offsets = words_of(pa.array(texts, pa.string()))
    sizes = np.diff(offsets)
    truth = np.repeat([labels.index(t) for t in tags], sizes)
    count = np.zeros((len(words), k))
    np.add.at(count, (at, truth), 1)
    total = count.sum(1)
    lexicon: dict[str, int] = {}
    for y in range(k):
        own = [w for w in np.argsort(-count[:, y], kind="stable")[: LEXICON * 2] if words[w] and count[w, y] >= LEXICON_COUNT and count[w, y] >= LEXICON_SHARE * total[w]]
        lexicon |= {words[w]: y for w in own[:LEXICON]}
    model = Model(labels, np.zeros((buckets_for(k), k)), lexicon, np.zeros((k + 1, k)), np.eye(k))
    if k < 2 or not len(at):
        return model
    bucket, starts = features(words, len(model.weights))
    scale = 1 / np.sqrt(np.maximum(np.diff(starts), 1))
    lex = np.array([lexicon.get(w, k) for w in words])
    mute = np.array([not w for w in words])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
    used, slot = np.unique(bucket, return_inverse=True)
    slot = slot.astype(np.int32)
    del bucket
    reset = np.zeros(len(at) + 1, bool)
    reset[offsets[:-1]] = True
    reset = reset[:-1]
    inner = np.flatnonzero(~reset)
    params = [np.zeros((len(used), k)), np.zeros((k + 1, k)), np.eye(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    done = 0
    for phase, steps in enumerate(STEPS):
        if phase:
            model.weights[used], model.lexical, model.moves = params[0], params[1], params[2]
            truth = model.marginals(at, words, offsets).argmax(1)
        observed = np.zeros((len(words), k))
        np.add.at(observed, (at, truth), 1)
        pairs = np.zeros((k, k))
        np.add.at(pairs, (truth[inner - 1], truth[inner]), 1)
        for _ in range(steps):
            done += 1
            score = word_sums(params[0], slot, starts) * scale[:, None] + params[1][lex]
            score[mute] = 0
            score = np.exp(np.clip(score - score.max(1, keepdims=True), -40, 0))[at]
            move = np.exp(params[2] - params[2].max())
            alpha, beta = forward_backward(score, move, reset)
            both = alpha * beta
            both /= both.sum(1, keepdims=True)
            expected = np.stack([np.bincount(at, both[:, y], len(words)) for y in range(k)], 1)
            gap = (expected - observed) / len(at)
            gap[mute] = 0
            before, after = alpha[inner - 1], score[inner] * beta[inner]
            before = before / np.einsum("ni,ij,nj->n", before, move, after, optimize=True)[:, None]
            moved = move * (before.T @ after)
            del before, after
            scaled = gap * scale[:, None]
            grads = [
                np.stack([np.bincount(slot, scaled[:, y][owner], len(used)) for y in range(k)], 1) + 1e-7 * params[0],
                np.stack([np.bincount(lex, gap[:, y], k + 1) for y in range(k)], 1) + 1e-6 * params[1],
                (moved - pairs) / len(at) + 1e-4 * params[2],
            ]
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.3 * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-9)
    model.weights[used], model.lexical, model.moves = params
    model.weights = model.weights.astype(np.float32)
    return model


# ---------------------------------------------------------------- documents


def train_on(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``per_label`` whole documents of each label, those whose ids hash smallest.

    Rows without id, text or label are left out; of several rows of an id the one of the least label and text counts.
    Without any the model knows no language.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label")).dropna()
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ranked = rows.select("id", "label").withColumn("n", F.row_number().over(first))
    ids = [r[0] for r in ranked.where(F.col("n") <= per_label).select("id").distinct().collect()]  # per_label to a label at most
    if not ids:
        return Model([], np.zeros((1, 0), np.float32), {}, np.zeros((1, 0)), np.zeros((0, 0)))
    found = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min(F.struct("label", "text")).alias("r")).collect()
    found.sort(key=lambda r: str(r[0]))
    return train([r["r"]["text"] for r in found], [r["r"]["label"] for r in found])


def label_batch(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text: the label with the largest share of its words' probability."""
    at, words, offsets = words_of(texts)
    if not model.labels:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    prob = model.marginals(at, words, offsets)
    prob[np.array([not w for w in words], bool)[at] if len(at) else slice(0)] = 0
    mass = sums(prob, offsets)
    total = mass.sum(1)
    best = mass.argmax(1)
    share = mass[np.arange(len(mass)), best] / np.maximum(total, 1e-300)
    return [model.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)], [float(min(1.0, max(0.0, s))) if t > 0 else 0.0 for s, t in zip(share, total, strict=True)]


def word_languages(model: Model, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and probability."""
    at, words, offsets = words_of(pa.array([text]))
    prob = model.marginals(at, words, offsets)
    return [(raw, model.labels[p.argmax()] if words[a] else UNKNOWN, float(p.max())) for raw, a, p in zip(text.encode().split(), at, prob, strict=True)]


def batch_bytes(model: Model) -> int:
    return BATCH_BYTES * 4 // max(4, len(model.labels))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score of every row.

    Null texts and texts without a letter are ``und`` with score 0; null ids stay null; repeated rows are each predicted;
    of labels with equal shares the first by name wins; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = label_batch(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, 4) == 2).alias("held_out"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double", size=batch_bytes(model))


def keep(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a known language of at least ``min_score``; all columns pass through.

    Null texts and texts without a letter have no language and go; null ids and repeated rows pass as any; empty stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = label_batch(model, b.column(text))
            yield b.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema, size=batch_bytes(model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train_on(docs.where(crc_mod("doc_id", 4) != 2)))
