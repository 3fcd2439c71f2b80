"""Tokenizing whole texts with a public tokenizer, each distinct chunk once as long as a worker remembers it."""

from __future__ import annotations

import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker remembers (some 100 MB).
CACHE = 500_000
#: Bytes of text that are tokenized at once.
BATCH_BYTES = 8 << 20
#: Chunks of these characters need no normalization but lower case, and the pieces of their lower case are plain to see.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ChunkEncoder:
    """Token ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The vocabulary's pre-tokenizer never joins characters across white space and neither its normalizer nor its special
    tokens look across it, so a text's ids are those of its chunks between ASCII white space, one after the other.  Chunks
    of ASCII and Latin-1 letters are cut into the pre-tokenizer's pieces here and only the model is asked; all other
    chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {"": 0}  # to its place among the starts
        self.pool = np.zeros(1 << 16, np.uint32)  # the ids of all chunks, one after the other
        self.starts = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)  # batches that had the chunk

    def _halve(self) -> None:
        """Forget chunks that one batch alone had, and beyond half the cache the least used ones."""
        n = len(self.chunks)
        if n <= CACHE:
            return
        uses = self.uses[:n].copy()
        uses[0] = np.iinfo(np.int32).max
        keep = uses >= max(2, int(np.partition(uses, n - CACHE // 2)[n - CACHE // 2]) + 1)
        row = np.flatnonzero(keep)
        sizes = self.starts[row + 1] - self.starts[row]
        ends = np.cumsum(sizes)
        self.pool = np.concatenate((self.pool[np.repeat(self.starts[row] - (ends - sizes), sizes) + np.arange(ends[-1])], np.zeros(1 << 16, np.uint32)))
        self.starts = np.concatenate(([0], ends, np.zeros(len(row) + (1 << 14), np.int64)))
        self.uses = np.zeros(len(self.starts), np.int32)
        self.uses[: len(row)] = uses[row] // 2
        self.chunks = dict(zip(compress(self.chunks, keep.tolist()), range(len(row)), strict=False))

    def _piece(self, piece: str) -> list[int]:
        row = self.chunks.get(piece)
        if row is not None:
            return self.pool[self.starts[row] : self.starts[row + 1]].tolist()
        return [t.id for t in self.model.tokenize(piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode())))]

    def _chunk(self, chunk: str) -> list[int]:
        if chunk.isascii() and chunk.isalpha():
            return self._piece(chunk.lower())
        if "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        lower = chunk.lower()
        if lower.isalpha():
            return self._piece(lower)
        return [i for p in _PIECES.findall(lower) for i in self._piece(p)]

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks not seen yet."""
        ids = list(map(self._chunk, chunks))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, at = len(self.chunks), int(self.starts[len(self.chunks)])
        if n + len(ids) + 1 > len(self.starts):
            more = max(len(ids) + 1, len(self.starts))
            self.starts, self.uses = np.concatenate((self.starts, np.zeros(more, np.int64))), np.concatenate((self.uses, np.zeros(more, np.int32)))
        total = int(sizes.sum())
        if at + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(total, len(self.pool)), np.uint32)))
        self.pool[at : at + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.starts[n + 1 : n + len(ids) + 1] = at + np.cumsum(sizes)
        self.chunks.update(zip(chunks, range(n, n + len(ids)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array's texts, one after the other, and len(texts) + 1 offsets; null counts as empty."""
        self._halve()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        row = np.fromiter(map(self.chunks.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            row[fresh] = len(self.chunks) + np.arange(len(fresh))
            self._learn([words[i] for i in fresh.tolist()])
        self.uses[row] += 1
        row = row[coded.indices.to_numpy(zero_copy_only=False)]
        first = self.starts[row]
        each = self.starts[row + 1] - first
        ends = np.concatenate(([0], np.cumsum(each)))
        kind = np.int32 if ends[-1] + len(self.pool) < 1 << 31 else np.int64
        place = np.repeat((first - ends[:-1]).astype(kind), each)
        place += np.arange(ends[-1], dtype=kind)
        flat = self.pool[place]
        offsets = split.offsets.to_numpy().astype(np.int64)
        return flat, ends[offsets - offsets[0]]


_ENCODERS: dict[str, ChunkEncoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
