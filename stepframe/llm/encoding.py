"""Encoding of whole texts by a word-wise BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import ctypes
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct white-space separated pieces remembered by a worker; beyond it only the first seen, mostly frequent, stay.
REMEMBERED, KEPT = 1_200_000, 400_000
#: Letters that are one code point in normal form C, and one mark after them: two pre-tokens at most.
PLAIN = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([.,;:!?]?)\Z")
JOINED = 500
#: Letters given to the tokenizer at once, about; its results take many times their size.
AT_ONCE = 200_000


class _Index(dict):
    """Numbers keys in order of first sight and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, key):
        self[key] = at = len(self)
        self.fresh.append(key)
        return at


class WordEncoder:
    """Encodes texts exactly as the tokenizer does, each distinct piece between ASCII white space once.

    The file must split at white space before merging and drop it, as its normaliser and pre-tokeniser state; pieces are
    then independent. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered, self.kept = remembered, remembered * KEPT // REMEMBERED
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ending[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # A mark alone is one token.
        self.marks = {"": -1} | {m: int(self._batch([m])[0][0]) for m in ".,;:!?"}
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        keep = _Index()
        keep.update((w, i) for w, i in self.index.items() if i < self.kept)
        self.index = keep
        self.starts, self.lengths = self.starts[: self.kept], self.lengths[: self.kept]
        self.pool = self.pool[: int((self.starts + self.lengths).max(initial=0))]

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        flat, counts, first, size = [], [], 0, 0
        for at, text in enumerate(texts, 1):
            size += len(text)
            if size >= AT_ONCE or at == len(texts):
                ids = [e.ids for e in encode(texts[first:at], add_special_tokens=False)]
                counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(counts[-1].sum())))
                first, size = at, 0
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words that are one pre-token each, many at a time; a word's last id ends it."""
        flat, _ = self._batch([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        ends = np.flatnonzero(self.ending[flat]) + 1
        if len(ends) != len(words):
            return self._batch(words)
        return flat, np.diff(ends, prepend=0)

    def _learn(self) -> None:
        """Encodes the new pieces. Those that are a word and a mark take the word's ids, whatever its case."""
        done = len(self.lengths)
        plain, odd, made = [], [], []
        at = done
        while self.index.fresh:
            fresh, self.index.fresh = self.index.fresh, []
            for piece in fresh:
                text = piece.decode()
                match = PLAIN.match(text)
                if match is None:
                    odd.append((at, text))
                elif match[0] == match[1] and (low := text.lower()) == text:
                    plain.append((at, low))
                else:
                    made.append((at, self.index[match[1].lower().encode()], self.marks[match[2]]))
                at += 1
        starts, lengths = np.zeros(at, np.int64), np.zeros(at, np.int64)
        starts[:done], lengths[:done] = self.starts, self.lengths
        pool, size = [self.pool], len(self.pool)
        for places, (flat, n) in ((plain, self._plain([t for _, t in plain])), (odd, self._batch([t for _, t in odd]))):
            where = np.array([p for p, _ in places], np.int64)
            starts[where], lengths[where] = size + np.cumsum(n) - n, n
            pool.append(flat)
            size += len(flat)
        self.pool = np.concatenate(pool)
        if made:
            where, base, mark = np.array(made, np.int64).T
            n = lengths[base] + (mark >= 0)
            ends = np.cumsum(n)
            flat = self.pool[np.minimum(np.repeat(starts[base] - (ends - n), n) + np.arange(ends[-1]), len(self.pool) - 1)]
            flat[ends[mark >= 0] - 1] = mark[mark >= 0]
            starts[where], lengths[where] = size + ends - n, n
            self.pool = np.concatenate([self.pool, flat])
        self.starts, self.lengths = starts, lengths

    def pieces(self, texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' pieces in one array, and how many each text has; valid until the next call.

        None is empty. With ``lower``, A-Z are lowered first, which the tokenizer does anyway.
        """
        if len(self.index) > self.remembered:
            self._shrink()
        look = self.index.__getitem__
        parts = []
        for text in texts:
            raw = text.encode("utf-8", "replace") if text else b""
            words = (raw.lower() if lower else raw).split()
            parts.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.index.fresh:
            self._learn()
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.fromiter(map(len, parts), np.int64, len(parts))

    def ids(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose pieces these are, and each text's offsets among them (one more than texts)."""
        n = self.lengths[pieces]
        ends = np.cumsum(n)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[pieces] - (ends - n), n) + np.arange(total)], bounds

    def encode(self, texts: list, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's offsets in it (one more than texts). None is empty."""
        flat, bounds = self.ids(*self.pieces(texts))
        if end_id is None:
            return flat, bounds
        return np.insert(flat, bounds[1:], np.int32(end_id)), bounds + np.arange(len(bounds))


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """The worker's encoder for a file, which remembers so many pieces."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = WordEncoder(path, remembered)
    return _ENCODERS[path, remembered]


def forget() -> None:
    """Give up the worker's encoders, for a stage that needs its memory for other things."""
    _ENCODERS.clear()


#: Where the C library has it: returns freed memory that its heap would keep between two that are in use.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns the worker's freed memory to the system, which the executor's JVM and other workers share."""
    if _TRIM:
        _TRIM(0)


def slices(batch, column: str = "text", chars: int = 2_000_000):
    """Cuts a record batch into runs of rows of about so many bytes of text: (first row, texts).

    Only one run's texts are Python strings at a time.
    """
    import pyarrow.compute as pc

    texts = batch.column(column)
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, before + chars, "right")))
        yield first, texts.slice(first, end - first).to_pylist()
        first = end
