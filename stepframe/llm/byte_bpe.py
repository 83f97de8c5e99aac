"""Byte-level BPE: texts to ids and back, by proposing tokens and checking them (operator 12).

A word (pre-token) is first cut greedily into the longest tokens. That cut is what the merges give exactly if each pair of
neighbours is compatible: no merge across their border would have come before the merges that made the two tokens. All
pairs are checked at once with arrays; only words with a failing pair are merged one rank after another.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, tokenizer_path
from .encoding import _Index, slices

#: Distinct stretches of text that a worker remembers; beyond it only the first seen, mostly frequent, stay.
REMEMBERED, KEPT = 600_000, 200_000
#: Ids that are spelled out at once.
BLOCK = 1 << 18
NEVER = np.int64(1) << 40
NO_RANK = 1 << 40
#: Bytes of a word that is merged by looking through all its pairs each time.
SHORT = 48
#: White space as the file's pattern means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space that doesn't stand alone before a word: two or more, or any at the end.
RUN = re.compile(f"([{WHITE}]{{2,}}|[{WHITE}]+\\Z)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(odd) for b in range(256)]


class _Spelled:
    """Byte strings in one pool, to be joined by number."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        out = []
        for first in range(0, len(ids), BLOCK):
            some = ids[first : first + BLOCK]
            n = self.sizes[some]
            ends = np.cumsum(n)
            out.append(self.pool[np.repeat(self.starts[some] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class ByteBpe:
    """A byte-level BPE file of the ``tokenizers`` library; encodes and decodes as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or data["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError(f"added tokens with options: {path}")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        spelled = [b""] * self.size
        for t, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in t)
        for t, i in added.items():
            spelled[i] = t.encode()
        self.spelled = _Spelled(spelled)
        self.special = {t: np.array([i], np.int32) for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.byte_ids = [vocab[c] for c in letters]
        self._merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], vocab)
        self._trie([spelled[i] for i in self.tokens], self.tokens)
        self._forget()

    # -- merges

    def _merges(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.ranks.setdefault(x * self.size + y, r)
            self.made.append(t)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()], np.int64)
        # A token may be proposed if the merges make it from its own bytes: its halves are such, and nothing merges across
        # their border before they do.
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made], kind="stable")]
        whole = np.zeros(self.size, bool)
        whole[self.byte_ids] = True
        free = self.compatible(self.left[made], self.right[made], below=True)
        for t, ok in zip(made.tolist(), free.tolist(), strict=True):
            whole[t] = ok and whole[self.left[t]] and whole[self.right[t]]
        self.tokens = np.flatnonzero(whole)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: bool = False) -> np.ndarray:
        """Whether the merges leave the border of each token a and the token b after it as it is.

        Undoes the later of the two tokens' merges step by step. At each step the pair at the border has a chance to merge: if its
        rank comes before the merge that takes the left one away, and not after the one that takes the right one (of equal
        merges the leftmost comes first). ``below`` leaves out the pair of whole tokens.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        end_x, end_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            if not below:
                key = x * self.size + y
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = np.where(self.keys[place] == key, self.key_ranks[place], NEVER)
                fires = (found < end_x) & (found <= end_y)
                ok[at[fires]] = False
            else:
                fires = np.zeros(len(at), bool)
            below = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~fires & ((rx >= 0) | (ry >= 0))
            undo_y = ry >= rx
            end_x, end_y = np.where(undo_y, end_x, rx), np.where(undo_y, ry, end_y)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
            at, x, y, end_x, end_y = at[go], x[go], y[go], end_x[go], end_y[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word by merging: least rank first, leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        size, rank_of, made = self.size, self.ranks.get, self.made
        ranks = [rank_of(x * size + y, NO_RANK) for x, y in pairwise(ids)]
        while ranks and (r := min(ranks)) < NO_RANK:
            i = ranks.index(r)
            ids[i] = x = made[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(x * size + ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * size + x, NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As ``merge``, with the pairs in a heap: time doesn't grow with the square of a word's length."""
        n, size, ranks, made = len(ids), self.size, self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] * size + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, x, y = heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j], k = made[r], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := ranks.get(ids[i] * size + ids[k])) is not None:
                    heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] * size + ids[i])) is not None:
                heappush(heap, (r, h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    # -- proposals

    def _trie(self, tokens: list[bytes], ids: np.ndarray) -> None:
        children: dict[int, int] = {}
        ends = {0: -1}
        for t, i in zip(tokens, ids.tolist(), strict=True):
            node = 0
            for b in t:
                node = children.setdefault(node << 8 | b, len(children) + 1)
            ends[node] = i
        self.edges = np.array(sorted(children), np.int64)
        self.nodes = np.array([children[k] for k in self.edges.tolist()], np.int64)
        self.token_at = np.full(len(children) + 1, -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())
        # The first step is taken from every place.
        self.first = np.array([children.get(b, -1) for b in range(256)])

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words in one array, and how many each word has."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        # The longest token from each place, all places a byte further at a time.
        limit = np.repeat(ends, size)
        at, node = np.arange(len(data)), self.first[data]
        token, length, depth = self.token_at[node], np.ones(len(data), np.int64), 1
        while len(at):
            go = at + depth < limit[at]
            at, node = at[go], node[go]
            key = node << 8 | data[at + depth]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            go = self.edges[place] == key
            at, node = at[go], self.nodes[place[go]]
            depth += 1
            hit = self.token_at[node] >= 0
            token[at[hit]], length[at[hit]] = self.token_at[node[hit]], depth
        # From each word's start to its end, all words a token further at a time.
        used = np.zeros(len(data), bool)
        now = ends - size
        now = now[size > 0]
        while len(now):
            used[now] = True
            after = now + length[now]
            now = after[after < limit[now]]
        counts = np.add.reduceat(np.append(used, False), np.minimum(ends - size, len(data)))[: len(words)] if len(words) else np.zeros(0, np.int64)
        return token[used], np.where(size > 0, counts, 0)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has; ``merged``: how many of them had a failing pair."""
        flat, counts = self.propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = np.unique(owner[inner[~good]])
        self.merged = len(failing)
        if not len(failing):
            return flat.astype(np.int32), counts
        exact = [np.array(self.merge(words[i]), np.int64) for i in failing.tolist()]
        wrong = np.zeros(len(words), bool)
        wrong[failing] = True
        new = counts.copy()
        new[failing] = [len(e) for e in exact]
        out = np.empty(int(new.sum()), np.int32)
        changed = np.repeat(wrong, new)
        out[changed] = np.concatenate(exact)
        out[~changed] = flat[~wrong[owner]]
        return out, new

    # -- texts

    def _forget(self) -> None:
        self.index = _Index()
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _shrink(self) -> None:
        keep = _Index()
        keep.update((k, i) for k, i in self.index.items() if i < KEPT)
        self.index = keep
        self.starts, self.lengths = self.starts[:KEPT], self.lengths[:KEPT]
        self.pool = self.pool[: int((self.starts + self.lengths).max(initial=0))].copy()

    def _stretches(self, text: str, out: list[str]) -> None:
        """Stretches of a text whose tokens don't depend on what is around them.

        A word after a single blank, without that blank; with a line break before it: what stands as it is. No word
        begins with white space, so the two can't be mixed up.
        """
        parts = RUN.split(text)
        blank = False
        for i in range(0, len(parts), 2):
            part = parts[i]
            if part:
                pieces = part.split(" ")
                if not blank:
                    pieces[0] = "\n" + pieces[0]
                out += pieces
            if i + 1 < len(parts):
                run = parts[i + 1]
                if parts[i + 2]:
                    blank = run[-1] == " "
                    out.append("\n" + run[:-1])
                    if not blank:
                        out.append("\n" + run[-1])
                else:
                    out.append("\n" + run)

    def _learn(self, fresh: list[str]) -> None:
        """Encodes stretches seen for the first time: the library cuts them into words, each distinct word is encoded once."""
        owners, words = [], []
        known: dict[str, int] = {}
        after = [(i, s) for i, s in enumerate(fresh) if s[:1] != "\n"]
        sizes = np.array([len(s) + 1 for _, s in after], np.int64)
        bounds = np.cumsum(sizes)
        for first in range(0, len(after), 2000):
            some = after[first : first + 2000]
            text = " " + " ".join([s for _, s in some])
            spans = [p[1] for p in self.pre.pre_tokenize_str(text)]
            base = int(bounds[first] - sizes[first])
            where = np.searchsorted(bounds[first : first + 2000] - base, np.array([a for a, _ in spans], np.int64), "right")
            owners += [some[w][0] for w in where.tolist()]
            words += [known.setdefault(text[a:b], len(known)) for a, b in spans]
        for i, s in enumerate(fresh):
            if s[:1] == "\n" and len(s) > 1:
                for _, (a, b) in self.pre.pre_tokenize_str(s[1:]):
                    owners.append(i)
                    words.append(known.setdefault(s[1 + a : 1 + b], len(known)))
        flat, counts = self.words([w.encode() for w in known])
        ends = np.cumsum(counts)
        number, owner = np.array(words, np.int64), np.array(owners, np.int64)
        order = np.argsort(owner, kind="stable")
        number = number[order]
        n = counts[number]
        out = np.cumsum(n)
        ids = flat[np.repeat(ends[number] - counts[number] - (out - n), n) + np.arange(out[-1] if len(out) else 0)]
        lengths = np.bincount(owner, counts[np.array(words, np.int64)], len(fresh)).astype(np.int64) if len(owner) else np.zeros(len(fresh), np.int64)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.index.__getitem__, stretches), np.int64, len(stretches))
        if self.index.fresh:
            fresh, self.index.fresh = self.index.fresh, []
            self._learn(fresh)
        return out

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > REMEMBERED:
            self._shrink()
        stretches, counts = [], [0]
        for t in texts:
            self._stretches(t, stretches)
            counts.append(len(stretches))
        numbers = self._numbers(stretches)
        n = self.lengths[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(total)], np.concatenate([[0], ends])[counts]

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's offsets in it (one more than texts). None is empty."""
        texts = [t or "" for t in texts]
        if self.cut is None or not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        parts = [self.cut.split(t) for t in texts]
        flat, bounds = self._plain([p for ps in parts for p in ps[::2]])
        pieces, sizes, k = [], [0], 0
        for ps in parts:
            mine = []
            for i, p in enumerate(ps):
                if i % 2:
                    mine.append(self.special[p])
                else:
                    mine.append(flat[bounds[k] : bounds[k + 1]])
                    k += 1
            pieces += mine
            sizes.append(sum(map(len, mine)))
        return np.concatenate(pieces), np.cumsum(sizes)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids between two bounds; what isn't valid UTF-8 becomes U+FFFD. Ids that the file doesn't have
        stand for nothing."""
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            some = ids[a:b]
            out.append(self.spelled.join(some[(some >= 0) & (some < self.size)]).decode("utf-8", "replace"))
        return out


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The worker's tokenizer for a file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


_IDS = T.ArrayType(T.IntegerType(), False)


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32())).cast(pa.list_(pa.field("element", pa.int32(), False)))


def encode_texts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>), the ids of each row's whole text, and, where ``decoded`` names a column, the text they give back.

    Row by row, no shuffle; a worker remembers at most ``REMEMBERED`` distinct stretches of text. Null and empty texts
    have no ids and decode to an empty text; repeated rows each get theirs; existing columns of these names are replaced;
    other columns pass through, null or not; an empty table gives no rows. Strings of added tokens are those tokens.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    new = [ids, *([decoded] if decoded else [])]
    kept = [c for c in docs.columns if c not in new or c == text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        own = loaded(path)
        for batch in batches:
            for first, texts in slices(batch, text):
                flat, bounds = own.encode(texts)
                made = [_lists(flat, bounds), *([pa.array(own.decode(flat, bounds), pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, *made], names=[*kept, *new])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(ids, _IDS, False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]))


def decode_ids(rows: DataFrame, vocabulary: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what each row's ids stand for. Null arrays, null ids and ids that the file doesn't have stand for nothing;
    the rest as ``encode_texts``."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    kept = [c for c in rows.columns if c != text]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        own = loaded(path)
        for batch in batches:
            for first in range(0, len(batch), 256):
                some = batch.slice(first, 256)
                lists = [np.array([i for i in r or () if i is not None], np.int64) for r in some.column(ids).to_pylist()]
                made = own.decode(np.concatenate(lists), np.cumsum([0, *map(len, lists)]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, pa.string())], names=[*kept, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType(), False)]))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_texts(documents(spark, sf_dir).select("doc_id", "text"), decoded="decoded")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
