"""Token counts under a unigram model, by a trie over distinct pre-tokens (operator 7)."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, tokenizer_path
from .encoding import slices

#: Nodes of the trie that a worker keeps; beyond it the trie starts anew.
NODES = 1_500_000
SPACE = "▁"


class UnigramVocabulary:
    """Pieces of a sentencepiece file with unigram scores, and byte pieces for what no piece covers.

    The files hold ranks, not probabilities; a piece's score is the log of a Zipf law over its rank, 1/(rank+2.7)
    normalised. A character without a piece costs one byte token for each byte of its UTF-8 form.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        norm = math.log(sum(1 / (i + 2.7) for i in range(len(pieces))))
        self.score = {p: -math.log(i + 2.7) - norm for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.byte = -math.log(len(pieces) + 2.7) - norm - 10.0


class PrefixTrie:
    """Forward scores of the best segmentation on a trie of distinct pre-tokens, computed once for each prefix they share.

    A node is a prefix; it holds the best log score of its segmentations and the fewest tokens at that score. Nodes stay from
    batch to batch, so a prefix is scored once as long as the trie is kept; beyond ``NODES`` nodes it starts anew. The count at a
    pre-token's last node is its token count.
    """

    def __init__(self, vocabulary: UnigramVocabulary):
        self.vocabulary = vocabulary
        self.made = 0
        self._clear()

    def _clear(self) -> None:
        #: Child of a node by the node's number and a character, in one key; the root is 0.
        self.children: dict[int, int] = {}
        self.scores, self.tokens = array("d", [0.0]), array("q", [0])
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """The terminal count of a pre-token (without the leading space mark)."""
        score, longest, byte = self.vocabulary.score, self.vocabulary.longest, self.vocabulary.byte
        children, scores, tokens = self.children, self.scores, self.tokens
        marked = SPACE + word
        node, path = 0, [0]
        for end, c in enumerate(marked, 1):
            key = node << 21 | ord(c)
            node = children.get(key, -1)
            if node < 0:
                best, fewest = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    gain, n = score.get(marked[start:end]), 1
                    if gain is None:
                        if start != end - 1:
                            continue
                        n = len(c.encode("utf-8", "replace"))
                        gain = n * byte
                    total, count = scores[path[start]] + gain, tokens[path[start]] + n
                    if total > best or total == best and count < fewest:
                        best, fewest = total, count
                node = children[key] = len(scores)
                scores.append(best)
                tokens.append(fewest)
                self.made += 1
            path.append(node)
        return tokens[node]

    def count(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text: the tokens are the sum of its pre-tokens' terminal counts. None is empty."""
        if len(self.scores) > NODES:
            self._clear()
        known = self.terminal
        n_words, n_tokens = [], []
        for text in texts:
            words = text.encode("utf-8", "replace").split() if text else []
            for w in set(words).difference(known):
                known[w] = self.insert(w.decode())
            n_words.append(len(words))
            n_tokens.append(sum(map(known.__getitem__, words)))
        return np.array(n_words, np.int64), np.array(n_tokens, np.int64)


_TRIES: dict[str, PrefixTrie] = {}


def trie_of(path: str) -> PrefixTrie:
    """The worker's trie for a vocabulary."""
    if path not in _TRIES:
        _TRIES[path] = PrefixTrie(UnigramVocabulary(path))
    return _TRIES[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``n_words`` and ``n_tokens`` (long) to each row: pre-tokens are runs between ASCII white space.

    Row by row, no shuffle; a worker keeps a trie of about ``NODES`` nodes between batches. Null and empty texts have 0;
    repeated rows each get their counts; existing columns of these names are replaced; other columns pass through; an empty
    table gives no rows.
    """
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")
    docs = docs.drop("n_words", "n_tokens")
    names = docs.columns

    def run(batches):
        own = trie_of(path)
        for batch in batches:
            for first, texts in slices(batch):
                words, tokens = own.count(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(words), pa.array(tokens)], names=[*names, "n_words", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("lang"), F.col("source"), "text")
    # The text itself isn't part of the result.
    return token_counts(docs).select("doc_id", "lang", "source", "n_words", "n_tokens")
