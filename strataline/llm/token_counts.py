"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

A node of the trie is a prefix shared by all pre-tokens that begin with it, so its forward score (the best sum of piece
log-probabilities over its segmentations) is computed once, from the scores of its ancestors. With it the node keeps the
number of pieces of that best segmentation; a pre-token's count is read off its terminal node.

The vocabulary is a public one. Its pieces come in descending frequency and give no probabilities of their own, so piece
r has the Zipf probability 1 / ((r + 1) H). A character outside the vocabulary costs its UTF-8 bytes, each at the least
probability. Equal scores: fewer pieces.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import lean, text_slices

WORD_START = "▁"


def zipf_pieces(model_path: str) -> tuple[dict[str, float], float]:
    """Log-probability of each ordinary piece of a sentencepiece model, and that of a byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces) + 1)))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}, -math.log(len(pieces) + 1) - norm


class UnigramTrie:
    """Counts of distinct pre-tokens; emptied when it holds max_nodes, which changes no result."""

    def __init__(self, scores: dict[str, float], byte_score: float, max_nodes: int = 1_000_000):
        self.scores, self.byte_score, self.max_nodes = scores, byte_score, max_nodes
        self.longest = max(map(len, scores), default=1)
        self._clear()

    def _clear(self):
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _insert(self, word: str) -> int:
        if len(self.best) + len(word) > self.max_nodes and len(self.best) > 1:
            self._clear()
        child, best, count, scores = self.child, self.best, self.count, self.scores
        keep = len(word) < self.max_nodes  # one longer than the whole trie leaves no nodes
        node, path, n = 0, [0], len(best)
        for i, c in enumerate(word, 1):
            node = child.get((path[-1], c), -1) if path[-1] < n else -1
            if node < 0:
                size = len(c.encode())
                top, least = best[path[i - 1]] + size * self.byte_score, count[path[i - 1]] + size
                if c in scores:
                    top, least = best[path[i - 1]] + scores[c], count[path[i - 1]] + 1
                for j in range(max(0, i - self.longest), i - 1):
                    if (s := scores.get(word[j:i])) is not None and ((b := best[path[j]] + s) > top or b == top and count[path[j]] + 1 < least):
                        top, least = b, count[path[j]] + 1
                node = len(best)
                best.append(top)
                count.append(least)
                if keep:
                    child[path[-1], c] = node
            path.append(node)
        found = count[node]
        if not keep:
            self._clear()
        return found

    def counts(self, words: list[str]) -> int:
        """Pieces of all the words together."""
        known = self.terminal
        if len(known) > self.max_nodes // 2:
            known.clear()
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self._insert(WORD_START + w)
                known = self.terminal
                known[w] = n
            total += n
        return total


_own: dict[str, UnigramTrie] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row's whole text, without a shuffle.

    Pre-tokens are runs of characters that are not white space; those too long for the trie are counted all the same. Null,
    empty and blank texts count 0; repeated rows are counted each, so ties need no order. Other columns are ignored, whatever their
    names; a table without rows gives none.
    """

    def work(batches):
        if model_path not in _own:
            _own[model_path] = UnigramTrie(*zipf_pieces(model_path))
        trie = _own[model_path]
        for b in batches:
            for i, j, texts in text_slices(b, 1):
                words = [t.split() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(map(len, words), pa.int64()), pa.array(map(trie.counts, words), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strataline.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
