"""Count-only Viterbi: how many pieces a unigram tokenizer cuts a text into, without making them.

The vocabulary's pieces are found in a word by Aho-Corasick; dynamic programming carries, for every place, the best score
and its number of pieces. The rules are those of the public unigram implementation: a later candidate must be strictly
better, candidates come from the left, a character no piece covers alone costs the least score less 10, and neighbouring
unknown characters are one piece. Each distinct word is counted once a worker while its bounded cache lasts.
"""

from __future__ import annotations

import functools
import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import short_batches, text_bytes

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_COST = 10.0
SPACE = "▁"
CACHE = 500_000


def vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """The public pieces in rank order with scores -ln(rank + 1); its byte and control pieces are left out."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [(piece, -math.log(rank + 1)) for rank, piece in enumerate(names, 1)]


class Counter:
    """Pieces of a word under a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        self.cache: dict[bytes, int] = {}

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, best score); longer pieces, which start further left, are asked first."""
        n = len(text)
        score, pieces, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            matches[end].append(match)
        single, cost = self.single, self.unknown
        for end in range(1, n + 1):
            best = None
            for size, value in matches[end - 1]:
                candidate = value + score[end - size]
                if best is None or candidate > best:
                    best, start = candidate, end - size
            odd = False
            if text[end - 1] not in single:
                candidate = cost + score[end - 1]
                if best is None or candidate > best:
                    best, start, odd = candidate, end - 1, True
            score[end], unknown[end] = best, odd
            pieces[end] = pieces[start] + (0 if odd and unknown[start] else 1)
        return pieces[n], score[n]

    def words(self, text: bytes) -> tuple[int, int]:
        """(words, pieces) of a text: every word after a space mark, on its own."""
        cache, words, total = self.cache, text.split(), 0
        for w in words:
            k = cache.get(w)
            if k is None:
                if len(cache) >= CACHE:
                    cache.clear()
                k = self.count(SPACE + w.decode())[0]
                if len(w) < 64:
                    cache[w] = k
            total += k
        return len(words), total


@functools.cache
def _counter(name: str) -> Counter:
    return Counter(vocabulary(name))


def count_tokens(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of docs (doc_id, text; more are ignored).

    A null or empty text has none of either. Repeated rows are counted each; an empty table gives an empty result.
    """

    def apply(batches):
        counter = _counter(name)
        for batch in batches:
            out = [counter.words(x) for x in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_words long, n_tokens long")
