"""Token counts of texts under a unigram model, by dynamic programming over a trie of their distinct words.

A word (a maximal run of characters other than space and \\t..\\r) becomes the pre-token "▁" + word.  Of all
ways to cut it into pieces of a public vocabulary the most probable is taken (of equal ones, that with the
fewest pieces); its number of pieces is the word's token count.  A character that no piece covers costs its
UTF-8 bytes, each as improbable as FALLBACK.

Distinct pre-tokens are put into a trie in sorted order, depth first.  A node's forward score, the best over
all pieces that end there, depends on its prefix alone, so it is computed once for all words that share it;
the current path is all that is held.  Terminal counts are kept for up to WORDS_HELD words a worker, and a
text's count is the sum over its words.

Null, empty and blank texts have no words and no tokens.  Repeated rows are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

FALLBACK = -30.0
WORDS_HELD = 400_000


def zipf_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of a SentencePiece file's ordinary pieces, in proportion to 1 / (rank + 2), best score first."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 2) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(ids)}


class Trie:
    """Forward scores along one path at a time; words come in sorted order."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=0)

    def counts(self, words: list[str]) -> list[int]:
        """Token counts of sorted distinct words."""
        pieces, longest = self.pieces.get, self.longest
        score, count, path, out = [0.0], [0], "", []
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, fewest = score[end - 1] + size * FALLBACK, count[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    p = pieces(word[begin:end])
                    if p is not None:
                        s, n = score[begin] + p, count[begin] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                score.append(best)
                count.append(fewest)
            path = word
            out.append(count[len(word)])
        return out


_HELD: dict[str, tuple[Trie, dict[bytes, int]]] = {}


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD[path] = Trie(zipf_pieces(path)), {}
        trie, held = _HELD[path]
        for batch in batches:
            for part, texts in slices(batch, "text"):
                parts = [t.split() for t in texts]
                if len(held) > WORDS_HELD:
                    held.clear()
                seen = set().union(*parts)
                new = sorted(w.decode() for w in seen - held.keys())
                held.update(zip((w.encode() for w in new), trie.counts([f"▁{w}" for w in new]), strict=True))
                n = np.array([len(p) for p in parts], np.int64)
                sums = np.cumsum([0, *np.fromiter((held[w] for p in parts for w in p), np.int64, int(n.sum()))])
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sums[ends] - sums[ends - n])], ["id", "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_words, n_tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counter(model_path), "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
