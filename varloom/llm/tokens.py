"""Token counts under a unigram model, with forward scores shared in a trie.

The best segmentation of a prefix does not depend on what follows, so its score is computed once
for all pre-tokens that start with it: the trie holds a score and a count at each node, and a
pre-token's number of tokens is the count at its last node.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a task's trie; beyond, it starts anew with the next pre-token.
TRIE_NODES = 1 << 19
#: Longer pre-tokens are segmented outside the trie, which they would fill.
TRIE_BYTES = 256


def zipf_scores(path: str) -> dict[bytes, float]:
    """Log-probabilities of a ranked vocabulary: ranks follow frequency, by Zipf's law."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - total for token, r in ranks.items()}


class Forward:
    """Forward scores of byte strings; every single byte must be in the vocabulary.

    Of equal scores the segmentation with fewer tokens counts.
    """

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.longest = max(map(len, scores))
        # suffixes by length: a prefix's last token is one of them
        self.scores = scores
        self.reset()

    def reset(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.best, self.count = [0.0], [0]
        self.known: dict[str, int] = {}

    def _extend(self, word: bytes, upto: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Score and count of word[:upto], from those of all shorter prefixes."""
        top, fewest, get = -math.inf, 0, self.scores.get
        for k in range(max(0, upto - self.longest), upto):
            s = get(word[k:upto])
            if s is not None:
                s += best[k]
                if s > top or s == top and count[k] < fewest - 1:
                    top, fewest = s, count[k] + 1
        return top, fewest

    def tokens(self, word: str) -> int:
        n = self.known.get(word)
        if n is not None:
            return n
        data = word.encode()
        if len(data) > TRIE_BYTES:
            return self._alone(data)
        if len(self.children) > TRIE_NODES:
            self.reset()
        node, best, count = 0, [0.0], [0]
        for k, c in enumerate(data):
            child = self.children[node].get(c)
            if child is None:
                s, n = self._extend(data, k + 1, best, count)
                child = len(self.children)
                self.children[node][c] = child
                self.children.append({})
                self.best.append(s)
                self.count.append(n)
            node = child
            best.append(self.best[node])
            count.append(self.count[node])
        self.known[word] = self.count[node]
        return self.count[node]

    def _alone(self, data: bytes) -> int:
        best, count = [0.0], [0]
        keep = 4 * self.longest
        cut = 0  # prefixes before it can end no token any more
        for k in range(len(data)):
            window = data[cut : k + 1]
            s, n = self._extend(window, len(window), best, count)
            best.append(s)
            count.append(n)
            if len(best) > keep:
                drop = len(best) - self.longest - 1
                best, count, cut = best[drop:], count[drop:], cut + drop
        return count[-1]


def _counter(scores: dict[bytes, float], pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, model = regex.compile(pattern).findall, Forward(scores)
        for b in batches:
            words, tokens = [], []
            for t in b.column(0):
                counts = Counter(find(t.as_py() or ""))
                words.append(sum(counts.values()))
                tokens.append(sum(n * model.tokens(w) for w, n in counts.items()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*b.schema.names[1:], "n_words", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, scores: dict[bytes, float], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, n_tokens) for every row: pre-tokens, and tokens of their best segmentations.

    The vocabulary, of fixed size, goes to every task; texts are not shuffled. Null and empty texts
    have no tokens; equal rows get equal counts; extra columns are ignored.
    """
    missing = [b for b in range(256) if bytes([b]) not in scores]
    if missing:
        raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
    rows = docs.select(F.col(text_col).cast("string").alias("_t"), F.col(id_col).alias("doc"))
    return rows.mapInArrow(_counter(scores, pattern), f"doc {dict(rows.dtypes)['doc']}, n_words long, n_tokens long")
