"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The model gives each token of a rank file the probability (1 + c) / (N + V): c says how often the token
stands as a whole pre-token in all documents, N is the sum of c, V the size of the vocabulary. A first pass
counts, each task into one number a token. In the second pass distinct pre-tokens go into a trie over bytes;
the best score of a prefix and its number of tokens are computed when its node is made, once for all
pre-tokens that share it, and the node that ends a pre-token gives that pre-token's count. Of equal scores
the one with fewer tokens counts. The trie starts anew when it exceeds a bound, which changes no count.

Where the pattern cuts at spaces, texts are cut there first and a stretch's pre-tokens are looked up together.

Defined cases: a null text is empty and has no tokens; null ids stay null; repeated rows give repeated
results; an empty table gives no rows; texts are read whole; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import lean, map_batches, narrow
from .encoding import cut_at_spaces, cuts_at_spaces, groups, unicode_blanks

#: Distinct stretches that a task counts before it adds them up.
STRETCHES = 400_000
_PRE = 32  # a stretch's pre-tokens stand above its tokens in one whole number


class _Splitter:
    """Texts as stretches, each a whole number of pre-tokens."""

    def __init__(self, pattern: str):
        self.pieces, self.spaced = regex.compile(unicode_blanks(pattern)), cuts_at_spaces(pattern)

    def stretches(self, text: str) -> list[str]:
        if not self.spaced:
            return self.pieces.findall(text)
        head, *rest = cut_at_spaces(text)
        return [head, *map(" ".__add__, rest)] if head else [*map(" ".__add__, rest)]

    def cut(self, stretch: str) -> list[str]:
        if not self.spaced or stretch[:1] == " " and stretch[1:].isalpha():
            return [stretch]
        return self.pieces.findall(stretch)


def _count_whole(path: str, pattern: str):
    def run(batches):
        ranks = load_ranks(path)
        own = {}
        for token, rank in ranks.items():
            try:
                own[token.decode()] = rank
            except UnicodeDecodeError:  # a part of a character is no pre-token
                continue
        split, counts, seen = _Splitter(pattern), np.zeros(max(ranks.values()) + 1, np.int64), Counter()

        def add() -> None:
            each: Counter = Counter()
            for stretch, n in seen.items():
                for piece in split.cut(stretch):
                    if piece in own:
                        each[piece] += n
            for piece, n in each.items():
                counts[own[piece]] += n
            seen.clear()

        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(split.stretches(text))
                if len(seen) > STRETCHES:
                    add()
        add()
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], ["rank", "n"])

    return run


def unigram_scores(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log-probability of each rank; a number a token of the vocabulary reaches the driver."""
    counted = map_batches(narrow(docs, id_col, text_col).select("text"), lean(_count_whole(ranks, pattern)), "rank long, n long")
    found = counted.groupBy("rank").agg(F.sum("n").alias("n")).toArrow()
    vocabulary = load_ranks(ranks).values()
    counts = np.zeros(max(vocabulary) + 1)
    counts[found["rank"].to_numpy()] = found["n"].to_numpy()
    return np.log1p(counts) - math.log(counts.sum() + len(vocabulary))


class TrieCounts:
    def __init__(self, path: str, pattern: str, log_probability: np.ndarray, most_nodes: int = 1_000_000):
        self.split, self.most = _Splitter(pattern), most_nodes
        scores = {t: float(log_probability[r]) for t, r in load_ranks(path).items()}
        #: Every ending of a token, with the token's score if it is one itself: bounds the search to the left.
        self.endings: dict[bytes, float | None] = {t[i:]: None for t in scores for i in range(len(t))}
        self.endings.update(scores)
        self._reset()

    def _reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token; makes the nodes that are missing."""
        child, endings, score, tokens = self.child, self.endings, self.score, self.tokens
        path, node = [0], 0
        for end, byte in enumerate(piece, 1):
            key = node << 8 | byte
            found = child.get(key)
            if found is None:
                best, fewest = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    own = endings.get(piece[start:end], endings)
                    if own is endings:
                        break
                    if own is not None:
                        total, n = score[path[start]] + own, tokens[path[start]] + 1
                        if total > best or total == best and n < fewest:
                            best, fewest = total, n
                found = child[key] = len(score)
                score.append(best)
                tokens.append(fewest)
            node = found
            path.append(node)
        return tokens[node]

    def count_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        cut = [self.split.stretches(x) for x in texts]
        if len(self.score) > self.most:
            self._reset()
        done = self.pieces
        for stretch in set().union(*cut).difference(self.known):
            pieces = self.split.cut(stretch)
            tokens = 0
            for x in pieces:
                if (n := done.get(x)) is None:
                    n = done[x] = self.count(x.encode())
                tokens += n
            self.known[stretch] = len(pieces) << _PRE | tokens
        get = self.known.__getitem__
        return [divmod(sum(map(get, x)), 1 << _PRE) for x in cut]


_kept: dict[tuple, TrieCounts] = {}


def trie_counts(path: str, pattern: str, log_probability: np.ndarray) -> TrieCounts:
    """The worker's trie of this model; one at a time."""
    key = path, pattern, log_probability.tobytes()
    if key not in _kept:
        _kept.clear()
        _kept[key] = TrieCounts(path, pattern, log_probability)
    return _kept[key]


def _count(path: str, pattern: str, scores):
    def run(batches):
        model = trie_counts(path, pattern, scores.value)
        for batch in batches:
            found = [x for group in groups(batch["text"].to_pylist()) for x in model.count_texts(group)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_pretokens, n_tokens, under the model of all of docs."""
    scores = docs.sparkSession.sparkContext.broadcast(unigram_scores(docs, ranks, pattern, id_col, text_col))
    return map_batches(narrow(docs, id_col, text_col), _count(ranks, pattern, scores), "doc_id long, n_pretokens long, n_tokens long")


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
