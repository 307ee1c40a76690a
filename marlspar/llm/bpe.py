"""Byte-level BPE by ranks, with a segment tree over byte positions.

Leaf i of a pre-token's tree holds the rank of the pair that starts at byte i, with i in the low bits,
so that the root is the leftmost pair of least rank. A merge rewrites three leaves (the merged pair,
its right part, its left neighbour) and their paths to the root. Many short pre-tokens run their trees
side by side in numpy arrays; a long one runs alone, in O(n log n). Each distinct pre-token is encoded
once a worker, in a cache of bounded size.

Defined cases: a null text is empty and has no ids; null ids stay null; repeated rows give repeated
results; an empty table gives no rows; texts are read whole; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, map_batches, narrow
from .encoding import groups, unicode_blanks

NONE = 1 << 20  # a rank above all
WIDEST = 64  # pre-tokens of up to so many bytes run side by side


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairs:
    def __init__(self, path: str, pattern: str, most: int = 300_000):
        self.ranks = load_ranks(path)
        self.pieces = regex.compile(unicode_blanks(pattern))
        self.most = most
        self.dtype = np.dtype("<u2" if max(self.ranks.values()) < 1 << 16 else "<u4")
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        get = self.ranks.get
        pairs = {(a << 20) | b: r for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None}
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[x] for x in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Pieces of up to `width` bytes, a power of two."""
        n, bits = len(pieces), width.bit_length() - 1
        lengths = np.array([len(x) for x in pieces])
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        inside = np.arange(width) < lengths[:, None]
        token = np.full((n, width + 1), NONE - 1, np.int64)  # behind the end stands an id that pairs with nothing
        token[:, :width] = np.where(inside, self.single[raw], NONE - 1)
        following = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE << bits, np.int64)
        tree[:, width:] = (self._rank(token[:, :-1], token[:, 1:]) << bits) | np.arange(width)
        for level in range(bits - 1, -1, -1):
            first = 1 << level
            tree[:, first : 2 * first] = np.minimum(tree[:, 2 * first : 4 * first : 2], tree[:, 2 * first + 1 : 4 * first : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE << bits)
        while len(rows):
            top = tree[rows, 1]
            at, rank = top & (width - 1), top >> bits
            right = following[rows, at]
            beyond = following[rows, right]
            token[rows, at] = rank
            token[rows, right] = -1
            following[rows, at] = beyond
            before[rows, beyond] = at
            here = (self._rank(rank, token[rows, beyond]) << bits) | at
            left = before[rows, at]
            first = left < 0
            left = np.where(first, at, left)
            there = np.where(first, here, (self._rank(token[rows, left], rank) << bits) | left)
            nodes = [right + width, at + width, left + width]
            for node, key in zip(nodes, (np.full(len(rows), NONE << bits), here, there), strict=True):
                tree[rows, node] = key
            for _ in range(bits):
                nodes = [x >> 1 for x in nodes]
                for node in nodes:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE << bits]
        return [token[i, :m][token[i, :m] >= 0] for i, m in enumerate(lengths.tolist())]

    def _alone(self, piece: bytes) -> list[int]:
        n = len(piece)
        bits = max(1, (n - 1).bit_length())
        width, get = 1 << bits, self.pairs.get
        none = NONE << bits
        token = [*self.single[np.frombuffer(piece, np.uint8)].tolist(), NONE - 1]
        following, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = (get((token[i] << 20) | token[i + 1], NONE) << bits) | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, key: int) -> None:
            node = width + leaf
            tree[node] = key
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while tree[1] < none:
            at, rank = tree[1] & (width - 1), tree[1] >> bits
            right = following[at]
            beyond = following[right]
            token[at], token[right] = rank, -1
            following[at] = beyond
            before[beyond] = at
            put(right, none)
            put(at, (get((rank << 20) | token[beyond], NONE) << bits) | at)
            left = before[at]
            if left >= 0:
                put(left, (get((token[left] << 20) | rank, NONE) << bits) | left)
        return [x for x in token[:n] if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list:
        """Ids of each pre-token; a pre-token in the vocabulary is its own id."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > WIDEST:
                out[i] = self._alone(piece)
            else:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, own in classes.items():
            for part in (own[i : i + 8192] for i in range(0, len(own), 8192)):
                for i, ids in zip(part, self._side_by_side([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, as self.dtype."""
        cut = [self.pieces.findall(x) for x in texts]
        missing = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(missing) > self.most:
            self.known.clear()
            missing = list(set().union(*cut))
        self.known.update(zip(missing, (np.array(x, self.dtype).tobytes() for x in self.encode_pieces([x.encode() for x in missing])), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@cache
def byte_pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches):
        model = byte_pairs(path, pattern)
        for batch in batches:
            ids = [x for group in groups(batch["text"].to_pylist()) for x in model.encode(group)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches):
        model = byte_pairs(path, pattern)
        for batch in batches:
            data, at = flat(batch["ids"])
            n, digests, texts = [], [], []
            for i in range(batch.num_rows):
                ids = np.frombuffer(data[at[i] : at[i + 1]].tobytes(), model.dtype)
                n.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
                texts.append(model.decode(ids))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian; 2 bytes an id where the vocabulary allows it, else 4)."""
    return map_batches(narrow(docs, id_col, text_col), _encode(ranks, pattern), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded (binary)."""
    return map_batches(encoded, _decode(ranks, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def op8(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = decode_documents(encode_documents(docs, *own), *own)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
