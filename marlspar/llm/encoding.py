"""Whole-text encoding with the tokenizers library, each distinct chunk encoded once a worker.

A text is cut where the tokenizer's own pre-tokenizer must cut too, so that the chunks' ids joined are
the text's ids. Word files: a chunk that is new is put together from its pre-tokens. Byte-level files: a
block of texts is cut by its bytes, each distinct chunk of the block is looked up once, and the new ones
go to the library many at a time. Chunks are kept with their ids, in tables of bounded size.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import blocks, flat

_SPACE_AFTER_BLANK = re.compile(r"\s ")


def cut_at_spaces(text: str) -> list[str]:
    """For byte-level pre-tokenizing: pieces p0, p1, ... with text = p0 + " " + p1 + ...; each " " + p
    encodes alone, as a run of blanks is never cut: a space after a blank stays within its piece."""
    parts = text.split(" ")
    if not _SPACE_AFTER_BLANK.search(text):
        return parts
    out = parts[:2]
    for before, part in zip(parts[1:], parts[2:]):
        if not before or before[-1].isspace():
            out[-1] += " " + part
        else:
            out.append(part)
    if len(parts) > 1 and parts[0] and parts[0][-1].isspace():
        out[:2] = [out[0] + " " + out[1]]
    return out


def unicode_blanks(pattern: str) -> str:
    """pattern with the blanks that Unicode means, as the libraries' own engines read it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


#: Pre-tokens of byte-level files, with the blanks that Unicode means.
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Chunks that a line end parts from others, whatever stands on its other side.
_JOINED = re.compile(r" ?\S(?:[^\n]*\S)?")
#: Pre-tokens of word files, which lower-case afterwards.
_WORD_PIECES = regex.compile(r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


#: Chunks that an encoder keeps, besides those of one gathering: about 200 MB with the old generation.
MOST = 700_000
#: Bytes of a chunk that is kept, chunks gathered at a time, and new chunks in one text given to the library.
KEPT, GATHERED, JOINED = 64, 1 << 20, 50


def _cut_table() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether byte-level pre-tokens part between two classes). Classes: letters, digits,
    other signs, apostrophe, space, other blanks, and the rest: control characters and bytes above 127."""
    kind = np.full(256, 6, np.uint8)
    kind[33:127] = 2
    for c in range(33, 127):
        kind[c] = 0 if chr(c).isalpha() else 1 if chr(c).isdigit() else kind[c]
    kind[ord("'")], kind[32], kind[9:14] = 3, 4, 5
    parts = np.zeros((7, 7), bool)
    parts[0, [1, 2, 3, 4, 5]] = parts[1, [0, 2, 3, 4, 5]] = parts[2, [0, 1, 4, 5]] = True
    parts[3, [1, 4, 5]] = True  # a letter may belong to the apostrophe
    parts[5, [0, 1, 2, 3]] = True  # after a blank that stands alone, see byte_cuts
    return kind, parts.ravel()


_KIND, _PARTS = _cut_table()
#: Blanks of two and three bytes, as one number each.
_BLANKS = [np.array([int.from_bytes(c.encode()) for c in x]) for x in ("\x85\xa0", ["\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000"])]


def byte_cuts(body: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts that stand one after another, whether byte-level pre-tokens surely part before it.
    Runs of blanks are never cut: what follows a run decides how it is parted."""
    kind = _KIND[body]
    cut = np.zeros(len(body), bool)
    cut[1:] = _PARTS[kind[:-1] * np.uint8(7) + kind[1:]]
    after = np.flatnonzero(cut[1:] & (kind[:-1] == 5)) + 1
    cut[after[(after < 2) | (kind[after - 2] > 3)]] = False
    wide = np.flatnonzero((body[1:] == 32) & (body[:-1] > 127)) + 1
    last = body[wide - 1].astype(np.int64) + (body[wide - 2].astype(np.int64) << 8)
    cut[wide[~np.isin(last, _BLANKS[0]) & ~np.isin(last + (body[wide - 3].astype(np.int64) << 16), _BLANKS[1])]] = True
    return cut


def cuts_at_spaces(pattern: str) -> bool:
    """Whether cut_at_spaces cuts only where this pattern does."""
    return unicode_blanks(pattern) == _BYTE_PIECES.pattern


class _Known(dict):
    """Values made on first use. make() says whether to keep one. When it holds more than `most`, it
    becomes the old generation, whose values move over as they are used."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value, keep = self.make(key)
            if not keep:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# The settings of tokenizer files whose splits the expressions above repeat.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN = {
    True: (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    ),
}


def _plain(part):
    """Settings without those that change no id (how offsets are trimmed)."""
    if isinstance(part, dict):
        return {k: _plain(v) for k, v in part.items() if k != "trim_offsets"}
    return [_plain(x) for x in part] if isinstance(part, list) else part


def splits_are_known(settings: dict, byte_level: bool) -> bool:
    """Whether texts under these settings may be cut as this module cuts them."""
    own = _plain(settings.get("normalizer")), _plain(settings.get("pre_tokenizer"))
    added = [x for x in settings.get("added_tokens", ()) if not x.get("special") or x.get("lstrip") or x.get("rstrip") or x.get("single_word")]
    return own == _KNOWN[byte_level] and not added and not settings.get("truncation") and not settings["model"].get("dropout")


class Encoder:
    """Texts to ids as little-endian bytes, 2 an id where the vocabulary allows it, else 4. Files with other
    settings than those known here are given whole texts."""

    def __init__(self, path: str, byte_level: bool, most: int = MOST):
        """byte_level: spaces belong to the following chunk; else blanks are dropped. most: chunks kept."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self._code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.whole = not splits_are_known(json.loads(self.tokenizer.to_str()), byte_level)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.added)) or "(?!)")
        if byte_level:
            line_end = self._ids("\n")
            self._line_end = line_end if len(line_end) == self.dtype.itemsize and not any("\n" in x for x in self.added) else None
            self.most, self.known, self.old = most, {}, {}
        else:
            self.chunks = _Known(self._chunk, most)

    def _ids(self, text: str) -> bytes:
        ids = array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> tuple[bytes, bool]:
        """A word file's chunk by its pre-tokens, where cutting it can't change how it is normalised; whether it may come again."""
        if not chunk.isascii() and ("\u0130" in chunk or not unicodedata.is_normalized("NFC", chunk)):
            return self._ids(chunk), False
        pieces = _WORD_PIECES.findall(chunk)
        if len(pieces) == 1:
            return self._ids(chunk), True
        return b"".join(map(self.chunks.__getitem__, pieces)), len(pieces) == 2

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of byte-level chunks by the library. Between two chunks that neither hold a line end nor end in a
        blank, nor begin with more than a space, a line end is a pre-token of its own; so many make one text."""
        out, joined = [b""] * len(chunks), []
        for i, chunk in enumerate(chunks):
            if (chunk[1:] if chunk[0] == 32 else chunk).isalnum() or _JOINED.fullmatch(chunk.decode()):
                joined.append(i)
            else:
                out[i] = self._ids(chunk.decode())
        lists, texts = [], []
        for own in (joined[i : i + JOINED] for i in range(0, len(joined), JOINED)):
            text = b"\n".join([chunks[i] for i in own]).decode()
            if self._line_end and not self.special.search(text):
                lists.append(own)
                texts.append(text)
            else:
                for i in own:
                    out[i] = self._ids(chunks[i].decode())
        for own, made in zip(lists, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(made.ids, self.dtype)
            data, first, size = ids.tobytes(), 0, self.dtype.itemsize
            ends = np.flatnonzero(ids == np.frombuffer(self._line_end, self.dtype)) * size
            for i, end in zip(own, [*ends.tolist(), len(data)], strict=True):
                out[i] = data[first:end]
                first = end + size
        return out

    def _values(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct byte-level chunks. Above `most` the table becomes the old generation, whose chunks move over as they are used."""
        known = self.known
        out = list(map(known.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i, value in zip(missing, map(self.old.get, [keys[i] for i in missing])):
            if value is None:
                new.append(i)
            else:
                out[i] = known[keys[i]] = value
        for i, value in zip(new, self._new([keys[i] for i in new])):
            out[i] = value
            if len(keys[i]) <= KEPT:
                known[keys[i]] = value
        if len(known) >= self.most:
            self.known, self.old = {}, known
        return out

    def _gather(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks of `body` that begin at `at`, number of ids a chunk)."""
        if not len(at):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(body)).astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
        data, ends = flat(chunks.dictionary)
        data, ends = data.tobytes(), ends.tolist()
        values = self._values([data[a:b] for a, b in zip(ends, ends[1:])])
        data, ends = flat(pa.array(values, pa.large_binary()).take(chunks.indices))
        return data[ends[0] : ends[-1]].view(self.dtype), np.diff(ends) // self.dtype.itemsize

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By blocks of a string column's texts: their ids, one text after another, and the number of ids a text. A null is empty."""
        if self.whole or not self.byte_level:
            for group in groups([x or "" for x in texts.to_pylist()]):
                made = self.encode(group)
                yield np.frombuffer(b"".join(made), self.dtype), np.array([len(x) // self.dtype.itemsize for x in made], np.int64)
            return
        texts = texts.fill_null("")
        data, at = flat(texts.cast(pa.large_binary()))
        for first, last in blocks(at, 1 << 22):
            body, starts = data[at[first] : at[last]], at[first : last + 1] - at[first]
            cut = byte_cuts(body)
            for x in self.added:
                for i in np.flatnonzero(pc.match_substring(texts.slice(first, last - first), x).to_numpy(zero_copy_only=False)):
                    cut[starts[i] : starts[i + 1]] = False
            cut[starts[:-1][np.diff(starts) > 0]] = True
            places = np.flatnonzero(cut)
            made = []
            for i in range(0, len(places), GATHERED):
                own = places[i : i + GATHERED + 1]
                end = own[GATHERED] if len(own) > GATHERED else len(body)
                made.append(self._gather(body[own[0] : end], own[:GATHERED] - own[0]))
            ids, counts = (np.concatenate(x) for x in zip(*made or [self._gather(body, places)]))
            before = np.concatenate([[0], np.cumsum(counts)])
            yield ids, np.diff(before[np.searchsorted(places, starts)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [self._ids(x) for x in texts]
        out = []
        if self.byte_level:
            for ids, counts in self.encode_column(pa.array(texts, pa.large_string())):
                ends = np.cumsum(counts)
                out += [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]
            return out
        get = self.chunks.__getitem__
        for text in texts:
            if self.special.search(text):
                out.append(self._ids(text))
            else:
                out.append(b"".join(map(get, text.replace("\n", " ").split(" "))))
        return out


def groups(texts: list[str], most: int = 1 << 20):
    """Consecutive lists of about `most` characters together, or of one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield texts[first:]


_kept: dict[tuple, Encoder] = {}


def encoder(path: str, byte_level: bool, most: int = MOST) -> Encoder:
    """The worker's encoder of this file."""
    key = path, byte_level, most
    if key not in _kept:
        release()
        _kept[key] = Encoder(*key)
    return _kept[key]


def release() -> None:
    """Give the memory of all encoders back: other work in the same worker needs none of it."""
    _kept.clear()
    trim()


def trim() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
