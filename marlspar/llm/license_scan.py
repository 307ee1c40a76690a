"""Licence scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for expressions.

Words are the runs of digits, ASCII letters and characters above ASCII, with A-Z lower-cased. One
automaton finds all notice phrases in the words joined by single spaces, another the tags in the raw
text; the longest well-formed start of what follows a tag on its line is taken as a licence expression with
( ) AND OR WITH and +. Punctuation behind an identifier is not part of it and ends the expression.

Defined cases: a null text is empty; an empty text has no words, notices or tags and the score 0;
texts are read whole; repeated rows give repeated results; null ids stay null; an empty table gives no
rows; columns other than id and text are not read; a line of which no start is an expression gives valid = false, no labels, score 0.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, map_batches, narrow

# Phrases that the contract names, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases (words only, lower case) and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl-2",
    "boost software license": "bsl-1",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Licence identifiers (lower case, without -only, -or-later and +) and their labels.
IDENTIFIERS = {
    "mit": "mit", "x11": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc",
    "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl-3", "mpl-2.0": "mpl-2",
    "epl-2.0": "epl-2", "bsl-1.0": "bsl-1", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc", "cc0-1.0": "cc0", "unlicense": "unlicense", "zlib": "zlib",
}
# How freely text under a label can be used, from 0 to 1.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl-1": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl-2": 0.6, "epl-2": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl-2": 0.3, "gpl-3": 0.3, "agpl-3": 0.2, "cc-by-nd": 0.1,
    "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: An exception after WITH lifts a licence to this freedom at least.
EXCEPTION_FREEDOM = 0.6
SCHEMA = "doc_id long, n_words long, notices array<struct<phrase: string, label: string, word: long>>, tags array<struct<expression: string, valid: boolean, labels: array<string>, score: double, start: long>>, score double"

_RANK = {"or": 1, "and": 2, "with": 3}
_PIECES = re.compile(r"[()]|[^\s()]+")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*$")
_OPENING, _CLOSING = "\"'`", ".,;:!?\"'`*/#>]}-"


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators in evaluation order. ValueError if it isn't well-formed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for piece in _PIECES.findall(expression):
        name = piece.lower()
        if piece == "(" or piece != ")" and name not in _RANK:
            if not operand_next or piece != "(" and not _IDENTIFIER.match(piece):
                raise ValueError(f"unexpected {piece!r}")
            if piece == "(":
                waiting.append(piece)
            else:
                out.append(piece)
                operand_next = False
            continue
        if operand_next:
            raise ValueError(f"an operand must stand before {piece!r}")
        if piece == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a parenthesis closes that never opened")
            waiting.pop()
        else:
            while waiting and _RANK.get(waiting[-1], 0) >= _RANK[name]:
                out.append(waiting.pop())
            waiting.append(name)
            operand_next = True
    if operand_next or "(" in waiting:
        raise ValueError("the expression ends too early")
    return out + waiting[::-1]


def label_of(identifier: str) -> str:
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    return IDENTIFIERS.get(name, name)


def evaluate(expression: str) -> tuple[float, list[str]]:
    """(freedom, sorted labels): OR takes the freer side, AND the stricter, WITH lifts its left side."""
    stack: list[tuple[float, frozenset, bool]] = []  # the last: a bare identifier
    for piece in to_postfix(expression):
        if piece not in _RANK:
            label = label_of(piece)
            stack.append((FREEDOM.get(label, 0.0), frozenset([label]), True))
            continue
        right, left = stack.pop(), stack.pop()
        if piece == "with":
            if not (left[2] and right[2]):
                raise ValueError("WITH stands between a licence and an exception")
            stack.append((max(left[0], EXCEPTION_FREEDOM), left[1], False))
        else:
            stack.append(((max if piece == "or" else min)(left[0], right[0]), left[1] | right[1], False))
    score, labels, _ = stack.pop()
    return score, sorted(labels)


def leading(text: str) -> tuple[str, float, list[str]]:
    """(longest start of text that is an expression, freedom, sorted labels). ValueError if there is none."""
    text = text.lstrip(_OPENING)
    pieces: list[str] = []
    ends: list[tuple[int, int]] = []  # of well-formed starts: pieces, characters
    depth, operand_next, closed = 0, True, False
    for found in _PIECES.finditer(text):
        piece = found.group()
        bare = piece if piece in "()" else piece.rstrip(_CLOSING)
        if closed and piece != ")":
            break
        if piece == "(" or bare == piece and bare.lower() in _RANK:
            if operand_next != (piece == "("):
                break
            operand_next, depth = True, depth + (piece == "(")
        elif piece == ")":
            if operand_next or not depth:
                break
            depth -= 1
        else:
            if not operand_next or not _IDENTIFIER.match(bare) or bare.lower() in _RANK:
                break
            operand_next, closed = False, bare != piece
        pieces.append(bare)
        if not operand_next and not depth:
            ends.append((len(pieces), found.start() + len(bare)))
    low, best, middle = 0, None, len(ends) - 1
    while low < len(ends):  # a misplaced WITH spoils every longer start too
        try:
            best = (text[: ends[middle][1]], *evaluate(" ".join(pieces[: ends[middle][0]])))
            low = middle + 1
        except ValueError:
            del ends[middle:]
        middle = (low + len(ends)) // 2
    if best is None:
        raise ValueError("no expression stands here")
    return best


@cache
def _automata():
    import ahocorasick

    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        notices.add_word(f" {phrase} ", (phrase, label))
    for tag in TAGS:
        tags.add_word(tag, tag)
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


_WORDS_ONLY = bytes(x + 32 if 65 <= x < 91 else x if 48 <= x < 58 or 97 <= x < 123 or x > 127 else 32 for x in range(256))


def scan(raw: bytes) -> dict:
    """What one UTF-8 text holds; see SCHEMA."""
    notices, tags = _automata()
    words = raw.translate(_WORDS_ONLY).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found, at, before = [], 0, 0
    hits = sorted((end - len(phrase) - 1, phrase, label) for end, (phrase, label) in notices.iter(joined))
    for start, phrase, label in hits:
        before += joined.count(" ", at, start)
        at = start
        found.append({"phrase": phrase, "label": label, "word": before})
    scored = [FREEDOM[x["label"]] for x in found]
    lowered, parsed = raw.lower().decode("latin-1"), []
    for end, tag in tags.iter(lowered):
        stop = lowered.find("\n", end)
        expression = raw[end + 1 : stop if stop >= 0 else len(raw)].decode("utf-8", "replace").strip(" \t\r*/#->")
        try:
            expression, score, labels = leading(expression)
            parsed.append({"expression": expression, "valid": True, "labels": labels, "score": score, "start": end - len(tag) + 1})
        except ValueError:
            parsed.append({"expression": expression, "valid": False, "labels": [], "score": 0.0, "start": end - len(tag) + 1})
        scored.append(parsed[-1]["score"])
    return {"n_words": len(words), "notices": found, "tags": parsed, "score": min(scored, default=0.0)}


def _scan_batches(batches):

    kind = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("notices", pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64())]))),
        ("tags", pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("start", pa.int64())]))),
        ("score", pa.float64()),
    ])
    for batch in batches:
        data, at = flat(batch["text"])
        rows = [scan(data[at[i] : at[i + 1]].tobytes()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[f.name] for r in rows], f.type) for f in list(kind)[1:])], schema=kind)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its notices (places from word 0), its tags with their parsed expressions, and
    score, the freedom of the strictest notice or tag (0 without any)."""
    return map_batches(narrow(docs, id_col, text_col, binary=True), _scan_batches, SCHEMA)


def op1(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    base = F.filter("notices", lambda x: x["phrase"].isin(*BASE))
    places = F.transform(base, lambda x: x["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    label = lambda x: x["label"]
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(F.transform(base, label)).alias("base_labels"),
        joined(F.concat(F.transform("notices", label), F.flatten(F.transform("tags", lambda x: x["labels"])))).alias("labels"),
        "score", F.size(F.filter("tags", lambda x: x["valid"])).cast("long").alias("n_expressions"),
    )
