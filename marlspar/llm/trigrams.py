"""Boolean trigram queries from regular expressions.

Every match of the expression must hold all trigrams of at least one clause, on lower-cased text. An
expression without mandatory trigrams gives no clauses and needs a full scan. Text is never read here.
"""

from __future__ import annotations

from itertools import product
from re import _constants as codes
from re import _parser

#: Strings that a part may spell out, and clauses of a query, before the part counts as unknown.
MOST = 64


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(clauses) -> frozenset[frozenset[str]]:
    """Without clauses that hold another one."""
    kept: list[frozenset[str]] = []
    for clause in sorted(set(clauses), key=lambda x: (len(x), sorted(x))):
        if not any(x <= clause for x in kept):
            kept.append(clause)
    return frozenset(kept)


_TRUE = frozenset([frozenset()])


def _both(a, b):
    if len(a) * len(b) > MOST:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _least(x | y for x, y in product(a, b))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is codes.LITERAL:
            out.add(chr(value).lower())
        elif kind is codes.RANGE and value[1] - value[0] < 2 * MOST:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
        if len(out) > 8:
            return None
    return out


def _part(kind, value) -> tuple[set[str] | None, frozenset]:
    """(all strings it can spell, or None; its query where it is None)"""
    if kind is codes.LITERAL:
        return {chr(value).lower()}, _TRUE
    if kind is codes.IN:
        return _class(value), _TRUE
    if kind is codes.AT:
        return {""}, _TRUE
    if kind is codes.SUBPATTERN:
        return _sequence(value[3])
    if kind is codes.BRANCH:
        found = [_sequence(x) for x in value[1]]
        if all(x[0] is not None for x in found) and len(spelled := set().union(*(x[0] for x in found))) <= MOST:
            return spelled, _TRUE
        return None, _least(c for spelled, q in found for c in (q if spelled is None else map(_grams, spelled)))
    if kind in (codes.MAX_REPEAT, codes.MIN_REPEAT):
        low, high, inner = value
        spelled, query = _sequence(inner)
        if spelled is not None and high <= 4 and len(spelled) ** high <= MOST:
            return {"".join(x) for n in range(low, high + 1) for x in product(spelled, repeat=n)}, _TRUE
        if not low:
            return None, _TRUE
        return None, query if spelled is None else _least(map(_grams, spelled))
    return None, _TRUE


def _sequence(items) -> tuple[set[str] | None, frozenset]:
    query, spelled, exact = _TRUE, {""}, True
    for kind, value in items:
        own, own_query = _part(kind, value)
        if own is None and kind in (codes.MAX_REPEAT, codes.MIN_REPEAT) and value[0]:
            once = _sequence(value[2])[0]  # what is repeated stands here once at least
            if once is not None and len(once) * len(spelled) <= MOST:
                spelled = {a + b for a in spelled for b in once}
        if own is not None and len(own) * len(spelled) <= MOST:
            spelled = {a + b for a in spelled for b in own}
            continue
        exact = False
        query = _both(query, _least(map(_grams, spelled)))
        if own is None:
            query, spelled = _both(query, own_query), {""}
        else:
            spelled = own
    if exact:
        return spelled, _TRUE
    return None, _both(query, _least(map(_grams, spelled)))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses, any of which a match's text must fulfil whole; none if there are no mandatory trigrams."""
    spelled, query = _sequence(_parser.parse(pattern))
    clauses = query if spelled is None else _least(map(_grams, spelled))
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)
