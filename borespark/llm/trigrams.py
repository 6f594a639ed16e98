"""Boolean trigram queries derived from regular expressions.

A query is a tree: True (any text may match), a trigram, ("and", ...), or ("or", ...). A text that matches the expression
satisfies the query, never the other way round. Trigrams are lower-cased, so the index folds case. The expression's parse
tree comes from Python's own regular expression module.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

MOST = 16  # exact strings followed at once; more are given up as "anything"


def _strings(node) -> set[str] | None:
    """The lower-cased strings that one element can match, if few; else None."""
    kind, arg = node
    if kind is C.LITERAL:
        return {chr(arg).lower()}
    if kind is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 6:
        return {chr(x).lower() for _, x in arg}
    if kind is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if kind is C.BRANCH:
        every = [_sequence_strings(x) for x in arg[1]]
        return None if any(x is None for x in every) or sum(map(len, every)) > MOST else set().union(*every)
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
        one = _sequence_strings(arg[2])
        if one is not None:
            out, power = set(), {""}
            for n in range(arg[1] + 1):
                out |= power if n >= arg[0] else set()
                power = {a + b for a in power for b in one}
                if len(out) + len(power) > MOST:
                    return None
            return out
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _strings(node)
        if one is None:
            return None
        out = {a + b for a in out for b in one}
        if len(out) > MOST:
            return None
    return out


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(found: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(found)])


def _query(nodes) -> object:
    """Runs of elements with few exact strings give trigrams; what lies between gives its own query."""
    parts, run = [], {""}
    for node in nodes:
        one = _strings(node)
        longer = {a + b for a in run for b in one} if one is not None else None
        if longer is not None and len(longer) <= MOST:
            run = longer
            continue
        parts.append(_of_strings(run))
        run = one if one is not None else {""}
        kind, arg = node
        if one is None and kind is C.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif one is None and kind is C.BRANCH:
            parts.append(_any([_query(x) for x in arg[1]]))
        elif one is None and kind in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query([*arg[2]] * min(arg[0], 3)))
    return _all([*parts, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The query of a pattern; True means that it has no mandatory trigram and needs a full scan."""
    return _query(parser.parse(pattern))


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1:]))
