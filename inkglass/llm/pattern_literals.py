"""Tokens that every match of a regular expression must have whole, read from the parsed pattern.

A token is a run of [0-9a-z] of the lower-cased text with none beside it. A literal run of a pattern
is one if the pattern itself bounds it on both sides: by a character, a class or an anchor that can't
be a letter or digit. Alternatives and optional parts are written out; where there would be more than
MOST of them, or one has no token, a pattern has none that it needs.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

MOST = 256
#: Atoms beside single characters: what surely isn't a letter or digit (or is a text's end), and what may be anything, or nothing.
SEPARATOR, ANYTHING = 1, 2
ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"
#: ASCII letters that letters beyond ASCII match where case is ignored (Kelvin sign, long s, dotted and dotless i).
FOLDED = "kis"


class TooMany(Exception):
    pass


def has_category(kind, c: str) -> bool:
    known = {C.CATEGORY_DIGIT: c.isdigit(), C.CATEGORY_SPACE: False, C.CATEGORY_WORD: True, C.CATEGORY_NOT_DIGIT: not c.isdigit(), C.CATEGORY_NOT_SPACE: True, C.CATEGORY_NOT_WORD: False}
    return known.get(kind, True)


def class_atom(items, flags: int) -> object:
    """The atom of a character class."""
    negated = bool(items) and items[0][0] is C.NEGATE
    rest = items[1:] if negated else items
    if not negated and len(rest) == 1 and rest[0][0] is C.LITERAL:
        return literal_atom(rest[0][1], flags)
    if flags & re.IGNORECASE and not flags & re.ASCII and any(kind is C.LITERAL and v > 127 or kind is C.RANGE and v[1] > 127 for kind, v in rest):
        return ANYTHING

    def inside(c: str) -> bool:
        return any(kind is C.LITERAL and v == ord(c) or kind is C.RANGE and v[0] <= ord(c) <= v[1] or kind is C.CATEGORY and has_category(v, c) for kind, v in rest)

    either = lambda c: inside(c) or inside(c.upper()) if flags & re.IGNORECASE else inside(c)
    cased = ALNUM + ALNUM.upper()
    can = any(either(c.lower()) != negated if flags & re.IGNORECASE else inside(c) != negated for c in cased)
    return ANYTHING if can else SEPARATOR


def literal_atom(code: int, flags: int) -> object:
    c = chr(code)
    if code > 127:
        return ANYTHING if flags & re.IGNORECASE and not flags & re.ASCII else SEPARATOR
    if c.lower() not in ALNUM:
        return SEPARATOR
    folded = flags & re.IGNORECASE and not flags & re.ASCII and c.lower() in FOLDED
    return ANYTHING if folded else c.lower()


def joined(before: list[tuple], after: list[tuple]) -> list[tuple]:
    out = list(dict.fromkeys(a + b for a in before for b in after))
    if len(out) > MOST:
        raise TooMany
    return out


def sequences(nodes, flags: int) -> list[tuple]:
    """All runs of atoms that a parsed pattern stands for."""
    out: list[tuple] = [()]
    for op, arg in nodes:
        if op is C.LITERAL:
            more: list[tuple] = [(literal_atom(arg, flags),)]
        elif op is C.IN:
            more = [(class_atom(arg, flags),)]
        elif op is C.AT:
            more = [()] if arg is C.AT_NON_BOUNDARY else [(SEPARATOR,)]
        elif op in (C.ASSERT, C.ASSERT_NOT):
            more = [()]  # takes no characters, so what is beside it stays so
        elif op is C.BRANCH:
            more = list(dict.fromkeys(s for part in arg[1] for s in sequences(part, flags)))
        elif op is C.SUBPATTERN:
            more = sequences(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is C.ATOMIC_GROUP:
            more = sequences(arg, flags)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            once = sequences(inner, flags)
            if all(s and set(s) == {SEPARATOR} for s in once):
                once = [(SEPARATOR,)]
            elif high != 1:
                once = joined(once, [(ANYTHING,)]) if low else [(ANYTHING,)]
            more = once if low else [*once, ()]
        else:
            more = [(ANYTHING,)]
        out = joined(out, more)
    return out


def tokens_of(atoms: tuple) -> frozenset[str]:
    """The tokens of one run: characters between two separators. A search may begin and end anywhere."""
    found, run, whole = set(), "", False
    for a in (*atoms, ANYTHING):
        if isinstance(a, str):
            run += a
            continue
        if run and whole and a == SEPARATOR:
            found.add(run)
        run, whole = "", a == SEPARATOR
    return frozenset(found)


def alternatives(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of tokens one of which a text that the pattern is found in has whole; none if there is no such choice."""
    parsed = _parser.parse(pattern)
    try:
        found = {tokens_of(s) for s in sequences(parsed, parsed.state.flags)}
    except TooMany:
        return ()
    if not all(found):
        return ()
    # a set that has all of another's tokens adds nothing
    return tuple(sorted(tuple(sorted(s)) for s in found if not any(o < s for o in found)))


def list_rule(line: str) -> tuple[str, str] | None:
    """(verdict, pattern) of a line of a filter list; None of an empty line or a comment (`!`, `#`, `[`).

    `||name` is a host or its subdomains, `|` the beginning or end of the URL, `^` one character that isn't a
    letter, a digit or one of `_-.%`, or the end, `*` anything, `@@` before a rule allows what it fits. Lines
    with options (`$`) or in `/`s are refused. Letters match in either case."""
    text = line.strip()
    if not text or text[0] in "!#[":
        return None
    verdict, text = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if "$" in text or not text.strip("*|^") or (len(text) > 1 and text[0] == text[-1] == "/"):
        raise ValueError(f"a rule of this form is not supported: {line}")
    begin = end = ""
    if text.startswith("||"):
        begin, text = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", text[2:]
    elif text.startswith("|"):
        begin, text = "^", text[1:]
    if text.endswith("|"):
        end, text = "$", text[:-1]
    body = "".join({"*": ".*", "^": r"(?:[^0-9a-z_.%-]|$)"}.get(c, re.escape(c)) for c in text)
    return verdict, f"(?isa){begin}{body}{end}"
