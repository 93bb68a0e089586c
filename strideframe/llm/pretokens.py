"""Pre-token boundaries from code-point classes, without a regular expression.

The pattern that both byte-level vocabularies split by is::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point becomes one of nine symbols (its class, with one or two code
points of look-ahead where the pattern looks ahead). A symbol is a function from
the state before it to the state after it; functions compose associatively, so
the state before any code point is a prefix scan over them. The finite set of
all compositions is tabulated once, and the scan works on table entries for many
blocks of text at a time.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, BLANK, END = range(6)

#: The code points that the pattern's \s matches.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers that Unicode 16 has, by which the encoding library splits, and Unicode 15.1 has not.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# Symbols. SPACE_LAST and BLANK_LAST stand before a visible code point, GAP does not.
S_OTHER, S_LETTER, S_NUMBER, S_SPACE_LAST, S_BLANK_LAST, S_GAP, S_SHORT, S_LONG, S_END = range(9)
SYMBOLS = 9
# States: what the pre-token that the last code point belongs to may go on with.
FRESH, PREFIXED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
WIDTH = 256


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[WHITE_SPACE] = BLANK
    out[0x20] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at the code point."""
    if symbol == S_END:
        return FRESH, True
    if symbol == S_SPACE_LAST:
        return PREFIXED, True
    if symbol == S_BLANK_LAST:
        return FRESH, True
    if symbol == S_GAP:
        return IN_GAP, state != IN_GAP
    if symbol == S_LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIXED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIXED)
    if state in (IN_OTHERS, PREFIXED):
        return IN_OTHERS, False
    return {S_OTHER: IN_OTHERS, S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}[symbol], True


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next states and starts by (state, symbol); symbols as functions; compositions; functions."""
    steps = [[_step(q, s) for s in range(SYMBOLS)] for q in range(STATES)]
    functions = [tuple(range(STATES))]
    known = {functions[0]: 0}

    def number(f: tuple[int, ...]) -> int:
        if f not in known:
            known[f] = len(functions)
            functions.append(f)
        return known[f]

    generators = [number(tuple(steps[q][s][0] for q in range(STATES))) for s in range(SYMBOLS)]
    done = 0
    while done < len(functions):  # close under composition with a symbol
        for g in generators:
            number(tuple(functions[g][q] for q in functions[done]))
        done += 1
    compose = [[number(tuple(g[q] for q in f)) for g in functions] for f in functions]
    return (
        np.array([[x[0] for x in row] for row in steps], np.uint8).ravel(),
        np.array([[x[1] for x in row] for row in steps], bool).ravel(),
        np.array(generators, np.intp),
        np.array(compose, np.intp),
        np.array(functions, np.uint8),
    )


def _symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    cls = class_table()[cp]
    cls[ends] = END
    after = np.append(cls[1:], np.uint8(END))
    visible = after < SPACE
    sym = cls.copy()  # OTHER, LETTER and NUMBER are their own symbols
    sym[(cls == SPACE) & visible] = S_SPACE_LAST
    sym[(cls == BLANK) & visible] = S_BLANK_LAST
    sym[((cls == SPACE) | (cls == BLANK)) & ~visible] = S_GAP
    sym[ends] = S_END
    quotes = np.flatnonzero(cp == ord("'"))
    quotes = quotes[sym[quotes] == S_OTHER]
    if len(quotes):
        size = len(cp)
        one = cp[np.minimum(quotes + 1, size - 1)]
        two = cp[np.minimum(quotes + 2, size - 1)]
        # A separator stands in for a code point 0, which is none of these letters.
        sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        sym[quotes[pairs]] = S_LONG
    return sym


def starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``ends`` are the separators of texts."""
    step, begins, generators, compose, functions = _tables()
    sym = _symbols(cp, ends)
    n = len(sym)
    blocks = -(-n // WIDTH)
    columns = np.full(blocks * WIDTH, S_END, np.uint8)
    columns[:n] = sym
    columns = np.ascontiguousarray(columns.reshape(blocks, WIDTH).T)
    # Each block's function, all blocks side by side.
    held, m = np.zeros(blocks, np.intp), compose.shape[0]
    flat = compose.ravel()
    for column in columns:
        held = flat[held * m + generators[column]]
    # The state before each block: a scan that composes functions over twice the distance in each round.
    reach = 1
    while reach < blocks:
        held = np.concatenate((held[:reach], flat[held[:-reach] * m + held[reach:]]))
        reach *= 2
    before = np.concatenate(([FRESH], functions[held[:-1], FRESH])).astype(np.intp)
    out = np.empty(columns.shape, bool)
    for i, column in enumerate(columns):
        at = before * SYMBOLS + column
        out[i] = begins[at]
        before = step[at].astype(np.intp)
    return out.T.ravel()[:n]


def split_batch(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, the byte offsets of pre-tokens' starts and ends, and each text's first pre-token (with the total last)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    at = np.flatnonzero(starts(cp, ends))
    data = joined.encode()
    if len(data) == len(cp):
        offsets = at
        end_offsets = ends
    else:
        sizes = (1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)
        all_offsets = np.cumsum(sizes) - sizes
        offsets, end_offsets = all_offsets[at], all_offsets[ends]
    first = np.searchsorted(offsets, np.concatenate(([0], end_offsets + 1)))
    first -= np.arange(len(texts) + 1)  # separators count as starts
    real = np.ones(len(offsets), bool)
    real[np.searchsorted(offsets, end_offsets)] = False
    return data, offsets[real], np.append(offsets[1:], len(data))[real], first
