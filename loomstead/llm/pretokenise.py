"""Token boundaries of a batch of texts without regular expressions.

Every code point becomes a symbol (its class, with one or two code points of look-ahead folded in). Each symbol is a
transition function over a handful of states; functions compose associatively, so the states before every block of
code points come from a prefix scan over the blocks' composed functions, and one more vectorised pass marks the
boundaries. The boundaries are those of the byte-level BPE split: contractions, letters, digits, other marks, each with
at most one leading space, and runs of white space that leave their last space to what follows.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

# The code points with the Unicode property White_Space, and the contractions of the public split.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_LEAD, S_LAST, S_WHITE = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_LEAD, ONE_TO_GO, TWO_TO_GO, DONE = range(9)
STATES = 9
BLOCK = 64

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point (1.1 MB, made once a process)."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
        table[kinds == ord("L")] = LETTER
        table[kinds == ord("N")] = NUMBER
        table[WHITE_SPACE] = SPACE
        _CLASSES = table
    return _CLASSES


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag by (symbol, state); symbols 8 to 15 are the same at the start of a text."""
    step, edge = np.zeros((16, STATES), np.uint8), np.ones((16, STATES), bool)
    going_on = {
        S_LETTER: ({IN_LETTERS: IN_LETTERS, AFTER_LEAD: IN_LETTERS, TWO_TO_GO: ONE_TO_GO, ONE_TO_GO: DONE}, IN_LETTERS),
        S_NUMBER: ({IN_NUMBERS: IN_NUMBERS, AFTER_LEAD: IN_NUMBERS}, IN_NUMBERS),
        S_OTHER: ({IN_OTHER: IN_OTHER, AFTER_LEAD: IN_OTHER}, IN_OTHER),
        S_SHORT: ({IN_OTHER: IN_OTHER, AFTER_LEAD: IN_OTHER}, ONE_TO_GO),
        S_LONG: ({IN_OTHER: IN_OTHER, AFTER_LEAD: IN_OTHER}, TWO_TO_GO),
        S_LEAD: ({}, AFTER_LEAD),
        S_LAST: ({}, IN_WHITE),
        S_WHITE: ({IN_WHITE: IN_WHITE}, IN_WHITE),
    }
    for symbol, (same, otherwise) in going_on.items():
        step[symbol], step[symbol + 8] = otherwise, otherwise
        for state, following in same.items():
            step[symbol, state], edge[symbol, state] = following, False
    return step, edge


STEP, EDGE = _transitions()


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``starts`` are the places where the (non-empty) texts begin."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = kind[1:] != SPACE
    solid_next &= ~first[1:]
    found = kind.copy()
    white = kind == SPACE
    found[white] = np.where(solid_next[white], np.where(points[white] == 32, S_LEAD, S_LAST), S_WHITE)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        ends = np.append(starts[1:], n)
        last = ends[np.searchsorted(starts, marks, "right") - 1] - 1
        one = points[np.minimum(marks + 1, n - 1)]
        two = points[np.minimum(marks + 2, n - 1)]
        short = (marks + 1 <= last) & np.isin(one, [ord(c) for c in ONE_LETTER])
        pair = one.astype(np.int64) << 32 | two
        long = (marks + 2 <= last) & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS])
        found[marks[short]] = S_SHORT
        found[marks[long]] = S_LONG
    found[starts] += 8
    return found


def scan_edges(sym: np.ndarray) -> np.ndarray:
    """Boundary flags by an associative scan of the transition functions."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    columns = np.full(blocks * BLOCK, S_WHITE, np.uint8)
    columns[:n] = sym
    columns = np.ascontiguousarray(columns.reshape(blocks, BLOCK).T)
    flat = STEP.ravel()
    acting = STEP[columns[0]]
    for row in columns[1:]:
        acting = flat[row.astype(np.intp)[:, None] * STATES + acting]
    reach = 1
    while reach < blocks:  # acting[i] becomes the composition of blocks 0..i
        acting[reach:] = np.take_along_axis(acting[reach:], acting[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.empty(blocks, np.intp)
    state[0] = FRESH
    state[1:] = acting[:-1, FRESH]
    edges = np.empty((BLOCK, blocks), bool)
    flags = EDGE.ravel()
    for j, row in enumerate(columns):
        at = row.astype(np.intp) * STATES + state
        edges[j] = flags[at]
        state = flat[at].astype(np.intp)
    return edges.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Pieces of all texts in order, and the number of pieces of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    if not whole:
        return [], np.zeros(len(texts), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(lengths) - lengths
    starts = begin[lengths > 0]
    edges = np.flatnonzero(scan_edges(symbols(points, starts)))
    bounds = edges.tolist()
    counts = np.searchsorted(edges, begin + lengths) - np.searchsorted(edges, begin)
    return [whole[a:b] for a, b in zip(bounds, bounds[1:] + [len(whole)])], counts
