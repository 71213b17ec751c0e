"""Pre-tokenisation without regular expressions: code point classes and a scan over transition functions."""

from __future__ import annotations

import numpy as np

from .textgrid import kept

LETTER, NUMBER, OTHER, LED, LAST, INNER, SHORT, LONG = range(8)  # classes; LED: space before a solid sign, LAST: other white space there
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_SPACES, ONE_MORE, TWO_MORE = range(8)  # states
BLOCK = 256


def automaton(lone_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a slice starts here" for 16 classes (the second eight: at a text's first code point) x 8 states.

    ``lone_numbers``: each number is a slice, as for the word vocabulary; else numbers go together.
    """
    go, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for kind, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        go[kind] = own
        cut[kind, [own, AFTER_SPACE]] = False
    for kind, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        go[kind] = state
        go[kind, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        cut[kind, [IN_OTHERS, AFTER_SPACE]] = False
    go[LETTER, ONE_MORE], go[LETTER, TWO_MORE] = FRESH, ONE_MORE
    cut[LETTER, [ONE_MORE, TWO_MORE]] = False
    go[LED], go[LAST], go[INNER] = AFTER_SPACE, FRESH, IN_SPACES
    cut[INNER, IN_SPACES] = False
    if lone_numbers:
        cut[NUMBER] = True
    go[8:] = go[:8, FRESH][:, None]
    return go.ravel(), cut.ravel()


class Classes:
    """Letter, number, white space or other: the splitting library's own tables, asked once per code point."""

    def __init__(self) -> None:
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        self.ask = [tiktoken.Encoding(f"class {p}", pat_str=p, mergeable_ranks=single, special_tokens={}) for p in (r"\p{L}", r"\p{N}", r"\s")]
        self.table = np.full(0x110000, 255, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        if (got == 255).any():
            for c in np.unique(points[got == 255]).tolist():
                letter, number, space = (bool(a.encode_ordinary(chr(c))) for a in self.ask)
                self.table[c] = LETTER if letter else NUMBER if number else INNER if space else OTHER
            got = self.table[points]
        return got


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each code point with its look-ahead; ``first`` holds where texts begin."""
    kind = kept("code point classes", Classes).of(points).copy()
    edge = np.zeros(len(points) + 2, bool)
    edge[first] = True
    edge[len(points):] = True
    space, after = kind == INNER, np.append(kind[1:], INNER)
    led = space & (after != INNER) & ~edge[1:-1]
    kind[led] = np.where(points[led] == 32, LED, LAST)
    quote = np.flatnonzero((points == 39) & ~edge[1:-1])
    one = points[quote + 1]
    kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = quote[~edge[quote + 2]]
    two = points[pairs + 1].astype(np.int64) << 32 | points[pairs + 2]
    kind[pairs[np.isin(two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    kind[first[first < len(points)]] += 8
    return kind


def slice_starts(kind: np.ndarray, lone_numbers: bool = False) -> np.ndarray:
    """Which code points start a slice: the scan over composed transition functions."""
    go, cut = kept(f"automaton {lone_numbers}", lambda: automaton(lone_numbers))
    n, m = len(kind), -(-len(kind) // BLOCK)
    rows = np.full(m * BLOCK, LAST, np.int64)
    rows[:n] = kind
    rows = np.ascontiguousarray(rows.reshape(m, BLOCK).T) * 8
    maps = np.tile(np.arange(8, dtype=np.uint8), (m, 1))  # each block's function of its first state
    for own in rows:
        maps = go[own[:, None] + maps]
    step = 1
    while step < m:  # maps[i]: blocks up to i, composed
        later = maps.copy()
        later[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        maps, step = later, step * 2
    state = np.full(m, FRESH, np.int64)
    state[1:] = maps[:-1, FRESH]
    found = np.zeros((BLOCK, m), bool)
    for i, own in enumerate(rows):
        at = own + state
        found[i], state = cut[at], go[at]
    return found.T.ravel()[:n]


def slices(data: np.ndarray, offsets: np.ndarray, lone_numbers: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of all texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.unique(np.searchsorted(lead, offsets[:-1][offsets[:-1] < len(data)]))
    starts = lead[slice_starts(classes(points, first), lone_numbers)]
    return starts, np.append(starts[1:], len(data))
