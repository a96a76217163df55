"""Names for repeated word sequences by recompression (used by operator 1).

The word sequence of every document is shortened: maximal runs of one word
become one symbol, then, round by round, pairs of a "left" and a "right" symbol
do. A symbol's side is a bit of its name and a new name is a fingerprint of what
it replaces, so equal stretches get equal names in every task and no table of
names has to be moved. Names only propose candidates; equality is settled on
cryptographic digests of the words themselves (``Words.digests``).

For each symbol the rounds keep the stretch of words that its creation looked
at. A window that holds this whole stretch, and some words on both sides of the
symbol, holds the symbol wherever the window's words occur. Each window is
represented by one such symbol, its anchor: one of the latest round, of these
the one with the largest name. Equal windows so have equal anchors, and a repeat
of many windows shares a few anchors.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_STEP, _LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Rounds of pairs, and words on both sides of an anchor that its key includes.
ROUNDS, MARGIN = 3, 3


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _mix_other(x: np.ndarray) -> np.ndarray:
    """As ``mix``, with other shifts and factors."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed.

    Fingerprints of short stretches by which rows find each other; never proof of
    equality, since such sums have structured collisions.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of values[i] * base**i over each prefix."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of values[start:end]; equal stretches give equal ones."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U) * _STEP)


#: Bytes from which on a word is named by BLAKE2b instead of in steps of 8 bytes.
LONG_WORD = 256


def _word_names(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each word, independent from its bytes on; ``raw`` goes on for 8 bytes after the last.

    Each takes in 8 bytes per step by a bijection of its own, so words of up to 8
    bytes of one length have different names.
    """
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 8 bytes from every place on
    size = end - begin
    one, two = mix(size.astype(U) * _STEP), _mix_other(size.astype(U) * _LEFT)
    live = np.arange(len(size)) if not len(size) or size.max() < LONG_WORD else np.flatnonzero(size < LONG_WORD)
    done = 0
    while len(live):
        left = np.minimum(size[live] - done, 8)
        piece = eight[begin[live] + done] & (~U(0) >> ((8 - left) * 8).astype(U))
        one[live] = mix(one[live] ^ piece)
        two[live] = _mix_other(two[live] + piece * _RIGHT)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size >= LONG_WORD).tolist():
        one[i], two[i] = np.frombuffer(blake2b(raw[begin[i] : end[i]], digest_size=16).digest(), "<u8")
    return one, two


class Words:
    """The words of some texts.

    ``names`` and ``others``: two independent uint64 per word; ``begin``/``end``: its
    bytes in ``raw``; ``first``: the index of each text's first word, with a last
    entry for the end; ``owner``: each word's text.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, bytes(8)])
        flat = np.frombuffer(self.raw, np.uint8)[:-8]
        self.blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
        edge = np.diff(np.concatenate([[True], self.blank]).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.names, self.others = _word_names(self.raw, self.begin, self.end)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.begin, ends)])
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def digests(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """BLAKE2b-128 of words low to high - 1 with one blank between them, as rows of two int64."""
        flat = np.frombuffer(self.raw, np.uint8)[:-8]
        stay = ~self.blank
        stay[self.end] = True
        plain = flat[stay]
        plain[self.blank[stay]] = 32
        plain = plain.tobytes()
        stop = np.cumsum(self.end - self.begin + 1) - 1
        start = stop - (self.end - self.begin)
        made = [blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(start[low].tolist(), stop[high - 1].tolist())]
        return np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)


ONE = Powers(0x9FB21C651E98DF25)


def _runs(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one word: name, text, first word, and what they looked at."""
    n, far = len(name), 2 * len(name) + 1000
    same = doc[1:] == doc[:-1]
    start = np.flatnonzero(np.concatenate([[True], ~(same & (name[1:] == name[:-1]))]))
    last = np.concatenate([start[1:], [n]]) - 1
    low = np.where(np.concatenate([[True], ~same])[start], -far, start - 1)  # a run's ends need both neighbours
    high = np.where(np.concatenate([~same, [True]])[last], far, last + 2)
    size = last - start + 1
    named = np.where(size > 1, mix(name[start] * _LEFT + size.astype(U) * _RIGHT), name[start])
    return named, doc[start], start, low, high


def _pairs(name: np.ndarray, doc: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, r: int) -> tuple[np.ndarray, ...]:
    """One round of pairs: a left symbol and the right symbol after it become one."""
    far = 2 * int(high[-1] + 1000)
    right = ((name >> U(r + 1)) & U(1)).astype(bool)
    same = doc[1:] == doc[:-1]
    joins = np.concatenate([~right[:-1] & right[1:] & same, [False]])
    at = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
    nxt = np.minimum(at + 1, len(name) - 1)
    pair, right = joins[at], right[at]
    before = np.concatenate([[-far], np.where(same, low[:-1], -far)])[at]
    after = np.concatenate([np.where(same, high[1:], far), [far]])[at]
    # a lone right symbol has looked to its left, a lone left one to its right
    new_low = np.where(right & ~pair, np.minimum(low[at], before), np.where(pair, np.minimum(low[at], low[nxt]), low[at]))
    new_high = np.where(~right | pair, np.maximum(high[at], after), high[at])
    made = np.where(pair, mix(name[at] * _LEFT + name[nxt] * _RIGHT + U(r + 1)), name[at])
    return made, doc[at], start[at], new_low, new_high


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: its key, the first and the last window start.

    The key is the fingerprint of the anchor's words and up to ``MARGIN`` words on
    both sides. Every window of every text lies in exactly one stretch.
    """
    n = len(words.names)
    margin = min(MARGIN, (window - 1) // 2)
    level = (words.names, words.owner, np.arange(n), np.arange(n), np.arange(1, n + 1))
    levels = [level]
    if n:
        level = _runs(*level[:2])
        levels.append(level)
        for r in range(ROUNDS):
            level = _pairs(*level, r)
            levels.append(level)
    sums = ONE.prefix(words.names)
    starts = np.arange(n)
    todo = starts <= np.repeat(words.first[1:] - window, np.diff(words.first))  # windows that have no anchor yet
    chosen, key = np.full(n, -1, np.int64), np.zeros(n, U)
    bits = U(int(n).bit_length())
    for k in range(len(levels) - 1, -1, -1):
        if not todo.any():
            break
        name, _, start, low, high = levels[k]
        stop = np.append(start[1:], n)
        low, high = np.minimum(low, start - margin), np.maximum(high, stop + margin)
        fit = np.flatnonzero((high - low <= window) & (low >= 0) & (high <= n))
        a, b = np.maximum(high[fit] - window, 0), low[fit]
        left = np.concatenate([[0], np.cumsum(todo)])
        some = left[b + 1] > left[a]
        fit, a, b = fit[some], a[some], b[some]
        rank = (name[fit] >> bits << bits) | (fit + 1).astype(U)  # equal names: the last one
        best = np.zeros(n, U)
        for d in range(window):
            at = a + d
            go = at <= b
            if not go.any():
                break
            np.maximum.at(best, at[go], rank[go])
        hit = np.flatnonzero(todo & (best > 0))
        index = (best[hit] & ((U(1) << bits) - U(1))).astype(np.int64) - 1
        chosen[hit] = index * len(levels) + k
        key[hit] = ONE.of(sums, start[index] - margin, stop[index] + margin)
        todo[hit] = False
    at = np.flatnonzero(chosen >= 0)
    if not len(at):
        return key[:0], at, at
    owner = words.owner[at]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(chosen[at]) != 0) | (np.diff(owner) != 0)]))
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    return key[at[head]], at[head], at[tail]
