"""Edit distances of many pairs of texts at once, compared with a bound each.

The columns of the distance tables are kept as bits, one per row for each step up and down
(Myers), in blocks of 64 rows; a step of numpy moves one block of all pairs by a column.  Only
blocks that a bounded distance can pass through are moved: what lies outside counts as if it were
reached by steps along a row or a column, which never makes a distance too small.  From time to
time pairs are left out of which no cell of the column lies on a way that is short enough.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

PAIRS = 1 << 10  # pairs at once
TABLE = 1 << 21  # entries, for a character and a block of each pair, at once
LOOK, LOOKS = 32, 16  # columns after which pairs are looked over: at least, and a share of the longest
BITS = 64
ONE, LAST, NONE, ALL = np.uint64(1), np.uint64(BITS - 1), np.uint64(0), np.uint64((1 << BITS) - 1)


def bounded(one: list[str], two: list[str], most: np.ndarray, alone: Callable[[str, str, int], bool] | None = None) -> np.ndarray:
    """Whether the edit distance of each text of ``one`` and the one of ``two`` is at most ``most``.

    ``alone`` says it of one pair, and is asked where that is cheaper: of long pairs that few others are like.
    """
    out = np.zeros(len(one), dtype=bool)
    m, n = (np.array([*map(len, x)], dtype=np.int64) for x in (one, two))
    out[(np.minimum(m, n) == 0) & (np.maximum(m, n) <= most)] = True
    rest = np.flatnonzero((np.abs(m - n) <= most) & (np.minimum(m, n) > 0))
    # pairs of like lengths and bounds go together
    rest = rest[np.lexsort((most[rest], m[rest]))]
    while len(rest):
        # those of which none has twice as many rows as another
        some = rest[:PAIRS]
        some = some[: np.searchsorted(m[some], max(BITS, 2 * m[some[0]]), side="right")]
        if alone and _dear(len(some), int(m[some[-1]]), int(most[some].max())):
            some = some[:1]
            out[some[0]] = alone(one[some[0]], two[some[0]], int(most[some[0]]))
        else:
            while True:
                some = some[np.argsort(n[some], kind="stable")]
                texts = [[side[k] for k in some.tolist()] for side in (one, two)]
                codes = [_codes(x) for x in texts]
                letters, number = _numbered(codes)
                if len(some) == 1 or letters * -(-int(m[some].max()) // BITS) * len(some) <= TABLE:
                    break
                some = rest[: len(some) // 2]
            out[some] = _run(number[codes[0]], number[codes[1]], letters, m[some], n[some], most[some])
        rest = rest[len(some) :]
    return out


def _dear(count: int, rows: int, most: int) -> bool:
    """Whether pairs cost less one by one: microseconds of a column, as measured."""
    blocks = -(-rows // BITS)
    moved = min(blocks, most // BITS + 2)
    return count * (1.5 + 0.02 * blocks) < moved * (20 + 0.045 * count)


def _numbered(codes: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """How many characters there are, and the number of each by its code."""
    number = np.zeros(max(int(x.max()) for x in codes) + 1, dtype=np.int64)
    for x in codes:
        number[x] = 1
    return int(number.sum()), np.cumsum(number) - 1


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _run(rows: np.ndarray, columns: np.ndarray, letters: int, m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The same for pairs in the order of ``n``, all with characters on both sides; ``rows`` and ``columns`` have their numbers."""
    count, blocks = len(m), int(-(-m.max() // BITS))
    # a way takes a step for each row by which it leaves its first column's place, and for each on the way back to its last one
    above, below = int(((m - n - most) // 2).min()), int(((m - n + most + 1) // 2).max())
    # the rows of each character: a bit table per block, with an entry for each pair and character
    pair = np.repeat(np.arange(count), m)
    row = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
    has = np.zeros(blocks * count * letters, dtype=np.uint64)
    np.add.at(has, ((row // BITS) * count + pair) * letters + rows, ONE << (row % BITS).astype(np.uint64))
    has = has.reshape(blocks, -1)
    # the characters of column j, as places in the table; they end at different columns
    across = np.zeros((int(n.max()), count), dtype=np.int64)
    pair = np.repeat(np.arange(count), n)
    across[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n), pair] = pair * letters + columns

    out = np.zeros(count, dtype=bool)
    live = np.arange(count)
    up, down = np.full((blocks, count), ALL), np.zeros((blocks, count), dtype=np.uint64)
    cost = np.zeros((blocks, count), dtype=np.int64)  # at the last row of each block
    low, high, room = 0, -1, None
    look = max(LOOK, len(across) // LOOKS)
    for j in range(1, len(across) + 1):
        while high < min(blocks - 1, max(0, j + below - 1) // BITS):
            high += 1
            # as if all its rows were reached by steps down the column before
            cost[high] = (cost[high - 1] if high else j - 1) + BITS
        low = max(low, (j + above - 1) // BITS)
        at = across[j - 1]
        if room is None or room.shape[1] != len(at):
            room = np.empty((7, len(at)), dtype=np.uint64)
        same, level, carry, rise, fall, gain, loss = room
        gain[:], loss[:] = 1, 0
        for b in range(low, high + 1):
            u, d = up[b], down[b]
            np.take(has[b], at, out=same, mode="clip")
            np.bitwise_or(same, d, out=level)
            same |= loss
            np.bitwise_and(same, u, out=carry)
            carry += u
            carry ^= u
            carry |= same
            np.bitwise_or(carry, u, out=rise)
            np.invert(rise, out=rise)
            rise |= d
            np.bitwise_and(u, carry, out=fall)
            # the steps along the last row, which the next block begins with
            np.right_shift(rise, LAST, out=same)
            np.right_shift(fall, LAST, out=carry)
            cost[b] += same.view(np.int64)
            cost[b] -= carry.view(np.int64)
            rise <<= ONE
            rise |= gain
            fall <<= ONE
            fall |= loss
            gain, same, loss, carry = same, gain, carry, loss
            np.bitwise_and(rise, level, out=d)
            level |= rise
            np.invert(level, out=level)
            np.bitwise_or(fall, level, out=u)
        ended = int(np.searchsorted(n, j, side="right"))
        if ended:
            b = (m[:ended] - 1) // BITS
            k = np.arange(ended)
            beyond = _from(m[:ended] - b * BITS)
            steps = np.bitwise_count(up[b, k] & beyond).astype(np.int64) - np.bitwise_count(down[b, k] & beyond)
            out[live[:ended]] = cost[b, k] - steps <= most[:ended]
        if j % look == 0 and j < len(across):
            keep = np.flatnonzero(_possible(up[low : high + 1], down[low : high + 1], cost[low : high + 1], low, j, m, n, most))
            keep = keep[keep >= ended]
            if len(keep) <= 0.9 * len(live):
                ended, live, m, n, most, up, down, cost, across = 0, live[keep], m[keep], n[keep], most[keep], up[:, keep], down[:, keep], cost[:, keep], across[:, keep]
        if ended:
            live, m, n, most, up, down, cost, across = live[ended:], m[ended:], n[ended:], most[ended:], up[:, ended:], down[:, ended:], cost[:, ended:], across[:, ended:]
        if not len(live):
            break
    return out


def _from(bit: np.ndarray) -> np.ndarray:
    """The bits from a number on, none for 64."""
    return np.where(bit < BITS, ALL << np.minimum(bit, BITS - 1).astype(np.uint64), NONE)


def _possible(up, down, cost, low: int, j: int, m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether some way through column ``j`` may still be short enough, given what rows and columns are left."""
    rows = (low * BITS + np.arange(1, len(up) * BITS + 1, dtype=np.int32))[None, :]
    bits = [np.unpackbits(np.ascontiguousarray(x.T).astype("<u8").view(np.uint8), axis=1, bitorder="little") for x in (up, down)]
    steps = np.cumsum(bits[0].view(np.int8) - bits[1].view(np.int8), axis=1, dtype=np.int32)
    over = (m - n + j).astype(np.int32)
    top = cost[-1] - steps[:, -1]  # the row above
    # cells below the last row of a text cost more than it does, so they do no harm
    steps += np.abs(rows - over[:, None])
    return top + np.minimum(steps.min(axis=1), np.abs(low * BITS - over)) <= most
