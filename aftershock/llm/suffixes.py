"""Suffixes of texts: which ones to sort, sorted front-coded runs, and their merge.

Sorting every suffix of a corpus is not needed to find repeated strings of ``span``
bytes.  Each such string holds one *anchor*, the place of the smallest hash of
``span // 2`` bytes among all places in it (the first of equal ones), which depends
on the string alone.  So equal strings have equal anchors at equal distances, and
only suffixes that begin at anchors are sorted, about one in a quarter of ``span``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from aftershock.llm.common import kept_in_worker, mixed

_BASE = 0x9E3779B97F4A7C55
# Text bytes whose hashes are held at once; places within them and a span fit into 24 bits.
_HELD = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = kept_in_worker("suffix-powers", dict)
    if len(kept.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            kept[name] = np.cumprod(p, out=p)
    return kept["up"], kept["down"]


def _seeds(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at every place; equal bytes have equal hashes, no more is needed."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    n = len(data) - size + 1
    return mixed((total[size:] - total[:-size]) * down[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``span`` bytes of all texts.

    Returns the text, the anchor's place in it, the smallest and the largest
    distance from a string's begin to the anchor (all distances between them
    occur), and a hash of the bytes there, which all those strings contain.
    """
    size, none = span // 2, np.zeros(0, np.int64)
    width = span - size + 1  # places among which a string has its anchor
    lengths = np.diff(offsets)
    change = np.zeros(len(data) + 1, np.int8)
    long = lengths >= span
    change[offsets[:-1][long]] += 1
    change[offsets[1:][long] - span + 1] -= 1
    starts = np.cumsum(change[:-1], dtype=np.int8) > 0  # where such a string begins
    places, froms, tos, hashes = [none], [none], [none], [np.zeros(0, np.uint64)]
    for a in range(0, len(data) - span + 1, _HELD):
        begin = np.flatnonzero(starts[a : a + _HELD])
        begin = begin[begin + span <= len(data) - a]
        if len(begin) == 0:
            continue
        seed = _seeds(data[a : a + int(begin[-1]) + span], size)
        # The place in the low bits tells which hash is least, and parts equal ones.
        key = ((seed >> np.uint64(24)) << np.uint64(24)) | np.arange(len(seed), dtype=np.uint64)
        rows = -(-len(key) // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(key)] = key
        grid = grid.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[begin], ahead[begin + width - 1])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(new[1:], len(at)) - 1
        places.append(at[new] + a)
        froms.append(begin[new] + a)
        tos.append(begin[last] + a)
        hashes.append(seed[at[new]])
    place, first, last, seed = (np.concatenate(x) for x in (places, froms, tos, hashes))
    # One anchor on both sides of a cut is one.
    new = np.flatnonzero(np.diff(place, prepend=-1))
    last = last[np.append(new[1:], len(place)) - 1] if len(place) else last
    place, first, seed = place[new], first[new], seed[new]
    text = np.searchsorted(offsets, place, "right") - 1
    return text, place - offsets[text], place - last, place - first, seed


def contexts(data: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> np.ndarray:
    """Keys to sort anchors by: the bytes from the anchor on, then those before it, backwards.

    Both are cut to what strings with distances from ``low`` to ``high`` cover
    and filled up with zeros, so all keys are of one length.
    """
    width = span - span // 2
    step = np.arange(span)
    at = place[:, None] + step
    ahead = data[np.minimum(at, len(data) - 1)] * (step < (span - low)[:, None])
    step = np.arange(1, width + 1)
    at = place[:, None] - step
    back = data[np.maximum(at, 0)] * (step <= high[:, None])
    return np.ascontiguousarray(np.concatenate([ahead, back], axis=1, dtype=np.uint8))


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """Row order by the rows' bytes; equal rows stay in their order."""
    if not keys.shape[1]:
        return np.arange(len(keys))
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def common_with_previous(keys: np.ndarray) -> np.ndarray:
    """Number of first bytes that each row shares with the row before; 0 for the first row."""
    out = np.zeros(len(keys), np.int64)
    for a in range(1, len(keys), 1 << 14):
        b = min(len(keys), a + (1 << 14))
        differ = keys[a:b] != keys[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return out


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows as the lengths shared with the row before, and all that follows these."""
    shared = common_with_previous(keys)
    rest = np.arange(keys.shape[1]) >= shared[:, None]
    return shared.astype("<u2"), keys[rest].tobytes()


def decoded(shared: np.ndarray, rests: bytes, length: int) -> Iterator[bytes]:
    """The rows of a front-coded run, one after the other."""
    at, key = 0, bytes(length)
    for n in shared.tolist():
        stop = at + length - n
        key = key[:n] + rests[at:stop]
        at = stop
        yield key


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length, of which ``known`` bytes are known."""
    n = len(a)
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            differ = int.from_bytes(x) ^ int.from_bytes(y)
            return known + len(x) - (differ.bit_length() + 7) // 8
        known += 64
    return n


def merged(runs: list[tuple[np.ndarray, bytes]], length: int) -> Iterator[tuple[int, bytes, int]]:
    """Merges front-coded runs: number of the run, row, and bytes shared with the row returned before.

    A tree of losers.  Every waiting row knows how many bytes it shares with the
    last winner on its path.  Of two rows the one that shares more with the last
    one returned comes first; only rows that share equally much are compared,
    from there on.  So no byte of a known prefix is looked at again.
    """
    streams = [zip(shared.tolist(), decoded(shared, rests, length), strict=True) for shared, rests in runs]
    n = 1
    while n < len(runs):
        n *= 2
    shares, rows = [0] * n, [None] * n
    for i, stream in enumerate(streams):
        shares[i], rows[i] = next(stream, (0, None))

    def play(x: int, y: int) -> tuple[int, int]:
        """The smaller row's run and the other's, which then shares with the smaller row."""
        if rows[y] is None:
            return x, y
        if rows[x] is None:
            return y, x
        if shares[x] != shares[y]:
            return (x, y) if shares[x] > shares[y] else (y, x)
        same = common(rows[x], rows[y], shares[x])
        if same < length and rows[x][same] > rows[y][same] or same == length and y < x:
            x, y = y, x
        shares[y] = same
        return x, y

    losers = [0] * (2 * n)
    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while rows[best] is not None:
        yield best, rows[best], shares[best]
        shares[best], rows[best] = next(streams[best], (0, None))
        node = (best + n) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


def repeated(
    keys: np.ndarray, shared: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray, span: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings around sorted anchors occur more than once.

    ``shared`` is what a key shares with the one before, ``times`` the number of
    its places.  Returns for each key and distance (columns) whether the string
    occurs again, and the keys and distances of the first of each different string.

    Strings at one distance are equal if the bytes after their anchors are, which
    holds for neighbours in the given order, and those before, which holds for
    neighbours in the order of the bytes read backwards.
    """
    n, width = len(keys), span - span // 2
    back = np.ascontiguousarray(keys[:, span:])
    order = sorted_order(back)
    behind = common_with_previous(back[order])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found = np.zeros((n, width + 1), bool)
    first_key, first_distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(width + 1):
        at = np.flatnonzero((low <= d) & (d <= high) & (times > 0))
        if len(at) == 0:
            continue
        after = np.cumsum(shared < span - d)[at]
        before = np.cumsum(behind < d)[place[at]]
        _, first, which = np.unique(after * (n + 1) + before, return_index=True, return_inverse=True)
        found[at, d] = np.bincount(which, times[at])[which] > 1
        first_key.append(at[first])
        first_distance.append(np.full(len(first), d))
    return found, np.concatenate(first_key), np.concatenate(first_distance)
