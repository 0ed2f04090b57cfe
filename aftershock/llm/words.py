"""Words of many texts at once, as numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from aftershock.llm.common import kept_in_worker, mixed

_BASE = 0x9E3779B97F4A7C55
_ODD = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def is_space(data: np.ndarray) -> np.ndarray:
    """Blank and the control characters from tab to carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(inside: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None):
    """Maximal runs of ``inside`` bytes that do not cross a text's end or a break.

    ``breaks`` marks bytes before which a run ends.  Returns starts, ends and
    the number of the text.
    """
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[n] = True
    if breaks is not None:
        cut[:n] |= breaks
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


# Spans of as many bytes are numbers themselves, so different ones have different hashes.
SHORT = 7
# Places in a span for which the values of all bytes are kept.
_KEPT_PLACES = 64


def _values(code: np.ndarray) -> np.ndarray:
    """A number for each byte at each place (``256 * place + byte``), without any structure."""
    return mixed(mixed((code.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)) + np.uint64(_ODD[3]))


def _long_hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of one mixed number for each byte and its place, mixed with the length.

    Unlike a polynomial it has no known texts with equal hashes.
    """
    table = kept_in_worker("byte-values", lambda: _values(np.arange(256 * _KEPT_PLACES)))
    stops = np.cumsum(size)
    total = np.zeros(int(stops[-1]) + 1, np.uint64)
    place = np.arange(len(total) - 1) - np.repeat(stops - size, size)
    code = (place << 8) + data[place + np.repeat(starts, size)]
    values = table[np.minimum(code, len(table) - 1)]
    far = np.flatnonzero(place >= _KEPT_PLACES)
    values[far] = _values(code[far])
    np.cumsum(values, out=total[1:])
    return mixed((total[stops] - total[stops - size]) ^ (size.astype(np.uint64) * np.uint64(_ODD[4])))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same in every text and task; spans do not overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]).view("<u8").ravel()
    short = np.minimum(size, SHORT).astype(np.uint64)
    kept = (np.uint64(1) << (short * np.uint64(8))) - np.uint64(1)
    out = mixed((first & kept) | (short << np.uint64(56)))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] = _long_hashes(data, starts[long], size[long])
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: text numbers and hashes, both sorted.

    A text with fewer words than ``size`` has its whole word sequence as its one
    shingle; a text without words has none.
    """
    low = lowered(data)
    starts, ends, text = spans(~is_space(low), offsets)
    if len(starts) == 0:
        return text, np.zeros(0, np.uint64)
    h = span_hashes(low, starts, ends)
    n = len(offsets) - 1
    words = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    keys, owners = [], []
    if len(h) >= size:
        k = len(h) - size + 1
        whole = text[:k] == text[size - 1 :]
        at = np.flatnonzero(whole)
        x = np.full(len(at), size, np.uint64)
        for i in range(size):
            x = mixed(x * np.uint64(_ODD[i % 5]) + h[at + i])
        keys.append(x)
        owners.append(text[at])
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        x = words[short].astype(np.uint64)
        for i in range(size - 1):
            has = words[short] > i
            at = np.minimum(first[short] + i, len(h) - 1)
            x = np.where(has, mixed(x * np.uint64(_ODD[i % 5]) + h[at]), x)
        keys.append(x)
        owners.append(short)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


class IdStore:
    """Ids of chunks of text, found by hash and told apart by their bytes."""

    def __init__(self, kind: np.dtype, limit: int):
        self.kind, self.limit = kind, limit
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)  # where a chunk's ids begin
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)
        self.begin = np.zeros(0, np.int64)  # where a chunk's bytes begin
        self.length = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Chunks whose bytes are not those of the known chunk at their place."""
        length = ends - starts
        other = self.length[place] != length
        # Short ones of one length and hash are equal.
        like = np.flatnonzero(~other & (length > SHORT))
        length = length[like]
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differ = self.bytes[inside + np.repeat(self.begin[place[like]], length)] != data[
            inside + np.repeat(starts[like], length)
        ]
        if differ.any():
            other[like[np.repeat(np.arange(len(like)), length)[differ]]] = True
        return np.flatnonzero(other)

    def encode(
        self,
        data: np.ndarray,
        starts: np.ndarray,
        ask: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and the number of ids before each chunk and in all.

        Chunks begin at ``starts`` and fill the data.  ``ask`` gives the ids of new
        chunks in a row and how many each has; different chunks are asked for once.
        """
        ends = np.append(starts[1:], len(data))
        h, at, like = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._forget()
        place = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != h[inside]
        if new.any():
            raw = data.tobytes()
            spans = list(zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True))
            ids, size = ask([raw[a:b].decode() for a, b in spans])
            first = len(self.ids) + np.cumsum(size) - size
            length = np.array([b - a for a, b in spans], np.int64)
            begin = len(self.bytes) + np.cumsum(length) - length
            fresh = np.frombuffer(b"".join([raw[a:b] for a, b in spans]), np.uint8)
            self.bytes = np.concatenate([self.bytes, fresh])
            self.begin = np.insert(self.begin, place[new], begin)
            self.length = np.insert(self.length, place[new], length)
            self.ids = np.concatenate([self.ids, ids.astype(self.kind, copy=False)])
            self.keys = np.insert(self.keys, place[new], h[new])
            self.first = np.insert(self.first, place[new], first)
            self.size = np.insert(self.size, place[new], size)
            place = np.searchsorted(self.keys, h)
        size, first = self.size[place][like], self.first[place][like]
        pool, other = self.ids, self._others(data, starts, ends, place[like])
        if len(other):  # chunks with the hash of another one are not remembered
            ids, own = ask([data[starts[k] : ends[k]].tobytes().decode() for k in other.tolist()])
            size[other], first[other] = own, len(pool) + np.cumsum(own) - own
            pool = np.concatenate([pool, ids.astype(self.kind, copy=False)])
        stop = np.cumsum(size)
        source = np.repeat(first - (stop - size), size) + np.arange(stop[-1])
        return pool[source], np.concatenate([[0], stop])
