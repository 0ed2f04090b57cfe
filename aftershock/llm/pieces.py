"""SentencePiece encoding and decoding with a batched Viterbi search in NumPy.

Words of equal length form a matrix of code points and advance together, one
position at a time.  Hashes of substrings come from prefix hashes and are looked
up among the sorted hashes of the pieces; the best way to each position is kept
as a back pointer, found by a vectorised maximum.

For unigram models a way's score is the sum of its pieces' scores.  A BPE model
has no such scores, but the pieces it gives have a local property: a sequence of
pieces is the result of merging if and only if each two neighbours, merged on
their own, stay as they are.  So the search takes steps between neighbours that
merging keeps apart, and exactly one way to each position remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.common import documents_of, kept_in_worker, slices, text_bytes
from aftershock.llm.words import IdStore

_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPACE = "▁"
_SPACE_BYTES = _SPACE.encode()
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model file
_UNIGRAM, _BPE = 1, 2  # model types of the model file
_NEVER = np.int64(1) << 40
# Words whose ids a worker remembers.
REMEMBERED = 600_000
# Bits of the tables that tell most absent hashes without a search.
_SIEVE = 18


def _sieve(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _SIEVE)).astype(np.int64)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A model file as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer: dict = {}
        self.normal: dict = {}
        pieces, scores, kinds = [], [], []
        for field, value in _fields(self.library.serialized_model_proto()):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, _NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                self.normal = dict(_fields(value))
        self.bpe = trainer.get(3, _UNIGRAM) == _BPE
        if not self.bpe and trainer.get(3, _UNIGRAM) != _UNIGRAM or _USER in kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces")
        self.size = len(pieces)
        self.pieces, kinds = pieces, np.array(kinds)
        self.scores = np.array(scores)
        self.unknown = int(np.flatnonzero(kinds == _UNKNOWN)[0])
        self.byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(kinds == _BYTE):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())
        plain = [i for i in np.flatnonzero(kinds == _NORMAL) if pieces[i]]
        self._nodes(plain)
        self._decoder(kinds)
        # Words part where no piece runs from a visible character over a blank.
        self.by_word = not any(_SPACE in pieces[i].lstrip(_SPACE) for i in plain)
        self.known = IdStore(np.dtype(np.int32), REMEMBERED)

    @staticmethod
    def at(path: str) -> PieceModel:
        return kept_in_worker(("pieces", path), lambda: PieceModel(path))

    # -- tables -----------------------------------------------------------

    def _nodes(self, plain: list[int]) -> None:
        """Nodes are the pieces, then single characters of pieces that are none themselves."""
        text_of = dict(enumerate(self.pieces))
        node_of = {self.pieces[i]: int(i) for i in plain}
        for c in sorted({c for i in plain for c in self.pieces[i]} - set(node_of)):
            node_of[c] = len(text_of)
            text_of[len(text_of)] = c
        self.text_of = text_of
        self.other = len(text_of)  # any character that no piece has
        n = len(text_of) + 1
        gain = np.zeros(n)
        gain[: self.size] = self.scores
        floor = (self.scores[plain].min() if plain else 0.0) - 10.0
        gain[self.size :] = floor
        self.gain = gain
        level = {s: r for r, s in enumerate(sorted({-self.scores[i] for i in plain}))}
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.odd = np.zeros(n, bool)
        self.score_of = {self.pieces[i]: self.scores[i] for i in plain}
        usable = set(node_of.values())
        if self.bpe:
            ties = {}
            for i in plain:
                ties[self.scores[i]] = ties.get(self.scores[i], 0) + 1
            for i in sorted(plain, key=lambda i: len(self.pieces[i])):
                p = self.pieces[i]
                if len(p) == 1:
                    continue
                last = self._last_merge(p)
                if last is None:
                    usable.discard(int(i))  # merging never gives this piece
                    continue
                a, b = node_of[last[0]], node_of[last[1]]
                self.left[i], self.right[i] = a, b
                self.rank[i] = level[-self.scores[i]]
                self.odd[i] = ties[self.scores[i]] > 1 or self.odd[a] or self.odd[b]
                self.odd[i] |= max(self.rank[a], self.rank[b]) >= self.rank[i]
            made = np.flatnonzero(self.left >= 0)
            key = self.left[made] * n + self.right[made]
            order = np.argsort(key)
            self.pair_keys, self.pair_nodes = key[order], made[order]
            self.pair_maybe = np.zeros(1 << _SIEVE, bool)
            self.pair_maybe[_sieve(self.pair_keys.astype(np.uint64) * _BASE)] = True
        self.apart: dict[tuple[int, int], bool] = {}
        # Sorted hashes of the usable pieces, by length.
        self.longest = max((len(text_of[i]) for i in usable), default=1)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for m in range(1, self.longest + 1):
            nodes = np.array([i for i in usable if len(text_of[i]) == m], np.int64)
            codes = np.array([[ord(c) for c in text_of[i]] for i in nodes], np.int64).reshape(-1, m)
            h = self._prefix_hashes(codes)[:, -1]
            order = np.argsort(h)
            maybe = np.zeros(1 << _SIEVE, bool)
            maybe[_sieve(h)] = True
            self.by_length.append((h[order], nodes[order], codes[order], maybe))
        pairs = {(ord(a) << 21) | ord(b) for i in usable for a, b in zip(text_of[i], text_of[i][1:], strict=False)}
        self.inner_pairs = np.array(sorted(pairs), np.int64)

    def _merged(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, then from the left."""
        out = list(text)
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = self.score_of.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        out = list(piece)
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = self.score_of.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return None
            if len(out) == 2:
                return out[0], out[1]
            out[at : at + 2] = [out[at] + out[at + 1]]
        return None

    def _decoder(self, kinds: np.ndarray) -> None:
        shown = []
        for i, p in enumerate(self.pieces):
            if kinds[i] == _BYTE:
                shown.append(bytes([int(p[3:5], 16)]))
            elif kinds[i] == _CONTROL:
                shown.append(b"")
            elif kinds[i] == _UNKNOWN:
                shown.append(" ⁇ ".encode())
            else:
                shown.append(p.replace(_SPACE, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_size)[:-1]])

    # -- encoding ---------------------------------------------------------

    @staticmethod
    def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            h[:, k + 1] = h[:, k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
        return h

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps two neighbouring nodes as they are."""
        ok = np.ones(len(a), bool)
        special = self.odd[a] | self.odd[b]
        for k in np.flatnonzero(special):
            key = (int(a[k]), int(b[k]))
            if key not in self.apart:
                x, y = self.text_of.get(key[0]), self.text_of.get(key[1])
                # Any character without pieces parts its neighbours.
                self.apart[key] = x is None or y is None or self._merged(x + y) == [x, y]
            ok[k] = self.apart[key]
        at = np.flatnonzero(~special & (a != self.other) & (b != self.other))
        n = len(self.rank)
        x, y = a[at], b[at]
        until_x = np.full(len(at), _NEVER)
        until_y = np.full(len(at), _NEVER)
        while len(at):
            key = x * n + y
            some = np.flatnonzero(self.pair_maybe[_sieve(key.astype(np.uint64) * _BASE)])
            found = np.searchsorted(self.pair_keys, key[some])
            hit = np.minimum(found, len(self.pair_keys) - 1)
            hit = self.pair_keys[hit] == key[some] if len(self.pair_keys) else np.zeros(0, bool)
            some, rank = some[hit], self.rank[self.pair_nodes[found[hit]]]
            # The pair merges while both parts exist: before either is merged
            # into its own whole; of equal merges the left one comes first.
            some = some[(rank < until_x[some]) & (rank <= until_y[some])]
            merges = np.zeros(len(at), bool)
            merges[some] = True
            ok[at[some]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~merges & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            until_x, until_y = until_x[go], until_y[go]
            open_x = rx > ry
            until_x, until_y = np.where(open_x, rx, until_x), np.where(open_x, until_y, ry)
            x, y = np.where(open_x, self.right[x], x), np.where(open_x, y, self.left[y])
        return ok

    def _look_up(
        self, h: np.ndarray, codes: np.ndarray, end: int, m: int, power: np.uint64
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose ``m`` characters before ``end`` are a piece, and its node."""
        hashes, nodes, texts, maybe = self.by_length[m - 1]
        if len(hashes) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sub = h[:, end] - h[:, end - m] * power
        at = np.flatnonzero(maybe[_sieve(sub)])
        probe = np.minimum(np.searchsorted(hashes, sub[at]), len(hashes) - 1)
        same = hashes[probe] == sub[at]
        for k in range(m):
            same &= texts[probe, k] == codes[at, end - m + k]
        return at[same], nodes[probe[same]]

    def _search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and lengths of the best last piece at each position, for words of one length."""
        n, size = codes.shape
        h = self._prefix_hashes(codes)
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0.0
        node = np.full((n, size + 1), -1, np.int64)
        back = np.zeros((n, size + 1), np.int64)
        power = _BASE
        powers = [np.uint64(1)]
        for _ in range(self.longest):
            powers.append(power)
            power = np.uint64((int(power) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF)
        for end in range(1, size + 1):
            rows, news, sizes = [], [], []
            for m in range(1, min(end, self.longest) + 1):
                at, new = self._look_up(h, codes, end, m, powers[m])
                if m == 1:  # every character is a node
                    rest = np.ones(n, bool)
                    rest[at] = False
                    rest = np.flatnonzero(rest)
                    at = np.concatenate([at, rest])
                    new = np.concatenate([new, np.full(len(rest), self.other)])
                if len(at):
                    rows.append(at)
                    news.append(new)
                    sizes.append(np.full(len(at), m))
            at, new, m = np.concatenate(rows), np.concatenate(news), np.concatenate(sizes)
            if self.bpe:
                last = node[at, end - m]
                inner = np.flatnonzero(last >= 0)
                good = np.ones(len(at), bool)
                good[inner] = self._stay_apart(last[inner], new[inner])
                at, new, m = at[good], new[good], m[good]  # one for each row
            else:
                score = total[at, end - m] + self.gain[new]
                np.maximum.at(total[:, end], at, score)
                best = score == total[at, end]
                at, new, m = at[best][::-1], new[best][::-1], m[best][::-1]  # of equal ones the shortest
            node[at, end], back[at, end] = new, m
        return node, back

    def _char_ids(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [int(self.byte_ids[b]) for b in char.encode()] if self.has_bytes else [self.unknown]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and how many each has, by groups of parts of one length."""
        joined = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.zeros(len(joined) + 1, bool)
        begin[np.concatenate([[0], np.cumsum(sizes)])] = True
        if len(joined) > 1 and len(self.inner_pairs):
            # No piece runs over these two characters, so nothing is lost here.
            key = (joined[:-1] << 21) | joined[1:]
            found = np.minimum(np.searchsorted(self.inner_pairs, key), len(self.inner_pairs) - 1)
            begin[1:-1] |= self.inner_pairs[found] != key
        cuts = np.flatnonzero(begin)
        lengths = np.diff(cuts)
        out_node = np.full(len(joined), -1, np.int64)  # at the last character of each piece
        for size in np.unique(lengths):
            starts = cuts[:-1][lengths == size]
            group = max(1, 500_000 // int(size))
            for k in range(0, len(starts), group):
                at = starts[k : k + group]
                codes = joined[at[:, None] + np.arange(size)]
                _, first, like = np.unique(self._prefix_hashes(codes)[:, -1], return_index=True, return_inverse=True)
                if (codes[first[like]] != codes).any():  # two different parts of one hash
                    first = like = np.arange(len(at))
                node, back = self._search(codes[first])
                row, end = np.arange(len(at)), np.full(len(at), size)
                while len(row):
                    out_node[at[row] + end - 1] = node[like[row], end]
                    end = end - back[like[row], end]
                    row, end = row[end > 0], end[end > 0]
        last = np.flatnonzero(out_node >= 0)
        owner = np.searchsorted(np.cumsum(sizes), last, "right")
        nodes = out_node[last]
        odd = np.flatnonzero(nodes >= self.size)  # characters without a piece
        size = np.ones(len(nodes), np.int64)
        own = [self._char_ids(chr(joined[last[k]])) for k in odd.tolist()]
        size[odd] = [len(x) for x in own]
        ids = np.repeat(nodes, size)
        at = (np.cumsum(size) - size)[odd]
        for k, x in zip(at.tolist(), own, strict=True):
            ids[k : k + len(x)] = x
        return ids.astype(np.int32), np.bincount(owner, size, len(words)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, equal to the library's, and the offsets of each text's."""
        data, offsets = text_bytes(pa.array(self.library.normalize(texts) if texts else [], pa.string()))
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin = np.zeros(len(data) + 1, bool)
        if self.by_word:  # a word begins with the first of its blanks
            blank = np.zeros(len(data) + 3, bool)
            at = np.flatnonzero(data[:-2] == _SPACE_BYTES[0])
            blank[at[(data[at + 1] == _SPACE_BYTES[1]) & (data[at + 2] == _SPACE_BYTES[2])]] = True
            begin[:-1] = blank[:-3]
            begin[3:-1] &= ~blank[:-6]
        begin[offsets] = True
        starts = np.flatnonzero(begin[:-1])
        ids, before = self.known.encode(data, starts, self._encode_words)
        bounds = before[np.searchsorted(starts, offsets)]
        if not self.has_bytes:  # neighbouring unknowns of a text are one piece
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            keep[bounds[bounds < len(ids)]] = True
            ids, bounds = ids[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
        return ids, bounds

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of many id sequences that lie one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the model")
        sizes = self.shown_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.shown_at[ids] - (ends - sizes), sizes) + np.arange(total)
        data = self.shown[source].tobytes()
        bounds = np.concatenate([[0], ends])[offsets]
        lead = self.normal.get(3, 1)  # the model's normaliser puts a blank in front
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lead and data[a : a + 1] == b" ":
                a += 1
            out.append(data[a:b].decode("utf-8", "replace"))
        return out


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """Piece ids of every whole text: ``doc_id``, ``text``, ``ids``, and if wanted ``decoded``, made from the ids.

    Ids equal the library's, without begin and end.  A null text counts as empty
    and has no ids; every row yields one row, repeated ids too; an empty table
    gives no rows; other columns are not read.  Long words are cut where no
    piece can run across, so the work is linear in a text's length.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.at(model)
        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = pieces.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            more = [pa.array(pieces.decode(ids, offsets), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists, *more], names)

    names = ["doc_id", "text", "ids"] + ["decoded"] * decoded
    schema = "doc_id long, text string, ids array<int>" + ", decoded string" * decoded
    return documents_of(docs, id_col, text_col).mapInArrow(encode, schema)


def decode_pieces(tokens: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of each id sequence; null ids give null, no ids an empty text.

    All other columns stay.  An id outside the model is an error.
    """
    schema = tokens.drop(out_col).schema.add(out_col, "string")
    kept = [c for c in tokens.columns if c != out_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.at(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column(ids_col)
                sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pieces.decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
                shown = pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), shown], [*kept, out_col])

    return tokens.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(decode, schema)
