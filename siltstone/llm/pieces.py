"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The vocabulary is a trained piece table (a model file, read on the driver); nothing is
trained here.  Texts fall into units that no piece crosses (a run of spaces with the word
behind it; a line feed), and only the distinct units of a batch are encoded.  Units of
equal length advance together: for every end position the hashes of all substrings that
end there probe the sorted piece keys, and a vectorised maximum over the admissible
pieces stores the backpointer.

Scores.  A unigram vocabulary takes the maximum of the summed scores.  A merge (BPE)
vocabulary is not defined by that maximum but by the order of its merges; the same
forward recursion gives its segmentation when a piece is admissible after the best piece
of the prefix only if the merge order leaves the seam between the two open (``seams``).
Exactly one piece is then admissible at each reachable position.  Both give the ids of
the sentencepiece library; units with runs of spaces (whose merges tie) and very long
units are merged one by one.

Defined results: null and empty texts have no ids and decode to the empty text; a
character outside the vocabulary becomes its UTF-8 bytes (or the unknown id where the
vocabulary has no bytes); U+2581 is read as a space, as the format says; every other text
decodes to itself; repeated rows are encoded one by one; an empty table gives an empty
result; columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, tidied
from .textops import U64, Words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Distinct units a Python worker remembers before it starts anew.
MEMORY = 1_000_000
#: Units longer than this many characters are not batched.
LONGEST = 96
#: Pairs of pieces whose seam a worker remembers (a newer pair takes the place of an older one).
SEAMS = 1 << 20
#: Code points of the units that advance together.
ADVANCE = 1 << 17
_FILTER_BITS = 20
_SPREAD = U64(0xD6E8FEB86659FD93)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POW = np.array([pow(_P, i, 1 << 64) for i in range(LONGEST + 64)], dtype=U64)
_INV = np.array([pow(_P_INV, i, 1 << 64) for i in range(LONGEST + 64)], dtype=U64)


def _hash(points: np.ndarray) -> U64:
    with np.errstate(over="ignore"):
        return ((points.astype(U64) + U64(1)) * _POW[: len(points)]).sum(dtype=U64)


@dataclass
class Vocabulary:
    """Pieces and their scores; ``merges`` tells a merge vocabulary from a unigram one."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 1 ordinary, 2 unknown, 3 control, 6 byte
    merges: bool
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0])
        byte = np.flatnonzero(self.kinds == 6)
        self.byte_ids = {int(self.pieces[i][3:5], 16): int(i) for i in byte}
        self.longest = max(map(len, self.ids), default=1)
        hashes = {_hash(np.array([ord(c) for c in p])): i for p, i in self.ids.items()}
        self.keys = np.array(sorted(hashes), dtype=U64)
        self.key_ids = np.array([hashes[k] for k in self.keys], dtype=np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        with np.errstate(over="ignore"):
            self.maybe[((self.keys * _SPREAD) >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        n = len(self.pieces)
        # Merges come in the order of falling scores; single characters come before all.
        order = np.argsort(-self.scores, kind="stable")
        self.rank = np.zeros(n, np.int64)
        self.rank[order] = np.arange(1, n + 1)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.char_hash = np.zeros(n, U64)
        self.size = np.zeros(n, np.int64)
        for p, i in self.ids.items():
            self.char_hash[i], self.size[i] = _hash(np.array([ord(c) for c in p])), len(p)
            if self.merges and len(p) > 1:
                parts = self.merge(p, until=i)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
        self.rank[self.size == 1] = 0
        raw = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() if k in (1, 4) else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])

    @staticmethod
    def load(path: str = MODEL) -> "Vocabulary":
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = np.array([2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 6 if sp.is_byte(i) else 1 for i in range(n)], dtype=np.int8)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        return Vocabulary([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), kinds, proto.trainer_spec.model_type == 2)

    def merge(self, unit: str, until: int | None = None) -> list[int]:
        """Ids (-1: outside the vocabulary) by merging neighbours, best score first, leftmost of equals.

        With ``until`` merging stops before that piece is made, which shows its two parts.
        """
        ids = self.ids
        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                at = ids.get(both)
                if at is not None and at != until:
                    heapq.heappush(heap, (-self.scores[at], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ids.get(p, -1) for p in parts if p is not None]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of substring hashes, -1 where no piece has that hash; a filter of bits spares most the search."""
        out = np.full(hashes.shape, -1, np.int64)
        with np.errstate(over="ignore"):
            likely = np.nonzero(self.maybe[((hashes * _SPREAD) >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        some = hashes[likely]
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        out[likely] = np.where(self.keys[at] == some, self.key_ids[at], -1)
        return out

    def seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b may stand side by side, for arrays of ids.

        Merges are undone from the latest back on either side of the seam.  The seam is
        closed if the parts that then touch it could have been merged earlier than the
        merge that was undone last; it stays open if that never happens.
        """
        a, b = a.copy(), b.copy()
        open_ = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            with np.errstate(over="ignore"):
                both = self.char_hash[x] + self.char_hash[y] * _POW[self.size[x]]
            made = self.find(both)
            # On equal ranks the merge further left happens first, so the right part's own merge comes later.
            closed = (made >= 0) & (self.rank[np.maximum(made, 0)] < limit[live])
            open_[live[closed]] = False
            live, x, y = live[~closed], x[~closed], y[~closed]
            rx, ry = self.rank[x], self.rank[y]
            whole = (rx == 0) & (ry == 0)
            live, x, y, rx, ry = live[~whole], x[~whole], y[~whole], rx[~whole], ry[~whole]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return open_


class Encoder:
    """Encodes batches with one vocabulary and remembers the units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._pairs, self._open = np.full(SEAMS, -1, np.int64), np.zeros(SEAMS, bool)
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(0, U64)  # sorted hashes of the units met
        self._place = np.zeros(0, np.int32)  # which entry of ``_starts`` each has
        self._pool = np.zeros(0, np.int32)
        self._starts = np.zeros(1, np.int64)

    def _seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.seams`` with the answers for pairs met before, each kept in the one cell its hash names."""
        pair = a * len(self.v.pieces) + b
        with np.errstate(over="ignore"):
            cell = ((pair.astype(U64) * _SPREAD) >> U64(64 - SEAMS.bit_length() + 1)).astype(np.int64)
        out = self._open[cell]
        new = np.flatnonzero(self._pairs[cell] != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            out[new] = self.v.seams(asked // len(self.v.pieces), asked % len(self.v.pieces))[back]
            # Two pairs of one cell: the answer must be that of the pair which stays there.
            cells, last = np.unique(cell[new], return_index=True)
            self._pairs[cells], self._open[cells] = pair[new[last]], out[new[last]]
        return out

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best last piece and its length for every prefix of n units of equal length (n x L code points), and which units have a path.

        Id -1 stands for a single character outside the vocabulary.
        """
        v = self.v
        n, length = points.shape
        sums = np.zeros((length + 1, n), U64)
        with np.errstate(over="ignore"):
            np.cumsum((points.T.astype(U64) + U64(1)) * _POW[:length, None], axis=0, out=sums[1:])
        # Every substring that is a piece, by its end; longer ones first, so that of equal scores the shortest stays.
        ends, begins, rows, ids = [], [], [], []
        outside = np.zeros((length, n), bool)
        for size in range(min(v.longest, length), 0, -1):
            with np.errstate(over="ignore"):
                found = v.find((sums[size:] - sums[:-size]) * _INV[: length - size + 1, None])
            if size == 1:
                outside = found < 0
            begin, row = np.nonzero(found >= 0)
            ends.append(begin + size)
            begins.append(begin)
            rows.append(row)
            ids.append(found[begin, row])
        end_of = np.concatenate(ends)
        order = np.argsort(end_of, kind="stable")
        begin_of, row_of, id_of = (np.concatenate(x)[order] for x in (begins, rows, ids))
        cut = np.searchsorted(end_of[order], np.arange(1, length + 2))
        last = np.full((length + 1, n), -1, np.int64)
        step = np.ones((length + 1, n), np.int64)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        floor = 1.0 if v.merges else float(v.scores.min()) - 10
        for end in range(1, length + 1):
            at = slice(cut[end - 1], cut[end])
            begin, row, piece = begin_of[at], row_of[at], id_of[at]
            ok = np.isfinite(best[begin, row])
            begin, row, piece = begin[ok], row[ok], piece[ok]
            if v.merges and len(row):
                before = last[begin, row]
                inner = np.flatnonzero((begin > 0) & (before >= 0))
                ok = np.ones(len(row), bool)
                ok[inner] = self._seams(before[inner], piece[inner])
                begin, row, piece = begin[ok], row[ok], piece[ok]
            score = best[begin, row] + (1.0 if v.merges else v.scores[piece])
            top = np.where(outside[end - 1], best[end - 1] + floor, -np.inf)
            np.maximum.at(top, row, score)
            pick = np.flatnonzero(score == top[row])
            last[end, row[pick]], step[end, row[pick]] = piece[pick], end - begin[pick]
            best[end] = top
        return last.T, step.T, np.isfinite(best[length])

    def _learn(self, hashes: np.ndarray, joined: bytes, sizes: np.ndarray) -> None:
        """Encodes new units, which lie one after the other in ``joined``, and remembers their ids."""
        text = joined.decode("utf-8").replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
        behind = np.cumsum(sizes)
        first = chars[behind - sizes]
        length = chars[behind] - first
        lone = length > LONGEST
        if self.v.merges:
            second = np.minimum(first + 1, len(points) - 1)
            lone |= (length > 1) & (points[first] == ord(SPACE)) & (points[second] == ord(SPACE))
        order, pool, counts = [], [], []

        def add(units, ids, n):
            order.append(units)
            pool.append(ids)
            counts.append(n)

        def alone(i: int) -> np.ndarray:
            unit = text[first[i] : first[i] + length[i]]
            return self._finish(self.v.merge(unit) if self.v.merges else self._one(unit), unit)

        rest = np.flatnonzero(~lone)
        rest = rest[np.argsort(length[rest], kind="stable")]
        cuts = np.flatnonzero(np.diff(length[rest])) + 1
        for group in np.split(rest, cuts) if len(rest) else []:
            size = int(length[group[0]])
            width = max(1, ADVANCE // size)
            for k in range(0, len(group), width):
                some = group[k : k + width]
                last, step, whole = self.viterbi(points[first[some][:, None] + np.arange(size)])
                ids, n = _trace_back(last[whole], step[whole])
                add(some[whole], ids, n)
                odd = np.flatnonzero(ids < 0)
                if len(odd):  # characters outside the vocabulary
                    ends = np.cumsum(n)
                    parts = np.split(ids, ends[:-1])
                    for j in np.unique(np.searchsorted(ends, odd, "right")).tolist():
                        i = some[whole][j]
                        parts[j] = self._finish(parts[j].tolist(), text[first[i] : first[i] + size])
                        n[j] = len(parts[j])
                    pool[-1] = np.concatenate(parts)
                lone[some[~whole]] = True
        for i in np.flatnonzero(lone).tolist():
            ids = alone(i)
            add(np.array([i]), ids, np.array([len(ids)]))
        base = len(self._starts) - 1
        units = np.concatenate(order)
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(np.concatenate(counts))])
        self._pool = np.concatenate([self._pool, *pool]).astype(np.int32, copy=False)
        place = np.empty(len(units), np.int32)
        place[units] = np.arange(base, base + len(units), dtype=np.int32)
        at = np.searchsorted(self._keys, hashes)
        self._keys = np.insert(self._keys, at, hashes)
        self._place = np.insert(self._place, at, place)

    def _one(self, unit: str) -> list[int]:
        """Unigram Viterbi of one long unit."""
        v, n = self.v, len(unit)
        best, last, step = [0.0] + [-np.inf] * n, [-1] * (n + 1), [1] * (n + 1)
        floor = float(v.scores.min()) - 10
        for end in range(1, n + 1):
            for size in range(1, min(v.longest, end) + 1):
                at = v.ids.get(unit[end - size : end], -1)
                if at >= 0 or size == 1:
                    s = best[end - size] + (v.scores[at] if at >= 0 else floor)
                    if s > best[end]:
                        best[end], last[end], step[end] = s, at, size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= step[at]
        return ids[::-1]

    def _finish(self, ids: list[int], unit: str) -> np.ndarray:
        if min(ids) >= 0:
            return np.array(ids, dtype=np.int32)
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.v.pieces[i])
                continue
            out += [self.v.byte_ids.get(b, self.v.unknown) for b in unit[at].encode()] if self.v.byte_ids else [self.v.unknown]
            at += 1
        return np.array(out, dtype=np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        return next(self.encode_slices([texts]))

    def encode_slices(self, slices: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of every slice; the units new to this encoder are gathered from all slices and encoded together."""
        if len(self._keys) > MEMORY:
            self._forget()
        split, new_hashes, new_bytes, new_sizes = [], [], [], []
        for texts in slices:
            unique, back, per_text, new, joined, sizes = self._units(texts)
            split.append((unique, back, per_text))
            new_hashes.append(new)
            new_bytes.append(joined)
            new_sizes.append(sizes)
        hashes, first = np.unique(np.concatenate(new_hashes), return_index=True)
        if len(hashes):
            sizes = np.concatenate(new_sizes)
            raw = np.frombuffer(b"".join(new_bytes), dtype=np.uint8)
            start = np.cumsum(sizes) - sizes
            self._learn(hashes, raw[_spread(start[first], sizes[first])].tobytes(), sizes[first])
        for unique, back, per_text in split:
            place = self._place[np.searchsorted(self._keys, unique)].astype(np.int64)[back]
            length = self._starts[place + 1] - self._starts[place]
            counts = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(per_text)])]
            yield self._pool[_spread(self._starts[place], length)], np.diff(counts)

    def _units(self, texts: list[bytes]):
        """Distinct unit hashes, the unit of every place, units of each text; and hashes, bytes and sizes of those not met before."""
        marked = [b" " + t.replace(b"\xe2\x96\x81", b" ") if t else b"" for t in texts]
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        buf = np.frombuffer(b"".join(marked), dtype=np.uint8)
        if not len(buf):
            return np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, U64), b"", np.zeros(0, np.int64)
        space, feed = buf == 32, buf == 10
        start = feed.copy()
        start[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        start[offsets[:-1][sizes > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(buf))
        unique, first, back = np.unique(_unit_hashes(buf, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        a, n = begin[first[new]], (end - begin)[first[new]]
        return unique, back.astype(np.int32), np.diff(np.searchsorted(begin, offsets)), unique[new], buf[_spread(a, n)].tobytes(), n

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of id sequences laid one after the other."""
        v = self.v
        size = v.raw_size[ids]
        out = v.raw[_spread(v.raw_start[ids], size)].tobytes()
        cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [out[a + (out[a : a + 1] == b" ") : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _trace_back(last: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all rows one after the other, and how many each has; all rows go back together."""
    n, length = last.shape[0], last.shape[1] - 1
    at, live, rounds = np.full(n, length), np.arange(n), []
    counts = np.zeros(n, np.int64)
    while len(live):
        rounds.append((live, last[live, at[live]]))
        counts[live] += 1
        at[live] -= step[live, at[live]]
        live = live[at[live] > 0]
    ends = np.cumsum(counts)
    flat = np.zeros(int(counts.sum()), np.int32)
    for k, (rows, ids) in enumerate(rounds):
        flat[ends[rows] - 1 - k] = ids
    return flat, counts


def _unit_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    w = Words.__new__(Words)
    w.buf = buf
    w.start, w.end = begin, end
    return w._hash()


def _worker(vocabulary) -> Encoder:
    """One encoder per Python worker and vocabulary, so that its memory outlives a task."""
    global _kept
    if _kept is None or _kept[0] != vocabulary.id:
        _kept = (vocabulary.id, Encoder(vocabulary.value))
    return _kept[1]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else id(broadcast)

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


_kept: tuple[int, Encoder] | None = None


def share(spark: SparkSession, model: str = MODEL) -> _Shared:
    """The parsed vocabulary on all executors; its size is that of the piece table (32,000 entries here)."""
    return _Shared(spark.sparkContext.broadcast(Vocabulary.load(model)))


def _slices(column: pa.Array, limit: int = 1 << 20):
    texts, held = [], 0
    for t in column:
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        texts.append(raw)
        held += len(raw)
        if held > limit:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def encode_documents(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and (with ``check``) whether decoding gives the text back, and the SHA-256 of what it gives."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = share(docs.sparkSession, model)
    schema = f"doc_id {kind}, n_tokens long, ids array<int>" + (", lossless boolean, decoded_sha256 string" if check else "")

    def run(batches):
        for b in batches:
            encoder, at = _worker(shared), 0
            slices = list(_slices(b.column("text")))
            for texts, (ids, counts) in zip(slices, encoder.encode_slices(slices), strict=True) if slices else ():
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                cols = [b.column("doc_id").slice(at, len(texts)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                names = ["doc_id", "n_tokens", "ids"]
                if check:
                    back = encoder.decode(ids, counts)
                    cols += [pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                    names += ["lossless", "decoded_sha256"]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names)

    return only(docs, "doc_id", "text").mapInArrow(tidied(run), schema)


def decode_documents(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of a table of id lists; a null list decodes to the empty text."""
    kind = dict(coded.dtypes)["doc_id"]
    shared = share(coded.sparkSession, model)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = _worker(shared).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"])

    return only(coded, "doc_id", "ids").mapInArrow(tidied(run), f"doc_id {kind}, text string")
