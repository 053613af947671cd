"""Token files: a shard of token ids as a wavelet matrix, bit plane by bit plane, in compressed blocks.

The top bits of all ids make the first plane; ids whose bit is 0 then go before those whose
bit is 1, in order, and the next bits make the next plane.  Each plane is cut into blocks of
``BLOCK`` bits, compressed one by one, and the directory at the end of the file says for each
where it stands and how many ones come before it.  So access, rank and select of any id read
a few blocks only, and reading all ids undoes the partitions from the last plane up.

Layout: magic, compressed blocks, the table of documents (an Arrow stream), the directory
(JSON), the length of both (two 8-byte integers), magic.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

MAGIC = b"SWMX0001"
#: Bits of a block (a multiple of 64).
BLOCK = 1 << 17
#: Blocks that a reader keeps unpacked.
KEPT = 64
_CODEC = "zstd"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write(sink, ids: np.ndarray, documents: pa.Table) -> None:
    """Writes the ids of a shard and its table of documents to an output stream."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    sink.write(MAGIC)
    at, planes = len(MAGIC), []
    codec = pa.Codec(_CODEC, compression_level=1)
    v = ids
    for b in range(bits - 1, -1, -1):
        bit = (v >> b) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        blocks, ones = [], 0
        for i in range(0, len(packed), BLOCK // 8):
            raw = packed[i : i + BLOCK // 8].tobytes()
            small = codec.compress(raw, asbytes=True)
            sink.write(small)
            blocks.append((at, len(small), len(raw), ones))
            at += len(small)
            ones += int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())
        planes.append({"zeros": len(v) - ones, "blocks": blocks})
        v = np.concatenate([v[~bit], v[bit]])
    table = pa.BufferOutputStream()
    with pa.ipc.new_stream(table, documents.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
        out.write_table(documents)
    table = table.getvalue().to_pybytes()
    directory = json.dumps({"n": len(ids), "bits": bits, "planes": planes}).encode()
    sink.write(table + directory + struct.pack("<QQ", len(table), len(directory)) + MAGIC)


class TokenFile:
    """A shard in a file: ids by position, how often an id occurs, and where, without reading the rest."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self._file = store.open_input_file(path)
        size = self._file.size()
        tail = len(MAGIC) + 16
        end = self._file.read_at(tail, size - tail) if size >= tail else b""
        if end[16:] != MAGIC:
            raise ValueError(f"{uri} is no token file, or a torn one")
        self._table, length = struct.unpack("<QQ", end[:16])
        directory = json.loads(self._file.read_at(length, size - tail - length))
        self._table_at = size - tail - length - self._table
        self.n, self.bits, self.planes = directory["n"], directory["bits"], directory["planes"]
        self._codec = pa.Codec(_CODEC)
        self._blocks: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def close(self) -> None:
        self._file.close()

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self._file.read_at(self._table, self._table_at)).read_all()

    def _raw(self, plane: int, block: int) -> bytes:
        at, small, size, _ = self.planes[plane]["blocks"][block]
        return self._codec.decompress(self._file.read_at(small, at), size, asbytes=True)

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a block and the ones before each, counted from the start of the plane."""
        key = (plane, block)
        if key in self._blocks:
            self._blocks.move_to_end(key)
            return self._blocks[key]
        raw = self._raw(plane, block)
        words = np.frombuffer(raw.ljust(-(-len(raw) // 8) * 8, b"\0"), "<u8")
        before = self.planes[plane]["blocks"][block][3] + np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self._blocks[key] = (words, before)
        if len(self._blocks) > KEPT:
            self._blocks.popitem(last=False)
        return words, before

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a position."""
        if at == self.n:
            return self.n - self.planes[plane]["zeros"]
        words, before = self._block(plane, at // BLOCK)
        word, bit = divmod(at % BLOCK, 64)
        return int(before[word]) + int(np.bitwise_count(words[word] & np.uint64((1 << bit) - 1)))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th one or zero of a plane (from 0)."""
        blocks = self.planes[plane]["blocks"]
        low, high = 0, len(blocks) - 1
        while low < high:
            middle = (low + high + 1) // 2
            held = blocks[middle][3] if bit else middle * BLOCK - blocks[middle][3]
            low, high = (middle, high) if held <= k else (low, middle - 1)
        words, before = self._block(plane, low)
        held = before if bit else low * BLOCK + 64 * np.arange(len(before)) - before
        word = int(np.searchsorted(held, k, "right")) - 1
        marks = np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little") == bit
        return low * BLOCK + 64 * word + int(np.flatnonzero(marks)[k - int(held[word])])

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for p, plane in enumerate(self.planes):
            words, _ = self._block(p, at // BLOCK)
            bit = int(words[at % BLOCK // 64]) >> (at % 64) & 1
            ones = self._ones(p, at)
            at = plane["zeros"] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        """The places of a token's occurrences among [start, end) in the order after the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for p, plane in enumerate(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (plane["zeros"] + a, plane["zeros"] + b) if token >> (self.bits - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs among the positions [start, end)."""
        a, b = self._span(token, start, self.n if end is None else end)
        return b - a

    def positions(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Where an id occurs among the positions [start, end), in order."""
        out = []
        for at in range(*self._span(token, start, self.n if end is None else end)):
            for p in range(self.bits - 1, -1, -1):
                bit = token >> (self.bits - 1 - p) & 1
                at = self._select(p, bit, at - self.planes[p]["zeros"] if bit else at)
            out.append(at)
        return np.array(out, dtype=np.int64)

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            raw = b"".join(self._raw(p, b) for b in range(len(self.planes[p]["blocks"])))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).astype(bool)
            zeros = self.planes[p]["zeros"]
            up = np.empty(self.n, kind)
            up[~bit] = v[:zeros]
            up[bit] = v[zeros:] | kind(1 << (self.bits - 1 - p))
            v = up
        return v
