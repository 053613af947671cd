"""Media columns: GIF files with LZW code streams, composed frames with times and colour histograms.

``encode_gif`` stores bytes losslessly as the 8-bit samples of a paletted animation
(64 samples a row, frames of up to ``FRAME_ROWS`` rows).  ``decode_gif`` reads any GIF:
global and local palettes, interlacing, transparency, disposal, delays.  ``decode_media``
stores with every file its timed frames: when each is shown and for how long, and a
histogram over 4 x 4 x 4 colour cells of the composed canvas; ``frame_table`` has a row for
each of them.  Features of a file are computed from these columns by built-in functions.

Texts: a null is empty; bytes 0 are appended up to a positive multiple of 64, so an empty
text is one row of zeros; very long texts become many frames, coded one at a time; equal
texts give equal files; repeated rows are coded one by one; rows with a null id are kept as
they are; columns of the input beside id and text, whatever their names, are ignored; an
empty table gives an empty result.  A damaged file raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, tidied

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
CLEAR, END, FIRST = 256, 257, 258
#: Codes after a clear code before the next one: the table then holds 4095 entries.
SEGMENT = 4096 - FIRST
#: Width in bits of the n-th code after a clear code, for a minimum code size of 8.
_WIDTHS = np.array([max(9, min(12, (FIRST + j - 1).bit_length())) for j in range(SEGMENT + 1)], dtype=np.int64)


def default_palette() -> np.ndarray:
    """256 distinct colours by rule: 3 bits red, 3 bits green, 2 bits blue of the sample."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, ((i >> 2) & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


def lzw_codes(data: bytes) -> list[int]:
    """Codes of a non-empty byte string, with the leading clear and the closing end code."""
    codes, table, free = [CLEAR], {}, FIRST
    add, get = codes.append, table.get
    last = FIRST + SEGMENT - 1
    prefix = data[0] << 8  # the code so far, moved to make room for the next byte
    for b in memoryview(data)[1:]:
        longer = get(prefix | b)
        if longer:
            prefix = longer
            continue
        add(prefix >> 8)
        if free < last:
            table[prefix | b] = free << 8
            free += 1
        else:
            add(CLEAR)
            table.clear()
            free = FIRST
        prefix = b << 8
    add(prefix >> 8)
    add(END)
    return codes


def pack_codes(codes: list[int]) -> bytes:
    """Codes to bits, least significant first; the width follows from the distance to the clear code."""
    c = np.array(codes, dtype=np.int64)
    clears = np.flatnonzero(c == CLEAR)
    since = np.arange(len(c)) - np.repeat(clears, np.diff(np.append(clears, len(c)))) - 1
    # A clear code itself closes the run before it.
    since[clears[1:]] = clears[1:] - clears[:-1] - 1
    since[0] = 0
    width = _WIDTHS[since]
    at = np.concatenate([[0], np.cumsum(width)])
    shifted = c << (at[:-1] & 7)
    byte, size = at[:-1] >> 3, int(at[-1] + 7) >> 3
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount(byte + k, (shifted >> (8 * k)) & 255, minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(raw: bytes, min_size: int, limit: int) -> bytes:
    """The first ``limit`` samples of a code stream of any encoder."""
    clear = 1 << min_size
    buf = np.frombuffer(raw + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    bits, n_bits = 0, len(raw) * 8
    sizes = _WIDTHS if min_size == 8 else np.array([max(min_size + 1, min(12, (clear + 1 + j).bit_length())) for j in range(4096)])
    out, have = [], 0
    run, done = [], 0
    while bits < n_bits and have < limit:
        # Widths are known up to the next clear code, so a whole run is cut into codes at once.
        width = sizes[done:] if done < len(sizes) else np.full(4096, 12)
        at = bits + np.concatenate([[0], np.cumsum(width)])
        fit = int(np.searchsorted(at, n_bits, "right")) - 1
        if fit <= 0:
            break
        start = at[:fit]
        at_byte = start >> 3
        word = buf[at_byte] | buf[at_byte + 1] << 8 | buf[at_byte + 2] << 16
        codes = (word >> (start & 7)) & ((1 << width[:fit]) - 1)
        stops = np.flatnonzero(codes >> 1 == clear >> 1)
        cut = int(stops[0]) if len(stops) else fit
        run.append(codes[:cut])
        done += cut
        if len(stops):
            part = expand_run(np.concatenate(run), clear)
            out.append(part)
            have += len(part)
            run, done = [], 0
            if codes[cut] == clear + 1:
                break
        bits = int(at[min(cut + 1, fit)])
    if run:
        out.append(expand_run(np.concatenate(run), clear))
    data = b"".join(out)
    if len(data) < limit:
        raise ValueError("LZW stream ends early")
    return data[:limit]


def expand_run(codes: np.ndarray, clear: int) -> bytes:
    """Samples of the codes between two clear codes.

    The n-th table entry is what the n-th code stands for and one sample more, which is
    where the next code begins in the output.  So an entry is a stretch of the output
    itself: every sample has a pointer to an earlier one, and doubling the pointers
    leads all of them to samples that were coded literally.
    """
    n = len(codes)
    if n == 0:
        return b""
    literal = codes < clear
    entry = np.where(literal, np.arange(n), codes - (clear + 2))
    if np.any((entry >= np.arange(n)) & ~literal):
        raise ValueError("LZW code out of range")
    depth, up = (~literal).astype(np.int64), entry
    while True:
        more = depth[up]
        if not more.any():
            break
        depth = depth + more
        up = up[up]
    length = depth + 1
    place = np.cumsum(length) - length
    total = int(place[-1] + length[-1])
    source = np.arange(total) + np.repeat(place[entry] - place, length)
    samples = np.zeros(total, np.uint8)
    samples[place[literal]] = codes[literal]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return samples[source].tobytes()
        source = further


def _sub_blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


def pad(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of ``WIDTH``."""
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def encode_gif(payload: bytes) -> bytes:
    """A GIF89a of the payload (whole rows of samples), a frame for every ``FRAME_ROWS`` rows."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("payload is not whole rows")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), default_palette().tobytes()]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_sub_blocks(pack_codes(lzw_codes(part))))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    """A coded image: its place, samples, palette and how it is shown and disposed of."""

    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay_cs: int


def decode_gif(raw: bytes) -> tuple[int, int, list[Frame]]:
    """(canvas width, canvas height, frames) of a GIF file."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    try:
        return _decode(raw)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF file ends early") from e


def _decode(raw: bytes) -> tuple[int, int, list[Frame]]:
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    at = 13
    palette = None

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n

    def data_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := raw[at]:
            parts.append(raw[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette, at = colours(at, flags)
    frames: list[Frame] = []
    transparent, disposal, delay = None, 0, 0
    while raw[at] != 0x3B:
        kind = raw[at]
        if kind == 0x21:
            label = raw[at + 1]
            body, at = data_blocks(at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown GIF block {kind:#x}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        own = palette
        if packed & 0x80:
            own, at = colours(at, packed)
        if own is None:
            raise ValueError("GIF image without a palette")
        min_size = raw[at]
        body, at = data_blocks(at + 1)
        samples = np.frombuffer(lzw_decode(body, min_size, w * h), np.uint8).reshape(h, w)
        if packed & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        frames.append(Frame(left, top, w, h, samples, own, transparent, disposal, delay))
        transparent, disposal, delay = None, 0, 0
    return width, height, frames


def compose(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """RGBA canvas as shown at each frame (yielded arrays are reused by the next step)."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        kept = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        part = f.samples[:h, :w]
        if part.size and int(part.max()) >= len(f.palette):
            raise ValueError("GIF sample outside the palette")
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        shown = np.ones(part.shape, bool) if f.transparent is None else part != f.transparent
        area[shown, :3] = f.palette[part[shown]]
        area[shown, 3] = 255
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif kept is not None:
            canvas = kept


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the opaque pixels over 64 colour cells (two high bits of red, green and blue)."""
    rgb = canvas[..., :3][canvas[..., 3] > 0] >> 6
    cell = rgb[:, 0].astype(np.int64) * 16 + rgb[:, 1] * 4 + rgb[:, 2]
    return np.bincount(cell, minlength=64)


def timed_frames(width: int, height: int, frames: list[Frame]) -> list[tuple[int, int, int, list[int]]]:
    """(start in ms, duration in ms, opaque pixels, histogram) of the canvas at every frame; if all frames cover it, none is composed."""
    if all(f.transparent is None and (f.left, f.top, f.width, f.height) == (0, 0, width, height) for f in frames):
        cells = []
        for f in frames:
            high = (f.palette >> 6).astype(np.int64)
            cells.append(np.bincount(high @ [16, 4, 1], np.bincount(f.samples.ravel(), minlength=len(f.palette)), minlength=64).astype(np.int64))
    else:
        cells = [histogram(c) for c in compose(width, height, frames)]
    out, clock = [], 0
    for f, c in zip(frames, cells, strict=True):
        out.append((clock, f.delay_cs * 10, int(c.sum()), c.tolist()))
        clock += f.delay_cs * 10
    return out


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF file of every text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            ids, sizes, files, held = [], [], [], 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                ids.append(doc_id)
                sizes.append(len(raw))
                files.append(encode_gif(pad(raw)))
                held += len(files[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("doc_id").type), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "gif"])
                    ids, sizes, files, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("doc_id").type), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "gif"])

    return only(docs, "doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, gif binary")


FRAMES = "array<struct<start_ms: long, duration_ms: long, pixels: long, histogram: array<long>>>"


def decode_media(media: DataFrame) -> DataFrame:
    """Reads stored files (doc_id, n_bytes, gif): digests of payload and file, canvas size and the timed frames, one row per file."""
    kind = dict(media.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, frames {FRAMES}"
    fields = ("start_ms", "duration_ms", "pixels", "histogram")
    frame = pa.struct([(n, pa.list_(pa.int64()) if n == "histogram" else pa.int64()) for n in fields])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(frame))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "frames"]

    def run(batches):
        for b in batches:
            rows = []
            for gif in b.column("gif"):
                raw = gif.as_py()
                width, height, frames = decode_gif(raw)
                payload = b"".join(f.samples.tobytes() for f in frames)
                timed = [dict(zip(fields, t, strict=True)) for t in timed_frames(width, height, frames)]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), width, height, timed))
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *arrays], names)

    return only(media, "doc_id", "n_bytes", "gif").mapInArrow(tidied(run), schema)


def frame_table(media: DataFrame) -> DataFrame:
    """One row per frame of the ``gif`` column: number, start and duration in ms, opaque pixels, histogram."""
    files = only(media, "doc_id", "gif").withColumn("n_bytes", F.lit(None).cast("long"))
    return decode_media(files).select("doc_id", F.posexplode("frames").alias("frame", "f")).select("doc_id", "frame", "f.*")


def feature(frames: Column, width: Column, height: Column) -> Column:
    """Frames, canvas, time shown and the four most frequent colour cells of all frames, from the frame columns."""
    total = F.aggregate(frames, F.array_repeat(F.lit(0).cast("long"), 64), lambda t, f: F.zip_with(t, f["histogram"], lambda a, b: a + b))
    used = F.filter(F.transform(total, lambda n, cell: F.struct((-n).alias("n"), cell.alias("cell"))), lambda x: x["n"] < 0)
    shown = F.array_join(F.transform(F.slice(F.array_sort(used), 1, 4), lambda x: F.format_string("%02d:%d", x["cell"], -x["n"])), ",")
    time = F.aggregate(frames, F.lit(0).cast("long"), lambda t, f: t + f["duration_ms"])
    return F.format_string("%dx%dx%d;%dms;%s", F.size(frames), width, height, time, shown)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF file in the shared folder, reads the files back into timed frames, and derives digests and features from those."""
    scratch = Scratch(docs.sparkSession, "gif")
    stored = scratch.settle(decode_media(scratch.settle(encode_documents(docs), "media")), "frames")
    digests = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return stored.select(*digests, feature(F.col("frames"), F.col("width"), F.col("height")).alias("feature"))
