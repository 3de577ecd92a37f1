"""Media columns: GIF files in a binary column, decoded to timed frames with colour histograms.

``encode_gif`` stores frames of 8-bit samples under a palette with LZW code streams; ``decode_gif`` reads any GIF
of the 87a and 89a formats: global and local palettes, code streams of any starting size with clear codes and deferred
clears, interlaced rows, transparency, the disposal rules and frame delays. Frames are composed on the canvas and
given as red, green, blue and alpha planes. Files are bounded by their row; tasks hold one Arrow batch of them, and one
canvas at a time, of at most ``MAX_PIXELS`` pixels (a parameter of ``iter_frames``): a header can ask for far more than
its file holds.

Defined results: a null text is stored as an empty payload; a broken file, one that asks for a larger canvas or frame, and a
null file give null figures and an error text instead of a failed job; rows are treated one by one, so repeated rows
get equal results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
UNIT = SIDE * SIDE
#: Squares of 24 x 24 samples, one below the other, in a full frame; the last frame of a file may hold fewer.
SQUARES = 16
FRAME = UNIT * SQUARES
DELAY_MS = 100
PAD = 255
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
HISTOGRAM_BINS = 8
LAST_CODE = 4095
MAX_PIXELS = 1 << 26
#: Bytes of canvases in a batch of frames.
BATCH_BYTES = 1 << 25
BROKEN = (ValueError, IndexError)


@dataclass
class Frame:
    """A composed frame: canvas planes, the rectangle it draws, when it is shown and for how long."""

    start_ms: int
    delay_ms: int
    rgba: np.ndarray = field(repr=False)
    box: tuple[int, int, int, int]  # left, top, width, height

    def drawn(self) -> np.ndarray:
        left, top, width, height = self.box
        return self.rgba[top : top + height, left : left + width]

    def histograms(self) -> list[list[int]]:
        """Pixels per eighth of the value range for red, green and blue; invisible pixels are left out."""
        seen = self.rgba[self.rgba[..., 3] > 0]
        return [np.bincount(seen[:, c] >> 5, minlength=HISTOGRAM_BINS).tolist() for c in range(3)]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """LZW code stream of samples below ``2 ** bits``."""
    clear = 1 << bits
    table: dict[int, int] = {}
    following, width = clear + 2, bits + 1
    value, filled = clear, width
    out = bytearray()
    if samples:
        prefix = samples[0]
        for sample in samples[1:]:
            key = prefix << 8 | sample
            known = table.get(key)
            if known is not None:
                prefix = known
                continue
            value |= prefix << filled
            filled += width
            if following <= LAST_CODE:
                table[key] = following
                if following >> width:
                    width += 1
                following += 1
            else:
                value |= clear << filled
                filled += width
                table.clear()
                following, width = clear + 2, bits + 1
            prefix = sample
            if filled >= 512:
                whole = filled >> 3
                out += (value & ((1 << (whole << 3)) - 1)).to_bytes(whole, "little")
                value >>= whole << 3
                filled -= whole << 3
        value |= prefix << filled
        filled += width
        if following <= LAST_CODE and following >> width:
            width += 1
    value |= (clear + 1) << filled
    filled += width
    return bytes(out) + value.to_bytes((filled + 7) >> 3, "little")


def lzw_decode(stream: bytes, bits: int, expected: int) -> bytes:
    """Samples of a code stream; stops at the end code, the end of the stream or ``expected`` samples."""
    clear = 1 << bits
    roots = [bytes((i,)) for i in range(clear)] + [b"", b""]  # the empty entries are the clear and the end code
    table = list(roots)
    size, width, limit = clear + 2, bits + 1, 1 << (bits + 1)
    out: list[bytes] = []
    got = 0
    previous = b""
    block = 192  # bytes turned into one number at a time, so that shifts stay cheap
    at = value = filled = 0
    while got < expected:
        if filled < width:
            piece = stream[at : at + block]
            value |= int.from_bytes(piece, "little") << filled
            filled += len(piece) << 3
            at += len(piece)
            if filled < width:
                break
        code = value & (limit - 1)
        value >>= width
        filled -= width
        if code < size:
            entry = table[code]
            if not entry:
                if code != clear:
                    break
                table = list(roots)
                size, width, limit, previous = clear + 2, bits + 1, 1 << (bits + 1), b""
                continue
        elif code == size and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("code outside the table")
        out.append(entry)
        got += len(entry)
        if previous and size <= LAST_CODE:
            table.append(previous + entry[:1])
            size += 1
            if size == limit and width < 12:
                width += 1
                limit <<= 1
        previous = entry
    return b"".join(out)[:expected]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: Sequence[bytes], width: int, palette: np.ndarray = GREY, delay_ms: int = DELAY_MS) -> bytes:
    """GIF of frames of palette indices, ``width`` samples a row, drawn from the top; the canvas is as high as the highest."""
    side = width.to_bytes(2, "little")
    heights = [len(frame) // width for frame in frames]
    out = [b"GIF89a", side, max(heights, default=0).to_bytes(2, "little"), b"\xf7\0\0", palette.tobytes()]
    lead = b"\x21\xf9\x04\x04" + (delay_ms // 10).to_bytes(2, "little") + b"\0\0\x2c\0\0\0\0" + side
    for frame, height in zip(frames, heights, strict=True):
        out += [lead, height.to_bytes(2, "little"), b"\0\x08", _blocks(lzw_encode(frame))]
    return b"".join(out) + b"\x3b"


def _interlaced(rows: int) -> list[int]:
    return [*range(0, rows, 8), *range(4, rows, 8), *range(2, rows, 4), *range(1, rows, 2)]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def iter_frames(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """Frames of a GIF as composed on its canvas, one by one; each is a copy of its own."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    common, at = _palette(data, 13, data[10])
    if width * height > max_pixels:
        raise ValueError("canvas too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = now = 0
    transparent: int | None = None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            if label == 0xF9:
                flags = data[at + 3]
                disposal, delay = flags >> 2 & 7, int.from_bytes(data[at + 4 : at + 6], "little") * 10
                transparent = data[at + 6] if flags & 1 else None
            _, at = _sub_blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        flags = data[at + 9]
        if w * h > max_pixels:
            raise ValueError("frame too large")
        own, at = _palette(data, at + 10, flags)
        palette = own if own is not None else common
        if palette is None:
            raise ValueError("no palette")
        bits = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        shown = len(samples)
        if shown < w * h:
            samples = np.concatenate([samples, np.zeros(w * h - shown, np.uint8)])
        drawn = np.arange(w * h).reshape(h, w) < shown if shown < w * h else None
        indices = samples.reshape(h, w)
        if flags & 0x40:
            rows = np.argsort(_interlaced(h))
            indices = indices[rows]
            drawn = drawn[rows] if drawn is not None else None
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + h, left : left + w]
        seen = indices[: view.shape[0], : view.shape[1]]
        colours = palette[np.minimum(seen, len(palette) - 1)]
        if transparent is None and drawn is None:
            view[..., :3] = colours
            view[..., 3] = 255
        else:
            mask = np.ones(seen.shape, bool) if drawn is None else drawn[: view.shape[0], : view.shape[1]].copy()
            if transparent is not None:
                mask &= seen != transparent
            view[mask, :3] = colours[mask]
            view[mask, 3] = 255
        yield Frame(now, delay, canvas.copy(), (left, top, w, h))
        now += delay
        if disposal == 2:
            view[...] = 0
        elif disposal == 3 and before is not None:
            canvas = before
        delay = disposal = 0
        transparent = None


def decode_gif(data: bytes, max_pixels: int = MAX_PIXELS) -> list[Frame]:
    return list(iter_frames(data, max_pixels))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of a square, and their number before."""
    raw = (text or "").encode()
    return raw + bytes((PAD,)) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: the text as a GIF of grey frames, 24 samples wide."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column(1):
                data, n = payload_of(text.as_py())
                sizes.append(n)
                files.append(encode_gif([data[i : i + FRAME] for i in range(0, len(data), FRAME)], SIDE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(store, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


FRAME_COLUMNS = "frame int, start_ms long, delay_ms long, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"


def _batch(key, key_type: pa.DataType, rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key] * len(rows), key_type), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], names)


def gif_frames(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of every file: its time, its canvas and its colour histograms; where a file breaks, a row with an error."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
    names = [part.split()[0] for part in FRAME_COLUMNS.split(", ")]

    def rows_of(media: bytes | None) -> Iterator[tuple]:
        try:
            for i, f in enumerate(iter_frames(media or b"")):
                yield i, f.start_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), *f.histograms(), None
        except BROKEN as broken:
            yield (None,) * 9 + (str(broken),)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                size = 0
                for row in rows_of(media.as_py()):
                    held.append(row)
                    size += len(row[5] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(key, kind, held, kinds, [id_col, *names])
                        held, size = [], 0
                if held:
                    yield _batch(key, kind, held, kinds, [id_col, *names])

    rows = files.select(id_col, media_col)
    return rows.mapInArrow(read, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {FRAME_COLUMNS}")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, error string"


def media_digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of ``store_texts``: everything but n_bytes is computed from the stored file as read back.

    feature: frames, total milliseconds and the pixels of each eighth of the grey range, separated by colons and commas.
    """
    names = [part.split()[0] for part in DIGEST.split(", ")]

    def facts(data: bytes | None) -> tuple:
        try:
            parts, total = [], 0
            for f in iter_frames(data or b""):
                parts.append(f.drawn()[..., 0].tobytes())
                total += f.delay_ms
        except BROKEN as broken:
            return (None,) * 7 + (str(broken),)
        payload = b"".join(parts)
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=HISTOGRAM_BINS)
        feature = f"{len(parts)}:{total}:{','.join(map(str, grey.tolist()))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(parts), None

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *facts(media.as_py())) for n, media in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    return files.mapInArrow(digest, f"`{id_col}` {files.schema[id_col].dataType.simpleString()}, {DIGEST}")
