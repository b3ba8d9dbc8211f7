"""GIF columns: write and read animations, composite their frames, store them with times and colour histograms.

`decode` reads any GIF: global and local palettes, LZW code streams with early or deferred clear codes, interlaced rasters,
transparent indices and the four disposal rules. `encode` stores samples losslessly as 8-bit indices of a grey palette, in
frames of `FRAME_ROWS` lines, so that a decoder holds one frame at a time however long the payload is.

A null or damaged medium has no frames (`frames`) and null features; an empty text is one line of blanks. Repeated rows come
back repeated, an empty table gives no rows, columns other than id and medium are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import stored

WIDTH = 192
FRAME_ROWS = 320
DELAY_CS = 4
#: Levels per colour channel of a frame's histogram, and of the luminance histogram of a whole medium.
CHANNEL_LEVELS = 4
LUMA_LEVELS = 16

CLEAR, END, FIRST, MOST = 256, 257, 258, 4096
#: Codes from one clear code to the next when the table is filled exactly.
SEGMENT = MOST - FIRST + 1


class Damaged(ValueError):
    """Bytes that are no complete GIF."""


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int
    canvas: np.ndarray  # rows x columns x RGB, as shown


def code_widths(count: int, first_width: int) -> np.ndarray:
    """Bits of the 1st, 2nd, ... code behind a clear code: the table grows by one entry per code but the first."""
    entries = (1 << (first_width - 1)) + 2 + np.maximum(0, np.arange(count) - 1)
    return np.clip(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, first_width, 12)


WIDTHS = code_widths(SEGMENT + 1, 9)


def lzw_encode(samples: bytes) -> bytes:
    """Code stream of 8-bit samples; the table is cleared when it is full."""
    runs: list[list[int]] = []
    table: dict[int, int] = {}
    out, code, free = [CLEAR], samples[0], FIRST
    look = table.get
    for sample in samples[1:]:
        key = code << 8 | sample
        known = look(key)
        if known is not None:
            code = known
            continue
        out.append(code)
        table[key] = free
        free += 1
        code = sample
        if free == MOST:
            runs.append(out)
            table.clear()
            out, free = [CLEAR], FIRST
    runs.append([*out, code, END])
    widths = []
    for n, run in enumerate(runs):
        before = 9 if n == 0 else int(WIDTHS[min(len(runs[n - 1]) - 1, SEGMENT)])
        widths += [np.array([before]), WIDTHS[: len(run) - 1]]
    codes, width = np.concatenate([np.array(run, np.uint16) for run in runs]), np.concatenate(widths)
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


@cache
def code_ends(first_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes behind a clear code while the table grows, and where each ends, in bits."""
    widths = code_widths(2 * SEGMENT, first_width)
    return widths, np.cumsum(widths)


def _copied(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    The table's n-th own entry is what the n-th code gave and the sample after it, which stand side by side in the output. So
    such a code copies from where the n-th code's samples begin, one sample more than it gave. Lengths, and then the sources of
    all samples, are followed to the plain codes by doubling, so runs of any depth take a few passes.
    """
    place = np.arange(len(codes))
    plain = codes < clear
    source = np.where(plain, place, codes.astype(np.int64) - clear - 2)
    deep = np.flatnonzero(~plain)
    if len(deep) and (source[deep].min() < 0 or (source[deep] >= deep).any()):
        raise Damaged("a code beyond the table")
    lengths, up = np.ones(len(codes), np.int64), source
    lengths[deep] = 2
    while True:
        deep = deep[~plain[up[deep]]]
        if not len(deep):
            break
        above = up[deep]
        more, further = lengths[above] - 1, up[above]
        up = up.copy()
        lengths[deep] += more
        up[deep] = further
    starts = np.cumsum(lengths) - lengths
    own = np.repeat(place, lengths)
    at = np.arange(len(own))
    origin = at - (starts - starts[source])[own]
    while True:
        further = origin[origin]
        if np.array_equal(further, origin):
            return codes[own[origin]].astype(np.uint8)
        origin = further


def lzw_decode(stream: bytes, code_size: int, size: int) -> bytes:
    """Samples of a code stream, `size` of them at most."""
    clear = 1 << code_size
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    at, limit, done, out, done_size = 0, 8 * len(stream), False, [], 0
    while at < limit and not done and done_size < size:
        # codes up to the next clear or end code; beyond a full table the codes keep their width
        parts, read, stop = [], 0, None
        while stop is None and at < limit:
            if read:
                widths = np.full(2 * SEGMENT, 12)
                ends = np.cumsum(widths)
            else:
                widths, ends = code_ends(code_size + 1)
            whole = int(np.searchsorted(ends, limit - at, "right"))
            if not whole:
                done = True
                break
            widths, ends = widths[:whole], ends[:whole] + at
            begin = ends - widths
            byte = begin >> 3
            window = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
            codes = window >> (begin & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            stop = int(stops[0]) if len(stops) else None
            parts.append(codes[:stop])
            read += len(parts[-1])
            at = int(ends[-1] if stop is None else ends[stop])
            done = stop is not None and int(codes[stop]) == clear + 1
            if stop is None and read >= size:
                done = True
        if read:
            run = _copied(np.concatenate(parts), clear)
            out.append(run.tobytes())
            done_size += len(run)
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(v for v in range(256) for _ in range(3))


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animation whose frames hold the samples, line after line; their number is a positive multiple of `width`."""
    if not samples or len(samples) % width:
        raise ValueError("the samples fill no whole number of lines")
    step = width * frame_rows
    height = min(len(samples), step) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for at in range(0, len(samples), step):
        part = samples[at : at + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        out.append(_blocks(lzw_encode(part)))
    return b"".join([*out, b";"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise Damaged("the data ends inside a block")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise Damaged("the data ends inside a block")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 3 << ((packed & 7) + 1)
    if at + n > len(data):
        raise Damaged("the data ends inside a palette")
    table = np.zeros((256, 3), np.uint8)
    table[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
    return table, at + n


def decode(data: bytes) -> Iterator[Frame]:
    """Frames as they are shown, one after the other; the canvas of a frame is valid until the next one is asked for."""
    try:
        yield from _decode(data)
    except (struct.error, IndexError) as error:
        raise Damaged(str(error)) from error


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Damaged("no GIF header")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if packed & 0x80:
        common, at = _palette(data, at, packed)
    back = common[background] if common is not None else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(back, (height, width, 3)).copy()
    delay, disposal, transparent = 0, 0, -1
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = (flags >> 2) & 7, index if flags & 1 else -1
            continue
        if kind != 0x2C:
            raise Damaged("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, common
        if packed & 0x80:
            palette, at = _palette(data, at, packed)
        if palette is None:
            raise Damaged("a frame without palette")
        code_size = data[at]
        if not 2 <= code_size <= 8:
            raise Damaged("an impossible code size")
        stream, at = _sub_blocks(data, at + 1)
        raster = np.frombuffer(lzw_decode(stream, code_size, w * h), np.uint8)
        if len(raster) < w * h:
            raise Damaged("a frame lacks samples")
        raster = raster.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(raster)
            plain[order] = raster
            raster = plain
        area = canvas[top : top + h, left : left + w]
        raster = raster[: area.shape[0], : area.shape[1]]
        before = area.copy() if disposal == 3 else None
        if transparent < 0:
            area[:] = palette[raster]
        else:
            shown = raster != transparent
            area[shown] = palette[raster[shown]]
        yield Frame(left, top, w, h, 10 * delay, disposal, transparent, canvas)
        if disposal == 2:
            area[:] = back
        elif disposal == 3:
            area[:] = before
        delay, disposal, transparent = 0, 0, -1


def colour_histogram(canvas: np.ndarray, levels: int = CHANNEL_LEVELS) -> np.ndarray:
    """Pixels per colour cell, red slowest."""
    cell = canvas.astype(np.uint16) * np.uint16(levels) >> np.uint16(8)
    flat = (cell[..., 0] * levels + cell[..., 1]) * levels + cell[..., 2]
    return np.bincount(flat.ravel(), minlength=levels**3)


def frames(media: DataFrame, id_column: str = "doc_id", media_column: str = "media", with_pixels: bool = False) -> DataFrame:
    """One row per frame: id, frame, at_ms, delay_ms, place, disposal, transparent index, colour histogram, and RGB on request."""
    source = media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    kind = source.schema["id"].dataType.simpleString()
    place = "left int, top int, width int, height int, disposal int, transparent int"
    schema = f"frame int, at_ms long, delay_ms long, {place}, colours array<long>" + ", rgb binary" * with_pixels

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(f.split()[0] for f in schema.split(", "))]
        for batch in batches:
            for row, data in enumerate(batch.column(1)):
                at, number = 0, 0
                try:
                    for f in decode(data.as_py() or b""):
                        values = [number, at, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent]
                        values.append(colour_histogram(f.canvas).tolist())
                        if with_pixels:
                            values.append(f.canvas.tobytes())
                        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int64()), pa.binary()]
                        columns = [pa.array([v], t) for v, t in zip(values, kinds, strict=False)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *columns], names)
                        at, number = at + f.delay_ms, number + 1
                except Damaged:
                    continue

    return source.mapInArrow(read, f"id {kind}, {schema}")


def store_frames(media: DataFrame, path: str, **options) -> None:
    """Write the frames of a media table as Parquet."""
    frames(media, **options).write.parquet(path)


def text_media(texts: pa.Array) -> pa.Array:
    """UTF-8 of a text, filled with blanks to whole lines, as an animation; null is the empty text."""
    sizes, out = [], []
    for text in texts:
        data = (text.as_py() or "").encode()
        sizes.append(len(data))
        out.append(encode(data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH)))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["n_bytes", "media"])


FRAMES = "array<struct<frame:int,at_ms:bigint,delay_ms:bigint,colours:array<bigint>>>"
DIGEST = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {FRAMES}"


def _digest(media: pa.Array) -> pa.Array:
    """What is read back from stored media: the frames with their times and colour histograms, and from them payload (first
    colour channel of each frame's area), checks and features."""
    rows = []
    for item in media:
        data = item.as_py()
        payload, tail, size, shown = hashlib.sha256(), b"", 0, []
        luma, ms = np.zeros(LUMA_LEVELS, np.int64), 0
        try:
            for f in decode(data or b""):
                area = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0]
                part = area.tobytes()
                payload.update(part)
                tail, size = (tail + part)[-16:], size + len(part)
                luma += np.bincount(area.ravel() >> 4, minlength=LUMA_LEVELS)
                shown.append({"frame": len(shown), "at_ms": ms, "delay_ms": f.delay_ms, "colours": colour_histogram(f.canvas).tolist()})
                ms += f.delay_ms
        except Damaged:
            rows.append(None)
            continue
        feature = f"frames={len(shown)};ms={ms};luma=" + ",".join(map(str, luma.tolist()))
        rows.append((size, payload.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, shown))
    moment = pa.struct([("frame", pa.int32()), ("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("colours", pa.list_(pa.int64()))])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(moment)]
    columns = [pa.array([r and r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, [f.split()[0] for f in DIGEST.split(", ")])


def media_digest(column: str) -> Column:
    """Struct column `DIGEST` of a medium column."""
    return F.arrow_udf(_digest, DIGEST)(F.col(column))


def stored_text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Table (id, n_bytes, media) of all texts, written to the shared folder and read back."""
    made = docs.select(F.col(id_column).alias("id"), F.arrow_udf(text_media, "n_bytes long, media binary")(F.col(text_column).cast("string")).alias("made"))
    return stored(made.select("id", "made.n_bytes", "made.media"), "media")
