"""Frames, times and histograms of stored texts against a plain computation; foreign and damaged media; long texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import ROWS, TEXTS, docs, empty  # noqa: F401  (fixtures)

from rollbook.llm import media, queries

LINE = 192
FRAME = LINE * 320


def payload_of(text):
    data = text.encode()
    return data.ljust(max(1, -(-len(data) // LINE)) * LINE)


def frames_by_hand(payload):
    out = []
    for n, at in enumerate(range(0, len(payload), FRAME)):
        # a shorter last frame is drawn over the canvas of the one before
        seen = bytearray(payload[:FRAME]) if n == 0 else seen
        part = payload[at : at + FRAME]
        seen[: len(part)] = part
        colours = [0] * 64
        for v in seen:
            colours[(v >> 6) * 21] += 1
        out.append({"frame": n, "at_ms": 40 * n, "delay_ms": 40, "colours": colours})
    return out


def digest_of(text):
    payload = payload_of(text)
    luma = [0] * 16
    for v in payload:
        luma[v >> 4] += 1
    frames = frames_by_hand(payload)
    feature = f"frames={len(frames)};ms={40 * len(frames)};luma=" + ",".join(map(str, luma))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature, frames


def test_query_returns_frames_and_features(spark, docs):  # noqa: F811
    found = queries.op1_gif_media(spark, docs).collect()
    assert len(found) == len(ROWS)
    want = {(i, t): digest_of(t) for (i, *_), t in zip(ROWS, TEXTS, strict=True)}
    for r in found:
        frames = [{**f.asDict(), "colours": list(f.colours)} for f in r.frames]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature, frames) in [v for (i, _), v in want.items() if i == r.doc_id]


@pytest.mark.parametrize("size", [FRAME - LINE + 1, FRAME, FRAME + 1, 5 * FRAME + 700])
def test_texts_of_several_frames(size):
    rng = random.Random(size)
    text = "".join(rng.choice("abc é\n~北") for _ in range(size))[:size]
    made = media.text_media(pa.array([text]))
    data = made.field("media")[0].as_py()
    row = media._digest(pa.array([data], pa.binary()))[0].as_py()
    assert (row["payload_bytes"], row["payload_sha256"], row["tail_crc32"], row["feature"], row["frames"]) == digest_of(text)
    assert row["media_bytes"] == len(data) and row["media_sha256"] == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("data", [None, b"", b"GIF89a", b"no picture", media.encode(b" " * LINE)[:-30]])
def test_damaged_media_have_no_frames(spark, data):
    assert set(media._digest(pa.array([data], pa.binary()))[0].as_py().values()) == {None}
    df = spark.createDataFrame([(1, data)], "doc_id long, media binary")
    assert media.frames(df).count() == 0


def test_stored_frames_equal_decoded_ones(spark, tmp_path):
    samples = bytes(random.Random(3).randrange(256) for _ in range(2 * FRAME + LINE))
    df = spark.createDataFrame([(1, media.encode(samples)), (2, media.encode(samples[:LINE]))], "doc_id long, media binary")
    media.store_frames(df, str(tmp_path / "frames"), with_pixels=True)
    rows = spark.read.parquet(str(tmp_path / "frames")).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.at_ms, r.delay_ms, r.width, r.height) for r in rows] == [(1, 0, 0, 40, 192, 320), (1, 1, 40, 40, 192, 320), (1, 2, 80, 40, 192, 1), (2, 0, 0, 40, 192, 1)]
    shown = np.frombuffer(rows[1].rgb, np.uint8).reshape(-1, 3)
    assert bytes(shown[:, 0]) == samples[FRAME : 2 * FRAME] and (shown[:, 0] == shown[:, 2]).all()
    assert list(rows[1].colours) == media.colour_histogram(shown.reshape(320, 192, 3)).tolist()


def coded(codes, width_of):
    value, at = 0, 0
    for n, code in enumerate(codes):
        value |= code << at
        at += width_of(n)
    return value.to_bytes(at // 8 + 1, "little")


def plain_decode(codes, clear):
    """Samples of a list of codes, entry by entry."""
    table, prev, out = {}, None, b""
    for code in codes:
        if code in (clear, clear + 1):
            table, prev = {}, None
            continue
        known = bytes([code]) if code < clear else table.get(code)
        if prev is None:
            out, prev = out + known, known
            continue
        entry = known if known is not None else prev + prev[:1]
        if clear + 2 + len(table) < 4096:
            table[clear + 2 + len(table)] = prev + entry[:1]
        out, prev = out + entry, entry
    return out


def test_codes_beyond_a_full_table_and_deep_runs():
    rng = random.Random(7)
    samples = bytes(rng.randrange(4) for _ in range(90_000)) + b"\0" * 9_000
    # an encoder that never clears: the table stays full
    table, codes, run = {bytes([i]): i for i in range(256)}, [256], b""
    for v in samples:
        if run + bytes([v]) in table:
            run += bytes([v])
            continue
        codes.append(table[run])
        if len(table) + 2 < 4096:
            table[run + bytes([v])] = len(table) + 2
        run = bytes([v])
    codes += [table[run], 257]
    widths = media.code_widths(len(codes), 9)
    stream = coded(codes, lambda n: 9 if n == 0 else int(widths[n - 1]))
    assert plain_decode(codes[:-1], 256) == samples
    assert media.lzw_decode(stream, 8, len(samples)) == samples
    with pytest.raises(media.Damaged):
        media._copied(np.array([65, 258, 260], np.uint32), 256)
    assert media._copied(np.array([65, 258, 259, 260], np.uint32), 256).tobytes() == b"A" * 10


def test_struct_of_a_gif():
    data = media.encode(b"x" * LINE)
    assert data[:6] == b"GIF89a" and struct.unpack_from("<HH", data, 6) == (192, 1) and data[-1:] == b";"
