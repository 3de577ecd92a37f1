import hashlib
import random
import zlib

import numpy as np

from wayloom.llm import media as op


def test_lzw_round_trips():
    rng = random.Random(1)
    for bits in (2, 5, 8):
        for n in (0, 1, 2, 300, 3837, 5000, 30000):
            for samples in (bytes(rng.randrange(1 << bits) for _ in range(n)), bytes([1]) * n, bytes(i % 3 for i in range(n))):
                assert op.lzw_decode(op.lzw_encode(samples, bits), bits, n) == samples


def frame(left, top, w, h, samples, disposal=0, transparent=None, delay=5, flags=0, palette=b""):
    lead = bytes((0x21, 0xF9, 4, disposal << 2 | (transparent is not None))) + delay.to_bytes(2, "little") + bytes((transparent or 0, 0))
    box = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes((flags,))
    return lead + box + palette + b"\x02" + op._blocks(op.lzw_encode(bytes(samples), 2))


def gif(w, h, *frames):
    colours = bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\xf1\0\0" + colours + b"\x21\xfe\x03abc\0" + b"".join(frames) + b"\x3b"


def red(f):
    return f.rgba[..., 0].tolist()


def test_disposal_transparency_and_times():
    file = gif(
        2, 2,
        frame(0, 0, 2, 2, [1, 1, 1, 1]),
        frame(0, 0, 1, 2, [0, 3], disposal=2, transparent=3),
        frame(1, 1, 1, 1, [0], disposal=3),
        frame(0, 1, 1, 1, [1]),
    )
    frames = op.decode_gif(file)
    assert [f.start_ms for f in frames] == [0, 50, 100, 150] and {f.delay_ms for f in frames} == {50}
    assert red(frames[0]) == [[255, 255], [255, 255]]
    assert red(frames[1]) == [[0, 255], [255, 255]]
    assert red(frames[2]) == [[0, 255], [0, 0]] and frames[2].rgba[0, 0, 3] == 0 and frames[2].rgba[1, 1, 3] == 255
    assert red(frames[3]) == [[0, 255], [255, 255]]


def test_interlace_local_palette_and_short_streams():
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 1]
    order = op._interlaced(9)
    file = gif(1, 9, frame(0, 0, 1, 9, [rows[i] for i in order], flags=0x40))
    assert op.decode_gif(file)[0].rgba[:, 0, :3].tolist() == [[[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]][v] for v in rows]
    own = frame(0, 0, 2, 1, [0, 1], flags=0x80, palette=bytes((9, 9, 9, 7, 7, 7)))
    assert op.decode_gif(gif(2, 1, own))[0].rgba[..., 0].tolist() == [[9, 7]]
    cut = op.decode_gif(gif(3, 1, frame(0, 0, 3, 1, [1])))
    assert cut[0].rgba[0, :, 3].tolist() == [255, 0, 0]


def test_texts_round_trip(spark, hard_docs):
    files = op.store_texts(hard_docs)
    want = []
    for r in hard_docs.collect():
        raw = (r["text"] or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((str(r["doc_id"]), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])))
    got = [(str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in op.media_digests(files).collect()]
    assert sorted(got) == sorted(want)
    for r in op.gif_frames(files.filter("doc_id = 2")).collect():
        assert (r["width"], r["height"], r["delay_ms"]) == (24, 24, 100) and r["red"] == [0] * 7 + [576] == r["blue"]
        assert np.frombuffer(bytes(r["rgba"]), np.uint8).reshape(24, 24, 4)[..., 0].min() == 255
    assert op.media_digests(op.store_texts(hard_docs.limit(0))).count() == 0


def test_broken_files_are_reported(spark):
    good = op.encode_gif([bytes(576)], 24)
    rows = [(1, good), (2, good[:40]), (3, b"no"), (4, None), (5, good[:-300])]
    got = op.gif_frames(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [r["error"] is None for r in sorted(got, key=lambda r: r["doc_id"])] == [True, False, False, False, False]


def test_broken_files_do_not_end_the_digests(spark):
    good = op.encode_gif([bytes(576)], 24)
    huge = gif(65535, 65535, frame(0, 0, 1, 1, [1]))
    wide = gif(1, 1, frame(0, 0, 65535, 65535, [1]))
    rows = [(1, 5, good), (2, 5, good[:40]), (3, 5, None), (4, 5, huge), (5, 5, wide), (6, 5, b"")]
    got = {r["doc_id"]: r for r in op.media_digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 6 and got[1]["payload_bytes"] == 576 and got[1]["error"] is None
    assert all(got[i]["payload_sha256"] is None and got[i]["error"] for i in (2, 3, 4, 5, 6))
    assert got[4]["error"] == "canvas too large" and got[5]["error"] == "frame too large"


def test_frames_come_one_by_one():
    frames = op.iter_frames(gif(1, 1, frame(0, 0, 1, 1, [1]), frame(0, 0, 1, 1, [2]))[:-3])
    assert red(next(frames)) == [[255]]
