"""Headers of whole and cut files; drawings, photos and stripes pixel by pixel."""

import random
import struct

import numpy as np

from quillspark.operators import images as I


def jpeg(width, height, turn=None, little=True, marker=0xC0, before=b""):
    e = "<" if little else ">"
    tiff = (b"II*\x00" if little else b"MM\x00*") + struct.pack(e + "IH", 8, 2) + struct.pack(e + "HHIHH", 0x010F, 3, 1, 5, 0) + struct.pack(e + "HHIHH", 0x0112, 3, 1, turn or 0, 0)
    exif = b"\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff if turn is not None else b""
    return b"\xff\xd8" + before + exif + b"\xff\xc4\x00\x05abc" + bytes([0xFF, marker]) + struct.pack(">HBHH", 17, 8, height, width) + b"x" * 12


def test_headers():
    get = lambda d: tuple(I.read_header(d).values())
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 70_000, 3)
    assert get(png) == ("png", 70_000, 3, 1) and get(png[:20]) == ("png", None, None, 1) and get(b"") == (None, None, None, 1) and get(b"GIF89a") == (None, None, None, 1)
    for turn in range(1, 9):
        assert get(jpeg(640, 480, turn, True)) == get(jpeg(640, 480, turn, False, 0xC2, b"\xff\xe0\x00\x04JF")) == ("jpeg", 640, 480, turn)
    assert get(jpeg(5, 6)) == ("jpeg", 5, 6, 1) and get(jpeg(5, 6, 0)) == ("jpeg", 5, 6, 1)
    whole = jpeg(640, 480, 6)
    for k in range(len(whole)):
        kind, w, h, turn = get(whole[:k])
        assert (w, h) in ((None, None), (640, 480)) and turn in (1, 6) and kind in (None, "jpeg")
    r = random.Random(1)
    for _ in range(500):
        get(b"\xff\xd8" + r.randbytes(60))


def by_pixel(px):
    h, w, c = px.shape
    step, pairs, flat, edges = max(1, h // 400), 0, 0, 0
    for y in range(0, h, step):
        for x in range(1, w):
            d = sum(abs(int(px[y, x, k]) - int(px[y, x - 1, k])) for k in range(c)) * (3 if c == 1 else 1)
            pairs, flat, edges = pairs + 1, flat + (d <= 8), edges + (d >= 150)
    colors = {tuple(p) for p in px.reshape(-1, c).tolist()}
    return pairs > 0 and flat / pairs >= 0.6 and edges / pairs >= 0.003, len(colors) > 1024, c == 1 or all(len(set(p)) == 1 for p in px.reshape(-1, c)[::97].tolist())


def test_kinds(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 700)
    r = np.random.default_rng(2)
    images = [np.full((30, 40, 3), 200, np.uint8), r.integers(0, 256, (60, 50, 3), dtype=np.uint8), np.repeat(np.where(np.arange(90) // 15 % 2, 255, 0)[None, :, None], 900, axis=0).astype(np.uint8)]
    images += [np.repeat(np.where(np.arange(64) // 16 % 2, 250, 5)[None, :, None], 20, axis=0).repeat(3, axis=2).astype(np.uint8), (np.arange(40)[:, None, None] + np.arange(60)[None, :, None] * 2 + np.zeros(3)).astype(np.uint8), np.zeros((3, 1, 1), np.uint8)]
    assert [by_pixel(p)[0] for p in images] == [False, False, True, True, False, False]
    rows = [(k, p.shape[1], p.shape[2], bytearray(p.tobytes() + b"\1" * (k % 2 and p.shape[2] > 1))) for k, p in enumerate(images)] + [(90, 5, 1, None), (91, 0, 3, bytearray(b"abc")), (92, None, 1, bytearray(b"a"))]
    got = {x.k: (x.graphic, x.many_colors, x.grey) for x in I.image_kinds(spark.createDataFrame(rows, "k int, w int, c int, px binary"), ["k"], "w", "c", "px").collect()}
    assert got == {k: by_pixel(p) for k, p in enumerate(images)} | {k: (False, False, True) for k in (90, 91, 92)}
