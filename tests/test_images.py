"""Image sets: PNG files written with the standard library, one folder per class."""

import os
import struct
import tempfile
import zlib

from sparkeda.operators import images as im
from sparkeda.sources import io


def _png(path, w, h, channels):
    color = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\x00" + bytes([(x * 7 + y * 3) % 256 for x in range(w) for _ in range(channels)])
                   for y in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)

    data = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    with open(path, "wb") as f:
        f.write(data)


def test_image_set(spark):
    root = tempfile.mkdtemp(prefix="sparkeda-img-")
    for cls, n, ch in [("cats", 3, 3), ("dogs", 1, 1)]:
        os.makedirs(os.path.join(root, cls))
        for i in range(n):
            _png(os.path.join(root, cls, f"{i}.png"), 7, 5, ch)
    _png(os.path.join(root, "top.png"), 9, 4, 1)
    with open(os.path.join(root, "cats", "notes.txt"), "w") as f:
        f.write("not an image")
    files = io.read_images(spark, root, with_size=True)
    dist = {r["label"]: r["count"] for r in im.class_distribution(files, "relpath").collect()}
    assert dist == {"cats": 3, "dogs": 1, "__root__": 1}
    imb = im.image_imbalance(files, "relpath").collect()[0]
    assert imb["total_images"] == 5 and imb["num_classes"] == 3 and imb["class_imbalance_ratio"] == 3.0
    size = im.image_size_stats(files).collect()[0]
    assert size["min_width"] == 7 and size["max_width"] == 9 and size["avg_height"] == 4.8
    stats = im.image_imbalance(files, "relpath")
    adv = {r["technique"] for r in im.augmentation_advice(stats).collect()}
    assert "Horizontal Flip" in adv and "Oversampling via Augmentation" not in adv


def _header(kind, w, h):
    be, le = (lambda v, n: v.to_bytes(n, "big")), (lambda v, n: v.to_bytes(n, "little"))
    jpeg = b"\xff\xd8\xff\xe1" + be(300, 2) + b"\xff\xc0" * 149 + b"\xff\xff\xdb" + be(67, 2) + b"\0" * 65
    ifd = [(256, 3, w), (257, 4, h), (258, 3, 8), (277, 3, 4)]
    return {"gif": b"GIF87a" + le(w, 2) + le(h, 2) + b"\0\0\0", "bmp": b"BM" + b"\0" * 16 + le(w, 4) + le(2 ** 32 - h, 4) + le(1, 2) + le(8, 2),
            "jpg": jpeg + b"\xff\xc2" + be(17, 2) + b"\x08" + be(h, 2) + be(w, 2) + b"\x01" + b"\0" * 9,
            "webp": b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + le(w, 2) + le(h, 2),
            "webpl": b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + le((w - 1) | (h - 1) << 14 | 1 << 28, 4),
            "webpx": b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\x10\0\0\0" + le(w - 1, 3) + le(h - 1, 3),
            "tiff": b"II*\0" + le(10, 4) + b"xx" + le(len(ifd), 2) + b"".join(le(t, 2) + le(k, 2) + le(1, 4) + le(v, 4) for t, k, v in ifd),
            "tiffm": b"MM\0*" + be(8, 4) + be(len(ifd), 2) + b"".join(
                be(t, 2) + be(k, 2) + be(1, 4) + (be(v, 2) + b"\0\0" if k == 3 else be(v, 4)) for t, k, v in ifd)}[kind]


def test_sizes_come_from_headers(spark):
    kinds = {"gif": 1, "bmp": 1, "jpg": 1, "webp": 3, "webpl": 4, "webpx": 4, "tiff": 4, "tiffm": 4}
    rows = [(k, _header(k, 640, 333)) for k in kinds] + [("short", b"\x89PNG\r\n\x1a\n\0\0"), ("cut", _header("jpg", 5, 5)[:200]),
                                                        ("text", b"hello"), ("empty", b""), ("none", None)]
    got = {r["k"]: (r["width"], r["height"], r["channels"]) for r in
           io.image_headers(spark.createDataFrame(rows, "k string, content binary")).collect()}
    for k, ch in kinds.items():
        assert got[k] == (640, 333, ch), k
    assert all(got[k] == (None, None, None) for k in ("short", "cut", "text", "empty", "none"))
