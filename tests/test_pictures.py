"""Headers made by hand: sizes and orientations of JPEG, PNG and WebP, and boxes clamped by them."""

import struct

import pytest

from simgate.functions.pictures import Header, box_in, exif_orientation, header
from simgate.operators import inference


def tiff(orientation, order="<", kind=3):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return head + struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x0100, 4, 1, 99) + struct.pack(order + "HHIHH", 0x0112, kind, 1, orientation, 0) + b"\0" * 4


def jpeg(width, height, exif=None, frame=0xC0):
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    app = part(0xE1, b"Exif\0\0" + exif) if exif else b""
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + b"\0" * 9) + app + part(0xDB, b"\0" * 65) + b"\xff" + part(frame, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9) + part(0xDA, b"\0" * 10) + b"pixels"


def png(width, height, exif=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0" * 4
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", width, height) + b"\x08\x02\0\0\0") + chunk(b"IDAT", b"xyz") + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IEND", b"")


def webp(kind, width, height, exif=None):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    if kind == "lossy":
        body = chunk(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width | 0x4000, height))
    elif kind == "lossless":
        body = chunk(b"VP8L", b"\x2f" + struct.pack("<I", width - 1 | height - 1 << 14))
    else:
        body = chunk(b"VP8X", b"\x08\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")) + chunk(b"ALPH", b"odd") + chunk(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 1, 1))
        body += chunk(b"EXIF", exif) if exif else b""
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


@pytest.mark.parametrize("orientation", range(1, 9))
@pytest.mark.parametrize("order", "<>")
def test_every_orientation(orientation, order):
    shown = (30, 40) if orientation >= 5 else (40, 30)
    exif = tiff(orientation, order)
    for raw in (jpeg(40, 30, exif), jpeg(40, 30, exif, 0xC2), png(40, 30, exif), webp("extended", 40, 30, exif), webp("extended", 40, 30, b"Exif\0\0" + exif)):
        assert header(raw) == Header(40, 30, orientation) and header(raw).upright() == shown


def test_sizes_without_orientation():
    for raw in (jpeg(640, 480), png(640, 480), webp("lossy", 640, 480), webp("lossless", 640, 480), webp("extended", 640, 480)):
        assert header(raw) == Header(640, 480, 1)
    assert [exif_orientation(x) for x in (b"", b"II*\0", tiff(0), tiff(9), tiff(6, kind=4), tiff(6)[:14])] == [1] * 6


def test_what_is_no_picture():
    whole = jpeg(40, 30, tiff(6))
    for raw in (None, b"", b"text", b"\xff\xd8", b"\xff\xd8\xff\xda\0\4xx", b"\xff\xd8junk!", whole[:60], png(40, 30)[:20], png(0, 30), b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0WEBPVP8L\5\0\0\0abcde"):
        assert header(raw) is None
    for k in range(len(whole)):
        assert header(whole[:k]) in (None, Header(40, 30, 6))


def test_boxes_are_clamped_to_what_is_shown(spark):
    assert box_in((40, 40, 60, 60), 0.0, (100, 100)) == (40, 40, 60, 60) and box_in((40, 40, 60, 60), 0.1, (100, 100)) == (38, 38, 62, 62)
    assert box_in((0, 0, 20, 20), 0.5, (100, 100)) == (0, 0, 30, 30) and box_in((0, 0, 20, 20), 0.5, None) == (0, 0, 30, 30) and box_in((90, 0, 100, 45), 0.5, (100, 50)) == (85, 0, 100, 50)
    rows = [("upright", jpeg(100, 50)), ("turned", jpeg(50, 100, tiff(6))), ("unknown", b"raw")]
    images = spark.createDataFrame(rows, "name string, content binary")
    load = lambda: lambda items: [[{"confidence": 0.9, "x1": 90, "y1": 0, "x2": 100, "y2": 45, "area_fraction": None}] for _ in items]
    cut = lambda raw, edges: str(edges).encode()
    got = {r.name: (bytes(r.crop).decode(), r.image_width, r.image_height, r.area_fraction) for r in inference.detect_and_crop(images, "content", load, cut, margin=0.5).collect()}
    assert got == {"upright": ("(85, 0, 100, 50)", 100, 50, 0.09), "turned": ("(85, 0, 100, 50)", 100, 50, 0.09), "unknown": ("(85, 0, 105, 67)", None, None, None)}
    sizes = {r.name: (r.image_width, r.image_height, r.orientation) for r in inference.with_size(images, "content").collect()}
    assert sizes == {"upright": (100, 50, 1), "turned": (100, 50, 6), "unknown": (None, None, None)}
