"""Width, height and orientation of pictures, read from the headers of JPEG, PNG and WebP bytes; no pixel is decoded."""

from __future__ import annotations

import struct
from typing import NamedTuple

#: EXIF's orientation tag, the orientations that lie on their side, and JPEG's frame markers.
ORIENTATION = 0x0112
SIDEWAYS = (5, 6, 7, 8)
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: JPEG markers without a length: restarts, start and the lone one.
BARE = frozenset(range(0xD0, 0xD9)) | {0x01}
UPRIGHT = 1


class Header(NamedTuple):
    """Size as it is stored, and EXIF's orientation (1 where there is none)."""

    width: int
    height: int
    orientation: int = UPRIGHT

    def upright(self) -> tuple[int, int]:
        """Size as it is shown, turned by the orientation."""
        return (self.height, self.width) if self.orientation in SIDEWAYS else (self.width, self.height)


def exif_orientation(tiff: bytes) -> int:
    """The orientation that a TIFF block of EXIF data gives; 1 where it gives none that exists."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    try:
        (at,) = struct.unpack_from(order + "I", tiff, 4) if order else (None,)
        if at is None:
            return UPRIGHT
        (entries,) = struct.unpack_from(order + "H", tiff, at)
        for k in range(entries):
            tag, kind, n, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == ORIENTATION:
                return value if kind == 3 and n == 1 and 1 <= value <= 8 else UPRIGHT
    except struct.error:  # cut short
        pass
    return UPRIGHT


def _jpeg(raw: bytes) -> Header | None:
    at, orientation = 2, UPRIGHT
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            return None
        marker = raw[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker in BARE:
            at += 2
            continue
        (size,) = struct.unpack_from(">H", raw, at + 2)
        if marker in FRAMES:
            if at + 9 > len(raw):
                return None
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return Header(width, height, orientation)
        if marker == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            orientation = exif_orientation(raw[at + 10 : at + 2 + size])
        if marker == 0xDA or size < 2:  # pixels, and no frame before them
            return None
        at += 2 + size
    return None


def _png(raw: bytes) -> Header | None:
    if raw[12:16] != b"IHDR" or len(raw) < 24:
        return None
    width, height = struct.unpack_from(">II", raw, 16)
    at, orientation = 8, UPRIGHT
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"eXIf":
            orientation = exif_orientation(raw[at + 8 : at + 8 + size])
        if kind in (b"eXIf", b"IEND"):
            break
        at += 12 + size
    return Header(width, height, orientation)


def _webp(raw: bytes) -> Header | None:
    at, size, orientation = 12, None, UPRIGHT
    while at + 8 <= len(raw):
        kind, n = struct.unpack_from("<4sI", raw, at)
        body = raw[at + 8 : at + 8 + min(n, 1 << 16)]
        if kind == b"VP8X" and len(body) >= 10:
            size = 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        elif kind == b"VP8 " and size is None and body[3:6] == b"\x9d\x01\x2a" and len(body) >= 10:
            size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L" and size is None and body[:1] == b"\x2f" and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            size = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"EXIF":
            orientation = exif_orientation(body.removeprefix(b"Exif\0\0"))
        at += 8 + n + n % 2
    return Header(*size, orientation) if size else None


def header(raw: bytes | None) -> Header | None:
    """The header of a picture; None where the bytes are none of the three, or cut off before their size."""
    raw = raw or b""
    if raw[:2] == b"\xff\xd8":
        found = _jpeg(raw)
    elif raw[:8] == b"\x89PNG\r\n\x1a\n":
        found = _png(raw)
    elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        found = _webp(raw)
    else:
        return None
    return found if found and found.width and found.height else None


def box_in(box: tuple[int, int, int, int], margin: float, size: tuple[int, int] | None) -> tuple[int, int, int, int]:
    """The edges of a box widened by a share of its sides (rounded half to even), clamped to a picture of that size; without one, to what isn't negative."""
    x1, y1, x2, y2 = box
    dx, dy = round((x2 - x1) * margin), round((y2 - y1) * margin)
    width, height = size or (x2 + dx, y2 + dy)
    return max(0, x1 - dx), max(0, y1 - dy), min(width, x2 + dx), min(height, y2 + dy)
