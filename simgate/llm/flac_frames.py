"""FLAC frames of any form, one value at a time: for streams that the fast path of ``flac`` doesn't read.

One to eight channels, 4 to 32 bits, blocks of any and of varying size, every partition order, both
Rice codings and their escapes, fixed predictors, linear ones, wasted bits and the stereo forms, as in
the format's specification (RFC 9639). Both checksums of every frame are verified.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from simgate.llm.flac import CONSTANT, FIXED, LPC, VERBATIM, FlacError, Stream, crcs

#: The fixed predictors of the format, by order.
PREDICTORS = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
#: Bits of a sample by their code in a frame header (0: as in the stream's metadata, 3: reserved).
SAMPLE_BITS = [0, 8, 12, None, 16, 20, 24, 32]
#: Codes of the stereo forms.
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


@dataclass
class Frame:
    first: int  # number of its first sample
    samples: np.ndarray  # (samples, channels)
    bits: int
    begin: int  # bytes: of the frame, of the end of its header, of its end, both without checksums
    head: int
    end: int


class Cursor:
    """Bits of a stream, read from a place on."""

    def __init__(self, data: bytes, byte: int):
        self.data, self.at = data, 8 * byte

    def read(self, width: int) -> int:
        stop = self.at + width
        end = stop + 7 >> 3
        if end > len(self.data):
            raise FlacError("a stream ends within a frame")
        value = int.from_bytes(self.data[self.at >> 3 : end], "big") >> (-stop & 7) & (1 << width) - 1
        self.at = stop
        return value

    def signed(self, width: int) -> int:
        value = self.read(width)
        return value - (1 << width) if width and value >> width - 1 else value

    def zeros(self) -> int:
        """The number of zeros before the next one, and past that one."""
        begin = self.at
        while True:
            piece = self.data[self.at >> 3 : (self.at >> 3) + 16]
            if not piece:
                raise FlacError("a stream ends within a frame")
            left = 8 * len(piece) - (self.at & 7)
            value = int.from_bytes(piece, "big") & (1 << left) - 1
            if value:
                self.at += left - value.bit_length() + 1
                return self.at - 1 - begin
            self.at += left


def _coded_number(cur: Cursor) -> int:
    lead = cur.read(8)
    ones = 8 - (~lead & 255).bit_length()
    if ones in (1, 8):
        raise FlacError("a frame number that is not coded rightly")
    value = lead & (1 << max(7 - ones, 0)) - 1 if ones else lead
    for _ in range(ones - 1):
        more = cur.read(8)
        if more >> 6 != 2:
            raise FlacError("a frame number that is not coded rightly")
        value = value << 6 | more & 63
    return value


def _residuals(cur: Cursor, size: int, order: int) -> list[int]:
    method = cur.read(2)
    parts = 1 << cur.read(4)
    if method > 1 or size % parts or size // parts < order:
        raise FlacError("a reserved coding method, or partitions that do not fit")
    width, out = 4 + method, []
    for part in range(parts):
        count = size // parts - (0 if part else order)
        k = cur.read(width)
        if k == (1 << width) - 1:  # escaped: plain values
            plain = cur.read(5)
            out += [cur.signed(plain) for _ in range(count)]
            continue
        for _ in range(count):
            code = cur.zeros() << k | cur.read(k)
            out.append(code >> 1 ^ -(code & 1))
    return out


def _subframe(cur: Cursor, size: int, bits: int) -> np.ndarray:
    if cur.read(1):
        raise FlacError("a subframe header that is not coded rightly")
    kind = cur.read(6)
    wasted = cur.zeros() + 1 if cur.read(1) else 0
    width = bits - wasted
    if width < 1:
        raise FlacError("no bits are left of a sample")
    if kind == CONSTANT:
        out = [cur.signed(width)] * size
    elif kind == VERBATIM:
        out = [cur.signed(width) for _ in range(size)]
    elif FIXED <= kind <= FIXED + 4 or kind >= LPC:
        order = kind - FIXED if kind < LPC else kind - LPC + 1
        if order > size:
            raise FlacError("a predictor longer than its block")
        out = [cur.signed(width) for _ in range(order)]
        coefs, shift = PREDICTORS[order] if kind < LPC else None, 0
        if coefs is None:
            precision, shift = cur.read(4) + 1, cur.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("a reserved precision or shift")
            coefs = [cur.signed(precision) for _ in range(order)]
        backwards = coefs[::-1]
        for residual in _residuals(cur, size, order):
            out.append(residual + (sum(c * x for c, x in zip(backwards, out[len(out) - order :], strict=True)) >> shift))
    else:
        raise FlacError("a reserved subframe type")
    if any(not -1 << width - 1 <= x < 1 << width - 1 for x in out):
        raise FlacError("samples of more bits than the frame says")
    return np.array(out, np.int64) << wasted


def _frame(cur: Cursor, info: Stream) -> Frame:
    begin = cur.at >> 3
    if cur.read(15) != 0x7FFC:
        raise FlacError("no frame where one should be")
    varying, size_code, rate_code, layout, bits_code, reserved = cur.read(1), cur.read(4), cur.read(4), cur.read(4), cur.read(3), cur.read(1)
    if reserved or not size_code or rate_code == 15 or layout > MID_SIDE or SAMPLE_BITS[bits_code] is None:
        raise FlacError("a reserved value in a frame header")
    number = _coded_number(cur)
    if size_code < 6:
        size = 192 if size_code == 1 else 576 << size_code - 2
    else:
        size = cur.read(8 * (size_code - 5)) + 1 if size_code < 8 else 256 << size_code - 8
    cur.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    bits, head = SAMPLE_BITS[bits_code] or info.bits, cur.at >> 3
    cur.read(8)
    channels = layout + 1 if layout < LEFT_SIDE else 2
    if channels != info.channels or bits != info.bits:
        raise FlacError("a frame of other channels or bits than its stream")
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(layout)
    parts = [_subframe(cur, size, bits + (c == side)) for c in range(channels)]
    if layout == LEFT_SIDE:
        parts[1] = parts[0] - parts[1]
    elif layout == SIDE_RIGHT:
        parts[0] = parts[0] + parts[1]
    elif layout == MID_SIDE:
        twice = parts[0] * 2 + (parts[1] & 1)
        parts = [twice + parts[1] >> 1, twice - parts[1] >> 1]
    cur.read(-cur.at & 7)
    end = cur.at >> 3
    cur.read(16)
    return Frame(number if varying else number * info.block, np.stack(parts, 1), bits, begin, head, end)


def frames(data: bytes, info: Stream, first: int = 0, last: int | None = None) -> list[Frame]:
    """The frames that hold samples from ``first`` up to ``last``, sought from the nearest seek point before them."""
    before = info.points[info.points["sample"] <= first]
    cur = Cursor(data, info.audio + (int(before["offset"][-1]) if len(before) else 0))
    found, done = [], 0
    while cur.at < 8 * len(data) and not (info.total and done >= info.total):
        frame = _frame(cur, info)
        done = frame.first + len(frame.samples)
        if last is not None and frame.first >= last:
            break
        if done > first:
            found.append(frame)
    if last is None and info.total and done < info.total:
        raise FlacError("a stream ends before its last sample")
    raw = np.frombuffer(data, np.uint8)
    begin, head, end = (np.array([getattr(f, name) for f in found], np.int64) for name in ("begin", "head", "end"))
    if (crcs(raw, begin, head - begin, 8, 0x07) != raw[head]).any():
        raise FlacError("a frame header's checksum is wrong")
    if (crcs(raw, begin, end - begin, 16, 0x8005) != raw[end].astype(np.uint32) << 8 | raw[end + 1]).any():
        raise FlacError("a frame's checksum is wrong")
    return found


def signed_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved samples as signed little-endian whole bytes, over which the stream's digest is taken."""
    return np.ascontiguousarray(samples).astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (bits + 7) // 8].tobytes()


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved samples, little-endian: of up to 8 bits unsigned (128 is the middle), of more signed."""
    raw = signed_bytes(samples, bits)
    return (np.frombuffer(raw, np.uint8) ^ 128).tobytes() if bits <= 8 else raw


def whole(data: bytes, info: Stream) -> list[Frame]:
    """All frames; the digest of the samples is verified where the stream has one."""
    found = frames(data, info)
    digest = hashlib.md5()
    for frame in found:
        digest.update(signed_bytes(frame.samples, frame.bits))
    if any(info.md5) and digest.digest() != info.md5:
        raise FlacError("the digest of the samples is wrong")
    return found
