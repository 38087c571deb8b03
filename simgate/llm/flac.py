"""FLAC streams of 8-bit samples, encoded and decoded many frames at a time with numpy.

What ``encode`` writes, and the fast path reads: one channel, 8 bits, frames of 576 samples (the
last frame of a stream too), constant, verbatim, fixed and linear-prediction subframes, Rice coded
residuals in partitions, a seek point for every frame. A sample is the byte less 128, as FLAC's
samples are signed. Any other stream (``flac_frames``) is read a frame at a time. The layouts and
numbers below are those of the format's specification (RFC 9639).

A bad checksum, a wrong sample digest or a reserved value raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

BLOCK = 576
RATE = 8000
ORDER = 4  # of linear prediction
PRECISION = 10
PARTITION_ORDER = 2
PARTS = 1 << PARTITION_ORDER
PART = BLOCK // PARTS
#: Fixed values of the format: sync, block size code of 576 and rate code of 8 kHz, mono of 8 bits.
HEADER = (0xFF, 0xF8, 0x24, 0x02)
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32
META = 4 + 4 + 34  # bytes of the marker and STREAMINFO
POINTS = [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]


class FlacError(ValueError):
    pass


class OtherForm(FlacError):
    """Not what the fast path reads; ``flac_frames`` may."""


@lru_cache(4)
def crc_table(width: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(width - 8)
    top, mask = np.uint32(1 << (width - 1)), np.uint32((1 << width) - 1)
    for _ in range(8):
        table = np.where(table & top, table << 1 ^ np.uint32(poly), table << 1) & mask
    return table


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, poly: int) -> np.ndarray:
    """CRC of data[start:start+size] for every span, byte by byte over all spans at once."""
    table = crc_table(width, poly)
    out = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return out
    order = np.argsort(-sizes, kind="stable")
    at, left, crc = starts[order], sizes[order], np.zeros(len(starts), np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # spans longer than t
    mask, shift = np.uint32((1 << width) - 1), np.uint32(width - 8)
    for t, n in enumerate(live.tolist()):
        c = crc[:n]
        crc[:n] = table[(c >> shift ^ data[at[:n] + t]) & 255] ^ (c << 8 & mask)
    out[order] = crc
    return out


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray | int, width: int) -> None:
    for b in range(width):
        bits[at + (width - 1 - b)] = value >> b & 1


def _restored(residual: np.ndarray, warm: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Samples (time first) from warm-up samples, residuals and coefficients (order first)."""
    order = len(warm)
    out = np.empty((BLOCK, residual.shape[1]), np.int64)
    out[:order] = warm
    for t in range(order, BLOCK):
        total = coefs[0] * out[t - 1]
        for j in range(1, order):
            total += coefs[j] * out[t - 1 - j]
        out[t] = residual[t - order] + (total >> shift)
    return out


def _predicted(samples: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of samples (frames first) after the first ORDER of each frame."""
    total = np.zeros((len(samples), BLOCK - ORDER), np.int64)
    for j in range(ORDER):
        total += coefs[:, j : j + 1] * samples[:, ORDER - 1 - j : BLOCK - 1 - j]
    return samples[:, ORDER:] - (total >> shift[:, None])


def coefficients(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized linear predictors by the autocorrelation of each frame (Levinson and Durbin)."""
    wide = samples.astype(np.int64)
    auto = np.stack([(wide[:, k:] * wide[:, : BLOCK - k]).sum(1) for k in range(ORDER + 1)], 1).astype(np.float64)
    error = auto[:, 0] + 1.0
    a = np.zeros((len(samples), ORDER))
    for i in range(ORDER):
        acc = auto[:, i + 1].copy()
        for j in range(i):
            acc = acc - a[:, j] * auto[:, i - j]
        k = acc / error
        old = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        error = np.maximum(error * (1.0 - k * k), 1.0)
    most = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(np.floor(np.log2(((1 << (PRECISION - 1)) - 1) / most)), 0, 12).astype(np.int64)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _utf8_size(n: np.ndarray) -> np.ndarray:
    return 1 + (n >= 1 << 7) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose length is a positive multiple of 576."""
    if not payloads:
        return []
    if any(not p or len(p) % BLOCK for p in payloads):
        raise FlacError("a payload must be a positive multiple of 576 bytes")
    frames = np.array([len(p) // BLOCK for p in payloads])
    first = np.concatenate(([0], np.cumsum(frames)))
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    samples = raw.astype(np.int32) - 128
    n = len(samples)
    number = np.arange(n) - np.repeat(first[:-1], frames)

    # choose: linear prediction, no prediction (fixed, order 0), verbatim or constant
    coefs, shift = coefficients(samples)
    predicted = _predicted(samples, coefs, shift)
    zig = np.zeros((2, n, BLOCK), np.int64)
    zig[0] = samples * 2 ^ samples >> 31
    zig[1, :, ORDER:] = predicted << 1 ^ predicted >> 63
    counts = np.full((2, PARTS), PART)
    counts[1, 0] -= ORDER
    parts = zig.reshape(2, n, PARTS, PART)
    ks = np.arange(12)
    cost = np.stack([(parts >> k).sum(3) + counts[:, None] * (1 + k) for k in ks])
    k_best = cost.argmin(0)
    bits_of = np.take_along_axis(cost, k_best[None], 0)[0].sum(2) + 6 + 4 * PARTS
    bits_of[1] += 8 * ORDER + 9 + PRECISION * ORDER
    linear = bits_of[1] < bits_of[0]
    pick = linear.astype(np.int64)
    every = np.arange(n)
    u, k, body = zig[pick, every], k_best[pick, every], bits_of[pick, every]
    constant = (samples == samples[:, :1]).all(1)
    verbatim = ~constant & (body >= 8 * BLOCK)
    coded = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, body))

    # frame sizes are known now, so every frame has its place among the bits
    head = len(HEADER) + _utf8_size(number) + 1
    size = head + (8 + body + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    at = start[:-1] * 8
    for i, byte in enumerate(HEADER):
        _put(bits, at + 8 * i, byte, 8)
    wide = _utf8_size(number)
    for length in np.unique(wide).tolist():
        own = np.flatnonzero(wide == length)
        for i in range(length):
            rest = number[own] >> 6 * (length - 1 - i)
            lead = rest | (0xFF00 >> length & 0xFF) if length > 1 else rest
            _put(bits, at[own] + 32 + 8 * i, lead if i == 0 else rest & 63 | 128, 8)
    kind = np.where(constant, CONSTANT, np.where(verbatim, VERBATIM, np.where(linear, LPC + ORDER - 1, FIXED)))
    sub = at + 8 * head
    _put(bits, sub, kind << 1, 8)
    pos = sub + 8
    _put(bits, pos[constant], raw[constant, 0] ^ 128, 8)
    if verbatim.any():
        _put(bits, (pos[verbatim, None] + 8 * np.arange(BLOCK)).ravel(), (raw[verbatim] ^ 128).ravel(), 8)
    for j in range(ORDER):
        own = coded & linear
        _put(bits, pos[own] + 8 * j, raw[own, j] ^ 128, 8)
    own = coded & linear
    pos = np.where(own, pos + 8 * ORDER, pos)
    _put(bits, pos[own], PRECISION - 1, 4)
    _put(bits, pos[own] + 4, shift[own], 5)
    for j in range(ORDER):
        _put(bits, pos[own] + 9 + PRECISION * j, coefs[own, j] & (1 << PRECISION) - 1, PRECISION)
    pos = np.where(own, pos + 9 + PRECISION * ORDER, pos)[coded]
    _put(bits, pos, PARTITION_ORDER, 6)  # coding method 0, then the order
    u, k, linear = u[coded], k[coded], linear[coded]
    lengths = (u >> np.repeat(k, PART, 1)) + 1 + np.repeat(k, PART, 1)
    lengths[:, :ORDER][linear] = 0
    lengths[:, ::PART] += 4  # each partition's parameter stands before its first code
    if linear.any():
        lengths[linear, 0], lengths[linear, ORDER] = 0, lengths[linear, ORDER] + 4
    ends = pos[:, None] + 6 + np.cumsum(lengths, 1)
    begin = np.arange(0, BLOCK, PART) + np.zeros((len(u), 1), np.int64)
    begin[linear, 0] = ORDER
    where = np.take_along_axis(ends - lengths, begin, 1)
    _put(bits, where.ravel(), k.ravel(), 4)
    flat_u, flat_k, flat_end = u.ravel(), np.repeat(k, PART, 1).ravel(), ends.ravel()
    real = np.ones(u.shape, bool)
    real[:, :ORDER][linear] = False
    real = real.ravel()
    flat_u, flat_k, flat_end = flat_u[real], flat_k[real], flat_end[real]
    bits[flat_end - 1 - flat_k] = 1
    for b in range(int(flat_k.max(initial=0))):
        own = flat_k > b
        bits[flat_end[own] - 1 - b] = flat_u[own] >> b & 1
    data = np.packbits(bits)
    data[start[:-1] + head - 1] = crcs(data, start[:-1], head - 1, 8, 0x07)
    whole = crcs(data, start[:-1], size - 2, 16, 0x8005)
    data[start[1:] - 2], data[start[1:] - 1] = whole >> 8, whole & 255

    out = []
    for p, a, b in zip(payloads, first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = size[a:b]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(b - a, POINTS)
        points["sample"], points["offset"], points["n"] = np.arange(b - a) * BLOCK, start[a:b] - start[a], BLOCK
        table = points.tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + data[start[a] : start[b]].tobytes())
    return out


class Stream:
    """The metadata of one stream: sizes, total samples, sample digest, seek points; offsets of all frames if the fast path reads it."""

    def __init__(self, data: bytes):
        if len(data) < META or data[:4] != b"fLaC" or data[4] & 127:
            raise FlacError("not a FLAC stream")
        packed = int.from_bytes(data[18:26], "big")
        self.total, self.md5 = packed & (1 << 36) - 1, data[26:42]
        self.channels, self.bits = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
        least, self.block = struct.unpack(">HH", data[8:12])
        at, last = META, data[4] >> 7
        self.points = np.zeros(0, POINTS)
        while not last:
            if at + 4 > len(data):
                raise FlacError("a stream ends within its metadata")
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            if kind == 3:
                points = np.frombuffer(data[at + 4 : at + 4 + size], POINTS)
                self.points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
            at += 4 + size
        self.audio = at
        numbers = self.points["sample"]
        own = (self.channels, self.bits, least, self.block) == (1, 8, BLOCK, BLOCK)
        whole = own and len(numbers) > 0 and len(numbers) * BLOCK == self.total and bool((numbers == np.arange(len(numbers)) * BLOCK).all())
        self.offsets = self.points["offset"].astype(np.int64) if whole else None


@lru_cache(16)
def _rice_table(k: int) -> np.ndarray:
    """For 16 bits: the code's length << 16 | its value, or 0 if it is longer than 16 bits."""
    window = np.arange(1 << 16)
    zeros = 15 - np.floor(np.log2(np.maximum(window, 1))).astype(np.int64)
    length = zeros + 1 + k
    ok = (window > 0) & (length <= 16)
    value = zeros << k | window >> np.maximum(16 - length, 0) & (1 << k) - 1
    return np.where(ok, length << 16 | value, 0).astype(np.int32)


class _Bits:
    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        self.words = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]
        self.tables = np.concatenate([_rice_table(k) for k in range(15)])

    def read(self, at: np.ndarray, width: int) -> np.ndarray:
        """Up to 24 bits from each position on."""
        return (self.words[at >> 3].astype(np.int64) >> 32 - width - (at & 7)) & (1 << width) - 1

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        value = self.read(at, width)
        return value - (value >> width - 1 << width)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unsigned values of a code at each position, and the positions after them."""
        entry = self.tables[k << 16 | (self.words[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & 0xFFFF)]
        value, after = (entry & 0xFFFF).astype(np.int64), at + (entry >> 16)
        for i in np.flatnonzero(entry == 0).tolist():  # a long run of zeros
            p, q, top = int(at[i]), 0, int(k[i])
            while not self.data[p >> 3] >> 7 - (p & 7) & 1:
                p, q = p + 1, q + 1
            low = int(self.read(np.array([p + 1]), top)[0]) if top else 0
            value[i], after[i] = q << top | low, p + 1 + top
        return value, after


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Samples (frames, 576) of frames at known places, with both checksums of each verified."""
    head = len(HEADER) + _utf8_size(number) + 1
    if (ends - starts < head + 4).any() or any((data[starts + i] != byte).any() for i, byte in enumerate(HEADER)):
        raise OtherForm("another frame header")
    if (crcs(data, starts, head - 1, 8, 0x07) != data[starts + head - 1]).any():
        raise FlacError("a frame header's checksum is wrong")
    if (crcs(data, starts, ends - starts - 2, 16, 0x8005) != data[ends - 2].astype(np.uint32) << 8 | data[ends - 1]).any():
        raise FlacError("a frame's checksum is wrong")
    bits = _Bits(data)
    kind = data[starts + head] >> 1
    out = np.empty((len(starts), BLOCK), np.int64)
    body = (starts + head + 1) * 8
    for code in np.unique(kind).tolist():
        own = np.flatnonzero(kind == code)
        at = body[own]
        if code == CONSTANT:
            out[own] = bits.signed(at, 8)[:, None]
        elif code == VERBATIM:
            out[own] = bits.signed(at[:, None] + 8 * np.arange(BLOCK), 8)
        elif FIXED <= code <= FIXED + 4 or code >= LPC:
            out[own] = _decode_subframes(bits, at, code)
        else:
            raise OtherForm("wasted bits, or a reserved subframe type")
    return out


def _decode_subframes(bits: _Bits, at: np.ndarray, code: int) -> np.ndarray:
    order = code - FIXED if code < LPC else code - LPC + 1
    warm = np.stack([bits.signed(at + 8 * j, 8) for j in range(order)]) if order else np.zeros((0, len(at)), np.int64)
    at = at + 8 * order
    if code >= LPC:
        precision, shift = bits.read(at, 4) + 1, bits.signed(at + 4, 5)
        if (precision != precision[0]).any():
            raise OtherForm("coefficients of differing precision")
        width = int(precision[0])
        coefs = np.stack([bits.signed(at + 9 + width * j, width) for j in range(order)])
        at = at + 9 + width * order
    else:
        #: The fixed predictors of the format.
        coefs = np.array([[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], np.int64)[:, None] if order else None
        shift = np.zeros(len(at), np.int64)
    method = bits.read(at, 6)
    if (method != PARTITION_ORDER).any():
        raise OtherForm("another coding method or partition order")
    at = at + 6
    residual = np.empty((BLOCK - order, len(at)), np.int64)
    t = 0
    for part in range(PARTS):
        k = bits.read(at, 4)
        if (k == 15).any():
            raise OtherForm("an escaped partition")
        at = at + 4
        for _ in range(PART - (order if part == 0 else 0)):
            residual[t], at = bits.rice(at, k)
            t += 1
    residual = residual >> 1 ^ -(residual & 1)
    return (_restored(residual, warm, coefs, shift) if order else residual).T


def blocks(data: bytes, info: Stream, first: int, stop: int) -> np.ndarray:
    """Stored bytes (frames, 576) of the frames from ``first`` up to ``stop`` of one stream that the fast path reads; no others are decoded."""
    starts = info.offsets[first:stop] + info.audio
    ends = np.append(info.offsets, len(data) - info.audio)[first + 1 : stop + 1] + info.audio
    return _stored(decode_frames(np.frombuffer(data, np.uint8), starts, ends, np.arange(first, stop)))


def _stored(samples: np.ndarray) -> np.ndarray:
    if (samples < -128).any() or (samples > 127).any():
        raise FlacError("samples of more than 8 bits")
    return samples.astype(np.int8).view(np.uint8) ^ 128


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream (frames, 576), as stored bytes; digests of the samples are verified. Streams of the fast path only."""
    if not streams:
        return []
    infos = [Stream(s) for s in streams]
    if any(i.offsets is None for i in infos):
        raise OtherForm("not one channel of 8 bits in blocks of 576, each with a seek point")
    begin = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
    data = np.frombuffer(b"".join(streams), np.uint8)
    starts = np.concatenate([i.offsets + b + i.audio for i, b in zip(infos, begin.tolist(), strict=False)])
    ends = np.append(starts[1:], begin[-1])
    sizes = np.array([len(i.offsets) for i in infos])
    first = np.concatenate(([0], np.cumsum(sizes)))
    ends[first[1:] - 1] = begin[1:]
    number = np.arange(len(starts)) - np.repeat(first[:-1], sizes)
    stored = _stored(decode_frames(data, starts, ends, number))
    out = []
    for info, a, b in zip(infos, first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hashlib.md5((stored[a:b] ^ 128).tobytes()).digest() != info.md5:
            raise FlacError("the digest of the samples is wrong")
        out.append(stored[a:b])
    return out
