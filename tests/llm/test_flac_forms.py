"""FLAC streams of forms that the encoder doesn't write, made here a bit at a time and read back."""

import hashlib
import random

import numpy as np
import pytest

from simgate.llm import flac, flac_frames, flac_media

DRAW = random.Random(11)


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += format(value & (1 << width) - 1, f"0{width}b") if width else ""
        return self

    def rice(self, value, k):
        code = value << 1 if value >= 0 else (-value << 1) - 1
        self.text += "0" * (code >> k) + "1"
        return self.put(code, k)

    def bytes(self):
        text = self.text + "0" * (-len(self.text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")


def crc(data, width, poly):
    value = 0
    for byte in data:
        value ^= byte << width - 8
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> width - 1 else 0)) & (1 << width) - 1
    return value


def residuals(bits, values, order, size, method, partition_order, k):
    bits.put(method, 2).put(partition_order, 4)
    width, parts, at = 4 + method, 1 << partition_order, 0
    for part in range(parts):
        count = size // parts - (0 if part else order)
        own = values[at : at + count]
        if part % 3 == 2:  # escaped
            plain = max([0, *((x if x >= 0 else -x - 1).bit_length() + 1 for x in own)])
            bits.put((1 << width) - 1, width).put(plain, 5)
            for x in own:
                bits.put(x, plain)
        else:
            bits.put(k, width)
            for x in own:
                bits.rice(x, k)
        at += count


def subframe(bits, samples, width, kind, wasted=0, method=0, partition_order=0, k=3, coefs=None, shift=0):
    bits.put(0, 1).put(kind, 6).put(1 if wasted else 0, 1)
    if wasted:
        bits.put(1, wasted)
    x, width = [v >> wasted for v in samples], width - wasted
    if kind == 0:
        bits.put(x[0], width)
    elif kind == 1:
        for v in x:
            bits.put(v, width)
    else:
        order = kind - 8 if kind < 32 else kind - 31
        for v in x[:order]:
            bits.put(v, width)
        if kind >= 32:
            bits.put(9, 4).put(shift, 5)
            for c in coefs:
                bits.put(c, 10)
        else:
            coefs = [(-1) ** j * w for j, w in enumerate([[], [1], [2, 1], [3, 3, 1], [4, 6, 4, 1]][order])]
        left = [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coefs)) >> shift) for t in range(order, len(x))]
        residuals(bits, left, order, len(x), method, partition_order, k)


def frame(number, size, layout, bits_code, subframes):
    bits = Bits().put(0x7FFC, 15).put(0, 1).put(7, 4).put(0, 4).put(layout, 4).put(bits_code, 3).put(0, 1)
    bits.put(number, 8).put(size - 1, 16)  # numbers under 128 only
    bits.put(crc(bits.bytes(), 8, 0x07), 8)
    for args in subframes:
        subframe(bits, *args[:3], **args[3])
    whole = bits.bytes()
    return whole + crc(whole, 16, 0x8005).to_bytes(2, "big")


def stream(frames, block, channels, bits, samples, points=()):
    """points: numbers of frames that get a seek point."""
    total = len(samples)
    digest = hashlib.md5(flac_frames.signed_bytes(samples, bits)).digest()
    info = block.to_bytes(2, "big") * 2 + b"\0" * 6 + (8000 << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8, "big") + digest
    table = b"".join((p * block).to_bytes(8, "big") + sum(map(len, frames[:p])).to_bytes(8, "big") + block.to_bytes(2, "big") for p in points)
    metadata = b"\x00" + len(info).to_bytes(3, "big") + info + (b"\x03" + len(table).to_bytes(3, "big") + table if points else b"") + b"\x84\x00\x00\x02ok"
    return b"fLaC" + metadata + b"".join(frames)


def wave(n, most, step=3):
    out, x = [], 0
    for _ in range(n):
        x = max(-most, min(most - 1, x + DRAW.randint(-step, step)))
        out.append(x)
    return out


MONO = [
    (8, {"partition_order": 0}), (9, {"partition_order": 1}), (10, {"partition_order": 2}), (11, {"partition_order": 3, "method": 1}), (12, {"partition_order": 3, "k": 0}),
    (1, {}), (32 + 2, {"coefs": [300, -40, 7], "shift": 8, "partition_order": 2, "method": 1, "k": 2}), (32, {"coefs": [256], "shift": 8, "k": 14}),
]


@pytest.mark.parametrize("bits,code", [(8, 1), (16, 4), (12, 2), (24, 6), (8, 0)])
def test_mono_forms_partitions_escapes_and_predictors(bits, code):
    samples, made = [], []
    for number, (kind, more) in enumerate(MONO):
        x = wave(192 if number < len(MONO) - 1 else 40, 1 << bits - 1, 5)
        samples += x
        made.append(frame(number, len(x), 0, code, [(x, bits, kind, more)]))
    want = np.array(samples)[:, None]
    data = stream(made, 192, 1, bits, want, points=(0, 3, 5))
    info = flac.Stream(data)
    assert info.offsets is None and (info.channels, info.bits, info.total) == (1, bits, len(samples))
    found = flac_frames.whole(data, info)
    assert (np.concatenate([f.samples for f in found]) == want).all() and [f.first for f in found] == [192 * i for i in range(len(MONO))]
    some = flac_frames.frames(data, info, 192 * 4 + 1, 192 * 6)
    assert [f.first for f in some] == [192 * 4, 192 * 5]
    bare = stream(made, 192, 1, bits, want)
    assert [f.first for f in flac_frames.frames(bare, flac.Stream(bare), 192 * 6, None)] == [192 * 6, 192 * 7]
    for at in range(-len(made[-1]), 0, 7):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac_frames.whole(bytes(bad), info)
    with pytest.raises(flac.FlacError):
        flac_frames.whole(data[:-30], info)


@pytest.mark.parametrize("layout", [1, 8, 9, 10])
def test_stereo_forms_and_wasted_bits(layout):
    left, right = ([4 * v for v in wave(160, 1 << 12)] for _ in range(2))
    left[7] += 0 if layout != 10 else 4  # an odd difference of quarters
    mid, side = [a + b >> 1 for a, b in zip(left, right, strict=True)], [a - b for a, b in zip(left, right, strict=True)]
    parts = {1: (left, right), 8: (left, side), 9: (side, right), 10: (mid, side)}[layout]
    subframes = [(parts[c], 16 + (c == {8: 1, 9: 0, 10: 1}.get(layout)), 10, {"wasted": 1 if layout == 10 else 2, "partition_order": 1, "k": 4}) for c in range(2)]
    want = np.array([left, right]).T
    data = stream([frame(0, 160, layout, 0, subframes)], 160, 2, 16, want)
    assert (flac_frames.whole(data, flac.Stream(data))[0].samples == want).all()


def test_both_decoders_read_the_encoders_streams_alike():
    payload = flac_media.padded(bytes(DRAW.choice([0, 65, 66, 255]) for _ in range(5000)) + b"q" * 700)
    data = flac.encode([payload])[0]
    info = flac.Stream(data)
    assert b"".join(flac_frames.pcm(f.samples, f.bits) for f in flac_frames.whole(data, info)) == payload
    assert flac.blocks(data, info, 3, 5).tobytes() == payload[3 * 576 : 5 * 576]


def test_media_columns_of_other_encoders_and_ranges(spark):
    x = wave(576, 120)
    other = stream([frame(0, 576, 0, 1, [(x, 8, 9, {"partition_order": 5})])], 576, 1, 8, np.array(x)[:, None], points=(0,))
    stereo = stream([frame(0, 90, 1, 4, [(wave(90, 99), 16, 1, {}), ([5] * 90, 16, 0, {})])], 90, 2, 16, np.zeros((0, 2)))
    wide = np.array([[3, -4]] * 33)
    constant = stream([frame(0, 33, 1, 4, [([3] * 33, 16, 0, {}), ([-4] * 33, 16, 0, {})])], 33, 2, 16, wide)
    own = flac.encode([flac_media.padded(b"abc" * 2000)])[0]
    assert flac.Stream(other).offsets is not None  # looks like the fast path's until its frames are read
    df = spark.createDataFrame([(1, bytearray(other)), (2, bytearray(own)), (3, None), (4, bytearray(constant))], "doc_id long, media binary")
    rows = {}
    for r in flac_media.decode(df, blocks=2).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert bytes(rows[1][0].pcm) == bytes(v + 128 for v in x) and 3 not in rows
    assert (rows[4][0].channels, rows[4][0].bits, bytes(rows[4][0].pcm)) == (2, 16, wide.astype("<i2").tobytes())
    ranged = [r for r in flac_media.decode(df, blocks=2, first=1500, last=4000).collect() if r.doc_id == 2]
    assert sorted(ranged) == sorted(r for r in rows[2] if r.first_sample + r.n_samples > 1500 and r.first_sample < 4000)
    assert flac_media.decode(df, first=10**9).count() == 0
    sized = df.where("doc_id < 4").selectExpr("doc_id", "1L n_bytes", "media")
    got = {r.doc_id: r for r in flac_media.features(sized).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(bytes(v + 128 for v in x)).hexdigest() and got[3].payload_sha256 is None
    with pytest.raises(flac.FlacError):
        flac_frames.whole(stereo, flac.Stream(stereo))  # its digest is of no samples
