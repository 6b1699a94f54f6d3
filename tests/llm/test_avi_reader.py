"""The AVI and JPEG reader on files that the writer doesn't make, damaged ones included."""

import random
import struct
import time

import numpy as np
import pytest

from notegrain.llm import avi_mjpeg as avi


class Writer:
    """Bits, most significant first."""

    def __init__(self):
        self.bits = ""

    def put(self, value, size):
        self.bits += f"{value:0{size}b}" if size else ""

    def bytes(self):
        full = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(full[k : k + 8], 2) for k in range(0, len(full), 8)).replace(b"\xff", b"\xff\x00")


def codes(table):
    out, code, at = {}, 0, 0
    for length, count in enumerate(table.lengths, 1):
        for _ in range(count):
            out[table.symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def number(w, value):
    size = abs(value).bit_length()
    w.put(value if value >= 0 else value + (1 << size) - 1, size)
    return size


def test_standard_tables():
    tables = avi._standard_tables()
    assert all(sum(t.lengths) == len(t.symbols) == (162 if k >> 4 else 12) for k, t in tables.items())
    # codes that the standard prints
    assert codes(tables[0x00])[0] == (0b00, 2) and codes(tables[0x00])[5] == (0b110, 3) and codes(tables[0x00])[11] == (0b111111110, 9)
    assert codes(tables[0x10])[0x00] == (0b1010, 4) and codes(tables[0x10])[0xF0] == (0b11111111001, 11) and codes(tables[0x10])[0x01] == (0b00, 2) and codes(tables[0x10])[0xFA] == (0xFFFE, 16)
    assert codes(tables[0x11])[0x00] == (0b00, 2) and codes(tables[0x11])[0xF0] == (0b1111111010, 10) and codes(tables[0x01])[11] == (0b11111111110, 11)


def baseline(blocks, across, down, interval=0, quantiser=2):
    """A grey baseline frame without Huffman tables; blocks: 64 coefficients each, in zigzag order."""
    tables = avi._standard_tables()
    dc, ac = codes(tables[0x00]), codes(tables[0x10])
    parts, w, before = [], Writer(), 0
    for k, block in enumerate(blocks):
        if interval and k and k % interval == 0:
            parts.append(w.bytes())
            w, before = Writer(), 0
        diff = block[0] - before
        before = block[0]
        w.put(*dc[abs(diff).bit_length()])
        number(w, diff)
        run = 0
        last = max((i for i in range(1, 64) if block[i]), default=0)
        for value in block[1 : last + 1]:
            if not value:
                run += 1
                continue
            while run > 15:
                w.put(*ac[0xF0])
                run -= 16
            w.put(*ac[run << 4 | abs(value).bit_length()])
            number(w, value)
            run = 0
        if last < 63:
            w.put(*ac[0])
    parts.append(w.bytes())
    scan = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))
    head = b"\xff\xd8" + avi._segment(0xDB, b"\x00" + bytes([quantiser] * 64)) + avi._segment(0xC0, struct.pack(">BHHB", 8, down * 8 - 3, across * 8 - 1, 1) + b"\x01\x11\x00")
    head += avi._segment(0xDD, struct.pack(">H", interval)) if interval else b""
    return head + avi._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def inverse(block, quantiser):
    """A block's samples by the formula."""
    place = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    grid = np.zeros((8, 8))
    for k, value in enumerate(block):
        grid[divmod(place[k], 8)] = value * quantiser
    out = np.zeros((8, 8))
    c = lambda u: 1 / np.sqrt(2) if u == 0 else 1.0
    for y in range(8):
        for x in range(8):
            out[y, x] = sum(c(u) * c(v) * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
    return np.clip(np.rint(out + 128), 0, 255)


@pytest.mark.parametrize("interval", [0, 1, 4])
def test_baseline_without_tables(interval):
    rnd = random.Random(3)
    blocks = [[rnd.randrange(-60, 60), *(rnd.choice((0, 0, 0, 0, 0, 7, -3, 1)) if rnd.random() < 0.3 else 0 for _ in range(63))] for _ in range(6)]
    got = avi.decode_frame(baseline(blocks, 3, 2, interval))
    whole = np.block([[inverse(blocks[3 * y + x], 2) for x in range(3)] for y in range(2)])
    assert got.shape == (13, 23) and np.abs(got.astype(int) - whole[:13, :23]).max() <= 1


def lossless(samples, table, predictor, restart):
    """A lossless frame with any table, restarted after so many lines (0: never)."""
    height, width = samples.shape
    code, parts, w = codes(table), [], Writer()
    for y in range(height):
        first = not y or restart and y % restart == 0
        if restart and y and y % restart == 0:
            parts.append(w.bytes())
            w = Writer()
        for x in range(width):
            a, b, c = (int(samples[y, x - 1]) if x else 0), (int(samples[y - 1, x]) if y else 0), (int(samples[y - 1, x - 1]) if x and y else 0)
            guess = (a if x else 128) if first else b if not x else (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
            diff = int(samples[y, x]) - guess
            w.put(*code[abs(diff).bit_length()])
            number(w, diff)
    parts.append(w.bytes())
    scan = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))
    head = b"\xff\xd8" + avi._segment(0xC4, b"\x00" + table.lengths + table.symbols) + avi._segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
    head += avi._segment(0xDD, struct.pack(">H", restart * width)) if restart else b""
    return head + avi._segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_any_table_predictor_and_restart(predictor, restart):
    samples = np.random.default_rng(predictor).integers(0, 256, (7, 9)).astype(np.uint8)
    wide = avi._Huffman(bytes([0, 0, 0, 11, *[0] * 12]), bytes(range(11)))
    assert np.array_equal(avi.decode_frame(lossless(samples, wide, predictor, restart)), samples)
    square = np.random.default_rng(9).integers(0, 256, (8, 8)).astype(np.uint8)
    if predictor == 1 and not restart:
        assert avi.encode_frames(square[None])[0] == avi._head(8, 8) + avi.encode_frames(square[None])[0][len(avi._head(8, 8)) :]
        assert np.array_equal(avi.decode_frame(avi.encode_frames(square[None])[0]), square)


def test_reading_bits_is_linear():
    bits, began = avi._Bits(bytes(400_000)), time.perf_counter()
    for _ in range(400_000):
        bits.take(8)
    assert time.perf_counter() - began < 5
    with pytest.raises(ValueError):
        bits.take(1)


def test_odd_files():
    frame = baseline([[0] * 64] * 4, 2, 2)
    good = avi.write_avi([frame, frame], 15, 13)
    assert [(c.first, c.last) for c in avi.shots_of(good)] == [(0, 1)]
    deep = b"RIFF\0\0\0\0AVI " + b"LIST\xff\xff\xff\x7fabcd" * 5000 + good[12:]
    assert len(avi.shots_of(deep)) == 1
    for width, height in ((32767, 32768), (65535, 65535)):
        huge = avi._head(width, height) + b"\x00" * 50 + b"\xff\xd9"
        with pytest.raises(ValueError):
            avi.shots_of(avi.write_avi([huge], 32767, 32768))
    wide = baseline([[0] * 64], 1, 1).replace(struct.pack(">HH", 5, 7), struct.pack(">HH", 65535, 65535))
    with pytest.raises(ValueError):
        avi.decode_frame(wide)
    with pytest.raises(ValueError):
        avi.shots_of(avi.write_avi([frame, baseline([[0] * 64], 1, 1)], 15, 13))  # frames of two sizes
    assert avi.shots_of(avi.write_avi([], 8, 8)) == []


def test_damaged_files_fail_nothing(spark):
    rnd = random.Random(4)
    frame = baseline([[k * 9 - 20, *[1] * 5, *[0] * 58] for k in range(4)], 2, 2, interval=2)
    files = [avi.write_avi([frame] * 3, 15, 13), avi.store(bytes(range(256)) * 9)]
    rows = []
    for k in range(400):
        data = bytearray(rnd.choice(files))
        for _ in range(rnd.randrange(1, 6)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        rows.append((k, bytearray(data[: rnd.randrange(len(data))] if k % 3 == 0 else data)))
    rows += [(1000, None), (1001, bytearray()), (1002, bytearray(files[1])), (1002, bytearray(files[1])), (None, bytearray(files[0]))]
    media = spark.createDataFrame([(*r, "x") for r in rows], "id long, media binary, clip string")
    found = avi.clips(media).collect()
    assert {r.id for r in found} >= {1002, None} and not {1000, 1001} & {r.id for r in found}
    assert len([r for r in found if r.id == 1002]) == 2 * len(avi.shots_of(files[1]))


def test_features_by_plain_loops():
    rnd = random.Random(7)
    for n in (0, 100, 5000, 40_000):
        data = bytes(rnd.choice((0, 3, 200)) if k // 9000 % 2 else rnd.randrange(256) for k in range(n))
        back, frames, parsed = avi.restore(avi.store(data))
        assert back == data
        padded = data + b"\0" * (-len(data) % 1024)
        shares = []
        for k in range(0, len(padded), 1024):
            counts = [0] * avi.BINS
            for b in padded[k : k + 1024]:
                counts[b * avi.BINS // 256] += 1
            shares.append([c / 1024 for c in counts])
        changes = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(shares, shares[1:], strict=False)]
        cuts, own = [0], []
        for k, change in enumerate(changes, 1):
            mean = sum(own) / len(own) if own else 0.0
            deviation = max(sum(c * c for c in own) / len(own) - mean * mean, 0) ** 0.5 if own else 0.0
            if change > avi.LEAST_DIFFERENCE and (not own or change > mean + avi.SIGMAS * deviation + avi.LEAST_DIFFERENCE):
                cuts.append(k)
                own = []
            else:
                own.append(change)
        ends = [*cuts[1:], len(shares)] if shares else []
        shown = ",".join(f"{a}-{b - 1}@{a * 0.04:.2f}-{b * 0.04:.2f}" for a, b in zip(cuts, ends, strict=False))
        if n:
            mean = sum(padded) / len(padded)
            spread = (sum((b - mean) ** 2 for b in padded) / len(padded)) ** 0.5
            assert avi.describe(frames, parsed) == f"frames={len(shares)};mean={mean:.4f};deviation={spread:.4f};shots={len(ends)};clips={shown}"
