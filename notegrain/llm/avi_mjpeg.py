"""AVI motion-JPEG columns: RIFF parsing, intra-frame decoding and shot detection.

Reading: the RIFF tree is walked without recursion, frames come from the ``idx1`` index (from the ``movi`` list where
there is none), and each frame is decoded by itself. Frames may be lossless JPEG (SOF3, any predictor, any Huffman table) or
baseline (SOF0, the usual motion-JPEG, its luma; the standard's Huffman tables where the frame brings none), with restart
intervals or without. Pictures that claim more samples than their scan has bits for are refused before any memory is
taken for them. Frames become histograms a few at a time. Shots: a frame whose histogram differs from the one before by more than the running
mean plus SIGMAS deviations of the differences in its shot starts a new shot; each shot is a clip with start and end time.

Writing: bytes become 8-bit grey samples of WIDTH x HEIGHT frames in lossless JPEG, predictor 1 (left neighbour).
Differences run from -255 to 255, in categories 0 to 8 with as many extra bits; category s has a Huffman code of 9 - s
bits. So each sample takes nine bits, all bytes are recovered exactly, and the writer's and reader's bit work is numpy.
(Huffman tables of other shapes take the reader's slow path, bit by bit.) A LIST INFO chunk names the payload's length, as
the last frame is filled up with zeros.

Defined results: null and empty texts have a payload of 64 zero bytes; equal texts give equal files and features;
repeated rows are judged alike; an empty table gives an empty table; long texts become more frames, one text at a time. A
file that is null, damaged, of another kind, or of frames that aren't all of one size has no clips and fails nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrain.llm._common import id_and_text, pieces, table

WIDTH, HEIGHT = 32, 32
FRAMES_PER_SECOND = 25
SIGMAS, LEAST_DIFFERENCE, BINS = 3.0, 0.10, 16
_BITS = 9
#: Frames that are decoded at a time.
_FRAMES_AT_ONCE = 256
#: The JPEG standard's Huffman tables for frames without their own: codes of each length, and the symbols' beginning;
#: the other symbols (runs of 0 to 15 zeros with sizes of 1 to 10) follow in ascending order. Class and number of the table first.
_STANDARD = {
    0x00: ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def _category(difference: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(difference) + 1)).astype(np.int64)


def _nine_bit_codes() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit symbol of each difference (index + 255), and difference of each symbol.

    The shortest code belongs to category 8; canonical codes of lengths 1, 2, ... are 0, 10, 110, ...
    """
    differences = np.arange(-255, 256)
    size = _category(differences)
    code = (1 << (_BITS - size)) - 2  # 1...10 in 9 - size bits
    extra = np.where(differences < 0, differences + (1 << size) - 1, differences)
    symbols = (code << size) | extra
    back = np.zeros(512, np.int16)
    back[symbols] = differences
    return symbols.astype(np.uint16), back


_SYMBOLS, _DIFFERENCES = _nine_bit_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    """Everything of a frame before its scan: lossless, 8 bits, one component, predictor 1."""
    lengths = bytes([1] * 9 + [0] * 7)
    table_ = _segment(0xC4, b"\x00" + lengths + bytes(range(8, -1, -1)))
    frame = _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + table_ + frame + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEGs of (frames, height, width) bytes; width * height must be a multiple of 8."""
    n, height, width = samples.shape
    wide = samples.astype(np.int16)
    difference = np.empty_like(wide)
    difference[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    difference[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    difference[:, 0, 0] = wide[:, 0, 0] - 128
    groups = _SYMBOLS[difference.reshape(n, height * width // 8, 8) + 255]
    packed = np.zeros((n, groups.shape[1], 9), np.uint16)
    for j in range(9):  # byte j of nine ends symbol j-1 and begins symbol j
        if j:
            packed[:, :, j] |= (groups[:, :, j - 1] << (8 - j)) & 0xFF
        if j < 8:
            packed[:, :, j] |= groups[:, :, j] >> (j + 1)
    scans = packed.astype(np.uint8).reshape(n, height * width * 9 // 8)
    head = _head(width, height)
    return [head + scan.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for scan in scans]


class _Huffman(NamedTuple):
    """A table: codes of each length, and the symbols in order."""

    lengths: bytes
    symbols: bytes


@cache
def _lookup(table_: _Huffman) -> list[int]:
    """For every 16 bits: length of the code they begin with, times 256, plus its symbol; 0 where there is none."""
    out = np.zeros(1 << 16, np.int64)
    code = at = 0
    for length, count in enumerate(table_.lengths, 1):
        for _ in range(count):
            if at >= len(table_.symbols) or code >> length:
                raise ValueError("a Huffman table that doesn't add up")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table_.symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


@cache
def _standard_tables() -> dict[int, _Huffman]:
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for name, (lengths, head) in _STANDARD.items():
        first = list(bytes.fromhex(head))
        rest = sorted(set(every) - set(first)) if name >> 4 else []
        out[name] = _Huffman(bytes.fromhex(lengths), bytes(first + rest))
    return out


_FAST = _Huffman(bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))


class _Bits:
    """A scan's bits, read a few at a time; each byte is touched once."""

    def __init__(self, scan: bytes):
        self.scan, self.at = scan, 0
        self.value = self.held = 0

    def _hold(self, n: int) -> None:
        while self.held < n:
            more = self.scan[self.at : self.at + 8]
            self.at += 8
            # past the end there are zeros; taking them is an error
            self.value = self.value << 64 | int.from_bytes(more.ljust(8, b"\0"), "big")
            self.held += 64

    def take(self, n: int) -> int:
        self._hold(n)
        self.held -= n
        out = self.value >> self.held
        self.value &= (1 << self.held) - 1
        if self.at * 8 - self.held > len(self.scan) * 8:
            raise ValueError("the scan ends early")
        return out

    def symbol(self, table_: list[int]) -> int:
        self._hold(16)
        found = table_[self.value >> (self.held - 16)]
        if not found:
            raise ValueError("no such code")
        self.take(found >> 8)
        return found & 255

    def number(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Jpeg(NamedTuple):
    """A parsed frame."""

    marker: int
    height: int
    width: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    tables: dict[int, _Huffman]
    quantisers: dict[int, list[int]]
    scan_components: list[tuple[int, int]]  # id, Huffman tables
    predictor: int
    interval: int  # units between restarts, 0: none
    scans: list[bytes]  # between restarts, without stuffing


def parse_jpeg(data: bytes) -> Jpeg:
    """Markers up to the first scan, and the scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quantisers, frame, interval = 2, dict(_standard_tables()), {}, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        if data[at + 1] == 0xFF:  # filling
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = _Huffman(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = list(struct.unpack(">64H", body[1:129]) if wide else struct.unpack("64B", body[1:65]))
                body = body[129 if wide else 65 :]
        elif marker in (0xC0, 0xC1, 0xC3):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width or not n:
                raise ValueError("not a picture of 8 bits")
            frame = marker, height, width, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            parts = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            return Jpeg(*frame, tables, quantisers, parts, body[1 + 2 * body[0]], interval, _scans(data, at))
    raise ValueError("no scan")


def _scans(data: bytes, at: int) -> list[bytes]:
    """A scan's parts between restart markers, up to the next other marker."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            at = len(data)
        elif data[at + 1] == 0:
            at += 2
            continue
        out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
        if at + 1 >= len(data) or not 0xD0 <= data[at + 1] <= 0xD7:
            return out
        at = start = at + 2


def _bits_of(jpeg: Jpeg) -> int:
    return 8 * sum(map(len, jpeg.scans))


def _lossless(jpeg: Jpeg) -> np.ndarray:
    table_ = jpeg.tables[jpeg.scan_components[0][1] >> 4]
    n, width = jpeg.height * jpeg.width, jpeg.width
    if len(jpeg.scan_components) > 1 or n > _bits_of(jpeg):
        raise ValueError("more samples than bits")
    if table_ == _FAST and jpeg.predictor == 1 and n % 8 == 0 and len(jpeg.scans) == 1 and 8 * len(jpeg.scans[0]) >= 9 * n:
        return decode_scans(jpeg.scans, jpeg.height, width)[0]
    if jpeg.interval % width:
        raise ValueError("a restart within a line")
    lookup, lines = _lookup(table_), jpeg.interval // width or jpeg.height
    out: list[list[int]] = []
    for y in range(jpeg.height):
        if y % lines == 0:
            if y // lines >= len(jpeg.scans):
                raise ValueError("the scan ends early")
            bits = _Bits(jpeg.scans[y // lines])
        line: list[int] = []
        above = out[-1] if y % lines else None
        for x in range(width):
            if above is None:  # a first line has no line above
                guess = line[x - 1] if x else 128
            elif not x:
                guess = above[0]
            else:
                a, b, c = line[x - 1], above[x], above[x - 1]
                guess = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[jpeg.predictor]
            line.append((guess + bits.number(bits.symbol(lookup))) & 0xFFFF)
        out.append(line)
    return np.array(out).astype(np.uint8)


def decode_scans(scans: list[bytes], height: int, width: int) -> np.ndarray:
    """Frames of nine-bit scans, all at once."""
    need = height * width * 9 // 8
    if any(len(s) < need for s in scans):
        raise ValueError("the scan ends early")
    raw = np.frombuffer(b"".join([s[:need] for s in scans]), np.uint8).reshape(len(scans), need // 9, 9).astype(np.uint16)
    symbols = np.empty((*raw.shape[:2], 8), np.uint16)
    for k in range(8):
        symbols[:, :, k] = ((raw[:, :, k] << 8 | raw[:, :, k + 1]) >> (7 - k)) & 0x1FF
    difference = _DIFFERENCES[symbols].reshape(len(scans), height, width).astype(np.int32)
    difference[:, 0, 0] += 128
    difference[:, :, 0] = np.cumsum(difference[:, :, 0], axis=1)
    return np.cumsum(difference, axis=2).astype(np.uint8)


def _zigzag() -> list[int]:
    """Places of a block's coefficients in the order in which they are coded."""
    return sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


def _baseline(jpeg: Jpeg) -> np.ndarray:
    """Luma (the first component) of a sequential DCT frame."""
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5 / np.sqrt(2)) for u in range(8)] for x in range(8)])
    order, tables = _zigzag(), dict(jpeg.scan_components)
    first = jpeg.components[0]
    most_h, most_v = max(c[1] for c in jpeg.components), max(c[2] for c in jpeg.components)
    if first[0] not in tables or (first[1], first[2]) != (most_h, most_v) or not most_h * most_v:
        raise ValueError("no luma of full size in the first scan")
    parts = [(c if len(tables) > 1 else (c[0], 1, 1, c[3])) for c in jpeg.components if c[0] in tables]
    step_h, step_v = (most_h, most_v) if len(tables) > 1 else (1, 1)
    across, down = -(-jpeg.width // (8 * step_h)), -(-jpeg.height // (8 * step_v))
    if 2 * across * down > _bits_of(jpeg):  # a block takes two codes at least
        raise ValueError("more blocks than bits")
    coded = [(name, h, v, jpeg.quantisers[q], _lookup(jpeg.tables[tables[name] >> 4]), _lookup(jpeg.tables[16 + (tables[name] & 15)])) for name, h, v, q in parts]
    blocks = np.zeros((down * step_v, across * step_h, 64))
    interval = jpeg.interval or across * down
    for unit in range(across * down):
        if unit % interval == 0:
            if unit // interval >= len(jpeg.scans):
                raise ValueError("the scan ends early")
            bits, previous = _Bits(jpeg.scans[unit // interval]), dict.fromkeys(tables, 0)
        for name, h, v, quantiser, dc, ac in coded:
            for block in range(h * v):
                previous[name] += bits.number(bits.symbol(dc))
                coefficients = blocks[unit // across * v + block // h, unit % across * h + block % h] if name == first[0] else None
                if coefficients is not None:
                    coefficients[0] = previous[name] * quantiser[0]
                k = 1
                while k < 64:
                    symbol = bits.symbol(ac)
                    if symbol == 0:
                        break
                    k += symbol >> 4
                    value = bits.number(symbol & 15)
                    if k > 63:
                        raise ValueError("a block of more than 64 coefficients")
                    if coefficients is not None:
                        coefficients[order[k]] = value * quantiser[k]
                    k += 1
    samples = basis @ blocks.reshape(*blocks.shape[:2], 8, 8) @ basis.T
    out = samples.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: jpeg.height, : jpeg.width]


def decode_frame(data: bytes) -> np.ndarray:
    """Grey samples of one JPEG."""
    jpeg = parse_jpeg(data)
    return _lossless(jpeg) if jpeg.marker == 0xC3 else _baseline(jpeg)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def write_avi(frames: list[bytes], width: int, height: int, rate: int = FRAMES_PER_SECOND, payload: int | None = None) -> bytes:
    """An AVI of JPEG frames with an idx1 index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture)))
    info = b"" if payload is None else _list(b"INFO", _chunk(b"ICMT", b"payload=%d\x00" % payload))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    body = headers + info + _list(b"movi", *[_chunk(b"00dc", f) for f in frames]) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


class Avi(NamedTuple):
    """What a reader needs of an AVI."""

    microseconds: int
    width: int
    height: int
    frames: list[bytes]
    comment: bytes


def read_avi(data: bytes) -> Avi:
    """Walk the RIFF tree; frames by idx1, else in the order of the movi list. What lies past the file's end is not there."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    found: dict[str, bytes] = {}
    listed: list[tuple[int, int]] = []
    index: list[tuple[int, int]] = []
    movi, at = 0, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"LIST":  # its parts follow, one after another, and then what follows the list
            if data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            at += 12
            continue
        if name[2:] in (b"dc", b"db"):
            listed.append((at + 8, size))
        elif name == b"idx1":
            whole = data[at + 8 : at + 8 + size]
            entries = struct.iter_unpack("<4sIII", whole[: len(whole) - len(whole) % 16])
            index.extend((offset, length) for kind, _, offset, length in entries if kind[2:] in (b"dc", b"db"))
        else:
            found.setdefault(name.decode("latin-1"), data[at + 8 : at + 8 + min(size, 1 << 16)])
        at += 8 + size + size % 2
    # offsets count from the movi list's name, or in some files from the start of the file
    base = movi if index and data[movi + index[0][0] + 2 : movi + index[0][0] + 4] in (b"dc", b"db") else 0
    spans = [(base + offset + 8, length) for offset, length in index] or listed
    main = struct.unpack("<14I", found["avih"][:56])
    # frames of no bytes repeat the one before and are passed over
    return Avi(main[0], main[8], main[9], [data[a : a + n] for a, n in spans if n], found.get("ICMT", b"").rstrip(b"\x00"))


def decode_frames(avi: Avi, start: int = 0, count: int | None = None) -> np.ndarray:
    """Frames from start on; those with the writer's header at once, others one by one."""
    chosen = avi.frames[start : None if count is None else start + count]
    if not chosen:
        return np.zeros((0, 0, 0), np.uint8)
    if avi.width * avi.height % 8 == 0 and 0 < avi.width <= 0xFFFF and 0 < avi.height <= 0xFFFF:
        head = _head(avi.width, avi.height)
        if all(f.startswith(head) for f in chosen):
            return decode_scans([f[len(head) : -2].replace(b"\xff\x00", b"\xff") for f in chosen], avi.height, avi.width)
    return np.stack([decode_frame(f) for f in chosen])


class Clip(NamedTuple):
    """A shot: frames first to last, and its times in seconds."""

    first: int
    last: int
    start: float
    end: float


def histograms(frames: np.ndarray) -> np.ndarray:
    """Share of each frame's samples in each bin."""
    n = len(frames)
    if not n:
        return np.zeros((0, BINS))
    flat = frames.reshape(n, -1).astype(np.int64) * BINS // 256 + np.arange(n)[:, None] * BINS
    return np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / frames[0].size


def find_shots(shares: np.ndarray, microseconds: int) -> list[Clip]:
    """Cut where a frame's histogram changes by more than stands out against the shot's own changes so far."""
    n = len(shares)
    if not n:
        return []
    changes = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    cuts, count, mean, square = [0], 0, 0.0, 0.0
    for k, change in enumerate(changes.tolist(), 1):
        deviation = (max(square / count - mean * mean, 0.0)) ** 0.5 if count else 0.0
        if change > LEAST_DIFFERENCE and (count == 0 or change > mean + SIGMAS * deviation + LEAST_DIFFERENCE):
            cuts.append(k)
            count, mean, square = 0, 0.0, 0.0
            continue
        count, square = count + 1, square + change * change
        mean += (change - mean) / count
    seconds = microseconds / 1e6
    return [Clip(a, b - 1, a * seconds, b * seconds) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def shots_of(media: bytes) -> list[Clip]:
    """The shots of an AVI; its frames are decoded a few at a time."""
    avi = read_avi(media)
    shares, shapes = [], set()
    for start in range(0, len(avi.frames), _FRAMES_AT_ONCE):
        frames = decode_frames(avi, start, _FRAMES_AT_ONCE)
        shapes.add(frames.shape[1:])
        shares.append(histograms(frames))
    if len(shapes) > 1:
        raise ValueError("frames of several sizes")
    return find_shots(np.concatenate(shares), avi.microseconds) if shares else []


def store(data: bytes) -> bytes:
    """An AVI that holds the bytes as samples."""
    each = WIDTH * HEIGHT
    full = np.frombuffer(data + b"\x00" * (-len(data) % each), np.uint8).reshape(-1, HEIGHT, WIDTH)
    return write_avi(encode_frames(full), WIDTH, HEIGHT, payload=len(data))


def restore(media: bytes) -> tuple[bytes, np.ndarray, Avi]:
    """The bytes an AVI holds, its frames, and its parts."""
    avi = read_avi(media)
    frames = decode_frames(avi)
    return frames.tobytes()[: int(avi.comment.removeprefix(b"payload="))], frames, avi


def describe(frames: np.ndarray, avi: Avi) -> str:
    """frames, mean and spread of samples, and the shots' last frames and times."""
    clips = find_shots(histograms(frames), avi.microseconds)
    shown = ",".join(f"{c.first}-{c.last}@{c.start:.2f}-{c.end:.2f}" for c in clips)
    return f"frames={len(frames)};mean={frames.mean():.4f};deviation={frames.std():.4f};shots={len(clips)};clips={shown}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of a text in UTF-8, and its bytes filled up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\x00" * (max(64, -(-len(data) // 64) * 64) - len(data))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_shots of each row."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    kinds += [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text in batch.column(1):
                n, payload = payload_of(text.as_py())
                media = store(payload)
                back, frames, avi = restore(media)
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(frames, avi)))
            columns = list(zip(*out, strict=True)) or [[]] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, (_, k) in zip(columns, kinds[1:], strict=True)]], [name for name, _ in kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return id_and_text(docs).mapInArrow(run, schema)


def clips(media: DataFrame) -> DataFrame:
    """id, media (binary) -> id, clip, first_frame, last_frame, start_s, end_s; a null or damaged file has no clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    shots = shots_of(data or b"")
                except (ValueError, KeyError, IndexError, struct.error):
                    shots = []
                rows += [(name, k, *c) for k, c in enumerate(shots)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    parts = media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media"))
    return parts.mapInArrow(run, "id long, clip int, first_frame int, last_frame int, start_s double, end_s double")


def op8_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_columns of the whole documents table; see the module for nulls, repeated rows and empty tables."""
    return media_columns(table(spark, sf_dir, "documents"))
