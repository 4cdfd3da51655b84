"""Baseline JPEG in numpy: a payload codec, a marker parser, a Huffman scan decoder, DC thumbnails.

The payload of a document is stored in the format's own lossless unit, the quantised DCT
coefficient: byte b is the coefficient whose magnitude category is 8 and whose eight extra bits
are b. One 4:4:4 MCU has three blocks of 64 coefficients, hence 192 bytes; a restart marker
follows every MCU. The decoder takes any baseline file with one interleaved scan (all sampling
factors, restart intervals or none) and decodes many restart segments side by side; files with a scan
for each component are refused with a ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

UNIT = 192
MAX_SIDE = 8191  # MCUs; 65535 pixels

#: Huffman tables written by the encoder: symbols by code length; no code is all ones.
_DC_BITS, _DC_SYMBOLS = [1, 1] + [0] * 14, [8, 0]
_AC_BITS, _AC_SYMBOLS = [1, 1] + [0] * 14, [0x08, 0x00]
_PAD_MCU = np.packbits(np.array([1, 0, 1, 0] * 3 + [1] * 4, np.uint8)).tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(payload: bytes) -> bytes:
    """A baseline JPEG that holds payload, whose length is a positive multiple of 192."""
    n = len(payload) // UNIT
    wide = min(int(np.ceil(np.sqrt(n))), MAX_SIDE)
    high = -(-n // wide)
    if high > MAX_SIDE:
        raise ValueError("payload exceeds one JPEG frame")
    frame = b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\x03\x01\x11\x00\x02\x11\x00\x03\x11\x00"
    head = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % len(payload)) + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, frame)
    head += _segment(0xC4, b"\x00" + bytes(_DC_BITS) + bytes(_DC_SYMBOLS) + b"\x10" + bytes(_AC_BITS) + bytes(_AC_SYMBOLS))
    head += _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    data = np.frombuffer(payload, np.uint8)
    parts = []
    for at in range(0, n, 16384):  # bounds the memory of long payloads
        k = min(16384, n - at)
        bits = np.zeros((k * UNIT, 9), np.uint8)
        bits[:, 1:] = np.unpackbits(data[at * UNIT : (at + k) * UNIT].reshape(-1, 1), axis=1)
        coded = np.empty((k, UNIT * 9 // 8 + 2), np.uint8)
        coded[:, :-2] = np.packbits(bits.reshape(k, -1), axis=1)
        coded[:, -2] = 0
        coded[:, -1] = 0xD0 + (np.arange(at, at + k) % 8)
        flat = coded.reshape(-1)
        stuffed = np.insert(flat, np.flatnonzero(flat == 0xFF) + 1, 0)
        # the marker bytes go in after stuffing, where the placeholder 0 stands before D0..D7
        ends = np.cumsum((coded[:, :-2] == 0xFF).sum(axis=1) + coded.shape[1])
        stuffed[ends - 2] = 0xFF
        parts.append(stuffed.tobytes())
    parts += [_PAD_MCU + bytes([0xFF, 0xD0 + i % 8]) for i in range(n, wide * high)]
    return head + b"".join(parts)[:-2] + b"\xff\xd9"


@dataclass
class Component:
    ident: int
    h: int
    v: int
    tq: int
    dc: int = 0
    ac: int = 0


@dataclass
class Parsed:
    """What the markers of a file say; scan is its entropy-coded part."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    scan: np.ndarray | None = None

    @property
    def blocks(self) -> list[int]:
        """The component of each block of an MCU, in order."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.h * c.v)]

    @property
    def mcus(self) -> tuple[int, int]:
        single = len(self.components) == 1
        h = 1 if single else max(c.h for c in self.components)
        v = 1 if single else max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Parsed:
    """Read the markers up to the scan; ValueError on anything but baseline with one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out, at = Parsed(), 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                out.huffman[body[i] >> 4, body[i] & 15] = (counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = 2 if body[i] >> 4 else 1
                out.quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int32)
                i += 1 + 64 * wide
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            if body[0] != len(out.components):
                raise ValueError("one interleaved scan only")
            for i in range(body[0]):
                c = next(c for c in out.components if c.ident == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            out.scan = np.frombuffer(data, np.uint8, offset=at)
            return out


_TABLES: dict[tuple[bytes, bytes], np.ndarray] = {}


def huffman_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: code length << 8 | symbol; 0 where no code begins the window."""
    key = (bytes(counts), bytes(symbols))
    if key not in _TABLES:
        table, code, k = np.zeros(65536, np.int32), 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        _TABLES[key] = table
    return _TABLES[key]


def _segments(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where each restart segment starts in it."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    stop = ff[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    end = int(stop[0]) if len(stop) else len(scan)
    ff, after = ff[ff < end], after[ff < end]
    cut = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(end, bool)
    keep[np.concatenate([ff[after == 0] + 1, cut, cut + 1, ff[after == 0xFF]])] = False
    starts = np.concatenate([[0], cut + 2])
    position = np.concatenate([[0], np.cumsum(keep)])
    return scan[:end][keep], position[starts]


def decode_scans(files: list[Parsed]) -> list[np.ndarray]:
    """Quantised coefficients (blocks, 64) in zigzag order, blocks in scan order, of each file.

    Files with equal tables and layout share the steps: each restart segment is a lane, and
    every step takes one Huffman symbol from all lanes at once.
    """
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        key = tuple((c, f.huffman[0, f.components[c].dc], f.huffman[1, f.components[c].ac]) for c in f.blocks)
        groups.setdefault(key, []).append(i)
    out: list = [None] * len(files)
    for key, members in groups.items():
        tables = [(c, huffman_table(*dc), huffman_table(*ac)) for c, dc, ac in key]
        clean, starts, counts, bases, offset, base = [], [], [], [], 0, 0
        for i in members:
            f = files[i]
            data, first = _segments(f.scan)
            total = f.mcus[0] * f.mcus[1]
            each = f.restart or total
            if len(first) != -(-total // each):
                raise ValueError("restart markers do not match the frame")
            clean += [data, np.full(8, 0xFF, np.uint8)]
            starts.append(first + offset)
            mcu = np.full(len(first), each, np.int64)
            mcu[-1] = total - each * (len(first) - 1)
            counts.append(mcu)
            bases.append(base + np.concatenate([[0], np.cumsum(mcu)[:-1]]))
            offset += len(data) + 8
            base += total
        coefs = _lanes(np.concatenate(clean), np.concatenate(starts), np.concatenate(counts), np.concatenate(bases), base, tables)
        at = 0
        for i in members:
            n = files[i].mcus[0] * files[i].mcus[1]
            out[i] = coefs[at : at + n].reshape(-1, 64)
            at += n
    return out


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that size extra bits stand for."""
    half = (1 << size) >> 1
    return np.where(bits < half, bits - (1 << size) + 1, bits)


def _lanes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, bases: np.ndarray, mcus: int, tables: list) -> np.ndarray:
    wide = data.astype(np.uint32)
    words = np.zeros(len(data), np.uint32)
    words[:-3] = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    last = len(words) - 4

    def peek(at: np.ndarray) -> np.ndarray:
        """The 16 bits from bit position at."""
        return ((words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    coefs = np.zeros((mcus, len(tables), 64), np.int16)
    pos = starts.astype(np.int64) * 8
    pred = np.zeros((len(starts), max(c for c, _, _ in tables) + 1), np.int64)
    for mcu in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > mcu)
        row = bases[live] + mcu
        at = pos[live]
        for b, (c, dc, ac) in enumerate(tables):
            code = dc[peek(at)]
            if not code.all():
                raise ValueError("no such DC code")
            at = at + (code >> 8)
            size = (code & 255).astype(np.int64)
            pred[live, c] += _extend(peek(at) >> (16 - size), size)
            coefs[row, b, 0] = pred[live, c]
            at += size
            k = np.ones(len(live), np.int64)
            act = slice(None)
            while True:
                here, kk = at[act], k[act]
                code = ac[peek(here)]
                if not code.all():
                    raise ValueError("no such AC code")
                here = here + (code >> 8)
                size = (code & 15).astype(np.int64)
                kk = kk + ((code >> 4) & 15)
                value = _extend(peek(here) >> (16 - size), size)
                ends = (code & 255) == 0
                put = size > 0
                if put.all():
                    coefs[row[act], b, np.minimum(kk, 63)] = value
                else:
                    coefs[row[act][put], b, np.minimum(kk[put], 63)] = value[put]
                if (kk[put] > 63).any():
                    raise ValueError("coefficient index over 63")
                at[act] = here + size
                k[act] = np.where(ends, 64, kk + 1)
                if (k < 64).all():
                    continue
                act = np.flatnonzero(k < 64)
                if not len(act):
                    break
        pos[live] = at
    return coefs


def payload_of(parsed: Parsed, blocks: np.ndarray) -> bytes:
    """The payload that encode() stored, read from the coefficients."""
    n = int(parsed.comment.removeprefix(b"payload="))
    value = blocks.reshape(-1)[:n]
    return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()


def thumbnail(parsed: Parsed, blocks: np.ndarray) -> np.ndarray:
    """Luminance at one pixel a block, from the dequantised DC coefficients alone."""
    wide, high = parsed.mcus
    per, c = len(parsed.blocks), parsed.components[0]
    h, v = (1, 1) if len(parsed.components) == 1 else (c.h, c.v)
    dc = blocks[:, 0].reshape(high, wide, per)[:, :, : h * v].astype(np.float64) * parsed.quant[c.tq][0]
    grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    return np.clip(np.rint(grid / 8 + 128), 0, 255).astype(np.uint8)


def cell_means(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """The mean of each cell of a grid over all pixels; thumbnails with fewer pixels than cells repeat them."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    (top, low), (left, right) = ((at[:-1], np.maximum(at[1:], at[:-1] + 1)) for at in (np.arange(n + 1) * size // n for n, size in ((rows, pixels.shape[0]), (cols, pixels.shape[1]))))
    sums = total[np.ix_(low, right)] - total[np.ix_(top, right)] - total[np.ix_(low, left)] + total[np.ix_(top, left)]
    return sums / np.outer(low - top, right - left)


def thumbnail_hashes(pixels: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash (64 bits each); every pixel of the thumbnail counts."""
    square, wide = cell_means(pixels, 8, 8), cell_means(pixels, 8, 9)
    bits = (square > square.mean(), wide[:, 1:] > wide[:, :-1])
    return tuple(int.from_bytes(np.packbits(x).tobytes(), "big") for x in bits)
