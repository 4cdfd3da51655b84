"""The decoder against files of a plain encoder with other tables, sampling factors and restart intervals."""

import numpy as np
import pytest

from sparkloom.llm import jpeg

# codes made by rule: all DC categories with 4 bits, all AC symbols with 8 or 9 (canonical, no code of ones only)
DC = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
AC_SYMBOLS = [0x00, 0xF0, *[run << 4 | size for size in range(1, 11) for run in range(16)]]
AC = ([0] * 7 + [90, 72] + [0] * 7, AC_SYMBOLS)


def codes(table):
    out, code, k = {}, 0, 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            out[table[1][k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def magnitude(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def block_bits(block, before, dc, ac):
    size, bits = magnitude(int(block[0]) - before)
    out, run = dc[size] + bits, 0
    last = max(np.flatnonzero(block[1:]) + 1, default=0)
    for v in block[1 : last + 1]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        size, bits = magnitude(int(v))
        out, run = out + ac[run << 4 | size] + bits, 0
    return out + (ac[0] if last < 63 else "")


def made(width, height, sampling, restart, seed):
    """A file and its coefficients, blocks in scan order."""
    rng = np.random.default_rng(seed)
    high, wide = (max(s[k] for s in sampling) if len(sampling) > 1 else 1 for k in (1, 0))
    mcus = -(-width // (8 * wide)) * -(-height // (8 * high))
    order = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)] if len(sampling) > 1 else [0]
    coefs = np.where(rng.random((mcus * len(order), 64)) < 0.2, rng.integers(-300, 300, (mcus * len(order), 64)), 0)
    coefs[:: 5, 1:] = 0
    coefs[1:: 7, 63] = 9
    dc, ac, segments, bits, before = codes(DC), codes(AC), [], "", [0] * len(sampling)
    for m in range(mcus):
        if restart and m and m % restart == 0:
            segments.append(bits)
            bits, before = "", [0] * len(sampling)
        for b, c in enumerate(order):
            block = coefs[m * len(order) + b]
            bits += block_bits(block, before[c], dc, ac)
            before[c] = int(block[0])
    scan = b""
    for i, s in enumerate([*segments, bits]):
        s += "1" * (-len(s) % 8)
        scan += int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD0 + i % 8])
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    head = part(0xE0, b"JFIF\x00junk") + part(0xDB, b"\x00" + bytes(range(1, 65))) + part(0xC0, frame)
    head += part(0xC4, b"\x00" + bytes(DC[0]) + bytes(DC[1])) + part(0xC4, b"\x10" + bytes(AC[0]) + bytes(AC[1]))
    head += part(0xDD, restart.to_bytes(2, "big")) if restart else b""
    head += part(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\x00\x3f\x00")
    return b"\xff\xd8" + head + scan[:-2] + b"\xff\xd9", coefs


CASES = [(17, 9, [(1, 1)], 0), (40, 40, [(1, 1)] * 3, 0), (50, 33, [(2, 2), (1, 1), (1, 1)], 0), (50, 33, [(2, 1), (1, 1), (1, 1)], 3), (64, 8, [(1, 1)], 1), (200, 90, [(1, 2), (1, 1), (1, 1)], 11)]


def test_foreign_files():
    files = [made(*case, seed) for seed, case in enumerate(CASES)]
    parsed = [jpeg.parse(data) for data, _ in files]
    for case, p, (_, want), got in zip(CASES, parsed, files, jpeg.decode_scans(parsed), strict=True):
        assert (p.width, p.height, p.restart) == (case[0], case[1], case[3])
        assert (got == want).all()
        (h, v), (wide, high) = (case[2][0] if len(case[2]) > 1 else (1, 1)), p.mcus
        per = len(p.blocks)
        thumb = jpeg.thumbnail(p, got)
        assert thumb.shape == (high * v, wide * h)
        for y in range(high * v):
            for x in range(wide * h):
                at = (y // v * wide + x // h) * per + y % v * h + x % h
                assert thumb[y, x] == np.clip(np.rint(want[at, 0] / 8 + 128), 0, 255)


def test_broken_files():
    data, _ = made(40, 40, [(1, 1)] * 3, 2, 1)
    for broken in (b"", b"\x89PNG", data[:30], data.replace(b"\xff\xc0", b"\xff\xc2", 1), data.replace(b"\xff\xd1", b"", 1)):
        with pytest.raises(ValueError):
            jpeg.decode_scans([jpeg.parse(broken)])


def test_every_pixel_counts():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (61, 83), dtype=np.uint8)
    want = [[pixels[i * 61 // 8 : (i + 1) * 61 // 8, j * 83 // 9 : (j + 1) * 83 // 9].mean() for j in range(9)] for i in range(8)]
    assert np.allclose(jpeg.cell_means(pixels, 8, 9), want)
    assert jpeg.cell_means(pixels[:1, :1], 8, 9).shape == (8, 9)
    flat = np.full((80, 90), 100, np.uint8)
    changed = flat.copy()
    changed[::10, ::10] = 0  # away from the middle of every cell
    changed[40:] = 101
    assert jpeg.thumbnail_hashes(flat) != jpeg.thumbnail_hashes(changed)
