"""Baseline JPEG frames: flat-block encoding of bytes, and decoding."""

from __future__ import annotations

import struct

import numpy as np

#: Code lengths of the format's usual table for luminance DC, symbols 0 to 11. Fixed values.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: The only AC symbol of a flat block, end of block, in one bit.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])
#: Samples in a row of a frame, each a block of 8 by 8 equal pixels.
WIDTH = 64


def zigzag() -> np.ndarray:
    """Places in a block, in the order of the coefficients."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """``(code, bits, symbol)`` of a table."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, bits, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of a flat block by its difference plus 255."""
    table = {s: (c, b) for c, b, s in huffman(DC_COUNTS, DC_SYMBOLS)}
    code, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, b = table[size]
        low = d if d >= 0 else d + (1 << size) - 1
        code[d + 255], bits[d + 255] = (((c << size) | low) << 1), b + size + 1
    return code, bits


CODE, BITS = _encoder()


def header(rows: int) -> bytes:
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, b"\x00" + bytes([8] * 64)),
            segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
            segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
            segment(0xDD, struct.pack(">H", WIDTH)),
            segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def encode_rows(samples: np.ndarray, frame_rows: np.ndarray) -> list[bytes]:
    """Frames of rows of WIDTH samples; ``frame_rows`` has the rows of each. A restart interval is a row of blocks.

    A flat block of value v has the DC coefficient 8 * (v - 128), which a step of 8 keeps whole, so decoding gives back v.
    """
    total = int(frame_rows.sum())
    x = samples.reshape(total, WIDTH).astype(np.int64) - 128
    d = np.diff(x, axis=1, prepend=0) + 255
    code, bits = CODE[d], BITS[d]
    after = np.cumsum(bits, axis=1)
    used = after[:, -1]
    size = (used + 7) >> 3
    start = np.concatenate([[0], np.cumsum(size)])
    bit = (start[:-1, None] << 3) + after - bits
    at, word = (bit >> 3).ravel(), (code << (24 - (bit & 7) - bits)).ravel()
    out = np.zeros(start[-1] + 3)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(at + k, (word >> shift) & 255, len(out))
    data = out[: start[-1]].astype(np.uint8)
    data[start[1:] - 1] |= ((1 << ((size << 3) - used)) - 1).astype(np.uint8)
    # a zero after each 255, then a marker after each row
    full = np.flatnonzero(data == 255)
    stuffed = np.bincount(np.searchsorted(start, full, "right") - 1, minlength=total)
    data = np.insert(data, full + 1, 0)
    size = size + stuffed
    row_end = np.cumsum(size + 2)
    flat = np.empty(int(row_end[-1]), np.uint8)
    inside = np.ones(len(flat), bool)
    inside[row_end - 1] = inside[row_end - 2] = False
    flat[inside] = data
    last = np.cumsum(frame_rows) - 1
    number = np.arange(total) - np.repeat(last - frame_rows + 1, frame_rows)
    flat[row_end - 2] = 255
    flat[row_end - 1] = 0xD0 + number % 8
    flat[row_end[last] - 1] = 0xD9
    begin = np.concatenate([[0], row_end[last][:-1]])
    raw = flat.tobytes()
    heads = {int(n): header(int(n)) for n in set(frame_rows.tolist())}
    return [heads[int(n)] + raw[a:b] for n, a, b in zip(frame_rows, begin, row_end[last], strict=True)]


class Frame:
    """Segments of one JPEG image."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no image")
        self.quant, self.tables, self.interval, at = {}, {}, 0, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no segment")
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    wide, which = body[0] >> 4, body[0] & 15
                    n = 128 if wide else 64
                    self.quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif mark == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
        self.data = data[at:]

    @property
    def flat(self) -> bool:
        """Whether the image can hold flat blocks only, one component, and a row of blocks in each restart interval."""
        if len(self.parts) != 1 or self.width % 8 or self.height % 8 or self.interval != self.width // 8:
            return False
        return self.tables[0x10 | self.scan[self.parts[0][0]][1]] == (AC_COUNTS, AC_SYMBOLS)


def decode_flat(frames: list[Frame]) -> list[np.ndarray]:
    """Block values of flat images of equal width and tables, (rows, columns) each; all restart intervals at once."""
    dc = frames[0].tables[frames[0].scan[frames[0].parts[0][0]][0]]
    step = frames[0].quant[frames[0].parts[0][3]][0]
    columns = frames[0].width // 8
    window_d, window_n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for code, bits, size in huffman(*dc):
        free = 16 - bits - size - 1
        if free < 0:
            continue
        for low in range(1 << size):
            d = low if size == 0 or low >> (size - 1) else low - (1 << size) + 1
            first = ((code << size) | low) << (free + 1)
            window_d[first : first + (1 << free)], window_n[first : first + (1 << free)] = d, bits + size + 1
    data = np.frombuffer(b"".join(f.data for f in frames), np.uint8)
    mark = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0))
    end = mark.copy()
    begin = np.concatenate([[0], mark[:-1] + 2])
    rows = np.array([f.height // 8 for f in frames])
    if len(mark) != rows.sum():
        raise ValueError("restart intervals are missing")
    keep = np.ones(len(data), bool)
    keep[1:] &= ~((data[1:] == 0) & (data[:-1] == 255))
    place = np.concatenate([[0], np.cumsum(keep)])
    bit = place[begin].astype(np.int64) << 3
    limit = place[end].astype(np.int64) << 3
    clean = np.concatenate([data[keep], np.full(4, 255, np.uint8)]).astype(np.uint32)
    word = (clean[:-3] << np.uint32(24)) | (clean[1:-2] << np.uint32(16)) | (clean[2:-1] << np.uint32(8)) | clean[3:]
    out = np.empty((len(begin), columns), np.int32)
    value = np.zeros(len(begin), np.int32)
    for k in range(columns):
        w = (word[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(16)
        n = window_n[w]
        if not n.all():
            raise ValueError("no code")
        value = value + window_d[w]
        out[:, k] = value
        bit = bit + n
    if (bit > limit).any():
        raise ValueError("an interval ends early")
    samples = np.clip(out * step // 8 + 128, 0, 255).astype(np.uint8)
    return np.split(samples, np.cumsum(rows)[:-1])


def decode(frame: Frame) -> np.ndarray:
    """Luminance of any baseline image, (height, width)."""
    lut = {}
    for which, table in frame.tables.items():
        lut[which] = {(bits, code): symbol for code, bits, symbol in huffman(*table)}
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    order = zigzag()
    most_h, most_v = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    across, down = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
    if len(frame.parts) == 1:
        across, down, frame.parts = -(-frame.width // 8), -(-frame.height // 8), [(frame.parts[0][0], 1, 1, frame.parts[0][3])]
    plane = np.zeros((down * 8 * frame.parts[0][2], across * 8 * frame.parts[0][1]))
    pieces, at, data = [], 0, frame.data
    start = 0
    while at < len(data) - 1:
        if data[at] == 0xFF and data[at + 1] != 0:
            pieces.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at + 2
            if data[at + 1] == 0xD9:
                break
            at += 2
        else:
            at += 2 if data[at] == 0xFF else 1
    else:
        pieces.append(data[start:].replace(b"\xff\x00", b"\xff"))
    unit = 0
    for piece in pieces:
        bits, pos, n_bits = int.from_bytes(piece, "big"), 0, len(piece) * 8

        def take(n: int) -> int:
            nonlocal pos
            pos += n
            return (bits >> (n_bits - pos)) & ((1 << n) - 1) if n else 0

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no code")

        def signed(n: int) -> int:
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        last = [0] * len(frame.parts)
        for _ in range(frame.interval or across * down):
            if unit >= across * down:
                break
            for c, (name, h, v, q) in enumerate(frame.parts):
                dc, ac = frame.scan[name]
                for k in range(h * v):
                    block = np.zeros(64)
                    last[c] += signed(symbol(lut[dc]))
                    block[0] = last[c] * frame.quant[q][0]
                    i = 1
                    while i < 64:
                        s = symbol(lut[0x10 | ac])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[order[i]] = signed(s & 15) * frame.quant[q][i]
                        i += 1
                    if c == 0:
                        y, x = (unit // across * v + k // h) * 8, (unit % across * h + k % h) * 8
                        plane[y : y + 8, x : x + 8] = basis.T @ block.reshape(8, 8) @ basis + 128
            unit += 1
    return np.clip(np.rint(plane[: frame.height, : frame.width]), 0, 255).astype(np.uint8)
