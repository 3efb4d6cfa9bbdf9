"""PNG, GIF and QOI in pure Python on (c, h, w) arrays in [0, 1].

Written values are cut off to bytes; one channel is repeated for all three.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..schema import UnsupportedFormat


def to_rgb8(a: np.ndarray) -> np.ndarray:
    """(h, w, 3) bytes."""
    a = a[[0, 0, 0]] if len(a) == 1 else a[[0, 1, 0]] if len(a) == 2 else a[:3]
    return (np.clip(a, 0, 1) * 255).astype(np.uint8).transpose(1, 2, 0)


def from_rgb8(rgb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rgb[..., :3].transpose(2, 0, 1)) / 255.0


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(a: np.ndarray) -> bytes:
    rgb = to_rgb8(a)
    h, w, _ = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfilter(raw: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    out, prev = np.zeros((h, stride), np.uint8), np.zeros(stride, np.int32)
    for y in range(h):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int32)
        if kind == 2:
            line = (line + prev) & 255
        elif kind in (1, 3, 4):
            for x in range(stride):
                left = line[x - bpp] if x >= bpp else 0
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + prev[x]) // 2
                else:
                    corner = prev[x - bpp] if x >= bpp else 0
                    p = left + prev[x] - corner
                    pa, pb, pc = abs(p - left), abs(p - prev[x]), abs(p - corner)
                    add = left if pa <= pb and pa <= pc else prev[x] if pb <= pc else corner
                line[x] = (line[x] + add) & 255
        out[y] = line
        prev = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """8-bit gray, gray-alpha, palette, RGB and RGBA, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise UnsupportedFormat("not a PNG")
    at, idat, palette, head = 8, b"", None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    w, h, depth, color, _, _, interlaced = head
    bpp = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlaced or bpp is None:
        raise UnsupportedFormat("only 8-bit PNG without interlacing")
    px = _unfilter(zlib.decompress(idat), h, w * bpp, bpp).reshape(h, w, bpp)
    rgb = palette[px[..., 0]] if color == 3 else np.repeat(px[..., :1], 3, 2) if color in (0, 4) else px[..., :3]
    return from_rgb8(rgb)


def _png_chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def read_apng(data: bytes) -> list[tuple[np.ndarray, int]]:
    """(frame, delay in ms) of each frame of an animated PNG; a plain PNG is one frame of no delay.

    Each frame's data is read as a PNG of the frame's size and drawn over its predecessors.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise UnsupportedFormat("not a PNG")
    parts = list(_png_chunks(data))
    if not any(kind == b"acTL" for kind, _ in parts):
        return [(read_png(data), 0)]
    head = parts[0][1]
    shared = [(k, v) for k, v in parts if k in (b"PLTE", b"tRNS")]
    frames: list[tuple[tuple, list[bytes]]] = []
    for kind, body in parts:
        if kind == b"fcTL":
            frames.append((struct.unpack(">IIIIHHBB", body[4:26]), []))
        elif kind == b"IDAT" and frames:  # a still that is no part of the animation comes before the first frame
            frames[-1][1].append(body)
        elif kind == b"fdAT":
            frames[-1][1].append(body[4:])
    w, h = struct.unpack(">II", head[:8])
    canvas, out = np.zeros((3, h, w)), []
    for (fw, fh, x, y, num, den, dispose, _), bodies in frames:
        file = data[:8] + _chunk(b"IHDR", struct.pack(">II", fw, fh) + head[8:]) + b"".join(_chunk(k, v) for k, v in shared) + _chunk(b"IDAT", b"".join(bodies)) + _chunk(b"IEND", b"")
        before = canvas.copy()
        canvas[:, y : y + fh, x : x + fw] = read_png(file)
        out.append((canvas.copy(), round(1000 * num / (den or 100))))
        if dispose == 1:
            canvas[:, y : y + fh, x : x + fw] = 0
        elif dispose == 2:
            canvas = before
    return out


# --- GIF -------------------------------------------------------------------------------


def _cube(rgb: np.ndarray) -> np.ndarray:
    """Index in a palette of 6 x 7 x 6 levels."""
    r, g, b = (np.floor(rgb[..., k] / 255 * n + 0.5).astype(int) for k, n in ((0, 5), (1, 6), (2, 5)))
    return (r * 7 + g) * 6 + b


def _palette() -> bytes:
    out = bytearray(b for r in range(6) for g in range(7) for v in range(6) for b in (r * 255 // 5, g * 255 // 6, v * 255 // 5))
    return bytes(out.ljust(768, b"\0"))


def _lzw(index: np.ndarray) -> bytes:
    codes: dict[tuple[int, int], int] = {}
    size, nxt, out, acc, bits = 9, 258, bytearray(), 256, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc |= code << bits
        bits += size
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    prefix = int(index[0])
    for v in index[1:].tolist():
        code = codes.get((prefix, v))
        if code is not None:
            prefix = code
            continue
        put(prefix)
        if nxt < 4096:
            codes[prefix, v] = nxt
            if nxt == 1 << size and size < 12:
                size += 1
            nxt += 1
        else:
            put(256)
            codes.clear()
            size, nxt = 9, 258
        prefix = v
    put(prefix)
    if nxt == 1 << size and size < 12:
        size += 1
    put(257)
    out.append(acc & 255)
    return bytes(out)


GIF_END = b"\x3b"


def gif_head(a: np.ndarray, loops: int = 0) -> bytes:
    """What comes before the frames, all of the size of ``a``."""
    h, w = a.shape[1:]
    return b"".join([b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), _palette(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01", struct.pack("<HB", loops, 0)])


def gif_frame(a: np.ndarray, ms: int) -> bytes:
    body = _lzw(_cube(to_rgb8(a)).ravel())
    out = [b"\x21\xf9\x04\x00", struct.pack("<H", max(0, ms // 10)), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, a.shape[2], a.shape[1], 0), b"\x08"]
    return b"".join(out + [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)] + [b"\0"])


def write_gif(frames: list[np.ndarray], delays_ms: list[int], loops: int = 0) -> bytes:
    """An animation; ``loops`` 0 repeats for ever. Colours are rounded to 252 levels."""
    return gif_head(frames[0], loops) + b"".join(gif_frame(a, ms) for a, ms in zip(frames, delays_ms, strict=True)) + GIF_END


def _unlzw(body: bytes, least: int, n: int) -> np.ndarray:
    clear, end = 1 << least, (1 << least) + 1
    out, table, size, acc, bits, prev = bytearray(), [], least + 1, 0, 0, b""
    for byte in body:
        acc |= byte << bits
        bits += 8
        while bits >= size:
            code = acc & ((1 << size) - 1)
            acc >>= size
            bits -= size
            if code == clear:
                table, size, prev = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == end or len(out) >= n:
                return np.frombuffer(bytes(out), np.uint8)
            entry = table[code] if code < len(table) else prev + prev[:1]
            out += entry
            if prev and len(table) < 4096:
                table.append(prev + entry[:1])
            prev = entry
            if len(table) == 1 << size and size < 12:
                size += 1
    return np.frombuffer(bytes(out), np.uint8)


def read_gif(data: bytes) -> list[tuple[np.ndarray, int]]:
    """(frame, delay in ms) of each image; frames are drawn over their predecessors."""
    if data[:3] != b"GIF":
        raise UnsupportedFormat("not a GIF")
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at, glob = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        glob, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas, out, delay, clear = np.zeros((h, w, 3), np.uint8), [], 100, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind, at = data[at + 1], at + 2
            if kind == 0xF9:
                delay = struct.unpack("<H", data[at + 2 : at + 4])[0] * 10
                clear = data[at + 4] if data[at + 1] & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        x, y, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, colors = at + 10, glob
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            colors, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        least, body, at = data[at], bytearray(), at + 1
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        index = np.zeros(fw * fh, np.uint8)
        got = _unlzw(bytes(body), least, fw * fh)[: fw * fh]
        index[: len(got)] = got
        index = index.reshape(fh, fw)
        if flags & 0x40:
            rows = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
            plain = np.empty_like(index)
            plain[rows] = index
            index = plain
        part = canvas[y : y + fh, x : x + fw]
        new = colors[np.minimum(index, len(colors) - 1)]
        part[:] = new if clear is None else np.where((index == clear)[..., None], part, new)
        out.append((from_rgb8(canvas.copy()), delay))
        clear = None
    return out


def write_qoi(a: np.ndarray) -> bytes:
    """Each pixel as a plain RGB chunk."""
    rgb = to_rgb8(a)
    h, w, _ = rgb.shape
    body = np.concatenate([np.full((h * w, 1), 0xFE, np.uint8), rgb.reshape(-1, 3)], 1).tobytes()
    return b"qoif" + struct.pack(">IIBB", w, h, 3, 0) + body + b"\0" * 7 + b"\x01"


def read_qoi(data: bytes) -> np.ndarray:
    """Any QOI image, its alpha left out."""
    if data[:4] != b"qoif":
        raise UnsupportedFormat("not a QOI image")
    w, h = struct.unpack(">II", data[4:12])
    px, seen, out, at = (0, 0, 0, 255), [(0, 0, 0, 0)] * 64, [], 14
    while len(out) < w * h:
        b = data[at]
        at += 1
        if b == 0xFE:
            px, at = (*data[at : at + 3], px[3]), at + 3
        elif b == 0xFF:
            px, at = tuple(data[at : at + 4]), at + 4
        elif b >> 6 == 0:
            px = seen[b]
        elif b >> 6 == 1:
            px = ((px[0] + (b >> 4 & 3) - 2) & 255, (px[1] + (b >> 2 & 3) - 2) & 255, (px[2] + (b & 3) - 2) & 255, px[3])
        elif b >> 6 == 2:
            g, d, at = (b & 63) - 32, data[at], at + 1
            px = ((px[0] + g + (d >> 4) - 8) & 255, (px[1] + g) & 255, (px[2] + g + (d & 15) - 8) & 255, px[3])
        else:
            out += [px] * (b & 63)
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out.append(px)
    return from_rgb8(np.array(out[: w * h], np.uint8).reshape(h, w, 4))
