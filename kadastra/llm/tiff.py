"""TIFF as a media column: a reader that emits one row a page, and a small writer for round trips.

The reader walks the chain of image directories in either byte order, decodes strips or tiles stored
plain, as PackBits, LZW or deflate, undoes horizontal differencing of integers and of floats, and returns the samples
of each page in row order, one byte, or 2 or 4 in the file's byte order, a sample.  Samples of 1, 2 and 4 bits are
unpacked to a byte each; separate planes are interleaved.

Defined cases: a null, empty or damaged file gives one row with ``page`` null and an ``error``; a damaged page gives
a row with its number and an ``error``, and the other pages are read; pages of more than ``MOST_SAMPLES`` samples are
an error; a loop in the chain of directories ends the walk; extra columns are kept out of the result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ._common import map_rows

#: Values fixed by the TIFF format: compression schemes, field type sizes.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Samples of a page that are read; beyond it the page is an error, as a damaged size would ask for any memory.
MOST_SAMPLES = 1 << 28
_RUN = re.compile(rb"(.)\1{2,127}", re.S)
SCHEMA = (
    "id long, page int, width int, height int, bits int, samples_per_pixel int, compression int, "
    "predictor int, tiled boolean, n_chunks int, samples binary, error string"
)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            piece = data[i : min(i + 128, b)]
            out.append(len(piece) - 1)
            out.extend(piece)

    at = 0
    for m in _RUN.finditer(data):
        literal(at, m.start())
        out.append(257 - (m.end() - m.start()))
        out.extend(m[1])
        at = m.end()
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, want: int) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n and len(out) < want:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Variable width codes of 9 to 12 bits, most significant bit first, widths change one code early."""
    clear, end = 256, 257
    first = {bytes([i]): i for i in range(256)}
    book, nxt, width = dict(first), 258, 9
    acc, bits, out = clear, 9, bytearray()

    def flush() -> None:
        nonlocal acc, bits
        whole = bits // 8
        if whole:
            rest = bits - 8 * whole
            out.extend((acc >> rest).to_bytes(whole, "big"))
            acc &= (1 << rest) - 1
            bits = rest

    w = b""
    for c in data:
        wc = w + bytes((c,))
        if wc in book:
            w = wc
            continue
        acc, bits = (acc << width) | book[w], bits + width
        if bits > 512:
            flush()
        book[wc] = nxt
        nxt += 1
        if nxt == 4095:
            acc, bits = (acc << 12) | clear, bits + 12
            book, nxt, width = dict(first), 258, 9
        elif nxt in (512, 1024, 2048):
            width += 1
        w = wc[-1:]
    if w:
        acc, bits = (acc << width) | book[w], bits + width
        nxt += 1
        if nxt in (512, 1024, 2048):
            width += 1
    acc, bits = (acc << width) | end, bits + width
    pad = -bits % 8
    acc, bits = acc << pad, bits + pad
    flush()
    return bytes(out)


def lzw_decode(data: bytes, want: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    book: list[bytes] = list(first)
    out: list[bytes] = []
    acc = bits = made = 0
    width, prev = 9, None
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            book, width, prev = list(first), 9, None
            continue
        if code == 257 or made >= want:
            break
        if prev is None:
            piece = book[code]
        else:
            if code < len(book):
                piece = book[code]
            elif code == len(book):
                piece = prev + prev[:1]
            else:
                raise ValueError("LZW code out of range")
            book.append(prev + piece[:1])
            if len(book) in (511, 1023, 2047):
                width += 1
        out.append(piece)
        made += len(piece)
        prev = piece
    return b"".join(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode}[compression](data)


def _unpack(data: bytes, compression: int, want: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, want)
    if compression == NONE:
        return data[:want]
    if compression == PACKBITS:
        return packbits_decode(data, want)[:want]
    if compression == LZW:
        return lzw_decode(data, want)[:want]
    raise ValueError(f"compression {compression}")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = 256) -> bytes:
    """8-bit grey pages (height x width) to a little-endian file, in strips of ``rows`` or square tiles."""
    parts: list[bytes] = [b"II*\0", b"\0\0\0\0"]
    size = 8
    link = 4  # place of the pointer to the next directory
    links: list[tuple[int, int]] = []

    def put(x: bytes) -> int:
        nonlocal size
        at = size
        parts.append(x)
        size += len(x)
        if size % 2:
            parts.append(b"\0")
            size += 1
        return at

    for page in pages:
        h, w = page.shape
        chunks: list[bytes] = []
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    piece = page[y : y + tile, x : x + tile]
                    block[: piece.shape[0], : piece.shape[1]] = piece
                    chunks.append(_differ(block, predictor).tobytes())
        else:
            for y in range(0, h, rows):
                chunks.append(_differ(page[y : y + rows], predictor).tobytes())
        packed = [_pack(c, compression) for c in chunks]
        offsets = [put(p) for p in packed]
        counts = [len(p) for p in packed]
        tags: list[tuple[int, int, list[int]]] = [
            (256, 4, [w]), (257, 4, [h]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]),
            (317, 3, [predictor]),
        ]
        if tile:
            tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)]
        else:
            tags += [(273, 4, offsets), (278, 4, [rows]), (279, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            entries += struct.pack("<HHI", tag, kind, len(values)) + (
                body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", put(body))
            )
        at = put(struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")
        links.append((link, at))
        link = at + 2 + len(entries)
    out = bytearray(b"".join(parts))
    for where, at in links:
        out[where : where + 4] = struct.pack("<I", at)
    return bytes(out)


def _differ(a: np.ndarray, predictor: int) -> np.ndarray:
    if predictor != 2:
        return np.ascontiguousarray(a)
    out = a.copy()
    out[:, 1:] = a[:, 1:] - a[:, :-1]
    return out


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """The tags of each image directory, in order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list] = {0: [order]}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            total = _SIZES.get(kind, 0) * count
            place = at + 10 + 12 * i
            if total > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if kind in (1, 3, 4) and total <= len(data):
                tags[tag] = list(struct.unpack_from(f"{order}{count}" + {1: "B", 3: "H", 4: "I"}[kind], data, place))
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _chunk(raw: bytes, bits: int, rows: int, width: int, spp: int, order: str, pred: int) -> np.ndarray:
    """Samples of one decoded strip or tile, predictor undone."""
    if bits < 8:
        packed = np.frombuffer(raw, np.uint8).reshape(rows, -1)
        per = 8 // bits
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        flat = (packed[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(rows, packed.shape[1] * per)
        return flat[:, : width * spp].reshape(rows, width, spp)
    kind = np.dtype("u1" if bits == 8 else f"{order}u{bits // 8}")
    if pred == 3:  # bytes of a row by significance, then differences of bytes
        size = bits // 8
        rows_of = np.frombuffer(raw, np.uint8).reshape(rows, width * size, spp)
        summed = np.cumsum(rows_of, axis=1, dtype=np.uint8).reshape(rows, size, width * spp)
        big = np.ascontiguousarray(summed.transpose(0, 2, 1))
        return big.view(f">u{size}").reshape(rows, width, spp).astype(kind)
    block = np.frombuffer(raw, kind).reshape(rows, width, spp)
    if pred == 2:
        block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
    elif pred != 1:
        raise ValueError(f"predictor {pred}")
    return block


def _page(data: bytes, tags: dict[int, list]) -> dict:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    order, w, h = tags[0][0], one(256), one(257)
    if not w or not h:
        raise ValueError("no image size")
    spp, bits, comp, pred, planes = one(277, 1), one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or len({*tags.get(258, [1])}) > 1:
        raise ValueError(f"{tags.get(258)} bits a sample")
    if pred == 3 and bits < 16 or pred == 2 and bits < 8:
        raise ValueError(f"predictor {pred} with {bits} bits")
    if not 0 < w * h * spp <= MOST_SAMPLES:
        raise ValueError("image too large")
    tiled = 322 in tags
    cw, ch = (one(322), one(323)) if tiled else (w, min(one(278, h) or h, h))
    if not cw or not ch or cw * ch * spp > MOST_SAMPLES:
        raise ValueError("no chunk size")
    offsets, counts = tags.get(324 if tiled else 273, []), tags.get(325 if tiled else 279, [])
    across, down = -(-w // cw), -(-h // ch)
    separate = planes == 2 and spp > 1
    if len(offsets) != len(counts) or len(offsets) < across * down * (spp if separate else 1):
        raise ValueError("chunks are missing")
    deep = 1 if separate else spp
    image = np.zeros((h, w, spp), np.uint8 if bits <= 8 else f"{order}u{bits // 8}")
    for i in range(across * down * (spp if separate else 1)):
        plane, k = divmod(i, across * down)
        y, x = k // across * ch, k % across * cw
        rows = ch if tiled else min(ch, h - y)
        want = rows * (-(-cw * deep * bits // 8))
        raw = _unpack(data[offsets[i] : offsets[i] + counts[i]], comp, want)
        if len(raw) < want:
            raise ValueError("chunk too short")
        block = _chunk(raw, bits, rows, cw, deep, order, pred)
        into = image[y : y + rows, x : x + cw, plane : plane + 1] if separate else image[y : y + rows, x : x + cw]
        into[...] = block[: h - y, : w - x]
    return {
        "width": w, "height": h, "bits": bits, "samples_per_pixel": spp, "compression": comp, "predictor": pred,
        "tiled": tiled, "n_chunks": len(offsets), "samples": image.tobytes(), "error": None,
    }


def pages(data: bytes) -> Iterator[dict]:
    """One dict a page: geometry, how it was stored, and its samples as bytes in row order."""
    for k, tags in enumerate(directories(data)):
        yield {"page": k} | _page(data, tags)


def page_rows(data: bytes | None) -> list[dict]:
    """A row a page, good or with an error; a row without a page where the chain of directories breaks."""
    out: list[dict] = []
    empty = dict.fromkeys(_KEYS)
    try:
        for k, tags in enumerate(directories(data or b"")):
            try:
                out.append({"page": k} | _page(data, tags))
            except Exception as e:  # noqa: BLE001 - whatever a damaged page brings about is told in its row
                out.append(empty | {"page": k, "error": f"{type(e).__name__}: {e}"})
    except Exception as e:  # noqa: BLE001
        out.append(empty | {"error": f"{type(e).__name__}: {e}"})
    return out or [empty | {"error": "no pages"}]


def decode_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row a page of the files in ``media_col``; ``id`` is ``id_col``."""

    def make():
        def run(cols):
            rows = [{"id": i} | r for i, m in zip(cols["id"], cols["media"], strict=True) for r in page_rows(m)]
            return {k: [r[k] for r in rows] for k in ["id", *_KEYS]}

        return run

    return map_rows(df.selectExpr(f"cast(`{id_col}` as long) id", f"`{media_col}` media"), make, SCHEMA)


_KEYS = [x.split()[0] for x in SCHEMA.split(", ")][1:]
#: Payload bytes of a page that text is stored in.
PAGE_BYTES = 1 << 16


def store(payload: bytes, pick: int) -> bytes:
    """A payload of a multiple of 64 bytes as grey pages 64 wide; ``pick`` chooses how they are stored."""
    grey = [
        np.frombuffer(payload, np.uint8, min(PAGE_BYTES, len(payload) - i), i).reshape(-1, 64)
        for i in range(0, len(payload), PAGE_BYTES)
    ]
    kind = (LZW, PACKBITS, DEFLATE)[pick % 3]
    return encode(grey, kind, 2 if pick >> 4 & 1 and kind != PACKBITS else 1, 64 if pick >> 5 & 1 else 0)
