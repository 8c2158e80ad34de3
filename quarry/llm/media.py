"""Media columns: baseline JPEG read in Python and numpy, as far as a thumbnail needs it.

The markers are parsed, the scans' Huffman codes decoded (AC coefficients are skipped over, several
symbols at a time, by a table that numpy makes of each code), and the DC coefficients of the luminance
give a picture of an eighth of the size: one pixel for each block of 8 x 8. Stored are the dimensions, the thumbnail, and two hashes of it: a 64-bit
difference hash, near for pictures that look alike, and a digest, equal for equal thumbnails.

The given tables hold no pictures. draw() and encode() make some, so that there is a media column to
read: each embedding becomes a picture of 64 tiles, encoded as baseline JPEG with the standard tables.

Defined cases
* null or empty bytes: a row with the error 'empty' and nulls otherwise.
* not a JPEG, progressive or arithmetic coding, 12 bits, cut-off or damaged data: the error says what; no crash.
* a header that promises more blocks than the scan can hold (2 bits each at least): 'scan data end early', before memory is taken.
* null id: kept. Repeated rows: one row each. Pictures whose size is no multiple of 8 or of the sampling: padding blocks are dropped.
* null or wrongly sized embeddings: null picture, hence 'empty'. Very large pictures: whole. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
SCHEMA = "vec_id long, width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, difference_hash long, digest string, error string"


class Damaged(ValueError):
    pass


def _table(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol << 8 | length of its code, or 0."""
    out, at, k = np.zeros(65536, np.int32), 0, 0
    for n, count in enumerate(lengths, 1):
        wide = count << (16 - n)
        if at + wide > 65536 or k + count > len(symbols):
            raise Damaged("bad Huffman table")
        out[at : at + wide] = np.repeat((np.frombuffer(symbols, np.uint8, count, k).astype(np.int32) << 8) | n, 1 << (16 - n))
        at, k = at + wide, k + count
    return out


#: In a table of runs: the end of the block follows; places to go on by; bits that this takes.
_END, _ON = 1 << 16, 8


def _runs(table: np.ndarray) -> np.ndarray:
    """For each 16 bits that may come next in a block's AC part: _END | places << 8 | bits of as many whole symbols, values included, as they hold, or 0."""
    next16 = np.arange(65536, dtype=np.int64)
    used, places, live, end = np.zeros(65536, np.int64), np.zeros(65536, np.int64), np.ones(65536, bool), np.zeros(65536, bool)
    while live.any():
        e = table[(next16 << used) & 0xFFFF]
        take = (e & 0xFF) + ((e >> 8) & 15)
        live &= (e > 0) & (used + take <= 16)
        stop = live & (e >> 8 == 0)
        end |= stop
        used += np.where(live, take, 0)
        places += np.where(live & ~stop, (e >> 12) + 1, 0)
        live &= ~stop & (places < 64)
    return np.where(end, _END, 0) | np.minimum(places, 255) << 8 | used


_seen: dict[bytes, tuple[list[int], list[int]]] = {}


def _cached(raw: bytes, ac: bool) -> tuple[list[int], list[int]]:
    """(symbols, runs) of a Huffman table; runs are for AC only."""
    key = bytes([ac]) + raw
    if key not in _seen:
        if len(_seen) > 16:
            _seen.clear()
        t = _table(raw[:16], raw[16:])
        _seen[key] = t.tolist(), _runs(t).tolist() if ac else []
    return _seen[key]


def parse(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, luminance thumbnail)."""
    if raw[:2] != b"\xff\xd8":
        raise Damaged("not a JPEG")
    at, quant, huff, frame, restart, dc = 2, {}, {}, None, 0, {}
    while at < len(raw):
        if raw[at] != 0xFF:
            raise Damaged("no marker where one is due")
        while at < len(raw) and raw[at] == 0xFF:
            at += 1
        if at >= len(raw):
            break
        m, at = raw[at], at + 1
        if m == 0xD9:
            break
        if m == 0x01 or 0xD0 <= m <= 0xD8:
            continue
        if at + 2 > len(raw):
            raise Damaged("cut off")
        n = struct.unpack_from(">H", raw, at)[0]
        body, at = raw[at + 2 : at + n], at + n
        if n < 2 or len(body) < n - 2:
            raise Damaged("cut off")
        if m == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                if len(body) < 1 + size:
                    raise Damaged("bad quantisation table")
                quant[k] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]  # the DC step is the first
                body = body[1 + size :]
        elif m == 0xC4:
            while body:
                count = sum(body[1:17])
                if len(body) < 17 + count:
                    raise Damaged("bad Huffman table")
                huff[body[0]] = _cached(body[1 : 17 + count], body[0] >= 16)
                body = body[17 + count :]
        elif m in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise Damaged("bad frame")
            if body[0] != 8:
                raise Damaged("not 8 bits a sample")
            h, w = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not h or not w or not parts or any(not 1 <= x <= 4 for p in parts for x in p[1:3]):
                raise Damaged("bad frame")
            frame = (w, h, parts, max(p[1] for p in parts), max(p[2] for p in parts))
        elif 0xC2 <= m <= 0xCF and m not in (0xC8, 0xCC):
            raise Damaged("not baseline")
        elif m == 0xDD:
            restart = struct.unpack_from(">H", body)[0] if len(body) >= 2 else 0
        elif m == 0xDA:
            if frame is None:
                raise Damaged("scan before frame")
            end = at
            while True:  # to the next marker that isn't a restart
                end = raw.find(b"\xff", end)
                if end < 0 or end + 1 >= len(raw):
                    end = len(raw)
                    break
                if raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7 or raw[end + 1] == 0xFF:
                    end += 1 if raw[end + 1] == 0xFF else 2
                    continue
                break
            _scan(raw[at:end], body, frame, huff, restart, dc)
            at = end
    if frame is None:
        raise Damaged("no frame")
    w, h, parts, hm, vm = frame
    first = parts[0]
    if first[0] not in dc:
        raise Damaged("no luminance scan")
    if first[3] not in quant:
        raise Damaged("no quantisation table")
    cols, rows = -(-(-(-w * first[1] // hm)) // 8), -(-(-(-h * first[2] // vm)) // 8)
    light = dc[first[0]][:rows, :cols].astype(np.float64) * quant[first[3]] / 8 + 128
    return w, h, len(parts), np.clip(np.rint(light), 0, 255).astype(np.uint8)


def _scan(data: bytes, head: bytes, frame: tuple, huff: dict, restart: int, dc: dict) -> None:
    w, h, parts, hm, vm = frame
    known = {p[0]: p for p in parts}
    if not head or len(head) < 1 + 2 * head[0]:
        raise Damaged("bad scan")
    mine = []
    for i in range(head[0]):
        c, t = head[1 + 2 * i], head[2 + 2 * i]
        if c not in known or (t >> 4) not in huff or 16 + (t & 15) not in huff:
            raise Damaged("scan without tables")
        mine.append((known[c], huff[t >> 4], huff[16 + (t & 15)]))
    wide, high = -(-w // (8 * hm)), -(-h // (8 * vm))
    if len(mine) == 1:  # not interleaved: only the blocks that hold picture, in rows
        (c, ch, cv, _), _, _ = mine[0]
        cols, rows = -(-(-(-w * ch // hm)) // 8), -(-(-(-h * cv // vm)) // 8)
        shape, each = (rows, cols), [(0, 1, 1)]
    else:
        shape, each = (high, wide), [(i, p[1], p[2]) for i, (p, _, _) in enumerate(mine)]
    if shape[0] * shape[1] * sum(h * v for _, h, v in each) * 2 > len(data) * 8:
        raise Damaged("scan data end early")
    planes = [dc.setdefault(c, np.zeros((high * cv, wide * ch), np.int32)) for (c, ch, cv, _), _, _ in mine]
    pieces, k, start = [], 0, 0
    while True:  # at restart markers
        k = data.find(b"\xff", k)
        if k < 0 or k + 1 >= len(data):
            break
        if 0xD0 <= data[k + 1] <= 0xD7:
            pieces.append(data[start:k])
            start = k + 2
        k += 2
    pieces.append(data[start:])
    total = shape[0] * shape[1]
    step = restart or total
    tables = [(d[0], *a) for _, d, a in mine]
    for p, lo in enumerate(range(0, total, step)):
        if p >= len(pieces):
            raise Damaged("scan data end early")
        _interval(pieces[p], lo, min(total, lo + step), shape[1], each, tables, planes)


def _interval(raw: bytes, lo: int, hi: int, wide: int, each: list, tables: list, planes: list) -> None:
    """Decode the DC values of the units lo .. hi - 1 of a restart interval into the planes."""
    raw = raw.replace(b"\xff\x00", b"\xff")
    n = len(raw) * 8
    b = np.frombuffer(raw + b"\xff" * 512, np.uint8).astype(np.uint32)  # a block's bits beyond the end stay within the padding
    window = array("I", ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]).tobytes())  # 24 bits from each byte on
    at, last = 0, [0] * len(each)
    for unit in range(lo, hi):
        y, x = divmod(unit, wide)
        for i, h, v in each:
            symbols, ac, runs = tables[i]
            for block in range(h * v):
                e = symbols[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
                if not e:
                    raise Damaged("bad Huffman code")
                at += e & 0xFF
                size = e >> 8
                if size:
                    if size > 15:
                        raise Damaged("bad coefficient size")
                    bits = ((window[at >> 3] >> (8 - (at & 7))) & 0xFFFF) >> (16 - size)
                    at += size
                    last[i] += bits if bits >> (size - 1) else bits - (1 << size) + 1
                planes[i][y * v + block // h, x * h + block % h] = last[i]
                k = 1
                while k < 64:
                    w = (window[at >> 3] >> (8 - (at & 7))) & 0xFFFF
                    e = runs[w]
                    to = k + ((e >> _ON) & 0xFF)
                    if e >= _END and to < 64:
                        at += e & 0xFF
                        break
                    if 0 < e < _END and to <= 64:
                        at, k = at + (e & 0xFF), to
                        continue
                    e = ac[w]  # longer than 16 bits with its value, or the block ends among them
                    if not e:
                        raise Damaged("bad Huffman code")
                    at += (e & 0xFF) + (e >> 8 & 15)
                    if e < 256:
                        break
                    k += (e >> 12) + 1
                if at > n:
                    raise Damaged("scan data end early")


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: on a grid of 8 rows and 9 columns (nearest pixels), is each pixel darker than its right neighbour?"""
    rows = (np.arange(8) * thumb.shape[0]) // 8
    cols = (np.arange(9) * thumb.shape[1]) // 9
    small = thumb[rows][:, cols].astype(np.int16)
    return int(np.packbits(small[:, :-1] < small[:, 1:]).view(">i8")[0])


def describe(raw: bytes | None) -> tuple:
    """What the media column stores of one picture; the last is the error."""
    if not raw:
        return (None,) * 8 + ("empty",)
    try:
        w, h, n, thumb = parse(bytes(raw))
    except Damaged as e:
        return (None,) * 8 + (str(e),)
    except (IndexError, struct.error, ValueError, OverflowError):
        return (None,) * 8 + ("cut off",)
    data = thumb.tobytes()
    return w, h, n, thumb.shape[1], thumb.shape[0], data, difference_hash(thumb), xxhash.xxh3_128_hexdigest(struct.pack(">HH", *thumb.shape) + data), None


# -- a baseline encoder, for the pictures that the tables lack

_DC_BITS, _DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: Every AC symbol with a code of 8 or 9 bits: valid, if not the shortest.
_AC_SYMBOLS = bytes([0, 0xF0, *(r << 4 | s for s in range(1, 11) for r in range(16))])
_AC_BITS = bytes([0, 0, 0, 0, 0, 0, 0, 90, 72, 0, 0, 0, 0, 0, 0, 0])


def _codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _dct() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def encode(planes: list[np.ndarray], sampling: list[tuple[int, int]] | None = None, step: int = 8, restart: int = 0) -> bytes:
    """Baseline JPEG of 8-bit planes, the first of full size; sampling: (h, v) of each, in which the others are smaller by their part of the most."""
    sampling = sampling or [(1, 1)] * len(planes)
    h, w = planes[0].shape
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    wide, high = (-(-w // 8), -(-h // 8)) if len(planes) == 1 else (-(-w // (8 * hm)), -(-h // (8 * vm)))
    if len(planes) == 1:
        sampling = [(1, 1)]
    d, blocks = _dct(), []
    for p, (ch, cv) in zip(planes, sampling):
        full = np.pad(p.astype(np.float64), ((0, high * cv * 8 - p.shape[0]), (0, wide * ch * 8 - p.shape[1])), mode="edge") - 128
        tiles = full.reshape(high * cv, 8, wide * ch, 8).transpose(0, 2, 1, 3)
        q = np.rint(np.einsum("ab,yxbc,dc->yxad", d, tiles, d) / step).astype(int)
        blocks.append(q.reshape(high * cv, wide * ch, 64)[..., ZIGZAG])
    dcc, acc = _codes(_DC_BITS, _DC_SYMBOLS), _codes(_AC_BITS, _AC_SYMBOLS)
    out, bits, last, done = [], [], [0] * len(planes), 0

    def put(code: int, n: int) -> None:
        if n:
            bits.append(format(code, f"0{n}b"))

    def number(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    def flush() -> None:
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        out.append(int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b"")
        bits.clear()

    for y in range(high):
        for x in range(wide):
            if restart and done and done % restart == 0:
                flush()
                out.append(bytes([0xFF, 0xD0 + (done // restart - 1) % 8]))
                last = [0] * len(planes)
            for i, (ch, cv) in enumerate(sampling):
                for v in range(cv):
                    for u in range(ch):
                        z = blocks[i][y * cv + v, x * ch + u]
                        n, raw = number(int(z[0]) - last[i])
                        last[i] = int(z[0])
                        put(*dcc[n])
                        put(raw, n)
                        run, end = 0, int(np.flatnonzero(z)[-1]) if z.any() else 0
                        for k in range(1, end + 1):
                            if not z[k]:
                                run += 1
                                continue
                            while run > 15:
                                put(*acc[0xF0])
                                run -= 16
                            n, raw = number(int(z[k]))
                            put(*acc[run << 4 | n])
                            put(raw, n)
                            run = 0
                        if end < 63:
                            put(*acc[0])
            done += 1
    flush()

    def segment(m: int, body: bytes) -> bytes:
        return bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body

    frame = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(sampling))
    tables = b"\0" + _DC_BITS + _DC_SYMBOLS + b"\x10" + _AC_BITS + _AC_SYMBOLS
    scan = bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0"
    restarts = segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([step]) * 64) + segment(0xC0, frame) + segment(0xC4, tables) + restarts + segment(0xDA, scan) + b"".join(out) + b"\xff\xd9"


def draw(vector: list[float] | None) -> bytes | None:
    """64 numbers as a picture of 8 x 8 tiles, each a block with a slope; nulls count as 0."""
    if vector is None or len(vector) != 64:
        return None
    v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in vector]).reshape(8, 8)
    flat = np.clip(128 + 320 * v, 0, 255).repeat(8, 0).repeat(8, 1)
    return encode([np.clip(flat + np.tile(np.arange(8) - 3.5, 8)[None, :], 0, 255).astype(np.uint8)])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([draw(v) for v in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "media"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for b in batches:
        rows = [describe(m) for m in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], names=names)


def pictures(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media): a JPEG for each embedding."""
    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lean(_draw), "vec_id long, media binary")


def media_columns(media: DataFrame) -> DataFrame:
    """The stored columns of a table (vec_id, media)."""
    return media.select("vec_id", "media").mapInArrow(lean(_describe), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all pictures of the media column."""
    return media_columns(pictures(read_table(spark, sf_dir, "embeddings")))
