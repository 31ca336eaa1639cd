"""Media columns: progressive JPEG (ITU-T T.81) read and written in numpy.

Reading accumulates the scans of a picture, by spectral band and by successive
approximation, into one array of coefficients for each component; the inverse
transform is a product with an integer basis, exact in double precision; chroma
is repeated up to full size and the picture becomes an RGB tensor.

Writing stores any bytes without loss: each 64 bytes are the 64 coefficients of
one block, a byte b as the coefficient 256 + b. All of them need nine bits, so
with one-bit codes the AC scans have equal strides; the reader notices such
tables and takes a whole scan apart at once. Other scans go through the general
bit-by-bit path.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .storage import with_fields

#: Units (2 x 2 luma blocks and two chroma blocks) across a stored picture, and in one picture at most.
ACROSS, MOST_UNITS = 64, 64 * 4095
UNIT_BLOCKS = 6
#: Tag of the segment that holds the length of the stored bytes.
TAG = b"bytes\0"
#: Rows of a batch, and bytes of its texts or files, at most (one longer file is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 128, 1 << 22

#: Row by row, the place of each coefficient in its block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, (i // 8 if s % 2 else i % 8))))
BANDS = ((1, 5), (6, 63))
BASIS_BITS = 20


@cache
def _basis() -> np.ndarray:
    """(64 zigzag coefficients, 64 samples), scaled to whole numbers."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 2**BASIS_BITS)


# --- writing ---------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """The bits, filled up with ones, as entropy-coded bytes."""
    spare = -len(bits) % 8
    if spare:
        bits = np.concatenate([bits, np.ones(spare, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, slot: int, lengths: list[int], symbols: bytes) -> bytes:
    counts = bytes(lengths.count(n) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | slot]) + counts + symbols)


def _scan(parts: Sequence[tuple[int, int, int]], ss: int, se: int, high: int, low: int) -> bytes:
    body = bytes([len(parts)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in parts)
    return _segment(0xDA, body + bytes([ss, se, high << 4 | low]))


_own_scan = cache(_scan)  # the same few for all stored pictures


def _dc_bits(values: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Differences within each component; four bits of category, then the category's bits."""
    diff = np.empty(len(values), np.int32)
    for c in range(3):
        own = values[component == c]
        own[1:] -= own[:-1].copy()  # own is a copy of its values
        diff[component == c] = own
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int32)
    code = (size << 16) | np.where(diff < 0, diff + (1 << size) - 1, diff)  # 4 bits of category above 16 bits
    each = 4 + size
    row = np.repeat(np.arange(len(diff)), each)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    shift = np.where(at < 4, 19 - at, size[row] + 3 - at)
    return ((code[row] >> shift) & 1).astype(np.uint8)


#: Shifts of the eight cells of nine bits that nine bytes hold.
_NINTHS = np.arange(8, dtype=np.uint16)


def _nines(values: np.ndarray) -> bytes:
    """Each byte behind a bit 0, filled up with ones, as entropy-coded bytes."""
    n = values.size
    cells = np.zeros(-(-n // 8) * 8, np.uint16)
    cells[:n] = values.reshape(-1)
    cells = cells.reshape(-1, 8)
    out = np.zeros((len(cells), 9), np.uint8)
    out[:, :8] = cells >> (_NINTHS + 1)
    out[:, 1:] |= (cells << (7 - _NINTHS)).astype(np.uint8)
    flat, spare = out.reshape(-1)[: -(-9 * n // 8)], -9 * n % 8
    flat[-1] |= (1 << spare) - 1
    return flat.tobytes().replace(b"\xff", b"\xff\x00")


def _cells_of_nine(raw: np.ndarray, n: int) -> np.ndarray:
    """The first n groups of nine bits."""
    whole = np.zeros(-(-n // 8) * 9, np.uint16)
    most = -(-9 * n // 8)
    whole[:most] = raw[:most]
    whole = whole.reshape(-1, 9)
    return ((((whole[:, :-1] << 8) | whole[:, 1:]) >> (7 - _NINTHS)) & 0x1FF).reshape(-1)[:n]


@cache
def _signed(size: int, low: int) -> np.ndarray:
    """What size bits stand for, shifted: the lower half of their values is negative."""
    value = np.arange(1 << size, dtype=np.int32)
    return (value - np.where(value >> (size - 1), 0, (1 << size) - 1).astype(np.int32)) << low


def _picture(payload: bytes) -> bytes:
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    units = -(-len(blocks) // UNIT_BLOCKS)
    across = min(ACROSS, units)
    down = -(-units // across)
    units = across * down
    filled = np.zeros((units * UNIT_BLOCKS, 64), np.uint8)
    filled[: len(blocks)] = blocks
    filled = filled.reshape(units, UNIT_BLOCKS, 64)
    y = filled[:, :4].reshape(down, across, 2, 2, 64).swapaxes(1, 2).reshape(-1, 64)  # rows of blocks, as scans of one component go
    planes = (y, filled[:, 4], filled[:, 5])

    out = [b"\xff\xd8", _segment(0xEB, TAG + struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_table(0, 0, [4] * 9, bytes(range(9))))
    out.append(_table(1, 0, [1], b"\x08"))
    out.append(_table(1, 1, [1], b"\x00"))
    everyone = ((1, 0, 0), (2, 0, 0), (3, 0, 0))
    dc = filled[:, :, 0].reshape(-1).astype(np.int32) + 256
    out += [_own_scan(everyone, 0, 0, 0, 1), _stuffed(_dc_bits(dc >> 1, np.tile([0, 0, 0, 0, 1, 2], units)))]
    for c, plane in enumerate(planes, 1):
        for first, last in BANDS:
            out += [_own_scan(((c, 0, 0),), first, last, 0, 1), _nines(128 + (plane[:, first : last + 1] >> 1))]
    out += [_own_scan(everyone, 0, 0, 1, 0), _stuffed((dc & 1).astype(np.uint8))]
    for c, plane in enumerate(planes, 1):
        cells = np.zeros((len(plane), 64), np.uint8)
        cells[:, 1:] = plane[:, 1:] & 1
        out += [_own_scan(((c, 0, 1),), 1, 63, 1, 0), _stuffed(cells.reshape(-1))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def write(payload: bytes) -> bytes:
    """Pictures, one behind the other, that hold the payload; its length is a positive multiple of 64."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload's length must be a positive multiple of 64")
    most = MOST_UNITS * UNIT_BLOCKS * 64
    return b"".join(_picture(payload[i : i + most]) for i in range(0, len(payload), most))


# --- reading ---------------------------------------------------------------


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol, the length of its code, and both added up, that each 16 bits begin with; length 0 and sum -1 where no code fits."""
    value, length = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int16)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            value[span], length[span] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return value, length, np.where(length > 0, length + value, -1).astype(np.int16)


class Table:
    """A Huffman table: the symbol and length of each code by its value with a leading one."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.counts, self.symbols = bytes(counts), bytes(symbols)
        self.codes, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[1 << length | code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class Bits:
    """Entropy-coded bytes, read bit by bit; ones follow the end."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes(), 0

    def bit(self) -> int:
        at, self.at = self.at, self.at + 1
        return self.bits[at] if at < len(self.bits) else 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, table: Table) -> int:
        value, codes = 1, table.codes
        for _ in range(16):
            value = value << 1 | self.bit()
            if value in codes:
                return codes[value]
        raise ValueError("a code that no table has")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int) -> None:
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


def _signed_run(data: bytes, tables: list[Table], which: np.ndarray) -> np.ndarray:
    """A sequence of values, each a code of its table for a size and then that many bits; ones follow the end."""
    raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
    wide = (raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]
    place = np.arange(8 * (len(data) + 1))
    ahead = (wide[place >> 3] >> (24 - (place & 7))) & 0xFFFF  # the 16 bits from each place on
    found = [_lookup(t.counts, t.symbols) for t in tables]
    steps = [step[ahead].tolist() for _, _, step in found]
    at, starts, end = 0, [], len(place) - 1
    for k in which.tolist():
        starts.append(at)
        step = steps[k][at]
        if step < 0:
            raise ValueError("a code that no table has")
        at = min(at + step, end)
    starts = np.array(starts, np.int64)
    value, length = ((found[0][i][ahead[starts]] if len(found) == 1 else np.choose(which, [f[i][ahead[starts]] for f in found])).astype(np.int64) for i in (0, 1))
    if len(value) and value.max() > 16:
        raise ValueError("a difference of more than 16 bits")
    own = np.minimum(starts + length, end)
    bits = ahead[own] >> (16 - value)
    return np.where((value > 0) & (bits >> np.maximum(value - 1, 0) == 0), bits - (1 << value) + 1, bits)


def _dc_scan(parts, tables, order, data: bytes, low: int, high: int) -> None:
    """order: the component and block of each data unit of this interval."""
    if high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[: len(order[0])]
        for c in {id(p): p for p in parts}.values():
            own = order[0] == c.ident
            c.coefs[order[1][own], 0] |= bits[own[: len(bits)].nonzero()[0]].astype(np.int32) << low
        return
    distinct = list({(t.counts, t.symbols): t for t in tables.values()}.values())
    of = {ident: next(i for i, t in enumerate(distinct) if (t.counts, t.symbols) == (own.counts, own.symbols)) for ident, own in tables.items()}
    which = np.zeros(len(order[0]), np.int64)
    for ident, i in of.items():
        if i:
            which[order[0] == ident] = i
    steps = _signed_run(data, distinct, which)
    for c in parts:
        own = order[0] == c.ident
        c.coefs[order[1][own], 0] = np.cumsum(steps[own]) << low


def _even_ac(c: Component, table: Table, blocks: np.ndarray, data: bytes, ss: int, se: int, high: int, low: int) -> bool:
    """Takes a scan of equal strides apart; False if this isn't one."""
    n, band = len(blocks), se - ss + 1
    rows = slice(None) if n == len(c.coefs) else blocks  # in rising order: all of them
    raw = np.frombuffer(data, np.uint8)
    if not high:
        if table.only is None or table.only >> 4 or not (size := table.only & 15) or size > 8:
            return False
        need = n * band * (1 + size)
        if len(raw) * 8 < need:
            return False
        if size == 8:
            value = _cells_of_nine(raw, n * band)
            if (value >> 8).any():
                return False
        else:
            cells = np.unpackbits(raw, count=need).reshape(n * band, 1 + size)
            if cells[:, 0].any():
                return False
            value = np.packbits(cells[:, 1:], axis=1)[:, 0] >> (8 - size)
        c.coefs[rows, ss : se + 1] = _signed(size, low)[value].reshape(n, band)
        return True
    if table.only != 0 or len(raw) * 8 < n * (1 + band):
        return False
    now = c.coefs[rows, ss : se + 1]
    if not now.all():
        return False
    cells = np.unpackbits(raw, count=n * (1 + band)).reshape(n, 1 + band)
    if cells[:, 0].any():
        return False
    step = np.sign(now)
    step *= cells[:, 1:]
    step <<= low
    step += now
    c.coefs[rows, ss : se + 1] = step
    return True


def _ac_first(c: Component, table: Table, blocks, bits: Bits, ss: int, se: int, low: int) -> None:
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                c.coefs[b, k] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _ac_refine(c: Component, table: Table, blocks, bits: Bits, ss: int, se: int, low: int) -> None:
    run, step = 0, 1 << low

    def correct(row, k):
        if bits.bit():
            row[k] += step if row[k] > 0 else -step

    for b in blocks.tolist():
        row, k = c.coefs[b], ss
        while k <= se and not run:
            zeros, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = step if bits.bit() else -step
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= se:
                if row[k]:
                    correct(row, k)
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if value and k <= se:
                row[k] = value
            k += 1
        if run:
            for j in range(k, se + 1):
                if row[j]:
                    correct(row, j)
            run -= 1


@lru_cache(maxsize=512)
def _unit_order(width: int, height: int, most: tuple[int, int], parts: tuple[tuple[int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """The component and block of each data unit of a scan of parts (ident, h, v, blocks across), and the units between restarts."""
    hmax, vmax = most
    if len(parts) == 1:
        ident, h, v, across = parts[0]
        wide = -(-(-(-width * h // hmax)) // 8)
        high = -(-(-(-height * v // vmax)) // 8)
        block = (np.arange(high)[:, None] * across + np.arange(wide)).reshape(-1)
        return np.full(len(block), ident), block, 1
    units_across, units_down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    idents, blocks = [], []
    row, column = np.arange(units_down)[:, None], np.arange(units_across)[None, :]
    for ident, own_h, own_v, across in parts:
        for v in range(own_v):
            for h in range(own_h):
                idents.append(np.full(units_down * units_across, ident))
                blocks.append(((row * own_v + v) * across + column * own_h + h).reshape(-1))
    return np.stack(idents, 1).reshape(-1), np.stack(blocks, 1).reshape(-1), len(idents)


class Picture:
    """The coefficients of one picture, and its RGB samples."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.stored, self.quant, self.parts, self.interval, self.most_blocks = None, {}, [], 0, 8 * len(data)
        tables: dict[tuple[int, int], Table] = {}
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no picture begins here")
        at += 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            (length,) = struct.unpack_from(">H", data, at)
            body = data[at + 2 : at + length]
            at += length
            if marker == 0xEB and body.startswith(TAG):
                (self.stored,) = struct.unpack(">Q", body[len(TAG) :])
            elif marker == 0xDB:
                self._quant_tables(body)
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[divmod(body[0], 16)] = Table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a progressive picture with Huffman codes")
            elif marker == 0xDA:
                at = self._scan(data, at, body, tables)
        self.end = at

    def _quant_tables(self, body: bytes) -> None:
        while body:
            wide, slot = divmod(body[0], 16)
            n = 128 if wide else 64
            self.quant[slot] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
            body = body[1 + n :]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if n not in (1, 3):
            raise ValueError(f"{n} components")
        self.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        if not all(c.h and c.v for c in self.parts) or not self.width or not self.height:
            raise ValueError("a picture without samples")
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        if sum(c.h * c.v for c in self.parts) * self.across * self.down > self.most_blocks:
            raise ValueError("more blocks than the file has bits")
        for c in self.parts:
            c.wide, c.high = self.across * c.h, self.down * c.v
            c.coefs = np.zeros((c.wide * c.high, 64), np.int32)

    def _order(self, parts: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
        return _unit_order(self.width, self.height, (self.hmax, self.vmax), tuple((c.ident, c.h, c.v, c.wide) for c in parts))

    def _scan(self, data: bytes, at: int, head: bytes, tables: dict) -> int:
        pieces, end = [], at
        while True:
            end = data.index(b"\xff", end)
            if data[end + 1] == 0:
                end += 2
            elif 0xD0 <= data[end + 1] <= 0xD7:
                pieces.append(data[at:end])
                at = end = end + 2
            else:
                break
        pieces.append(data[at:end])
        by_ident = {c.ident: c for c in self.parts}
        chosen = [(by_ident[head[i]], *divmod(head[i + 1], 16)) for i in range(1, 1 + 2 * head[0], 2)]
        ss, se, (high, low) = head[-3], head[-2], divmod(head[-1], 16)
        parts = [c for c, _, _ in chosen]
        idents, blocks, unit = self._order(parts)
        each = self.interval * unit or len(blocks)
        for i, piece in enumerate(pieces):
            plain, own = piece.replace(b"\xff\x00", b"\xff"), slice(i * each, (i + 1) * each)
            if ss == 0:
                dc = {} if high else {c.ident: tables[0, d] for c, d, _ in chosen}
                _dc_scan(parts, dc, (idents[own], blocks[own]), plain, low, high)
                continue
            c, _, slot = chosen[0]
            args = (c, tables[1, slot], blocks[own])
            if _even_ac(*args, plain, ss, se, high, low):
                continue
            if high:
                _ac_refine(*args, Bits(plain), ss, se, low)
            else:
                _ac_first(*args, Bits(plain), ss, se, low)
        return end

    def payload(self) -> bytes:
        """The stored bytes, from the coefficients."""
        y, cb, cr = (c.coefs for c in self.parts)
        luma = y.reshape(self.down, 2, self.across, 2, 64).swapaxes(1, 2).reshape(-1, 4, 64)
        units = np.concatenate([luma, cb[:, None], cr[:, None]], axis=1)
        return (units - 256).astype(np.uint8).tobytes()[: self.stored]

    def rgb(self) -> np.ndarray:
        """Full-resolution samples (height, width, 3)."""
        planes = []
        for c in self.parts:
            samples = (c.coefs * self.quant[c.quant]) @ _basis()  # whole numbers far below 2**53: exact in any order
            samples += 2 ** (BASIS_BITS - 1) + (128 << BASIS_BITS)
            samples *= 2.0**-BASIS_BITS
            np.floor(samples, out=samples)
            samples = np.minimum(np.maximum(samples, 0, out=samples), 255, out=samples).astype(np.int32)
            plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
            if (c.v, c.h) != (self.vmax, self.hmax):  # each sample stands for those that fall on it
                if self.vmax % c.v or self.hmax % c.h:
                    down, across = np.arange(self.height) * c.v // self.vmax, np.arange(self.width) * c.h // self.hmax
                    plane = plane[down[:, None], across[None, :]]
                else:
                    plane = plane.repeat(self.vmax // c.v, 0).repeat(self.hmax // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[..., None], 3, -1)
        y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
        y += 1 << 15
        out = np.empty((*y.shape, 3), np.uint8)
        for i, p in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):  # 1.402, 0.344136, 0.714136, 1.772 in 16 bits
            p >>= 16
            out[..., i] = np.minimum(np.maximum(p, 0, out=p), 255, out=p)
        return out


def pictures(media: bytes) -> list[Picture]:
    found, at = [], 0
    while at < len(media):
        found.append(Picture(media, at))
        at = found[-1].end
    return found


def feature(tensors: list[np.ndarray]) -> str:
    """Width x height, mean of each channel and a checksum of all samples, of each picture."""
    return ";".join(f"{t.shape[1]}x{t.shape[0]}:{':'.join(str(int(m)) for m in t.reshape(-1, 3).sum(0, dtype=np.int64) // (t.size // 3))}:{zlib.crc32(t):08x}" for t in tensors)


# --- columns ---------------------------------------------------------------


def _mapped(df: DataFrame, read: str, added: dict[str, str], make) -> DataFrame:
    schema = with_fields(df, added)
    kept = schema.names[: -len(added)]

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(read)), 0).to_pylist()
            at = 0
            while at < batch.num_rows:
                end, size = at + 1, sizes[at]
                while end < min(batch.num_rows, at + BATCH_ROWS) and size + sizes[end] <= BATCH_BYTES:
                    size += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *make(part)], names=[*kept, *added])
                at = end

    return df.mapInArrow(run, schema)


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Adds a column of progressive JPEG that holds a column of bytes without loss.

    The bytes' number must be a positive multiple of 64; null bytes give null
    media. Equal bytes give equal media; repeated rows stay; a column named media
    is replaced. An empty table gives an empty result.
    """

    def make(part):
        return [pa.array([None if p is None else write(p) for p in part.column(payload).to_pylist()], pa.binary())]

    return _mapped(df, payload, {media: "binary"}, make)


def load(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds stored (the bytes of store(), null for other pictures), feature, tensors and problem.

    tensors holds each picture at full resolution as (height, width, rgb), rgb being
    its samples row by row. Null or empty media give nulls. A file that isn't
    progressive JPEG of one or three components, or that breaks off, gives nulls and
    what is wrong with it in problem, which is null otherwise. Columns with these
    names are replaced. An empty table gives an empty result.
    """

    def make(part):
        stored, features, tensors, problems = [], [], [], []
        for data in part.column(media).to_pylist():
            found, samples, own, problem = [], [], None, None
            try:
                found = pictures(data) if data else []
                if found and all(p.stored is not None for p in found):
                    own = b"".join(p.payload() for p in found)
                samples = [p.rgb() for p in found]
            except (ValueError, IndexError, KeyError, TypeError, AttributeError, struct.error, MemoryError) as e:
                found, own, problem = [], None, f"{type(e).__name__}: {e}"
            stored.append(own)
            features.append(feature(samples) if found else None)
            tensors.append([{"height": s.shape[0], "width": s.shape[1], "rgb": s.tobytes()} for s in samples] if found else None)
            problems.append(problem)
        kind = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))
        return [pa.array(stored, pa.binary()), pa.array(features, pa.string()), pa.array(tensors, kind), pa.array(problems, pa.string())]

    added = {"stored": "binary", "feature": "string", "tensors": "array<struct<height:int,width:int,rgb:binary>>", "problem": "string"}
    return _mapped(df, media, added, make)
