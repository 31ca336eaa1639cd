import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoploom.llm import media, queries


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=1500), st.sampled_from([b"", b"\xff" * 200, b"\0" * 500]))
def test_bytes_come_back(head, tail):
    data = head + tail
    data += bytes(-len(data) % 64)
    found = media.pictures(media.write(data))
    assert b"".join(p.payload() for p in found) == data


def test_long_payload_takes_several_pictures(monkeypatch):
    monkeypatch.setattr(media, "MOST_UNITS", 3)
    data = bytes(range(256)) * 20
    found = media.pictures(media.write(data))
    assert len(found) == 5
    assert b"".join(p.payload() for p in found) == data


class Pen:
    """A plain bit-by-bit writer, after the standard's flow charts."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def symbol(self, s):
        self.put(s, 8) if s < 255 else self.put(255 << 1, 9)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


def shrink(v, low):
    return v >> low if v >= 0 else -(-v >> low)


def draw(coefs, interval=0):
    """One component, blocks in a row; a table whose symbols 0..254 have 8 bits, as no code is all ones."""
    n = len(coefs)
    table = bytes([0] * 7 + [255] + [1] + [0] * 7) + bytes(range(256))
    out = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes(range(1, 65)))
    out += media._segment(0xC2, struct.pack(">BHHB", 8, 8, 8 * n, 1) + bytes([1, 0x11, 0]))
    out += media._segment(0xC4, b"\x00" + table) + media._segment(0xC4, b"\x10" + table)
    if interval:
        out += media._segment(0xDD, struct.pack(">H", interval))
    for ss, se, high, low in [(0, 0, 0, 1), (1, 20, 0, 2), (21, 63, 0, 1), (0, 0, 1, 0), (1, 20, 2, 1), (1, 63, 1, 0)]:
        out += media._scan([(1, 0, 0)], ss, se, high, low)
        for i, at in enumerate(range(0, n, interval or n)):
            pen, before, run, held = Pen(), 0, 0, []

            def flush():
                nonlocal run, held
                if run:
                    size = run.bit_length() - 1
                    pen.symbol(size << 4)
                    pen.put(run - (1 << size), size)
                    pen.bits += held
                    run, held = 0, []

            for row in coefs[at : at + (interval or n)]:
                if ss == 0:
                    if high:
                        pen.put(int(row[0]) & 1, 1)
                        continue
                    d, before = (int(row[0]) >> low) - before, int(row[0]) >> low
                    size = abs(d).bit_length()
                    pen.symbol(size)
                    pen.put(d if d >= 0 else d + (1 << size) - 1, size)
                    continue
                now = [shrink(int(v), low) for v in row]
                new = [k for k in range(ss, se + 1) if now[k] and (not high or abs(now[k]) == 1)]
                k, zeros, fix = ss, 0, []
                last = max(new, default=0)
                while k <= last:
                    v = now[k]
                    if not v:
                        zeros += 1
                        if zeros == 16:
                            flush()
                            pen.symbol(0xF0)
                            pen.bits += fix
                            zeros, fix = 0, []
                    elif high and abs(v) > 1:
                        fix.append(abs(v) & 1)
                    else:
                        flush()
                        size = abs(v).bit_length()
                        pen.symbol(zeros << 4 | size)
                        pen.put(v if v > 0 else v + (1 << size) - 1, size)
                        pen.bits += fix
                        zeros, fix = 0, []
                    k += 1
                rest = fix + [abs(now[j]) & 1 for j in range(k, se + 1) if high and abs(now[j]) > 1]
                if last < se:
                    run, held = run + 1, held + rest
                else:
                    flush()
            flush()
            out += (struct.pack("BB", 0xFF, 0xD0 + (i - 1) % 8) if i else b"") + pen.data()
    return out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 3])
@pytest.mark.parametrize("density", [0.0, 0.05, 0.4, 1.0])
def test_general_scans(density, interval):
    rng = np.random.default_rng(int(density * 100) + interval)
    coefs = np.where(rng.random((11, 64)) < density, rng.integers(-200, 200, (11, 64)), 0)
    coefs[:, 0] = rng.integers(-500, 500, 11)
    picture = media.Picture(draw(coefs, interval))
    assert (picture.parts[0].coefs == coefs).all()
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    square = np.zeros((11, 64))
    square[:, media.ZIGZAG] = coefs * np.arange(1, 65)
    want = np.einsum("ux,vy,nuv->nxy", c, c, square.reshape(11, 8, 8)) + 128
    got = picture.rgb()[..., 0].reshape(8, 11, 8).swapaxes(0, 1)
    assert np.abs(got - np.clip(np.rint(want), 0, 255)).max() <= 1


def test_chroma_is_upsampled():
    picture = media.pictures(media.write(bytes(64 * 4) + bytes([200] + [0] * 63) + bytes(64)))[0]
    assert picture.rgb().shape == (16, 16, 3)
    assert picture.parts[1].coefs.shape == (1, 64)


def test_operator_on_odd_rows(spark):
    rows = [(1, bytes(64), "a"), (2, None, None), (3, bytes(range(64)) * 40, "x"), (3, bytes(range(64)) * 40, "x")]
    df = spark.createDataFrame(rows, "k int, payload binary, feature string")
    got = media.load(media.store(df)).orderBy("k").collect()
    assert [r.stored and bytes(r.stored) for r in got] == [r[1] for r in rows]
    assert got[1].feature is None and got[1].media is None
    assert got[2] == got[3]
    t = got[2].tensors[0]
    assert len(t.rgb) == t.height * t.width * 3
    assert media.load(media.store(df.limit(0))).count() == 0


def test_broken_files_give_a_reason(spark):
    fine = media.write(bytes(range(64)) * 9)
    frame = fine.index(b"\xff\xc2")
    four = fine[:frame] + media._segment(0xC2, struct.pack(">BHHB", 8, 16, 16, 4) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0, 4, 0x11, 0])) + fine[frame + 19 :]
    huge = fine[: frame + 5] + struct.pack(">HH", 65_535, 65_535) + fine[frame + 9 :]
    rows = [fine, b"", None, b"no picture", fine[:-40], fine[: len(fine) // 2], fine + b"rest", four, huge, b"\xff\xd8" * 3]
    got = media.load(spark.createDataFrame([(i, r, 1, "x") for i, r in enumerate(rows)], "i int, media binary, tensors int, problem string")).orderBy("i").collect()
    assert [r.problem is None for r in got] == [True, True, True] + [False] * 7
    assert got[0].tensors and got[0].stored
    assert all(r.tensors is None and r.stored is None and r.feature is None for r in got[1:])


def test_chroma_of_any_sampling():
    """Three luma blocks for two of chroma: every pixel takes the sample that it falls on."""
    table = media._table(0, 0, [4] * 9, bytes(range(9)))
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\1" * 64) + media._segment(0xC2, struct.pack(">BHHB", 8, 8, 24, 3) + bytes([1, 0x31, 0, 2, 0x21, 0, 3, 0x11, 0])) + table
    dc = np.array([0, 0, 0, 80, -80, 40], np.int32)  # three of luma, two of cb, one of cr
    values = dc.copy()
    values[4] -= 80
    bits = np.concatenate([media._dc_bits(np.array([v]), np.array([0])) for v in values])
    picture = media.Picture(head + media._scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 0) + media._stuffed(bits) + b"\xff\xd9")
    assert [c.coefs[:, 0].tolist() for c in picture.parts] == [[0, 0, 0], [80, -80], [40]]
    rgb = picture.rgb().astype(int)
    assert rgb.shape == (8, 24, 3)
    assert rgb[0, :, 2].tolist() == [128 + 18] * 12 + [128 - 18] * 12  # 1.772 * 10, and so back


def test_query(spark, tmp_path):
    texts = [None, "", "été" * 100, "x" * 64, "é" * 9000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op8_media(spark, str(tmp_path)).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(media.write(padded)).hexdigest()
        rgb = [p.rgb() for p in media.pictures(media.write(padded))]
        assert r.tensor_bytes == sum(t.size for t in rgb) and r.tensor_sha256 == ",".join(hashlib.sha256(t.tobytes()).hexdigest() for t in rgb)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 1000])
def test_cells_of_nine_bits_without_taking_bits_apart(n):
    values = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    values[: n // 2] = 255
    cells = np.zeros((n, 9), np.uint8)
    cells[:, 1:] = np.unpackbits(values[:, None], axis=1)
    packed = media._nines(values)
    assert packed == media._stuffed(cells.reshape(-1))
    raw = np.frombuffer(packed.replace(b"\xff\x00", b"\xff"), np.uint8)
    assert media._cells_of_nine(raw, n).tolist() == values.tolist()


def test_tables_are_worked_out_once():
    counts, symbols = bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))
    value, length, step = media._lookup(counts, symbols)
    assert media._lookup(counts, symbols)[2] is step
    assert (step == np.where(length > 0, length + value, -1)).all() and step.min() == -1
