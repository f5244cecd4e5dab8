"""Compressed LAS: chunks, items and files there and back."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from cloudloom.sources import las, laz


def rows(kind, n, seed, extra=3):
    """Records as a scanner makes them: lines of small steps, several returns, four interleaved clocks, jumps, colours and grey."""
    r = random.Random(seed)
    out, x, y, z, clocks = [], 0, 0, 0, [r.uniform(0, 1e5) for _ in range(6)]
    rgb = [0, 0, 0]
    for i in range(n):
        x, y, z = x + r.randint(-50, 400), y + r.randint(-3, 3), z + r.randint(-20, 20)
        if r.random() < 0.02:
            x, y, z = (r.randint(-(1 << 31), (1 << 31) - 1) for _ in range(3))
        x, y, z = ((v + (1 << 31)) % (1 << 32) - (1 << 31) for v in (x, y, z))
        many = r.randint(0, 7)
        line = r.randrange(6)
        raw = struct.pack("<iiiHBBbBH", x, y, z, r.choice([0, 100, 65535, r.randrange(65536)]), r.randint(0, many) | many << 3 | r.randrange(4) << 6, r.choice([2, 2, 2, 5, 255]), r.choice([-90, 0, 1, 90]), r.choice([0, 0, 9]), line)
        if kind in (1, 3):
            clocks[line] += r.choice([0, 1e-5, 1e-5, 2e-5, 7e-5, -3e-5, 0.5, r.uniform(0, 3)])
            raw += struct.pack("<d", clocks[line] if r.random() < 0.97 else r.choice([0.0, -1e300, 1e18]))
        if kind in (2, 3):
            rgb = [r.randrange(256) << r.choice([0, 8])] * 3 if r.random() < 0.3 else [(v + r.randint(-9, 9)) % 65536 for v in rgb]
            raw += struct.pack("<HHH", *rgb)
        out.append(raw + bytes(r.choice([0, i & 255, r.randrange(256)]) for _ in range(extra)))
    return out


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
@pytest.mark.parametrize("extra", [0, 3])
def test_chunks_there_and_back(kind, extra):
    own = rows(kind, 3000, kind, extra)
    coding = laz.read_coding(laz.coding_record(laz.coding_of(kind, extra, 700)))
    length = len(own[0])
    assert coding.chunk_size == 700 and sum(s for _, s in coding.items) == length
    data = bytes(99) + laz.write_points(b"".join(own), length, coding, 99)
    read_at = lambda at, many: data[at : at + many]
    table = laz.chunk_table(read_at, 99, len(data), coding, len(own))
    assert [n for _, _, n in table] == [700] * 4 + [200]
    for i in (3, 0, 4, 1, 2):  # any order
        at, size, n = table[i]
        assert laz.read_chunk(data[at : at + size], n, coding) == b"".join(own[700 * i : 700 * i + n])


def test_steady_lines_shrink():
    raw = b"".join(struct.pack("<iiiHBBbBHd", 10 * i, 5 * i, 100, 40, 9, 2, 3, 0, 1, 1000 + i * 1e-5) for i in range(5000))
    coding = laz.coding_of(1, 0, 5000)
    packed = laz.write_points(raw, 28, coding, 0)
    assert len(packed) < len(raw) / 8
    assert laz.read_chunk(packed[8:], 5000, coding) == raw


@pytest.mark.parametrize("width, contexts", [(16, 4), (32, 2)])
def test_integers_are_whole_range(width, contexts):
    r = random.Random(width)
    low, high = (0, 1 << 16) if width == 16 else (-(1 << 31), 1 << 31)
    edge = [low, high - 1, low + 1, 0, 1]
    values = [(r.choice([*edge, r.randrange(low, high)]), r.choice([*edge, r.randrange(low, high)]), r.randrange(contexts)) for _ in range(4000)]
    e, w = laz.Encoder(), laz.Integers(width, contexts)
    for p, v, c in values:
        w.write(e, p, v, c)
    d, back = laz.Decoder(e.finish()), laz.Integers(width, contexts)
    assert [back.read(d, p, c) for p, _, c in values] == [v for _, v, _ in values]


def test_plain_bits_and_carries():
    """Without models the coder is long division, so a decoder can be written from its definition."""
    r = random.Random(4)
    numbers = [(n, r.choice([0, (1 << n) - 1, r.randrange(1 << n)])) for n in r.choices([1, 3, 8, 16, 24, 32], k=500)]
    e = laz.Encoder()
    for n, v in numbers:
        e.bits(n, v)
    data = e.finish()
    d = laz.Decoder(data)
    assert [d.bits(n) for n, _ in numbers] == [v for _, v in numbers]
    value, length, at = int.from_bytes(data, "big"), 0xFFFFFFFF, 8 * len(data) - 32
    for n, v in numbers:
        for part, own in ((16, v & 0xFFFF), (n - 16, v >> 16)) if n > 19 else ((n, v),):
            length >>= part
            assert value // (length << at) == own
            value -= own * (length << at)
            while length < 1 << 24:
                length, at = length << 8, at - 8


def test_median_of_five():
    """The window keeps five values sorted, and drops the largest or the smallest by where the last one went."""
    r, m = random.Random(1), laz.Median()
    window, drop_largest = [0] * 5, True
    for _ in range(500):
        x = r.randint(-9, 9)
        middle = window[2]
        window = sorted((window[:4] if drop_largest else window[1:]) + [x])
        drop_largest = x < middle if drop_largest else x <= middle
        m.add(x)
        assert m.v == window and m.drop_high == drop_largest


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_files_equal_plain_ones(spark, tmp_path, kind):
    from test_sources import points

    own = points(1000, kind)
    own["depth"] = np.linspace(0, 9, 1000).astype(np.float32)
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    las.write_file(str(tmp_path / "plain/a.las"), pa.table(own), {"point_format": kind})
    las.write_file(str(tmp_path / "packed/a.laz"), pa.table(own), {"point_format": kind, "compress": "true", "chunk": "150"})
    plain, packed = las.read_las(spark, str(tmp_path / "plain")).drop("file"), las.read_las(spark, str(tmp_path / "packed"), chunk=400).drop("file")
    assert packed.rdd.getNumPartitions() == 3 and plain.exceptAll(packed).isEmpty() and packed.count() == 1000
    h = las.read_headers(spark, str(tmp_path / "packed")).first()
    assert (h.n_points, h.point_format, h.extra) == (1000, kind, ["depth"])


def test_empty_and_unreadable_files(spark, tmp_path):
    las.write_file(str(tmp_path / "none.laz"), pa.table({"x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "z": pa.array([], pa.float64())}), {"compress": "true"})
    las.write_file(str(tmp_path / "two.laz"), pa.table({"x": [1.0, 2.0], "y": [1.0, 2.0], "z": [1.0, 2.0]}), {"compress": "true"})
    assert las.read_las(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="compressed"):
        las.write_file(str(tmp_path / "x.laz"), pa.table({"x": [1.0], "y": [1.0], "z": [1.0]}), {"compress": "true", "point_format": 6})
    raw = bytearray((tmp_path / "two.laz").read_bytes())
    at = raw.index(b"laszip encoded") - 2 + 54
    raw[at] = 3  # the layered coder
    (tmp_path / "layered.laz").write_bytes(bytes(raw))
    with pytest.warns(UserWarning, match="skipped"):
        assert len(las.headers(str(tmp_path))[0]) == 2


def test_headers_by_a_job(spark, tmp_path):
    for i in range(7):
        las.write_file(str(tmp_path / f"{i}.las"), pa.table({"x": [float(i)], "y": [0.0], "z": [0.0]}), {"compress": "false"})
    (tmp_path / "8.las").write_bytes(b"no header")
    with pytest.warns(UserWarning, match="skipped"):
        found, bad = las.scan_headers(spark, str(tmp_path), files_a_task=2)
    assert [h.low[0] for h in found] == [float(i) for i in range(7)] and [b[-5:] for b in bad] == ["8.las"]
    assert found == las.headers(str(tmp_path))[0]


def test_many_chunks_are_few_partitions(spark, tmp_path):
    """600 chunks of 2 points, each decoded on its own, in some 256 tasks at most; points keep their places."""
    for name in "ab":
        las.write_file(str(tmp_path / f"{name}.laz"), pa.table({"x": np.arange(600.0), "y": np.zeros(600), "z": np.zeros(600)}), {"compress": "true", "chunk": "2"})
    back = las.read_las(spark, str(tmp_path), chunk=2)
    assert back.rdd.getNumPartitions() <= 256
    assert sorted((r.file, r.point_idx, round(r.x, 3)) for r in back.select("file", "point_idx", "x").collect()) == [(f"{f}.laz", i, float(i)) for f in "ab" for i in range(600)]
