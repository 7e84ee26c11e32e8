"""Array files and PNG pictures: every kind, against plain encoders, and damaged files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.operators import training
from orthomill.sources import arrays, png


def encoded(x, kind, depth, interlaced=False, palette=None, filters=(0,)):
    """A PNG file of the samples (height, width, channels)."""
    h, w, c = x.shape
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    step, body, number = max(1, c * depth // 8), b"", 0
    grids = [(0, 0, 1, 1)] if not interlaced else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    for x0, y0, dx, dy in grids:
        sub = x[y0::dy, x0::dx]
        if not sub.size:
            continue
        above = None
        for row in sub:
            bits = "".join(f"{v:0{depth}b}" for v in row.ravel().tolist())
            line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            above = above or [0] * len(line)
            kind_of, out = filters[number % len(filters)], []
            for i, v in enumerate(line):
                a, b, q = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - q
                nearest = a if abs(p - a) <= min(abs(p - b), abs(p - q)) else b if abs(p - b) <= abs(p - q) else q
                out.append((v - [0, a, b, (a + b) // 2, nearest][kind_of]) % 256)
            body += bytes([kind_of, *out])
            above, number = line, number + 1
    extra = part(b"PLTE", bytes(palette.ravel().tolist())) if palette is not None else b""
    return png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(interlaced))) + extra + part(b"tEXt", b"k\0v") + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kind,depth", [(k, d) for k, depths in png.DEPTHS.items() for d in depths])
def test_every_kind_of_png(kind, depth, interlaced):
    rng = np.random.default_rng(kind * 20 + depth)
    for h, w in ((1, 1), (3, 2), (9, 13), (16, 8)):
        x = rng.integers(0, 2**depth, (h, w, png.CHANNELS[kind]))
        palette = rng.integers(0, 256, (2**depth, 3)) if kind == 3 else None
        got = png.decode_png(encoded(x, kind, depth, interlaced, palette, [4, 0, 1, 2, 3]))
        colours = palette[x[..., 0]] / 255 if kind == 3 else x / (2**depth - 1)
        want = colours[..., :3] @ [0.299, 0.587, 0.114] if colours.shape[2] >= 3 else colours[..., 0]
        assert got.shape == (h, w) and np.allclose(got, want)


def test_damaged_pictures_say_why(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (8, 8, 1))
    whole = encoded(x, 0, 8)
    crc = bytearray(whole)
    crc[40] ^= 1
    files = {"good": whole, "text": b"no picture", "cut": whole[:-30], "crc": bytes(crc), "small": encoded(x[:4], 0, 8), "depth": encoded(x % 8, 0, 3), "palette": encoded(x, 3, 8, palette=np.zeros((2, 3), int)), "sixteen": encoded(x * 257, 0, 16, True)}
    for name, data in files.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in png.read_pictures(spark, str(tmp_path), 3, 3).collect()}
    assert got.keys() == files.keys()
    for name, r in got.items():
        assert (r.re is None) == (r.error is not None) == (name not in ("good", "sixteen")), name
    assert np.allclose(got["good"].re, (x[..., 0] / 255).ravel(order="F")) and np.allclose(got["sixteen"].re, got["good"].re)
    pictures = png.read_pictures(spark, str(tmp_path), 3, 3).filter("re is not null")
    done = training.train(pictures, "qft", 3, 3, epochs=1, id_col="path", batch_size=1, split=0.0)
    assert len(done.steps) == 2


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(arrays.ArrayFiles)
    return spark


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">i2", "u1", "?", "<c16", "<c8"])
def test_npy_files_by_ranges(session, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = (rng.integers(0, 2 if kind == "?" else 100, (50, 4, 3)) * (1 + 2j if "c" in kind else 1)).astype(kind)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", x[:7] if kind != "u1" else x[:0])
    (tmp_path / "_skipped").write_bytes(b"x")
    df = session.read.format("arrays").option("bytesPerPartition", 20 * x[0].nbytes).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 + (kind != "u1") and df.columns == ["file", "record", "re"] + ["im"] * ("c" in kind)
    rows = {(r.file.rsplit("/", 1)[1], r.record): r for r in df.collect()}
    assert len(rows) == 50 + (0 if kind == "u1" else 7)
    for (name, i), r in rows.items():
        flat = x[i].flatten(order="F")
        assert np.allclose(r.re, flat.real) and ("c" not in kind or np.allclose(r.im, flat.imag))
    assert session.read.format("arrays").schema("record long").load(str(tmp_path / "a.npy")).agg(F.sum("record")).first()[0] == sum(range(50))
    with pytest.raises(Exception, match="no column"):
        session.read.format("arrays").schema("colour long").load(str(tmp_path)).collect()


def test_idx_files(session, tmp_path):
    x = np.arange(60, dtype=">i4").reshape(5, 3, 4)
    (tmp_path / "a.idx").write_bytes(bytes([0, 0, 0x0C, 3]) + struct.pack(">3I", *x.shape) + x.tobytes())
    got = sorted(session.read.format("arrays").option("bytesPerPartition", 50).load(str(tmp_path)).collect(), key=lambda r: r.record)
    assert len(got) == 5 and all(np.allclose(r.re, x[i].flatten(order="F")) for i, r in enumerate(got))


@pytest.mark.parametrize("data", [b"junk", arrays.NPY_MAGIC + b"\x01\x00" + struct.pack("<H", 60) + b"{'descr': '<f8', 'fortran_order': False, 'shape': (9,)}     \n", bytes([0, 0, 0x0D, 1]) + struct.pack(">I", 4)])
def test_files_that_are_no_arrays(session, tmp_path, data):
    (tmp_path / "x.npy").write_bytes(data)
    with pytest.raises(Exception, match="no array file|ends early"):
        session.read.format("arrays").load(str(tmp_path)).collect()


def test_array_files_are_written(session, tmp_path):
    df = session.createDataFrame([(i, [float(i), 0.5, -1.0], [0.0, float(i), 2.0]) for i in range(40)], "id long, re array<double>, im array<double>").repartition(3)
    for columns in (["re"], ["re", "im"]):
        for _ in range(2):
            df.select(*columns).write.format("arrays").mode("overwrite").save(str(tmp_path / columns[-1]))
        back = session.read.format("arrays").load(str(tmp_path / columns[-1])).select(*columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select(*columns).collect()))
    whole = sum(len(np.load(p)) for p in (tmp_path / "im").glob("*.npy"))
    assert whole == 40
    for bad in ([(1, [1.0, None])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(Exception, match="null|one length"):
            session.createDataFrame(bad, "id long, re array<double>").coalesce(1).select("re").write.format("arrays").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.npy")) or all(p.name.startswith("_") for p in (tmp_path / "bad").glob("*.npy"))
