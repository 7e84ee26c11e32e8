import math
import struct
import tempfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from orthomill.operators import coordinates, losses
from orthomill.operators.basis import Basis, apply_steps, baseline_recovered, cosine_steps
from orthomill.plans import catalogue
from orthomill.plans.images import chosen, gaussian, grey, mosaics, pixels, synthetic, vectors
from orthomill.sources import files
from orthomill.sources.png import read_pictures
from orthomill.streaming.compress import compress_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    clean = lambda v: round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v
    return sorted(tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and all(x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b))


def test_entry_and_registry(spark):
    assert registry.entry(spark).count() == 3000
    assert set(registry.oracle_sql()) <= set(registry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_transforms_need_no_shuffle(spark, sf):
    low = catalogue.QFT.compress(vectors(spark, sf), ratio=0.9)
    plan = plan_of(catalogue.QFT.recover(low))
    assert "Exchange" not in plan and plan.count("MapInArrow") == 2 and plan.count("FileScan") == 1


@pytest.mark.parametrize("name,passes", [("qft_topk", 1), ("fft_baseline", 1), ("topk_freq_weighted", 2), ("compress_ratio", 1), ("compression_stats", 1), ("recover_metrics_by_label", 2), ("best_label_by_ratio", 2), ("mse_loss", 1)])
def test_one_scan_and_one_transform_per_query(spark, sf, name, passes):
    plan = plan_of(catalogue.QUERIES[name](spark, sf))
    final = plan.split("Initial Plan")[0] if "Initial Plan" in plan else plan
    assert final.count("FileScan") == 1 and final.count("MapInArrow") == passes and "array_sort" not in final


def test_recover_rejects_another_basis(spark, sf):
    low = catalogue.QFT.compress(vectors(spark, sf).limit(3), ratio=0.5)
    with pytest.raises(Exception, match="another basis"):
        Basis.make("tebd", 3, 3).recover(low).collect()


@pytest.mark.parametrize("m,n,family", [(5, 5, "eqft"), (9, 9, "qft"), (4, 6, "tebd")])
def test_larger_pictures_equal_numpy(spark, m, n, family):
    """By row and by coordinates, against the circuit's matrices; kept coefficients and the recovered picture."""
    rng = np.random.default_rng(m)
    basis = Basis.make(family, m, n, None if family == "qft" else tuple(rng.normal(size=5 if family == "eqft" else m + n)), "middle")
    x = rng.normal(size=(2, 2**m, 2**n))
    df = spark.createDataFrame([(i, [float(v) for v in p.ravel(order="F")]) for i, p in enumerate(x)], "img_id long, re array<double>")
    want = np.array([circuit_forward(basis, p).ravel(order="F") for p in x])
    got = basis.forward(df, real=True).orderBy("img_id").toPandas()
    assert np.allclose(np.stack(got["re"]) + 1j * np.stack(got["im"]), want, atol=1e-9)
    low = basis.compress(df, ratio=0.9)
    places = np.argsort(-np.round(np.abs(want), 9), axis=1, kind="stable")[:, : round(0.1 * basis.size)]
    assert [list(r.indices) for r in low.orderBy("img_id").collect()] == (places + 1).tolist()
    kept = np.zeros_like(want)
    np.put_along_axis(kept, places, np.take_along_axis(want, places, 1), 1)
    back = np.stack(basis.recover(low).orderBy("img_id").toPandas()["re"])
    for i, y in enumerate(kept):
        for kind, k in basis.steps(inverse=True):
            z = y.reshape(2**m, 2**n, order="F")
            y = (k @ z if kind == "row" else z @ k.T if kind == "col" else k * z).ravel(order="F")
        assert np.allclose(back[i], y.real, atol=1e-9)
    rows = coordinates.transform(pixels(df, "img_id"), basis).toPandas()
    out = np.zeros_like(want)
    out[rows["id"], rows["lin"]] = rows["re"] + 1j * rows["im"]
    assert len(rows) == want.size and np.allclose(out, want, atol=1e-9)


def circuit_forward(basis, x):
    for kind, k in basis.steps():
        x = k @ x if kind == "row" else x @ k.T if kind == "col" else k * x
    return x


def test_null_and_wrong_images(spark):
    schema = "vec_id long, re array<double>"
    df = spark.createDataFrame([(1, None), (2, [1.0] * 16), (3, None)], schema)
    basis = Basis.make("qft", 2, 2)
    got = {r.vec_id: r for r in basis.compress(df, k=2).collect()}
    assert got[1].indices is None and got[3].values_real is None and list(got[2].indices) == [1, 2]
    assert [r.re is None for r in basis.recover(basis.compress(df, k=2)).orderBy("vec_id").collect()] == [True, False, True]
    assert basis.forward(spark.createDataFrame([], schema), real=True).count() == 0
    with pytest.raises(Exception, match="16 values"):
        basis.forward(spark.createDataFrame([(1, [1.0] * 15)], schema), real=True).collect()
    with pytest.raises(Exception, match="outside"):
        coordinates.transform(spark.createDataFrame([(1, 99, 1.0, 0.0)], "id long, lin long, re double, im double"), basis).collect()
    one = coordinates.transform(spark.createDataFrame([(None, 0, 4.0, 0.0)], "id long, lin long, re double, im double"), basis).toPandas()
    assert np.allclose(one["re"], 1.0) and len(one) == 16


def test_baselines_and_similarity(spark):
    rng = np.random.default_rng(3)
    x = rng.random((8, 8))
    df = spark.createDataFrame([(1, [float(v) for v in x.ravel(order="F")])], "vec_id long, re array<double>").withColumn("x", F.col("re"))
    whole = apply_steps(apply_steps(df, cosine_steps(3, 3), 3, 3, im=None), cosine_steps(3, 3, inverse=True), 3, 3).first()
    assert np.allclose(whole.re, x.ravel(order="F"))
    for kind in ("fft", "dct"):
        errors = [losses.picture_metrics(baseline_recovered(df, 3, 3, r, kind), "x", "re").first().mse for r in (0.0, 0.5, 0.9)]
        assert errors[0] < 1e-12 and errors[0] < errors[1] < errors[2]
    assert losses.similarity(df, "x", "re", 8, 8).first().ssim == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown loss"):
        losses.image_loss(df, catalogue.QFT, "huber")
    assert losses.image_loss(df, catalogue.QFT, "mse", 6).first().loss == pytest.approx(losses.mse_loss(df, catalogue.QFT, 6).first().loss)


def test_made_up_and_chosen_pictures(spark):
    a, b = (np.stack(synthetic(spark, 3, 4, 5).orderBy("img_id").toPandas()["re"]) for _ in range(2))
    assert a.shape == (3, 512) and np.array_equal(a, b) and a.min() >= 0 and a.max() <= 1 and not np.array_equal(a[0], a[1])
    g = gaussian(spark, 4, 5, 5).toPandas()
    z = np.stack(g["re"]) + 1j * np.stack(g["im"])
    assert abs(z.mean()) < 0.05 and abs(np.std(z.real) - 0.5**0.5) < 0.05 and abs(np.corrcoef(z.real.ravel(), z.imag.ravel())[0, 1]) < 0.05
    picked = [sorted(r.id for r in chosen(spark.range(100), "id", 5, seed).collect()) for seed in (1, 1, 2)]
    assert picked[0] == picked[1] != picked[2] and len(picked[2]) == 5
    assert spark.range(1).select(grey(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("g")).first().g == pytest.approx(0.299 + 0.587 / 2)


def png(x, kind, filters):
    """A PNG file of the samples (height, width, channels), each line with a filter of its own."""
    h, w, c = x.shape
    lines, above = [], np.zeros(w * c, int)
    for y in range(h):
        f, line = filters[y % len(filters)], x[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(c, int), line])[: w * c], np.concatenate([np.zeros(c, int), above])[: w * c]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append(bytes([f]) + bytes(((line - [0, left, above, (left + above) // 2, near][f]) % 256).tolist()))
        above = line
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def test_pictures_from_files(spark, tmp_path):
    rng = np.random.default_rng(9)
    rgb, grey_scale = rng.integers(0, 256, (10, 9, 3)), rng.integers(0, 256, (8, 8, 1))
    (tmp_path / "a.png").write_bytes(png(rgb, 2, [0, 1, 2, 3, 4]))
    (tmp_path / "b.png").write_bytes(png(grey_scale, 0, [4, 2]))
    (tmp_path / "c.png").write_bytes(b"no picture")
    (tmp_path / "d.png").write_bytes(png(rng.integers(0, 256, (4, 4, 1)), 0, [0]))
    (tmp_path / "e.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.re for r in read_pictures(spark, str(tmp_path), 3, 3).collect()}
    want = (rgb @ np.array([0.299, 0.587, 0.114]) / 255)[1:9, 0:8]
    assert got.keys() == {"a.png", "b.png", "c.png", "d.png"} and got["c.png"] is None and got["d.png"] is None
    assert np.allclose(got["a.png"], want.ravel(order="F")) and np.allclose(got["b.png"], grey_scale[..., 0].ravel(order="F") / 255)


def test_compressed_files_carry_their_version(spark, sf, tmp_path):
    low = catalogue.QFT.compress(vectors(spark, sf).limit(4), ratio=0.75)
    path = files.write_compressed(low, str(tmp_path / "low"))
    row = files.read_compressed(spark, path).first()
    assert (row.version, row.num_coefficients, row.compression_ratio) == ("1.0", 16, 0.75) and len(row.indices) == 16
    files.with_metadata(low).withColumn("version", F.lit("0.9")).write.json(str(tmp_path / "old"))
    with pytest.warns(UserWarning, match="0.9"):
        files.read_compressed(spark, str(tmp_path / "old"))
    for i in range(2):
        files.append_results(spark.createDataFrame([(f"q{i}", 1.5)], "name string, seconds double"), str(tmp_path / "bench"))
    assert spark.read.json(str(tmp_path / "bench")).count() == 2


def test_json_roundtrip_and_files(spark, sf):
    assert catalogue.QUERIES["json_roundtrip"](spark, sf).count() == 500 * 64
    for basis in (Basis.make("qft", 2, 3), Basis.make("eqft", 2, 2, (0.1, 0.2), "middle"), Basis.make("tebd", 3, 3, (0.1,) * 6), Basis.make("mera", 2, 2, (0.1,) * 4)):
        path = files.save_basis(basis, f"{tempfile.mkdtemp()}/b.json")
        again = files.load_basis(path)
        assert again == basis and again.basis_hash() == basis.basis_hash()
    legacy = files.basis_to_dict(Basis.make("eqft", 2, 2, (0.1, 0.2))) | {"entangle_position": None}
    assert files.dict_to_basis(legacy).position == "back"
    with pytest.warns(UserWarning):
        files.dict_to_basis(files.basis_to_dict(Basis.make("qft", 2, 2)) | {"hash": "0"})


def test_training_query(spark, sf):
    out = catalogue.QUERIES["train_qft"](spark, sf).toPandas()
    assert list(out["epoch"]) == [1, 2, 3] and out["train_loss"].map(math.isfinite).all()


@pytest.mark.parametrize("name", ["adam_64x64", "gd_64x64"])
def test_large_pictures_are_fitted(spark, sf, name):
    trace = catalogue.QUERIES[name](spark, sf).orderBy("step").toPandas()["loss"].to_numpy()
    assert len(trace) == 11 and trace[-1] < trace[0]
    # the untrained basis is an inverse Fourier transform of pixels in bit-reversed order
    x = np.stack(mosaics(vectors(spark, sf)).toPandas()["re"]).reshape(-1, 64, 64)
    turned = [int(f"{i:06b}"[::-1], 2) for i in range(64)]
    x = x[:, turned][:, :, turned]
    power = np.sort(np.abs(np.fft.ifft2(x, norm="ortho").reshape(len(x), -1)) ** 2, axis=1)
    assert trace[0] == pytest.approx(power[:, :-409].sum(axis=1).mean())


def test_stream_compresses(spark, sf):
    folder = tempfile.mkdtemp()
    vectors(spark, sf).limit(20).write.parquet(folder + "/in")
    stream = spark.readStream.schema("vec_id long, label int, re array<double>").parquet(folder + "/in")
    q = compress_stream(stream, catalogue.QFT).writeStream.format("memory").queryName("low").option("checkpointLocation", folder + "/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT indices FROM low").toPandas()
    assert len(got) == 20 and all(len(x) == 6 for x in got["indices"])
    assert np.all([len(set(x)) == 6 for x in got["indices"]])
