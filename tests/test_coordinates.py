"""Pictures as coordinate rows: selection, recovery, gradients and training, against numpy and the array code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.operators import circuits, coordinates, losses, training
from orthomill.operators.basis import Basis, keep_count, ranking, sizes_of
from orthomill.plans.images import gaussian
from orthomill.sources.tables import written

ROWS = "id long, lin long, re double, im double"
PHASES = (0.3, -0.5, 0.8, 0.2)
BASES = [Basis.make("qft", 3, 2), *[Basis.make("eqft", 3, 4, PHASES[:3], p) for p in ("front", "middle", "back")], Basis.make("eqft", 4, 2, PHASES[:2], "middle"), Basis.make("tebd", 2, 3, (*PHASES, 0.1)), Basis.make("mera", 2, 4, tuple(0.1 * i for i in range(8)))]
NAMES = [f"{b.family}-{b.position}-{b.m}x{b.n}" for b in BASES]


def as_rows(spark, x):
    """Complex pictures, a row each, as coordinate rows without the zeros."""
    rows = [(i, j, float(v.real), float(v.imag)) for i, p in enumerate(x) for j, v in enumerate(p) if v]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def as_pictures(df, n, size):
    out = np.zeros((n, size), complex)
    for r in df.collect():
        out[r.id, r.lin] += r.re + 1j * r.im
    return out


def pictures(n, size, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size)) + 1j * rng.standard_normal((n, size))
    x[:, rng.integers(0, size, size // 4)] = 0
    return x


@pytest.mark.parametrize("basis", BASES, ids=NAMES)
def test_compressed_rows_come_back(spark, basis):
    x = pictures(3, basis.size)
    full = circuits.run_gates(list(basis.gates), x.T, basis.m + basis.n).T
    k = keep_count(basis.size, 0.7)
    kept = np.zeros_like(full)
    places = ranking(sizes_of(full), k)
    np.put_along_axis(kept, places, np.take_along_axis(full, places, 1), 1)
    low = written(coordinates.compress(as_rows(spark, x), basis, ratio=0.7))
    assert low.count() == 3 * k and np.allclose(as_pictures(low, 3, basis.size), kept)
    matrix = circuits.run_gates(list(basis.gates), np.eye(basis.size), basis.m + basis.n)
    assert np.allclose(as_pictures(coordinates.recover(low, basis), 3, basis.size), kept @ matrix.conj())
    other = Basis.make("qft", basis.m, basis.n) if basis.family != "qft" else Basis.make("tebd", basis.m, basis.n)
    with pytest.raises(Exception, match="another basis"):
        coordinates.recover(low, other).collect()


@pytest.mark.parametrize("family", ["qft", "eqft", "mera"])
def test_pictures_of_512(spark, family):
    """One sparse picture of 512 x 512 (or 16 x 256 in the hierarchy) against the matrices."""
    m, n = (9, 9) if family != "mera" else (4, 8)
    phases = None if family == "qft" else tuple(np.random.default_rng(1).standard_normal(9 if family == "eqft" else len(Basis.make("mera", m, n).phases)))
    basis = Basis.make(family, m, n, phases, "middle")
    h, w = basis.image_size
    rng = random.Random(3)
    x = np.zeros((h, w), complex)
    for _ in range(300):
        x[rng.randrange(h), rng.randrange(w)] = complex(rng.random(), rng.random())
    r, c, mask, place = circuits.separated(list(basis.gates), m, n)
    y = r @ x
    y = (y if mask is None or place != "middle" else y * mask) @ c.T
    full = y.flatten(order="F")
    low = written(coordinates.compress(as_rows(spark, [x.flatten(order="F")]), basis, k=2000))
    places = ranking(sizes_of(full[None]), 2000)[0]
    got = {q.lin: complex(q.re, q.im) for q in low.collect()}
    cut = np.abs(full[places[-1]])
    assert len(got) == 2000 and all(abs(full[p] - v) < 1e-9 for p, v in got.items()) and all(p in got for p in places if abs(full[p]) > cut + 1e-8)
    back = coordinates.recover(low, basis)
    kept = np.zeros(h * w, complex)
    kept[list(got)] = list(got.values())
    z = kept.reshape(h, w, order="F") @ c.conj()
    z = r.conj().T @ (z if mask is None or place != "middle" else z * mask.conj())
    assert np.allclose(as_pictures(back, 1, h * w)[0], z.flatten(order="F"))


def test_largest_with_many_equal_sizes(spark, monkeypatch):
    monkeypatch.setattr(coordinates, "RANKED", 50)
    monkeypatch.setattr(coordinates, "BINS", 7)
    rng = random.Random(2)
    rows = [(i, lin, float(rng.choice([1, 2, 3, 3, 3, -3, 1000])), 0.0) for i in (1, 2) for lin in rng.sample(range(5000), 900)] + [(3, 5, 1.0, 0.0), (3, 2, -1.0, 0.0)] + [(None, lin, 4.0, 3.0) for lin in range(300)]
    got = coordinates.largest(written(spark.createDataFrame(rows, ROWS).repartition(3)), 400).collect()
    want = set()
    for i in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == i), key=lambda r: (-abs(complex(r[2], r[3])), r[1]))
        want |= set(mine[:400])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = coordinates.largest(written(spark.createDataFrame([], ROWS)), 3)
    assert none.count() == 0
    with pytest.raises(ValueError):
        coordinates.largest(none, 0)


@pytest.mark.parametrize("basis", BASES, ids=NAMES)
def test_gradient_is_that_of_arrays(spark, basis):
    x = pictures(4, basis.size, 7)
    k = basis.size // 4
    total, grads = training.loss_and_gradient(list(basis.gates), x.T, basis.m + basis.n, "mse", k)
    loss, y, kept = coordinates.loss_and_kept(as_rows(spark, x), basis, k)
    assert loss == pytest.approx(total / 4)
    for a, b in zip(coordinates.gradient(y, kept, basis), grads, strict=True):
        assert np.allclose(a, b / 4)


@pytest.mark.parametrize("kind", ["adam", "gd"])
def test_training_takes_the_same_steps(spark, kind):
    basis, x = Basis.make("eqft", 2, 3, (0.4, 0.2), "front"), pictures(5, 32, 3)
    arrays = spark.createDataFrame([(i, p.real.tolist(), p.imag.tolist()) for i, p in enumerate(x)], "img_id long, re array<double>, im array<double>")
    one, trace = training.optimize(arrays, basis, training.Optimizer(kind, 0.05), k=6, max_iter=2, tol=0.0)
    two, other = coordinates.optimize(as_rows(spark, x), basis, training.Optimizer(kind, 0.05), k=6, max_iter=2, tol=0.0)
    assert np.allclose(trace, other) and trace[-1] < trace[0]
    assert all(np.allclose(a, b) for a, b in zip(one.tensors, two.tensors))


def moved(basis, seed):
    """A basis of the same shape whose gates are elsewhere on their manifolds."""
    rng = np.random.default_rng(seed)
    turn = lambda g: g.matrix @ np.linalg.qr(rng.standard_normal((2, 2)) + 1j * rng.standard_normal((2, 2)))[0] if g.role == "h" else g.matrix * np.exp(1j * rng.random((2, 2)))
    return Basis(basis.family, basis.m, basis.n, tuple(circuits.Gate(g.role, g.qubits, turn(g), g.entangling) for g in basis.gates), basis.position)


@pytest.mark.parametrize("basis", [BASES[i] for i in (1, 2, 5)], ids=[NAMES[i] for i in (1, 2, 5)])
def test_circuits_are_evaluated_together(spark, basis):
    """Losses of several circuits by the same jobs, entangled before, between or behind the products, and of a picture without an id."""
    x, k, bases = pictures(4, basis.size, 5), basis.size // 4, [basis, moved(basis, 1), moved(basis, 2)]
    rows = as_rows(spark, x).withColumn("id", F.when(F.col("id") != 3, F.col("id")))
    want = [training.loss_and_gradient(list(b.gates), x.T, basis.m + basis.n, "mse", k, False)[0] / 4 for b in bases]
    assert np.allclose(coordinates.losses_of_each(rows, bases, k), want) and len({round(v, 6) for v in want}) == 3
    assert coordinates.losses_of_each(rows.limit(0), bases[:2], k) == [0.0, 0.0]


def test_a_line_search_shares_jobs(spark, monkeypatch):
    """Ten tries that all fail are evaluated in three parts after the step's own loss, and the last loss is not measured again."""
    basis, x, calls = Basis.make("eqft", 2, 3, (0.4, 0.2), "middle"), pictures(3, 32, 3), []
    arrays = spark.createDataFrame([(i, p.real.tolist(), p.imag.tolist()) for i, p in enumerate(x)], "img_id long, re array<double>, im array<double>")
    _, trace = training.optimize(arrays, basis, training.Optimizer("gd", 0.05, armijo=1e9), k=6, max_iter=1, tol=0.0)
    transformed = coordinates.transformed
    monkeypatch.setattr(coordinates, "transformed", lambda rows, bases, deal: calls.append(len(bases)) or transformed(rows, bases, deal))
    _, other = coordinates.optimize(as_rows(spark, x), basis, training.Optimizer("gd", 0.05, armijo=1e9), k=6, max_iter=1, tol=0.0)
    assert np.allclose(trace, other) and calls == [1, 1, 3, 6]


def test_complex_pictures_train(spark, monkeypatch):
    """In one task and by jobs alike, and not like their real parts alone."""
    images = gaussian(spark, 6, 2, 2)
    runs = []
    for most in (training.ONE_TASK_VALUES, 0):
        monkeypatch.setattr(training, "ONE_TASK_VALUES", most)
        runs.append(training.optimize(images, Basis.make("qft", 2, 2), training.Optimizer("gd", 0.05), k=4, max_iter=2, tol=0.0)[1])
    x = np.array([np.array(r.re) + 1j * np.array(r.im) for r in images.collect()])
    total, _ = training.loss_and_gradient(list(Basis.make("qft", 2, 2).gates), x.T, 4, "mse", 4, False)
    assert np.allclose(*runs) and runs[0][0] == pytest.approx(total / 6)
    assert training.optimize(images.drop("im"), Basis.make("qft", 2, 2), training.Optimizer(), k=4, max_iter=0)[1][0] < runs[0][0]


def test_batches_are_read_from_one_write(spark, tmp_path):
    rows = training.by_batch(spark.range(1000).select(F.col("id").alias("img_id"), (F.col("id") % 50).alias("batch"), F.array(F.lit(1.0)).alias("re")))
    part = rows.filter(F.col("batch") == 7)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(batch), EqualTo(batch,7)]" in plan and part.count() == 20
    few = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.5, float(i)]) for i in range(12)], "img_id long, re array<double>")
    for size in (1, 4):
        done = training.train(few, "qft", 1, 1, epochs=1, batch_size=size, split=0.0)
        assert len(done.steps) == 12 // size and sorted({b for _, _, b, _ in done.steps}) == list(range(1, 12 // size + 1))


@pytest.mark.parametrize("m,n,tile", [(5, 4, 8), (4, 5, 3), (6, 6, 64), (2, 5, 4)])
def test_similarity_by_tiles(spark, monkeypatch, m, n, tile):
    monkeypatch.setattr(coordinates, "TILE", tile)
    rng = np.random.default_rng(m)
    x = rng.random((3, 2 ** (m + n))) * 1.2
    x[2] = 0
    x[:, rng.integers(0, x.shape[1], 40)] = 0
    y = np.where(x > 0, x + 0.1 * rng.standard_normal(x.shape), 0)
    y[2, 5] = 0.5
    images = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, re array<double>")
    want = {r.id: r.ssim for r in losses.similarity(images, "x", "re", 2**m, 2**n).collect()}
    got = {r.id: r.ssim for r in coordinates.similarity(coordinates.paired(as_rows(spark, x.astype(complex)), as_rows(spark, y.astype(complex))), m, n).collect()}
    assert got == pytest.approx(want)
