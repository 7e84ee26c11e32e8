import numpy as np
import pytest

from orthomill.functions.series import learning_rate_at, validation_count
from orthomill.operators import circuits, manifolds, training
from orthomill.operators.basis import Basis
from orthomill.operators.circuits import Gate
from orthomill.sources import files


@pytest.mark.parametrize("loss", ["l1", "mse"])
def test_gradient_matches_finite_differences(loss):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16, 3)) + 1j * rng.normal(size=(16, 3))
    basis = Basis.make("eqft", 2, 2, (0.3, 0.9))
    gates = list(basis.gates)
    _, grads = training.loss_and_gradient(gates, x, 4, loss, 5)
    for at in (0, 1, len(gates) - 1):
        g = gates[at]
        way = manifolds.MANIFOLDS[g.manifold].project(g.matrix, rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)))
        values = []
        for e in (1e-6, -1e-6):
            moved = gates[:at] + [Gate(g.role, g.qubits, manifolds.MANIFOLDS[g.manifold].retract(g.matrix, way, e), g.entangling)] + gates[at + 1 :]
            values.append(training.loss_and_gradient(moved, x, 4, loss, 5, False)[0])
        slope = float(np.real(np.conj(grads[at]) * way).sum())
        assert (values[0] - values[1]) / 2e-6 == pytest.approx(slope, rel=1e-3, abs=1e-4)


def test_manifolds():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(5, 2, 2)) + 1j * rng.normal(size=(5, 2, 2))
    u = np.linalg.qr(z)[0]
    xi = manifolds.Unitary.project(u, z)
    skew = manifolds.adjoint(u) @ xi
    assert np.allclose(skew, -manifolds.adjoint(skew))
    assert all(manifolds.is_unitary(v) for v in manifolds.Unitary.retract(u, xi, 0.3))
    p = z / np.abs(z)
    assert np.allclose(np.abs(manifolds.Phase.retract(p, manifolds.Phase.project(p, z), 0.3)), 1)
    assert np.allclose(manifolds.inverse2(z) @ z, np.eye(2))


def test_schedule_and_split():
    assert learning_rate_at(0, 1000) == 0 and learning_rate_at(50, 1000) == pytest.approx(0.01) and learning_rate_at(1000, 1000) == pytest.approx(0.001)
    assert [validation_count(n, 0.2) for n in (1, 2, 5, 10)] == [0, 0, 1, 2]


def images(spark, n=40):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(v) for v in np.outer(np.sin(np.arange(4) + i), np.ones(4)).ravel() + 0.05 * rng.normal(size=16)]) for i in range(n)], "img_id long, re array<double>")


@pytest.mark.parametrize("kind", ["gd", "adam"])
def test_optimizer_lowers_loss_and_stays_on_manifold(spark, kind):
    basis, trace = training.optimize(images(spark), Basis.make("qft", 2, 2), training.Optimizer(kind, rate=0.05), k=3, max_iter=8)
    assert trace[-1] < trace[0]
    if kind == "gd":
        assert all(b <= a + 1e-12 for a, b in zip(trace, trace[1:]))
    for g in basis.gates:
        assert manifolds.is_unitary(g.matrix) if g.role == "h" else np.allclose(np.abs(g.matrix), 1)


def test_train_without_validation_returns_last_gates(spark):
    out = training.train(images(spark, 12), "tebd", 2, 2, epochs=1, split=0.0, batches=1)
    assert len(out.epochs) == 1 and np.isinf(out.epochs[0][2]) and not out.basis == Basis.make("tebd", 2, 2)


def test_checkpoints_and_steps(spark, tmp_path):
    out = training.train(images(spark, 12), "mera", 2, 2, epochs=2, batches=2, checkpoint_dir=str(tmp_path / "c"), checkpoint_every=2)
    assert sorted(f.name for f in (tmp_path / "c").iterdir()) == sorted(n for s in (2, 4) for n in files.checkpoint_names(s))
    assert len(files.load_history(str(tmp_path / "c" / "step0004_loss.json"))["step_losses"]) == 4
    again = files.load_basis(str(tmp_path / "c" / "step0002_basis.json"))
    assert again.family == "mera" and any(abs(p) > 1e-3 for p in again.phases)
    steps = out.steps_frame(spark).orderBy("step").toPandas()
    assert steps["smoothed"][0] == steps["loss"][0] and steps["smoothed"][1] == pytest.approx(0.6 * steps["loss"][0] + 0.4 * steps["loss"][1])


def test_unknown_losses_are_errors(spark):
    with pytest.raises(ValueError, match="unknown loss"):
        training.optimize(images(spark, 3), Basis.make("qft", 2, 2), training.Optimizer(), loss="L1", max_iter=1)
    with pytest.raises(ValueError, match="unknown loss"):
        training.train(images(spark, 3), "qft", 2, 2, epochs=1, loss="huber")


@pytest.mark.parametrize("n,size,batches", [(12, 4, 3), (12, 99, 1), (12, 0, 10), (3, 2, 1)])
def test_batch_size_gives_exact_parts(spark, n, size, batches):
    """A fifth of the rows, rounded, is held out; the others are cut into batches of the size, clamped to what there is."""
    out = training.train(images(spark, n), "qft", 2, 2, epochs=2, split=0.2, batch_size=size)
    assert len(out.steps) == 2 * batches and [s[2] for s in out.steps[:batches]] == list(range(1, batches + 1))
    held = validation_count(n, 0.2)
    assert np.isinf(out.epochs[0][2]) == (held == 0)


def test_rows_are_numbered_without_gaps(spark):
    got = training.numbered(spark.range(1000), "id", 7, "at").toPandas().sort_values("at")
    assert got["at"].tolist() == list(range(1000)) and got["id"].tolist() != sorted(got["id"])
    other = training.numbered(spark.range(1000).repartition(5), "id", 7, "at").toPandas().sort_values("at")
    assert other["id"].tolist() == got["id"].tolist() != training.numbered(spark.range(1000), "id", 8, "at").toPandas().sort_values("at")["id"].tolist()


def test_runs_are_compared(spark, tmp_path):
    runs = {f: training.train(images(spark, 12), f, 2, 2, epochs=2, split=0.25, batch_size=5) for f in ("qft", "tebd")}
    both = training.compare(spark, runs).toPandas()
    assert sorted(map(tuple, both[["name", "epoch", "kind"]].to_numpy().tolist())) == sorted((f, e, k) for f in runs for e in (1, 2) for k in ("train", "validation"))
    assert set(training.compare(spark, runs, "train").toPandas()["kind"]) == {"train"}
    with pytest.raises(ValueError):
        training.compare(spark, runs, "all")
    grid = training.compare_steps(spark, runs, columns=1).toPandas()
    assert set(map(tuple, grid[["name", "grid_row", "grid_column"]].to_numpy().tolist())) == {("qft", 0, 0), ("tebd", 1, 0)} and len(grid) == 8
    for name, run in runs.items():
        files.save_history(run, str(tmp_path / f"{name}.json"), name)
    epochs, steps = files.read_histories(spark, str(tmp_path))
    assert epochs.count() == 4 and steps.count() == 8
    row = epochs.filter("basis_name = 'qft' and epoch = 1").first()
    assert (row.train_loss, row.val_loss) == pytest.approx(runs["qft"].epochs[0][1:])


@pytest.mark.parametrize("kind", ["gd", "adam"])
def test_one_task_or_a_job_a_step_give_the_same(spark, monkeypatch, kind):
    runs = []
    for limit in (10**6, 0):
        monkeypatch.setattr(training, "ONE_TASK_VALUES", limit)
        optimizer = training.Optimizer(kind, rate=0.05)
        basis, trace = training.optimize(images(spark, 9), Basis.make("eqft", 2, 2, (0.2, 0.4)), optimizer, k=3, max_iter=4)
        runs.append((trace, np.array(basis.tensors), optimizer.steps, np.array(optimizer.first)))
    assert all(np.allclose(a, b) for a, b in zip(*runs)) and len(runs[0][0]) == 5


def test_kept_entries_are_the_lowest_of_equal_ones():
    y = np.array([[1, 2j, 0], [-1, 2, 0], [1j, 1, 0], [3, 2, 0]])
    assert training.keep_mask(y, 2).astype(int).T.tolist() == [[1, 0, 0, 1], [1, 1, 0, 0], [1, 1, 0, 0]]


def test_weighted_selection_in_training(spark):
    """Ties stay; the gradient is that of finite differences, as the selection counts as fixed."""
    y = np.array([[3.0, 3.0, 1.0, 1.0], [0.0, 5.0, 5.0, 5.0]]).T.astype(complex)
    assert training.keep_weighted(y, 1, 1).sum(axis=0).tolist() == [2, 3]
    rng = np.random.default_rng(6)
    x = rng.standard_normal((16, 5)) + 1j * rng.standard_normal((16, 5))
    basis = Basis.make("eqft", 2, 2, (0.4, 0.9), "middle")
    gates = list(basis.gates)
    total, grads = training.loss_and_gradient(gates, x, 4, "weighted", 5, m=2)
    run = lambda gs: circuits.run_gates(gs, x, 4)
    stays = training.keep_weighted(run(gates), 5, 2)
    assert total == pytest.approx((np.abs(x) ** 2).sum() - (np.abs(run(gates)[stays]) ** 2).sum())
    for i, g in enumerate(gates):
        for at in ((0, 0), (0, 1), (1, 0), (1, 1)):
            for step in (1e-6, 1e-6j):
                near = []
                for sign in (1, -1):
                    moved = g.matrix.astype(complex).copy()
                    moved[at] += sign * step
                    near.append(-(np.abs(run([*gates[:i], circuits.Gate(g.role, g.qubits, moved, g.entangling), *gates[i + 1 :]])[stays]) ** 2).sum())
                slope = (near[0] - near[1]) / 2e-6
                assert slope == pytest.approx(grads[i][at].real if step == 1e-6 else grads[i][at].imag, abs=1e-4)
    images = spark.createDataFrame([(i, v.real.tolist(), v.imag.tolist()) for i, v in enumerate(x.T)], "img_id long, re array<double>, im array<double>")
    _, trace = training.optimize(images, basis, training.Optimizer("gd", 0.05), loss="weighted", k=5, max_iter=3, tol=0.0)
    assert trace[0] == pytest.approx(total / 5) and trace[-1] < trace[0]
