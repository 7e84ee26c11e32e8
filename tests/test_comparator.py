"""The comparator: every gate of a circuit on orthonormal frames, whatever it was before."""

import numpy as np
import pytest

from orthomill.operators import manifolds, training
from orthomill.operators.basis import Basis
from orthomill.operators.circuits import Gate

RNG = np.random.default_rng(11)


def complex_normal(*shape):
    return RNG.normal(size=shape) + 1j * RNG.normal(size=shape)


@pytest.mark.parametrize("family,phases", [("qft", None), ("eqft", (0.3, 0.9)), ("tebd", (0.2, -0.4, 0.7, 1.1)), ("mera", tuple(0.1 * i for i in range(1, 5)))])
def test_gradient_of_free_gates_matches_finite_differences(family, phases):
    basis = Basis.make(family, 2, 2, phases)
    gates = [Gate(g.role, g.qubits, g.matrix + 0.2 * complex_normal(2, 2), g.entangling) for g in basis.gates]
    gates[-1].matrix[0, 1] = 0  # an entry that can't be divided by
    x = complex_normal(16, 3)
    _, grads = training.loss_and_gradient(gates, x, 4, "roundtrip", 5)
    for at, g in enumerate(gates):
        way = complex_normal(2, 2)
        sides = [training.loss_and_gradient([*gates[:at], Gate(g.role, g.qubits, g.matrix + e * way, g.entangling), *gates[at + 1 :]], x, 4, "roundtrip", 5, False)[0] for e in (1e-6, -1e-6)]
        assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(float(np.real(np.conj(grads[at]) * way).sum()), rel=1e-4, abs=1e-4)


def test_on_their_own_manifolds_both_squared_errors_agree():
    gates, x = list(Basis.make("eqft", 2, 2, (0.3, 0.9)).gates), complex_normal(16, 3)
    (one, a), (two, b) = (training.loss_and_gradient(gates, x, 4, loss, 5) for loss in ("mse", "roundtrip"))
    assert one == pytest.approx(two)
    for g, p, q in zip(gates, a, b):
        assert np.allclose(manifolds.MANIFOLDS[g.manifold].project(g.matrix, p), manifolds.MANIFOLDS[g.manifold].project(g.matrix, q))


@pytest.mark.parametrize("kind", ["stiefel_polar", "stiefel_qr"])
def test_frames(kind):
    m, z = manifolds.MANIFOLDS[kind], complex_normal(6, 2, 2)
    u = m.retract(z, np.zeros_like(z), 1.0)
    assert manifolds.is_unitary(u).all()
    xi = m.project(u, complex_normal(6, 2, 2))
    inner = manifolds.adjoint(u) @ xi
    assert np.allclose(inner, -manifolds.adjoint(inner)) and np.allclose(m.project(u, xi), xi)
    assert manifolds.is_unitary(m.retract(u, xi, 0.7)).all()
    slope = (m.retract(u, xi, 1e-6) - m.retract(u, xi, -1e-6)) / 2e-6
    assert np.allclose(slope, xi, atol=1e-6)  # retractions start along their tangent
    assert manifolds.is_unitary(m.retract(np.ones((2, 2), complex), np.zeros((2, 2)), 1.0))  # also where no frame is nearest


def pictures(spark):
    return spark.createDataFrame([(i, list(map(float, RNG.random(16))), list(map(float, RNG.random(16)))) for i in range(4)], "img_id long, re array<double>, im array<double>")


@pytest.mark.parametrize("kind", ["stiefel_polar", "stiefel_qr"])
def test_comparator_descends_on_frames(spark, kind, monkeypatch):
    """The first step brings phase gates to frames, another circuit with a larger loss; from there on the loss falls."""
    rows, start = pictures(spark), Basis.make("qft", 2, 2)
    there, trace = training.optimize(rows, start, training.Optimizer("gd", 0.05, manifold=kind), loss="roundtrip", k=4, max_iter=30, tol=0.0)
    assert trace[0] < trace[1] and trace[-1] < trace[1] and all(b <= a + 1e-12 for a, b in zip(trace[1:], trace[2:]))
    assert all(manifolds.is_unitary(g.matrix) for g in there.gates)
    monkeypatch.setattr(training, "ONE_TASK_VALUES", 0)
    _, jobs = training.optimize(rows.repartition(3), start, training.Optimizer("gd", 0.05, manifold=kind), loss="roundtrip", k=4, max_iter=3, tol=0.0)
    assert np.allclose(jobs, trace[:4])


def test_both_gradients_lead_the_same_way(spark):
    """On the gates' own manifolds, the round trip and the sum of what is left out give the same descent."""
    rows, start = pictures(spark), Basis.make("eqft", 2, 2, (0.3, 0.9))
    for kind in ("gd", "adam"):
        (a, one), (b, two) = (training.optimize(rows, start, training.Optimizer(kind, 0.02), loss=loss, k=4, max_iter=15, tol=0.0) for loss in ("mse", "roundtrip"))
        assert np.allclose(one, two) and one[-1] < 0.9 * one[0]
        assert all(np.allclose(g.matrix, h.matrix) for g, h in zip(a.gates, b.gates))


def test_losses_that_take_the_circuit_for_unitary_are_errors(spark):
    with pytest.raises(ValueError, match="roundtrip"):
        training.optimize(pictures(spark), Basis.make("qft", 2, 2), training.Optimizer("gd", manifold="stiefel_qr"), loss="mse", max_iter=1)
    with pytest.raises(ValueError, match="roundtrip"):
        training.train(pictures(spark), "qft", 2, 2, epochs=1, optimizer=training.Optimizer(manifold="stiefel_qr"))
