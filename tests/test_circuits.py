import numpy as np
import pytest

from orthomill.operators import circuits
from orthomill.operators.basis import Basis, keep_count
from orthomill.operators.basis import phase_numbers, role_of
from orthomill.operators.diagram import draw, gate_rows, layers

FAMILIES = [("qft", 3, 2, None, "back"), ("eqft", 3, 3, (0.1, 0.2, 0.3), "front"), ("eqft", 3, 3, (0.1, 0.2, 0.3), "middle"), ("eqft", 4, 2, (0.4, 0.5), "middle"), ("eqft", 2, 4, (0.4, 0.5), "back"),
            ("tebd", 3, 2, (0.1, 0.2, 0.3, 0.4, 0.5), "back"), ("mera", 2, 4, tuple(np.arange(8) / 7), "back"), ("mera", 1, 1, (), "back")]


def matrix_forward(basis, x):
    for kind, k in basis.steps():
        x = k @ x if kind == "row" else x @ k.T if kind == "col" else k * x
    return x


@pytest.mark.parametrize("family,m,n,phases,position", FAMILIES)
def test_separated_matches_gate_by_gate_and_inverts(family, m, n, phases, position):
    basis = Basis.make(family, m, n, phases, position)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2**m, 2**n)) + 1j * rng.normal(size=(2**m, 2**n))
    direct = circuits.run_gates(list(basis.gates), x.reshape(-1, 1, order="F"), m + n).reshape(x.shape, order="F")
    assert np.allclose(matrix_forward(basis, x), direct, atol=1e-12)
    assert np.isclose(np.linalg.norm(direct), np.linalg.norm(x))
    back = direct
    for kind, k in basis.steps(inverse=True):
        back = k @ back if kind == "row" else back @ k.T if kind == "col" else k * back
    assert np.allclose(back, x, atol=1e-10)


@pytest.mark.parametrize("m,n", [(3, 3), (2, 4), (1, 3)])
def test_qft_is_the_inverse_fft_of_bit_reversed_input(m, n):
    rev = lambda bits: [int(format(i, f"0{bits}b")[::-1], 2) for i in range(2**bits)]
    x = np.random.default_rng(1).normal(size=(2**m, 2**n))
    want = np.fft.ifft2(x[np.ix_(rev(m), rev(n))], norm="ortho")
    assert np.allclose(matrix_forward(Basis.make("qft", m, n), x), want)


def test_middle_equals_back_only_where_rows_are_longer():
    x = np.random.default_rng(2).normal(size=(16, 4))
    a, b = (matrix_forward(Basis.make("eqft", 4, 2, (0.3, 0.7), p), x) for p in ("middle", "back"))
    assert np.allclose(a, b)
    y = np.random.default_rng(2).normal(size=(8, 8))
    c, d = (matrix_forward(Basis.make("eqft", 3, 3, (0.3, 0.7, 0.1), p), y) for p in ("middle", "back"))
    assert not np.allclose(c, d)


def test_counts_and_errors():
    assert Basis.make("qft", 3, 4).num_gates == 7 + 3 + 6
    assert Basis.make("eqft", 3, 4).num_gates == 16 + 3
    assert Basis.make("tebd", 3, 4).num_gates == 14
    assert Basis.make("mera", 4, 2).num_gates == 6 + 6 + 2
    assert Basis.make("mera", 4, 2).num_parameters == 4 * 14
    for bad in [("mera", 3, 4, None), ("tebd", 1, 3, None), ("eqft", 2, 2, (1.0,)), ("other", 2, 2, None)]:
        with pytest.raises(ValueError):
            Basis.make(*bad)
    assert [keep_count(64, r) for r in (0.5, 0.8, 0.9, 0.95)] == [32, 13, 6, 3]
    with pytest.raises(ValueError):
        keep_count(64, 1.0)
    assert Basis.make("tebd", 2, 2, (0.1, 0.2, 0.3, 0.4)).phases == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert len(draw(Basis.make("qft", 2, 1)).split("\n")) == 3 and len(gate_rows(Basis.make("qft", 2, 1))) == 4


def fewest_columns(basis):
    """By trying every order of placing gates column by column."""
    spans = [set(range(min(g.qubits), max(g.qubits) + 1)) for g in basis.gates]
    before = [{j for j in range(i) if set(basis.gates[j].qubits) & set(g.qubits)} for i, g in enumerate(basis.gates)]
    reached, columns = {frozenset()}, 0
    while frozenset(range(len(spans))) not in reached:
        columns, following = columns + 1, set()
        for done in reached:
            ready = [i for i in range(len(spans)) if i not in done and before[i] <= done]

            def fill(at, free, chosen):
                if at == len(ready):
                    following.add(done | chosen)
                    return
                fill(at + 1, free, chosen)
                if spans[ready[at]] <= free:
                    fill(at + 1, free - spans[ready[at]], chosen | {ready[at]})

            fill(0, set(range(1, basis.m + basis.n + 1)), frozenset())
        reached = {d for d in following if not any(d < e for e in following)}
    return columns


@pytest.mark.parametrize("basis", [Basis.make("qft", 2, 1), Basis.make("qft", 3, 2), Basis.make("eqft", 2, 2, None, "middle"), Basis.make("tebd", 2, 2), Basis.make("mera", 2, 2), Basis.make("tebd", 3, 2)], ids=lambda b: f"{b.family}-{b.m}x{b.n}")
def test_gates_share_columns(basis):
    at = layers(basis)
    fewest = fewest_columns(basis)
    assert fewest <= max(at) + 1 <= fewest + (basis.family == "eqft")  # first fit needs one more there
    for i, g in enumerate(basis.gates):
        for j in range(i):
            other = basis.gates[j]
            assert not set(g.qubits) & set(other.qubits) or at[j] < at[i]
            spans = [set(range(min(q), max(q) + 1)) for q in (g.qubits, other.qubits)]
            assert at[i] != at[j] or not spans[0] & spans[1]
    text = draw(basis).split("\n")
    assert len({len(line) for line in text}) == 1 and sum(line.count("H") for line in text) == sum(g.role == "h" for g in basis.gates)


@pytest.mark.parametrize("family", ["qft", "eqft", "tebd", "mera"])
def test_roles_of_bare_tensors(family):
    """Trained tensors, drifted a little and without roles, in any mix of the two kinds."""
    rng = np.random.default_rng(4)
    basis = Basis.make(family, 2, 2)
    basis = basis.with_tensors([t * np.exp(0.05j * rng.standard_normal((2, 2))) * (1 + 0.05 * rng.standard_normal((2, 2))) for t in basis.tensors])
    assert Basis.from_tensors(family, 2, 2, basis.tensors) == basis
    turned = basis.tensors[::-1]
    mixed = [t for t in turned if role_of(t) == "phase"][::-1] + [t for t in turned if role_of(t) == "h"][::-1]
    assert Basis.from_tensors(family, 2, 2, mixed) == basis
    phases = [i for i, t in enumerate(basis.tensors) if role_of(t) == "phase"]
    assert phase_numbers(basis.tensors, family, 1) == phases[-1:] and phase_numbers(basis.tensors, family, 99) == ([] if family == "eqft" else phases)
    with pytest.raises(ValueError, match="mixing"):
        Basis.from_tensors(family, 2, 2, basis.tensors[1:])
    with pytest.raises(ValueError, match="2 x 2"):
        Basis.from_tensors(family, 2, 2, [np.eye(4), *basis.tensors[1:]])
