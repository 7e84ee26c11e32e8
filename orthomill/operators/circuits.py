"""Gate lists of the four circuit families and the matrices they amount to.

A gate is one row: its role, the qubits it acts on (1-based; 1..m address rows, m+1..m+n
columns, lowest bit first) and a 2x2 complex matrix. Row gates touch row qubits only and
column gates column qubits only, so a circuit is ``F = R X C^T`` with one elementwise phase
mask for entangling gates before, between or after the two products.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HADAMARD = np.array([[1, 1], [1, -1]], complex) / math.sqrt(2)


def phase_matrix(phi: float) -> np.ndarray:
    """The form phase gates have in circuits: the exponent applies where both bits are 1."""
    return np.array([[1, 1], [1, np.exp(1j * phi)]])


def entanglement_gate(phi: float) -> np.ndarray:
    """The diagonal single-qubit form diag(1, e^(i phi))."""
    return np.diag([1, np.exp(1j * phi)])


@dataclass(frozen=True, eq=False)
class Gate:
    role: str  # "h" or "phase"
    qubits: tuple[int, ...]
    matrix: np.ndarray
    entangling: bool = False

    @property
    def manifold(self) -> str:
        return "unitary" if self.role == "h" else "phase"

    @property
    def phase(self) -> float:
        return float(np.angle(self.matrix[1, 1]))

    def apply(self, state: np.ndarray) -> np.ndarray:
        """``state`` has one axis of length 2 per qubit, first qubit first, and one batch axis last."""
        if self.role == "h":
            q = self.qubits[0] - 1
            return np.moveaxis(np.tensordot(self.matrix, state, (1, q)), 0, q)
        shape = [1] * state.ndim
        a, b = (q - 1 for q in self.qubits)
        shape[a] = shape[b] = 2
        return state * (self.matrix if a < b else self.matrix.T).reshape(shape)


def _qft(first: int, count: int) -> list[Gate]:
    gates = []
    for j in range(count):
        gates.append(Gate("h", (first + j,), HADAMARD))
        gates += [Gate("phase", (first + k, first + j), phase_matrix(2 * math.pi / 2 ** (k - j + 1))) for k in range(j + 1, count)]
    return gates


def qft(m: int, n: int) -> list[Gate]:
    return _qft(1, m) + _qft(m + 1, n)


def entangled_qft(m: int, n: int, phases=None, position: str = "back") -> list[Gate]:
    size = min(m, n)
    phases = [0.0] * size if phases is None else list(phases)
    if len(phases) != size:
        raise ValueError(f"{size} phases are needed, got {len(phases)}")
    if position not in ("front", "middle", "back"):
        raise ValueError(f"unknown position {position!r}")
    joins = [Gate("phase", (m - k, m + n - k), phase_matrix(p), True) for k, p in enumerate(phases)]
    if position == "front":
        return joins + qft(m, n)
    if position == "back" or m > n:  # between the parts the mask acts as behind them if m > n
        return qft(m, n) + joins
    return _qft(1, m) + joins + _qft(m + 1, n)


def tebd(m: int, n: int, phases=None) -> list[Gate]:
    if m < 2 or n < 2:
        raise ValueError("a ring needs at least two qubits")
    phases = [0.0] * (m + n) if phases is None else list(phases)
    if len(phases) != m + n:
        raise ValueError(f"{m + n} phases are needed, got {len(phases)}")
    pairs = [(i, i % m + 1) for i in range(1, m + 1)] + [(m + i, m + i % n + 1) for i in range(1, n + 1)]
    return [Gate("h", (q,), HADAMARD) for q in range(1, m + n + 1)] + [Gate("phase", p, phase_matrix(x)) for p, x in zip(pairs, phases)]


def mera_pairs(count: int) -> list[tuple[int, int]]:
    if count & (count - 1) or count < 1:
        raise ValueError("qubit counts must be powers of two")
    pairs, stride = [], 1
    while stride < count:
        starts = range(0, count, 2 * stride)
        pairs += [(s + 2, (s + stride + 1) % count + 1) for s in starts] + [(s + 1, s + stride + 1) for s in starts]
        stride *= 2
    return pairs


def mera(m: int, n: int, phases=None) -> list[Gate]:
    pairs = mera_pairs(m) + [(a + m, b + m) for a, b in mera_pairs(n)]
    phases = [0.0] * len(pairs) if phases is None else list(phases)
    if len(phases) != len(pairs):
        raise ValueError(f"{len(pairs)} phases are needed, got {len(phases)}")
    return [Gate("h", (q,), HADAMARD) for q in range(1, m + n + 1)] + [Gate("phase", p, phase_matrix(x)) for p, x in zip(pairs, phases)]


def run_gates(gates: list[Gate], x: np.ndarray, qubits: int) -> np.ndarray:
    """Apply the gates to column-major states of shape (2 ** qubits, batch)."""
    state = x.astype(complex).reshape([2] * qubits + [-1], order="F")
    for g in gates:
        state = g.apply(state)
    return state.reshape(x.shape, order="F")


def mask_place(gates: list[Gate]) -> str:
    """Where the entangling gates stand; "back" if there are none."""
    joins = [i for i, g in enumerate(gates) if g.entangling]
    return "back" if not joins or joins[-1] == len(gates) - 1 else "front" if joins[0] == 0 else "middle"


def separated(gates: list[Gate], m: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, str]:
    """R, C, the entangling mask (2^m x 2^n) or None, and its place: front, middle or back."""
    rows = [g for g in gates if not g.entangling and max(g.qubits) <= m]
    cols = [Gate(g.role, tuple(q - m for q in g.qubits), g.matrix) for g in gates if not g.entangling and min(g.qubits) > m]
    r, c = run_gates(rows, np.eye(2**m), m), run_gates(cols, np.eye(2**n), n)
    joins = [i for i, g in enumerate(gates) if g.entangling]
    if not joins:
        return r, c, None, "back"
    mask = run_gates([gates[i] for i in joins], np.ones((2 ** (m + n), 1)), m + n).reshape(2**m, 2**n, order="F")
    return r, c, mask, mask_place(gates)
