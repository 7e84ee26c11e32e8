"""Circuits as tables and text."""

from __future__ import annotations

from .basis import Basis


def layers(basis: Basis) -> list[int]:
    """The column of each gate: the first one after all earlier gates on its qubits in which nothing stands between its ends."""
    taken: list[set[int]] = []  # qubits by column that a gate or the line between its ends covers
    last = dict.fromkeys(range(1, basis.m + basis.n + 1), -1)
    out = []
    for g in basis.gates:
        span = set(range(min(g.qubits), max(g.qubits) + 1))
        at = max(last[q] for q in g.qubits) + 1
        while at < len(taken) and taken[at] & span:
            at += 1
        if at == len(taken):
            taken.append(set())
        taken[at] |= span
        last.update(dict.fromkeys(g.qubits, at))
        out.append(at)
    return out


def gate_rows(basis: Basis) -> list[tuple[int, str, int, int | None, float | None, int]]:
    """(number, role, first qubit, second qubit, phase, column) in circuit order."""
    return [(i, g.role, g.qubits[0], g.qubits[1] if len(g.qubits) > 1 else None, g.phase if g.role == "phase" else None, at) for (i, g), at in zip(enumerate(basis.gates), layers(basis))]


def draw(basis: Basis) -> str:
    """One line per qubit: H for a mixing gate, * at both ends of a phase gate; gates that don't cross share a column."""
    column = layers(basis)
    lines = [[f"r{q}" if q <= basis.m else f"c{q - basis.m}", *["-"] * (max(column, default=-1) + 1)] for q in range(1, basis.m + basis.n + 1)]
    for g, at in zip(basis.gates, column):
        for q in range(min(g.qubits), max(g.qubits) + 1):
            lines[q - 1][at + 1] = ("H" if g.role == "h" else "*") if q in g.qubits else "|"
    return "\n".join("-".join(line) for line in lines)
