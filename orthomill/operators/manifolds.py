"""Unitary 2x2 matrices and 2x2 arrays of unit phases: tangent projection, retraction, transport.

``StiefelPolar`` and ``StiefelQR`` are orthonormal frames in two dimensions with the two usual
retractions. They take any 2x2 array as a starting point: the first retraction brings it to the nearest
frame (polar), or to the frame of its columns in order (QR).
"""

from __future__ import annotations

import numpy as np


def adjoint(x: np.ndarray) -> np.ndarray:
    return np.conj(np.swapaxes(x, -1, -2))


def inverse2(x: np.ndarray) -> np.ndarray:
    """Closed form for stacks of 2x2 matrices."""
    det = x[..., 0, 0] * x[..., 1, 1] - x[..., 0, 1] * x[..., 1, 0]
    out = np.stack([np.stack([x[..., 1, 1], -x[..., 0, 1]], -1), np.stack([-x[..., 1, 0], x[..., 0, 0]], -1)], -2)
    return out / det[..., None, None]


def is_unitary(x: np.ndarray, tolerance: float = 1e-6):
    """Of a matrix, or of each one of a stack."""
    if x.shape[-1] != x.shape[-2]:
        return np.zeros(x.shape[:-2], bool)[()]
    return np.isclose(x @ adjoint(x), np.eye(x.shape[-1]), atol=tolerance).all(axis=(-1, -2))


class Unitary:
    @staticmethod
    def project(u, g):
        inner = adjoint(u) @ g
        return u @ ((inner - adjoint(inner)) / 2)

    @staticmethod
    def retract(u, xi, alpha: float):
        """Cayley transform of the skew part."""
        w = xi @ adjoint(u)
        w = (w - adjoint(w)) / 2
        one = np.eye(2)
        return inverse2(one - alpha / 2 * w) @ (one + alpha / 2 * w) @ u


class Phase:
    @staticmethod
    def project(z, g):
        return 1j * np.imag(np.conj(z) * g) * z

    @staticmethod
    def retract(z, xi, alpha: float):
        moved = z + alpha * xi
        return moved / np.abs(moved)


class StiefelPolar:
    @staticmethod
    def project(u, g):
        inner = adjoint(u) @ g
        return g - u @ ((inner + adjoint(inner)) / 2)

    @staticmethod
    def retract(u, xi, alpha: float):
        left, _, right = np.linalg.svd(u + alpha * xi)
        return left @ right


class StiefelQR(StiefelPolar):
    @staticmethod
    def retract(u, xi, alpha: float):
        q, r = np.linalg.qr(u + alpha * xi)
        turn = np.diagonal(r, axis1=-2, axis2=-1)
        size = np.abs(turn)
        return q * np.where(size > 0, turn / np.where(size > 0, size, 1), 1)[..., None, :]  # so that R's diagonal is positive


MANIFOLDS = {"unitary": Unitary, "phase": Phase, "stiefel_polar": StiefelPolar, "stiefel_qr": StiefelQR}


def transport(kind: str, at_new, tangent):
    return MANIFOLDS[kind].project(at_new, tangent)
