"""Bases: circuits as steps over array images, and the compressed form.

An image is a row with ``re`` (and ``im``) arrays of 2^(m+n) doubles in column-major order.
Transforms, selection of the largest coefficients and recovery run where the images are read,
as one pass over Arrow batches: a batch of images times the circuit's two small matrices. They
need no shuffle, whatever the number of images, and hold a few million values at a time. Images
too large for one row are transformed as rows of coordinates by ``coordinates.transform``.

Null images stay null; an image of another size than the basis's is an error.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import circuits

NAMES = {"qft": "QFT", "eqft": "Entangled QFT", "tebd": "TEBD", "mera": "MERA"}
TYPES = {"qft": "QFTBasis", "eqft": "EntangledQFTBasis", "tebd": "TEBDBasis", "mera": "MERABasis"}


#: Values of a slice of a batch, so that memory stays bounded for large images.
SLICE_VALUES = 2_000_000


def let(name: str, values: dict[str, str], body: str) -> str:
    """SQL that computes ``values`` once and gives them to ``body`` as fields of ``name``.

    Without it the optimizer may copy a column's expression into the lambdas that use it,
    which then compute it anew for every element.
    """
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {name} -> {body})[0]"


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """A row per list; lists of another length are an error."""
    values = column.flatten().to_numpy()
    if len(values) != len(column) * size or (len(column) and (np.diff(column.offsets.to_numpy()) != size).any()):
        raise ValueError(f"an image of this basis has {size} values")
    return values.reshape(len(column), size)


def lists_of(matrix: np.ndarray, kind=None) -> pa.Array:
    n, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size) if size else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def map_images(df: DataFrame, inputs: list[str], outputs: str, size: int, work, drop=("re", "im")) -> DataFrame:
    """``df`` without ``drop``, with the columns ``outputs`` (DDL) that ``work`` makes of the arrays ``inputs``.

    ``work`` gets the columns of some rows as Arrow arrays without nulls and returns Arrow
    arrays; where an input is null, so are the outputs.
    """
    added = T.StructType.fromDDL(outputs)
    others = [c for c in df.columns if c not in drop and c not in added.fieldNames()]
    schema, names = df.select(*others).schema, [*others, *added.fieldNames()]
    for f in added.fields:
        schema = schema.add(f)
    step = max(1, SLICE_VALUES // size)
    src = df.select(*others, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                taken = part.columns[len(others) :]
                known = np.ones(part.num_rows, bool)
                for c in taken:
                    known &= c.is_valid().to_numpy(zero_copy_only=False)
                if known.all():
                    made = work(*taken)
                else:
                    where = pa.array(np.where(known, np.cumsum(known) - 1, 0), pa.int64(), mask=~known)
                    made = [x.take(where) for x in work(*[c.filter(pa.array(known)) for c in taken])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *made], names)

    return src.mapInArrow(run, schema)


def run_steps(x: np.ndarray, steps) -> np.ndarray:
    """("row" | "col", matrix) and ("mask", matrix) steps on images indexed [image, column, row]."""
    for kind, k in steps:
        k = k.real if np.iscomplexobj(k) and not k.imag.any() else k
        x = x @ k.T if kind == "row" else k @ x if kind == "col" else x * k.T
    return x


def images_of(re: pa.Array, im: pa.Array | None, m: int, n: int) -> np.ndarray:
    x = matrix_of(re, 2 ** (m + n))
    return (x if im is None else x + 1j * matrix_of(im, 2 ** (m + n))).reshape(-1, 2**n, 2**m)


def flat(x: np.ndarray) -> np.ndarray:
    """Images as rows of complex numbers in column-major order."""
    return x.reshape(len(x), int(np.prod(x.shape[1:]))).astype(complex, copy=False)


def apply_steps(df: DataFrame, steps, m: int, n: int, im: str | None = "im") -> DataFrame:
    """Replace ``re`` and ``im`` by the result of the steps; ``im=None`` says that images are real."""

    def work(re, im=None):
        y = flat(run_steps(images_of(re, im, m, n), steps))
        return [lists_of(y.real), lists_of(y.imag)]

    return map_images(df, ["re", im] if im else ["re"], "re array<double>, im array<double>", 2 ** (m + n), work)


def keep_count(total: int, ratio: float) -> int:
    """Coefficients kept at a compression ratio; halves round to even."""
    if not 0 <= ratio < 1:
        raise ValueError("the ratio must be in [0, 1)")
    return max(1, round(total * (1.0 - ratio)))


def ranking(sizes: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first, the lowest place first among equal ones; only what may stay is sorted."""
    total = sizes.shape[1]
    if 4 * k >= total:
        return np.argsort(-sizes, axis=1, kind="stable")[:, :k]
    least = np.partition(sizes, total - k, axis=1)[:, total - k : total - k + 1]
    equal = sizes == least
    stays = (sizes > least) | equal & (np.cumsum(equal, axis=1) <= k - (sizes > least).sum(axis=1, keepdims=True))
    places = np.nonzero(stays)[1].reshape(len(sizes), k)
    return np.take_along_axis(places, np.argsort(-np.take_along_axis(sizes, places, axis=1), axis=1, kind="stable"), axis=1)


def sizes_of(y: np.ndarray) -> np.ndarray:
    """Rounded, as mirror coefficients of real images tie."""
    return np.round(np.sqrt(y.real**2 + y.imag**2), 9)


KEPT = "kept array<struct<lin: int, re: double, im: double>>"


def kept_lists(y: np.ndarray, places: np.ndarray) -> pa.Array:
    chosen = np.take_along_axis(y, places, axis=1)
    fields = [pa.array(places.astype(np.int32).ravel()), pa.array(np.ascontiguousarray(chosen.real).ravel()), pa.array(np.ascontiguousarray(chosen.imag).ravel())]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, places.size + 1, places.shape[1]), pa.int32()), pa.StructArray.from_arrays(fields, ["lin", "re", "im"]))


def largest_after(images: DataFrame, steps, m: int, n: int, k: int, im: str | None = None, whole: bool = False) -> DataFrame:
    """Transform and rank in one pass: adds ``kept``, the k largest coefficients as (lin, re, im), largest first.

    With ``whole`` all coefficients stay as ``re`` and ``im``.
    """
    if k < 1:
        raise ValueError("at least one coefficient must be kept")

    def work(re, im=None):
        y = flat(run_steps(images_of(re, im, m, n), steps))
        kept = kept_lists(y, ranking(sizes_of(y), k))
        return [lists_of(y.real), lists_of(y.imag), kept] if whole else [kept]

    return map_images(images, ["re", im] if im else ["re"], ("re array<double>, im array<double>, " if whole else "") + KEPT, 2 ** (m + n), work)


def largest(df: DataFrame, k: int, size: int) -> DataFrame:
    """Adds ``kept`` to coefficients: the k largest ones as (lin, re, im), largest first."""
    if k < 1:
        raise ValueError("at least one coefficient must be kept")

    def work(re, im):
        y = matrix_of(re, size) + 1j * matrix_of(im, size)
        return [re, im, kept_lists(y, ranking(sizes_of(y), k))]

    return map_images(df, ["re", "im"], f"re array<double>, im array<double>, {KEPT}", size, work)


def truncated(df: DataFrame, k: int, size: int) -> DataFrame:
    """All but the k largest coefficients set to zero."""
    if k >= size:
        return df

    def work(re, im):
        y = matrix_of(re, size) + 1j * matrix_of(im, size)
        places, out = ranking(sizes_of(y), k), np.zeros_like(y)
        np.put_along_axis(out, places, np.take_along_axis(y, places, axis=1), axis=1)
        return [lists_of(out.real), lists_of(out.imag)]

    return map_images(df, ["re", "im"], "re array<double>, im array<double>", size, work)


def place_weights(m: int, n: int) -> np.ndarray:
    """Weights of the alternative rule by place: 2 in the centre, 1.5 in the corners."""
    h, w, size = 2**m, 2**n, 2 ** (m + n)
    place = np.arange(size)
    far = np.sqrt((place % h + 1 - (h + 1) / 2) ** 2 + (place // h + 1 - (w + 1) / 2) ** 2)
    return 2.0 - 0.5 * far / math.sqrt(((h - 1) / 2) ** 2 + ((w - 1) / 2) ** 2) if size > 1 else np.full(1, 2.0)


def weighted_largest(df: DataFrame, m: int, n: int, k: int) -> DataFrame:
    """The alternative rule: sizes weighted towards the centre; all that reach the k-th score stay, ties included."""
    size, weight = 2 ** (m + n), place_weights(m, n)

    def work(re, im):
        y = matrix_of(re, size) + 1j * matrix_of(im, size)
        scores = np.round(np.sqrt(y.real**2 + y.imag**2) * weight, 9)
        stays = scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        at = np.nonzero(stays)
        fields = [pa.array(at[1].astype(np.int32)), pa.array(scores[at]), pa.array(y.real[at]), pa.array(y.imag[at])]
        ends = np.concatenate([[0], np.cumsum(stays.sum(axis=1))])
        return [re, im, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["lin", "score", "re", "im"]))]

    return map_images(df, ["re", "im"], "re array<double>, im array<double>, kept array<struct<lin: int, score: double, re: double, im: double>>", size, work)


#: How far from 1 the size of a phase gate's entries may have drifted.
DRIFT = 0.15


def role_of(tensor: np.ndarray) -> str:
    """"phase" if all four entries have about size 1, else "h"; mixing gates have entries of about 0.7."""
    if np.shape(tensor) != (2, 2):
        raise ValueError(f"a gate has 2 x 2 entries, not {np.shape(tensor)}")
    return "phase" if (np.abs(np.abs(tensor) - 1) <= DRIFT).all() else "h"


def phase_numbers(tensors, family: str, count: int) -> list[int]:
    """Which tensors are the last ``count`` phase gates; of too few none in the entangled family, all in the others."""
    found = [i for i, t in enumerate(tensors) if role_of(t) == "phase"]
    if len(found) < count:
        return [] if family == "eqft" else found
    return found[len(found) - count :]


@dataclass(frozen=True, eq=False)
class Basis:
    family: str
    m: int
    n: int
    gates: tuple[circuits.Gate, ...] = field(repr=False)
    position: str = "back"

    @classmethod
    def make(cls, family: str, m: int, n: int, phases=None, position: str = "back") -> Basis:
        if family == "qft":
            gates = circuits.qft(m, n)
        elif family == "eqft":
            gates = circuits.entangled_qft(m, n, phases, position)
        elif family in ("tebd", "mera"):
            gates = getattr(circuits, family)(m, n, phases)
        else:
            raise ValueError(f"unknown family {family!r}")
        return cls(family, m, n, tuple(gates), position)

    @property
    def size(self) -> int:
        return 2 ** (self.m + self.n)

    @property
    def image_size(self) -> tuple[int, int]:
        return 2**self.m, 2**self.n

    @property
    def tensors(self) -> list[np.ndarray]:
        """Unitary gates first, then phase gates, each in circuit order."""
        return [g.matrix for g in sorted(self.gates, key=lambda g: g.role != "h")]

    @property
    def num_gates(self) -> int:
        return len(self.gates)

    @property
    def num_parameters(self) -> int:
        return 4 * len(self.gates)

    @property
    def phases(self) -> list[float]:
        """Phases of the entangling gates, or of all phase gates of a ring or a hierarchy."""
        return [g.phase for g in self.gates if g.role == "phase" and (g.entangling or self.family in ("tebd", "mera"))]

    def gates_by_manifold(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, g in enumerate(self.gates):
            out.setdefault(g.manifold, []).append(i)
        return out

    def with_tensors(self, tensors) -> Basis:
        order = sorted(range(len(self.gates)), key=lambda i: self.gates[i].role != "h")
        gates = list(self.gates)
        for i, t in zip(order, tensors, strict=True):
            g = gates[i]
            gates[i] = circuits.Gate(g.role, g.qubits, np.asarray(t, complex), g.entangling)
        return Basis(self.family, self.m, self.n, tuple(gates), self.position)

    @classmethod
    def from_tensors(cls, family: str, m: int, n: int, tensors, position: str = "back") -> Basis:
        """A basis of bare tensors, whose roles are told by their entries; each role's gates are in circuit order."""
        template = cls.make(family, m, n, position=position)
        roles = [role_of(t) for t in tensors]
        asked = [g.role for g in template.gates]
        if sorted(roles) != sorted(asked):
            raise ValueError(f"{TYPES[family]} of {m} and {n} qubits has {asked.count('h')} mixing and {asked.count('phase')} phase gates, not {roles.count('h')} and {roles.count('phase')}")
        return template.with_tensors([t for role in ("h", "phase") for r, t in zip(roles, tensors) if r == role])

    def basis_hash(self) -> str:
        head = f"{TYPES[self.family]}:m={self.m}:n={self.n}:"
        if self.family == "eqft":
            head += f"n_entangle={len(self.phases)}:pos={self.position}:"
        elif self.family != "qft":
            rows = sum(1 for g in self.gates if g.role == "phase" and max(g.qubits) <= self.m)
            head += f"n_row={rows}:n_col={len(self.phases) - rows}:"
        body = "".join(f"{z.real},{z.imag};" for t in self.tensors for z in t.flatten(order="F"))
        return hashlib.sha256((head + body).encode()).hexdigest()

    def __eq__(self, other) -> bool:
        if not isinstance(other, Basis) or (self.family, self.m, self.n, self.position, len(self.gates)) != (other.family, other.m, other.n, other.position, len(other.gates)):
            return False
        return all(np.allclose(a, b, rtol=1.5e-8, atol=0) or np.allclose(a, b, atol=1e-12) for a, b in zip(self.tensors, other.tensors))

    __hash__ = None

    def steps(self, inverse: bool = False) -> list[tuple[str, np.ndarray]]:
        r, c, mask, place = circuits.separated(list(self.gates), self.m, self.n)
        steps = [("row", r), ("col", c)]
        if mask is not None:
            steps.insert({"front": 0, "middle": 1, "back": 2}[place], ("mask", mask))
        if inverse:
            steps = [(kind, x.conj() if kind == "mask" else x.conj().T) for kind, x in reversed(steps)]
        return steps

    def forward(self, images: DataFrame, real: bool = False) -> DataFrame:
        """``re`` and ``im`` become coefficients; ``real`` says that the images have no ``im`` column."""
        return apply_steps(images, self.steps(), self.m, self.n, im=None if real else "im")

    def inverse(self, coefficients: DataFrame) -> DataFrame:
        return apply_steps(coefficients, self.steps(inverse=True), self.m, self.n)

    def compress(self, images: DataFrame, ratio: float | None = 0.9, k: int | None = None, real: bool = True) -> DataFrame:
        """One sparse row per image: 1-based column-major indices, largest coefficient first."""
        count = keep_count(self.size, ratio) if k is None else min(k, self.size)
        return self._sparse(largest_after(images, self.steps(), self.m, self.n, count, None if real else "im"))

    def compress_ratios(self, images: DataFrame, ratios, real: bool = True) -> DataFrame:
        """``compress`` at several ratios, a row for each image and ratio, from one transform and one ranking."""
        counts = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.lit(keep_count(self.size, r)).alias("k")) for r in ratios]))
        kept = largest_after(images, self.steps(), self.m, self.n, max(keep_count(self.size, r) for r in ratios), None if real else "im")
        each = kept.withColumn("_at", counts).withColumn("kept", F.slice("kept", 1, F.col("_at.k"))).withColumn("ratio", F.col("_at.ratio"))
        return self._sparse(each.drop("_at"))

    def _sparse(self, kept: DataFrame) -> DataFrame:
        h, w = self.image_size
        others = [c for c in kept.columns if c not in ("kept", "re", "im")]
        at = F.transform("kept", lambda x: x["lin"] + 1)
        return kept.select(
            *others, at.alias("indices"), F.col("kept.re").alias("values_real"), F.col("kept.im").alias("values_imag"),
            F.lit(h).alias("original_height"), F.lit(w).alias("original_width"), F.lit(self.basis_hash()).alias("basis_hash"),
        )

    def recover(self, compressed: DataFrame, verify_hash: bool = True) -> DataFrame:
        """Images again, from the kept coefficients; the real part is the picture."""
        if verify_hash:
            wrong = F.raise_error(F.lit("the image was compressed with another basis"))
            compressed = compressed.withColumn("values_real", F.when(F.col("basis_hash") == self.basis_hash(), F.col("values_real")).otherwise(wrong.cast("array<double>")))
        m, n, size, steps = self.m, self.n, self.size, self.steps(inverse=True)

        def work(at, re, im):
            owner, place = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy() - 1
            x = np.zeros((len(at), size), complex)
            x[owner, place] = re.flatten().to_numpy() + 1j * im.flatten().to_numpy()
            y = flat(run_steps(x.reshape(-1, 2**n, 2**m), steps))
            return [lists_of(y.real), lists_of(y.imag)]

        sparse = ["indices", "values_real", "values_imag"]
        return map_images(compressed, sparse, "re array<double>, im array<double>", size, work, (*sparse, "original_height", "original_width", "basis_hash", "version", "num_coefficients", "compression_ratio"))


def compression_stats(compressed: DataFrame) -> DataFrame:
    total = F.col("original_height") * F.col("original_width")
    kept = F.size("indices")
    return compressed.select("*", total.alias("total"), kept.alias("kept_count"), (1 - kept / total).alias("ratio"), (8 * total / (20 * kept + 100)).alias("storage_ratio"))


def classical_steps(m: int, n: int, inverse: bool = False) -> list[tuple[str, np.ndarray]]:
    """The plain discrete Fourier transform, as a baseline."""
    sign = 1 if inverse else -1
    dft = lambda size: np.exp(sign * 2j * np.pi * (np.outer(np.arange(size), np.arange(size)) % size) / size) / np.sqrt(size)
    return [("row", dft(2**m)), ("col", dft(2**n))]


def cosine_steps(m: int, n: int, inverse: bool = False) -> list[tuple[str, np.ndarray]]:
    """The orthonormal cosine transform (type 2), as a baseline."""

    def dct(size: int) -> np.ndarray:
        k = np.sqrt(2 / size) * np.cos(np.pi * np.outer(np.arange(size), 2 * np.arange(size) + 1) / (2 * size))
        k[0] /= math.sqrt(2)
        return k.T if inverse else k

    return [("row", dct(2**m)), ("col", dct(2**n))]


def baseline_recovered(images: DataFrame, m: int, n: int, ratio: float, kind: str = "fft") -> DataFrame:
    """Images from the coefficients that a fixed transform ("fft" or "dct") keeps at a ratio; the real part is the picture."""
    steps = {"fft": classical_steps, "dct": cosine_steps}[kind]
    low = truncated(apply_steps(images, steps(m, n), m, n, im=None), keep_count(2 ** (m + n), ratio), 2 ** (m + n))
    return apply_steps(low, steps(m, n, inverse=True), m, n)
