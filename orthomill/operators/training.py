"""Fitting circuit gates to a table of images.

Pictures are real (``re``) or complex (``re`` and ``im``). The driver holds the gates (a few hundred numbers). A step is one Spark job: every task adds
up loss and gradient of its images, and an aggregate by gate entry adds the tasks' sums, so
what reaches the driver has the size of the gates. A line search takes three jobs at most: the
full step, then shorter ones, several together. Images of at most ``ONE_TASK_VALUES`` values in all
are fitted in one task by the same code.

Behaviour: moments of Adam last over steps; without validation rows the last gates are
returned, else the best; patience counts from the second epoch on and equal loss is no
improvement; a last, shorter batch weighs as much as a full one. By default rows go to the
validation part and to batches by a hash of their id, so no global numbering is needed. An epoch's
rows are shuffled and written once, in order of their batches, and every batch reads its own part. With
``batch_size`` the parts are exact: rows are numbered in the order of a seeded hash, the
first ``validation_count`` are held out, and every epoch cuts the others, in an order of its
own, into batches of that size, the last one shorter.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.series import learning_rate_at, validation_count
from ..sources.files import save_checkpoint
from ..sources.tables import forget, written
from .basis import Basis, matrix_of, place_weights
from .losses import LOSSES
from .circuits import Gate
from .manifolds import MANIFOLDS, transport


TRAINED = (*LOSSES, "weighted", "roundtrip")


def project_phase_columns(zr: Column, zi: Column, gr: Column, gi: Column) -> tuple[Column, Column]:
    turn = zr * gi - zi * gr
    return -turn * zi, turn * zr


def retract_phase_columns(zr: Column, zi: Column, xr: Column, xi: Column, alpha: float) -> tuple[Column, Column]:
    a, b = zr + alpha * xr, zi + alpha * xi
    size = F.sqrt(a * a + b * b)
    return a / size, b / size


def keep_mask(y: np.ndarray, k: int) -> np.ndarray:
    """True for the k largest entries of each column, lowest place first among ties."""
    if k >= len(y):
        return np.ones(y.shape, bool)
    size = np.round(np.abs(y), 12)
    least = -np.partition(-size, k - 1, axis=0)[k - 1]
    above, equal = size > least, size == least
    return above | equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0))


def keep_weighted(y: np.ndarray, k: int, m: int) -> np.ndarray:
    """True where a column's size times its place's weight reaches the k-th largest such score, ties included."""
    scores = np.round(np.abs(y) * place_weights(m, len(y).bit_length() - 1 - m)[:, None], 12)
    return scores >= -np.partition(-scores, min(k, len(y)) - 1, axis=0)[min(k, len(y)) - 1]


def by_bits(values: np.ndarray, qubits: tuple[int, int]) -> np.ndarray:
    """A view of values by place with an axis each for the higher and the lower of two qubits (axes 1 and 3)."""
    low, high = sorted(q - 1 for q in qubits)
    return values.reshape(-1, 2, 1 << high - low - 1, 2, 1 << low)


def blocks_of(gates: list[Gate], qubits: int) -> list[tuple[int | None, list[int], np.ndarray]]:
    """Runs of phase gates as one diagonal (None, their numbers, 2^qubits factors); each other gate alone (its qubit from 0, number, matrix)."""
    out = []
    for i, g in enumerate(gates):
        if g.role == "h":
            out.append((g.qubits[0] - 1, [i], g.matrix))
            continue
        if not out or out[-1][0] is not None:
            out.append((None, [], np.ones((1 << qubits, 1), complex)))
        out[-1][1].append(i)
        view = by_bits(out[-1][2], g.qubits)
        view *= (g.matrix if g.qubits[0] > g.qubits[1] else g.matrix.T)[None, :, None, :, None]
    return out


def mixed(matrix: np.ndarray, state: np.ndarray, qubit: int) -> np.ndarray:
    """A 2x2 matrix applied along one qubit of (2^qubits, images) states."""
    pair = state.reshape(-1, 2, state.shape[1] << qubit)
    matrix = matrix if matrix.imag.any() else matrix.real
    out, part = np.empty_like(pair), np.empty_like(pair[:, 0])
    for i in (0, 1):
        np.multiply(pair[:, 0], matrix[i, 0], out=out[:, i])
        np.multiply(pair[:, 1], matrix[i, 1], out=part)
        out[:, i] += part
    return out.reshape(state.shape)


def loss_and_gradient(gates: list[Gate], x: np.ndarray, qubits: int, loss: str, k: int, gradient: bool = True, m: int = 0):
    """Summed loss over the columns of ``x`` and its gradient by gate (dL/dRe + i dL/dIm).

    "weighted" is the squared error of the alternative selection, for pictures of 2^m rows; what a
    selection keeps counts as fixed in the gradient. "roundtrip" is the squared error too, by the way back
    through the conjugate circuit, so it also holds for gates that left their manifold.
    """
    if loss == "roundtrip":
        return round_trip(gates, np.ascontiguousarray(x, complex), qubits, k, gradient)
    state, blocks = np.ascontiguousarray(x, complex), blocks_of(gates, qubits)
    for qubit, _, block in blocks:
        state = block * state if qubit is None else mixed(block, state, qubit)
    if loss == "l1":
        size = np.abs(state)
        total, bar = float(size.sum()), np.where(size > 0, state / np.where(size > 0, size, 1), 0)
    else:
        kept = np.where(keep_weighted(state, k, m) if loss == "weighted" else keep_mask(state, k), state, 0)
        total = float((np.abs(x) ** 2).sum() - (np.abs(kept) ** 2).sum())
        bar = -2 * kept
    if not gradient:
        return total, []
    return total, list(backwards(gates, blocks, state, bar)[2])


def backwards(gates: list[Gate], blocks, state: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State and gradient before the gates from those after them, and each gate's own gradient."""
    grads = np.zeros((len(gates), 2, 2), complex)
    for qubit, numbers, block in reversed(blocks):  # gates stay on their manifolds, so their adjoints undo them
        if qubit is None:
            each = np.einsum("ij,ij->i", state.conj(), bar)  # by place; unit phases of the run's other gates cancel out
            for i in numbers:
                sums = by_bits(each, gates[i].qubits).sum(axis=(0, 2, 4))
                grads[i] = (sums if gates[i].qubits[0] > gates[i].qubits[1] else sums.T) * gates[i].matrix
            back = block.conj()
            state, bar = back * state, back * bar
        else:
            state = mixed(block.conj().T, state, qubit)
            a, b = state.conj().reshape(-1, 2, state.shape[1] << qubit), bar.reshape(-1, 2, bar.shape[1] << qubit)
            grads[numbers[0]] = np.array([[np.einsum("ij,ij->", b[:, i], a[:, j]) for j in (0, 1)] for i in (0, 1)])
            bar = mixed(block.conj().T, bar, qubit)
    return state, bar, grads


def applied(block, qubit: int | None, state: np.ndarray, back: bool = False) -> np.ndarray:
    """A block of ``blocks_of``, or its conjugate transpose, applied to states."""
    if qubit is None:
        return (block.conj() if back else block) * state
    return mixed(block.conj().T if back else block, state, qubit)


def entry_gradients(gates: list[Gate], qubit: int | None, numbers: list[int], after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Gradient by entry of a block's gates: ``after`` times the conjugate of ``before``, and of the other gates of a run of diagonals."""
    if qubit is not None:
        a, b = (v.reshape(-1, 2, v.shape[1] << qubit) for v in (before.conj(), after))
        return np.array([[[np.einsum("ij,ij->", b[:, i], a[:, j]) for j in (0, 1)] for i in (0, 1)]])
    each = np.einsum("ij,ij->i", after, before.conj())
    factors = np.ones((len(numbers), len(each)), complex)
    for factor, i in zip(factors, numbers):
        view = by_bits(factor, gates[i].qubits)
        view *= (gates[i].matrix if gates[i].qubits[0] > gates[i].qubits[1] else gates[i].matrix.T)[None, :, None, :, None]
    # products of the gates before and after each one, as entries may be zero
    lower, upper = np.ones_like(factors), np.ones_like(factors)
    lower[1:], upper[:-1] = np.cumprod(factors[:-1], axis=0), np.cumprod(factors[:0:-1], axis=0)[::-1]
    sums = [by_bits(each * (a * b).conj(), gates[i].qubits).sum(axis=(0, 2, 4)) for a, b, i in zip(lower, upper, numbers)]
    return np.array([s if gates[i].qubits[0] > gates[i].qubits[1] else s.T for s, i in zip(sums, numbers)])


def round_trip(gates: list[Gate], x: np.ndarray, qubits: int, k: int, gradient: bool):
    """Squared error of what the conjugate circuit makes of the k largest coefficients, and its gradient by gate.

    Nothing is undone by adjoints: states are kept on both ways, two arrays of the size of ``x`` a block.
    """
    blocks, ahead = blocks_of(gates, qubits), [x]
    for qubit, _, block in blocks:
        ahead.append(applied(block, qubit, ahead[-1]))
    mask = keep_mask(ahead[-1], k)
    home = [np.where(mask, ahead[-1], 0)]
    for qubit, _, block in reversed(blocks):
        home.append(applied(block, qubit, home[-1], back=True))
    home.reverse()
    error = home[0] - x
    total = float((np.abs(error) ** 2).sum())
    if not gradient:
        return total, []
    grads, bar = np.zeros((len(gates), 2, 2), complex), 2 * error
    for (qubit, numbers, block), state in zip(blocks, home[1:]):
        grads[numbers] += entry_gradients(gates, qubit, numbers, state, bar)
        bar = applied(block, qubit, bar)
    bar = np.where(mask, bar, 0)
    for (qubit, numbers, block), state in zip(reversed(blocks), reversed(ahead[:-1])):
        grads[numbers] += entry_gradients(gates, qubit, numbers, bar, state)
        bar = applied(block, qubit, bar, back=True)
    return total, list(grads)


def values_of(images: DataFrame) -> list[str]:
    """The columns that hold pictures: ``im`` too where they are complex."""
    return ["re", "im"] if "im" in images.columns else ["re"]


def states_of(batch: pa.RecordBatch, qubits: int) -> np.ndarray:
    """Pictures of a batch (re, or re and im) as columns."""
    re, *im = (matrix_of(c, 2**qubits) for c in batch.columns)
    return (re + 1j * im[0] if im else re).T


def checked(loss: str, optimizer: Optimizer) -> None:
    """Errors for losses that are not there, or that need gates on their own manifolds where the optimizer takes them off."""
    if loss not in TRAINED:
        raise ValueError(f"unknown loss {loss!r}; there are {', '.join(TRAINED)}")
    if optimizer.manifold and loss != "roundtrip":
        raise ValueError(f"gates on {optimizer.manifold!r} need the loss 'roundtrip', as {loss!r} takes the circuit for unitary")


def evaluate(images: DataFrame, candidates: list[list[Gate]], qubits: int, loss: str, k: int, gradient: bool = False, m: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean loss of each candidate, and the mean gradient of the first, in one job."""
    if loss not in TRAINED:
        raise ValueError(f"unknown loss {loss!r}; there are {', '.join(TRAINED)}")

    def run(batches):
        n, sums = 0, [0.0] * len(candidates)
        grad = np.zeros((len(candidates[0]), 2, 2), complex)
        for b in batches:
            x = states_of(b, qubits)
            n += b.num_rows
            for i, gates in enumerate(candidates):
                total, g = loss_and_gradient(gates, x, qubits, loss, k, gradient and not i, m)
                sums[i] += total
                if g:
                    grad += np.array(g)
        flat = np.concatenate([[n], sums, grad.real.ravel(), grad.imag.ravel()] if gradient else [[n], sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(float))], ["at", "v"])

    parts = images.select(*values_of(images)).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    got = {r["at"]: r["v"] for r in parts.collect()}  # as many rows as there are parameters
    flat = np.array([got[i] for i in sorted(got)])
    n = flat[0] if len(flat) else 0
    if not n:
        return np.full(len(candidates), math.inf), []
    means = flat[1 : 1 + len(candidates)] / n
    if not gradient:
        return means, []
    re, im = flat[1 + len(candidates) :].reshape(2, -1, 2, 2) / n
    return means, list(re + 1j * im)


@dataclass
class Optimizer:
    """Riemannian gradient descent with Armijo search, or Riemannian Adam.

    ``manifold`` puts all gates on one manifold instead of each on its own: "stiefel_polar" or
    "stiefel_qr" is what general manifold optimizers do with circuits. Phase gates then turn into
    unitary matrices, the circuit is no longer unitary, and the loss has to be "roundtrip".
    """

    kind: str = "adam"
    rate: float = 0.001
    clip: float | None = None
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    armijo: float = 1e-4
    shrink: float = 0.5
    tries: int = 10
    manifold: str | None = None
    steps: int = 0
    first: list = field(default_factory=list)
    second: list = field(default_factory=list)

    def step(self, gates: list[Gate], grads: list[np.ndarray], rate: float, loss: float, losses_of) -> tuple[list[Gate], float]:
        """New gates and the gradient's norm; ``losses_of`` evaluates candidate gate lists together."""
        kind_of = lambda g: self.manifold or g.manifold
        tangent = [MANIFOLDS[kind_of(g)].project(g.matrix, d) for g, d in zip(gates, grads)]
        norm = math.sqrt(sum(float((np.abs(t) ** 2).sum()) for t in tangent))
        if not math.isfinite(norm):
            return gates, norm
        if self.clip and norm > self.clip:
            tangent = [t * (self.clip / norm) for t in tangent]
            norm = self.clip
        moved = lambda way, a: [Gate(g.role, g.qubits, MANIFOLDS[kind_of(g)].retract(g.matrix, w, a), g.entangling) for g, w in zip(gates, way)]
        if self.kind == "gd":
            sizes = [rate * self.shrink**j for j in range(self.tries)]
            tried = [moved([-t for t in tangent], a) for a in sizes]
            # the full step mostly does, or one not much shorter; those of a part are evaluated together, in one job
            for part in (slice(0, 1), slice(1, 4), slice(4, None)):
                for new, a, value in zip(tried[part], sizes[part], losses_of(tried[part]) if tried[part] else []):
                    if value <= loss - self.armijo * a * norm**2:
                        return new, norm
            return tried[-1], norm
        self.steps += 1
        if not self.first:
            self.first, self.second = [np.zeros((2, 2), complex) for _ in gates], [np.zeros((2, 2)) for _ in gates]
        b1, b2 = self.betas
        self.first = [b1 * m + (1 - b1) * t for m, t in zip(self.first, tangent)]
        self.second = [b2 * v + (1 - b2) * np.abs(t) ** 2 for v, t in zip(self.second, tangent)]
        way = [-(m / (1 - b1**self.steps)) / (np.sqrt(v / (1 - b2**self.steps)) + self.eps) for m, v in zip(self.first, self.second)]
        new = moved([MANIFOLDS[kind_of(g)].project(g.matrix, w) for g, w in zip(gates, way)], rate)
        self.first = [transport(kind_of(g), g.matrix, m) for g, m in zip(new, self.first)]
        return new, norm


@dataclass
class Trained:
    basis: Basis
    epochs: list[tuple[int, float, float]]
    steps: list[tuple[int, int, int, float]]

    def history_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e, t, None if math.isinf(v) else v) for e, t, v in self.epochs]
        return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double")

    def steps_frame(self, spark: SparkSession, alpha: float = 0.6) -> DataFrame:
        """What a plot of the steps shows: each step's loss and its moving average."""
        rows, smooth = [], None
        for step, epoch, batch, loss in self.steps:
            smooth = loss if smooth is None else alpha * smooth + (1 - alpha) * loss
            rows.append((step, epoch, batch, loss, smooth))
        return spark.createDataFrame(rows, "step int, epoch int, batch int, loss double, smoothed double")


def compare(spark: SparkSession, runs: dict[str, Trained], loss: str = "both") -> DataFrame:
    """What a comparison of runs shows: name, epoch, kind ("train" or "validation") and loss."""
    if loss not in ("train", "validation", "both"):
        raise ValueError("loss must be train, validation or both")
    out = None
    for name, run in runs.items():
        each = run.history_frame(spark).select(F.lit(name).alias("name"), "epoch", F.explode(F.create_map(F.lit("train"), "train_loss", F.lit("validation"), "val_loss")).alias("kind", "loss"))
        out = each if out is None else out.unionByName(each)
    return out if loss == "both" else out.filter(F.col("kind") == loss)


def compare_steps(spark: SparkSession, runs: dict[str, Trained], alpha: float = 0.6, columns: int = 3) -> DataFrame:
    """Steps of several runs, and each run's place in a grid of at most ``columns`` columns."""
    out = None
    for i, (name, run) in enumerate(runs.items()):
        wide = min(columns, len(runs))
        each = run.steps_frame(spark, alpha).select(F.lit(name).alias("name"), F.lit(i // wide).alias("grid_row"), F.lit(i % wide).alias("grid_column"), "step", "epoch", "loss", "smoothed")
        out = each if out is None else out.unionByName(each)
    return out


def descend(gates: list[Gate], optimizer: Optimizer, measure, max_iter: int, tol: float) -> tuple[list[Gate], list[float]]:
    """The last gates, and the losses before each step and after the last. ``measure(candidates, gradient)`` gives mean losses and the first's gradient."""
    trace, last = [], None

    def losses_of(candidates):
        values = measure(candidates, False)[0]
        tried.extend(zip(candidates, values))
        return values

    for _ in range(max_iter):
        (last,), grads = measure([gates], True)
        trace.append(float(last))
        if not grads:
            break
        tried: list = []
        new, norm = optimizer.step(gates, grads, optimizer.rate, last, losses_of)
        if norm < tol or not math.isfinite(norm):
            break
        gates, last = new, next((value for each, value in tried if each is new), None)  # a line search has measured it
    return gates, [*trace, float(measure([gates], False)[0][0] if last is None else last)]


#: Up to so many values, all steps run in one task: a job a step would take longer than the steps.
ONE_TASK_VALUES = 100_000


def descend_in_task(rows: DataFrame, gates: list[Gate], optimizer: Optimizer, qubits: int, loss: str, k: int, max_iter: int, tol: float, m: int = 0):
    """``descend`` on a few images, in one task."""

    def run(batches):
        x = np.concatenate([np.zeros((2**qubits, 0)), *[states_of(b, qubits) for b in batches]], axis=1)

        def measure(candidates, gradient):
            each = [loss_and_gradient(c, x, qubits, loss, k, gradient and not i, m) for i, c in enumerate(candidates)]
            return np.array([t for t, _ in each]) / x.shape[1], [g / x.shape[1] for g in each[0][1]]

        result = pickle.dumps((*descend(gates, optimizer, measure, max_iter, tol), optimizer))
        yield pa.RecordBatch.from_arrays([pa.array([result], pa.binary())], ["result"])

    return pickle.loads(rows.coalesce(1).mapInArrow(run, "result binary").first()[0])


def optimize(images: DataFrame, basis: Basis, optimizer: Optimizer, loss: str = "mse", k: int | None = None, max_iter: int = 100, tol: float = 1e-6) -> tuple[Basis, list[float]]:
    """Full-batch optimisation; the losses before each step, and the last."""
    checked(loss, optimizer)
    qubits, gates = basis.m + basis.n, list(basis.gates)
    k = max(1, round(0.1 * basis.size)) if k is None else k
    values = values_of(images)
    rows = images.select(*values).filter(" and ".join(f"{c} is not null" for c in values)).persist()
    try:
        n = rows.count()
        if 0 < n * basis.size <= ONE_TASK_VALUES:
            gates, trace, done = descend_in_task(rows, gates, optimizer, qubits, loss, k, max_iter, tol, basis.m)
            optimizer.__dict__.update(done.__dict__)
        else:
            gates, trace = descend(gates, optimizer, lambda c, gradient: evaluate(rows, c, qubits, loss, k, gradient, basis.m), max_iter, tol)
    finally:
        rows.unpersist()
    return Basis(basis.family, basis.m, basis.n, tuple(gates), basis.position), trace


def numbered(rows: DataFrame, id_col: str, seed: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of a seeded hash of the id, by ranges of hashes, so no task numbers all rows."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    dealt = rows.withColumn("_key", key).withColumn("_range", F.shiftright("_key", 52))  # at most 4,096 ranges
    order = W.partitionBy("_range").orderBy("_key", id_col)
    before = rows.select(F.shiftright(key, 52).alias("_range")).groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = before.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return dealt.join(starts, "_range").withColumn(name, F.col("_start") + F.row_number().over(order) - 1).drop("_key", "_range", "_start")


def by_batch(rows: DataFrame) -> DataFrame:
    """An epoch's rows written in order of their ``batch``, so that a batch is read from the files, or parts of them, that hold it."""
    return written(rows.repartitionByRange("batch").sortWithinPartitions("batch"))


def train(images: DataFrame, family: str, m: int, n: int, epochs: int = 3, split: float = 0.2, batches: int = 2, patience: int = 2, loss: str = "mse", k: int | None = None,
          phases=None, position: str = "back", optimizer: Optimizer | None = None, peak: float = 0.01, final: float = 0.001, warmup: float = 0.05, id_col: str = "img_id", seed: int = 42,
          checkpoint_dir: str | None = None, checkpoint_every: int = 0, batch_size: int | None = None) -> Trained:
    """Fit a basis to images. Ring and hierarchy start from small random phases unless some are given.

    Every ``checkpoint_every`` steps the history and basis so far are saved in ``checkpoint_dir``.
    """
    start = Basis.make(family, m, n, phases, position)
    if phases is None and family in ("tebd", "mera"):
        start = Basis.make(family, m, n, tuple(0.1 * np.random.default_rng(seed).standard_normal(len(start.phases))), position)
    k = max(1, round(0.1 * start.size)) if k is None else k
    optimizer, values = optimizer or Optimizer(), values_of(images)
    checked(loss, optimizer)
    if batch_size is None:
        share = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(10_000))
        rows = images.select(id_col, *values, (share < int(split * 10_000)).alias("held")).persist()
        part_of = lambda training, epoch: training.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed + epoch), F.col(id_col)), F.lit(batches)))
    else:
        total = images.count()
        n_held = validation_count(total, split)
        n_training = max(1, total - n_held)
        batch_size = min(max(1, batch_size), n_training)
        batches = -(-n_training // batch_size)
        rows = numbered(images.select(id_col, *values), id_col, seed, "at").select(id_col, *values, (F.col("at") < n_held).alias("held")).persist()
        part_of = lambda training, epoch: numbered(training, id_col, seed + epoch, "at").withColumn("batch", F.expr(f"at div {batch_size}"))
    try:
        training, held = rows.filter("not held"), rows.filter("held")
        gates, best, best_loss, waited, log, steps, done = list(start.gates), list(start.gates), math.inf, 0, [], [], 0
        for epoch in range(1, epochs + 1):
            means, shuffled = [], by_batch(part_of(training, epoch))
            for batch in range(batches):
                part = shuffled.filter(F.col("batch") == batch)
                (value,), grads = evaluate(part, [gates], m + n, loss, k, gradient=True, m=m)
                if not grads:
                    continue
                done += 1
                rate = learning_rate_at(done, epochs * batches, warmup, peak, final)
                gates, _ = optimizer.step(gates, grads, rate, value, lambda c, part=part: evaluate(part, c, m + n, loss, k, m=m)[0])
                means.append(float(value))
                steps.append((done, epoch, batch + 1, float(value)))
                if checkpoint_dir and checkpoint_every and done % checkpoint_every == 0:
                    save_checkpoint(Trained(Basis(family, m, n, tuple(gates), position), log, steps), checkpoint_dir, done, family)
            forget(shuffled)
            value = float(evaluate(held, [gates], m + n, loss, k, m=m)[0][0])
            log.append((epoch, float(np.mean(means)) if means else math.inf, value))
            if value < best_loss:
                best, best_loss, waited = list(gates), value, 0
            elif epoch > 1:
                waited += 1
                if waited >= patience:
                    break
    finally:
        rows.unpersist()
    chosen = gates if math.isinf(best_loss) else best
    return Trained(Basis(family, m, n, tuple(chosen), position), log, steps)
