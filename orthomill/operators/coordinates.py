"""Images too large for one row, as rows of (id, lin, re, im): transform, selection, recovery, similarity, loss and gradient.

A circuit acts on rows and columns apart, so an image is dealt by column, transformed column by
column, dealt by row and transformed row by row: two shuffles of its pixels. A task holds one
column or row at a time, gate by gate, never a kernel matrix. Entangling gates are a phase of each
pixel by its place, before, between or after the two. The inverse takes the same ways backwards
with the gates' adjoints; lines without a pixel are never made.

The largest coefficients are found by counting: a histogram of sizes per image narrows the range in
which the last kept one lies, round by round, so no image is sorted in a task.

Absent pixels are zeros; pixels of one place add up; a null id is an image of its own; a place
outside the image is an error.

Several circuits of one size (those that a line search tries) are evaluated together, by the same
jobs: an image's id becomes (n, id), n the circuit's number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from ..sources.tables import forget, written
from .basis import Basis, keep_count, lists_of
from .circuits import Gate, mask_place, run_gates
from .training import Optimizer, backwards, blocks_of, descend

#: Bins of a histogram of an image's sizes, and coefficients that may be ranked together at the end.
BINS, RANKED = 4096, 4096
#: Sizes are compared in these units.
UNIT = 1e-9


def phased(rows: DataFrame, *circuits: list[Gate]) -> DataFrame:
    """Each pixel turned by the angles that the gates of its circuit have for the bits of its place; pairs of columns (re, im) and, if there, (bre, bim)."""
    if not circuits[0]:
        return rows
    turned = rows.withColumn("_turn", sum((angle_of(*gates) for gates in zip(*circuits)), F.lit(0.0)))
    pairs = [("re", "im"), ("bre", "bim")] if "bre" in rows.columns else [("re", "im")]
    values = [v for a, b in pairs for v in ((F.col(a) * F.cos("_turn") - F.col(b) * F.sin("_turn")).alias(a), (F.col(a) * F.sin("_turn") + F.col(b) * F.cos("_turn")).alias(b))]
    return turned.select("id", "lin", *values)


def bits_of(g: Gate):
    """Which of a gate's four entries a place has: the first qubit's bit twice, and the second's."""
    a, b = (F.shiftright("lin", q - 1).bitwiseAND(1) for q in g.qubits)
    return (a * 2 + b).cast("int")


def angle_of(*gates: Gate):
    """The angle of a gate for a place; of several, which stand at one position of as many circuits, that of the row's circuit."""
    angles = F.array(*[F.lit(float(x)) for g in gates for x in np.angle(g.matrix).ravel()])
    return F.get(angles, bits_of(gates[0]) + (F.col("id.n") * 4 if len(gates) > 1 else 0))


def adjoint(g: Gate) -> Gate:
    return Gate(g.role, g.qubits, g.matrix.conj().T if g.role == "h" else g.matrix.conj(), g.entangling)


def lines_of(rows: DataFrame, line, place, values: list[str]) -> DataFrame:
    """id, line and z, the line's pixels with their places."""
    return rows.select("id", line.alias("line"), F.struct(place.alias("at"), *values).alias("z")).groupBy("id", "line").agg(F.collect_list("z").alias("z"))


def dense(lists: pa.ListArray, side: int, values: int) -> list[np.ndarray]:
    """A line per row as columns of (side, lines) arrays: one complex array for every two values."""
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at, *parts = (lists.flatten().field(i).to_numpy() for i in range(values + 1))
    if len(at) and not 0 <= at.min() <= at.max() < side:
        raise ValueError("a pixel lies outside the image")
    out = []
    for re, im in zip(parts[::2], parts[1::2]):
        x = np.zeros((side, len(lists)), complex)
        np.add.at(x, (at, owner), re + 1j * im)
        out.append(x)
    return out


def along(rows: DataFrame, circuits: list[list[Gate]], bits: int, line, place, deal: bool = False) -> DataFrame:
    """Every line of every image run through the gates of its circuit; ``line`` and ``place`` say which line a pixel is in, and where.

    With ``deal`` every line is run through every circuit, and ids become (n, id).
    """
    side = 1 << bits
    lines = lines_of(rows, line, place, ["re", "im"])
    kind, id_type = lines.schema["id"].dataType.simpleString(), to_arrow_type(lines.schema["id"].dataType)

    def run(batches):
        for b in batches:
            step = max(1, 500_000 // side)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                (x,) = dense(part.column(2), side, 2)
                which = part.column(0).field("n").to_numpy() if len(circuits) > 1 and not deal else None
                for n, gates in enumerate(circuits):
                    mine = np.arange(part.num_rows) if which is None else np.flatnonzero(which == n)
                    y = np.ascontiguousarray(run_gates(gates, x[:, mine], bits).T)
                    ids, at = (part.column(i).take(pa.array(mine)) for i in (0, 1))
                    if deal:
                        ids = pa.StructArray.from_arrays([pa.array(np.full(len(mine), n), pa.int32()), ids], fields=[pa.field("n", pa.int32()), pa.field("id", id_type)])
                    yield pa.RecordBatch.from_arrays([ids, at, lists_of(y.real), lists_of(y.imag)], ["id", "line", "re", "im"])

    done = lines.mapInArrow(run, f"id {f'struct<n:int,id:{kind}>' if deal else kind}, line long, re array<double>, im array<double>")
    return done.select("id", "line", F.posexplode(F.arrays_zip("re", "im")).alias("at", "z")).select("id", "line", F.col("at").cast("long").alias("at"), "z.re", "z.im")


class Ways:
    """A basis's gates by the way they go: within columns, within rows, and entangling ones at their spot."""

    def __init__(self, basis: Basis):
        self.m, self.n, h = basis.m, basis.n, 2**basis.m
        gates = list(enumerate(basis.gates))
        self.joins = [(i, g) for i, g in gates if g.entangling]
        self.first = [(i, g) for i, g in gates if not g.entangling and max(g.qubits) <= self.m]
        self.second = [(i, Gate(g.role, tuple(q - self.m for q in g.qubits), g.matrix)) for i, g in gates if not g.entangling and min(g.qubits) > self.m]
        # how many of the two products come before the entangling gates
        self.spot = {"front": 0, "middle": 1, "back": 2}[mask_place(list(basis.gates))]
        within, across = F.expr(f"cast(lin % {h} as int)"), F.expr(f"lin div {h}")
        # by way: gates, bits, line and place of a pixel, and the pixel of a line and place
        self.by_way = [(self.first, self.m, across, within, F.col("at") + F.col("line") * h), (self.second, self.n, F.expr(f"lin % {h}"), F.expr(f"cast(lin div {h} as int)"), F.col("line") + F.col("at") * h)]


def transform(rows: DataFrame, basis: Basis) -> DataFrame:
    """id, lin, re, im of the coefficients; ``rows`` has the same columns, lin from 0 in column-major order."""
    return transformed(rows, [basis], False)


def transform_each(rows: DataFrame, bases: list[Basis]) -> DataFrame:
    """The same by each of several bases that differ in their gates' matrices only; ids are (n, id), n the basis's number."""
    return transformed(rows, bases, True)


def transformed(rows: DataFrame, bases: list[Basis], deal: bool) -> DataFrame:
    ways = [Ways(b) for b in bases]
    joins = [[g for _, g in w.joins] for w in ways]
    if deal and ways[0].spot == 0:  # the bases differ from the first step on, else lines are shuffled once for all
        each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(len(bases) - 1))).alias("n"), "id", "lin", "re", "im")
        rows, deal = each.select(F.struct("n", "id").alias("id"), "lin", "re", "im"), False
    for spot, (_, bits, line, place, lin) in enumerate(ways[0].by_way):
        if ways[0].spot == spot:
            rows = phased(rows, *joins)
        rows = along(rows, [[g for _, g in w.by_way[spot][0]] for w in ways], bits, line, place, deal and spot == 0).select("id", lin.alias("lin"), "re", "im")
    return phased(rows, *joins) if ways[0].spot == 2 else rows


def inverse(rows: DataFrame, basis: Basis) -> DataFrame:
    """id, lin, re, im of the images of coefficients, of which any may be absent."""
    ways = Ways(basis)
    joins = [adjoint(g) for _, g in ways.joins]
    for spot in (1, 0):
        gates, bits, line, place, lin = ways.by_way[spot]
        rows = phased(rows, joins if ways.spot == spot + 1 else [])
        rows = along(rows, [[adjoint(g) for _, g in reversed(gates)]], bits, line, place).select("id", lin.alias("lin"), "re", "im")
    return phased(rows, joins if ways.spot == 0 else [])


def narrowed(values: DataFrame, need: DataFrame | int) -> DataFrame:
    """id, low, high, held, rest: the range [low, high) of an image's values ``v`` (whole numbers) that holds the ``need``-th smallest, how many it holds, and how many of it are wanted.

    Round by round the range becomes the bin of its histogram in which that value lies, until the bin
    has at most ``RANKED`` values or is one value wide. Images with fewer values get a range with all.
    ``need`` is a number for all images, or a table of it by image (``of``).
    """
    state = values.groupBy("id").agg(F.min("v").alias("low"), (F.max("v") + 1).alias("high"), F.count(F.lit(1)).alias("held"))
    if isinstance(need, int):
        state = state.withColumn("rest", F.least("held", F.lit(need)))
    else:
        state = state.join(need, F.col("id").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("need", "rest")
    state, done = written(state), None
    while True:
        settled = (F.col("held") <= RANKED) | (F.col("high") - F.col("low") <= 1)
        part = state.filter(settled)
        done = part if done is None else done.unionByName(part)
        open_ = state.filter(~settled)
        if open_.isEmpty():
            return done
        width = F.greatest(F.lit(1), F.expr(f"(high - low + {BINS - 1}) div {BINS}"))
        ranges = open_.select(F.col("id").alias("of"), "low", "high", "rest", width.alias("width"))
        inside = values.join(ranges, F.col("id").eqNullSafe(F.col("of")) & (F.col("v") >= F.col("low")) & (F.col("v") < F.col("high")))
        bins = inside.groupBy("id", "low", "width", "rest", F.expr("(v - low) div width").alias("bin")).agg(F.count(F.lit(1)).alias("held"))
        before = F.coalesce(F.sum("held").over(W.partitionBy("id").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most a row per bin
        cut = bins.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") >= F.col("rest")))
        low = F.col("low") + F.col("bin") * F.col("width")
        state = written(cut.select("id", low.alias("low"), (low + F.col("width")).alias("high"), "held", (F.col("rest") - F.col("before")).alias("rest")))


def largest(rows: DataFrame, k: int) -> DataFrame:
    """The k largest coefficients of every image, the lowest place first among equal ones; sizes within a billionth are equal.

    ``rows`` is read several times, so it should be a written table.
    """
    if k < 1:
        raise ValueError("at least one coefficient must be kept")
    size = -F.round(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / UNIT).cast("long")
    sized = rows.withColumn("v", size)
    cuts = written(narrowed(sized.select("id", "v"), k))
    own = cuts.select(F.col("id").alias("of"), "low", "high", "rest")
    placed = sized.join(own, F.col("id").eqNullSafe(F.col("of"))).drop("of")
    above = placed.filter(F.col("v") < F.col("low"))
    # the last range: ranked together if it is short, else its values are equal and the places are narrowed
    short = placed.filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("high"))).withColumn("last", F.col("rest"))
    many = cuts.filter(F.col("held") > RANKED).select(F.col("id").alias("of"), F.col("rest").alias("need"))
    if not many.isEmpty():
        tied = short.drop("last")
        by_place = narrowed(tied.select("id", F.col("lin").alias("v")), many).select(F.col("id").alias("of"), F.col("low").alias("from"), F.col("high").alias("to"), F.col("rest").alias("left"))
        tied = tied.join(by_place, F.col("id").eqNullSafe(F.col("of")), "left")
        above = above.unionByName(tied.filter(F.col("lin") < F.col("from")).select(*above.columns))
        short = tied.filter(F.col("from").isNull() | (F.col("lin") >= F.col("from")) & (F.col("lin") < F.col("to"))).withColumn("last", F.coalesce("left", "rest"))
    place = F.row_number().over(W.partitionBy("id").orderBy("v", "lin"))  # at most RANKED rows an image
    short = short.withColumn("place", place).filter(F.col("place") <= F.col("last"))
    return above.select(*rows.columns).unionByName(short.select(*rows.columns))


def compress(rows: DataFrame, basis: Basis, ratio: float | None = 0.9, k: int | None = None) -> DataFrame:
    """id, lin, re, im, basis_hash of the kept coefficients."""
    count = keep_count(basis.size, ratio) if k is None else min(k, basis.size)
    return largest(written(transform(rows, basis)), count).withColumn("basis_hash", F.lit(basis.basis_hash()))


def recover(kept: DataFrame, basis: Basis, verify_hash: bool = True) -> DataFrame:
    """id, lin, re, im of the images, from kept coefficients; those of another basis are an error."""
    if verify_hash:
        wrong = F.raise_error(F.lit("the image was compressed with another basis")).cast("double")
        kept = kept.withColumn("re", F.when(F.col("basis_hash") == basis.basis_hash(), F.col("re")).otherwise(wrong))
    return inverse(kept.select("id", "lin", "re", "im"), basis)


def energies(rows: DataFrame) -> DataFrame:
    """id, energy of every image."""
    return rows.groupBy("id").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))


def loss_and_kept(rows: DataFrame, basis: Basis, k: int) -> tuple[float, DataFrame, DataFrame]:
    """Mean squared error after keeping k coefficients an image, all coefficients and the kept ones, both written."""
    y = written(transform(rows, basis))
    kept = written(largest(y, k))
    whole, images = energies(y).agg(F.sum("energy"), F.count(F.lit(1))).first()
    return ((whole or 0.0) - (energies(kept).agg(F.sum("energy")).first()[0] or 0.0)) / max(1, images), y, kept


def losses_of_each(rows: DataFrame, bases: list[Basis], k: int) -> list[float]:
    """Mean squared errors by several bases, as ``loss_and_kept`` has them, evaluated by the same jobs; a number per basis reaches the driver."""
    y = written(transform_each(rows, bases))
    by_basis = lambda df: {r["n"]: r for r in energies(df).groupBy("id.n").agg(F.sum("energy").alias("energy"), F.count(F.lit(1)).alias("images")).collect()}
    whole, kept = by_basis(y), by_basis(largest(y, k))
    forget(y)
    return [(whole[n]["energy"] - kept[n]["energy"]) / whole[n]["images"] if n in whole else 0.0 for n in range(len(bases))]


def back_along(rows: DataFrame, gates: list[Gate], bits: int, line, place) -> DataFrame:
    """``along`` backwards for states and gradients: rows id, line, at, re, im, bre, bim, and rows of a number (``at``) and value (``re``) of the gates' gradients, whose line is null."""
    side = 1 << bits
    lines = lines_of(rows, line, place, ["re", "im", "bre", "bim"])
    names = ["id", "line", "at", "values"]
    kind = lines.schema["id"].dataType.simpleString()

    def run(batches):
        total = np.zeros((len(gates), 2, 2), complex)
        for b in batches:
            step = max(1, 250_000 // side)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                x, bar, grads = backwards(gates, blocks_of(gates, bits), *dense(part.column(2), side, 4))
                total += grads
                z = np.ascontiguousarray(np.stack([x.real, x.imag, bar.real, bar.imag]).transpose(2, 1, 0)).reshape(part.num_rows, side * 4)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.nulls(part.num_rows, pa.int32()), lists_of(z)], names)
        flat = np.concatenate([total.real.ravel(), total.imag.ravel()])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, lines_type), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), lists_of(flat[None])], names)

    lines_type = to_arrow_type(lines.schema["id"].dataType)
    return lines.mapInArrow(run, f"id {kind}, line long, at int, values array<double>")


def gradient(y: DataFrame, kept: DataFrame, basis: Basis) -> list[np.ndarray]:
    """Gradients of the mean squared error by gate, as the selection counts as fixed; sums by gate entry are all that reaches the driver."""
    ways = Ways(basis)
    images = y.select("id").distinct().count()
    grads = [np.zeros((2, 2), complex) for _ in basis.gates]
    mark = kept.select(F.col("id").alias("of"), F.col("lin").alias("at"), F.lit(-2.0).alias("factor"))
    bar = lambda c: F.coalesce(F.col("factor") * F.col(c), F.lit(0.0))
    rows = y.join(mark, F.col("id").eqNullSafe(F.col("of")) & (F.col("lin") == F.col("at")), "left").select("id", "lin", "re", "im", bar("re").alias("bre"), bar("im").alias("bim"))

    def past_joins(rows):
        re, im = F.col("re") * F.col("bre") + F.col("im") * F.col("bim"), F.col("re") * F.col("bim") - F.col("im") * F.col("bre")
        sums = [F.sum(F.when(bits_of(g) == e, v).otherwise(0.0)) for _, g in ways.joins for e in range(4) for v in (re, im)]
        if not sums:
            return rows
        found = np.array(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), float).reshape(-1, 2, 2, 2)
        for (i, g), s in zip(ways.joins, found):
            grads[i] = (s[..., 0] + 1j * s[..., 1]) * g.matrix
        return phased(rows, [adjoint(g) for _, g in ways.joins])

    for spot in (1, 0):
        gates, bits, line, place, lin = ways.by_way[spot]
        if ways.spot == spot + 1:
            rows = past_joins(written(rows))
        done = written(back_along(rows, [g for _, g in gates], bits, line, place))
        totals = done.filter("line is null").select(F.posexplode("values").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(8 * len(gates))
        for r in totals:
            flat[r["i"]] = r["v"]
        re, im = flat.reshape(2, -1, 2, 2)
        for (i, _), g in zip(gates, re + 1j * im):
            grads[i] = g
        each = F.expr("transform(sequence(0, size(values) div 4 - 1), i -> named_struct('re', values[4 * i], 'im', values[4 * i + 1], 'bre', values[4 * i + 2], 'bim', values[4 * i + 3]))")
        rows = done.filter("line is not null").select("id", "line", F.posexplode(each).alias("at", "z")).select("id", lin.cast("long").alias("lin"), "z.*")
    if ways.spot == 0:
        past_joins(written(rows))
    return [g / max(1, images) for g in grads]


def optimize(rows: DataFrame, basis: Basis, optimizer: Optimizer, k: int | None = None, max_iter: int = 10, tol: float = 1e-6) -> tuple[Basis, list[float]]:
    """Full-batch optimisation on coordinate rows (the squared error); the losses before each step, and the last."""
    k = max(1, round(0.1 * basis.size)) if k is None else k
    rows = written(rows.select("id", "lin", "re", "im"))
    as_basis = lambda gates: Basis(basis.family, basis.m, basis.n, tuple(gates), basis.position)

    def measure(candidates, with_gradient):
        if not with_gradient:
            return np.array(losses_of_each(rows, [as_basis(gates) for gates in candidates], k)), []
        value, y, kept = loss_and_kept(rows, as_basis(candidates[0]), k)
        grads = gradient(y, kept, as_basis(candidates[0]))
        forget(y, kept)
        return np.array([value, *(measure(candidates[1:], False)[0] if candidates[1:] else [])]), grads

    gates, trace = descend(list(basis.gates), optimizer, measure, max_iter, tol)
    return as_basis(gates), trace


#: Windows of a tile start in so many rows and columns.
TILE = 64


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, lin, x, y: the real parts of two tables' pixels, zero where one has none."""
    none = F.lit(0.0)
    both = a.select("id", "lin", F.col("re").alias("x"), none.alias("y")).unionByName(b.select("id", "lin", none.alias("x"), F.col("re").alias("y")))
    return both.groupBy("id", "lin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def similarity(pairs: DataFrame, m: int, n: int, window: int = 7) -> DataFrame:
    """id, ssim: the mean structural similarity over all places of a square window, for pictures (id, lin, x, y) of 2^m x 2^n after clamping to [0, 1].

    Windows are dealt to tiles by their first row and column, and a pixel goes to every tile whose windows
    reach it, so a task holds a tile and its margin at a time. Tiles without a pixel hold equal windows.
    """
    h, w = 2**m, 2**n
    side = min(window, h, w)
    c1, c2 = 0.01**2, 0.03**2
    rows, columns = F.expr(f"lin % {h}"), F.expr(f"lin div {h}")
    tiles = lambda at, last: F.sequence(F.floor(F.greatest(F.lit(0), at - (side - 1)) / TILE), F.floor(F.least(F.lit(last), at) / TILE))
    dealt = pairs.select("id", rows.alias("r"), columns.alias("c"), "x", "y").withColumn("i", F.explode(tiles(F.col("r"), h - side))).withColumn("j", F.explode(tiles(F.col("c"), w - side)))
    pixel = F.struct((F.col("r") - F.col("i") * TILE).cast("int").alias("r"), (F.col("c") - F.col("j") * TILE).cast("int").alias("c"), "x", "y")
    held = dealt.groupBy("id", "i", "j").agg(F.collect_list(pixel).alias("z"))  # a tile and its margin at most
    kind = held.schema["id"].dataType.simpleString()

    def means(x):
        return np.lib.stride_tricks.sliding_window_view(x, (side, side)).mean(axis=(2, 3))

    def run(batches):
        for b in batches:
            total, count = [], []
            for i, j, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                tall, wide = (min(TILE, size - side + 1 - at * TILE) + side - 1 for size, at in ((h, i), (w, j)))
                r, c, *values = (z.values.field(f).to_numpy() for f in range(4))
                x, y = np.zeros((2, tall, wide))
                x[r, c], y[r, c] = np.clip(values, 0, 1)
                mx, my = means(x), means(y)
                vx, vy, vxy = means(x * x) - mx * mx, means(y * y) - my * my, means(x * y) - mx * my
                each = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
                total.append(float(each.sum()))
                count.append(each.size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.float64()), pa.array(count, pa.int64())], ["id", "total", "count"])

    parts = held.mapInArrow(run, f"id {kind}, total double, count long")
    windows = (h - side + 1) * (w - side + 1)
    return parts.groupBy("id").agg(((F.sum("total") + windows - F.sum("count")) / windows).alias("ssim"))
