"""SQL for DuckDB that computes the transforms on (image, row, column) rows with kernel joins."""

from __future__ import annotations

VECTORS = "SELECT vec_id, label, (p - 1)::INT AS lin, embedding[p]::DOUBLE AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS p FROM embeddings)"
UNIT = f"SELECT vec_id, label, lin, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS v FROM ({VECTORS}) WINDOW w AS (PARTITION BY vec_id)"


def bit(x: str, i: int) -> str:
    return f"(({x} >> {i}) & 1)"


def reverse(x: str, bits: int) -> str:
    return "(" + " + ".join(f"{bit(x, i)} * {2 ** (bits - 1 - i)}" for i in range(bits)) + ")"


def kernel(kind: str, bits: int) -> str:
    n = 2**bits
    if kind == "wht":
        return f"SELECT a.i AS y, b.i AS x, (CASE WHEN bit_count(a.i & b.i) % 2 = 0 THEN 1 ELSE -1 END) / sqrt({n}.0) AS kr, 0.0::DOUBLE AS ki FROM range(0, {n}) a(i), range(0, {n}) b(i)"
    if kind.endswith("dct"):
        y, x = ("b.i", "a.i") if kind.startswith("inverse") else ("a.i", "b.i")
        return f"SELECT a.i AS y, b.i AS x, cos(pi() * {y} * (2 * {x} + 1) / {2 * n}.0) * sqrt(2.0::DOUBLE / {n}) / CASE WHEN {y} = 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END AS kr, 0.0::DOUBLE AS ki FROM range(0, {n}) a(i), range(0, {n}) b(i)"
    if kind == "inverse_fft":
        return f"SELECT a.i AS y, b.i AS x, cos(2 * pi() * ((a.i * b.i) % {n}) / {n}.0) / sqrt({n}.0) AS kr, sin(2 * pi() * ((a.i * b.i) % {n}) / {n}.0) / sqrt({n}.0) AS ki FROM range(0, {n}) a(i), range(0, {n}) b(i)"
    x, sign = (reverse("b.i", bits), "") if kind.endswith("qft") else ("b.i", "-")
    if kind.startswith("inverse"):
        # the conjugate transpose: rows are places in the image
        x, sign = f"({reverse('a.i', bits)} * b.i)", "-"
        angle = f"2 * pi() * ({x} % {n}) / {n}.0"
    else:
        angle = f"2 * pi() * ((a.i * {x}) % {n}) / {n}.0"
    return f"SELECT a.i AS y, b.i AS x, cos({angle}) / sqrt({n}.0) AS kr, {sign}sin({angle}) / sqrt({n}.0) AS ki FROM range(0, {n}) a(i), range(0, {n}) b(i)"


def phase_step(name: str, source: str, u: str, c: str, angle: str) -> str:
    return f"{name} AS (SELECT vec_id, {u}, {c}, re * cos(th) - im * sin(th) AS re, re * sin(th) + im * cos(th) AS im FROM (SELECT *, {angle} AS th FROM {source}))"


def joint(phases, m: int, n: int, u: str, c: str) -> str:
    return " + ".join(f"{p} * {bit(u, m - k)} * {bit(c, n - k)}" for k, p in enumerate(phases, 1))


def pairs(phases, which, u: str) -> str:
    return " + ".join(f"{p} * {bit(u, a - 1)} * {bit(u, b - 1)}" for p, (a, b) in zip(phases, which))


def transform(m: int, n: int, kind: str, tag: str = "f", source: str = "px", front: str = "", middle: str = "", back: str = "") -> str:
    """CTEs that end in ``tag`` (vec_id, u, w, re, im); angles are SQL over the indices of their place."""
    h = 2**m
    parts = [f"{tag}g AS (SELECT vec_id, lin % {h} AS r0, lin // {h} AS c0, re, im FROM {source})"]
    at = f"{tag}g"
    if front:
        parts.append(phase_step(f"{tag}a", at, "r0", "c0", front))
        at = f"{tag}a"
    parts.append(f"{tag}kr AS ({kernel(kind, m)}), {tag}kc AS ({kernel(kind, n)})")
    parts.append(f"{tag}s AS (SELECT vec_id, y AS u, c0, sum(re * kr - im * ki) AS re, sum(re * ki + im * kr) AS im FROM {at} JOIN {tag}kr ON r0 = x GROUP BY vec_id, y, c0)")
    at = f"{tag}s"
    if middle:
        parts.append(phase_step(f"{tag}m", at, "u", "c0", middle))
        at = f"{tag}m"
    last = f"{tag}t" if back else tag
    parts.append(f"{last} AS (SELECT vec_id, u, y AS w, sum(re * kr - im * ki) AS re, sum(re * ki + im * kr) AS im FROM {at} JOIN {tag}kc ON c0 = x GROUP BY vec_id, u, y)")
    if back:
        parts.append(phase_step(tag, last, "u", "w", back))
    return ", ".join(parts)


def with_pixels(body: str, pixels: str = VECTORS) -> str:
    return f"WITH v AS ({pixels}), px AS (SELECT vec_id, lin, v AS re, 0.0::DOUBLE AS im FROM v), {body}"


def all_coefficients(h: int) -> str:
    return f" SELECT vec_id, u + 1 + w * {h} AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM f"


def ranked(h: int, source: str = "f", tag: str = "rk") -> str:
    return f"{tag} AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sqrt(re * re + im * im), 9) DESC, w * {h} + u) AS rn FROM {source})"


ENTRIES = [(i, j) for i in (0, 1) for j in (0, 1)]


def matrix(prefix: str) -> list:
    """A 2x2 complex matrix as pairs of column names."""
    return [[(f"{prefix}{i}{j}r", f"{prefix}{i}{j}i") for j in (0, 1)] for i in (0, 1)]


def fixed(values) -> list:
    return [[(f"{complex(v).real!r}::DOUBLE", f"{complex(v).imag!r}::DOUBLE") for v in row] for row in values]


def times(a, b) -> list:
    term = lambda x, y: (f"({x[0]} * {y[0]} - {x[1]} * {y[1]})", f"({x[0]} * {y[1]} + {x[1]} * {y[0]})")
    return [[tuple(" + ".join(p) for p in zip(*[term(a[i][k], b[k][j]) for k in (0, 1)])) for j in (0, 1)] for i in (0, 1)]


def adjoint(a) -> list:
    return [[(a[j][i][0], f"-({a[j][i][1]})") for j in (0, 1)] for i in (0, 1)]


def skew(a) -> list:
    b = adjoint(a)
    return [[tuple(f"(({x}) - ({y})) / 2" for x, y in zip(a[i][j], b[i][j])) for j in (0, 1)] for i in (0, 1)]


def step(name: str, source: str, prefix: str, values) -> str:
    """A CTE that adds the matrix ``values`` to ``source`` as columns."""
    return f"{name} AS (SELECT *, " + ", ".join(f"{values[i][j][p]} AS {prefix}{i}{j}{'ri'[p]}" for i, j in ENTRIES for p in (0, 1)) + f" FROM {source})"


def inverted(name: str, source: str, prefix: str, a) -> str:
    """CTEs that add the inverse of ``a``, whose entries are columns."""
    det = f"{name}d AS (SELECT *, " + ", ".join(f"{x} AS {prefix}d{p}" for x, p in zip((
        f"{a[0][0][0]} * {a[1][1][0]} - {a[0][0][1]} * {a[1][1][1]} - {a[0][1][0]} * {a[1][0][0]} + {a[0][1][1]} * {a[1][0][1]}",
        f"{a[0][0][0]} * {a[1][1][1]} + {a[0][0][1]} * {a[1][1][0]} - {a[0][1][0]} * {a[1][0][1]} - {a[0][1][1]} * {a[1][0][0]}"), "ri")) + f" FROM {source})"
    over = lambda x, sign: (f"{sign}({x[0]} * {prefix}dr + {x[1]} * {prefix}di) / ({prefix}dr * {prefix}dr + {prefix}di * {prefix}di)", f"{sign}({x[1]} * {prefix}dr - {x[0]} * {prefix}di) / ({prefix}dr * {prefix}dr + {prefix}di * {prefix}di)")
    values = [[over(a[1][1], ""), over(a[0][1], "-")], [over(a[1][0], "-"), over(a[0][0], "")]]
    return det + ", " + step(name, f"{name}d", prefix, values)


def polar(name: str, source: str, prefix: str, a) -> str:
    """CTEs that add the polar factor of ``a`` (columns): with S = A*A and d = |det A|, A times the inverse of (S + d) / sqrt(tr S + 2 d)."""
    det = (f"{a[0][0][0]} * {a[1][1][0]} - {a[0][0][1]} * {a[1][1][1]} - {a[0][1][0]} * {a[1][0][0]} + {a[0][1][1]} * {a[1][0][1]}",
           f"{a[0][0][0]} * {a[1][1][1]} + {a[0][0][1]} * {a[1][1][0]} - {a[0][1][0]} * {a[1][0][1]} - {a[0][1][1]} * {a[1][0][0]}")
    size = " + ".join(f"{x} * {x}" for row in a for entry in row for x in entry)
    first = f"{name}1 AS (SELECT *, sqrt(pow({det[0]}, 2) + pow({det[1]}, 2)) AS {prefix}d, {size} AS {prefix}t FROM {source})"
    square = times(adjoint(a), a)
    root = [[tuple(f"(({square[i][j][k]}){f' + {prefix}d' if i == j and k == 0 else ''}) / sqrt({prefix}t + 2 * {prefix}d)" for k in (0, 1)) for j in (0, 1)] for i in (0, 1)]
    return ", ".join([first, step(f"{name}2", f"{name}1", f"{prefix}s", root), inverted(f"{name}3", f"{name}2", f"{prefix}q", matrix(f"{prefix}s")), step(name, f"{name}3", prefix, times(a, matrix(f"{prefix}q")))])


def rounded_matrix(prefix: str, source: str) -> str:
    return " SELECT vec_id, " + ", ".join(f"round({prefix}{i}{j}{p}, 6) + 0.0 AS m{i}{j}{p}" for i, j in ENTRIES for p in "ri") + f" FROM {source}"


#: The first eight numbers of each vector as a matrix, by rows.
GRADIENTS = "g AS (SELECT vec_id, " + ", ".join(f"embedding[{4 * i + 2 * j + k + 1}]::DOUBLE AS g{i}{j}{'ri'[k]}" for i, j in ENTRIES for k in (0, 1)) + " FROM embeddings)"
