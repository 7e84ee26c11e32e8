"""Quality rules with risk-controlled cutoffs.

Every rule measures how junk-like a text is. Labelled rows are dealt into two parts by a hash
of their id. In each stratum (language) the first part orders the tightening steps: starting
with all rules off, the rule whose next grid cell has the most bad documents for its good
ones lowers its cutoff. Along this fixed path the second part, the holdout, tests step by step the
hypothesis "more than ``alpha`` of the good documents are rejected by all rules together": it is
refuted if the exact binomial lower tail is at most ``delta / strata``. The first step that isn't
refuted ends the tests (fixed-sequence testing needs no correction for the steps; strata are
corrected by Bonferroni). So with confidence ``1 - delta`` at most ``alpha`` of the good documents
of every stratum are falsely rejected, whichever proven step is taken. Taken is the one
whose share of bad documents, less ``price`` times its share of good ones, is largest in the holdout, the
earliest on ties; without a proven or useful step all rules stay off in that stratum.

Defined results: null and blank texts have no words and fail the base rule; a null
stratum is a stratum of its own; unlabelled or null labels are not used; without labels
only the base rule decides; an empty table gives an empty result; repeated rows each get
a row; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "bang_ratio")
#: Cutoffs tried for each ratio: 1/64, 2/64, ... 63/64.
GRID = 64


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str | None) -> tuple:
    """The base counts and the five ratios of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    chars = len(text or "") - sum(data.count(c) for c in SPACES)
    symbols = sum(data.count(c) for c in SYMBOLS)
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    dup_lines = len(full) - len(set(full))
    repeats = repeated_words(words)
    upper = len(data) - len(data.translate(None, UPPER))
    letters = len(data) - len(data.translate(None, LETTERS))
    ratio = lambda a, b: a / b if b else 0.0
    return (n_words, chars, symbols, dup_lines, repeats, ratio(symbols, chars), ratio(repeats, n_words), ratio(dup_lines, len(full)), ratio(upper, letters), min(1.0, ratio(data.count(b"!"), n_words)))


def text_measures(docs: DataFrame, id_col="doc_id", text_col="text", stratum_col="lang") -> DataFrame:
    """doc_id, stratum, base counts and rule ratios, computed where the texts are read."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("(none)")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RULES)

    def run(batches):
        for b in batches:
            rows = list(zip(*[measure(t.as_py()) for t in b.column(2)])) or [()] * (len(COUNTS) + len(RULES))
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RULES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, k) for x, k in zip(rows, kinds)]], ["doc_id", "stratum", *COUNTS, *RULES])

    return src.mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def tightening_path(cells: dict[str, dict[int, tuple[int, int]]], grid: int) -> list[tuple[str, int]]:
    """(rule, grid cell) steps: each lowers that rule's cutoff to the cell. ``cells`` has (bad, good) documents by rule and cell.

    A rule's next cell is its highest one below its cutoff that has documents; cell 0 is never rejected.
    """
    left = {r: sorted((c for c in cells.get(r, ()) if c), reverse=True) for r in RULES}
    path = []
    while any(left.values()):
        # the most bad documents for each good one; RULES decides between equal ones
        rule = min((r for r in RULES if left[r]), key=lambda r: (-(cells[r][left[r][0]][0] + 0.5) / (cells[r][left[r][0]][1] + 0.5), RULES.index(r)))
        path.append((rule, left[rule].pop(0)))
    return path


def proven_step(good: list[int], bad: list[int], alpha: float, level: float, price: float) -> int:
    """How many steps of a path are taken. ``good[i]`` and ``bad[i]``: holdout documents that step i + 1 rejects first; the last entries, those that none does."""
    n_good, n_bad = sum(good), sum(bad)
    best, steps = 0.0, 0
    over_good = over_bad = 0
    for i in range(len(good) - 1):
        over_good += good[i]
        over_bad += bad[i]
        if not n_good or binomial_tail(over_good, n_good, alpha) > level:
            break
        worth = over_bad / max(n_bad, 1) - price * over_good / n_good
        if worth > best + 1e-12:
            best, steps = worth, i + 1
    return steps


def calibrate(measures: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", alpha: float = 0.02, delta: float = 0.05, grid: int = GRID, price: float = 5.0) -> DataFrame:
    """stratum, and for each rule its proven cutoff or null. Only counts by stratum, rule, cell or step are grouped."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter("good in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    cell = lambda r: F.least(F.floor(F.col(r) * grid), F.lit(grid - 1)).cast("int")
    places = F.array(*[F.struct(F.lit(r).alias("rule"), cell(r).alias("cell")) for r in RULES])
    held = F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)) == 1
    # a document counts once, however often its id is repeated
    one = measures.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("stratum", "good", places.alias("places"))).alias("one"))
    labelled = materialize(one.select("doc_id", "one.*", held.alias("held")))
    strata = max(1, labelled.agg(F.count_distinct("stratum")).first()[0])
    counted = labelled.filter("not held").select("stratum", "good", F.explode("places").alias("x")).groupBy("stratum", "x.rule", "x.cell", "good").count()

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        cells: dict = {}
        for rule, at, good, n in zip(pdf["rule"], pdf["cell"], pdf["good"], pdf["count"]):
            bad_good = cells.setdefault(rule, {}).setdefault(at, [0, 0])
            bad_good[good] += int(n)
        path = tightening_path(cells, grid)
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[0], "rule": [r for r, _ in path], "cutoff_cell": [c for _, c in path], "step": range(1, len(path) + 1)})

    # at most rules * grid rows a stratum
    paths = materialize(counted.groupBy("stratum").applyInPandas(order, "stratum string, rule string, cutoff_cell int, step int"))
    # the first step that rejects a document: the first one that takes one of its rules down to its cell or below;
    # documents of the same cells are counted first, so the join sees each combination once
    same = labelled.filter("held").groupBy("stratum", "good", "places").agg(F.count(F.lit(1)).alias("n"))
    numbered = same.select("stratum", "good", "places", "n", F.explode("places").alias("x")).select("stratum", "good", "places", "n", "x.*")
    reached = numbered.join(paths.withColumnRenamed("stratum", "of").withColumnRenamed("rule", "by"), (F.col("stratum") == F.col("of")) & (F.col("rule") == F.col("by")) & (F.col("cutoff_cell") <= F.col("cell")), "left")
    first = reached.groupBy("stratum", "good", "places", "n").agg(F.min("step").alias("step"))
    tested = first.groupBy("stratum", "good", "step").agg(F.sum("n").alias("count"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        last = int(pdf["step"].max()) if pdf["step"].notna().any() else 0
        split = {g: [0] * (last + 1) for g in (0, 1)}
        for good, step, n in zip(pdf["good"], pdf["step"], pdf["count"]):
            split[good][last if pd.isna(step) else int(step) - 1] += int(n)
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "steps": [proven_step(split[1], split[0], alpha, delta / strata, price)]})

    taken = tested.groupBy("stratum").applyInPandas(choose, "stratum string, steps int")
    chosen = paths.join(taken, "stratum").filter("step <= steps").groupBy("stratum", "rule").agg((F.min("cutoff_cell") / F.lit(float(grid))).alias("cutoff"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", stratum_col="lang", label_col="quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    measures = materialize(text_measures(docs, id_col, text_col, stratum_col))
    cutoffs = calibrate(measures, labels, id_col, label_col, alpha, delta)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = None
    for r in RULES:
        hit = F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
        rejected = hit if rejected is None else rejected | hit
    return measures.join(cutoffs, "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", *RULES)
