"""Files: bases and histories as JSON documents, compressed images as JSON or parquet tables; pictures are in ``png`` and ``arrays``."""

from __future__ import annotations

import json
import math
import os
import uuid
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.basis import TYPES, Basis
from .tables import shared_folder

VERSIONS = {"qft": "1.0", "eqft": "1.1", "tebd": "2.0", "mera": "1.0"}
COMPRESSED_VERSION = "1.0"
COMPRESSED = "version string, num_coefficients int, compression_ratio double, indices array<int>, values_real array<double>, values_imag array<double>, original_height int, original_width int, basis_hash string"
FAMILIES = {v: k for k, v in TYPES.items()}


def basis_to_dict(basis: Basis) -> dict:
    tensors = [[[float(z.real), float(z.imag)] for z in t.flatten(order="F")] for t in basis.tensors]
    out = {"type": TYPES[basis.family], "version": VERSIONS[basis.family], "m": basis.m, "n": basis.n, "tensors": tensors, "hash": basis.basis_hash()}
    if basis.family == "eqft":
        out |= {"n_entangle": len(basis.phases), "entangle_phases": basis.phases, "entangle_position": basis.position}
    elif basis.family != "qft":
        rows = sum(1 for g in basis.gates if g.role == "phase" and max(g.qubits) <= basis.m)
        out |= {"n_row_gates": rows, "n_col_gates": len(basis.phases) - rows, "phases": basis.phases}
    return out


def dict_to_basis(d: dict) -> Basis:
    family = FAMILIES.get(d.get("type", "QFTBasis"))
    if family is None:
        raise ValueError(f"unknown basis type {d.get('type')!r}")
    if family != "eqft" and d.get("version") != VERSIONS[family]:
        warnings.warn(f"version {d.get('version')} is not {VERSIONS[family]}", stacklevel=2)
    phases = d.get("entangle_phases") if family == "eqft" else d.get("phases")
    shape = Basis.make(family, d["m"], d["n"], phases, d.get("entangle_position") or "back")
    basis = shape.with_tensors([np.array([complex(a, b) for a, b in t]).reshape(2, 2, order="F") for t in d["tensors"]])
    if d.get("hash") and d["hash"] != basis.basis_hash():
        warnings.warn("the stored hash differs from the gates'", stacklevel=2)
    return basis


def save_basis(basis: Basis, path: str) -> str:
    with open(path, "w") as f:
        json.dump(basis_to_dict(basis), f, indent=2)
    return path


def load_basis(path: str) -> Basis:
    with open(path) as f:
        return dict_to_basis(json.load(f))


def save_history(trained, path: str, name: str) -> str:
    finite = lambda v: v if math.isfinite(v) else None
    doc = {"basis_name": name, "epoch_losses": [{"epoch": e, "train_loss": finite(t), "val_loss": finite(v)} for e, t, v in trained.epochs],
           "step_losses": [{"epoch": e, "step": s, "loss": finite(x)} for s, e, _, x in trained.steps]}
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    return path


def load_history(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


HISTORY = "basis_name string, epoch_losses array<struct<epoch: int, train_loss: double, val_loss: double>>, step_losses array<struct<epoch: int, step: int, loss: double>>"


def read_histories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Epochs and steps of all history files at a path: (basis_name, epoch, train_loss, val_loss) and (basis_name, epoch, step, loss)."""
    docs = spark.read.schema(HISTORY).option("multiLine", True).json(path)
    return docs.select("basis_name", F.inline("epoch_losses")), docs.select("basis_name", F.inline("step_losses"))


def append_results(df: DataFrame, path: str) -> None:
    """Add benchmark rows to those at a path."""
    df.write.mode("append").json(path)


def with_metadata(df: DataFrame) -> DataFrame:
    """Compressed images with the format's version, the number of coefficients and the ratio of those left out."""
    kept = F.size("indices")
    return df.withColumn("version", F.lit(COMPRESSED_VERSION)).withColumn("num_coefficients", kept).withColumn("compression_ratio", 1 - kept / (F.col("original_height") * F.col("original_width")))


def write_compressed(df: DataFrame, path: str, kind: str = "json") -> str:
    with_metadata(df).write.format(kind).save(path)
    return path


def read_compressed(spark: SparkSession, path: str, keys: str = "vec_id long, label int", kind: str = "json") -> DataFrame:
    """Compressed images; warns if some are of another version of the format."""
    df = spark.read.schema(f"{keys}, {COMPRESSED}").format(kind).load(path)
    other = df.filter(~F.col("version").eqNullSafe(COMPRESSED_VERSION)).select("version").head()
    if other is not None:
        warnings.warn(f"version {other[0]} is not {COMPRESSED_VERSION}", stacklevel=2)
    return df


def roundtrip(df: DataFrame) -> DataFrame:
    """Write to the shared folder as JSON and read back with the declared schema."""
    return read_compressed(df.sparkSession, write_compressed(df, f"{shared_folder(df.sparkSession)}/compressed-{uuid.uuid4().hex}"))


def save_checkpoint(trained, folder: str, step: int, name: str) -> tuple[str, str]:
    """History and basis so far, under names by step; small files of the driver."""
    os.makedirs(folder, exist_ok=True)
    history, basis = (os.path.join(folder, n) for n in checkpoint_names(step))
    return save_history(trained, history, name), save_basis(trained.basis, basis)


def checkpoint_names(step: int) -> tuple[str, str]:
    return f"step{step:04d}_loss.json", f"step{step:04d}_basis.json"
