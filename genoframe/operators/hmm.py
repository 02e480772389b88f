"""Hidden Markov segmentation of profiles: copy-number states along each chromosome of each cell.

A (cell, chromosome) is one row with its values in an array, so its length is bounded by the genome's bins. A round of
Baum-Welch is a map over these rows, many of them at once as matrices, and a small aggregate by cell: what comes out of
a row are sums for its states. Models are a row a cell; each round writes them, which cuts the lineage. The last step
is Viterbi's best path.

Values that are null or NaN are steps that say nothing of the state. Of equally good paths the one of lower states
counts. States that no value supports keep their mean and spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoframe.session import Scratch


@dataclass(frozen=True)
class Start:
    """The model that every cell starts with: a state for each level, its spread, and the chance to stay in a state."""

    levels: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5)
    spread: float = 0.15
    stay: float = 0.99
    least_spread: float = 1e-3

    def row(self) -> list[list[float]]:
        k = len(self.levels)
        moves = np.full((k, k), (1 - self.stay) / max(1, k - 1))
        np.fill_diagonal(moves, self.stay if k > 1 else 1.0)
        return [list(map(float, self.levels)), [self.spread] * k, [1 / k] * k, moves.ravel().tolist()]


MODEL = ["mu", "sd", "first", "moves"]
MODEL_DDL = "mu array<double>, sd array<double>, first array<double>, moves array<double>"
SUMS = ["loglik", "g0", "n", "sx", "sxx", "xi"]


def sequences(values: DataFrame, value: str = "value") -> DataFrame:
    """cell, chrom, bins, xs: a row for each cell and chromosome, in the order of bins. ``values`` has cell, chrom, bin_id."""
    packed = F.array_sort(F.collect_list(F.struct("bin_id", F.col(value).cast("double").alias("x"))))
    return values.groupBy("cell", "chrom").agg(packed.alias("s")).select("cell", "chrom", F.col("s.bin_id").alias("bins"), F.col("s.x").alias("xs"))


def log_emissions(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """[rows, steps, states]; 0 where nothing was observed."""
    e = -0.5 * ((x[:, :, None] - mu[:, None, :]) / sd[:, None, :]) ** 2 - np.log(sd[:, None, :]) - 0.5 * np.log(2 * np.pi)
    return np.where(np.isnan(x)[:, :, None], 0.0, e)


def expected(x: np.ndarray, mu: np.ndarray, sd: np.ndarray, first: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """SUMS of rows of equal length, by the scaled forward-backward recursion."""
    rows, steps = x.shape
    k = mu.shape[1]
    e = log_emissions(x, mu, sd)
    top = e.max(2, keepdims=True)
    e = np.exp(e - top)
    forward, scale = np.empty((rows, steps, k)), np.empty((rows, steps))
    now = first * e[:, 0]
    for t in range(steps):
        if t:
            now = np.einsum("ri,rij->rj", forward[:, t - 1], moves) * e[:, t]
        scale[:, t] = now.sum(1)
        forward[:, t] = now / scale[:, t, None]
    back, xi = np.ones((rows, k)), np.zeros((rows, k, k))
    gamma = np.empty_like(forward)
    gamma[:, -1] = forward[:, -1]
    for t in range(steps - 2, -1, -1):
        ahead = e[:, t + 1] * back / scale[:, t + 1, None]
        xi += forward[:, t, :, None] * moves * ahead[:, None, :]
        back = np.einsum("rij,rj->ri", moves, ahead)
        gamma[:, t] = forward[:, t] * back
    seen = np.where(np.isnan(x)[:, :, None], 0.0, gamma)
    filled = np.nan_to_num(x)[:, :, None]
    return [np.log(scale).sum(1) + top.sum((1, 2)), gamma[:, 0], seen.sum(1), (seen * filled).sum(1), (seen * filled**2).sum(1), xi]


def best_paths(x: np.ndarray, mu: np.ndarray, sd: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi's states of rows of equal length."""
    rows, steps = x.shape
    e = log_emissions(x, mu, sd)
    with np.errstate(divide="ignore"):
        score, step = np.log(first) + e[:, 0], np.log(moves)
    came = np.zeros((rows, steps, mu.shape[1]), "i4")
    for t in range(1, steps):
        each = score[:, :, None] + step
        came[:, t] = each.argmax(1)
        score = each.max(1) + e[:, t]
    path = np.empty((rows, steps), "i4")
    path[:, -1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = came[np.arange(rows), t, path[:, t]]
    return path


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and matrices (xs, mu, sd, first, moves) of the rows with the same number of steps."""
    columns = batch.to_pydict()
    lengths: dict[int, list[int]] = {}
    for n, xs in enumerate(columns["xs"]):
        lengths.setdefault(len(xs), []).append(n)
    for rows in lengths.values():
        matrices = [np.array([columns[c][n] for n in rows], float) for c in ("xs", *MODEL)]
        k = matrices[1].shape[1]
        yield rows, [*matrices[:4], matrices[4].reshape(-1, k, k)]


def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list = [None] * b.num_rows
        for rows, model in by_length(b):
            for n, *sums in zip(rows, *expected(*model), strict=True):
                out[n] = [float(sums[0]), *[s.ravel().tolist() for s in sums[1:]]]
        made = [pa.array(c, pa.float64() if s == "loglik" else pa.list_(pa.float64())) for s, c in zip(SUMS, zip(*out, strict=True), strict=True)] if out else []
        if made:
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("chrom"), *[b.column(c) for c in MODEL], *made], names=["cell", "chrom", *MODEL, *SUMS])


def m_step(least_spread: float):
    """The next model of a cell, from the sums of its chromosomes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chrom")
        loglik, g0, n, sx, sxx, xi = (np.array(t[s].to_pylist(), float).sum(0) for s in SUMS)
        mu, sd, _, old = (np.array(t[c][0].as_py()) for c in MODEL)
        k, some = len(mu), n > 1e-9
        mean = np.where(some, sx / np.where(some, n, 1), mu)
        spread = np.sqrt(np.maximum(np.where(some, sxx / np.where(some, n, 1) - mean**2, sd**2), least_spread**2))
        xi, old = xi.reshape(k, k), old.reshape(k, k)
        total = xi.sum(1, keepdims=True)
        moves = np.where(total > 1e-12, xi / np.where(total > 1e-12, total, 1), old)
        model = [mean, spread, g0 / g0.sum(), moves.ravel()]
        return pa.table({"cell": t["cell"].slice(0, 1), **{c: pa.array([m.tolist()]) for c, m in zip(MODEL, model, strict=True)}, "loglik": pa.array([float(loglik)])})

    return run


def fit(rows: DataFrame, start: Start, scratch: Scratch, rounds: int = 6) -> DataFrame:
    """cell, the model after ``rounds`` of Baum-Welch, and loglik of the model before the last round."""
    mu, sd, first, moves = start.row()
    models = rows.select("cell").distinct().select("cell", *[F.array(*map(F.lit, x)).alias(c) for c, x in zip(MODEL, (mu, sd, first, moves), strict=True)], F.lit(None).cast("double").alias("loglik"))
    key = f"`cell` {rows.schema['cell'].dataType.simpleString()}"
    sums = "loglik double, " + ", ".join(f"{s} array<double>" for s in SUMS[1:])
    for _ in range(rounds):
        known = rows.select("cell", "chrom", "xs").join(models.drop("loglik"), "cell")
        models = scratch.save(known.mapInArrow(e_step, f"{key}, chrom string, {MODEL_DDL}, {sums}").groupBy("cell").applyInArrow(m_step(start.least_spread), f"{key}, {MODEL_DDL}, loglik double"))
    return models


def decode(rows: DataFrame, models: DataFrame) -> DataFrame:
    """cell, chrom, bin_id, state: the best path of every sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            for numbers, model in by_length(b):
                for n, path in zip(numbers, best_paths(*model), strict=True):
                    out[n] = path.tolist()
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("chrom"), b.column("bins"), pa.array(out, pa.list_(pa.int32()))], names=["cell", "chrom", "bins", "states"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("cell", "chrom", "bins"))
    paths = rows.join(models.drop("loglik"), "cell").select("cell", "chrom", "bins", "xs", *MODEL).mapInArrow(run, f"{kinds}, states array<int>")
    return paths.select("cell", "chrom", F.explode(F.arrays_zip("bins", "states")).alias("s")).select("cell", "chrom", F.col("s.bins").alias("bin_id"), F.col("s.states").alias("state"))


def segments(states: DataFrame) -> DataFrame:
    """cell, chrom, seg_id, first_bin, last_bin, n_bins, state: runs of one state along a chromosome."""
    along = Window.partitionBy("cell", "chrom").orderBy("bin_id")
    new = F.coalesce(F.lag("state").over(along) != F.col("state"), F.lit(False)).cast("int")
    runs = states.withColumn("new", new).withColumn("seg_id", F.sum("new").over(along).cast("int"))
    return runs.groupBy("cell", "chrom", "seg_id").agg(F.min("bin_id").alias("first_bin"), F.max("bin_id").alias("last_bin"), F.count("*").alias("n_bins"), F.first("state").alias("state"))
