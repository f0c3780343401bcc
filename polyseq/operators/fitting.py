"""Representations and fits: sums over all rows come from Spark, small dense problems are solved on the driver.

What reaches the driver is a matrix of the features' moments (at most 243 by 243), or the few labelled variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, STICKERS
from polyseq.operators.hamiltonian import Couplings, effective_energy
from polyseq.operators.segments import CLASSES, class_pairs
from polyseq.operators.sequences import residue_counts, with_counts

ALPHAS = ("clustering", "connectivity", "percolation", "arrangement", "homology")
PHIS = tuple(f"phi_{a}" for a in ALPHAS)


def composition_theta(df: DataFrame) -> DataFrame:
    """name, theta: the 20 counts, zeros included."""
    return with_counts(df).select("name", F.col("c").cast("array<double>").alias("theta"))


def pair_theta(df: DataFrame) -> DataFrame:
    """name, theta: the 210 numbers of unordered pairs of places; pairs of like residues count in both orders."""
    c = [F.get("c", k).cast("double") for k in range(len(ALPHABET))]
    return with_counts(df).select("name", F.array(*[c[i] * (c[i] - 1) if i == j else c[i] * c[j] for i in range(20) for j in range(i, 20)]).alias("theta"))


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of the entries of an array column; a task sends one matrix, by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(x):
                x = np.column_stack([np.ones(batch.num_rows), x.reshape(batch.num_rows, -1)])
                found = x.T @ x + (0 if found is None else found)
        if found is not None:
            yield pa.record_batch({"i": pa.array(np.arange(len(found))), "p": pa.array(found.tolist(), pa.list_(pa.float64()))})

    parts = df.select(column).mapInArrow(run, "i long, p array<double>").select("i", F.posexplode("p").alias("j", "p"))
    rows = parts.groupBy("i", "j").agg(F.sum("p").alias("p")).collect()  # at most 244 by 244
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    p = np.zeros((1 + max(r.i for r in rows),) * 2)
    for r in rows:
        p[r.i, r.j] = r.p
    return int(p[0, 0]), p[0, 1:], p[1:, 1:]


@dataclass(frozen=True)
class Components:
    """mean of the residue fractions, loadings (a row for each component, the largest in absolute value positive), explained shares of the variance."""

    mean: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray


def fractions(df: DataFrame) -> DataFrame:
    """name, f: the shares of the 20 residues."""
    return with_counts(df).select("name", F.transform("c", lambda v: v / F.length("seq")).alias("f"))


def principal_components(df: DataFrame, k: int = 3) -> Components:
    """Of the residue fractions of all sequences, from one pass that sums their products.

    An eigenvector has no sign of its own: the loading that is largest in absolute value, the first of equals, is made
    positive. Without rows all is zero.
    """
    n, s, p = moments(fractions(df), "f")
    if not n:
        return Components(np.zeros(len(ALPHABET)), np.zeros((k, len(ALPHABET))), np.zeros(k))
    values, vectors = np.linalg.eigh(p / n - np.outer(s, s) / n**2)
    order = np.argsort(-values, kind="stable")[:k]
    loadings, values = vectors[:, order].T, np.maximum(values, 0)
    size = np.round(np.abs(loadings), 9)
    sign = np.sign(loadings[np.arange(len(loadings)), size.argmax(axis=1)])
    return Components(s / n, loadings * sign[:, None], values[order] / values.sum() if values.sum() else np.zeros(k))


def composition_components(df: DataFrame, k: int = 3) -> DataFrame:
    """component, explained: the share of the variance of the residue fractions that each principal component explains."""
    found = principal_components(df, k)
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(found.explained)], "component int, explained double")


def composition_projections(df: DataFrame, k: int = 3) -> DataFrame:
    """name, projection: of each sequence's residue fractions, less their mean, on the first k :func:`principal_components`; an expression over the row."""
    found = principal_components(df, k)
    on = lambda row: sum(((F.get("f", a) - float(m)) * float(v) for a, (m, v) in enumerate(zip(found.mean, row, strict=True))), F.lit(0.0))
    return fractions(df).select("name", F.array(*[on(row) for row in found.loadings]).alias("projection"))


def sufficiency(n: int, s: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """R2 and RMSE of the last entry fitted by the others without an intercept, least squares of least norm, from the :func:`moments` of all; zeros without rows."""
    if not n:
        return 0.0, 0.0
    gram, right = p[:-1, :-1], p[:-1, -1]
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))  # entries differ by orders of magnitude
    w = np.linalg.lstsq(gram / np.outer(size, size), right / size, rcond=None)[0] / size
    residual = max(p[-1, -1] - 2 * w @ right + w @ gram @ w, 0.0)
    spread = p[-1, -1] - s[-1] ** 2 / n
    return (float(1 - residual / spread) if spread > 0 else 0.0), float(np.sqrt(residual / n))


#: Size of each representation.
REPRESENTATIONS = {"composition": 20, "sticker": 5, "interaction_class": 7, "pair_counts": 210}


def representations(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """x: for each sequence the entries of all REPRESENTATIONS and its uniform energy, each over the squared length; all follow from its counts."""
    m, kinds = np.array(matrix), class_pairs()
    i, j = np.triu_indices(len(ALPHABET))
    like = np.where(i == j, 2.0, 1.0)  # pairs of like residues count in both orders
    of = {(ALPHABET[a], ALPHABET[b]): k for k, (a, b) in enumerate(zip(i, j, strict=True))}
    classes = np.zeros((len(i), len(CLASSES)))
    for k, name in enumerate(CLASSES):
        at = [of[pair] for pair in kinds.get(name, [])]
        classes[at, k] = 1 / like[at]
    stickers = np.array([a in STICKERS for a in ALPHABET])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(ALPHABET))
            n, n_s = c.sum(axis=1), c[:, stickers].sum(axis=1)
            n_l = n - n_s
            pairs = c[:, i] * (c[:, j] - (i == j))
            x = np.column_stack([c, n_s, n_l, n_s * (n_s - 1) / 2, n_l * (n_l - 1) / 2, n_s * n_l, pairs @ classes, pairs, pairs @ (m[i, j] / like)]) / np.square(n)[:, None]
            yield pa.record_batch({"x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))})

    return df.select(residue_counts(F.col("seq")).alias("c")).mapInArrow(run, "x array<double>")


def minimal_representation(df: DataFrame, matrix: list[list[float]], least: float = 0.95) -> DataFrame:
    """theta, size, r2, rmse, sufficient, minimal: how well each representation tells the uniform energy, both over the squared length.

    sufficient: r2 over ``least``; minimal: the smallest of these. One pass over the sequences sums the products of all entries.
    """
    n, s, p = moments(representations(df, matrix), "x")
    rows, at = [], 0
    for name, size in REPRESENTATIONS.items():
        own = [*range(at, at + size), len(s) - 1]
        rows.append((name, size, *sufficiency(n, s[own] if n else s, p[np.ix_(own, own)] if n else p)))
        at += size
    best = min((size for _, size, r2, _ in rows if r2 > least), default=None)
    return df.sparkSession.createDataFrame([(*r, r[2] > least, r[1] == best) for r in rows], "theta string, size int, r2 double, rmse double, sufficient boolean, minimal boolean")


def calibration_table(metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """name, csat_relative and the energy terms with unit weights, of the variants that have a measured value."""
    unit = effective_energy(metrics, Couplings(2.0, 1.0, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0))
    return unit.join(labels.filter("csat_relative is not null").select("name", "csat_relative"), "name").select("name", "csat_relative", "h_chemistry", *PHIS)


def _predicted(alphas: dict[str, object]):
    h = F.col("h_chemistry") + sum((F.col(p) * alphas[a] for p, a in zip(PHIS[1:], ALPHAS[1:], strict=True)), F.col(PHIS[0]) * alphas[ALPHAS[0]])
    return h


def calibration_loss(table: DataFrame, c: Couplings = Couplings()) -> float:
    """The sum of squared logarithms of predicted over measured c_sat, predictions being relative to WT."""
    h = table.select("name", "csat_relative", _predicted(dict(zip(ALPHAS, astuple(c)[3:], strict=True))).alias("h"))
    wt = h.filter("name = 'WT'").select(F.col("h").alias("h0"))
    return h.join(F.broadcast(wt), F.lit(True)).agg(F.sum(F.pow(F.col("h") - F.col("h0") - F.log("csat_relative"), 2))).first()[0]


def calibrate(table: DataFrame) -> Couplings:
    """Couplings of least norm that fit the measured values: the energy is linear in them. WT must be there."""
    rows = table.collect()  # the measured variants
    wt = next((r for r in rows if r.name == "WT"), None)
    if wt is None:
        raise ValueError("WT is needed")
    a = np.array([[r[p] - wt[p] for p in PHIS] for r in rows])
    b = np.array([np.log(r.csat_relative) - (r.h_chemistry - wt.h_chemistry) for r in rows])
    return Couplings(2.0, 1.0, 0.5, *np.linalg.lstsq(a, b, rcond=None)[0].tolist())


def robustness(table: DataFrame, c: Couplings = Couplings(), points: int = 20, span: float = 5.0) -> DataFrame:
    """parameter, step, value, rho: the rank correlation of predicted and measured c_sat along a sweep of each coupling."""
    spark, base = table.sparkSession, dict(zip(ALPHAS, astuple(c)[3:], strict=True))
    grid = []
    for a, v in base.items():
        values = np.linspace(0.0, 1.0, points) if v < 1e-10 else np.linspace(v / span, v * span, points)
        grid += [(a, k, float(x), *[float(x) if b == a else base[b] for b in ALPHAS]) for k, x in enumerate(values)]
    sweep = spark.createDataFrame(grid, f"parameter string, step int, value double, {', '.join(f'g_{a} double' for a in ALPHAS)}")
    rows = table.join(F.broadcast(sweep), F.lit(True)).select("parameter", "step", "value", "csat_relative", _predicted({a: F.col(f"g_{a}") for a in ALPHAS}).alias("h"))
    ranks = lambda x: (F.rank().over(Window.partitionBy("parameter", "step").orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("parameter", "step", x)) - 1) / 2)
    rho = F.corr("a", "b")
    found = rows.withColumns({"a": ranks("h"), "b": ranks("csat_relative")}).groupBy("parameter", "step", "value").agg(rho.alias("rho"))
    return found.withColumn("rho", F.when(F.col("rho").isNull() | F.isnan("rho"), 0.0).otherwise(F.col("rho")))


FEATURES = ("n_stickers", "sticker_fraction", "omega", "mean_length", "ss", "cross", "ll", "clustering", "n_components", "threshold", "h0_total", "normalized_spacing_entropy", "composition_entropy")


def features(metrics: DataFrame) -> DataFrame:
    """name, features: thirteen numbers; an undefined omega is 1."""
    value = lambda f: F.when(F.isnan(f) | F.col(f).isNull(), 1.0).otherwise(F.col(f).cast("double")) if f == "omega" else F.col(f).cast("double")
    return metrics.select("name", F.array(*[value(f) for f in FEATURES]).alias("features"))


def compare_models(table: DataFrame, c: Couplings = Couplings()) -> DataFrame:
    """model (chemistry, full), rank_correlation, rmse_log of predicted against measured c_sat, from :func:`calibration_table`; predictions are relative to WT."""
    alphas = dict(zip(ALPHAS, astuple(c)[3:], strict=True))
    x = table.select("name", "csat_relative", F.explode(F.array(F.struct(F.lit("chemistry").alias("model"), F.col("h_chemistry").alias("h")), F.struct(F.lit("full").alias("model"), _predicted(alphas).alias("h")))).alias("x")).select("name", "csat_relative", "x.*")
    wt = x.filter("name = 'WT'").select("model", F.col("h").alias("h0"))
    x = x.join(F.broadcast(wt), "model").withColumn("p", F.col("h") - F.col("h0"))  # the logarithm of the prediction
    ranks = lambda v: F.rank().over(Window.partitionBy("model").orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy("model", v)) - 1) / 2
    x = x.withColumns({"a": ranks("p"), "b": ranks("csat_relative")})
    rho = F.corr("a", "b")
    return x.groupBy("model").agg(F.when(rho.isNull() | F.isnan(rho), 0.0).otherwise(rho).alias("rank_correlation"), F.sqrt(F.avg(F.pow(F.col("p") - F.log("csat_relative"), 2))).alias("rmse_log"))


def training_rows(metrics: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """name, features, h_chem_target, csat_target, phase_target, h_eff_target: targets are null where there are none.

    known: name, csat_relative, phase_separates, one row a name, each nullable. Without a phase there, a variant
    separates if it has more than ``least`` stickers. There is no target for h_eff.
    """
    h = effective_energy(metrics).select("name", F.col("h_chemistry").alias("h_chem_target"))
    x = features(metrics).join(h, "name").join(known.select("name", "csat_relative", "phase_separates"), "name", "left")
    phase = F.coalesce("phase_separates", F.get("features", FEATURES.index("n_stickers")) > least).cast("double")
    return x.select("name", "features", "h_chem_target", F.col("csat_relative").alias("csat_target"), phase.alias("phase_target"), F.lit(None).cast("double").alias("h_eff_target"))


#: The heads of the network, the columns of their targets, and the weights of their losses; phase is a probability, c_sat is learned as its logarithm.
HEADS = {"h_eff": ("h_eff_target", 0.0), "csat": ("csat_target", 1.0), "phase": ("phase_target", 0.5), "h_chem": ("h_chem_target", 0.5)}
#: Rows that the network is fitted on, at most: those with the least hash of their name.
NETWORK_ROWS = 2000


def train_and_predict(rows: DataFrame, sample: int = NETWORK_ROWS, epochs: int = 300, seed: int = 42) -> DataFrame:
    """name and the four outputs of a network fitted on at most ``sample`` of the :func:`training_rows`, for all of them; empty if there are none.

    The sample is bounded, so the fit is a small dense problem on the driver; predictions are made on the executors.
    """
    targets = [t for t, _ in HEADS.values()]
    first = rows.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(sample).select("features", *targets).toArrow()
    net = Network(len(HEADS), seed)
    if first.num_rows:
        y = np.array([first[t].to_numpy(zero_copy_only=False).astype(float) for t in targets]).T
        y[:, [*HEADS].index("csat")] = np.log(np.maximum(y[:, [*HEADS].index("csat")], 1e-12))
        net.fit(np.array(first["features"].to_pylist(), float), y, epochs)
    out = net.predict(rows)
    value = lambda k, h: F.exp(F.get("outputs", k)) if h == "csat" else F.get("outputs", k)
    return out.select("name", *[value(k, h).alias(h) for k, h in enumerate(HEADS)])


class Network:
    """A small network, 13-16-8 and a head for each task, trained by Adam on rows some of whose targets are NaN.

    With four tasks they are those of HEADS: phase goes through a sigmoid and is fitted by cross-entropy, the others by
    squares; each task's loss is the mean over its known targets, times its weight.
    """

    def __init__(self, tasks: int, seed: int = 42, sizes: tuple[int, ...] = (len(FEATURES), 16, 8)):
        random = np.random.default_rng(seed)
        self.w = [random.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip((*sizes[:-1], sizes[-1]), (*sizes[1:], tasks), strict=True)]
        self.b = [np.zeros(x.shape[1]) for x in self.w]
        self.mean, self.std = np.zeros(sizes[0]), np.ones(sizes[0])
        four = tasks == len(HEADS)
        self.weight = np.array([w for _, w in HEADS.values()]) if four else np.ones(tasks)
        self.logistic = np.array([h == "phase" for h in HEADS]) if four else np.zeros(tasks, bool)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [(x - self.mean) / self.std]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            y = out[-1] @ w + b
            out.append(np.maximum(y, 0) if k < len(self.w) - 1 else np.where(self.logistic, 1 / (1 + np.exp(-np.clip(y, -500, 500))), y))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 2000, rate: float = 0.005) -> list[float]:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-8
        known, target = ~np.isnan(y), np.nan_to_num(y)
        share = self.weight / np.maximum(known.sum(axis=0), 1)
        moments_, losses = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)], []
        for t in range(1, epochs + 1):
            out = self.forward(x)
            off = np.where(known, out[-1] - target, 0.0)
            p = np.clip(out[-1], 1e-12, 1 - 1e-12)
            cross = -np.where(known, target * np.log(p) + (1 - target) * np.log(1 - p), 0.0)
            losses.append(float((share * np.where(self.logistic, cross, off * off)).sum()))
            d = off * share
            gw, gb = [], []
            for k in reversed(range(len(self.w))):
                gw.insert(0, out[k].T @ d)
                gb.insert(0, d.sum(axis=0))
                d = (d @ self.w[k].T) * (out[k] > 0) if k else d
            for p, g, (m, v) in zip((*self.w, *self.b), (*gw, *gb), moments_, strict=True):
                m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return losses

    def predict(self, df: DataFrame) -> DataFrame:
        """name and the tasks' outputs for every row of :func:`features`, made on the executors."""
        net = self

        @F.arrow_udf("array<double>")
        def apply(x: pa.Array) -> pa.Array:
            return pa.array(net.forward(np.array(x.to_pylist(), float).reshape(len(x), -1))[-1].tolist(), pa.list_(pa.float64()))

        return df.select("name", apply("features").alias("outputs"))
