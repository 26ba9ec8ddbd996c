"""Feature selection: constant, redundant and weak features go.

Associations of all pairs of features come from a fixed number of passes over the rows: tasks sum arrays whose size is set by the
number of features, and only their sums reach the driver. What several passes read is written once (``once``), so
the features are worked out a single time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from daybook.operators.relational import safe_corr
from daybook.operators.strata import pin

#: Bins of a correlation ratio, at most.
BINS = 20
#: So many tasks sum arrays, at most; each holds one array.
SUMMING_TASKS, CHUNK = 4096, 1 << 15
#: Correlations are told apart to so many digits when features are ranked by them.
DIGITS = 12


def once(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` of ``df`` as a checkpoint for several passes; a frame that comes from here is taken as it is."""
    if "read_again" in df.__dict__:
        return df
    out = pin(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(cols)]))
    out.read_again = True
    return out


def candidates(df: DataFrame, suffix: str = "_real") -> list[str]:
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if c.endswith(suffix) and t in numeric]


def drop_constant(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Features with more than one value, null counted as one; a single pass."""
    row = df.agg(*[f(c).alias(f"{n}{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))], F.count("*").alias("rows")).first()
    return [c for c in cols if row[f"lo{c}"] != row[f"hi{c}"] or 0 < row[f"n{c}"] < row["rows"]]


def drop_zero_only(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Features but those that are 0, false or a text of zero in every row; nulls are no zeros. A single pass."""
    kind = {f.name: f.dataType for f in df.schema}
    number = lambda c: F.col(f"`{c}`").cast("double") == 0 if isinstance(kind[c], (NumericType, BooleanType)) else F.lit(False)
    zero = lambda c: F.trim(f"`{c}`").isin("0", "0.0") if isinstance(kind[c], StringType) else number(c)
    row = df.agg(*[F.count_if(zero(c)).alias(c) for c in cols], F.count("*").alias("rows")).first()
    return [c for c in cols if not 0 < row[c] == row["rows"]]


def rank_by_corr(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """(feature, corr): absolute correlations with the target, strongest first."""
    one = df.agg(*[F.abs(safe_corr(c, y)).alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def array_sums(df: DataFrame, cols: Sequence[str], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of(x)`` over all rows, x some rows of ``cols`` as doubles (null: NaN); None if there are no rows.

    A task adds up what its batches give and sends one array in chunks; these are summed in two steps, so that no
    task reads more than a root of what all tasks send of a chunk.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            for k in range(math.ceil(len(total) / CHUNK)):
                salt = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([total[k * CHUNK : (k + 1) * CHUNK].tobytes()], pa.binary())], names=["chunk", "salt", "sums"])

    def add(f):
        total = sum((np.frombuffer(data) for data in f["sums"]), np.zeros(1))
        return pd.DataFrame({"chunk": f["chunk"].iloc[:1], "salt": f["salt"].iloc[:1], "sums": [total.tobytes()]})

    schema = "chunk int, salt int, sums binary"
    narrow = df.select(*[F.col(f"`{c}`").cast("double") for c in cols])
    parts = narrow.coalesce(SUMMING_TASKS).mapInArrow(run, schema)
    for keys in (["chunk", "salt"], ["chunk"]):
        parts = parts.groupBy(*keys).applyInPandas(add, schema)
    rows = sorted(parts.collect(), key=lambda r: r["chunk"])
    return np.concatenate([np.frombuffer(r["sums"]) for r in rows]) if rows else None


def _shift(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """A value near each column's mean, of a few rows; sums about it lose no digits, and every result is free of it."""
    few = df.select(*[F.col(f"`{c}`").cast("double") for c in cols]).limit(1000)
    row = few.agg(*[F.avg(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`"))).alias(f"{i}") for i, c in enumerate(cols)]).first()
    return np.array([row[f"{i}"] or 0.0 for i in range(len(cols))])


def correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Absolute Pearson correlations of all pairs, each over the rows where both are there; 0 where one is constant there."""
    df = once(df, cols)
    p, shift = len(cols), _shift(df, cols)

    def of(x):
        there = ~np.isnan(x)
        m, x = there.astype(np.float64), np.where(there, x - shift, 0.0)
        return np.concatenate([(m.T @ m).ravel(), (x.T @ m).ravel(), ((x * x).T @ m).ravel(), (x.T @ x).ravel()])

    sums = array_sums(df, cols, of)
    if sums is None:
        return np.zeros((p, p))
    n, s, ss, c = sums.reshape(4, p, p)
    with np.errstate(invalid="ignore", divide="ignore"):
        left, right = ss - s * s / n, (ss - s * s / n).T
        flat = (left <= 1e-12 * ss) | (right <= 1e-12 * ss.T)
        r = np.abs(c - s * s.T / n) / np.sqrt(left * right)
    return np.where(flat | ~np.isfinite(r), 0.0, np.minimum(r, 1.0))


def _greedy(order: list[str], tie: Callable[[str, str], float], limit: float) -> list[str]:
    kept: list[str] = []
    for c in order:
        if all(tie(c, k) <= limit for k in kept):
            kept.append(c)
    return kept


def _by_target(cols: Sequence[str], to_target: Sequence[float]) -> list[str]:
    return [c for _, c in sorted((-round(float(r), DIGITS), c) for c, r in zip(cols, to_target, strict=True))]


def drop_correlated(df: DataFrame, cols: Sequence[str], y: str, limit: float = 0.95) -> list[str]:
    """Strongest first; a feature goes if its correlation with a kept one is above the limit. One pass over the rows."""
    r = correlations(df, [*cols, y])
    at = {c: i for i, c in enumerate(cols)}
    return _greedy(_by_target(cols, r[:-1, -1]), lambda a, b: r[at[a], at[b]], limit)


def bin_edges(df: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Inner edges of min(20, distinct values) quantile bins of each feature, all in one aggregation."""
    shares = sorted({i / k for k in range(2, BINS + 1) for i in range(1, k)})
    aggs = [f for i, c in enumerate(cols) for f in (F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 10_000).alias(f"e{i}"), F.approx_count_distinct(f"`{c}`", 0.01).alias(f"n{i}"))]
    row = df.agg(*aggs).first()
    out = []
    for i in range(len(cols)):
        k = max(2, min(BINS, row[f"n{i}"] or 0))
        at = dict(zip(shares, row[f"e{i}"] or [], strict=False))
        out.append(np.unique([at[j / k] for j in range(1, k) if j / k in at]))
    return out


def correlation_ratios(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """eta[a, b]: the share of b's deviation that bins of a explain, as a root, over the rows where both are there.

    Two jobs on one written table whatever the number of features: edges of all bins (of all rows that have the feature), then counts, sums and squares of every feature
    in every bin of every other one. A batch is sorted by each feature's bins and summed by runs.
    """
    df = once(df, cols)
    p, edges, shift = len(cols), bin_edges(df, cols), _shift(df, cols)

    def of(x):
        there = ~np.isnan(x)
        values = np.where(there, x - shift, 0.0)
        wide = np.concatenate([there.astype(np.float64), values, values * values], axis=1)
        out = np.zeros((p, BINS, 3 * p))
        for a in range(p):
            rows = np.flatnonzero(there[:, a])
            if len(rows):
                bins = np.searchsorted(edges[a], x[rows, a], "left")  # bins are closed on the right
                order = np.argsort(bins, kind="stable")
                found, first = np.unique(bins[order], return_index=True)
                out[a, found] = np.add.reduceat(wide[rows[order]], first, axis=0)
        return out.ravel()

    sums = array_sums(df, cols, of)
    if sums is None:
        return np.zeros((p, p))
    n, s, ss = np.moveaxis(sums.reshape(p, BINS, 3, p), 2, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        all_n, all_s = n.sum(1), s.sum(1)
        total = ss.sum(1) - all_s**2 / all_n
        between = np.where(n > 0, s * s / n, 0.0).sum(1) - all_s**2 / all_n
        eta = np.sqrt(np.clip(between / total, 0, 1))
    usable = (total > 1e-12 * np.maximum(ss.sum(1), 1e-300)) & ((n > 0).sum(1) > 1)
    return np.where(usable & np.isfinite(eta), eta, 0.0)


def drop_nonlinear(df: DataFrame, cols: Sequence[str], y: str, limit: float = 0.95) -> list[str]:
    """Strongest first; a feature goes if the larger of its correlation ratios with a kept one, either way round, is above the limit."""
    df = once(df, [*cols, y])
    eta = correlation_ratios(df, cols)
    tie = np.maximum(eta, eta.T)
    at = {c: i for i, c in enumerate(cols)}
    order = _by_target(cols, correlations(df, [*cols, y])[:-1, -1])
    return _greedy(order, lambda a, b: tie[at[a], at[b]], limit)


def coordinate_descent(gram: np.ndarray, to_target: np.ndarray, strength: float, mix: float, rounds: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """w that minimises w'Gw / 2 - w'r + strength (mix |w|_1 + (1 - mix) |w|^2 / 2), one coordinate after another."""
    w, l1, l2 = np.zeros(len(to_target)), strength * mix, strength * (1 - mix)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] > 0:
                rho = to_target[j] - gram[j] @ w + gram[j, j] * w[j]
                new = math.copysign(max(abs(rho) - l1, 0.0), rho) / (gram[j, j] + l2)
                most, w[j] = max(most, abs(new - w[j])), new
        if most <= tol:
            break
    return w


def elastic_net_weights(df: DataFrame, cols: Sequence[str], y: str, strength: float = 0.01, mix: float = 0.5) -> np.ndarray:
    """Weights of standardised, zero-imputed features: one pass for the Gram matrix, then coordinate descent on it."""
    df = once(df, [*cols, y])
    p, shift = len(cols) + 1, _shift(df.fillna(0.0, [*cols, y]), [*cols, y])

    def of(x):
        x = np.nan_to_num(x, nan=0.0) - shift
        return np.concatenate([[float(len(x))], x.sum(0), (x.T @ x).ravel()])

    sums = array_sums(df, [*cols, y], of)
    if sums is None:
        return np.zeros(len(cols))
    n, s, c = sums[0], sums[1 : p + 1], sums[p + 1 :].reshape(p, p)
    cov = c / n - np.outer(s, s) / n**2
    dev = np.sqrt(np.where(np.diag(cov) > 1e-12 * np.diag(c) / n, np.diag(cov), 0.0))[:-1]
    safe = np.where(dev > 0, dev, 1.0)
    gram = cov[:-1, :-1] / np.outer(safe, safe) * np.outer(dev > 0, dev > 0)
    return coordinate_descent(gram, cov[:-1, -1] / safe * (dev > 0), strength, mix)


def elastic_net(df: DataFrame, cols: Sequence[str], y: str, strength: float = 0.01, mix: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """(feature, importance, normalized_importance, selected) by the weights' sizes; at least one is selected."""
    weights = np.abs(elastic_net_weights(df, cols, y, strength, mix)).tolist()
    total = sum(weights)
    best = min(range(len(cols)), key=lambda i: (-weights[i], cols[i]), default=None)
    rows = [(c, w, w / total if total > 0 else 0.0, bool(w > eps or i == best)) for i, (c, w) in enumerate(zip(cols, weights, strict=True))]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, normalized_importance double, selected boolean")


def top_features(ranked: DataFrame, k: int) -> list[str]:
    return [r["feature"] for r in ranked.orderBy(F.desc("importance"), "feature").limit(k).collect()]


def select_features(df: DataFrame, cols: Sequence[str], y: str, k: int = 50, limit: float = 0.95, strength: float = 0.01, mix: float = 0.5) -> DataFrame:
    """(feature, stage, rank, importance): each candidate with the stage at which it went (constant, linear, nonlinear, weak, top) or ``kept``,
    and for those that the last stage saw their importance; the k most important are kept."""
    df, left, gone = once(df, [*cols, y]), list(cols), {}
    stages = {"constant": drop_constant, "linear": lambda df, cols: drop_correlated(df, cols, y, limit), "nonlinear": lambda df, cols: drop_nonlinear(df, cols, y, limit)}
    for stage, keep in stages.items():
        kept = keep(df, left) if left else []
        gone |= dict.fromkeys(set(left) - set(kept), stage)
        left = [c for c in left if c in kept]
    rows = [(c, s, None, None) for c, s in sorted(gone.items())]
    ranked = elastic_net(df, left, y, strength, mix).collect() if left else []
    ranked.sort(key=lambda r: (not r["selected"], -r["importance"], r["feature"]))
    rows += [(r["feature"], "weak" if not r["selected"] else "kept" if i < k else "top", i + 1, r["importance"]) for i, r in enumerate(ranked)]
    return df.sparkSession.createDataFrame(rows, "feature string, stage string, rank int, importance double")
