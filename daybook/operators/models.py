"""Boosted forecasters: one fitted with a validation set, and refits for every date of a walk from one table of statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.operators.strata import null_safe

# ---------------------------------------------------------------- one model, with a validation set


@dataclass(frozen=True)
class Forecaster:
    prepare: object
    model: object
    numeric: Sequence[str]
    categorical: Sequence[str]
    baseline: str | None

    @property
    def rounds(self) -> int:
        return self.model.getNumTrees

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Absolute predictions: the baseline, where the model learned what is left of it, and never below 0."""
        kept = df.select(F.struct(*df.columns).alias("__row"), *self.numeric, *self.categorical)
        got = self.model.transform(self.prepare.transform(typed(kept, self.numeric, self.categorical)))
        level = F.col("__learned") + (F.col(f"__row.{self.baseline}") if self.baseline else F.lit(0.0))
        return got.select("__row.*", F.greatest(level, F.lit(0.0)).alias(out))


def typed(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.col(c).cast("string") for c in categorical})


def fit_forecaster(train: DataFrame, valid: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, baseline: str | None = None, weight: str | None = None, rounds: int = 60, depth: int = 5, rate: float = 0.1, tolerance: float = 1e-3) -> Forecaster:
    """A gradient-boosted regression in one pipeline.

    It learns ``target`` less ``baseline`` (all of it if none is named) on the rows of ``train`` by their weights, and stops adding trees
    when the error on ``valid`` no longer falls. Categories are indexed and gaps in numbers filled with medians, both as the training rows have
    them; categories that those lack are one more. Rows without a target or baseline, and of no weight, are not learned.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    learn = F.col(target).cast("double") - (F.col(baseline).cast("double") if baseline else F.lit(0.0))
    ready = lambda df, held: df.select(*numeric, *categorical, learn.alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), F.lit(held).alias("__held")).where("__y IS NOT NULL AND NOT isnan(__y) AND __w > 0")
    known = ready(train, False)
    prepared = [
        *([StringIndexer(inputCols=list(categorical), outputCols=[f"__c_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")] if categorical else []),
        *([Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"__n_{c}" for c in numeric])] if numeric else []),
        VectorAssembler(inputCols=[*(f"__n_{c}" for c in numeric), *(f"__c_{c}" for c in categorical)], outputCol="__x"),
    ]
    prepare = Pipeline(stages=prepared).fit(typed(known, numeric, categorical))
    widest = max([len(x) + 1 for x in prepare.stages[0].labelsArray], default=0) if categorical else 0
    gbt = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", validationIndicatorCol="__held", validationTol=tolerance, predictionCol="__learned", maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=max(32, widest), seed=7)
    both = prepare.transform(typed(known.unionByName(ready(valid, True)), numeric, categorical)).select("__x", "__y", "__w", "__held")
    return Forecaster(prepare, gbt.fit(both), list(numeric), list(categorical), baseline)


# ---------------------------------------------------------------- a model for every date


def boost(bins: np.ndarray, n: np.ndarray, s: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> np.ndarray:
    """Predictions for cells (rows of bin numbers) by squared-error boosting on their counts ``n`` and sums ``s``.

    That is boosting of the rows themselves, as trees on binned features see no more of them. A tree is grown level by level: each node takes the
    split with the largest gain that leaves ``least`` rows on both sides; of equal ones the first feature and bin. Empty cells follow the splits.
    """
    total = n.sum()
    if not total:
        return np.full(len(bins), np.nan)
    width = int(bins.max()) + 1 if bins.size else 1
    out = np.full(len(bins), s.sum() / total)
    for _ in range(rounds):
        rest, node = s - n * out, np.zeros(len(bins), dtype=np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            size = (1 << level) * width
            best = np.full(1 << level, 1e-9 * max(1.0, np.abs(rest).sum()))
            chosen, at = np.full(1 << level, -1), np.zeros(1 << level, dtype=np.int64)
            for f in range(bins.shape[1]):
                key = (node - first) * width + bins[:, f]
                live = node >= first
                count = np.bincount(key[live], n[live], size).reshape(-1, width).cumsum(1)
                sums = np.bincount(key[live], rest[live], size).reshape(-1, width).cumsum(1)
                right, right_sums = count[:, -1:] - count, sums[:, -1:] - sums
                with np.errstate(invalid="ignore", divide="ignore"):
                    gain = sums**2 / count + right_sums**2 / right - sums[:, -1:] ** 2 / count[:, -1:]
                gain = np.where((count >= least) & (right >= least), gain, -np.inf)
                top = gain.argmax(1)
                value = gain[np.arange(len(gain)), top]
                better = value > best * (1 + 1e-9)
                best[better], chosen[better], at[better] = value[better], f, top[better]
            split = (node >= first) & (chosen[np.maximum(node - first, 0)] >= 0)
            if not split.any():
                break
            mine = node[split] - first
            node[split] = 2 * node[split] + 1 + (bins[split, chosen[mine]] > at[mine])
        leaves, place = np.unique(node, return_inverse=True)
        count, sums = np.bincount(place, n, len(leaves)), np.bincount(place, rest, len(leaves))
        out = out + rate * np.where(count > 0, sums / np.maximum(count, 1e-300), 0.0)[place]
    return out


def bins_of(cols: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """The features' bin numbers as an array; a gap is a bin of its own, the last."""
    one = lambda c, e: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), len(e) + 1).otherwise(sum((F.when(F.col(c) > x, 1).otherwise(0) for x in e), F.lit(0)))
    return F.array(*[one(c, e).cast("int") for c, e in zip(cols, edges, strict=True)])


def feature_edges(df: DataFrame, cols: Sequence[str], bins: int) -> list[list[float]]:
    """Inner edges of quantile bins of every feature, in one aggregation."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    return [sorted(set(row[f"e{i}"] or [])) for i in range(len(cols))]


def walk_forward(rows: DataFrame, dates: Sequence, cols: Sequence[str], target: str, day: str = "dt", every: int = 1, bins: int = 16, rounds: int = 20, depth: int = 3, rate: float = 0.3, out: str = "prediction") -> DataFrame:
    """The rows of the dates with predictions by a boosted model of all rows before; refitted every ``every`` dates.

    Features are binned by quantiles of the rows before the first date. Counts and sums of the target by (interval of refits, cell of bins)
    hold all that any of the models learns; running sums over the intervals are each refit's training table, of as many rows as there
    are cells. Refits are tasks side by side, and predictions one join on (refit, cell). So the rows are read three times, for edges, statistics
    and predictions, whatever the number of dates. Rows without a target are not learned; a refit that has no rows before it predicts null.
    """
    refits = sorted(dates)[::every]
    schema = rows.schema
    if not refits:
        return rows.limit(0).withColumn(out, F.lit(None).cast("double"))
    edges = feature_edges(rows.where(F.col(day) < F.lit(refits[0])), cols, bins)
    ends = F.array(*[F.lit(d).cast(schema[day].dataType) for d in refits])
    binned = rows.withColumns({"__cell": bins_of(cols, edges), "__before": F.size(F.filter(ends, lambda d: d <= F.col(day)))})
    # a row is known to refit k if refit k is later than its day, that is if k >= __before
    y = F.col(target).cast("double")
    told = y.isNotNull() & ~F.isnan(y)
    steps = binned.groupBy("__cell", "__before").agg(F.count_if(told).alias("n"), F.coalesce(F.sum(F.when(told, y)), F.lit(0.0)).alias("s"))
    grid = steps.select("__cell").distinct().withColumn("__refit", F.explode(F.sequence(F.lit(0), F.lit(len(refits) - 1))))
    tables = null_safe(grid, steps.select("__cell", F.col("__before").alias("__refit"), "n", "s"), ["__cell", "__refit"], "left")
    running = Window.partitionBy("__cell").orderBy("__refit").rowsBetween(Window.unboundedPreceding, 0)
    tables = tables.select("__cell", "__refit", F.coalesce(F.sum("n").over(running), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("s").over(running), F.lit(0.0)).alias("s"))

    def fit(f):
        cells = np.stack(f["__cell"].to_numpy()).reshape(len(f), len(cols))
        order = np.lexsort(cells.T[::-1])
        got = np.empty(len(f))
        got[order] = boost(cells[order], f["n"].to_numpy()[order], f["s"].to_numpy()[order], rounds, depth, rate)
        return pd.DataFrame({"__cell": f["__cell"], "__refit": f["__refit"], out: got})

    models = tables.groupBy("__refit").applyInPandas(fit, f"__cell array<int>, __refit int, `{out}` double")
    models = models.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    asked = binned.where(F.col(day).isin(*dates)).withColumn("__refit", F.col("__before") - 1).drop("__before")
    return asked.join(models, ["__refit", "__cell"], "left").select(*rows.columns, out)
