"""Walk-forward gradient boosting with MLlib."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..functions.storage import materialize
from .backtest import walk_forward_folds
from .screen import rank_ic

#: Series that one call takes.
SERIES = 1_000
#: What a model is made of unless told otherwise. They are what the study's models are made of, so that results are comparable.
DEFAULTS = {"maxIter": 300, "maxDepth": 3, "stepSize": 0.03, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 0}


def make_model(kind: str = "regressor", **params):
    """Boosted trees over columns x and y, as a regressor or a classifier (of y in 0 and 1)."""
    makers = {"regressor": GBTRegressor, "classifier": GBTClassifier}
    if kind not in makers:
        raise ValueError(f"the kind is one of {sorted(makers)}")
    return makers[kind](featuresCol="x", labelCol="y", **(DEFAULTS | params))


def param_grid(options: dict[str, list]) -> list[dict]:
    """All combinations of the options' values, the last name varying fastest."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def _predicted(model, kind: str, rows: DataFrame) -> DataFrame:
    """rows with pred: the value, or the probability of class 1."""
    out = model.transform(rows)
    return out.withColumn("pred", vector_to_array("probability")[1] if kind == "classifier" else F.col("prediction"))


def score(predictions: DataFrame, order: str, key: str = "fold") -> DataFrame:
    """key, ic, n: rank correlation of predictions with what followed; null where either is constant."""
    return rank_ic(predictions, key, order, ("pred",), ("y",)).select(key, F.when(~F.isnan("ic"), F.col("ic")).alias("ic"), "n")


def choose_params(rows: DataFrame, order: str, train_end: int, grid: list[dict], kind: str = "regressor", validation_fraction: float = 0.2, embargo: int = 5) -> dict:
    """Of the grid the first with the best rank correlation on the tail of the rows before train_end; the first of all where none has one."""
    tail = int(train_end * validation_fraction)
    before, after = rows.filter(F.col("row") < train_end - tail - embargo), rows.filter((F.col("row") >= train_end - tail) & (F.col("row") < train_end))
    tried = None
    for k, params in enumerate(grid):
        one = _predicted(make_model(kind, **params).fit(before), kind, after).select(F.lit(k).alias("k"), order, "y", "pred")
        tried = one if tried is None else tried.unionByName(one)
    best = score(tried, order, "k").filter("ic is not null").orderBy(F.desc("ic"), "k").first()
    return grid[best["k"]] if best else grid[0]


def run_walk_forward(df: DataFrame, series: str, order: str, features: tuple[str, ...], target: str, n_splits: int = 6, embargo: int = 5, kind: str = "regressor", grid: list[dict] | None = None, validation_fraction: float = 0.2, min_test_start: int = 0, min_train: int = 250, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions (series, fold, order, y, pred), the table of folds, and a row of summary for each series.

    A fold is fit on its series' rows before it, less the embargo, and is a tenth of the rows long; with a grid its parameters are
    chosen on the tail of its training rows. The folds' table holds dates, sizes, ic, parameters and importances. Rows with a missing
    feature or target are left out first, and a series without a fold of enough rows is left out; none at all is an error.
    The fits run as the frames are made, one after another, each one distributed; so at most SERIES series are taken.
    """
    full = df.select(series, order, *features, F.col(target).cast("double").alias("y")).na.drop()
    rows = materialize(numbered(full, [series], order, "row"), "walk-forward")
    sizes = sorted(rows.groupBy(series).count().limit(SERIES + 1).collect())
    if len(sizes) > SERIES:
        raise ValueError(f"more than {SERIES} series at once; run them in parts")
    parts = []
    for name, n in sizes:
        folds = walk_forward_folds(n, n_splits, n // 10, embargo, min_test_start, min_train)
        if folds:
            mine = rows.filter(F.col(series) == name).drop(series)
            parts.append([x.select(F.lit(name).alias(series), "*") for x in _walk_one(mine, order, features, folds, kind, grid, validation_fraction, params)])
    if not parts:
        raise ValueError("no fold has enough rows to train on")
    return tuple(reduce(DataFrame.unionByName, same) for same in zip(*parts, strict=True))


def _walk_one(numbered_rows: DataFrame, order: str, features: tuple[str, ...], folds: list[tuple[int, int, int, int]], kind: str, grid: list[dict] | None, validation_fraction: float, params: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """run_walk_forward's three frames for one series, whose rows are numbered."""
    spark = numbered_rows.sparkSession
    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(numbered_rows)
    embargo, out, table = folds[0][2] - folds[0][1], None, []
    for fold, train_end, start, end in folds:
        chosen = choose_params(rows, order, train_end, grid, kind, validation_fraction, embargo) if grid else params
        model = make_model(kind, **chosen).fit(rows.filter(F.col("row") < train_end))
        got = _predicted(model, kind, rows.filter((F.col("row") >= start) & (F.col("row") < end))).select(F.lit(fold).alias("fold"), order, "y", "pred")
        out = got if out is None else out.unionByName(got)
        table.append((fold, train_end, start, end, {k: str(v) for k, v in chosen.items()}, {f: float(v) for f, v in zip(features, model.featureImportances.toArray(), strict=True)}))
    folds = spark.createDataFrame(table, "fold int, n_train long, test_start_row int, test_end_row int, params map<string, string>, importances map<string, double>")
    at = lambda a, b: F.col("row") == (F.col(a) - b)
    edges = F.broadcast(folds).join(rows.select("row", order), at("n_train", 1) | at("test_start_row", 0) | at("test_end_row", 1))
    pick = lambda a, b, c: F.max(F.when(at(a, b), F.col(order))).alias(c)
    dates = edges.groupBy("fold").agg(pick("n_train", 1, "train_end"), pick("test_start_row", 0, "test_start"), pick("test_end_row", 1, "test_end"))
    folds = folds.join(dates, "fold").join(score(out, order).select("fold", F.col("ic").alias("oos_ic"), F.col("n").alias("n_test")), "fold", "left").drop("test_start_row", "test_end_row")
    summary = folds.agg(F.avg("oos_ic").alias("mean_oos_ic"), F.count_if(F.col("oos_ic") > 0).alias("folds_positive"), F.count("*").alias("n_folds"), F.stddev_samp("oos_ic").alias("ic_std"))
    return out, folds, summary
