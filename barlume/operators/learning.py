"""Leak-free features, labels and folds, and models on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.functions import windows as W
from barlume.functions.scalar import no_nan
from barlume.functions.totals import running_totals
from barlume.operators.attribution import explain
from barlume.operators.indicators import Spec, combine, lookup
from barlume.sources.shared import stored

# The usual feature set.
DEFAULT_FEATURES: list[Spec] = [
    ("ret", {"periods": 1}), ("ret", {"periods": 5}), ("ret", {"periods": 20}), ("rsi", {"window": 14}),
    ("zscore", {"window": 20}), ("atr", {"window": 14}), ("sma", {"window": 50}), ("std", {"window": 20}),
]


def feature_names(specs: Sequence[Spec] = DEFAULT_FEATURES) -> list[str]:
    return [c for name, settings in specs for c in lookup(name).columns(**settings)]


def make_features(bars: DataFrame, specs: Sequence[Spec] = DEFAULT_FEATURES, normalize: bool = True) -> DataFrame:
    """The bars with features; those on the price's level are put relative to the close."""
    df = combine(bars, specs)
    if not normalize:
        return df
    scaled = {}
    for c in feature_names(specs):
        if c.startswith(("sma_", "ewma_", "atr_", "std_")):
            ratio = F.try_divide(F.col(c), F.col("close"))
            scaled[c] = ratio - 1 if c.startswith(("sma_", "ewma_")) else ratio
    return df.withColumns(scaled) if scaled else df


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in which none of the columns is null, NaN or infinite."""
    return df.withColumns({c: no_nan(F.col(c).cast("double")) for c in columns}).dropna(subset=list(columns))


def binary_label(horizon: int = 5, keys: Sequence[str] = W.KEYS):
    """1 where the forward return is positive, else 0; null at the end."""
    ahead = W.forward_change("close", horizon, keys)
    return F.when(ahead.isNotNull(), (ahead > 0).cast("double"))


def triple_barrier(bars: DataFrame, horizon: int = 10, upper: float = 2.0, lower: float = 2.0, vol_window: int = 20, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """Adds label (1, -1, 0), label_ret and touch_idx of the first barrier touched within the horizon.

    Barriers lie upper and lower deviations of the trailing returns from the
    close; on one bar the upper goes first. Null without a deviation or a
    whole horizon ahead.
    """
    ahead = W.ordered(keys).rowsBetween(1, horizon)
    df = bars.withColumn("__r", W.change("close", 1, keys))
    df = df.withColumns({"__vol": W.full(F.stddev_samp, "__r", vol_window, keys), "__path": F.collect_list("close").over(ahead)})
    first = lambda touched: F.nullif(F.array_position(F.transform("__path", touched), F.lit(True)), F.lit(0).cast("long"))
    top, floor = F.col("close") * (1 + upper * F.col("__vol")), F.col("close") * (1 - lower * F.col("__vol"))
    df = df.withColumns({"__up": first(lambda c: c >= top), "__down": first(lambda c: c <= floor)})
    known = F.col("__vol").isNotNull() & (F.size("__path") == horizon)
    touch = F.coalesce(F.least("__up", "__down"), F.lit(horizon).cast("long"))
    sign = F.when(F.col("__up").isNotNull() & (F.col("__down").isNull() | (F.col("__up") <= F.col("__down"))), 1.0).when(F.col("__down").isNotNull(), -1.0).otherwise(0.0)
    return df.withColumns({
        "label": F.when(known, sign), "label_ret": F.when(known, F.try_divide(F.element_at("__path", touch.cast("int")), F.col("close")) - 1), "touch_idx": F.when(known, touch),
    }).drop("__r", "__vol", "__path", "__up", "__down")


def fold_bounds(n: int, n_splits: int) -> list[tuple[int, int]]:
    """Contiguous folds [start, stop) of n rows; the first ones take what is left over."""
    if not 2 <= n_splits <= n:
        raise ValueError(f"cannot make {n_splits} folds of {n} rows")
    size, more = divmod(n, n_splits)
    edges = [0]
    for k in range(n_splits):
        edges.append(edges[-1] + size + (k < more))
    return list(zip(edges[:-1], edges[1:], strict=True))


def _with_roles(df: DataFrame, n: Column, n_splits: int, label_horizon: int, embargo: float) -> DataFrame:
    """Rows with their number in a column row, times folds with a role."""
    df = df.withColumn("__n", n).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    size, more = F.floor(F.col("__n") / n_splits), F.col("__n") % n_splits
    start = F.col("fold") * size + F.least(F.col("fold").cast("long"), more)
    stop = start + size + F.when(F.col("fold") < more, 1).otherwise(0)
    row, gap = F.col("row"), F.floor(F.col("__n") * F.lit(float(embargo)))
    role = (
        F.when((row >= start) & (row < stop), "test").when((row < start) & (row >= start - label_horizon), "purged")
        .when((row >= stop) & (row < stop + gap), "embargoed").otherwise("train")
    )
    return df.withColumn("role", role).drop("__n")


def purged_folds(rows: DataFrame, n_splits: int = 5, label_horizon: int = 10, embargo: float = 0.01, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """Rows times folds with a column role: test, train, or purged (before a test fold) or embargoed (after it).

    Everything is arithmetic on the row number within the key, so no fold is
    held anywhere.
    """
    df = rows.withColumn("row", F.row_number().over(W.ordered(keys)).cast("long") - 1)
    return _with_roles(df, F.count("*").over(Window.partitionBy(*keys)), n_splits, label_horizon, embargo)


def numbered_dates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(the distinct timestamps with their number from 0 in a column row, how many there are), numbered range by range."""
    dates = stored(rows.select("timestamp").distinct(), "dates")
    return running_totals(dates.withColumn("__one", F.lit(1)), "timestamp", {"row": "__one"}).select("timestamp", (F.col("row").cast("long") - 1).alias("row")), dates.count()


def panel_folds(rows: DataFrame, n_splits: int = 5, label_horizon: int = 10, embargo: float = 0.01) -> DataFrame:
    """The same roles by date over a whole panel: no symbol's training rows lie inside another's test dates.

    Dates are numbered once, one row a date; labels reach ``label_horizon`` dates ahead.
    """
    dates, n = numbered_dates(rows)
    return rows.join(_with_roles(dates, F.lit(n), n_splits, label_horizon, embargo).withColumnRenamed("row", "date_row"), "timestamp")


def panel_split(rows: DataFrame, test_size: float = 0.25) -> DataFrame:
    """Adds is_test: the last dates of the panel, for all symbols alike."""
    dates, n = numbered_dates(rows)
    return rows.join(dates.select("timestamp", (F.col("row") >= F.floor(F.lit(n) * F.lit(1 - test_size))).alias("is_test")), "timestamp")


def base_rate(labels: DataFrame, label: str = "label", keys: Sequence[str] = W.KEYS) -> DataFrame:
    """How many labels each key has, and the share of ones: what a model has to beat."""
    return labels.groupBy(*keys).agg(F.count(label).alias("n"), F.avg((F.col(label) == 1).cast("double")).alias("base_rate"))


def scores(scored: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """One row: n, accuracy at 0.5 and the area under the curve; that is null where only one class occurs.

    The area counts, for each distinct probability, the pairs of a one and a zero, ties by half; zeros
    below a probability are a running total by ranges, however many probabilities there are.
    """
    steps = scored.groupBy(F.col(proba).alias("p")).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"), F.count_if((F.col(proba) > 0.5) == (F.col(label) == 1)).alias("right"))
    steps = running_totals(stored(steps, "scores"), "p", {"below": "zeros"})
    pairs = steps.withColumn("won", F.col("ones") * (F.col("below") - F.col("zeros") / 2))
    return pairs.agg(
        F.sum(F.col("ones") + F.col("zeros")).alias("n"), (F.sum("right") / F.sum(F.col("ones") + F.col("zeros"))).alias("accuracy"),
        F.try_divide(F.sum("won"), (F.sum("ones") * F.sum("zeros")).cast("double")).alias("auc"),
    )


def time_split(rows: DataFrame, test_size: float = 0.25, keys: Sequence[str] = W.KEYS) -> DataFrame:
    """Adds is_test: the last rows of each key, cut at int(n (1 - test_size))."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("is_test", F.row_number().over(W.ordered(keys)) > F.floor(n * F.lit(1 - test_size)))


def _pipeline(features: Sequence[str], model) -> Pipeline:
    assembled = VectorAssembler(inputCols=list(features), outputCol="raw")
    return Pipeline(stages=[assembled, StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), model])


def purged_auc(data: DataFrame, features: Sequence[str], label: str = "label", n_splits: int = 5, label_horizon: int = 10, embargo: float = 0.01) -> DataFrame:
    """(fold, auc, n_train, n_test): scaled logistic regression on purged folds of dates; a fold with one class is left out."""
    spark = data.sparkSession
    rows = panel_folds(complete(data, [*features, label]), n_splits, label_horizon, embargo).cache()
    judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
    out = []
    for k in range(n_splits):
        train, test = rows.filter((F.col("fold") == k) & (F.col("role") == "train")), rows.filter((F.col("fold") == k) & (F.col("role") == "test"))
        if any(part.select(label).distinct().count() < 2 for part in (train, test)):
            continue
        model = _pipeline(features, LogisticRegression(featuresCol="features", labelCol=label, maxIter=50)).fit(train)
        out.append((k, float(judge.evaluate(model.transform(test))), train.count(), test.count()))
    rows.unpersist()
    return spark.createDataFrame(out, "fold int, auc double, n_train long, n_test long")


def _fit_boosted(data: DataFrame, features: Sequence[str], label: str, test_size: float, rounds: int, seed: int):
    """(model, assembler, all complete rows with is_test): splits go by date over the whole panel, the last fifth of the training dates stops the rounds."""
    rows = panel_split(complete(data, [*features, label]), test_size)
    train = panel_split(rows.filter("NOT is_test").drop("is_test"), 0.2).withColumnRenamed("is_test", "holdout")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    boosting = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=3, seed=seed, validationIndicatorCol="holdout")
    return boosting.fit(assembler.transform(train)), assembler, rows


def boosted(data: DataFrame, features: Sequence[str], label: str = "label", test_size: float = 0.25, rounds: int = 20, threshold: float = 0.5, seed: int = 7):
    """(scored test rows with proba and signal, importances): boosted trees, stopped early on the last fifth of the training dates.

    ``scores`` tells accuracy and area under the curve of the test rows.
    """
    model, assembler, rows = _fit_boosted(data, features, label, test_size, rounds, seed)
    scored = model.transform(assembler.transform(rows.filter("is_test"))).withColumn("proba", vector_to_array("probability")[1])
    ranks = data.sparkSession.createDataFrame(sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: -x[1]), "feature string, importance double")
    return scored.withColumn("signal", proba_signal(threshold)).drop("features", "rawPrediction", "probability", "prediction"), ranks


def explained(data: DataFrame, features: Sequence[str], label: str = "label", test_size: float = 0.25, rounds: int = 20, seed: int = 7, keep: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """What each feature adds to the margin of each test row (``attribution``), beside the model's own margin in model_margin."""
    model, assembler, rows = _fit_boosted(data, features, label, test_size, rounds, seed)
    scored = model.transform(assembler.transform(rows.filter("is_test"))).withColumn("model_margin", vector_to_array("rawPrediction")[1])
    return explain(model, scored, features, [*keep, "model_margin"])


def proba_signal(threshold: float = 0.55, column: str = "proba"):
    return (F.col(column) > threshold).cast("double")
