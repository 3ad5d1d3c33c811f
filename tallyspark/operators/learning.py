"""Learned models on pyspark.ml: trees per target, stacking, sample weights and feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from .windows import numbered

#: How far each refinement goes, in their order, and the coefficients of variation where nothing is known.
REFINEMENTS = (("joint", 0.30), ("lstm", 0.15), ("transformer", 0.15), ("temporal", 0.20), ("graph", 0.10))
VARIATION = {"pts": 0.45, "reb": 0.40, "ast": 0.50, "stl": 0.80, "blk": 0.90, "tov": 0.60}


def cleaned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaN become 0, infinities 1e10."""
    big = lambda c: F.when(c == float("inf"), 1e10).when(c == float("-inf"), -1e10).otherwise(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c))
    return df.withColumns({c: big(F.col(c).cast("double")) for c in columns})


def temporal_split(df: DataFrame, day: str, cut: Column, share: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the day on; where none is left on a side, the last share of the rows is the test."""
    train, test = df.where(F.col(day) < cut), df.where(F.col(day) >= cut)
    if not train.isEmpty() and not test.isEmpty():
        return train, test
    rows = numbered(df, [day, *[c for c in df.columns if c != day]], "__no")
    n = df.count()
    edge = n - max(1, int(n * share))
    return rows.where(F.col("__no") < edge).drop("__no"), rows.where(F.col("__no") >= edge).drop("__no")


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="__x").transform(cleaned(df, columns))


class TargetModel:
    """Boosted trees for one target with a deviation from its residuals' quantiles; constant targets need no trees."""

    def __init__(self, target: str, columns: Sequence[str], trees: int = 20, depth: int = 4, seed: int = 42) -> None:
        self.target, self.columns, self.trees, self.depth, self.seed = target, list(columns), trees, depth, seed
        self.model = self.constant = None
        self.spread = 0.0

    def fit(self, df: DataFrame) -> "TargetModel":
        from pyspark.ml.regression import GBTRegressor

        df = df.where(F.col(self.target).isNotNull())
        low, high = df.agg(F.min(self.target), F.max(self.target)).first()
        if low == high:
            self.constant = low
            return self
        rows = _vectors(df, self.columns)
        self.model = GBTRegressor(featuresCol="__x", labelCol=self.target, predictionCol="__p", maxIter=self.trees, maxDepth=self.depth, seed=self.seed).fit(rows)
        q = self.model.transform(rows).select(F.percentile(F.col(self.target) - F.col("__p"), [0.1, 0.9]).alias("q")).first().q
        self.spread = (q[1] - q[0]) / 2.56
        return self

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        name = name or f"{self.target}_pred"
        if self.model is None:
            return df.withColumns({name: F.lit(self.constant).cast("double"), f"{name}_std": F.lit(0.0)})
        return self.model.transform(_vectors(df, self.columns)).drop("__x").withColumnRenamed("__p", name).withColumn(f"{name}_std", F.lit(self.spread))


def stacked(df: DataFrame, order: Sequence[str], target: str, columns: Sequence[str], folds: int = 4) -> DataFrame:
    """Out-of-fold predictions of three learners, forward in time, blended by an elastic net; as `stacked`."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    rows = numbered(df, order, "__no")
    n = df.count()
    rows = _vectors(rows, columns).withColumn("__fold", F.floor(F.col("__no") * (folds + 1) / n)).cache()
    learners = {"gbt": GBTRegressor(maxIter=8, maxDepth=3, seed=1), "forest": RandomForestRegressor(numTrees=10, maxDepth=4, seed=1), "linear": LinearRegression(regParam=0.1)}
    out = None
    for k in range(1, folds + 1):
        past, now = rows.where(F.col("__fold") < k), rows.where(F.col("__fold") == k)
        for name, learner in learners.items():
            now = learner.copy().setFeaturesCol("__x").setLabelCol(target).setPredictionCol(f"__{name}").fit(past).transform(now)
        out = now if out is None else out.union(now)
    from pyspark.ml.feature import VectorAssembler

    meta = VectorAssembler(inputCols=[f"__{n}" for n in learners], outputCol="__meta").transform(out)
    net = LinearRegression(featuresCol="__meta", labelCol=target, predictionCol="stacked", elasticNetParam=0.5, regParam=0.01).fit(meta)
    return net.transform(meta).drop("__x", "__no", "__fold", "__meta", *[f"__{n}" for n in learners])


def adversarial_weights(train: DataFrame, test: DataFrame, columns: Sequence[str], least_auc: float = 0.7) -> tuple[DataFrame, float]:
    """train with weight, and the AUC of telling train from test. Weights are odds within .1 and 10 with mean 1, or all 1 if the AUC is low."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    both = _vectors(train.select(*columns).withColumn("__y", F.lit(0.0)).union(test.select(*columns).withColumn("__y", F.lit(1.0))), columns)
    model = LogisticRegression(featuresCol="__x", labelCol="__y", standardization=True, regParam=0.01).fit(both)
    auc = BinaryClassificationEvaluator(labelCol="__y").evaluate(model.transform(both))
    if auc <= least_auc:
        return train.withColumn("weight", F.lit(1.0)), auc
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(_vectors(train, columns)).withColumn("__w", F.least(F.greatest(p / (1 - p), F.lit(0.1)), F.lit(10.0)))
    scored = scored.crossJoin(F.broadcast(scored.agg(F.avg("__w").alias("__m")))).withColumn("weight", F.col("__w") / F.col("__m"))
    return scored.select(*train.columns, "weight"), auc


def select_features(df: DataFrame, columns: Sequence[str], target: str, most: int = 100) -> list[str]:
    """Columns that vary, the most important ones of a forest first."""
    from pyspark.ml.regression import RandomForestRegressor

    clean = cleaned(df, columns)
    spread = clean.agg(*[F.variance(c).alias(c) for c in columns]).first().asDict()
    kept = [c for c in columns if spread[c]]
    if not kept:
        return []
    forest = RandomForestRegressor(featuresCol="__x", labelCol=target, numTrees=20, maxDepth=5, seed=42).fit(_vectors(clean, kept))
    ranked = sorted(zip(forest.featureImportances.toArray(), kept), key=lambda x: (-x[0], x[1]))
    return [c for _, c in ranked[:most]]


def refined(base: Column, others: dict[str, Column]) -> Column:
    """The base blended with each refinement in turn, where their ratio is within .1 and 10."""
    for name, share in REFINEMENTS:
        if name in others:
            x = others[name]
            ratio = x / base
            base = F.when(x.isNotNull() & (ratio > 0.1) & (ratio < 10), base * (1 - share) + x * share).otherwise(base)
    return base


def spread_from_history(last10: Column, rolled: Column, mean: Column, stat: str) -> Column:
    return F.coalesce(F.when(last10 > 0, last10), F.when(rolled > 0, rolled), mean * VARIATION[stat])


def safe_columns(df: DataFrame, allow: Sequence[str] = (), prefixes: Sequence[str] = ("roll_", "vs_opp_", "team_", "opp_", "season_"), suffixes: Sequence[str] = ("_te", "_bayesian", "_z"), deny: Sequence[str] = ()) -> list[str]:
    """Numeric columns that only look back, by name."""
    numeric = {"double", "float", "int", "bigint"}
    return [c for c, t in df.dtypes if t in numeric and c not in deny and (c in allow or c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes)))]


def with_fallback(df: DataFrame, prediction: str, fallback: Column) -> DataFrame:
    return df.withColumn(prediction, F.when(finite(F.col(prediction), -1.0) > 0, F.col(prediction)).otherwise(fallback))
