"""Expected rating, residuals and neighbourhood clusters."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import HexGrid
from ..functions.numeric import half_even, logit_to_rating, rating_to_logit
from ..operators.cells import hex_table, label_clusters
from ..operators.ranking import positions
from ..session import materialise
from . import boosting

NUMERIC = [
    "log_review_count", "price_numeric", "is_chain", "hex_restaurant_count",
    "hex_mean_rating", "hex_cuisine_entropy", "hex_chain_share",
]


#: Training rows of a partition at least. A fit is thousands of short jobs, whose tasks should not be more than
#: the rows need, nor more than the cores: each job pays for its tasks twice, for the sums and for their shuffle.
PARTITION_ROWS = 20_000

#: Training rows of a partition at most, some 300 MB of binned rows; beyond, each core gets several partitions.
MOST_PARTITION_ROWS = 1_000_000


def training_partitions(rows: int, cores: int) -> int:
    if rows <= cores * MOST_PARTITION_ROWS:
        return max(1, min(math.ceil(rows / PARTITION_ROWS), cores))
    return cores * math.ceil(rows / (cores * MOST_PARTITION_ROWS))


@dataclass(frozen=True)
class TreeSettings:
    iterations: int = 200
    depth: int = 8
    step: float = 0.1
    min_leaf: int = 20
    seed: int = 42


def _numeric(df: DataFrame) -> DataFrame:
    return df.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC})


def design_table(df: DataFrame, categories: list[str], venue_types: list[str]) -> DataFrame:
    """The design matrix as plain columns: numerics and one 0/1 column per level."""
    flags = {f"category_{c}": (F.col("category") == c).cast("int") for c in categories}
    flags |= {f"venue_{v}": (F.col("venue_type") == v).cast("int") for v in venue_types}
    cols = [F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in flags.items()]
    return _numeric(df).select("id", *[F.col(f"x_{c}").alias(c) for c in NUMERIC], *cols, "rating")


def design_stages() -> list:
    """The same matrix as sparse vectors; every level is kept."""
    index = StringIndexer(
        inputCols=["category", "venue_type"], outputCols=["category_ix", "venue_ix"], handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    hot = OneHotEncoder(inputCols=["category_ix", "venue_ix"], outputCols=["category_v", "venue_v"], dropLast=False)
    gather = VectorAssembler(inputCols=[f"x_{c}" for c in NUMERIC] + ["category_v", "venue_v"], outputCol="features")
    return [index, hot, gather]


def _trees(settings: TreeSettings, label: str) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="raw_prediction", maxIter=settings.iterations,
        maxDepth=settings.depth, stepSize=settings.step, minInstancesPerNode=settings.min_leaf, seed=settings.seed,
        maxBins=256,
    )


def train(df: DataFrame, settings: TreeSettings = TreeSettings(), logit: bool = False) -> PipelineModel:
    """Fit on all rows; with ``logit`` the target is mapped to an unbounded scale first."""
    return _fit(df, _trees(settings, "label"), logit)


def _fit(df: DataFrame, trees: GBTRegressor, logit: bool, at_once: int = 1) -> PipelineModel:
    """``at_once``: fits that share the cores. Two partitions for each of a fit's cores then fill the gaps of the others."""
    y = rating_to_logit(F.col("rating")) if logit else F.col("rating")
    # indexing, encoding and trees all read these columns, so they are derived once
    rows = materialise(_numeric(df).select("category", "venue_type", *[f"x_{c}" for c in NUMERIC], y.alias("label")))
    cores = df.sparkSession.sparkContext.defaultParallelism
    cores = cores if at_once == 1 else math.ceil(2 * cores / at_once)
    rows = rows.repartition(training_partitions(rows.count(), cores)).persist()
    try:
        return Pipeline(stages=[*design_stages(), trees]).fit(rows)
    finally:
        rows.unpersist()


def predict(model: PipelineModel, df: DataFrame, logit: bool = False) -> DataFrame:
    """Adds predicted_rating and residual."""
    out = model.transform(_numeric(df))
    expected = logit_to_rating(F.col("raw_prediction")) if logit else F.col("raw_prediction")
    drop = [f"x_{c}" for c in NUMERIC] + ["category_ix", "venue_ix", "category_v", "venue_v", "features", "raw_prediction"]
    return add_residual(out.withColumn("predicted_rating", expected).drop(*drop))


def add_residual(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("rating") - F.col("predicted_rating"))


def contiguous_folds(df: DataFrame, folds: int = 5, order: str = "id") -> DataFrame:
    """Fold numbers by position in the order of a column of any type, nulls first.

    The first n mod k folds are one row longer, as in unshuffled k-fold splitting. No task sorts more than
    a range of the rows.
    """
    placed = materialise(positions(df, [F.col(order).asc_nulls_first()], "_at"))
    size, longer = divmod(placed.count(), folds)
    at = F.col("_at") - 1
    border = longer * (size + 1)
    fold = F.when(at < border, F.floor(at / F.lit(size + 1))).otherwise(
        F.lit(longer) + F.floor((at - border) / F.lit(max(size, 1)))
    )
    return placed.withColumn("fold", fold.cast("int")).drop("_at")


def cross_validate(
    df: DataFrame, settings: TreeSettings = TreeSettings(), folds: int = 5, logit: bool = False
) -> DataFrame:
    """fold, r2 and their mean and spread (twice the standard deviation).

    The trees of all folds are grown together, so that a pass over the rows serves every fold.
    """
    trees = _trees(settings, "label")
    placed = contiguous_folds(df.select("id", "category", "venue_type", *NUMERIC, "rating"), folds)
    y = rating_to_logit(F.col("rating")) if logit else F.col("rating")
    inputs = [f"x_{c}" for c in NUMERIC]
    rows = _numeric(placed).select("fold", "category", "venue_type", *inputs, y.cast("double").alias("label"), F.col("rating").cast("double").alias("rating"))
    rows = materialise(rows)
    plan, totals = boosting.design(rows, inputs, ["category", "venue_type"], folds, trees.getMaxBins())
    spark = df.sparkSession
    partitions = training_partitions(sum(totals) // max(folds - 1, 1), spark.sparkContext.defaultParallelism)
    grown = boosting.grow(rows, plan, totals, partitions, trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getMinInstancesPerNode())
    raw = boosting.predict_held_out(rows, plan, grown, trees.getStepSize())
    expected = logit_to_rating(F.col("raw_prediction")) if logit else F.col("raw_prediction")
    predicted = materialise(raw.select("fold", "rating", expected.alias("predicted_rating")))
    scorer = RegressionEvaluator(labelCol="rating", predictionCol="predicted_rating", metricName="r2")
    scores = [(k, float(scorer.evaluate(predicted.filter(F.col("fold") == k)))) for k in range(folds)]
    mean = sum(s for _, s in scores) / folds
    spread = 2 * math.sqrt(sum((s - mean) ** 2 for _, s in scores) / folds)
    return spark.createDataFrame(
        [(k, s, mean, spread) for k, s in scores], "fold int, r2 double, mean_r2 double, spread double"
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- a rating expectation that plain SQL can repeat ------------------------------------

def expected_rating(df: DataFrame, min_rows: int = 3) -> DataFrame:
    """Mean rating of (category, price, cell), of (category, price) or of the category: the
    finest group with at least ``min_rows`` rows, else the mean of all.

    One aggregation at the finest grain feeds all the coarser ones.
    """
    keys = ["category", "price_numeric", "cell"]
    finest = df.groupBy(*keys).agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
    joined = df
    options = []
    for depth in (3, 2, 1):
        names = {k: f"_{k}{depth}" for k in keys[:depth]}
        level = finest.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(
            F.sum("s").alias(f"_s{depth}"), F.sum("n").alias(f"_n{depth}")
        )
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        joined = joined.join(level, same, "left").drop(*names.values())
        enough = F.col(f"_n{depth}") >= (min_rows if depth > 1 else 1)
        options.append(F.when(enough, F.col(f"_s{depth}") / F.col(f"_n{depth}")))
    out = joined.withColumn("predicted_rating", F.coalesce(*options))
    return add_residual(out).drop(*[f"_{k}{d}" for k in "sn" for d in (1, 2, 3)])


# --- neighbourhoods -----------------------------------------------------------------------

CLUSTER_INPUTS = [
    "mean_rating", "mean_residual", "mean_reviews", "chain_share", "mean_price", "cuisine_diversity",
    "restaurant_count",
]


def cluster_cells(hexes: DataFrame, k: int = 4, seeds: int = 10, seed: int = 42) -> DataFrame:
    """Adds hub_score (first principal component), cluster and cluster_label to the hex table.

    Inputs are scaled to unit population spread; the best of several k-means runs is kept and
    the component is turned so that it does not fall with the mean rating.
    """
    hexes = materialise(hexes)
    n = hexes.count()
    rows = hexes.withColumns({f"c_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CLUSTER_INPUTS})
    rows = VectorAssembler(inputCols=[f"c_{c}" for c in CLUSTER_INPUTS], outputCol="_raw").transform(rows)
    scaled = (
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    )
    stretch = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    scaled = (
        scaled.withColumn("_z", F.transform(vector_to_array("_scaled"), lambda v: v * F.lit(stretch)))
        .withColumns({f"z_{c}": F.col("_z")[i] for i, c in enumerate(CLUSTER_INPUTS)})
        .drop("_raw", "_scaled", "_z")
    )
    vectors = VectorAssembler(inputCols=[f"z_{c}" for c in CLUSTER_INPUTS], outputCol="_v").transform(scaled)
    vectors = vectors.cache()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(vectors) for i in range(seeds)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        pca = PCA(k=1, inputCol="_v", outputCol="_pc").fit(vectors)
    finally:
        vectors.unpersist()
    weight = pca.pc.toArray()[0][0]
    out = best.transform(pca.transform(vectors))
    hub = vector_to_array("_pc")[0] * F.lit(1.0 if weight >= 0 else -1.0)
    helpers = [c for c in out.columns if c.startswith(("c_", "z_"))] + ["_v", "_pc"]
    return label_clusters(out.withColumn("hub_score", hub).drop(*helpers))


def with_geometry(hexes: DataFrame, grid: HexGrid) -> DataFrame:
    centre = grid.centre(F.col("cell"))
    return hexes.withColumns(
        {"hex_lat": centre["lat"], "hex_lng": centre["lng"], "boundary": grid.boundary(F.col("cell"))}
    )


def neighbourhoods(venues: DataFrame, grid: HexGrid) -> DataFrame:
    """Hex table with hub score, clusters and geometry."""
    return with_geometry(cluster_cells(hex_table(venues)), grid)


# --- GeoJSON -----------------------------------------------------------------------------

def hex_features_json(hexes: DataFrame, grid: HexGrid) -> DataFrame:
    """cell and one GeoJSON feature per cell, with a closed (lng, lat) ring."""
    ring = F.transform(grid.boundary(F.col("cell")), lambda p: F.array(p["lng"], p["lat"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.col("cell").alias("h3_index"),
            half_even(F.col("mean_rating"), 2).alias("mean_rating"),
            half_even(F.col("mean_residual"), 3).alias("mean_residual"),
            F.col("restaurant_count").cast("int").alias("restaurant_count"),
            F.col("cluster_label").alias("cluster_label"),
            half_even(F.col("hub_score"), 2).alias("hub_score"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"),
    )
    return hexes.filter(F.col("cell").isNotNull()).select(
        "cell", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )


def write_feature_collection(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line; the scalable form of the collection."""
    features.select("feature").write.mode("overwrite").text(path)

