"""Model fitting and scoring on pyspark.ml: standardisation, balanced class
weights, logistic regression, random forest, random search with stratified
folds, importances, scoring, model comparison.

Training data is persisted for the duration of a fit (the optimisers and the
tree builder scan it once per iteration / depth level) and released after.
Deep forests keep each row's node in every tree beside the row (cached node ids,
checkpointed every few levels), so no task carries the forest that is growing;
shallow ones, bounded by numTrees x 2^SHALLOW nodes, do without.
Per-feature statistics (means, stds, class counts) are bounded by the number
of features or classes and travel to the executors as literals.
"""

from __future__ import annotations

import itertools
import math
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.functions.columns import positive_probability
from loanscope.operators.features import NUMERIC_FEATURES
from loanscope.operators.trees import cut_back, importances_of, node_table, save_forest, score_settings, with_forest
from loanscope.session import ensure_checkpoint_dir

LABEL = "DefaultFlag"


# ---- M2 / M3 ---------------------------------------------------------------------------------------

def fit_standardizer(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Per column (mean, population std) over the training rows; std 0 -> 1."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    stats = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        stats[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return stats


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std with train statistics (NULL stays NULL)."""
    out = df
    for c, (m, s) in stats.items():
        out = out.withColumn(c, (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return out


def balanced_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """weight = n / (k * n_class) ("balanced"): class counts (k rows) broadcast back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    everything = Window.partitionBy()
    w = counts.select(label, (F.sum("_nc").over(everything).cast("double")
                              / (F.count(F.lit(1)).over(everything) * F.col("_nc")).cast("double")).alias(out))
    return df.join(F.broadcast(w), label, "left")


# ---- pipelines -------------------------------------------------------------------------------------

def _prepared(features: list[str], nullable: list[str]) -> tuple[list, list[str]]:
    """Imputer (train means) for the inputs that may hold NULLs at scoring
    time (all features by default: training data may be NULL-free when the
    scored data is not), then the assembler."""
    stages: list = []
    cols = list(features)
    if nullable:
        outs = [f"{c}__imp" for c in nullable]
        stages.append(Imputer(strategy="mean", inputCols=nullable, outputCols=outs))
        cols = [f"{c}__imp" if c in nullable else c for c in features]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error"))
    return stages, cols


#: Rows of one partition of a training frame, and partitions of a small one.
TRAIN_ROWS = 50_000
TRAIN_PARTITIONS = 4


def train_partitions(rows: int) -> int:
    """Partitions of a training frame of ``rows`` rows.  Bagging seeds follow partitions and
    row order, so the number depends on the rows alone, never on the cores."""
    return max(TRAIN_PARTITIONS, math.ceil(rows / TRAIN_ROWS))


def laid_out(df: DataFrame, key: str = "LoanID", partitions: int | None = None) -> DataFrame:
    """The training rows dealt and sorted by key."""
    return df.repartition(partitions or train_partitions(df.count()), key).sortWithinPartitions(key)


def as_double_features(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Features as DOUBLE, label as DOUBLE 'label' (pyspark.ml input shape)."""
    keep = [c for c in df.columns if c not in features and c != "label"]
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features],
                     F.col(label).cast("double").alias("label"))


def training_rows(train: DataFrame, features: list[str], *more: str | None, key: str = "LoanID") -> DataFrame:
    """The columns that a fit reads: key, features, label and ``more`` (weight, fold); the rest of the
    feature table is neither shuffled nor persisted."""
    return as_double_features(train, features).select(key, *features, "label", *[c for c in more if c])


@dataclass
class Fitted:
    model: PipelineModel
    features: list[str]
    name: str
    #: (mean, population std) of the features that the model scales.
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)


def train_logistic(train: DataFrame, features: list[str], weight: str | None = "weight", c: float = 1.0,
                   max_iter: int = 1000, seed: int = 42) -> Fitted:
    """L2 logistic regression; the numeric features are standardised as in M2 (mean
    and population std of the training rows), one-hot columns stay 0/1.  With
    balanced weights the penalty 1/(2C)||w||^2 over the weighted log-loss sum maps
    to regParam = 1/(C*sum w)."""
    data = laid_out(training_rows(train, features, weight)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total_w = data.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0] or 1.0
        imputer = _prepared(features, features)[0][0]
        filled = {c: f"{c}__imp" for c in features}
        numeric = [c for c in features if c in NUMERIC_FEATURES]
        stats = fit_standardizer(imputer.fit(data).transform(data), [filled[c] for c in numeric])
        scale = {c: stats[filled[c]] for c in numeric}
        scaled = SQLTransformer(statement="SELECT *, " + ", ".join(
            f"(`{filled[c]}` - {m!r}D) / {s!r}D AS `{c}__std`" for c, (m, s) in scale.items()) + " FROM __THIS__")
        vector = VectorAssembler(inputCols=[f"{c}__std" if c in scale else filled[c] for c in features],
                                 outputCol="scaled", handleInvalid="error")
        lr = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=max_iter, regParam=1.0 / (c * total_w),
                                elasticNetParam=0.0, standardization=False, tol=1e-6)
        if weight:
            lr.setWeightCol(weight)
        model = Pipeline(stages=[imputer, *([scaled] if scale else []), vector, lr]).fit(data)
    finally:
        data.unpersist()
    return Fitted(model, features, "LogisticRegression", scale)


#: Depth up to which a growing forest (numTrees x 2^SHALLOW nodes at most) is sent with the tasks.
SHALLOW = 6


def _forest(spark: SparkSession, weight: str | None, seed: int, **params) -> RandomForestClassifier:
    """Gini forest.  A deep one keeps each row's node in every tree, with the lineage cut in the shared checkpoint
    folder; the nodes of a shallow one are few and travel with the tasks, which spares an array of numTrees ints a row.
    The forest is the same either way."""
    ensure_checkpoint_dir(spark)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", impurity="gini", seed=seed,
                                cacheNodeIds=params.get("maxDepth", 5) > SHALLOW, checkpointInterval=10, **params)
    return rf.setWeightCol(weight) if weight else rf


def train_forest(train: DataFrame, features: list[str], weight: str | None = "weight", num_trees: int = 200,
                 max_depth: int = 30, min_instances: int = 1, subset: str = "sqrt", seed: int = 42,
                 max_bins: int = 32, name: str = "RandomForest", min_split: int = 2, partitions: int | None = None) -> Fitted:
    """Random forest (Gini); max_depth None in the reference maps to Spark's cap of 30.
    ``min_split``: rows below which a node is not split."""
    spark = train.sparkSession
    data = laid_out(training_rows(train, features, weight), partitions=partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stages, _ = _prepared(features, features)
        rf = _forest(spark, weight, seed, numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_instances,
                     featureSubsetStrategy=subset, maxBins=max_bins)
        model = Pipeline(stages=stages + [rf]).fit(data)
    finally:
        data.unpersist()
    if min_split > 2:
        model = with_forest(model, cut_back(spark, save_forest(spark, model.stages[-1]), min_split))
    return Fitted(model, features, name)


# The random-search space (n_estimators, max_depth, min_samples_split, min_samples_leaf, max_features).
SEARCH_SPACE = {
    "numTrees": [100, 200, 400],
    "maxDepth": [6, 10, 15, 30],
    "minSamplesSplit": [2, 5, 10],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
}


def draw(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Seeded sample of grid points, without repeats."""
    points = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    return random.Random(seed).sample(points, min(n_iter, len(points)))


def shared_fits(points: list[dict]) -> list[tuple[dict, list[int]]]:
    """(parameters of a fit, points that it serves): trees, depth and rows a split are cut
    back from the largest forest with the same leaf size and feature subset."""
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        groups.setdefault((p["minInstancesPerNode"], p["featureSubsetStrategy"]), []).append(i)
    return [({"minInstancesPerNode": leaf, "featureSubsetStrategy": subset,
              "numTrees": max(points[i]["numTrees"] for i in at), "maxDepth": max(points[i]["maxDepth"] for i in at)}, at)
            for (leaf, subset), at in groups.items()]


def random_search(train: DataFrame, features: list[str], fold_col: str = "fold", folds: int = 3, n_iter: int = 20, seed: int = 42,
                  weight: str | None = "weight", parallelism: int = 3,
                  space: dict[str, list] | None = None) -> tuple[Fitted, list[tuple[dict, float]]]:
    """Seeded sample of ``n_iter`` grid points, k-fold CV on the given stratified
    folds 0 to ``folds`` - 1 (exact ROC-AUC), refit of the best on all training rows.

    Points that differ only in trees, depth or rows a split share one deep fit a fold,
    cut back to each of them when the fold is scored; ``parallelism`` fits run at once."""
    points = draw(space or SEARCH_SPACE, n_iter, seed)
    spark = train.sparkSession
    stages, inputs = _prepared(features, features)
    data = laid_out(training_rows(train, features, weight, fold_col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prepared = []
        for f in range(folds):
            ready = Pipeline(stages=stages).fit(data.where(F.col(fold_col) != f))
            prepared.append((ready.transform(data.where(F.col(fold_col) != f)).persist(StorageLevel.MEMORY_AND_DISK),
                             ready.transform(data.where(F.col(fold_col) == f))))

        def run(task) -> dict[int, float]:
            (fit, at), (known, held) = task
            path = save_forest(spark, _forest(spark, weight, seed, **fit).fit(known))
            scored = score_settings(path, held, inputs, [points[i] for i in at], ["label"]).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="p", metricName="areaUnderROC", numBins=0)
                return {i: auc.evaluate(scored.select("label", F.get("Scores", F.lit(k)).alias("p"))) for k, i in enumerate(at)}
            finally:
                scored.unpersist()

        tasks = sorted(itertools.product(shared_fits(points), prepared), key=lambda t: -t[0][0]["numTrees"] * t[0][0]["maxDepth"])
        with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
            found = pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)
        for known, _ in prepared:
            known.unpersist()
    finally:
        data.unpersist()
    results = [(p, sum(r[i] for r in found if i in r) / folds) for i, p in enumerate(points)]
    best = max(results, key=lambda r: r[1])[0]
    model = train_forest(train, features, weight, best["numTrees"], best["maxDepth"], best["minInstancesPerNode"],
                         best["featureSubsetStrategy"], seed, name="RandomForest_tuned", min_split=best.get("minSamplesSplit", 2))
    return model, results


def logistic_gradient(fitted: Fitted, train: DataFrame, c: float = 1.0, weight: str = "weight") -> DataFrame:
    """Feature, Coefficient, Gradient of the penalised loss that ``train_logistic`` minimises, at the
    fitted coefficients: one aggregate over the training rows, from the exported numbers alone.  All
    gradients are near 0 at the optimum; the intercept (Feature '(intercept)') has no penalty."""
    stages = fitted.model.stages
    lr, imputer = stages[-1], stages[0]
    known = imputer.surrogateDF.first().asDict()
    weights = [float(x) for x in lr.coefficients.toArray()]
    inputs = []
    for f in fitted.features:
        mean, std = fitted.scale.get(f, (0.0, 1.0))
        inputs.append((F.coalesce(F.col(f), F.lit(float(known[f]))) - F.lit(float(mean))) / F.lit(float(std)))
    data = as_double_features(train, fitted.features).select(
        F.col("label"), F.col(weight).alias("s"), F.array(*inputs).alias("z"))
    margin = F.aggregate(F.zip_with("z", F.array(*map(F.lit, weights)), lambda z, w: z * w), F.lit(float(lr.intercept)), lambda a, x: a + x)
    off = F.col("s") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m"))) - F.col("label"))
    rows = data.withColumn("m", margin).withColumn("off", off)
    sums = rows.agg(F.sum("s").alias("total"), F.sum("off").alias("bias"),
                    *[F.sum(F.col("off") * F.get("z", F.lit(i))).alias(f"g{i}") for i in range(len(weights))])
    cells = [F.struct(F.lit(f).alias("Feature"), F.lit(w).alias("Coefficient"),
                      ((F.col(f"g{i}") + F.lit(w / c)) / F.col("total")).alias("Gradient"))
             for i, (f, w) in enumerate(zip(fitted.features, weights))]
    cells.append(F.struct(F.lit("(intercept)").alias("Feature"), F.lit(float(lr.intercept)).alias("Coefficient"),
                          (F.col("bias") / F.col("total")).alias("Gradient")))
    return sums.select(F.inline(F.array(*cells)))


def score(fitted: Fitted, df: DataFrame, threshold: float | None = 0.5, keep: list[str] | None = None) -> DataFrame:
    """keep columns + PredProb (positive-class probability) + PredFlag."""
    keep = keep or ["LoanID", LABEL]
    data = as_double_features(df, fitted.features)
    out = fitted.model.transform(data).select(*keep, positive_probability("probability").alias("PredProb"))
    if threshold is not None:
        out = out.withColumn("PredFlag", (F.col("PredProb") >= F.lit(float(threshold))).cast("int"))
    return out


def importances(fitted: Fitted, spark: SparkSession | None = None) -> DataFrame:
    """Feature, Importance (Gini decreases of the forest, summing to 1), aggregated from its node table."""
    spark = spark or SparkSession.getActiveSession()
    return importances_of(node_table(spark, save_forest(spark, fitted.model.stages[-1])), fitted.features)


def top_features(imp: DataFrame, n: int = 20) -> DataFrame:
    return imp.orderBy(F.desc("Importance"), "Feature").limit(n)


def model_comparison(scored: dict[str, DataFrame], label: str = LABEL) -> DataFrame:
    """Model, AUC, AP for each scored frame (LoanID, label, PredProb)."""
    from loanscope.operators import metrics as E

    out = None
    for name, sc in scored.items():
        row = E.auc_and_ap(sc, label, "PredProb").select(F.lit(name).alias("Model"), "AUC", "AP")
        out = row if out is None else out.unionByName(row)
    return out


def choose(comparison: DataFrame, metric: str = "AUC") -> str:
    """Name of the best model by ``metric`` (ties by name)."""
    return comparison.orderBy(F.desc(metric), "Model").first()["Model"]


def standardize_with(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale ``cols`` of ``df`` with the mean / population std of ``train``."""
    return standardize(df, fit_standardizer(train, cols))
