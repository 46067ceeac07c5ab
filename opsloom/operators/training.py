"""Training set preparation, classifier, evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.ordered import by_prefix, row_index

# Hidden layer sizes, batch rows, epochs, held-out share, seed.
HIDDEN = [256, 128]
BATCH, EPOCHS, TEST_SHARE, SEED = 64, 10, 0.2, 42


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """code = position of the label among the sorted distinct labels; NULL for a NULL label."""
    names = df.select(F.col(label).cast("string").alias("_name")).distinct().filter("_name IS NOT NULL")
    codes = row_index(names, [], ["_name"], by_prefix("_name", 1), "code")
    return (df.withColumn("_name", F.col(label).cast("string")).join(codes, "_name", "left").drop("_name"))


def _place(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.withColumn("_place", F.md5(F.concat_ws(":", F.lit(str(seed)),
                                                     F.col(key).cast("string"))))


def stratified_split(df: DataFrame, share: float = TEST_SHARE, seed: int = SEED,
                     label: str = "label", key: str = "id") -> DataFrame:
    """``split`` = test for the first round(n * share) rows of each label in hash order.

    Sizes are exact and repeatable. Ranks come from slices of the hash, so a label that holds most
    rows is ranked by many tasks. Rows with a NULL label are split like a label of their own.
    """
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_index(_place(df, seed, key), [label], ["_place", key], by_prefix("_place"), "_rank")
    test = F.col("_rank") < F.round(F.col("_n") * share)
    return (ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
            .withColumn("split", F.when(test, "test").otherwise("train"))
            .drop("_place", "_rank", "_n", "_label"))


def assign_batches(df: DataFrame, workers: int, batch: int = BATCH, seed: int = SEED,
                   by: Sequence[str] = ("split",), key: str = "id") -> DataFrame:
    """Row i of a split goes to worker i mod w and batch (i / w) / b of that worker."""
    placed = row_index(_place(df, seed, key), list(by), ["_place", key], by_prefix("_place"), "_i")
    return (placed.withColumn("worker", F.pmod("_i", F.lit(workers)))
            .withColumn("batch", F.expr(f"(_i div {int(workers)}) div {int(batch)}"))
            .drop("_place", "_i"))


def train_classifier(df: DataFrame, kind: str = "mlp", label: str = "label",
                     vec: str = "embedding", max_iter: int = EPOCHS, seed: int = SEED,
                     hidden: Sequence[int] = tuple(HIDDEN)) -> PipelineModel:
    """Feed-forward network d -> 256 -> 128 -> classes, or logistic regression.

    The network of the library uses sigmoid units, so it differs from a ReLU network by design.
    """
    shape = df.agg(F.max(F.size(vec)).alias("d"), F.count_distinct(label).alias("c")).first()
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc",
                            handleInvalid="keep")
    if kind == "mlp":
        head = MultilayerPerceptronClassifier(
            layers=[shape["d"], *hidden, shape["c"] + 1], maxIter=max_iter, seed=seed,
            featuresCol="features", labelCol="_y", predictionCol="_p")
    elif kind == "logistic":
        head = LogisticRegression(maxIter=max_iter, featuresCol="features", labelCol="_y",
                                  predictionCol="_p")
    else:
        raise ValueError(f"unknown classifier {kind}")
    return Pipeline(stages=[indexer, head]).fit(with_features(df, vec))


def with_features(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def score(model: PipelineModel, df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Arg-max class as the original label text."""
    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    out = model.transform(with_features(df, vec))
    return out.withColumn("prediction", F.try_element_at(names, (F.col("_p") + 1).cast("int"))).drop(
        "features", "_y", "_p", "rawPrediction", "probability")


def score_linear(df: DataFrame, classes: Mapping[str, tuple[str, float]],
                 vec: str = "embedding") -> DataFrame:
    """D22 with given coefficients: the class of the largest ``w . x + b``, the first one on ties.

    ``classes`` has for each class the weight at place ``i`` (from 0) as an expression, and ``b``.
    """
    x = F.col(vec).cast("array<double>")
    cells = []
    for at, (name, (weight, bias)) in enumerate(classes.items()):
        dot = F.expr(f"aggregate(transform(cast({vec} AS array<double>), (x, i) -> x * ({weight})), "
                     f"0.0D, (a, y) -> a + y)") + F.lit(float(bias))
        cells.append(F.struct(dot.alias("margin"), F.lit(-at).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*cells))
    return df.withColumn("prediction", F.when(x.isNotNull(), best["name"]))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A22, long form."""
    return pred.groupBy(F.col(label).cast("string").alias("label"),
                        F.col(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_wide(pred: DataFrame, classes: Sequence[str], label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """A22 with one column per class."""
    return (confusion_matrix(pred, label, prediction).groupBy("label")
            .pivot("prediction", list(classes)).agg(F.sum("n")).na.fill(0))


def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per class, accuracy, macro and weighted averages; all from the confusion counts."""
    cells = confusion_matrix(pred, label, prediction)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))))
    per = sides.filter("class IS NOT NULL").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("tp").alias("tp"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")),
                           "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))
    total = F.sum("support")

    def weighted(c):
        return ratio(F.sum(F.col(c) * F.col("support")), total)

    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1").alias("f1"), total.alias("support"))
    heavy = per.agg(weighted("precision").alias("precision"), weighted("recall").alias("recall"),
                    weighted("f1").alias("f1"), total.alias("support"))
    hit = ratio(F.sum("tp"), total)
    plain = per.agg(hit.alias("precision"), hit.alias("recall"), hit.alias("f1"),
                    total.alias("support"))
    out = per.select("class", "precision", "recall", "f1", "support")
    for name, df in (("accuracy", plain), ("macro avg", macro), ("weighted avg", heavy)):
        out = out.unionByName(df.withColumn("class", F.lit(name)))
    return out


def run_metrics(pred: DataFrame, run: str, label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Evaluation as (run, metric, value) rows."""
    report = classification_report(pred, label, prediction)
    cells = [F.struct(F.concat_ws(".", "class", F.lit(m)).alias("metric"),
                      F.col(m).cast("double").alias("value"))
             for m in ("precision", "recall", "f1", "support")]
    return report.select(F.lit(run).alias("run"), F.inline(F.array(*cells)))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """Mean loss and accuracy per epoch; ``best`` marks the highest accuracy, earliest first."""
    per = batches.groupBy("epoch").agg(
        F.avg("loss").alias("loss"), (100 * F.sum("correct") / F.sum("total")).alias("accuracy"))
    # One row per epoch, so ranking them all together is cheap.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("accuracy"), "epoch"))
    return per.withColumn("best", rank == 1)


def label_profile(df: DataFrame, by: Sequence[str] = ("dataset",), label: str = "label",
                  vec: str = "embedding") -> DataFrame:
    """A24."""
    return df.groupBy(*by).agg(
        F.count_distinct(label).alias("classes"), F.count(F.lit(1)).alias("n"),
        F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim"))
