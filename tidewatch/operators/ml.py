"""The generated-domain model: n-gram language models, boosted trees on lexical features, and logistic calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features, scalars
from .ordered import placed_within

C = F.col
FEATURES = ["length", "entropy", "digit_ratio", "vowel_ratio", "label_count", "lm_bigram", "lm_trigram"]
SEED = 26_145
#: Rows that a task has at least when the trees are grown, if all cores have a task.
TASK_ROWS = 100_000


def exploded(df: DataFrame, label: str, n: int) -> DataFrame:
    return df.select("*", F.explode(features.ngrams_of(C(label), n)).alias("gram"))


def language_model(names: DataFrame, label: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """gram, p: relative frequency over all sizes together."""
    from functools import reduce

    grams = reduce(DataFrame.unionByName, [exploded(names.select(label), label, n).select("gram") for n in sizes])
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    return counts.select("gram", (C("c") / F.sum("c").over(Window.partitionBy(F.lit(1)))).alias("p"))


def language_scores(df: DataFrame, label: str, model: DataFrame, sizes: tuple[int, ...] = (2, 3), floor: float = -12.0, by: tuple[str, ...] = ()) -> DataFrame:
    """df with lm_<n>, the mean log probability of its label's n-grams by a left join on the model; unseen grams count as the floor, a short label as 0. With `by`, columns of df and the model, each of their values has its own model. All sizes are looked up in one pass."""
    own = [label, *by]
    grams = df.select(*own).distinct().select(*own, F.explode(F.concat(*[features.ngrams_of(C(label), n) for n in sizes])).alias("gram"))
    p = F.when(C("p").isNull(), floor).otherwise(F.log(F.greatest("p", F.lit(1e-12))))
    means = grams.join(model, ["gram", *by], "left").groupBy(*own).agg(*[F.avg(F.when(F.length("gram") == n, p)).alias(f"lm_{n}") for n in sizes])
    return df.join(means, own, "left").fillna(0.0, [f"lm_{n}" for n in sizes])


def lexical(df: DataFrame, model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """df (qname) with the seven features; `by` as in language_scores."""
    f = features.domain_features(C("qname"), F.lit(0.0), F.lit(None).cast("map<string,double>"))
    d = df.withColumns({n: f[n] for n in FEATURES[:5]}).withColumn("_label", F.regexp_replace(features.primary_label(C("qname")), "[^a-z0-9]", ""))
    # A model of 36 characters has 36 ** 2 + 36 ** 3 grams at most, whatever the names: it goes to all tasks.
    return language_scores(d, "_label", F.broadcast(model), by=by).withColumnsRenamed({"lm_2": "lm_bigram", "lm_3": "lm_trigram"}).drop("_label")


def out_of_fold(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """df (qname, y) with the seven features, the language scores of each fold by a model of the benign names of the other folds; a group is in one fold."""
    d = df.withColumn("_fold", scalars.hash_bucket(C(group), folds))
    benign = d.where("y = 0").withColumn("_name", F.regexp_replace(features.primary_label(C("qname")), "[^a-z0-9]", ""))
    return lexical(d, fold_models(benign, "_name", folds), ("_fold",)).drop("_fold")


def fold_models(names: DataFrame, label: str, folds: int, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """_fold, gram, p: for each fold the language model of the names (label, _fold) of the others, from one count of all: what a gram has in all folds less what it has in its own."""
    from functools import reduce

    grams = reduce(DataFrame.unionByName, [exploded(names.select("_fold", label), label, n).select("_fold", "gram") for n in sizes])
    own = [F.count_if(C("_fold") == k).alias(f"_{k}") for k in range(folds)]
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *own)
    left = F.array(*[F.struct(F.lit(k).cast("long").alias("_fold"), (C("n") - C(f"_{k}")).alias("c")) for k in range(folds)])
    c = counts.select("gram", F.inline(left)).where("c > 0")
    return c.select("_fold", "gram", (C("c") / F.sum("c").over(Window.partitionBy("_fold"))).alias("p"))


class DgaModel:
    """Boosted trees on the seven features, calibrated by a logistic fit on every fourth example of each class."""

    def __init__(self, trees: PipelineModel, platt: PipelineModel, names: DataFrame):
        self.trees, self.platt, self.names = trees, platt, names

    @staticmethod
    def fit(df: DataFrame, group: str = "domain", trees: int = 120) -> DgaModel:
        """From rows (qname, y, group column)."""
        names = language_model(df.where("y = 0").withColumn("_name", F.regexp_replace(features.primary_label(C("qname")), "[^a-z0-9]", "")), "_name")
        # The order of a class is cut by the first digits of its hashes, so that the trees are grown by all tasks and not by one a class. Places are given before the features are, as that reads its rows twice; the whole is read twice by the trees' two parts.
        placed = placed_within(df.withColumn("_hash", F.sha2("qname", 256)), ["y"], "_hash", F.substring("_hash", 1, 3), "_place")
        placed = placed.withColumn("_held", C("_place") % 4 == 0).withColumn("label", C("y").cast("double")).drop("_hash", "_place")
        d = out_of_fold(placed, group).persist()
        # Trees and calibration pass over the rows hundreds of times: tasks of few rows would take longer to send than to run.
        rows = d.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-d.count() // TASK_ROWS)))
        gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, stepSize=0.08, maxDepth=4, minInstancesPerNode=5, seed=SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt]).fit(rows.where("not _held"))
        raw = DgaModel._raw(model.transform(rows.where("_held")))
        platt = Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="logit_v"), LogisticRegression(featuresCol="logit_v", labelCol="label")]).fit(raw.select("logit", "label"))
        d.unpersist()
        return DgaModel(model, platt, names)

    @staticmethod
    def _raw(df: DataFrame) -> DataFrame:
        return df.withColumn("logit", scalars.logit(vector_to_array("probability")[1])).drop("rawPrediction", "probability", "prediction", "features")

    def predict(self, df: DataFrame) -> DataFrame:
        """df with p, the calibrated probability."""
        raw = self._raw(self.trees.transform(lexical(df, self.names)))
        return self.platt.transform(raw).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "logit_v", "logit", *FEATURES)

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        self.platt.write().overwrite().save(f"{path}/platt")
        self.names.write.mode("overwrite").parquet(f"{path}/names")

    @staticmethod
    def load(spark, path: str) -> DgaModel:
        return DgaModel(PipelineModel.load(f"{path}/trees"), PipelineModel.load(f"{path}/platt"), spark.read.parquet(f"{path}/names"))


def calibrate_detectors(df: DataFrame, ridge: float = 1e-3, least: int = 5) -> dict[str, tuple[float, float]]:
    """(a, b) of a logistic fit of truth on x for each detector with at least `least` true and false alerts and a rising slope. The detectors are a fixed few, so they are fitted one by one."""
    counts = df.groupBy("detector").agg(F.sum("truth").alias("pos"), F.sum(1 - C("truth")).alias("neg")).collect()
    out = {}
    for r in counts:
        if r.pos >= least and r.neg >= least:
            own = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.where(C("detector") == r.detector).withColumn("label", C("truth").cast("double")))
            m = LogisticRegression(regParam=ridge, standardization=False).fit(own)
            if m.coefficients[0] > 0:
                out[r.detector] = (float(m.coefficients[0]), float(m.intercept))
    return out
