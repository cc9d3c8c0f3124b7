"""The learned correction: gradient-boosted trees on the residual of the physical baseline."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.operators.boosting import Booster, Trees
from zephyrframe.operators.evaluation import assign_split, metrics_by_sets, persistence, regression_metrics, residual_intervals, should_activate
from zephyrframe.operators.frames import feature_columns
from zephyrframe.operators.predictions import forecast_value
from zephyrframe.settings import DEFAULTS, Settings

MODE = "physical_residual"


@dataclass
class Artifact:
    """A fitted model with what is needed to use and judge it."""

    model: Trees
    features: list[str]
    metadata: dict = field(default_factory=dict)

    def predict(self, frame: DataFrame, name: str = "residual") -> DataFrame:
        """Adds the predicted residual; columns the frame lacks count as missing."""
        return prepared(frame, self.features, self.model.features).withColumn(name, self.model.column()).drop(*self.model.features)

    def save(self, path: str) -> None:
        """Model and metadata as the next version below a path; a version counts once its metadata, written last, is whole."""
        spark = SparkSession.getActiveSession()
        old = versions(spark, path)
        folder = f"{path}/v{max(old, default=0) + 1:08d}"
        spark.createDataFrame([(self.model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")
        spark.createDataFrame([(json.dumps({"features": self.features, "metadata": self.metadata}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")

    @classmethod
    def load(cls, path: str) -> Artifact:
        """The last whole version stored below a path."""
        spark = SparkSession.getActiveSession()
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no model below {path}")
        folder = f"{path}/v{max(found):08d}"
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        return cls(Trees.from_json(spark.read.text(f"{folder}/model").first()[0]), about["features"], about["metadata"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions below a path whose metadata is whole."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = files.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
    return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(files.Path(f"{path}/{n}/about/_SUCCESS"))]


def prepared(frame: DataFrame, features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Features as numbers under names of their own (`names`: those, then one for each gas, 1 where it is the row's); what a frame lacks is missing."""
    value = lambda c: F.col(c).cast("double") if c in frame.columns else F.lit(None).cast("double")
    gases = names[len(features) :]
    code = F.coalesce("substance_code", F.lit(""))
    return frame.select("*", *[value(c).alias(n) for c, n in zip(features, names)], *[(code == n.removeprefix("__gas_")).cast("double").alias(n) for n in gases])


def estimator(features: Sequence[str], settings: Settings = DEFAULTS) -> Booster:
    """The trees to fit, on the features and an indicator of each gas."""
    names = [*[f"__f_{c}" for c in features], *[f"__gas_{g}" for g in settings.gases]]
    return Booster(names, "correction_target", settings.iterations, settings.depth, settings.learning_rate)


def with_correction_target(frame: DataFrame) -> DataFrame:
    """Rows with a target, and what the baseline leaves of it."""
    out = frame.withColumn("correction_target", F.col("target_value") - F.col("physical_baseline"))
    return out.filter(F.col("target_value").isNotNull() & F.col("correction_target").isNotNull())


def fit(frame: DataFrame, settings: Settings = DEFAULTS) -> Artifact:
    """A model on all rows of a training frame."""
    features = feature_columns(frame, with_post=False)
    trees = estimator(features, settings)
    return Artifact(trees.fit(prepared(frame, features, trees.features)), features)


def evaluate(frame: DataFrame, artifact: Artifact) -> DataFrame:
    """A frame with the corrected prediction."""
    return artifact.predict(frame).withColumn("predicted", forecast_value(F.col("physical_baseline"), F.col("residual")))


def train(frame: DataFrame, current_mae: float | None = None, settings: Settings = DEFAULTS) -> tuple[Artifact | None, dict]:
    """Hold out the last hours, judge, and refit on everything if the candidate may replace the current model."""
    rows = with_correction_target(frame).persist()
    try:
        n = rows.count()
        if n < settings.min_train_rows:
            raise ValueError(f"{n} training rows; at least {settings.min_train_rows} are needed")
        split = assign_split(rows, settings.test_fraction)
        test = evaluate(split.filter("is_test").drop("is_test"), fit(split.filter("not is_test").drop("is_test"), settings)).withColumn("persistence", persistence(settings)).persist()
        sets = metrics_by_sets(test, "target_value", "predicted").collect()  # gases and stations
        intervals = residual_intervals(test, "target_value", "predicted").collect()
        base = test.agg(*[c.alias(f"{p}_{k}") for p in ("physical_baseline", "persistence") for k, c in regression_metrics(F.col("target_value"), F.col(p)).items()]).first().asDict()
        test.unpersist()
        entry = lambda r: {k: r[k] for k in ("mae", "rmse", "r2")}
        metrics = {
            "overall": next(entry(r) for r in sets if r["scope"] == "overall"),
            "by_gas": {r["substance_code"]: entry(r) for r in sets if r["scope"] == "gas"},
            "by_station": {str(r["monitoring_post_id"]): entry(r) for r in sets if r["scope"] == "station"},
            "baselines": base,
        }
        active, reason = should_activate(current_mae, metrics["overall"]["mae"])
        report = {"rows": n, "metrics": metrics, "activated": active, "activation_reason": reason}
        if not active:
            return None, report
        artifact = fit(rows, settings)
        artifact.metadata = {"metrics": metrics, "residual_intervals": {r["substance_code"]: {"lower": r["lower"], "upper": r["upper"]} for r in intervals}, "prediction_mode": MODE, "active_gases": list(settings.gases)}
        return artifact, report
    finally:
        rows.unpersist()


def compatible(artifact: Artifact | None, settings: Settings = DEFAULTS) -> bool:
    """Whether a stored model fits today's feature contract; else it is trained anew."""
    if artifact is None:
        return False
    about = artifact.metadata
    return about.get("prediction_mode") == MODE and "monitoring_post_id" not in artifact.features and about.get("active_gases") == list(settings.gases)
