"""Saving and loading trained models with their metadata, a version at a time.

Each save goes to a new folder below ``versions``. The model is written first and the
metadata last, and a version counts only once its metadata is complete: readers see the
old pair or the new one, never a mix, and what a crash leaves behind is never loaded.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("test_mae", T.DoubleType()),
        T.StructField("test_rmse", T.DoubleType()),
        T.StructField("test_r2", T.DoubleType()),
        T.StructField("test_mape", T.DoubleType()),
        T.StructField("overall_bias", T.DoubleType()),
        T.StructField("residual_std", T.DoubleType()),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Artifacts:
    model: PipelineModel
    metadata: dict
    version: str = ""

    @property
    def residual_std(self) -> float | None:
        """None leaves forecasts without bounds."""
        return self.metadata.get("residual_std")

    @property
    def feature_columns(self) -> list[str]:
        return list(self.metadata["feature_columns"])


def metadata_table(spark: SparkSession, metadata: dict) -> DataFrame:
    row = [metadata.get(f.name) for f in METADATA_SCHEMA.fields]
    return spark.createDataFrame([row], METADATA_SCHEMA)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _begun(spark: SparkSession, path: str) -> list[str]:
    """All versions below ``path``, whole or not, oldest first."""
    files, target = _folder(spark, f"{path}/versions")
    if not files.exists(target):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory())


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions, oldest first."""
    files, _ = _folder(spark, path)
    done = lambda v: files.exists(_folder(spark, f"{path}/versions/{v}/metadata/_SUCCESS")[1])
    return [v for v in _begun(spark, path) if done(v)]


def save_artifacts(spark: SparkSession, path: str, model: PipelineModel, metadata: dict) -> str:
    """Write a new version and return its name. Earlier versions stay as they are."""
    begun = _begun(spark, path)
    number = int(begun[-1].split("-")[0]) + 1 if begun else 1
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/versions/{version}"
    model.write().save(f"{folder}/model")
    # the committer's mark of this table makes the version count
    marked = metadata_table(spark, metadata).coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    marked.parquet(f"{folder}/metadata")
    return version


def load_artifacts(spark: SparkSession, path: str, version: str | None = None) -> Artifacts:
    """The newest complete version, or the one named."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete version {version or ''} below {path}")
    chosen = version or known[-1]
    folder = f"{path}/versions/{chosen}"
    model = PipelineModel.load(f"{folder}/model")
    return Artifacts(model, spark.read.parquet(f"{folder}/metadata").first().asDict(), chosen)


def prune(spark: SparkSession, path: str, keep: int = 3) -> list[str]:
    """Delete all but the newest ``keep`` complete versions, and unfinished ones older than these."""
    kept = versions(spark, path)[-keep:]
    gone = [v for v in _begun(spark, path) if kept and v < kept[0]]
    for version in gone:
        files, target = _folder(spark, f"{path}/versions/{version}")
        files.delete(target, True)
    return gone
