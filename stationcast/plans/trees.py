"""Tree ensembles as tables: one row per node, and scoring by joins over them.

A trained or loaded forest or boosted ensemble becomes a DataFrame that any engine can
read: tree, node, feature, threshold, children, value, rows and weight. Rows walk down
all trees at once, one join with the node table a level. Node tables are bounded by the
model (trees times nodes of a tree); their size is checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DATE, STATION
from ..session import durable, scratch_path
from .least_squares import as_array

#: Nodes of a table that is broadcast.
BROADCAST_NODES = 1_000_000


def ensemble_of(model):
    """The tree ensemble at the end of a pipeline."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if not hasattr(last, "treeWeights"):
        raise ValueError(f"{type(last).__name__} is no tree ensemble")
    return last


def node_table(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    """``tree``, ``node``, ``feature``, ``position``, ``threshold``, ``left``, ``right``, ``value``, ``n``, ``weight``.

    Leaves have no feature, threshold and children. A row goes left if its value is at most
    the threshold. ``n`` counts the (bagged) training rows of the node; the weights are those
    that the trees' values are added up with.
    """
    ensemble = ensemble_of(model)
    path = scratch_path(spark, "trees")
    ensemble.write().save(path)
    # Spark's own format of saved ensembles: a row per node, a row per tree with its weight last
    nodes, trees = spark.read.load(f"{path}/data"), spark.read.load(f"{path}/treesMetadata")
    total = sum(ensemble.treeWeights) if "RandomForest" in type(ensemble).__name__ else 1.0
    weights = trees.select(F.col(trees.columns[0]).alias("tree"), (F.col(trees.columns[-1]) / total).alias("weight"))
    inner = F.col("nodeData.leftChild") >= 0
    position = F.when(inner, F.col("nodeData.split.featureIndex"))
    flat = nodes.select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.get(F.array(*[F.lit(c) for c in columns]), position).alias("feature"),
        position.alias("position"),
        F.when(inner, F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("nodeData.leftChild")).alias("left"),
        F.when(inner, F.col("nodeData.rightChild")).alias("right"),
        F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.rawCount").alias("n"),
    )
    return durable(flat.join(F.broadcast(weights), "tree"), "nodes")


def _small(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def _depth(nodes: DataFrame) -> int:
    """Levels below the root of the deepest tree."""
    links = nodes.filter("left is not null").select("tree", "node", F.explode(F.array("left", "right")).alias("child"))
    level, depth = nodes.filter("node = 0").select("tree", "node"), 0
    while True:
        level = durable(level.join(links, ["tree", "node"]).select("tree", F.col("child").alias("node")), "level")
        if level.isEmpty():
            return depth
        depth += 1


def walk(rows: DataFrame, nodes: DataFrame, features: str = "features") -> DataFrame:
    """``rows`` times trees, with the ``tree`` and the ``node`` of the leaf that each row reaches."""
    n_trees, depth = nodes.agg(F.max("tree")).first()[0] + 1, _depth(nodes)
    splits = _small(nodes.filter("left is not null").select("tree", "node", "position", "threshold", "left", "right"))
    at = rows.withColumns({"_x": as_array(rows, features), "tree": F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))), "node": F.lit(0)})
    for _ in range(depth):
        met = at.join(splits, ["tree", "node"], "left")
        side = F.when(F.get("_x", F.col("position")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = met.withColumn("node", F.coalesce(side, F.col("node"))).drop("position", "threshold", "left", "right")
    return at.drop("_x")


def leaf_values(rows: DataFrame, nodes: DataFrame, label: Column, features: str = "features") -> DataFrame:
    """Each leaf beside the rows that reach it: ``tree``, ``node``, ``value``, ``n`` of the model, ``n_rows``, ``mean_label``."""
    reached = walk(rows.select(label.alias("_y"), features), nodes, features).groupBy("tree", "node")
    found = reached.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("_y").alias("mean_label"))
    leaves = nodes.filter("left is null").select("tree", "node", "value", "n")
    return leaves.join(found, ["tree", "node"], "left")


def score(rows: DataFrame, nodes: DataFrame, keys: Sequence[str] = (STATION, DATE), features: str = "features") -> DataFrame:
    """``keys`` and the ``prediction`` of the ensemble; keys must tell the rows apart."""
    leaves = _small(nodes.filter("left is null").select("tree", "node", (F.col("value") * F.col("weight")).alias("share")))
    reached = walk(rows.select(*keys, features), nodes, features)
    return reached.join(leaves, ["tree", "node"]).groupBy(*keys).agg(F.sum("share").alias("prediction"))


def importance(nodes: DataFrame) -> DataFrame:
    """How often and over how many training rows each feature splits."""
    inner = nodes.filter("left is not null")
    return inner.groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("n").alias("rows"))
