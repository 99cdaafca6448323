"""A forest as a table of splits, and scores from it in one projection.

Rows are (tree, node, feature, threshold, left, right, zeros, ones): what a node asks (feature number, up to the threshold to the left), where that
leads, and the weight of both classes in a leaf (left is -1 there). The table may come from a trained model or from anywhere else. To score, it
becomes one row of arrays, whose size is the number of trees times the nodes that their depth allows; each record walks down all trees at once.
A feature that is NaN or null is beyond every threshold.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.text import let
from veritrail.operators import scoring
from veritrail.sources.catalog import work_dir

SPLITS = "tree int, node int, feature int, threshold double, left int, right int, zeros double, ones double"


def exported(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The table of a trained pipeline's forest, its last stage, as it is stored."""
    at = work_dir(spark, "forest")
    model.stages[-1].write().save(at)
    node = spark.read.parquet(f"{at}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return node.select(
        "tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"), F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), F.col("impurityStats")[0].alias("zeros"), F.col("impurityStats")[1].alias("ones"),
    )


def arrays(trees: DataFrame) -> DataFrame:
    """One row: `forest`, an array of trees, each arrays by node; nodes are numbered from 0 without gaps."""
    p = F.col("ones") / F.nullif(F.col("zeros") + F.col("ones"), F.lit(0.0))
    one = trees.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left", "right", F.coalesce(p, F.lit(0.0)).alias("p")))).alias("n"))
    of = lambda c: F.transform("n", lambda x: x[c]).alias(c)
    fields = [of(c) for c in ("feature", "threshold", "left", "right", "p")]
    return one.select("tree", F.struct(*fields).alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "t"))), lambda x: x["t"]).alias("forest"))


def probability(forest: Column, vector: Column, depth: int) -> Column:
    """The mean of the trees' shares of ones in the leaves that `vector`, an array of features, comes to."""

    def leaf(t: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            goes_left = F.coalesce(F.get(vector, F.get(t["feature"], at)) <= F.get(t["threshold"], at), F.lit(False))
            return F.when(F.get(t["left"], at) < 0, at).when(goes_left, F.get(t["left"], at)).otherwise(F.get(t["right"], at))

        return F.get(t["p"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down))

    return F.aggregate(F.transform(forest, leaf), F.lit(0.0), lambda a, x: a + x) / F.size(forest)


def scored(df: DataFrame, trees: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """`df` with `probability_1`; the forest is one row of a size that its parameters bound, and goes to every task."""
    vector = F.array(*(F.col(c).cast("double") for c in columns))
    # the vector is bound once, not made anew at each node
    found = let(vector, lambda x: probability(F.col("forest"), x, depth))
    return df.crossJoin(F.broadcast(arrays(trees))).withColumn("probability_1", found).drop("forest")


def online(features: DataFrame, trees: DataFrame, columns: list[str], depth: int, length: str) -> DataFrame:
    """`features` with ai_probability, ai_score, label and confidence: features are standardised, texts with a `length` below 50 score 0 as original."""
    stats = features.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))))
    scale = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns}
    scaled = features.crossJoin(F.broadcast(stats)).select(*(c for c in features.columns if c not in columns), *(x.alias(c) for c, x in scale.items()))
    found = scored(scaled, trees, columns, depth).withColumn("decision", scoring.model_decision(F.col("probability_1"), F.col(length)))
    rest = [c for c in features.columns if c not in columns]
    return found.select(*rest, F.when(F.col(length) >= 50, F.round("probability_1", 4)).otherwise(0.0).alias("ai_probability"), "decision.*")
