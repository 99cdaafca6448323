"""Preparation, split and evaluation of a classifier, and the forest itself."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators import ranks

#: The class ratio that is let through, the share of groups held out, the forest, and the gates of its quality.
RATIO, TEST_SHARE, SEED = 2, 0.2, 42
TREES, DEPTH = 200, 10
LEAST_F1, LEAST_RECALL = 0.80, 0.70


def draw(key: Column, seed: int = SEED) -> Column:
    """A number that orders rows as if at random, the same in every run."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)).cast("binary"))


def sampled(df: DataFrame, id: str, rows: int, seed: int = SEED) -> DataFrame:
    """`rows` rows as if at random, the same in every run: a top-k of each partition by draw, then of all."""
    return df.orderBy(draw(F.col(id), seed), id).limit(rows)


def sampled_fraction(df: DataFrame, id: str, fraction: float, seed: int = SEED) -> DataFrame:
    """The share `fraction` of the rows, to the nearest whole row, as if at random and the same in every run: those first by draw, ranked over ranges."""
    keyed = df.select(id).withColumns({"_draw": draw(F.col(id), seed), "_one": F.lit(1)})
    ranked = ranks.running(keyed, ["_draw", id], {"_before": "_one"})
    wanted = ranked.agg(F.bround(F.count("*") * fraction).alias("_wanted"))
    chosen = ranked.crossJoin(F.broadcast(wanted)).where(F.col("_before") < F.col("_wanted")).select(id)
    return df.join(chosen, id, "left_semi")


def class_ratio(df: DataFrame, label: str, ratio: int = RATIO) -> DataFrame:
    """One row: rows of either class, how many of label 1 there are for one of label 0, and how many of label 1 are let through."""
    zeros, ones = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(zeros.alias("zeros"), ones.alias("ones"), F.round(ones / F.nullif(zeros, F.lit(0)), 4).alias("ratio"), F.least(ones, zeros * ratio).alias("most"))


def undersampled(df: DataFrame, label: str, author: str, id: str, ratio: int = RATIO) -> DataFrame:
    """`df` with at most `ratio` rows of label 1 for each of label 0, taken from authors in proportion; all of label 0 stay.

    Each author gives a rounded share, at least one row, and the whole is trimmed to the target. Without too many rows nothing is taken out.
    """
    humans, machines = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    target, ones = humans * ratio, df.where(F.col(label) == 1)
    if machines <= target:
        return df.where(F.col(label).isin(0, 1))
    size = ones.groupBy(author).agg(F.count("*").alias("own"))
    quota = F.least(F.greatest(F.lit(1), F.bround(target * (F.col("own") / machines)).cast("long")), F.col("own"))
    # ranks inside an author are running counts over ranges of (author, draw), less those of the authors before: no author is one task's
    drawn = ones.withColumns({"_draw": draw(F.col(id)), "_one": F.lit(1)})
    ranked = ranks.running(drawn, [author, "_draw", id], {"_before": "_one"})
    first = ranked.groupBy(author).agg(F.min("_before").alias("_first"))
    limits = size.withColumn("_quota", quota).join(first.withColumnRenamed(author, "_author"), F.col(author).eqNullSafe(F.col("_author"))).select(F.col(author).alias("_of"), "_quota", "_first")
    chosen = ranked.join(limits, F.col(author).eqNullSafe(F.col("_of"))).where(F.col("_before") - F.col("_first") < F.col("_quota")).select(df.columns)
    # rounding takes at most one row an author too many: those last by draw go
    over = max(0, chosen.count() - target)
    last = chosen.select(id).orderBy(F.desc(draw(F.col(id))), F.desc(id)).limit(over)
    return chosen.join(last, id, "left_anti").select(df.columns).unionByName(df.where(F.col(label) == 0))


def group_split(df: DataFrame, group: str, share: float = TEST_SHARE) -> DataFrame:
    """`df` with `part`: whole groups are held out, `share` of the groups rounded up, those first by draw. The ranks are over groups, not rows."""
    groups = df.select(group).distinct().withColumns({"draw": draw(F.col(group)), "one": F.lit(1)})
    ranked = ranks.running(groups, ["draw", group], {"before": "one"})
    n = ranked.agg(F.ceil(F.count("*") * share).alias("n"))
    part = F.when(F.col("before") < F.col("n"), "test").otherwise("train")
    return df.join(ranked.crossJoin(F.broadcast(n)).select(group, part.alias("part")), group)


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` without NaN (the median takes their place) and without infinities (the greatest or least finite value does)."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    ends = df.agg(*(x for c in columns for x in (F.max(finite(c)).alias(f"{c}_top"), F.min(finite(c)).alias(f"{c}_low"))))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), finite(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*").where("value is not null")
    # one row a column and one in all: what is brought together is as wide as the list of columns
    middle = ranks.quantiles(long, "value", (0.5,), "name").agg(*(F.max(F.when(F.col("name") == c, F.col("q")[0])).alias(f"{c}_mid") for c in columns))
    stats = ends.crossJoin(F.broadcast(middle))
    filled = {c: F.when(F.col(c).isNull() | F.isnan(c), F.col(f"{c}_mid")).when(F.col(c) == float("inf"), F.col(f"{c}_top")).when(F.col(c) == float("-inf"), F.col(f"{c}_low")).otherwise(F.col(c)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(filled).select(df.columns)


def standardised(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """`df` with columns less their mean, over their population deviation (1 where that is 0), both taken from the rows `fit_on`."""
    of = df.where(fit_on) if fit_on is not None else df
    stats = of.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))))
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(df.columns)


def class_differences(df: DataFrame, label: str, columns: list[str], top: int = 5) -> DataFrame:
    """The features whose class means are farthest apart."""
    mean = lambda c, k: F.avg(F.when(F.col(label) == k, F.col(c)))
    wide = df.agg(*(F.struct(F.lit(c).alias("feature"), mean(c, 0).alias("mean_0"), mean(c, 1).alias("mean_1")).alias(c) for c in columns))
    long = wide.select(F.explode(F.array(*columns)).alias("f")).select("f.*")
    return long.withColumn("difference", F.abs(F.col("mean_0") - F.col("mean_1"))).orderBy(F.desc("difference"), "feature").limit(top)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts and the measures that follow from them, one row; a measure without cases is 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp", "fp", "tn", "fn", F.round(over(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), F.round(over(tp, tp + fp), 6).alias("precision"), F.round(over(tp, tp + fn), 6).alias("recall"),
        F.round(over(tn, tn + fp), 6).alias("specificity"), F.round(over(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def passes_gates(measures: DataFrame) -> DataFrame:
    return measures.withColumn("passes", (F.col("f1") >= LEAST_F1) & (F.col("recall") >= LEAST_RECALL) & (F.col("specificity") >= LEAST_RECALL))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve from rank sums, ties at their mean rank; rows are first summed up by score."""
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    won = ranks.running(by, [score], {"below": "zeros"}).withColumn("won", F.col("ones") * (F.col("below") + F.col("zeros") / 2))
    return won.agg(F.round(F.sum("won") / (F.sum("ones") * F.sum("zeros")), 6).alias("auc"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, false positive rate, true positive rate) at each distinct score."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    down = ranks.running(by, [F.desc("threshold")], {"p_above": "ones", "n_above": "zeros"})
    total = down.agg(F.sum("ones").alias("p"), F.sum("zeros").alias("n"))
    rate = lambda above, own, of: F.round((F.col(above) + F.col(own)) / F.col(of), 6)
    return down.crossJoin(F.broadcast(total)).select("threshold", rate("n_above", "zeros", "n").alias("fpr"), rate("p_above", "ones", "p").alias("tpr"))


def train_forest(df: DataFrame, columns: list[str], label: str, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """A random forest whose classes weigh the same in total: n / (2 n_c) a row."""
    counts = df.groupBy(label).agg(F.count("*").alias("of_class"))
    total = df.agg(F.count("*").alias("rows"))
    weighted = df.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("rows") / (2 * F.col("of_class")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featuresCol="features", labelCol=label, weightCol="weight", seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(weighted)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with the probability of label 1 and the prediction."""
    return model.transform(df).withColumn("probability_1", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def importances(model: PipelineModel, columns: list[str], top: int | None = None) -> list[tuple[str, float]]:
    """Features by importance, greatest first; all of them, or the first `top`."""
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]
