"""Decision rules as columns: labels from scores, fusion of two layers, recogniser gates, routing and consensus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.text import similarity, stripped, word_count

#: Limits of the labels, of disagreement and of the fused recognisers.
AI_ABOVE, ORIGINAL_BELOW, DISAGREE = 70, 30, 40
AGREEMENT, REVIEW_SIMILARITY, REVIEW_CONFIDENCE, ESCALATE_BELOW = 0.82, 0.60, 0.70, 0.80
#: Statistics of a text that has none.
NO_STATISTICS = {"mean_perplexity": 50.0, "perplexity_variance": 1.0, "entropy": 3.0}


def label(score: Column) -> Column:
    return F.when(score > AI_ABOVE, "AI-generated").when(score < ORIGINAL_BELOW, "Original").otherwise("Mixed")


def model_decision(probability: Column, length: Column) -> Column:
    """Struct of score, label and confidence from a probability; texts below 50 characters score 0."""
    score = F.round(probability * 100, 2)
    short = F.struct(F.lit(0.0).alias("ai_score"), F.lit("Original").alias("label"), F.lit(0.0).alias("confidence"))
    return F.when(length < 50, short).otherwise(F.struct(score.alias("ai_score"), label(probability * 100).alias("label"), F.round(F.abs(probability - 0.5) * 2, 2).alias("confidence")))


def fused_layers(statistical: Column, semantic: Column, stat_confidence: Column, sem_confidence: Column, pattern: Column, alignment: Column) -> Column:
    """Struct of score, label, confidence and basis of two layers: 60 to 40, half-way back to 50 where they disagree, and an override for uniform texts."""
    mixed = statistical * 0.6 + semantic * 0.4
    apart = F.abs(statistical - semantic) > DISAGREE
    override = (pattern == "uniform") & (alignment == "high") & (statistical > 80)
    score = F.when(apart, F.lit(50.0) + (mixed - 50) * 0.5).otherwise(mixed)
    named = F.when(override, "AI-generated").when(apart, "Mixed").otherwise(label(mixed))
    sure = F.when(apart, F.least(stat_confidence, sem_confidence) * 0.5).otherwise((stat_confidence + sem_confidence) / 2)
    return F.struct(
        F.round(F.when(override, F.greatest(score, F.lit(85.0))).otherwise(score), 6).alias("ai_score"), named.alias("label"), F.round(sure, 4).alias("confidence"),
        F.when(apart, "disagreement").otherwise("agreement").alias("basis"),
    )


def statistical_likelihood(perplexity: Column, burstiness: Column) -> Column:
    """Struct of the likelihood from perplexity (85 below 18, 15 above 50, a line between) and the uniformity of sentences, with pattern and risk."""
    p = F.when(perplexity < 18, 85.0).when(perplexity > 50, 15.0).otherwise(85 - (perplexity - 18) * (70 / 32))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - burstiness / 0.8))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), p * 0.4 + u * 60))
    return F.struct(
        F.round(score, 6).alias("likelihood"), F.round(u, 4).alias("uniformity"), F.when(u > 0.65, "uniform").when(u < 0.35, "irregular").otherwise("mixed").alias("pattern"),
        F.when(score > 70, "high").when(score > 40, "moderate").otherwise("low").alias("risk"),
    )


def ocr_gate(confidence: Column, words: Column, scanned: Column) -> Column:
    """Struct of rejected and status: too unsure with too few words, or good from 65, from 60 for scans."""
    return F.struct(((confidence < 50) & (words < 15)).alias("rejected"), F.when(confidence >= F.when(scanned, 60).otherwise(65), "good").otherwise("low").alias("status"))


def recogniser_confidence(words: Column) -> Column:
    return F.when(words >= 15, 96.0).when(words >= 5, 85.0).otherwise(50.0)


def region_route(table_like: Column, math_like: Column, confidence: Column, stroke: Column, sharpness: Column) -> Column:
    """Struct of category and kind: tables before formulas before regions that a reader is unsure of."""
    unsure = (confidence < 0.60) | (stroke > 0.45) | (sharpness < 15)
    return F.struct(
        F.when(table_like | math_like, "COMPLEX").when(unsure, "UNCERTAIN").otherwise("NORMAL").alias("category"),
        F.when(table_like, "TABLE").when(math_like, "FORMULA").otherwise("TEXT").alias("kind"),
    )


def calibrated(confidence: Column, alike: Column, specialised: Column, empty: Column) -> Column:
    """A recogniser's confidence after comparison with another's text."""
    near = F.when(alike >= 0.85, F.least(F.lit(0.99), confidence + 0.05 * alike)).when(alike < 0.40, F.greatest(F.lit(0.20), confidence - 0.15 * (1 - alike))).otherwise(confidence)
    return F.round(F.when(empty, 0.0).otherwise(F.when(specialised, F.least(F.lit(0.99), near + 0.04)).otherwise(near)), 3)


def fused_recognisers(line: Column, line_confidence: Column, page: Column, page_confidence: Column) -> Column:
    """Struct of text, confidence, model and needs_review from a line and a page recogniser, either of which may be null.

    Where both agree the surer wins; else marks of a formula or table speak for the page recogniser, else confidence decides.
    """
    alike = similarity(line, page)
    marked = page.rlike(r"[\\^_{|]") | page.contains("\n---")
    by_line = F.when(page.isNull(), True).when(line.isNull(), False).when(alike >= AGREEMENT, line_confidence >= page_confidence).when(marked, False).otherwise(line_confidence >= page_confidence)
    both = line.isNotNull() & page.isNotNull()
    own = F.when(by_line, line_confidence).otherwise(page_confidence)
    text = F.when(by_line, line).otherwise(page)
    sure = F.when(both, calibrated(own, alike, ~by_line & marked, stripped(text) == "")).otherwise(F.round(own, 3))
    return F.struct(
        text.alias("text"), sure.alias("confidence"), F.when(by_line, "line").otherwise("page").alias("model"),
        (F.coalesce(both & (alike < REVIEW_SIMILARITY), F.lit(False)) | (sure < REVIEW_CONFIDENCE)).alias("needs_review"),
    )


def with_vision(vision: Column, vision_confidence: Column, fused: Column) -> Column:
    """`fused`, the struct of two recognisers, unless a vision model has read the region: its text is taken as it is."""
    own = F.struct(vision.alias("text"), vision_confidence.alias("confidence"), F.lit("vision").alias("model"), (vision_confidence < REVIEW_CONFIDENCE).alias("needs_review"))
    return F.when(vision_confidence.isNotNull(), own).otherwise(fused)


def escalation(category: Column, line_confidence: Column, line_on: Column, page_on: Column, vision_on: Column, vision_first: Column) -> Column:
    """Struct of the recognisers that read a region: line, page, vision.

    Plain regions go to the line recogniser, and further up where it is off or unsure: to vision, else to the page recogniser. Complex ones go to the
    page recogniser, else to vision; doubtful ones to the first reader and the page recogniser. Where vision comes first it stands for the line reader.
    """
    instead, normal, complex_ = vision_first & vision_on, category == "NORMAL", category == "COMPLEX"
    line = ~complex_ & ~instead & line_on
    up = normal & ~instead & (~line_on | (F.coalesce(line_confidence, F.lit(0.0)) < ESCALATE_BELOW))
    return F.struct(
        line.alias("line"), F.when(normal, up & ~vision_on & page_on).otherwise(page_on).alias("page"),
        F.when(normal, instead | (up & vision_on)).when(complex_, ~page_on & vision_on).otherwise(instead).alias("vision"),
    )


def with_fallback(statistics: Column, length: Column) -> Column:
    """Struct of a text's statistics, the fixed ones where it is below 50 characters or there are none, and whether they are."""
    missing = (length < 50) | statistics.isNull()
    return F.struct(*(F.when(missing, F.lit(x)).otherwise(statistics[c]).alias(c) for c, x in NO_STATISTICS.items()), missing.alias("fallback"))


def first_accepted(readings: list[tuple[str, Column, int]]) -> Column:
    """Struct of engine and text: of (engine, text, least words), in order, the first with enough words; else the one with the most, of equals the first."""
    n = [F.coalesce(word_count(t), F.lit(0)) for _, t, _ in readings]
    taken = [F.when(k >= least, F.struct(F.lit(e).alias("engine"), t.alias("text"))) for k, (e, t, least) in zip(n, readings, strict=True)]
    longest = [F.when(k == F.greatest(*n), F.struct(F.lit(e).alias("engine"), t.alias("text"))) for k, (e, t, _) in zip(n, readings, strict=True)]
    return F.coalesce(*taken, *longest)
