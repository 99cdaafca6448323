"""All 18 features of a text in one table: three of a language model, eleven stylometric ones, reading ease and three of phrasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import fixed, text
from veritrail.operators import models, scoring

FEATURES = list(fixed.FEATURES)
WITHOUT_MODEL = scoring.NO_STATISTICS


def of_text(column: Column, tags: Column | None = None, entities: Column | None = None) -> Column:
    """Struct of the fifteen features that the text alone gives, and a tagger's tags and count of names if there are any, rounded to 4."""

    def joined(s: Column) -> Column:
        phrase = {"generic_phrasing": "generic", "lack_of_personal_voice": "impersonal", "over_structured_coherence": "structured"}
        return F.struct(
            *(s["style"][c].alias(c) for c in FEATURES[3:14]), s["ease"].alias("flesch_reading_ease"), *(F.round(s["phrase"][p], 4).alias(c) for c, p in phrase.items()),
        )

    return text.let(F.struct(text.stylometrics(column, tags, entities).alias("style"), text.flesch(column).alias("ease"), text.phrase_features(column).alias("phrase")), joined)


def all_features(docs: DataFrame, id: str, column: str, losses: DataFrame | None = None, tags: str | None = None, entities: str | None = None) -> DataFrame:
    """(id, the 18 features) of each document. `losses`: (id, loss, n) of a language model's tokens, from the corpus's bigrams by default. `tags` and
    `entities`: columns with what a tagger found."""
    losses = models.bigram_losses(docs, id, column) if losses is None else losses
    model = models.perplexity(losses, id).select(id, F.col("perplexity").alias("mean_perplexity"), F.col("loss_variance").alias("perplexity_variance"), F.col("mean_token_loss").alias("entropy"))
    own = docs.select(id, of_text(F.col(column), F.col(tags) if tags else None, F.col(entities) if entities else None).alias("f")).select(id, "f.*")
    return own.join(model, id, "left").select(id, *(F.coalesce(c, F.lit(WITHOUT_MODEL[c])).alias(c) if c in WITHOUT_MODEL else F.col(c) for c in FEATURES))


def as_map(df: DataFrame, id: str) -> DataFrame:
    """(id, features): the features as a map by name."""
    return df.select(id, F.create_map(*(x for c in FEATURES for x in (F.lit(c), F.col(c)))).alias("features"))
