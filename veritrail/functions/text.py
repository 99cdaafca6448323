"""Text cleaning and text features as expressions of built-in functions.

A word is a run of letters, digits and underscores. Phrases count where they stand as written, case apart, and neither begin nor end inside a
word. Null texts count as empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions import fixed

WORD = r"[\p{L}\p{N}_]+"
#: What lies between words.
BETWEEN = r"[^\p{L}\p{N}_]+"
SENTENCE_END = "[.!?]+"
_SPACE = r"[ \t\f\r\x0B ]"
_ANY_SPACE = r"[\s ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_ANY_SPACE}+", ""), f"{_ANY_SPACE}+$", "")


def clean_whitespace(text: Column) -> Column:
    """Tabs to blanks, runs of blanks to one, three or more line ends to two, then every line and the whole without blanks at the ends, in one pass."""
    once = F.regexp_replace(F.regexp_replace(F.translate(text, "\t", " "), " {2,}", " "), "\n{3,}", "\n\n")
    lines = F.transform(F.split(once, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{_SPACE}+", ""), f"{_SPACE}+$", ""))
    return stripped(F.array_join(lines, "\n"))


def without_leakage(text: Column) -> Column:
    """Without a model's opening words; each pattern once, in order."""
    for pattern in fixed.LEAKAGE:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    return stripped(text)


def has_tags(text: Column) -> Column:
    return text.rlike("<[^>]+>")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


class _Data(HTMLParser):
    """Text between tags, with entities decoded; comments and declarations are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _text_of(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Data()
    parser.feed(html)
    parser.close()  # so that a text that ends inside a tag or an entity loses nothing
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def strip_html(html: pd.Series) -> pd.Series:
    """Text of HTML by a parser: what tags and entities mean is not a regular language."""
    return html.map(_text_of)


@F.pandas_udf(T.StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """NFKD, without zero-width characters; Spark has no function for it."""
    gone = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).translate(gone))


def clean_essay(text: Column) -> Column:
    """The cleaning steps in their order."""
    return without_leakage(clean_whitespace(normalize_unicode(strip_html(text))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def blank_split(text: Column) -> Column:
    """Pieces between blanks."""
    return F.filter(F.split(text, f"{_ANY_SPACE}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that aren't blank."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(r"[^\s ]"))


def long_sentences(text: Column, least: int = 3) -> Column:
    """Pieces after a sentence end with a blank, or between lines, that have `least` words."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.size(blank_split(s)) >= least)


def word_count(text: Column) -> Column:
    return F.size(blank_split(text))


def in_list(tokens: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*known)))


def overlap(p: str, q: str) -> bool:
    """Whether two phrases can share words in a text."""
    a, b = p.split(), q.split()
    return any(x[k : k + len(y)] == y[: len(x) - k] for x, y in ((a, b), (b, a)) for k in range(len(x)))


def phrase_groups(phrases: tuple[str, ...]) -> list[list[str]]:
    """The phrases in as few lists as it takes for no two of one list to overlap."""
    groups: list[list[str]] = []
    for p in phrases:
        fits = next((g for g in groups if not any(overlap(p, q) for q in g)), None)
        if fits is None:
            groups.append([p])
        else:
            fits.append(p)
    return groups


def phrase_hits(lowered: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of all phrases, as they are written, between ends of words; one expression a group of phrases that can't overlap."""
    quoted = lambda p: re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", p)
    whole = [rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(map(quoted, g))})(?![\p{{L}}\p{{N}}_])" for g in phrase_groups(phrases)]
    return sum((F.regexp_count(lowered, F.lit(w)) for w in whole[1:]), F.regexp_count(lowered, F.lit(whole[0])))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def fingerprint(text: Column) -> Column:
    """Struct of word length, sentence length, type-token ratio and punctuation density; zeros for texts below 10 characters."""
    whole = F.coalesce(text, F.lit(""))

    def figures(d: Column) -> Column:
        bare = F.transform(d["w"], lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))

        def of(b: Column) -> Column:
            kept = F.filter(F.transform(b, lambda w: F.lower(w)), lambda w: w != "")
            n = F.size(d["w"])
            return F.struct(
                _ratio(F.aggregate(b, F.lit(0), lambda a, w: a + F.length(w)), n).alias("word_length"), (n / F.greatest(F.lit(1), F.size(sentences(d["t"])))).cast("double").alias("sentence_length"),
                _ratio(F.size(F.array_distinct(kept)), F.size(kept)).alias("ttr"), _ratio(F.regexp_count(d["t"], F.lit(r"\p{Punct}")), F.length(d["t"])).alias("punctuation_density"),
            )

        return let(bare, of)

    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("word_length", "sentence_length", "ttr", "punctuation_density")))
    return F.when(F.length(stripped(whole)) < 10, zero).otherwise(let(F.struct(whole.alias("t"), blank_split(whole).alias("w")), figures))


def _bound(text: Column, use: Callable[[Column], Column]) -> Column:
    """`use` over a struct of the text t, the text in lower case, its words in lower case and n, their number, at least 1."""
    first = let(F.coalesce(text, F.lit("")), lambda t: F.struct(t.alias("t"), F.lower(t).alias("lower")))
    tokens = let(first, lambda d: F.struct(d["t"].alias("t"), d["lower"].alias("lower"), words(d["lower"]).alias("tokens")))
    return let(let(tokens, lambda d: F.struct(d["t"].alias("t"), d["lower"].alias("lower"), d["tokens"].alias("tokens"), F.greatest(F.lit(1), F.size(d["tokens"])).alias("n"))), use)


def tag_shares(tags: Column | None, entities: Column | None) -> dict[str, Column]:
    """Shares of a tagger's tags, one a token, and of named entities; 0 without a tagger or without tags."""
    n = F.greatest(F.size(tags), F.lit(1)) if tags is not None else F.lit(1)
    share = lambda *names: F.coalesce(in_list(tags, names) / n, F.lit(0.0)) if tags is not None else F.lit(0.0)
    density = F.coalesce(entities / n, F.lit(0.0)) if entities is not None else F.lit(0.0)
    return {"noun_ratio": share("NOUN", "PROPN"), "verb_ratio": share("VERB"), "adjective_ratio": share("ADJ"), "named_entity_density": density}


def stylometrics(text: Column, tags: Column | None = None, entities: Column | None = None) -> Column:
    """Struct of the eleven stylometric features, rounded to 4. `tags`, an array of a tagger's tags by token, and `entities`, how many names it found,
    give four of them; these are 0 without."""

    def of(d: Column) -> Column:
        lengths = F.filter(F.transform(F.split(d["t"], SENTENCE_END), lambda s: F.size(words(s))), lambda n: n > 0)
        paragraphs = F.filter(F.split(d["t"], "\n\n"), lambda p: p.rlike(r"[^\s ]"))
        of_paragraph = F.transform(F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(d["t"])), lambda p: F.size(words(p)))
        total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
        squares = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y * y)

        def with_lengths(s: Column) -> Column:
            k = F.size(s["l"])
            spread = F.when(k > 1, F.sqrt((squares(s["l"]) - total(s["l"]) * total(s["l"]) / k) / (k - 1))).otherwise(F.lit(0.0))
            # a match begins where a word does, and a run is never given back: no letter is looked at twice
            found = F.regexp_extract_all(d["lower"], F.lit(rf"(?<!{WORD[:-1]}){WORD}+(?:'+{WORD}+)+"), F.lit(0))
            contracted = F.when(F.contains(d["lower"], F.lit("'")), found).otherwise(F.array().cast("array<string>"))
            out = {
                "avg_sentence_length": _ratio(total(s["l"]), k), "sentence_length_std": spread, "type_token_ratio": F.size(F.array_distinct(d["tokens"])) / d["n"],
                "stop_word_ratio": in_list(d["tokens"], fixed.STOP_WORDS) / d["n"], "punctuation_frequency": _ratio(F.regexp_count(d["t"], F.lit(r"\p{Punct}")), F.length(d["t"])),
                "contraction_ratio": in_list(contracted, fixed.CONTRACTIONS) / d["n"], **tag_shares(tags, entities), "avg_paragraph_length": _ratio(total(s["p"]), F.size(s["p"])),
            }
            return F.struct(*(F.round(c.cast("double"), 4).alias(name) for name, c in out.items()))

        return let(F.struct(lengths.alias("l"), of_paragraph.alias("p")), with_lengths)

    return _bound(text, of)


def flesch(text: Column) -> Column:
    """Reading ease from words, sentences and syllables: runs of vowels, one less for a final e, at least one a word."""

    def of(d: Column) -> Column:
        syllables = F.transform(d["tokens"], lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiou]+")) - F.when(w.endswith("e"), 1).otherwise(0)))
        total = F.aggregate(syllables, F.lit(0), lambda a, x: a + x)
        per_sentence = d["n"] / F.greatest(F.lit(1), F.size(sentences(d["t"])))
        return F.round(F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * (total / d["n"]), 4)

    return _bound(text, of)


def phrase_features(text: Column) -> Column:
    """Struct of generic phrasing, lack of personal voice, over-structured coherence and repetitiveness, not rounded."""

    def of(d: Column) -> Column:
        count = lambda phrases: phrase_hits(d["lower"], phrases)
        return F.struct(
            F.least(F.lit(1.0), count(fixed.GENERIC_PHRASES) * 10 / d["n"]).alias("generic"), F.greatest(F.lit(0.0), 1 - count(fixed.PERSONAL_VOICE) * 5 / d["n"]).alias("impersonal"),
            F.least(F.lit(1.0), count(fixed.TRANSITIONS) * 15 / d["n"]).alias("structured"), F.greatest(F.lit(0.0), 1 - F.size(F.array_distinct(d["tokens"])) / d["n"]).alias("repetitiveness"),
        )

    return _bound(text, of)


def semantic_layer(text: Column) -> Column:
    """Struct of the semantic scores, their agreement and risk; fixed middle values for texts below 50 characters."""

    def of(p: Column) -> Column:
        g, v, c = p["generic"], p["impersonal"], p["structured"]
        spread = F.greatest(g, v, c) - F.least(g, v, c)
        likelihood = g * 0.3 + v * 0.3 + c * 0.4
        aligned = F.when(spread < 0.3, "high").when(spread < 0.6, "medium").otherwise("low")
        reason = F.concat(F.lit("Semantic alignment is "), aligned, F.lit("."), F.when(v > 0.7, " Lacks personal voice.").otherwise(""), F.when(c > 0.7, " Highly structured transitions detected.").otherwise(""))
        scores = {
            "generic_phrasing": g, "lack_of_personal_voice": v, "over_structured_coherence": c, "repetitiveness": p["repetitiveness"], "semantic_predictability": (g + c) / 2,
            "conceptual_shallowness": g, "final_ai_likelihood": likelihood * 100, "confidence": F.greatest(F.lit(0.1), 1 - spread),
        }
        risk = F.when(likelihood > 0.7, "high").when(likelihood > 0.4, "moderate").otherwise("low")
        return F.struct(*(F.round(x, 2).alias(name) for name, x in scores.items()), aligned.alias("signal_alignment"), risk.alias("risk_level"), reason.alias("reasoning"))

    middle = dict.fromkeys(("generic_phrasing", "lack_of_personal_voice", "over_structured_coherence", "repetitiveness", "semantic_predictability", "conceptual_shallowness"), 0.5)
    middle |= {"final_ai_likelihood": 50.0, "confidence": 0.1}
    fallback = F.struct(
        *(F.lit(x).alias(name) for name, x in middle.items()), F.lit("low").alias("signal_alignment"), F.lit("moderate").alias("risk_level"),
        F.lit("Fallback used due to insufficient text or processing failure.").alias("reasoning"),
    )
    short = (F.length(stripped(F.coalesce(text, F.lit("")))) < 50) | (F.size(words(F.coalesce(text, F.lit("")))) == 0)
    return F.when(short, fallback).otherwise(let(phrase_features(text), of))


def hex_code(text: Column) -> Column:
    """The last eight characters of the last token with six letters or digits, upper case, with letters that look like digits as digits."""
    bare = F.regexp_replace(text, r"\\[A-Za-z]+|[{}$]", " ")
    tokens = F.filter(F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "")), lambda w: F.length(w) >= 6)
    last = F.when(F.size(tokens) > 0, F.element_at(tokens, -1)).otherwise(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    return F.right(F.translate(F.upper(last), "OIL", "011"), F.lit(8))


def numeric_code(text: Column) -> Column:
    """Digits only, after letters that look like digits were read as such."""
    return F.regexp_replace(F.translate(F.upper(text), "OILSBG", "011586"), "[^0-9]", "")


def without_list_number(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*\d+[.)]\s*", "")


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length, of both in lower case without outer blanks; two empty ones are equal."""
    x, y = (F.lower(stripped(F.coalesce(c, F.lit("")))) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)
