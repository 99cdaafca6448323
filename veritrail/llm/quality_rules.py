"""Quality rules: a threshold table compiled into one Spark projection.

All metrics of a text are built-in expressions; a text's arrays (words, lines, windows) are bound once and used many times.
No user function runs, nothing is shuffled: each row is judged on its own.

Defined results: a null text counts as the empty text (no words, so it fails the base rules); repeated rows are judged one by one;
an empty table gives an empty table; columns of the input stay, and the result is one struct column whose name the caller chooses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks between words.
BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as are this be was at by from or an a not have "
    "der die das und ist von zu den mit ein eine des dem sich auf im nicht auch als für "
    "le la les de des et un une du en que qui est pour dans par sur au pas plus "
    "el los las del y una es por con para se no lo su al como más"
).split()


@dataclass(frozen=True)
class Rule:
    """`metric` must lie between `least` and `most`, both included; None is no bound."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Rules that any text has to meet.
BASE = (Rule("n_words", least=20), Rule("repeat_percent", most=30))
#: The method's own rules. Ratios are to the number of words or lines; one stop word is given to each text, so that short ones need none. An echo
#: is a word that equals the one before it.
RULES = (
    Rule("mean_word_length", least=2, most=12),
    Rule("symbol_ratio", most=0.1),
    Rule("shout_ratio", most=0.5),
    Rule("stop_word_ratio", least=0.01),
    Rule("echo_ratio", most=0.3),
    Rule("dup_line_ratio", most=0.5),
    Rule("mark_line_ratio", most=0.9),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more; `hashes` has one number a word."""
    windows = F.when(
        F.size(hashes) > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = F.filter(s, lambda x, k: ((k > 0) & (s[k - 1]["h"] == x["h"])) | ((k + 1 < F.size(s)) & (s[k + 1]["h"] == x["h"])))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def length(p: Column) -> Column:
            reach = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), p[k + 1] - x)).otherwise(F.lit(WINDOW)))
            return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(placed, again), length)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def metrics(text: Column, words: Column, lines: Column) -> Column:
    """All figures of one text, as a struct."""
    n = F.size(words).cast("bigint")
    taken_out = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")
    word_chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint")
    plain = F.split(F.lower(F.translate(text, ".,;:!?", "")), f"[{BLANK}]+")
    stop = F.size(F.filter(plain, lambda w: w.isin(*STOP_WORDS)))
    echoes = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
    dup_lines = (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")
    marked = F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]|(\.\.\.|…)[\x20\x09-\x0D]*$")))
    figures = F.struct(
        n.alias("n_words"), word_chars.alias("word_chars"), taken_out(SYMBOLS).alias("n_symbols"), dup_lines.alias("n_dup_lines"),
        let(F.transform(words, lambda w: F.xxhash64(w)), _repeat_words).alias("n_repeat_words"),
        taken_out("!").alias("n_shouts"), (stop + 1).alias("n_stop_words"), echoes.alias("n_echoes"), F.size(lines).alias("n_lines"), marked.alias("n_mark_lines"),
    )

    def ratios(m: Column) -> Column:
        part = lambda a, b: F.when(m[b] > 0, m[a].cast("double") / m[b]).otherwise(F.lit(0.0))
        return F.struct(
            *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            part("word_chars", "n_words").alias("mean_word_length"), part("n_symbols", "n_words").alias("symbol_ratio"), part("n_shouts", "n_words").alias("shout_ratio"),
            part("n_stop_words", "n_words").alias("stop_word_ratio"), part("n_echoes", "n_words").alias("echo_ratio"), part("n_dup_lines", "n_lines").alias("dup_line_ratio"), part("n_mark_lines", "n_lines").alias("mark_line_ratio"),
        )

    return let(figures, ratios)


def _met(figures: Column, rules: tuple[Rule, ...]) -> Column:
    met = F.lit(True)
    for r in rules:
        x = figures["n_repeat_words"] * 100 if r.metric == "repeat_percent" else figures[r.metric]
        per = figures["n_words"] if r.metric == "repeat_percent" else F.lit(1)
        if r.least is not None:
            met = met & (x >= per * F.lit(r.least))
        if r.most is not None:
            met = met & (x <= per * F.lit(r.most))
    return met


def judge(df: DataFrame, text: str = "text", into: str = "quality_rules", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`df` with one more struct column `into`: the figures of each text, base_failed and kept."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def verdict(m: Column) -> Column:
        failed = ~_met(m["figures"], base)
        return F.struct(m["figures"].alias("figures"), failed.alias("base_failed"), (~failed & _met(m["figures"], rules)).alias("kept"))

    has_word = rf"[^{BLANK}]"
    figures = let(
        F.struct(
            whole.alias("text"),
            F.filter(F.split(whole, f"[{BLANK}]+"), lambda w: w != "").alias("words"),
            F.filter(F.split(whole, "\n"), lambda x: x.rlike(has_word)).alias("lines"),
        ),
        lambda d: F.struct(metrics(d["text"], d["words"], d["lines"]).alias("figures")),
    )
    return df.withColumn(into, let(figures, verdict))
