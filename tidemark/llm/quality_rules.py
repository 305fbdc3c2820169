"""Quality rules: a threshold table compiled into one projection, without user functions.

A rule bounds one ratio of a text; the table of rules becomes a single Boolean column, so the whole operator is a
scan and a projection: no shuffle, no Python, and the cost of a text is n log n in its words.

Edge cases: a null text counts as empty and an empty text has no words, so it is never kept; NaN or null
ratios cannot arise (denominators are at least 1); rows are judged one by one, so repeated rows get equal verdicts;
an empty table gives an empty result; columns of the input are all kept, whatever their names, and if one has the name of a
result column it is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words, as a regular expression class and as plain text.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is was for on that with as it be are this by from at or an "
    "der die das und ist von zu mit den im auf für sich nicht ein eine dem des er es "
    "le la les de des et est un une que qui dans pour en du il elle sur pas plus "
    "el los las y del se por con para una su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``metric`` lies in low..high, bounds included; None is no bound."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Metrics are named in :func:`ratios`.
RULES = (
    Rule("enough words", "n_words", low=50),
    Rule("word length", "mean_word_chars", low=2.0, high=18.0),
    Rule("symbols", "symbol_ratio", high=0.06),
    Rule("stop words", "stop_word_ratio", low=0.01),
    Rule("copied lines", "dup_line_ratio", high=0.5),
    Rule("line length", "words_per_line", low=1.5),
    Rule("repeated windows", "repeat_word_ratio", high=0.5),
)


def _counts(text: Column, own: str) -> dict[str, Column]:
    solid = F.btrim(text, F.lit(SPACE_CHARS))
    return {
        f"{own}words": F.when(F.length(solid) == 0, F.array().cast("array<string>")).otherwise(F.split(solid, SPACE + "+")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        f"{own}lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0),
    }


def word_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with word_chars, n_symbols, n_words, n_lines, n_dup_lines, n_repeat_words and n_stop_words (long)."""
    named = ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    kept = [c for c in df.columns if c.lower() not in named]
    # Names of steps that no column of the input begins with.
    own = "_"
    while any(c.lower().startswith(own) for c in kept):
        own += "_"
    words, lines, windows, ordered = (f"{own}{x}" for x in ("words", "lines", "windows", "sorted"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Each step names arrays that the next reads more than once, so that none is worked out again.
    step = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(k) for k, c in _counts(text, own).items()])
    # The hash of a window stands for its three words: within one text, 64 bits do not collide in practice.
    step = step.withColumn(
        windows,
        F.when(
            F.size(words) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    step = step.withColumn(
        ordered,
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    twice = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(ordered, k + 1)["h"].eqNullSafe(x["h"])))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    counts = {
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.col("n_symbols"),
        "n_words": F.size(words),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
    }
    # A generator of one row: filters on its columns stay above it, so they never work the arrays out anew.
    return step.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))))


def ratios() -> dict[str, Column]:
    """The metrics that rules may bound, over the columns of :func:`word_statistics`."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "words_per_line": F.col("n_words") / lines,
        "repeat_word_ratio": F.col("n_repeat_words") / words,
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of rules as one Boolean column: true if a text passes all of them."""
    metrics, verdict = ratios(), F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (metrics[rule.metric] >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (metrics[rule.metric] <= F.lit(float(rule.high)))
    return verdict


def apply_quality_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with its statistics, base_failed and kept."""
    stats = word_statistics(df.drop(*[c for c in df.columns if c.lower() in ("base_failed", "kept")]), text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "kept": ~failed & compile_rules(rules)})
