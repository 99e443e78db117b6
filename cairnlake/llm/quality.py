"""Quality rules: a table of thresholds compiled into one projection.

Every rule is a row of RULES: a ratio or count, its least and its greatest allowed value.
`quality_columns` turns the table into Column expressions of the text alone, so that the
whole verdict is one projection without shuffle, join or user function. The stop-word ratio
counts words as they stand in any case and between marks; it is asked of texts of SHORT words
or more.

Cases: a null or empty text has no words and fails; repeated rows are judged alike; other
columns are ignored or passed through, and ones named like an output are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, without, words_of

#: Frequent function words of the languages that the corpus may hold.
STOP_WORDS = """
the be to of and that have with in is it for was on are as by this from at or an a
le la les de des du et en un une que qui pour dans est pas avec au sur
der die das und in den von zu mit ist nicht ein eine sich auf für es im dem
el los las y que en un una por con para es se lo su al como del
""".split()

WINDOW = 5
#: Texts of fewer words may well hold no stop word; the rule passes them.
SHORT = 50
MARKS = ".,;:!?\"'()[]«»¿¡…"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= measure <= most; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules come first; a document that fails one of them is never kept.
BASE_RULES = (Rule("n_words", least=10), Rule("repeat_word_percent", most=20))
RULES = (
    Rule("n_words", most=1_000_000),
    Rule("mean_word_length", least=2, most=15),
    Rule("symbol_word_ratio", most=0.1),
    Rule("shout_word_ratio", most=0.3),
    Rule("dup_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("stop_word_ratio", least=0.05),
)


def _windows(words: Column) -> Column:
    """A hash of every window of five words, by doubling: pairs, fours, then one more word."""
    n = F.size(words)

    def five(pairs: Column) -> Column:
        fours = F.zip_with(pairs, F.slice(pairs, 3, n), lambda a, b: F.xxhash64(a, b))
        fives = F.zip_with(fours, F.slice(words, 5, n), lambda a, b: F.xxhash64(a, b))
        return F.slice(fives, 1, n - (WINDOW - 1))

    none = F.array().cast("array<bigint>")
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n < WINDOW, none).otherwise(let(pairs, five))


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur at least twice."""

    def positions(s: Column) -> Column:
        again = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    def slow(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(placed, positions), total)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(slow(w)))


def quality_columns(text: Column) -> Column:
    """A struct of the counts and measures of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measured(words: Column) -> Column:
        return let(
            lines,
            lambda own: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
                _covered(_windows(words)).cast("long").alias("n_repeat_words"),
                F.size(own).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda w: F.btrim(F.lower(w), F.lit(MARKS)).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
                F.size(F.filter(own, lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(own, lambda x: let(F.rtrim(x, F.lit(" \t\x0b\f\r")), lambda y: y.endswith("...") | y.endswith("…")))).cast("long").alias("n_ellipsis_lines"),
                F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}[\p{Lu}\p{P}]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_shout_words"),
            ),
        )

    return let(words_of(text), measured)


def _measures(q: Column) -> dict[str, Column]:
    words, lines = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["n_lines"], F.lit(1))
    return {
        "n_words": q["n_words"],
        "repeat_word_percent": 100 * q["n_repeat_words"] / words,
        "mean_word_length": q["word_chars"] / words,
        "symbol_word_ratio": q["n_symbols"] / words,
        "shout_word_ratio": q["n_shout_words"] / words,
        "dup_line_ratio": q["n_dup_lines"] / lines,
        "bullet_line_ratio": q["n_bullet_lines"] / lines,
        "ellipsis_line_ratio": q["n_ellipsis_lines"] / lines,
        "stop_word_ratio": F.when(q["n_words"] < SHORT, F.lit(1.0)).otherwise(q["n_stop_words"] / words),
    }


def failures(q: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the measures of the rules that are broken."""
    of = _measures(q)
    broken = []
    for r in rules:
        for bound, bad in ((r.least, lambda m, b: m < b), (r.most, lambda m, b: m > b)):
            if bound is not None:
                broken.append(F.when(bad(of[r.measure], F.lit(bound)), F.lit(r.measure)))
    return F.array_distinct(F.array_compact(F.array(*broken)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs with the counts, base_failed, kept, and the failed measures of each document."""
    def verdict(q: Column) -> Column:
        base, more = failures(q, base_rules), failures(q, rules)
        return F.struct(
            *[q[c].alias(c) for c in COUNTS],
            (F.size(base) > 0).alias("base_failed"),
            ((F.size(base) == 0) & (F.size(more) == 0)).alias("kept"),
            F.array_distinct(F.concat(base, more)).alias("failed"),
        )

    # One column holds all, so that a filter on any of it measures a text once more at most.
    outputs = (*COUNTS, "base_failed", "kept", "failed")
    measured = without(docs, *outputs, "__q").withColumn("__q", let(quality_columns(F.col("text")), verdict))
    return measured.select(*[f"`{c}`" for c in measured.columns if c != "__q"], *[F.col("__q")[c].alias(c) for c in outputs])


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, with the columns that they came with."""
    q = quality_columns(F.col("text"))
    verdict = let(q, lambda x: (F.size(failures(x, BASE_RULES)) == 0) & (F.size(failures(x, RULES)) == 0))
    return docs.where(verdict)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", F.concat_ws(",", "failed").alias("failed"))
