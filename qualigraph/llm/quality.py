"""Quality rules: a threshold table compiled into one Spark projection.

The table below is data; `verdict` turns it into a single boolean expression over
measures that are themselves built-in expressions. No user function runs.

Defined results: a null or empty text has no words, so every count is 0, `base_failed`
is true (fewer than ten words) and the row is not kept. Repeated rows are measured row by
row. Extra columns pass through `apply_rules` untouched; measures live in one struct
column, so a column of the input with the name of a measure can't clash with it. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualigraph.llm.common import SPACES, bind, text_or_empty

WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The method's own ratio also counts shouting.
NOISE_SYMBOLS = SYMBOLS + "!"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with as at by this an from or are be not have had "
    "der die und das den von zu mit im ein eine für auf ist des dem nicht sich auch "
    "le la les de un une et est que qui en du dans pour sur pas par avec au ce "
    "el los las y una por no se con para su al lo como del"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject when `measure` is below `low` or above `high`, for texts of `min_words` words or more."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table. Ratios are of words unless the name says lines.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.30),
    Rule("stop_word_ratio", 0.02, None, 50),
    Rule("duplicate_line_ratio", None, 0.50, 50),
    Rule("repeat_word_ratio", None, 0.20),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside any `width`-word window that occurs twice or more; first occurrence included.

    Where all windows have different hashes none occurs twice, and most texts are done. In the
    others windows are sorted with their starts, so a window is repeated when a neighbour in the
    order is equal; the starts are sorted again and each covers the words up to the next.
    O(n log n) for a text of n words, whatever the number of repeats.
    """
    starts = F.sequence(F.lit(1), F.size(words) - F.lit(width - 1))
    windows = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, width)).alias("k"), i.alias("i")))
    )

    def twice(s: Column) -> Column:
        n = F.size(s)
        return F.filter(
            s,
            lambda x, p: ((p > 0) & (F.get(s, p - 1)["k"] == x["k"])) | ((p < n - 1) & (F.get(s, p + 1)["k"] == x["k"])),
        )

    def covered(d: Column) -> Column:
        gaps = F.transform(d, lambda x, p: F.least(F.lit(width), F.coalesce(F.get(d, p + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = bind(windows, lambda s: bind(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(width)]))
    different = bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    nothing = F.lit(0).cast("long")
    return F.when(F.size(words) <= width, nothing).when(different, nothing).otherwise(found)


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """One struct with the counts of a text."""
    blank = _without(text, SPACES)
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    bare = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", "")), WORD_SPLIT)
    stops = F.size(F.filter(bare, lambda w: w.isin(*dict.fromkeys(stop_words))))

    def all_of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(blank).cast("long").alias("word_chars"),
            (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.length(text) - F.length(_without(text, NOISE_SYMBOLS))).cast("long").alias("n_noise"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            stops.cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return bind(words, all_of)


def ratio(m: Column, name: str) -> Column:
    of_words = {
        "mean_word_length": m["word_chars"],
        "symbol_ratio": m["n_noise"],
        "stop_word_ratio": m["n_stop_words"],
        "repeat_word_ratio": m["n_repeat_words"],
    }
    if name == "duplicate_line_ratio":
        return m["lines"]["dup"] / F.nullif(m["lines"]["n"], F.lit(0))
    return of_words[name] / F.nullif(m["n_words"], F.lit(0))


def verdict(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one expression: true when no rule rejects."""
    kept = F.lit(True)
    for rule in rules:
        value = ratio(m, rule.measure)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        kept = kept & ~F.coalesce(bad & (m["n_words"] >= rule.min_words), F.lit(False))
    return kept


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def apply_rules(df: DataFrame, text: str = "text", out: str = "_quality", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add a struct column `out` with the measures, `base_failed` and `kept`.

    One projection: the measures are bound once per row by a lambda variable, so the
    optimizer can't duplicate them.
    """
    judged = bind(
        measures(text_or_empty(text)),
        lambda m: F.struct(
            m.alias("measures"),
            base_failed(m).alias("base_failed"),
            (~base_failed(m) & verdict(m, rules)).alias("kept"),
        ),
    )
    return df.withColumn(out, judged)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    out = "_quality"
    while out in df.columns:
        out += "_"
    return apply_rules(df, text, out).where(F.col(f"{out}.kept")).drop(out)
