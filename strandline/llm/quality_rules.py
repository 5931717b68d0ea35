"""Heuristic quality rules: a threshold table compiled into Spark columns.

``RULES`` is data: each row names a ratio, a bound and a side.  ``measures``
builds the ratios from built-in functions only, and ``verdict`` folds the table
into one boolean expression, so that a document is judged in the scan's own
stage: no user function, no shuffle, no second pass.

Defined results: a null text has no word; an empty text has one line without a
word; duplicate rows are judged separately and alike; extra columns pass through
``apply`` untouched and cannot clash, since ``apply`` returns only its own
columns beside the ones asked for; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE_CLASS

#: Frequent function words of four languages, in natural order.
STOP_WORDS = {
    "en": "the of and to in that is was for it with as on be at by this are from or an not",
    "fr": "le la les de des et en un une du que qui est dans pour pas sur au par",
    "es": "el la los las de del que y en un una se con por para su es al como",
    "de": "der die das und in zu den mit von auf ist im dem nicht ein eine als auch",
}

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``ratio`` must be at least ``low`` and at most ``high`` (None: no bound)."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("word length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols to words", "symbol_ratio", None, 0.10),
    Rule("stop words to words", "stop_word_ratio", 0.01, None),
    Rule("repeated lines to lines", "dup_line_ratio", None, 0.50),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


#: Low bits of a window's long that hold its place.
_PLACE_BITS = 24


def _windows(words: Column) -> Column:
    """A sorted long per 3-word window: 40 bits of its hash, then its place."""
    n = F.size(words)
    return F.when(
        (n >= 3) & (n < 1 << _PLACE_BITS),
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.shiftleft(
                    F.shiftright(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE_BITS),
                    _PLACE_BITS,
                ).bitwiseOR(i.cast("long")),
            )
        ),
    )


def _same_words(words: Column, i: Column, j: Column) -> Column:
    return (
        (F.get(words, i) == F.get(words, j))
        & (F.get(words, i + 1) == F.get(words, j + 1))
        & (F.get(words, i + 2) == F.get(words, j + 2))
    )


def _links(words: Column, windows: Column) -> Column:
    """For each window but the first: 0 if its hash is new, 1 if it repeats the window before, 2 if only its hash does."""
    mask = F.lit((1 << _PLACE_BITS) - 1)
    place = lambda j: F.get(windows, j).bitwiseAND(mask).cast("int")
    hash_of = lambda j: F.shiftright(F.get(windows, j), _PLACE_BITS)
    return F.when(
        F.size(windows) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(windows) - 1),
            lambda j: F.when(hash_of(j) != hash_of(j - 1), 0).when(_same_words(words, place(j), place(j - 1)), 1).otherwise(2),
        ),
    )


def _repeated_places(words: Column, windows: Column, links: Column) -> Column:
    """Places of repeated windows in order.

    Equal windows are neighbours in hash order.  Where two different windows
    share a hash (or the text has too many words for the packing) the windows
    themselves are sorted instead, so the answer never rests on a hash.
    """
    mask = F.lit((1 << _PLACE_BITS) - 1)
    fast = F.transform(
        F.filter(
            F.sequence(F.lit(0), F.size(windows) - 1),
            lambda j: (F.coalesce(F.get(links, j - 1), F.lit(0)) == 1) | (F.coalesce(F.get(links, j), F.lit(0)) == 1),
        ),
        lambda j: F.coalesce(F.get(windows, j).bitwiseAND(mask).cast("int"), F.lit(0)),
    )
    n = F.size(words)
    texts = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
            ),
        )
    )
    at = lambda j: F.get(texts, j)
    slow = F.transform(
        F.filter(
            F.sequence(F.lit(0), n - 3),
            lambda j: F.coalesce(at(j)["w"] == at(j - 1)["w"], F.lit(False))
            | F.coalesce(at(j)["w"] == at(j + 1)["w"], F.lit(False)),
        ),
        lambda j: F.coalesce(at(j)["i"], F.lit(0)),
    )
    return F.when(
        (n >= 1 << _PLACE_BITS) | F.coalesce(F.array_contains(links, 2), F.lit(False)), F.sort_array(slow)
    ).when(F.array_contains(links, 1), F.sort_array(fast))


def _covered(places: Column) -> Column:
    """Words under the windows that start at ``places``: each covers three at most, up to the next."""
    k = F.size(places)
    total = F.aggregate(
        F.sequence(F.lit(0), k - 1),
        F.lit(0),
        lambda a, j: a + F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - F.get(places, j), F.lit(3))),
    )
    return F.coalesce(F.when(k > 0, total), F.lit(0)).cast("long")


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and every count that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*(F.col(c) for c in keep), t.alias("_t"), words_of(F.col(text)).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select("*", lines.alias("_lines"), _windows(F.col("_w")).alias("_win"))
    base = base.select("*", _links(F.col("_w"), F.col("_win")).alias("_link"))
    base = base.select("*", _repeated_places(F.col("_w"), F.col("_win"), F.col("_link")).alias("_at"))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    n_stop = F.size(F.filter(F.col("_w"), lambda x: x.isin(stops)))
    return base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_at")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        n_stop.cast("long").alias("n_stop_words"),
    )


def ratios() -> dict[str, Column]:
    """The ratios by name; null where the text has no word."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression; true if a document breaks no rule."""
    have = ratios()
    ok = F.lit(True)
    for r in rules:
        value = have[r.ratio]
        if r.low is not None:
            ok &= F.coalesce(value >= r.low, F.lit(False))
        if r.high is not None:
            ok &= F.coalesce(value <= r.high, F.lit(False))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``keep``, the counts, ``base_failed`` and ``kept`` for every row of ``df``."""
    out = measures(df, text, keep).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that keep their place, with all their columns."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    # the row number keeps the optimizer from pushing the filter below the counts, which would copy them into it
    judged = apply(packed, "_text", ("_row",), rules).withColumn("_n", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_n") >= 0)).select("_row.*")
