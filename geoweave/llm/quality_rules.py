"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Each document gets the base counts (words, symbols, repeated lines, repeated 8-word windows). Then
its normalised lines are hashed, the distinct documents of a host that hold a line are counted, lines
in more than a few of them are removed, however large the host is, and a document that keeps too little of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import ROW_ID, any_names, with_row_id

#: Fixed values of the word and symbol definitions.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is boilerplate in more documents of its host; a document is depleted below the share kept.
LINE_DOCS, MIN_KEPT = 5, 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of `window` words that occur at least twice in the array."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n < window + 1, F.lit(0)).otherwise(_covered(hashed, window))


def _covered(hashed: Column, window: int) -> Column:
    """Zero in the usual case of no repeat; else sort windows with positions and add up what repeats cover."""
    return F.aggregate(F.array(hashed), F.lit(0), lambda _, h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_cover_repeats(h, window)))


def _cover_repeats(h: Column, window: int) -> Column:
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(
        F.transform(
            s,
            lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    starts = F.array_sort(F.flatten(F.transform(F.array(placed), twice)))
    return F.aggregate(
        starts,
        F.struct(F.lit(-window - 1).alias("last"), F.lit(0).alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with a column __gw_words of words) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACE) > 0)
    out = docs.withColumn("__gw_words", words_of(t)).withColumn("__gw_lines", lines)
    out = out.withColumns(
        {
            "n_words": F.size("__gw_words").cast("long"),
            "word_chars": _without(t, SPACE).cast("long"),
            "n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__gw_lines") - F.size(F.array_distinct("__gw_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__gw_words")).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__gw_words", "__gw_lines")


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """One row per document, with lines: array of (h: hash of the normalised line, c: its non-space characters)."""
    norm = lambda x: F.regexp_replace(F.trim(F.lower(x)), r"[\x20\x09-\x0D]+", " ")
    lines = F.filter(
        F.transform(
            F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
            lambda x: F.struct(F.xxhash64(norm(x)).alias("h"), _without(x, SPACE).alias("c")),
        ),
        lambda x: x["c"] > 0,
    )
    return docs.select(ROW_ID, F.coalesce(F.col(host), F.lit("")).alias("host"), lines.alias("lines"))


def frequent_lines(lines: DataFrame, min_docs: int = LINE_DOCS) -> DataFrame:
    """(host, h, n_docs) of lines that more than min_docs documents of the host hold."""
    each = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return each.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)


@any_names(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars"), "text", "host")
def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = LINE_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """Every row of docs with the base counts, removed_chars, base_failed and kept.

    A line counts once per document. Null texts count as empty (and fail the base rules), a null
    host is a host of its own, texts of any length are read whole, repeated rows count as documents of their own, columns of docs with
    the names of result columns are replaced, and an empty table gives an empty result.
    """
    rows = with_row_id(docs)
    lines = line_table(rows, text, host)
    frequent = frequent_lines(lines, min_docs)
    removed = (
        lines.select(ROW_ID, "host", F.explode("lines").alias("l"))
        .select(ROW_ID, "host", F.col("l.h").alias("h"), F.col("l.c").alias("c"))
        .join(frequent.select("host", "h"), ["host", "h"])
        .groupBy(ROW_ID)
        .agg(F.sum("c").alias("removed_chars"))
    )
    counted = base_counts(rows, text).drop(*([text] if text not in docs.columns else []))
    out = counted.join(removed, ROW_ID, "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)).cast("long"))
    depleted = F.col("word_chars") - F.col("removed_chars") < min_kept * F.col("word_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop(ROW_ID)
