"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. The token counts of the cells are raked to
the target share of each source, language and topic in turn until they settle. No cell can give more
tokens than it has, so the raking is bounded: cells at their bound count with it, and the others are raked to
what the targets leave. A value whose target is above all its tokens gives all of them, and the other values
of its dimension share what is missing. Each document is kept with its cell's probability by a hash of its own
content; report() sets expected shares beside the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import any_names, materialize, release
from geoweave.llm.quality_rules import SYMBOLS, words_of

DIMENSIONS = ("source", "lang", "topic")
#: Exponent on a value's present share that gives its target share; 1 keeps it, 0 makes all equal.
TEMPERATURE = {"source": 0.7, "lang": 0.6, "topic": 0.9}
#: Name of the null source and language among the cells.
NULL = "\x00null"
KEEP_SHARE, ROUNDS, TOLERANCE, SEED = 0.8, 40, 1e-3, 20


def topic_of(text: Column, n_tokens: Column) -> Column:
    """Kind of text by its form: symbols, table, short, lines or prose."""
    t = F.coalesce(text, F.lit(""))
    count = lambda char: F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))
    return (
        F.when(n_tokens < 40, "short")
        .when(count("|") * 8 > n_tokens, "table")
        .when(F.regexp_count(t, F.lit(f"[{SYMBOLS}]")) * 8 > n_tokens, "symbols")
        .when(count("\n") * 25 > n_tokens, "lines")
        .otherwise("prose")
    )


def targets(cells: DataFrame, dimension: str, temperature: float, shares: dict[str, float] | None = None) -> DataFrame:
    """(dimension, target): tokens that each value is raked to; together all tokens of the cells.

    Shares given for some values are taken as they are; the other values divide the rest.
    """
    present = cells.groupBy(dimension).agg(F.sum("t").alias("t"))
    named = F.create_map(*[x for k, v in (shares or {}).items() for x in (F.lit(k), F.lit(float(v)))]) if shares else None
    fixed = named[F.col(dimension)] if shares else F.lit(None).cast("double")
    part = present.withColumn("fixed", fixed).withColumn("free", F.when(F.col("fixed").isNull(), F.pow("t", F.lit(temperature))).otherwise(0.0))
    sums = part.agg(F.sum("t").alias("all"), F.sum("free").alias("sum_free"), F.coalesce(F.sum("fixed"), F.lit(0.0)).alias("sum_fixed"))
    rest = F.greatest(F.lit(0.0), 1 - F.col("sum_fixed"))
    scale = F.when(F.col("sum_free") > 0, F.greatest(F.lit(1.0), F.col("sum_fixed"))).otherwise(F.col("sum_fixed"))
    share = F.coalesce(F.col("fixed") / scale, F.try_divide(F.col("free") * rest, F.col("sum_free")), F.lit(0.0))
    return part.join(F.broadcast(sums)).select(dimension, (share * F.col("all")).alias("target"))


def _fit_factor(df: DataFrame, weight: str, cap: str, total: float, start: float = 1.0) -> float:
    """The factor of the weights at which they add up to total, each of them being at most its cap."""
    factor = start
    for _ in range(60):
        r = df.agg(
            F.sum(F.when(F.col(weight) * factor >= F.col(cap), F.col(cap)).otherwise(0.0)).alias("full"),
            F.sum(F.when(F.col(weight) * factor >= F.col(cap), 0.0).otherwise(F.col(weight))).alias("rest"),
        ).first()
        if not r.rest:
            break
        before, factor = factor, max(0.0, total - r.full) / r.rest
        if abs(factor - before) <= 1e-9 * before:
            break
    return factor


def reachable(cells: DataFrame, goals: DataFrame, dimension: str, keep_share: float) -> DataFrame:
    """(dimension, target, pinned): the goals, none above what the value's tokens allow; pinned where it needs them all."""
    have = cells.groupBy(dimension).agg((F.sum("t") / max(keep_share, 1e-9)).alias("cap"))
    both = materialize(goals.join(have, dimension), "goals")
    total = both.agg(F.sum("target")).first()[0] or 0.0
    raised = F.col("target") * _fit_factor(both, "target", "cap", total)
    return materialize(both.select(dimension, F.least(raised, F.col("cap")).alias("target"), (raised >= F.col("cap")).alias("pinned")), "goals")


def rake(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, keep_share: float = 0.0) -> DataFrame:
    """cells with w: tokens t raked to the goals of all dimensions. Marginal sums are combined before the shuffle.

    A cell counts with at most t / keep_share: w may be greater, and is least(w, t / keep_share) then. Cells of a pinned value
    stay at their bound. Goals that contradict each other are met as far as the last round gets.
    """
    cap = F.col("t") / max(keep_share, 1e-9)
    cur = cells.withColumns({"w": F.col("t").cast("double"), "off": F.lit(0.0), "bound": F.lit(False)})
    for d in goals:
        if "pinned" in goals[d].columns:
            cur = cur.join(goals[d].select(d, "pinned"), d).withColumn("bound", F.col("bound") | F.col("pinned")).drop("pinned")
    written = None
    for _ in range(rounds):
        worst = 0.0
        for d in goals:  # each step is cut, else the plan would double with every factor
            full = F.col("bound") | (F.col("w") >= cap)
            sums = cur.groupBy(d).agg(
                F.sum(F.when(full, cap).otherwise(F.col("w"))).alias("s"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("free")
            ).join(goals[d].select(d, "target"), d)
            ratio = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0)
            left = F.col("target") - (F.col("s") - F.col("free"))
            factor = F.when((F.col("free") > 0) & (left > 0), left / F.col("free")).otherwise(ratio)
            sums = sums.select(d, factor.alias("f"), F.abs(ratio - 1).alias("miss"))
            step = cur.drop("off").join(sums, d).withColumns({"w": F.col("w") * F.col("f"), "off": F.col("miss")}).drop("f", "miss")
            cur = materialize(step, "rake")
            worst = max(worst, cur.agg(F.max(F.when(F.col("t") > 0, F.col("off")))).first()[0] or 0.0)
            if written is not None:
                release(written)
            written = cur
        if worst < tolerance:
            break
    return cur.withColumn("w", F.when(F.col("bound"), cap).otherwise(F.least(F.col("w"), cap))).drop("off", "bound")


def calibrate(raked: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """raked with p: the probability of each cell, so that the expected tokens are keep_share of all."""
    total = raked.agg(F.sum("t").alias("t")).first()[0] or 0
    factor = _fit_factor(raked, "w", "t", keep_share * total, keep_share)
    return raked.withColumn("p", F.when(F.col("t") > 0, F.least(F.lit(1.0), F.col("w") * factor / F.col("t"))).otherwise(F.lit(keep_share)))


def report(
    mixed: DataFrame, source: str = "source", lang: str = "lang",
    shares: dict[str, dict[str, float]] | None = None, temperature: dict[str, float] = TEMPERATURE,
) -> DataFrame:
    """(dimension, value, target, most, expected) of what mix() gave: target share, greatest share that the value's
    tokens allow at the tokens expected in all, and expected share."""
    keys = {"source": F.coalesce(F.col(source).cast("string"), F.lit(NULL)), "lang": F.coalesce(F.col(lang).cast("string"), F.lit(NULL)), "topic": F.col("topic")}
    kept = F.sum(F.col("n_tokens") * F.col("probability"))
    cells = materialize(mixed.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.sum("n_tokens").cast("double").alias("t"), kept.alias("x")), "cells")
    all_t, all_x = cells.agg(F.sum("t"), F.sum("x")).first()
    out = None
    for d in DIMENSIONS:
        have = cells.groupBy(d).agg(F.sum("t").alias("t"), F.sum("x").alias("x"))
        part = targets(cells, d, temperature.get(d, 1.0), (shares or {}).get(d)).join(have, d).select(
            F.lit(d).alias("dimension"), F.col(d).alias("value"), (F.col("target") / (all_t or 1.0)).alias("target"),
            F.least(F.lit(1.0), F.col("t") / (all_x or 1.0)).alias("most"), (F.col("x") / (all_x or 1.0)).alias("expected"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@any_names(("topic", "n_tokens", "probability", "kept"), "text", "source", "lang", "id_col")
def mix(
    docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", id_col: str = "doc_id",
    shares: dict[str, dict[str, float]] | None = None, temperature: dict[str, float] = TEMPERATURE, keep_share: float = KEEP_SHARE, seed: int = SEED,
    texts_out: bool = True,
) -> DataFrame:
    """Every row of docs with topic, n_tokens, probability and kept; without its text if texts_out is false.

    Texts are read once: what is told of each row is written to the shared folder before the cells are counted.
    shares: target shares by dimension and value, where the temperature should not decide. Null sources
    and languages are values of their own (NULL, apart from the empty string); texts of any length are counted whole; of equal
    rates no tie has to be broken; texts without words (null ones too) have no tokens and are kept with
    probability keep_share if their cell has none; rows that repeat in id and text share their fate; an
    empty table gives an empty result; columns of docs with the names of result columns are replaced.
    """
    words = F.size(words_of(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.withColumn("n_tokens", words.cast("long"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text)), 11) * F.lit(2.0**-53)
    rows = rows.withColumns({"topic": topic_of(F.col(text), F.col("n_tokens")), "__gw_chance": chance})
    rows = materialize(rows if texts_out else rows.drop(text), "measured")
    keys = {"source": F.coalesce(F.col(source).cast("string"), F.lit(NULL)), "lang": F.coalesce(F.col(lang).cast("string"), F.lit(NULL)), "topic": F.col("topic")}
    cells = materialize(rows.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.sum("n_tokens").cast("double").alias("t")), "cells")
    goals = {d: materialize(targets(cells, d, temperature.get(d, 1.0), (shares or {}).get(d)), "goals") for d in DIMENSIONS}
    goals = {d: reachable(cells, g, d, keep_share) for d, g in goals.items()}
    rates = materialize(calibrate(rake(cells, goals, keep_share=keep_share), keep_share), "rates")
    rates = rates.select(*[F.col(d).alias(f"__gw_{d}") for d in DIMENSIONS], F.col("p").alias("probability"))
    on = [keys[d] == F.col(f"__gw_{d}") for d in DIMENSIONS]
    return rows.join(rates, on).withColumn("kept", F.col("__gw_chance") < F.col("probability")).drop("__gw_chance", *[f"__gw_{d}" for d in DIMENSIONS])
