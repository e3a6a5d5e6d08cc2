"""Mixing sources by temperature, realised as budgeted permutations.

A source with token share s gets weight s**a / sum(s**a). The exponent a is
found by bisection (several halvings per pass over the table of sources):
the largest a whose weights reach the target entropy, or, if that would
repeat some source more often than allowed, the smallest a that keeps to
the repetition limit. a = 1 keeps the sources' own shares, a = 0 makes
them equal.

A source's budget is its weight of the whole budget. It is filled with
blocks, each a permutation of all its documents (by hash of id and block number);
the last block is cut where the next document would exceed the budget.
Without a stated budget the whole budget is the smallest that passes over
every source at least once, so no document is left out. ``turn`` orders the
documents so that every stretch of the mix has the target weights.

Sources are a table like any other: totals are aggregated, the exponent's
sums are aggregated, weights come back by a join in which every source is
spread over ``SALTS`` keys, and running totals are per range, not per source.

Cases: a null source is a source; a null text has no tokens; sources without
tokens get no weight and one pass; rows that share id and source are one
document (their tokens add up); null ids likewise; an empty table gives no
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm import common

SALTS = 32
#: target entropy as a share of the largest possible, and most passes over a source.
ENTROPY_SHARE, MAX_PASSES = 0.95, 2.0
#: exponents tried per pass over the sources (four halvings each), and passes.
TRIES, ROUNDS = 16, 6


def word_count(text: Column) -> Column:
    """White-space separated words: the mix's unit of tokens."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0b\f\r]+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def exponent(sources: DataFrame, *, entropy_share: float = ENTROPY_SHARE, max_passes: float = MAX_PASSES, budget: float | None = None) -> float:
    """The exponent for a staged table (source, tokens); only sums over it reach the driver."""
    some = sources.filter("tokens > 0")
    facts = some.agg(F.sum("tokens").alias("all"), F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not facts["n"]:
        return 1.0
    total = float(facts["all"])
    log_share = F.log(F.col("tokens") / total)
    target = entropy_share * math.log(facts["n"])

    def measures(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, most passes over a source) under each exponent."""
        sums = [F.sum(F.exp(log_share * a)).alias(f"z{i}") for i, a in enumerate(exponents)]
        sums += [F.sum(F.exp(log_share * a) * log_share).alias(f"l{i}") for i, a in enumerate(exponents)]
        row, out = some.agg(*sums).first(), []
        for i, a in enumerate(exponents):
            z = row[f"z{i}"]
            whole = budget if budget is not None else facts["most"] / ((facts["most"] / total) ** a / z)
            passes = max(whole * (t / total) ** a / z / t for t in (facts["least"], facts["most"]))
            out.append((math.log(z) - a * row[f"l{i}"] / z, passes))
        return out

    def bisect(fits, smallest: bool) -> float:
        """The least exponent that fits, or the greatest; ``fits`` changes once over [0, 1]."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            tries = [low + (high - low) * i / TRIES for i in range(TRIES + 1)]
            good = [fits(m) for m in measures(tries)]
            if smallest:
                at = good.index(True) if True in good else TRIES
                low, high = tries[max(0, at - 1)], tries[at]
            else:
                at = TRIES - good[::-1].index(True) if True in good else 0
                low, high = tries[at], tries[min(TRIES, at + 1)]
        return high if smallest else low

    by_entropy = bisect(lambda m: m[0] >= target - 1e-12, smallest=False)
    by_passes = bisect(lambda m: m[1] <= max_passes + 1e-12, smallest=True)
    return round(max(by_entropy, by_passes), 7)


def budgets(sources: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, budget) from (source, tokens)."""
    some = sources.filter("tokens > 0")
    total = float(some.agg(F.sum("tokens")).first()[0] or 1)
    raw = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / total) * a)).otherwise(0.0)
    sums = some.agg(F.sum(raw).alias("z"), F.max(F.col("tokens") / raw).alias("whole")).first()
    z = sums["z"] or 1.0
    whole = budget if budget is not None else (sums["whole"] or 0.0) * z
    weight = raw / z
    share = F.round(weight * whole).cast("long")
    if budget is None:  # rounding must not cut a first pass short
        share = F.greatest(share, F.col("tokens"))
    return sources.select("source", "tokens", weight.alias("weight"), share.alias("budget"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    entropy_share: float = ENTROPY_SHARE, max_passes: float = MAX_PASSES, budget: float | None = None, seed: int = 7,
) -> DataFrame:
    """One row per document and pass in the mix: doc_id, source, pass, n_tokens, start, turn, weight.

    ``start`` counts the tokens before it in its source's sequence, ``turn``
    (0 to 1) is its place in the whole mix.
    """
    units = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n"))
    units = common.staged(units.groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens")))
    sources = common.staged(units.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    a = exponent(sources, entropy_share=entropy_share, max_passes=max_passes, budget=budget)
    table = common.staged(budgets(sources, a, budget))
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)).cast("int")
    joined = units.withColumn("_salt", salt).join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("_salt") == F.col("salt")))
    passes = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest(F.col("tokens"), F.lit(1)))).cast("int")
    drawn = joined.select("doc_id", "source", "n_tokens", "weight", "budget", F.explode(F.sequence(F.lit(1), passes)).alias("pass"))
    shuffled = drawn.withColumn("draw", F.xxhash64("doc_id", "pass", F.lit(seed)))
    placed = common.with_running_start(shuffled, ["source", "pass", "draw", "doc_id"], "n_tokens", start="_at")
    # where each source begins in the order; staged, so that the join is one of plain shuffles
    begins = common.staged(placed.groupBy("source").agg(F.min("_at").alias("first")))
    spread = begins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    within = placed.withColumn("_salt", salt).join(spread, F.col("source").eqNullSafe(F.col("of")) & (F.col("_salt") == F.col("salt")))
    start = F.col("_at") - F.col("first")
    return within.filter(start + F.col("n_tokens") <= F.col("budget")).select(
        "doc_id", "source", "pass", "n_tokens", start.alias("start"),
        ((start + F.col("n_tokens") / 2) / F.greatest(F.col("budget"), F.lit(1))).alias("turn"), "weight",
    )


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> DataFrame:
    """``docs`` with every row once per draw of its document, in the order of the mix, with their own columns.

    Partitions are stretches of the mix, sorted within, so what reads them in
    their order meets the target weights throughout. The rows of a document
    with several are spread by hash over the stretch of its tokens; only rows
    that share the text too keep one place.
    """
    drawn = mix(docs, id_col, text_col, source_col, **limits)
    of, source, nth, size, start, turn, own, place = common.unused(docs, "of", "of_source", "pass", "n_tokens", "start", "turn", "own", "place")
    names = {"doc_id": of, "source": source, "pass": nth, "n_tokens": size, "start": start, "turn": turn}
    drawn = common.staged(drawn.select(*[F.col(c).alias(n) for c, n in names.items()]))
    same = F.col(id_col).eqNullSafe(F.col(of)) & F.col(source_col).eqNullSafe(F.col(source))
    rows = docs.withColumn(own, word_count(F.col(text_col))).join(drawn, same)
    # turn / (start + n / 2) is one token's part of the source's sequence
    aside = F.pmod(F.xxhash64(text_col, nth), F.lit(2**30)) / F.lit(float(2**30)) - 0.5
    spread = F.col(turn) * (1 + (F.col(size) - F.col(own)) / (F.col(start) + F.col(size) / 2) * aside)
    placed = rows.withColumn(place, F.when(F.col(size) > F.col(own), spread).otherwise(F.col(turn)))
    return placed.repartitionByRange(place, id_col).sortWithinPartitions(place, id_col).select(*docs.columns)
