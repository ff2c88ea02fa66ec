"""Mixing sources to target weights by repetition rates and one hash-seeded Bernoulli copy.

Tokens are summed per source, target sizes are shared out by weight under a cap, and every document
is emitted ``floor(rate)`` times plus one more copy with the remaining fraction as probability, where
``rate`` is target / size of its source. Of a fixed number of hash seeds each source takes the one that comes
nearest its target. Nothing but one row per source and task is shuffled.

Defined results: a null or empty text has size 0 (it is emitted by the same rule and adds no words);
a null source is a source of its own, ordered last; an empty table gives an empty result; repeated
rows are drawn alike (the draw depends on doc_id, text and seed only); extra columns pass
through, but one named like the plan's is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.scratch import all_columns, in_order, materialize, quoted, same, unit_draw, unused, with_rank

WORD = r"[^\x20\x09-\x0D]+"
#: Above this number of sources their rates are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000
#: Hash seeds that each source chooses from.
SEEDS = 32


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: float = 3.0, text: str = "text", source: str = "source"
) -> DataFrame:
    """One row per source: _source, _source_size, _target, _rate.

    Sources in code point order (null last) take ``weights`` in turn. The targets share the total
    size by weight; one that exceeds ``max_repeat`` times its source's size stops there and the excess
    is shared again by weight among the rest, until none is above.
    """
    sizes = docs.groupBy(F.col(quoted(source)).alias("_source")).agg(F.sum(word_count(F.col(quoted(text)))).alias("_source_size"))
    ranked = with_rank(in_order(sizes, F.col("_source").asc_nulls_last(), name="sources"), "_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    table = materialize(
        ranked.select("_source", "_source_size", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_w")), "weighted"
    )
    cap, level, capped_before = F.col("_source_size") * max_repeat, 0.0, -1
    total = table.agg(F.coalesce(F.sum("_source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    level = total[0] / total[1] if total[1] else 0.0
    while True:
        above = cap <= F.col("_w") * F.lit(level)
        capped, at_cap, free = table.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, F.col("_source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0)),
        ).first()
        if capped == capped_before or not free:
            break
        capped_before, level = capped, (total[0] - max_repeat * at_cap) / free
    target = F.least(cap, F.col("_w") * F.lit(level)).cast("double")
    rate = F.when(F.col("_source_size") > 0, target / F.col("_source_size")).otherwise(F.lit(0.0))
    return table.select("_source", "_source_size", target.alias("_target"), rate.alias("_rate"))


def _joined(docs: DataFrame, rates: DataFrame, source: Column, name: str) -> DataFrame:
    """``docs`` with the row of its source in ``rates`` as the struct ``name``."""
    own = unused([*docs.columns, name], "_source")[0]
    table = rates.select(F.col("_source").alias(own), F.struct("*").alias(name))
    if rates.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    return docs.join(table, same(source, F.col(own))).drop(own)


def _copies(rate: Column, seed: Column, key: Column, text: Column) -> Column:
    """floor(rate), and one more where the draw says so."""
    whole = F.floor(rate)
    return whole.cast("int") + (unit_draw(seed, key, F.xxhash64(text)) < rate - whole).cast("int")


def seeded_rates(docs: DataFrame, seeds: int = SEEDS, text: str = "text", source: str = "source", key: str = "doc_id", **sharing) -> DataFrame:
    """:func:`source_rates` with _seed, of 0 to ``seeds`` - 1 that whose draws bring the source's words nearest its target.

    A single Bernoulli copy of a long document moves a small source's sum, so one pass adds up, for every seed, what
    a source would come to: ``seeds`` sums a source.
    """
    rates = source_rates(docs, text=text, source=source, **sharing)
    sized = docs.select(F.col(quoted(source)).alias("_of"), F.col(quoted(key)).alias("_k"), F.xxhash64(quoted(text)).alias("_h"), word_count(F.col(quoted(text))).alias("_size"))
    drawn = _joined(sized, rates, F.col("_of"), "_r")
    sums = [F.sum(F.col("_size") * _copies(F.col("_r._rate"), F.lit(s), F.col("_k"), F.col("_h"))) for s in range(seeds)]
    taken = drawn.groupBy(F.col("_of"), F.col("_r._target").alias("_t")).agg(F.array(*sums).alias("_sums"))
    off = F.transform("_sums", lambda x, at: F.struct(F.abs(x - F.col("_t")).alias("off"), at.alias("seed")))
    best = taken.select("_of", F.array_min(off)["seed"].alias("_seed"))
    return materialize(rates.join(best, same(rates["_source"], best["_of"])).drop("_of"), "seeds")


def plan_mix(
    docs: DataFrame, seeds: int = SEEDS, text: str = "text", source: str = "source", key: str = "doc_id", plan: str = "_plan", **sharing
) -> DataFrame:
    """``docs`` with the struct ``plan``: size, source_size, target, rate and copies (0 to ceil of the largest rate)."""
    rates = seeded_rates(docs, seeds, text, source, key, **sharing)
    own = unused([*docs.columns, plan], "_mix")[0]
    joined = _joined(docs, rates, F.col(quoted(source)), own)
    of = lambda name: F.col(f"{own}.{name}")
    copies = _copies(of("_rate"), of("_seed"), F.col(quoted(key)), F.xxhash64(quoted(text)))
    row = F.struct(
        word_count(F.col(quoted(text))).alias("size"), of("_source_size").alias("source_size"), of("_target").alias("target"), of("_rate").alias("rate"), copies.alias("copies")
    )
    return joined.withColumn(plan, row).drop(own)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    plan, copy = unused(docs.columns, "_plan", "_copy")
    planned = plan_mix(docs, plan=plan, **options).filter(F.col(f"{plan}.copies") > 0)
    return planned.select(*all_columns(docs), F.explode(F.expr(f"sequence(1, {plan}.copies)")).alias(copy)).drop(copy)
