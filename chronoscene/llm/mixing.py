"""Mixing sources to target weights along a time-varying curriculum.

Over training time t from 0 to 1 source s has the weight ``share * (1 + a * (2 t - 1))``: sources that are repeated or
favoured against their size rise, the others fall, and the weights add up to the sum of the shares at any time. Its integral
``share * (t + a (t^2 - t))`` is the cumulative token demand; inverting it at a document's place among its source's tokens
gives the document's position in training, by which the mix is range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoscene.operators.rangescan import prefix_sum
from chronoscene.storage import materialized

#: Columns that tell the rows of ``plans`` apart.
PLAN = ["plan_id", "source"]


def supplies(docs: DataFrame) -> DataFrame:
    """``(source, available)`` tokens per source; a few rows."""
    return docs.where("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available"))


def plans(docs: DataFrame, targets: DataFrame, keep_shares: bool = False) -> DataFrame:
    """One row per plan and source with demand, number of passes and slope of the schedule.

    ``plan_tokens`` is ``plan_size`` times the tokens of the whole corpus. A source that can't meet its demand within
    ``max_repeats`` gives all its documents ``max_repeats`` times; the rest isn't moved to other sources, so no source
    exceeds its target. Sources that the corpus lacks stay with 0 available tokens. Null shares and repeats count 0;
    of repeated rows of a plan and source the one with the largest share counts.

    With ``keep_shares`` a plan is as large as all sources can fill at their shares, at most as wanted; sources that the
    corpus lacks or that may not occur leave their shares to the others in proportion. ``fitting_tokens`` is that size.
    """
    best = targets.where("plan_id is not null and source is not null").groupBy("plan_id", "source").agg(F.max(F.struct("target_share", "max_repeats", "plan_size")).alias("t"))
    wanted = best.select("plan_id", "source", F.coalesce("t.target_share", F.lit(0.0)).alias("share"), F.coalesce("t.max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("t.plan_size", F.lit(0.0)).alias("plan_size"))
    corpus = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus"))
    rows = wanted.crossJoin(F.broadcast(corpus)).join(supplies(docs), "source", "left").na.fill(0, ["available"])
    most = F.col("available") * F.col("max_repeats")
    able = (most > 0) & (F.col("share") > 0)
    sums = rows.groupBy("plan_id").agg(F.sum(F.when(able, F.col("share"))).alias("shares"), F.min(F.when(able, most / F.col("share"))).alias("bound"))
    rows = rows.join(sums, "plan_id").withColumn("fitting_tokens", F.coalesce(F.least(F.col("plan_size") * F.col("corpus"), F.col("bound") * F.col("shares")), F.lit(0.0)))
    demand = F.col("share") * F.col("plan_size") * F.col("corpus")
    if keep_shares:
        demand = F.when(able, F.col("share") / F.col("shares") * F.col("fitting_tokens")).otherwise(0.0)
    passes = F.when(F.col("available") > 0, F.least(demand / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    natural = F.greatest(F.col("available") / F.col("corpus"), F.lit(1e-9))
    rise = F.when(F.col("share") > 0, F.tanh(F.ln(F.col("share") / natural)) / 2).otherwise(0.0)
    full = rows.select("plan_id", "source", "share", "max_repeats", "available", (F.col("plan_size") * F.col("corpus")).alias("plan_tokens"), "fitting_tokens", demand.alias("demand"), passes.alias("passes"), rise.alias("rise"))
    middle = full.groupBy("plan_id").agg((F.sum(F.col("share") * F.col("rise")) / F.sum("share")).alias("middle"))
    return full.join(middle, "plan_id").withColumn("slope", F.coalesce(F.col("rise") - F.col("middle"), F.lit(0.0))).drop("rise", "middle")


def inverted(done: Column, slope: Column) -> Column:
    """Time t at which ``t + slope (t^2 - t)`` reaches ``done``."""
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-9, done).otherwise(2 * done / (b + F.sqrt(F.greatest(b * b + 4 * slope * done, F.lit(0.0)))))


def filled(chosen: DataFrame, rounds: int = 5) -> DataFrame:
    """``(plan_id, source, doc_id)``: documents behind the cut that fill what the last part pass leaves of its quota.

    First those that fit the gap one by one go in as long as their sum does, by another prefix sum; then in each round the
    largest document that still fits is taken, of equals the one that comes first. ``chosen`` has a row per plan and
    document with ``part`` (quota), ``within`` (taken already), ``n_tokens`` and ``place``.
    """
    gaps = chosen.groupBy(*PLAN).agg((F.first("part") - F.coalesce(F.sum(F.when(F.col("within"), F.col("n_tokens"))), F.lit(0))).alias("gap"))
    rest = chosen.where(~F.col("within")).select(*PLAN, "doc_id", "n_tokens", "place")
    small = rest.join(gaps, PLAN).where("n_tokens <= gap").withColumn("key", F.concat_ws("/", F.col("plan_id").cast("string"), "source"))
    run = materialized(prefix_sum(small, "key", ["place", "doc_id"], "n_tokens", "ahead", "_r").where(F.col("ahead") + F.col("n_tokens") <= F.col("gap")).select(*PLAN, "doc_id", "n_tokens"))
    used = run.groupBy(*PLAN).agg(F.sum("n_tokens").alias("used"))
    state = gaps.join(used, PLAN, "left").select(*PLAN, (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.array().cast("array<bigint>").alias("picked"))
    rest = materialized(rest.join(gaps, PLAN).where("n_tokens <= gap").drop("gap").join(run, [*PLAN, "doc_id"], "left_anti"))
    for _ in range(rounds):
        fits = rest.join(state, PLAN).where((F.col("n_tokens") <= F.col("gap")) & ~F.array_contains("picked", F.col("doc_id")))
        best = fits.groupBy(*PLAN).agg(F.min(F.struct((-F.col("n_tokens")).alias("n"), "place", "doc_id")).alias("b"))
        state = materialized(
            state.join(best, PLAN, "left").select(
                *PLAN, (F.col("gap") + F.coalesce("b.n", F.lit(0))).alias("gap"), F.when(F.col("b").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("b.doc_id"))).alias("picked")
            )
        )
    return state.select(*PLAN, F.explode("picked").alias("doc_id")).union(run.select(*PLAN, "doc_id"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42, keep_shares: bool = False) -> DataFrame:
    """``(plan_id, position, doc_id, source, n_tokens, repeats, copy_no)``, range-sorted by plan and position.

    ``docs (doc_id, source, n_tokens)``, one row per document. Documents of null source or no tokens are never chosen. A
    source goes through its documents in a seeded random order, pass after pass; a last part pass takes documents in
    that order as long as all of them lie within its quota, then fills what is left with documents from further on that
    fit (``filled``). ``repeats`` is how often the document occurs in the plan, at most ``max_repeats``.
    """
    pool = docs.where("source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens").withColumn("place", F.xxhash64(F.lit(seed), "doc_id"))
    summed = prefix_sum(pool, "source", ["place", "doc_id"], "n_tokens").drop("rank")
    whole = F.floor("passes")
    part = (F.col("passes") - whole) * F.col("available")
    wanted = plans(docs, targets, keep_shares).where("passes > 0").select(*PLAN, "passes", "available", "slope", whole.alias("whole"), part.alias("part"))
    chosen = materialized(summed.join(wanted, "source").withColumn("within", F.col("before") + F.col("n_tokens") <= F.col("part")))
    more = filled(chosen).withColumn("more", F.lit(True))
    chosen = chosen.join(more, [*PLAN, "doc_id"], "left").na.fill(False, ["more"])
    repeats = (F.col("whole") + (F.col("within") | F.col("more")).cast("long")).cast("int")
    copies = chosen.withColumn("repeats", repeats).where("repeats > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    # A document that fills the last part pass takes a place in it in proportion to its place among all documents.
    own = F.when(F.col("more") & (F.col("copy_no") > F.col("whole")), F.col("before") * F.col("part") / F.col("available")).otherwise(F.col("before") + F.col("n_tokens") / 2)
    done = ((F.col("copy_no") - 1) * F.col("available") + own) / (F.col("passes") * F.col("available"))
    out = copies.select("plan_id", F.least(inverted(done, F.col("slope")), F.lit(1.0)).alias("position"), "doc_id", "source", "n_tokens", "repeats", "copy_no")
    return out.orderBy("plan_id", "position", "doc_id", "copy_no")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame, keep_shares: bool = False) -> DataFrame:
    """Per plan and source: target and actual share of the mix, tokens wanted, available and mixed, and largest repeat."""
    got = mixed.groupBy("plan_id", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("repeats").alias("most_repeats"), F.count_distinct("doc_id").alias("documents"))
    rows = plans(docs, targets, keep_shares).join(got, ["plan_id", "source"], "left").na.fill(0, ["mixed_tokens", "most_repeats", "documents"])
    total = rows.groupBy("plan_id").agg(F.sum("mixed_tokens").alias("total"))
    return rows.join(total, "plan_id").select(
        "plan_id", "source", F.col("share").alias("target_share"), F.round(F.try_divide("mixed_tokens", "total"), 6).alias("actual_share"),
        F.round(F.try_divide("mixed_tokens", "plan_tokens"), 6).alias("share_of_plan"), F.round("demand").cast("long").alias("wanted_tokens"),
        F.col("available").alias("available_tokens"), "mixed_tokens", "max_repeats", "most_repeats", "documents", F.round("plan_tokens").cast("long").alias("plan_tokens"), F.floor("fitting_tokens").alias("fitting_tokens"),
    )


def soundness(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan: no document more often than its source allows, no source above its demand, ``repeats`` rows for each document."""
    allowed = plans(docs, targets).select(*PLAN, "max_repeats", "demand")
    per_doc = mixed.groupBy(*PLAN, "doc_id").agg(F.count("*").alias("n"), F.max("repeats").alias("repeats"), F.count_distinct("copy_no").alias("copies"), F.sum("n_tokens").alias("tokens"))
    per = per_doc.groupBy(*PLAN).agg(F.max("n").alias("most"), F.bool_and((F.col("n") == F.col("repeats")) & (F.col("copies") == F.col("n"))).alias("counted"), F.sum("tokens").alias("tokens"))
    rows = allowed.join(per, PLAN, "left").na.fill(0, ["most", "tokens"]).na.fill(True, ["counted"])
    return rows.groupBy("plan_id").agg(F.bool_and(F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), F.bool_and(F.col("tokens") <= F.col("demand") + 0.5).alias("demand_kept"), F.bool_and("counted").alias("copies_counted"))
