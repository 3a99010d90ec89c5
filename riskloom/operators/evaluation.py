"""How good is a ranking: exact metrics, alert budgets, calibration and uncertainty.

Scores are first collapsed to one row per distinct value (combined on the map
side, so a value shared by a large part of the table is one row), then totalled
in score order across the cluster. Labels are 0 (normal) and 1 (fraud).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import steps_at_or_below
from riskloom.operators.ranking import (
    broadcast_if_small,
    exact_quantiles,
    row_index_within,
    running_totals,
    with_constants,
)

# Thresholds of a percentile risk and alert budgets to report by default.
DEFAULT_THRESHOLDS = (0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999)
DEFAULT_BUDGETS = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)


def check_inputs(df: DataFrame, label: str, *numbers: str, both: bool = True) -> DataFrame:
    """Refuse other labels than 0/1, missing classes and scores that are not finite."""
    odd = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in numbers]
    row = df.agg(
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("_other"),
        F.count_if(F.col(label) == 1).alias("_fraud"),
        F.count_if(F.col(label) == 0).alias("_normal"),
        *odd,
    ).first()
    if row["_other"]:
        raise ValueError("a label is neither 0 (normal) nor 1 (fraud)")
    for c in numbers:
        if row[c]:
            raise ValueError(f"column {c} contains values that are null, NaN or infinite")
    if both and not (row["_fraud"] and row["_normal"]):
        raise ValueError("rows of both normal and fraud are required")
    if not row["_fraud"]:
        raise ValueError("without at least one fraud row there is nothing to find")
    return df


def per_score(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., score, n, pos): rows and frauds per distinct score."""
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )


def ranked_scores(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds `flagged` and `tp`: rows and frauds at or above each score."""
    return running_totals(counted, [F.desc("score")], {"flagged": "n", "tp": "pos"}, by)


def metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, its base rate and ROC-AUC, per `by` group.

    Average precision sums precision over the recall steps of the distinct
    scores, without interpolation; ties count half in the area under the ROC.
    """
    ranked = ranked_scores(per_score(df, score, label, by), by)
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    below_half = neg.cast("double") * (F.col("tp") - pos / 2)
    return ranked.groupBy(*by).agg(
        (F.sum(pos * F.col("tp") / F.col("flagged")) / F.sum(pos)).alias("pr_auc"),
        (F.sum(pos) / F.sum("n")).alias("pr_auc_baseline"),
        F.try_divide(F.sum(below_half), F.sum(pos).cast("double") * F.sum(neg)).alias("roc_auc"),
        F.sum("n").alias("n"),
        F.sum(pos).alias("n_fraud"),
    )


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score: precision, recall and false positive rate."""
    ranked = ranked_scores(per_score(df, score, label))
    totals = df.agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    return with_constants(ranked, totals).select(
        "score",
        "flagged",
        "tp",
        (F.col("tp") / F.col("flagged")).alias("precision"),
        (F.col("tp") / F.col("_pos")).alias("recall"),
        F.try_divide(F.col("flagged") - F.col("tp"), F.col("_n") - F.col("_pos")).alias("false_positive_rate"),
    )


def recall_at_precision(points: DataFrame, minimum: float) -> DataFrame:
    """The best recall among curve points that reach the precision, else 0."""
    reached = F.max(F.when(F.col("precision") >= minimum, F.col("recall")))
    return points.agg(F.coalesce(reached, F.lit(0.0)).alias("recall"))


# ------------------------------------------------------------- thresholds
def totals_from(df: DataFrame, score: Column, edges: Sequence[float], sums: Mapping[str, Column]) -> DataFrame:
    """Totals of rows at or above each edge: (step, <sums>) for step 0..len(edges).

    Step k covers scores >= edges[k-1]; step 0 covers everything. One scan, with
    at most len(edges)+1 groups; the running sum is over that small table.
    """
    grouped = df.groupBy(steps_at_or_below(score, edges).alias("step")).agg(
        *(F.sum(column).alias(name) for name, column in sums.items())
    )
    steps = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("step"))
    every = steps.join(grouped, "step", "left")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return every.select("step", *(F.coalesce(F.sum(name).over(down), F.lit(0)).alias(name) for name in sums))


def threshold_table(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float] = DEFAULT_THRESHOLDS, amount: str | None = None
) -> DataFrame:
    """Confusion counts and derived rates at each threshold.

    Undefined ratios are null: precision with nothing flagged, alerts per fraud
    with nothing caught.
    """
    edges = sorted(set(float(t) for t in thresholds))
    fraud = F.col(label) == 1
    sums = {"flagged": F.lit(1), "tp": F.when(fraud, 1).otherwise(0)}
    if amount is not None:
        sums["caught"] = F.when(fraud, F.col(amount).cast("double")).otherwise(0.0)
    steps = totals_from(df, F.col(score), edges, sums)
    whole = steps.select(F.col("step").alias("whole"), *(F.col(name).alias(f"all_{name}") for name in sums))
    # Step 0 holds the totals of the table; both joins are with a table of one row per threshold.
    named = df.sparkSession.createDataFrame(
        [(i + 1, 0, e) for i, e in enumerate(edges)], "step int, whole int, threshold double"
    )
    table = named.join(F.broadcast(steps), "step").join(F.broadcast(whole), "whole")
    fp, normals = F.col("flagged") - F.col("tp"), F.col("all_flagged") - F.col("all_tp")
    precision, recall = F.try_divide("tp", "flagged"), F.try_divide("tp", "all_tp")
    columns = [
        F.col("threshold"),
        F.col("flagged"),
        (100 * F.try_divide("flagged", "all_flagged")).alias("flagged_pct"),
        F.col("tp"),
        fp.alias("fp"),
        (F.col("all_tp") - F.col("tp")).alias("fn"),
        (normals - fp).alias("tn"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        (100 * F.try_divide(fp, normals)).alias("normal_flagged_pct"),
        F.try_divide("flagged", "tp").alias("alerts_per_fraud"),
    ]
    if amount is not None:
        columns.append((100 * F.try_divide("caught", "all_caught")).alias("fraud_amount_caught_pct"))
    return table.select(*columns)


def confusion_at(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """tp, fp, fn and tn of one threshold; a score equal to it counts as flagged."""
    flagged, fraud = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(
        F.count_if(flagged & fraud).alias("tp"),
        F.count_if(flagged & ~fraud).alias("fp"),
        F.count_if(~flagged & fraud).alias("fn"),
        F.count_if(~flagged & ~fraud).alias("tn"),
    )


def best_precision(table: DataFrame) -> DataFrame:
    """The threshold with the highest precision, the lowest one on ties."""
    order = F.struct("precision", -F.col("threshold"))
    return table.where(F.col("precision").isNotNull()).agg(
        F.max_by("threshold", order).alias("threshold"), F.max("precision").alias("precision")
    )


# ------------------------------------------------------------ alert budgets
@dataclass(frozen=True)
class Cut:
    """The end of a top-k alert list: all scores above `score`, ties up to `last_id`."""

    alerts: int
    score: float | None
    last_id: object

    def flags(self, score: str, row_id: str) -> Column:
        if self.alerts == 0:
            return F.lit(False)
        tied = F.col(score) == self.score
        if self.last_id is not None:
            tied = tied & (F.col(row_id) <= self.last_id)
        return (F.col(score) > self.score) | tied


def top_cuts(df: DataFrame, score: str, row_id: str, wanted: Sequence[int]) -> list[Cut]:
    """Where the `k` highest scores end, ties taken in `row_id` order, for each wanted k.

    Only one row per k comes back to the driver; a tie group that is cut through
    is ranked across the cluster, as it may be a large part of the table.
    """
    counted = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, [F.desc("score")], {"upto": "n"})
    ends = ranked.agg(
        *(
            F.max(
                F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), F.struct("score", "upto", "n"))
            ).alias(f"k{i}")
            for i, k in enumerate(wanted)
        )
    ).first()
    place_in_tie = lambda k, end: k - (end["upto"] - end["n"])
    partial = {
        (end["score"], place_in_tie(k, end)) for k, end in zip(wanted, ends) if end is not None and k < end["upto"]
    }
    last = {}
    if partial:
        tied = df.where(F.col(score).isin(sorted({s for s, _ in partial}))).select(
            F.col(score).cast("double").alias("score"), F.col(row_id).alias("_id")
        )
        needed = df.sparkSession.createDataFrame(sorted(partial), "score double, place bigint")
        placed = row_index_within(tied, ["score"], ["_id"], "place", start=1)
        found = placed.join(F.broadcast(needed), ["score", "place"]).collect()
        last = {(row["score"], row["place"]): row["_id"] for row in found}
    return [
        Cut(0, None, None) if end is None else Cut(k, end["score"], last.get((end["score"], place_in_tie(k, end))))
        for k, end in zip(wanted, ends)
    ]


def budget_cuts(df: DataFrame, score: str, row_id: str, budgets: Sequence[float]) -> list[Cut]:
    """`top_cuts` for shares of the table; the number of alerts rounds half to even."""
    size = df.count()
    return top_cuts(df, score, row_id, [int(round(b * size)) for b in budgets])


def budget_table(
    df: DataFrame, score: str, label: str, row_id: str, budgets: Sequence[float] = DEFAULT_BUDGETS
) -> DataFrame:
    """Precision and recall when only the top share of rows is alerted, one scan for all budgets."""
    cuts = budget_cuts(df, score, row_id, budgets)
    fraud = F.col(label) == 1
    caught = [
        F.struct(
            F.lit(100.0 * b).alias("budget_pct"),
            F.lit(cut.alerts).cast("long").alias("alerts"),
            F.count_if(fraud & cut.flags(score, row_id)).alias("tp"),
            F.count_if(fraud).alias("frauds"),
        )
        for b, cut in zip(budgets, cuts)
    ]
    rows = df.agg(F.array(*caught).alias("rows")).select(F.inline("rows"))
    return rows.select(
        "budget_pct",
        "alerts",
        "tp",
        F.try_divide("tp", "alerts").alias("precision"),
        F.try_divide("tp", "frauds").alias("recall"),
        F.try_divide("alerts", "tp").alias("alerts_per_fraud"),
    )


def overlap(df: DataFrame, first: str, second: str, label: str, row_id: str, budget: float) -> DataFrame:
    """Frauds caught by both, one or neither of two rankings at the same budget."""
    a = budget_cuts(df, first, row_id, [budget])[0].flags(first, row_id)
    b = budget_cuts(df, second, row_id, [budget])[0].flags(second, row_id)
    fraud = F.col(label) == 1
    return df.agg(
        F.count_if(fraud & a & b).alias("both"),
        F.count_if(fraud & a & ~b).alias("only_first"),
        F.count_if(fraud & ~a & b).alias("only_second"),
        F.count_if(fraud & ~a & ~b).alias("missed"),
    )


def amount_profile(df: DataFrame, amount: str, groups: Mapping[str, Column]) -> DataFrame:
    """Count, quartiles and maximum of the amount in several, possibly overlapping, sets of rows."""
    tagged = df.select(
        amount, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in groups.items())))).alias("population")
    )
    quartiles = exact_quantiles(tagged, amount, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["population"])
    sizes = tagged.groupBy("population").agg(F.count(amount).alias("n"), F.max(amount).alias("maximum"))
    return sizes.join(F.broadcast(quartiles), "population")


def false_alarms(df: DataFrame, score: str, label: str, amount: str, row_id: str, budget: float) -> DataFrame:
    """Amounts of all normal rows against those a ranking would alert on."""
    flagged = budget_cuts(df, score, row_id, [budget])[0].flags(score, row_id)
    normal = F.col(label) == 0
    return amount_profile(df, amount, {"all normal": normal, "false alarms": normal & flagged})


# -------------------------------------------------------- agreement, calibration
def mid_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, rank): the mean position of each distinct value."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, [value], {"_upto": "_n"})
    return ranked.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def spearman(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rank correlation with mid-ranks on ties.

    Pairs are collapsed before the two joins, so a pair of scores shared by many
    rows travels once; the correlation is taken from weighted sums.
    """
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("_w"))
    lookup = lambda value, name: broadcast_if_small(mid_ranks(df, value, name), 100_000)
    ranked = pairs.join(lookup(first, "_a"), first).join(lookup(second, "_b"), second)
    # Centred on the mean rank (n + 1) / 2, known from the count alone, to keep the sums small.
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    centred = with_constants(ranked, size).select(
        "_w",
        (F.col("_a") - (F.col("_n") + 1) / 2).alias("_a"),
        (F.col("_b") - (F.col("_n") + 1) / 2).alias("_b"),
    )
    w, a, b = F.col("_w"), F.col("_a"), F.col("_b")
    return centred.agg(
        F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))).alias("spearman")
    )


def calibrated(reference: DataFrame, scored: DataFrame, score: str, name: str = "risk") -> DataFrame:
    """Risk as the share of reference (normal) scores above each score.

    Lower raw scores are stranger. NaN, infinite and null scores are refused when
    the job runs rather than read as safe.
    """
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) != float("inf"))
    safe = F.when(finite, F.col(score).cast("double")).otherwise(
        F.raise_error(F.lit("raw scores contain missing, NaN or infinite values")).cast("double")
    )
    known = reference.groupBy(safe.alias("_s")).agg(F.count(F.lit(1)).alias("_ref"))
    asked = scored.groupBy(safe.alias("_s")).agg(F.lit(0).cast("long").alias("_ref"))
    merged = known.unionByName(asked).groupBy("_s").agg(F.sum("_ref").alias("_ref"))
    ranked = running_totals(merged, ["_s"], {"_upto": "_ref"})
    size = ranked.agg(F.sum("_ref").alias("_size"))
    share = F.try_divide(F.col("_size") - F.col("_upto"), F.col("_size"))
    lookup = with_constants(ranked, size).select("_s", share.alias(name))
    return scored.withColumn("_s", safe).join(broadcast_if_small(lookup, 100_000), "_s").drop("_s")


def budget_calibration(df: DataFrame, risk: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Does a percentile threshold flag the share of normal rows it promises?"""
    table = threshold_table(df, risk, label, thresholds)
    return table.select(
        "threshold",
        ((1 - F.col("threshold")) * 100).alias("expected_pct"),
        F.col("normal_flagged_pct").alias("actual_pct"),
        F.col("tp").alias("fraud_caught"),
        (F.col("tp") + F.col("fn")).alias("frauds"),
    )


def lowest_lift(df: DataFrame, score: str, label: str, share: float = 0.01) -> DataFrame:
    """Frauds among the lowest scores, against what random picking would find."""
    cut = exact_quantiles(df, score, {"cut": share})
    inside = F.col(score) <= F.col("cut")
    counted = with_constants(df, cut).agg(
        F.count_if(inside).alias("picked"),
        F.count_if(inside & (F.col(label) == 1)).alias("fraud_picked"),
        F.avg(F.col(label).cast("double")).alias("_rate"),
    )
    expected = F.col("_rate") * F.col("picked")
    return counted.select(
        "picked", "fraud_picked", expected.alias("expected_fraud"), F.try_divide("fraud_picked", expected).alias("lift")
    )


def scaling_comparison(df: DataFrame, schemes: Mapping[str, Column], label: str, at: float = 0.5) -> DataFrame:
    """Medians per class and rows flagged at one threshold, for several scalings of one score."""
    long = df.select(
        F.col(label).alias("_y"),
        F.inline(F.array(*(F.struct(F.lit(n).alias("scheme"), c.cast("double").alias("_v")) for n, c in schemes.items()))),
    )
    medians = exact_quantiles(long, "_v", {"_m": 0.5}, ["scheme", "_y"])
    pick = lambda y: F.max(F.when(F.col("_y") == y, F.col("_m")))
    per_scheme = medians.groupBy("scheme").agg(pick(0).alias("normal_median"), pick(1).alias("fraud_median"))
    hit = F.col("_v") >= at
    flagged = long.groupBy("scheme").agg(
        (100 * F.try_divide(F.count_if(hit & (F.col("_y") == 0)), F.count_if(F.col("_y") == 0))).alias("normal_flagged_pct"),
        F.count_if(hit & (F.col("_y") == 1)).alias("fraud_caught"),
    )
    return flagged.join(F.broadcast(per_scheme), "scheme")


# ----------------------------------------------------------------- uncertainty
def hashed_fraction(*parts: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for the given parts: 52 bits of SHA-256."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


DRAWS_PER_TASK = 1 << 18  # a table of few rows lies in one partition, whatever is drawn from it


def bootstrap_replicates(
    df: DataFrame, score: str, label: str, row_id: str, resamples: int, seed: int = 0
) -> DataFrame:
    """(replicate, pr_auc) of resamples that keep each class at its own size.

    Draw j of a class picks the row at position floor(u * size). Rows are dealt out
    by the number of draws they make, and the picks, counted where the row they
    picked is, take its score along. Every replicate is ranked with the same
    cluster-wide running totals.
    """
    placed = row_index_within(
        df.select(F.col(label).alias("_y"), F.col(score).cast("double").alias("_s"), F.col(row_id).alias("_id")), ["_y"], ["_id"], "_at"
    )
    sizes = placed.groupBy("_y").agg(F.count(F.lit(1)).alias("_size"))
    parts = max(1, -(-placed.count() * resamples // DRAWS_PER_TASK))
    dealt = placed.select("_y", "_at", "_s").repartition(parts, "_y", "_at")
    draws = dealt.join(F.broadcast(sizes), "_y").select(
        "_y", "_size", "_at", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("replicate")
    )
    spot = F.floor(hashed_fraction(F.lit(seed), F.col("replicate"), F.col("_y"), F.col("_at")) * F.col("_size"))
    picked = draws.select("replicate", "_y", spot.alias("_at")).repartition(parts, "_y", "_at")
    drawn = picked.groupBy("replicate", "_y", "_at").agg(F.count(F.lit(1)).alias("_times")).join(dealt.hint("shuffle_hash"), ["_y", "_at"])
    counted = drawn.groupBy("replicate", F.col("_s").alias("score")).agg(
        F.sum("_times").alias("n"), F.sum(F.when(F.col("_y") == 1, F.col("_times")).otherwise(0)).alias("pos")
    )
    ranked = ranked_scores(counted, ["replicate"])
    return ranked.groupBy("replicate").agg(
        (F.sum(F.col("pos") * F.col("tp") / F.col("flagged")) / F.sum("pos")).alias("pr_auc")
    )


def poisson_replicates(df: DataFrame, score: str, label: str, row_id: str, resamples: int, seed: int = 0) -> DataFrame:
    """The cheap form for very large tables: each row is repeated Poisson(1) times per replicate.

    No draws are joined back: one scan, combined per (replicate, score) before the shuffle.
    """
    u = hashed_fraction(F.lit(seed), F.col("replicate"), F.col("_id"))
    mass, upto, steps = 2.718281828459045**-1, 0.0, []
    for k in range(1, 17):  # beyond 16 repeats the remaining mass is under 1e-14
        upto += mass
        steps.append(upto)
        mass /= k
    each = df.select(
        F.col(label).alias("_y"), F.col(score).cast("double").alias("score"), F.col(row_id).alias("_id"),
        F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("replicate"),
    ).withColumn("_times", steps_at_or_below(u, steps))
    counted = (
        each.where("_times > 0")
        .groupBy("replicate", "score")
        .agg(F.sum(F.col("_times").cast("long")).alias("n"), F.sum(F.when(F.col("_y") == 1, F.col("_times").cast("long")).otherwise(0)).alias("pos"))
    )
    ranked = ranked_scores(counted, ["replicate"])
    return ranked.groupBy("replicate").agg(
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("flagged")), F.sum("pos")).alias("pr_auc")
    )


def interval(replicates: DataFrame, confidence: float = 0.95) -> DataFrame:
    """The central interval; its input is one row per replicate, a parameter, not data."""
    tail = (1 - confidence) / 2
    return replicates.agg(
        F.percentile("pr_auc", tail).alias("low"),
        F.percentile("pr_auc", 1 - tail).alias("high"),
        F.count("pr_auc").alias("resamples"),
    )


def side_by_side(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Two small tables aligned on a key, their other columns prefixed."""
    renamed = [
        df.select(key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key))
        for df, name in zip((left, right), names)
    ]
    return renamed[0].join(renamed[1], key)
