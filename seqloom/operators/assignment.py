"""Greedy assignment of items to groups with room, best pairs first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import round_robin

#: Groups of a review, in the order of their sheets, their scores and reasons.
REFERENCE = "overview"
SCORES = {"eye": "eye_score", "mouth": "mouth_score", "pose": "pose_score", "difficult": "difficult_score"}
REASONS = {"overview": "LOW_MULTI_METRIC_CHANGE;BALANCED_NORMAL_REFERENCE", "eye": "EAR_CHANGE", "mouth": "MAR_CHANGE", "pose": "POSE_OR_LANDMARK_CHANGE", "difficult": "ROI_EDGE_OR_DIFFICULT"}
LAST_REASON = "STEP2C_EXISTING_SELECTION"


def greedy(pairs: Column, capacities: Mapping[str, int]) -> Column:
    """From an array of (score, item, group) the array of (item, group) that is taken when pairs
    are gone through by falling score, item and group, and one counts if its item has no
    group yet and its group has room.

    The pairs stand in one row: for as many items as all groups hold, not for a whole table.
    """
    names = list(capacities)
    place = lambda p: F.array_position(F.array(*map(F.lit, names)), p["group"]).cast("int") - 1

    def step(state: Column, p: Column) -> Column:
        room, taken = state["room"], state["taken"]
        fits = (F.get(room, place(p)) > 0) & ~F.exists(taken, lambda t: t["item"] == p["item"])
        less = F.transform(room, lambda n, i: F.when(i == place(p), n - 1).otherwise(n))
        more = F.concat(taken, F.array(F.struct(p["item"].alias("item"), p["group"].alias("group"))))
        return F.when(fits, F.struct(less.alias("room"), more.alias("taken"))).otherwise(state)

    none = F.transform(F.slice(pairs, 1, 0), lambda p: F.struct(p["item"].alias("item"), p["group"].alias("group")))
    start = F.struct(F.array(*[F.lit(n) for n in capacities.values()]).alias("room"), none.alias("taken"))
    return F.aggregate(F.sort_array(pairs, asc=False), start, step, lambda s: s["taken"])


def assign_review_groups(samples: DataFrame, key: str = "sample_id", strata: Sequence[str] = ("split", "label"), scores: Mapping[str, str] = SCORES, capacity: int = 7, references: int = 7) -> DataFrame:
    """key, review_group, reason and review_order (from 1) of exactly ``references`` samples and
    ``capacity`` for each scored group.

    Scores are scaled to [0, 1] over the samples (0 if all are equal).  References are dealt
    from the strata in turn, those whose scaled scores sum lowest first.  The others go to the
    group of their highest scaled score that has room, the highest pairs of all first.  Groups
    are listed in their order, each by falling score.  Another number of samples, or a
    repeated one, is refused before any of them is brought together.
    """
    total = references + capacity * len(scores)
    found = samples.limit(total + 1).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if (found["n"], found["d"]) != (total, total):
        raise ValueError(f"{total} different samples are needed")
    # From here on there are ``total`` rows.
    double = {g: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for g, c in scores.items()}
    s = samples.select(key, *strata, *[x.alias(g) for g, x in double.items()])
    bounds = s.agg(*[f(g).alias(f"{name}_{g}") for g in scores for name, f in (("low", F.min), ("high", F.max))])
    scaled = {g: F.coalesce(F.try_divide(F.col(g) - F.col(f"low_{g}"), F.col(f"high_{g}") - F.col(f"low_{g}")), F.lit(0.0)) for g in scores}
    s = s.crossJoin(bounds).select(key, *strata, *scores, *[x.alias(f"scaled_{g}") for g, x in scaled.items()])
    change = sum((F.col(f"scaled_{g}") for g in scores), F.lit(0.0))
    calm = round_robin(s, strata, [change, F.col(key)], references).select(key, F.lit(REFERENCE).alias("calm"))
    s = s.join(calm, key, "left")
    pairs = s.where("calm IS NULL").select(F.explode(F.array(*[F.struct(F.col(f"scaled_{g}").alias("score"), F.col(key).alias("item"), F.lit(g).alias("group")) for g in scores])).alias("p"))
    taken = pairs.agg(F.collect_list("p").alias("pairs")).select(F.explode(greedy(F.col("pairs"), dict.fromkeys(scores, capacity))).alias("t"))
    s = s.join(taken.select(F.col("t.item").alias(key), F.col("t.group").alias("taken")), key, "left")
    s = s.withColumn("review_group", F.coalesce("calm", "taken"))
    own = F.coalesce(*[F.when(F.col("review_group") == g, F.col(g)) for g in scores], F.lit(0.0))
    names = F.array(*map(F.lit, [REFERENCE, *scores]))
    reason = lambda g: F.concat(F.lit(f"{REASONS.get(g, g.upper())};score="), F.format_string("%.6f", own), F.lit(f";{LAST_REASON}"))
    why = F.coalesce(F.when(F.col("review_group") == REFERENCE, REASONS[REFERENCE]), *[F.when(F.col("review_group") == g, reason(g)) for g in scores])
    place = F.row_number().over(Window.orderBy(F.array_position(names, F.col("review_group")), own.desc(), key))
    return s.select(key, "review_group", why.alias("reason"), place.alias("review_order"))
