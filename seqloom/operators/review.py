"""Samples for review and what reviewers found: selections, checks, counts and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.geometry import circular_difference

from .distribution import summarize
from .integrity import violations
from .rollup import ratio
from .sampling import round_robin, top_k

#: The five reasons for looking at a video, and how many of each.
REASONS = (("highest_missing_count", 8), ("longest_consecutive_run", 8), ("highest_context_missing", 8), ("isolated_single_miss", 6), ("zero_missing_reference", 6))
#: Metric columns of a sample and the flag of their extremes.
METRICS = (
    ("normalized_landmark_diff", "LARGE_LANDMARK_DIFF"), ("ear_abs_diff", "LARGE_EAR_DIFF"), ("mar_abs_diff", "LARGE_MAR_DIFF"), ("pitch_circular_diff", "LARGE_PITCH_DIFF"), ("yaw_circular_diff", "LARGE_YAW_DIFF"),
    ("roll_circular_diff", "LARGE_ROLL_DIFF"), ("crop_mean_abs_diff", "LARGE_CROP_DIFF"), ("hog_crop_padding_fraction", "HOG_CROP_PADDING"), ("yunet_crop_padding_fraction", "YUNET_CROP_PADDING"),
)
FACE_FLAGS = ("LARGE_LANDMARK_DIFF", "LARGE_EAR_DIFF", "LARGE_MAR_DIFF")
GROUPS = ("detector_failures", "landmark_ear_mar", "pose_crop", "normal_reference")


def severity(review_id: Column) -> Column:
    """The stretch of review numbers a sample stands in."""
    return F.when(review_id == 0, "MOSTLY_MISSING").when(review_id == 1, "FULL_CLIP_MISSING").when(review_id.between(2, 23), "LONG_RUN").when(review_id.between(24, 29), "ISOLATED").otherwise("NORMAL_REFERENCE")


def suspected_reason(decoded: Column, face: Column, selected: Column, crop: Column) -> Column:
    """Why a frame may be missing, the first step that failed."""
    return F.when(~decoded, "SOURCE_FRAME_UNAVAILABLE").when(~face, "DETECTOR_MISS").when(selected & ~crop, "PIPELINE_OR_STORAGE_SUSPECT").otherwise("UNCLASSIFIED")


def choose_candidates(videos: DataFrame, target: int = 36, strata: Sequence[str] = ("split", "label")) -> DataFrame:
    """review_order, video_id, reason: up to ``target`` videos by five reasons in turn, dealt from
    strata, none twice, then a fill that evens out the strata.

    ``videos`` are (video_id, split, label, yunet_missing_count, longest_yunet_missing_run,
    context_missing_count).  A pass a reason over what is left; at most ``target`` ids are
    kept on the driver between passes.
    """
    miss, run, ctx = F.col("yunet_missing_count"), F.col("longest_yunet_missing_run"), F.col("context_missing_count")
    rules = {
        "highest_missing_count": (miss > 0, [miss.desc(), run.desc(), F.col("video_id")]),
        "longest_consecutive_run": (run > 0, [run.desc(), miss.desc(), F.col("video_id")]),
        "highest_context_missing": (ctx > 0, [ctx.desc(), miss.desc(), F.col("video_id")]),
        "isolated_single_miss": ((miss > 0) & (run == 1), [miss.desc(), F.col("video_id")]),
        "zero_missing_reference": ((miss == 0) & (ctx == 0), [F.col("video_id")]),
    }
    taken: list[tuple] = []
    for name, quota in REASONS:
        condition, order = rules[name]
        left = videos.where(condition & ~F.col("video_id").isin([t[0] for t in taken])) if taken else videos.where(condition)
        picked = round_robin(left, strata, order, min(quota, target - len(taken))).orderBy("turn", *strata)
        taken += [(r["video_id"], name) for r in picked.select("video_id", "turn", *strata).collect()]
    if len(taken) < target:
        left = videos.where(~F.col("video_id").isin([t[0] for t in taken])) if taken else videos
        have = videos.where(F.col("video_id").isin([t[0] for t in taken])).groupBy(*strata).agg(F.count(F.lit(1)).alias("have"))
        fill = left.join(have, list(strata), "left").orderBy(F.coalesce("have", F.lit(0)), miss.desc(), "video_id").limit(target - len(taken))
        taken += [(r["video_id"], "balanced_fill") for r in fill.select("video_id").collect()]
    kind = videos.schema["video_id"].dataType.simpleString()
    return videos.sparkSession.createDataFrame([(i, v, r) for i, (v, r) in enumerate(taken)], f"review_order int, video_id {kind}, reason string")


def with_review_frames(chosen: DataFrame, runs: DataFrame, last: int = 99) -> DataFrame:
    """Chosen videos with their representative run (the longest, the first of equal ones; start
    and end null without any) and the frames to look at: its ends, its middle and their
    neighbours in 0..last, else the clip's ends and middle.  ``runs`` are (video_id, start,
    end, length)."""
    mine = runs.join(chosen.select("video_id"), "video_id", "left_semi")
    best = mine.groupBy("video_id").agg(F.min_by(F.struct("start", "end"), F.struct(-F.col("length"), "start")).alias("run"))
    d = chosen.join(best, "video_id", "left").withColumns({"representative_start": F.col("run.start"), "representative_end": F.col("run.end")}).drop("run")
    start, end = F.col("representative_start"), F.col("representative_end")
    near = F.array(F.greatest(F.lit(0), start - 1), start, F.floor((start + end) / 2).cast("int"), end, F.least(F.lit(last), end + 1))
    frames = F.when(start.isNull(), F.array(F.lit(0), F.lit((last + 1) // 2), F.lit(last)).cast("array<long>")).otherwise(F.array_sort(F.array_distinct(near)).cast("array<long>"))
    return d.withColumn("recommended_frames", F.array_join(frames, ";"))


def select_review_samples(samples: DataFrame, outcome: Column, top: int = 8, most: int = 45, normal: int = 10) -> DataFrame:
    """sample_id, review_group, reasons (sorted): every sample whose outcome isn't BOTH_SUCCESS,
    then the extremes of each metric in turn (rank by rank) until ``most - normal`` are chosen,
    then normal references dealt from split and label.  A chosen sample keeps all its reasons.

    Failures, of which there may be any number, stay distributed; extremes (``top`` a metric)
    and references go through the driver.
    """
    spark, kind = samples.sparkSession, samples.schema["sample_id"].dataType.simpleString()
    failed = samples.select("sample_id", outcome.alias("why")).where("why <> 'BOTH_SUCCESS'")
    ranked = [[r["sample_id"] for r in top_k(samples.where(F.col(m).isNotNull()), [F.desc(m), F.col("sample_id")], top).orderBy("rank").select("sample_id").collect()] for m, _ in METRICS]
    flags: dict = {}
    for (_, flag), ids in zip(METRICS, ranked, strict=True):
        for i in ids:
            flags.setdefault(i, set()).add(flag)
    n_failed = failed.count()
    known = {r[0] for r in failed.where(F.col("sample_id").isin(list(flags))).select("sample_id").collect()}  # at most top a metric
    chosen: dict = {}
    for place in range(top):
        for (_, flag), ids in zip(METRICS, ranked, strict=True):
            if place < len(ids) and ids[place] not in known and ids[place] not in chosen and n_failed + len(chosen) < most - normal:
                chosen[ids[place]] = GROUPS[1] if flag in FACE_FLAGS else GROUPS[2]
    dealt = round_robin(normal_samples(samples, outcome), ["split", "label"], [F.col("sample_id")], normal + len(flags))
    references = [r["sample_id"] for r in dealt.select("sample_id", "turn", "split", "label").orderBy("turn", "split", "label").collect()]
    references = [i for i in references if i not in chosen][: max(0, min(normal, most - n_failed - len(chosen)))]
    rows = [(i, g, ";".join(sorted(flags[i]))) for i, g in chosen.items()] + [(i, GROUPS[3], "NORMAL_REFERENCE") for i in references]
    more = spark.createDataFrame([(i, sorted(f)) for i, f in flags.items() if i in known], f"sample_id {kind}, f array<string>")
    reasons = F.array_join(F.array_sort(F.concat(F.array("why"), F.coalesce("f", F.array().cast("array<string>")))), ";")
    first = failed.join(more, "sample_id", "left").select("sample_id", F.lit(GROUPS[0]).alias("review_group"), reasons.alias("reasons"))
    return first.unionByName(spark.createDataFrame(rows, f"sample_id {kind}, review_group string, reasons string"))


def normal_samples(samples: DataFrame, outcome: Column) -> DataFrame:
    """Samples that succeeded, without padding, at or below the median of every difference."""
    from .ordering import percentiles

    names = [m for m, _ in METRICS[:6]]
    middle = {m: percentiles(samples, [], F.col(m), [("m", 0.5)]).first()["m"] for m in names}  # six numbers
    ok = outcome == "BOTH_SUCCESS"
    for m in names:
        ok = ok & (F.col(m) <= middle[m])
    for p in ("hog_crop_padding_fraction", "yunet_crop_padding_fraction"):
        ok = ok & (F.coalesce(p, F.lit(0.0)) <= 0)
    return samples.where(ok)


def repeated_flags(samples: DataFrame, flags: DataFrame) -> DataFrame:
    """Per video with any: how many of its samples have a flag of each family, and all flags.
    ``flags`` are (sample_id, flag)."""
    per = flags.groupBy("sample_id").agg(F.collect_set("flag").alias("f"))
    any_ = lambda *names: F.count_if(F.arrays_overlap(F.coalesce("f", F.array().cast("array<string>")), F.array(*map(F.lit, names))))
    return samples.join(per, "sample_id", "left").groupBy("video_id").agg(
        F.count(F.lit(1)).alias("sample_count"), any_("LARGE_LANDMARK_DIFF").alias("landmark_outlier_count"), any_("LARGE_EAR_DIFF").alias("ear_outlier_count"), any_("LARGE_MAR_DIFF").alias("mar_outlier_count"),
        any_("LARGE_PITCH_DIFF", "LARGE_YAW_DIFF", "LARGE_ROLL_DIFF").alias("pose_outlier_count"), any_("LARGE_CROP_DIFF", "HOG_CROP_PADDING", "YUNET_CROP_PADDING").alias("crop_outlier_count"),
        F.sum(F.coalesce(F.size("f"), F.lit(0))).alias("total_outlier_flags"),
    ).where("total_outlier_flags > 0")


def extremes(samples: DataFrame, key: str = "sample_id", top: int = 8) -> DataFrame:
    """key and flag: the ``top`` samples of each metric."""
    parts = [top_k(samples.where(F.col(m).isNotNull()), [F.desc(m), F.col(key)], top).select(key, F.lit(flag).alias("flag")) for m, flag in METRICS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_selection(preferred: DataFrame, usable: DataFrame, key: str, order: str, target: int) -> DataFrame:
    """The preferred keys that are usable, in their order, then other usable keys ascending, up to
    ``target``: key, place."""
    first = preferred.join(usable.select(key), key, "left_semi").groupBy(key).agg(F.min(order).alias("o")).orderBy("o", key).limit(target)
    rest = usable.select(key).distinct().join(first, key, "left_anti").orderBy(key).limit(target).select(key, F.lit(None).cast(first.schema["o"].dataType).alias("o"))
    return top_k(first.unionByName(rest), [F.col("o").asc_nulls_last(), F.col(key)], target).select(key, F.col("rank").alias("place"))


def pilot(videos: DataFrame, count: int, imputed: bool, strata: Sequence[str] = ("split", "label")) -> DataFrame:
    """video_id and place: one video of each stratum (the most imputed one, then the first), then
    others in that order up to ``count``, among those with imputed slots or those without."""
    d = videos.where((F.col("imputed_slots") > 0) == F.lit(imputed)).select("video_id", "imputed_slots", *strata)
    high = [F.desc("imputed_slots")] if imputed else []
    heads = top_k(d, [*high, F.col("video_id")], 1, strata).drop("rank").withColumn("head", F.lit(True))
    others = d.join(heads.select("video_id"), "video_id", "left_anti")
    order = [*high, *[F.col(s) for s in strata], F.col("video_id")]
    rest = top_k(others, order, count).drop("rank").withColumn("head", F.lit(False))
    whole = [F.desc("head"), F.when(F.col("head"), F.concat_ws("/", *strata)), *order]
    return top_k(heads.unionByName(rest), whole, count).select("video_id", F.col("rank").alias("place"))


def review_slots(videos: DataFrame, slots: DataFrame, strata: Sequence[str] = ("split", "label")) -> DataFrame:
    """Per stratum the two videos of the highest score and the lowest of the others, and of each
    its first, last and best middle slot (nearest to 15 of equal ones): video_id, slot, role.
    ``slots`` are (video_id, slot, score)."""
    s = slots.groupBy("video_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("s"))
    d = videos.join(s, "video_id")
    # From both ends: the lowest of the others is among the three lowest.
    high = top_k(d, [F.desc("best"), F.col("video_id")], 2, strata).withColumn("end", F.lit("high"))
    low = top_k(d, [F.col("best"), F.col("video_id")], 3, strata).withColumn("end", F.lit("low"))
    other = low.join(high.select("video_id"), "video_id", "left_anti")
    d = high.drop("rank").unionByName(top_k(other.drop("rank"), [F.col("best"), F.col("video_id")], 1, strata).drop("rank"))
    middle = F.slice("s", 2, F.size("s") - 2)
    best = F.array_max(F.transform(middle, lambda x: F.struct(x["score"].alias("score"), (-F.abs(x["slot"] - 15)).alias("near"), (-x["slot"]).alias("back"))))
    roles = F.array(F.struct(F.lit("first").alias("role"), F.element_at("s", 1)["slot"].alias("slot")), F.struct(F.lit("middle").alias("role"), (-best["back"]).alias("slot")), F.struct(F.lit("last").alias("role"), F.element_at("s", -1)["slot"].alias("slot")))
    return d.select("video_id", F.explode(roles).alias("r")).select("video_id", "r.role", "r.slot")


def hard_and_control(scores: DataFrame, top: int = 20, per_label: int = 6) -> DataFrame:
    """From (video_id, label, loss_a, loss_b, correct_a, correct_b): the videos in both models'
    ``top`` by loss, by falling worst and summed loss, and per label as controls the
    ``per_label`` easiest of those that both models have right: video_id, sample_group, place."""
    tops = [top_k(scores, [F.desc(c), F.col("video_id")], top).select("video_id") for c in ("loss_a", "loss_b")]
    hard = scores.join(tops[0], "video_id", "left_semi").join(tops[1], "video_id", "left_semi")
    worst, both = F.greatest("loss_a", "loss_b"), F.col("loss_a") + F.col("loss_b")
    h = top_k(hard.withColumns({"worst": worst, "both": both}), [F.desc("worst"), F.desc("both"), F.col("video_id")], top)
    easy = scores.where("correct_a AND correct_b").join(hard.select("video_id"), "video_id", "left_anti").withColumns({"worst": worst, "mean": both / 2})
    c = top_k(easy, [F.col("worst"), F.col("mean"), F.col("video_id")], per_label, ["label"])
    pick = lambda d, name: d.select("video_id", F.lit(name).alias("sample_group"), F.col("rank").alias("place"))
    return pick(h, "hard").unionByName(pick(c, "control"))


def review_scores(candidates: Sequence[str] = ("m05", "m10", "m15")) -> dict[str, Column]:
    """Composite scores of a sample's changes between the raw box and margins of it."""
    change = lambda c, f: F.coalesce(circular_difference(F.col(f"raw_{f}"), F.col(f"{c}_{f}")) if f in ("pitch_raw", "yaw", "roll") else F.abs(F.col(f"raw_{f}") - F.col(f"{c}_{f}")), F.lit(0.0))
    most = lambda *f: F.greatest(*[change(c, x) for c in candidates for x in f])
    landmark = F.greatest(*[F.col(f"raw_{c}_normalized_landmark_diff") for c in candidates])
    return {
        "eye_score": most("ear") + landmark,
        "mouth_score": most("mar") + landmark,
        "pose_score": most("pitch_raw", "yaw", "roll") + 20.0 * landmark,
        "difficult_score": sum((F.col(f"{c}_roi_clipped").cast("int") for c in candidates), F.lit(0)) + 20.0 * F.greatest(*[F.col(f"{c}_clipped_fraction") for c in candidates]) + F.abs("raw_yaw") / 45.0 + F.greatest(F.lit(0.0), 1.0 - F.col("yunet_confidence")),
    }


def pairwise_differences(df: DataFrame, key: str, features: Sequence[str], angles: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per pair of candidates and feature the distribution of their differences (circular for
    angles): pair, feature, n, min, mean, std, median, p95, max.  Columns are ``candidate_feature``.

    Rows are taken apart by feature, then by pair, and the difference is written once, for all
    of them: with one expression a pair and feature, the code Spark makes of it outgrows what
    the JVM compiles.  Pairs and features are numbers until their rows are summed up."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    values = [F.struct(F.lit(i).alias("feature"), F.lit(f in angles).alias("angle"), *[F.col(f"{c}_{f}").cast("double").alias(f"of_{c}") for c in names]) for i, f in enumerate(features)]
    sides = [F.struct(F.lit(i).alias("pair"), F.col(f"of_{a}").alias("x"), F.col(f"of_{b}").alias("y")) for i, (a, b) in enumerate(pairs)]
    long = df.select(F.explode(F.array(*values)).alias("c")).select("c.*").select("feature", "angle", F.explode(F.array(*sides)).alias("p")).select("feature", "angle", "p.*")
    x, y = F.col("x"), F.col("y")
    long = long.select("pair", "feature", F.when(F.col("angle"), circular_difference(x, y)).otherwise(F.abs(x - y)).alias("d"))
    named = lambda of, c: F.get(F.array(*[F.lit(n) for n in of]), F.col(c)).alias(c)
    found = summarize(long, ["pair", "feature"], F.col("d"), (50, 95))
    return found.select(named([f"{a}_{b}" for a, b in pairs], "pair"), named(features, "feature"), *[c for c in found.columns if c not in ("pair", "feature")])


def fallback_chain(df: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """How a first detector and a fallback did: attempts, successes, rates, what the fallback
    recovered, and per source how often landmarks were found.  Rates without a base are 0."""
    n = lambda c: F.count_if(c)
    first, second = F.col("source_frame_index") != -1, F.col("yunet_attempted")
    is_hog, is_yunet = F.col("detector_source") == "HOG", F.col("detector_source") == "YUNET_FALLBACK"
    g = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("frames"), n(first).alias("hog_attempted"), n(F.col("hog_success")).alias("hog_success"), n(F.coalesce("hog_detection_count", F.lit(0)) > 1).alias("multiple_detection_count"),
        n(second).alias("yunet_attempted"), n(F.col("yunet_success")).alias("recovered"), n(is_hog | is_yunet).alias("final_success"),
        n(is_hog).alias("hog_landmark_attempted"), n(is_hog & F.col("landmark_success")).alias("hog_landmark_success"), n(is_yunet).alias("yunet_landmark_attempted"), n(is_yunet & F.col("landmark_success")).alias("yunet_landmark_success"),
        n(F.col("landmark_success")).alias("pose_attempted"), n(F.col("head_pose_valid")).alias("pose_success"),
    )
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    return g.withColumns({
        "hog_failure": F.col("hog_attempted") - F.col("hog_success"), "hog_success_rate": rate("hog_success", "hog_attempted"), "recovery_rate": rate("recovered", "yunet_attempted"),
        "final_success_rate": rate("final_success", "frames"), "hog_landmark_rate": rate("hog_landmark_success", "hog_landmark_attempted"), "yunet_landmark_rate": rate("yunet_landmark_success", "yunet_landmark_attempted"), "pose_success_rate": rate("pose_success", "pose_attempted"),
    })


def rates(df: DataFrame, value: str, values: Sequence[str], by: str | None = None) -> DataFrame:
    """scope, value, n, rate: how often each of the values stands, over all rows and for each value
    of ``by``, zeros included."""
    scopes = F.array(F.lit("overall"), *([F.col(by).cast("string")] if by else []))
    cells = F.array(*[F.struct(F.lit(v).alias("value"), F.coalesce(F.col(value) == v, F.lit(False)).alias("hit")) for v in values])
    d = df.select(F.explode(scopes).alias("scope"), cells.alias("cells")).select("scope", F.explode("cells").alias("c"))
    return d.groupBy("scope", "c.value").agg(F.count_if("c.hit").alias("n"), F.avg(F.col("c.hit").cast("double")).alias("rate"))


def review_errors(candidates: DataFrame, reviews: DataFrame, key: str, identity: Sequence[str], enums: Mapping[str, Sequence[str]], follows: tuple[str, str, Mapping[str, str]], optional: Sequence[str] = ()) -> DataFrame:
    """key and rule for every fault of a filled review sheet: a side without the other, identity
    columns that changed, values outside their enumeration (blank is allowed for optional
    columns), and a column that doesn't follow from another as ``follows`` (from, to, map) says."""
    a = candidates.select(key, *[F.col(c).alias(f"own_{c}") for c in identity], F.lit(True).alias("asked"))
    j = a.join(reviews.withColumn("answered", F.lit(True)), key, "full")
    there = F.col("asked").isNotNull() & F.col("answered").isNotNull()
    source, target, mapping = follows
    want = F.element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), F.col(source))
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = [
        ("NOT_REVIEWED", F.col("answered").isNull()), ("NOT_A_CANDIDATE", F.col("asked").isNull()),
        *[(f"IDENTITY:{c}", there & ~F.col(c).cast("string").eqNullSafe(F.col(f"own_{c}").cast("string"))) for c in identity],
        *[(f"VALUE:{c}", there & ~value(c).isin(list(v)) & ~((value(c) == "") & F.lit(c in optional))) for c, v in enums.items()],
        (f"FOLLOWS:{target}", there & F.col(source).isin(list(mapping)) & ~value(target).eqNullSafe(want)),
    ]
    return violations(j, [key], rules)


def template_errors(rows: DataFrame, key: str, ids: str, size: int, domains: Mapping[str, Sequence[str]], blank: Sequence[str] = ()) -> DataFrame:
    """rule and n: faults of a candidate list or a blank sheet, which should have ``size`` rows,
    dense numbers ``key`` from 0, ids that are there once and are plain names, values within their
    domains, and blank columns without a value."""
    twice = rows.groupBy(ids).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))
    a = rows.agg(
        (F.count(F.lit(1)) != size).cast("int").alias("ROW_COUNT"),
        ((F.min(key) != 0) | (F.max(key) != size - 1) | (F.count_distinct(key) != size)).cast("int").alias("ORDER"),
        F.count_if(F.coalesce(F.col(ids).cast("string"), F.lit("")).rlike(r"^$|[/\\]|^\.\.?$")).alias("PLAIN_ID"),
        *[F.count_if(~F.coalesce(F.col(c), F.lit("")).isin(list(v))).alias(f"DOMAIN:{c}") for c, v in domains.items()],
        *[F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"NOT_BLANK:{c}") for c in blank],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in a.columns])
    out = a.select(F.explode(pairs).alias("p")).select("p.rule", "p.n")
    return out.unionByName(twice.select(F.lit("REPEATED_ID").alias("rule"), "n"))


def against_expected(totals: DataFrame, expected: Mapping[str, float], tolerance: float = 0.0) -> DataFrame:
    """name, actual, expected, matches: named totals (name, value) against what they should be.
    A name on one side only doesn't match."""
    e = totals.sparkSession.createDataFrame([(k, float(v)) for k, v in expected.items()], "name string, expected double")
    j = totals.select("name", F.col("value").cast("double").alias("actual")).join(e, "name", "full")
    return j.withColumn("matches", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)))


def rewritten(sheet: DataFrame, rules: Mapping[str, Column], frozen: Sequence[str]) -> DataFrame:
    """A review sheet whose manual columns a rule fills in; frozen columns can't be among them."""
    wrong = set(rules) & set(frozen)
    if wrong:
        raise ValueError(f"columns {sorted(wrong)} must not change")
    return sheet.withColumns({c: F.coalesce(x.cast("string"), F.lit("")) for c, x in rules.items()})
