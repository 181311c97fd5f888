"""Rules of observed frames and of the bundles and sequences made of them.

A frame is a row (video_id, canonical_index 0..n-1) with the outcome of each step: yunet_success
(a face), landmark_success, pose_success, context_selected, context_crop_available, and the
values ear, mar and four pose angles.  Rules state faults; codes are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalars import finite, is_infinite, safe_path

from .integrity import scattered_groups, violations
from .resample import nearest_valid
from .runs import runs

POSE = ("pitch_raw", "pitch_centered_candidate", "yaw", "roll")
RATIOS = ("ear", "mar")
SPLITS = ("train", "val")
#: Values beyond it are reported.
OVERFLOW = 1_000_000


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _there(name: str) -> Column:
    return finite(F.col(name)).isNotNull()


def frame_rules() -> list[tuple[str, Column]]:
    """Ten faults of one frame; several may hold."""
    face, landmark, pose = F.col("yunet_success"), F.col("landmark_success"), F.col("pose_success")
    selected, crop = F.col("context_selected"), F.col("context_crop_available")
    sizes = [finite(F.col(c)) for c in ("bbox_width", "bbox_height", "frame_width", "frame_height")]
    values = [*RATIOS, *POSE]
    return [
        ("LANDMARK_SUCCESS_NONFINITE_EAR_MAR", landmark & ~_all([_there(c) for c in RATIOS])),
        ("LANDMARK_FAILURE_FINITE_EAR_MAR", ~landmark & _any([_there(c) for c in RATIOS])),
        ("POSE_SUCCESS_NONFINITE_VALUES", pose & ~_all([_there(c) for c in POSE])),
        ("POSE_FAILURE_FINITE_VALUES", ~pose & _any([_there(c) for c in POSE])),
        ("FEATURE_DEPENDENCY", (landmark & ~face) | (pose & ~landmark)),
        ("CROP_DEPENDENCY", crop & ~(selected & face)),
        ("DECODE_OR_SOURCE_INDEX", ~F.col("decode_ok") | ~F.col("source_index_in_range")),
        ("NUMERIC_INFINITY", _any([is_infinite(F.col(c)) for c in values])),
        ("NUMERIC_OVERFLOW_DIAGNOSTIC", _any([F.coalesce(F.abs(finite(F.col(c))) > OVERFLOW, F.lit(False)) for c in values])),
        ("INVALID_BBOX_OR_CONFIDENCE", face & (_any([s.isNull() | (s <= 0) for s in sizes]) | ~_there("yunet_confidence"))),
    ]


def frame_issues(frames: DataFrame, keys: Sequence[str] = ("video_id", "canonical_index")) -> DataFrame:
    """One row for each frame and fault: keys, rule."""
    return violations(frames, list(keys), frame_rules())


def distinct_below(value: Column, size: int) -> Column:
    """An aggregate: how many of the whole numbers 0..size-1 there are among the values, by a bit
    for each, so that a group's state has the same size however many rows it has."""
    words = [F.bit_or(F.when(value.between(k, min(k + 62, size - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), (value - k).cast("int")))) for k in range(0, size, 63)]
    return sum((F.coalesce(F.bit_count(w), F.lit(0)) for w in words), F.lit(0))


def _per_video(frames: DataFrame, slots: int, context: int) -> DataFrame:
    """Counts that whole-video rules need, in one aggregation after one window by video."""
    w = Window.partitionBy("video_id").orderBy("canonical_index")
    falls = lambda c: F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    d = frames.withColumn("falls", falls("target_timestamp_sec") | falls("source_frame_index"))
    chosen = F.when(F.col("context_selected"), F.col("context_slot"))
    dense = lambda n, low, high, distinct, size: (n == size) & (low == 0) & (high == size - 1) & (distinct == size)
    return d.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"),
        dense(F.count("canonical_index"), F.min("canonical_index"), F.max("canonical_index"), distinct_below(F.col("canonical_index"), slots), slots).alias("index_ok"),
        F.count_if(F.col("context_selected")).alias("n_selected"),
        F.coalesce(dense(F.count(chosen), F.min(chosen), F.max(chosen), distinct_below(chosen, context), context), F.lit(False)).alias("slots_ok"),
        F.count_if(F.col("falls")).alias("falls"),
        F.count_if(~F.col("split").isin(*SPLITS)).alias("other_split"),
        F.coalesce(F.min("label") == F.max("label"), F.lit(False)).alias("one_label"),
        F.min("label").alias("label"),
    )


def _codes(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    return violations(df, [key], rules).withColumnRenamed("rule", "error")


def bundle_errors(frames: DataFrame, markers: DataFrame | None = None, points: str | None = None, slots: int = 100, context: int = 32) -> DataFrame:
    """video_id and error for every fault of a bundle's frames: whole-bundle codes, and codes with
    ``:index`` for one frame.

    ``markers`` are (video_id, policy_hash, run_config_hash, canonical_row_count).  ``points``
    names a column of 68 points as [x, y] arrays, whose shape and missing values are checked.
    """
    v = _per_video(frames, slots, context)
    whole = _codes(v, "video_id", [
        ("CANONICAL_ROW_COUNT", F.col("n") != slots),
        ("CANONICAL_INDEX", ~F.col("index_ok")),
        ("TEST_OR_UNKNOWN_SPLIT", F.col("other_split") > 0),
        ("CONTEXT_SELECTION_COUNT", F.col("n_selected") != context),
        ("CONTEXT_SLOT_INDEX", ~F.col("slots_ok")),
        ("SAMPLING_ORDER", F.col("falls") > 0),
    ])
    face, landmark, pose, crop = (F.col(c) for c in ("yunet_success", "landmark_success", "pose_success", "context_crop_available"))
    empty = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | is_infinite(F.col(c))
    lost, kept = F.lit(False), F.lit(False)
    if points:
        p = F.flatten(points)
        bad = lambda x: F.coalesce(F.isnan(x), F.lit(True))
        lost = ~F.forall(p, bad)
        kept = F.exists(p, lambda x: bad(x) | (F.abs(x) == float("inf")))
    rules = [
        ("DEPENDENCY", (landmark & ~face) | (crop & ~face) | (crop & ~F.col("context_selected"))),
        ("LANDMARK_MISSING", ~landmark & (lost | ~_all([empty(c) for c in RATIOS]))),
        ("LANDMARK_VALID", landmark & kept),
        ("POSE_MISSING", ~pose & ~_all([empty(c) for c in POSE])),
        ("CONTEXT_FILE_MISSING", crop & F.coalesce(F.col("context_crop_relpath") == "", F.lit(True)) if "context_crop_relpath" in frames.columns else F.lit(False)),
    ]
    if points:
        rules.append(("LANDMARK_NPZ_SHAPE", (F.size(points) != 68) | F.exists(points, lambda q: F.size(q) != 2)))
    each = violations(frames, ["video_id", "canonical_index"], rules)
    each = each.select("video_id", F.concat_ws(":", "rule", "canonical_index").alias("error"))
    out = whole.unionByName(each)
    if markers is not None:
        j = v.join(markers, "video_id", "left")
        out = out.unionByName(_codes(j, "video_id", [("MARKER_HASH_MISSING", F.col("policy_hash").isNull() | F.col("run_config_hash").isNull()), ("MARKER_ROW_COUNT", F.coalesce(F.col("canonical_row_count") != slots, F.lit(True)))]))
    return out


def scan_errors(frames: DataFrame, videos: DataFrame, policy: str | None = None, slots: int = 100, context: int = 32) -> DataFrame:
    """video_id and error where frames and video metadata (video_id, label, policy_hash) don't
    agree.  Frames with the columns of ``scan_order`` are also checked for videos whose rows
    do not stand together in their files (SCATTERED)."""
    v = _per_video(frames, slots, context).withColumn("scanned", F.lit(True))
    m = videos.select("video_id", F.col("label").alias("known_label"), *(["policy_hash"] if policy else []), F.lit(True).alias("known"))
    out = _codes(v.join(m, "video_id", "full"), "video_id", [
        ("UNKNOWN_VIDEO", F.col("known").isNull()),
        ("NO_FRAMES", F.col("scanned").isNull()),
        ("ROW_COUNT", F.col("n") != slots),
        ("INDEX", ~F.col("index_ok")),
        ("CONTEXT_SLOTS", ~F.col("slots_ok")),
        ("LABEL", ~F.col("one_label") | (F.col("label") != F.col("known_label"))),
        ("ORDER", F.col("falls") > 0),
        *([("POLICY", F.col("policy_hash") != policy)] if policy else []),
    ])
    if {"scan_file", "scan_row"} <= set(frames.columns):
        out = out.unionByName(scattered_groups(frames, "video_id").select("video_id", F.lit("SCATTERED").alias("error")).distinct())
    return out


def video_counters(frames: DataFrame) -> DataFrame:
    """Per video the twelve totals that upstream summaries state."""
    yes = lambda c: F.count_if(F.col(c))
    n = lambda c: F.count(finite(F.col(c)))
    same = Window.partitionBy("video_id", "source_frame_index")
    d = frames.withColumn("shared", F.count(F.lit(1)).over(same) > 1)
    return d.groupBy("video_id").agg(
        yes("yunet_success").alias("yunet_success_count"), F.count_if(~F.col("yunet_success")).alias("yunet_failure_count"),
        yes("landmark_success").alias("landmark_success_count"), (yes("yunet_success") - yes("landmark_success")).alias("landmark_failure_count"),
        n("ear").alias("ear_valid_count"), n("mar").alias("mar_valid_count"), yes("pose_success").alias("pose_valid_count"),
        yes("context_selected").alias("context_selected_count"), yes("context_crop_available").alias("context_crop_available_count"),
        F.count_if(F.col("context_selected") & ~F.col("context_crop_available")).alias("context_crop_missing_count"),
        yes("decode_ok").alias("decoded_slots"), yes("shared").alias("duplicate_source_index_count"),
    )


def run_table(frames: DataFrame, slots: int = 100) -> DataFrame:
    """Runs of frames without a face: run_id, ends, length, their times, whether they touch the
    clip's ends, and how many selected and missing context slots they hold."""
    extra = [
        F.min("target_timestamp_sec").alias("start_timestamp_sec"), F.max("target_timestamp_sec").alias("end_timestamp_sec"),
        F.count_if(F.col("context_selected")).alias("context_slots_inside_run"),
        F.count_if(F.col("context_selected") & ~F.col("context_crop_available")).alias("context_missing_slots_inside_run"),
    ]
    r = runs(frames, ["video_id"], "canonical_index", ~F.col("yunet_success"), extra)
    return r.withColumns({"touches_clip_start": F.col("start") == 0, "touches_clip_end": F.col("end") == slots - 1})


def status_chain(frames: DataFrame) -> DataFrame:
    """decode_status, detector_status, landmark_status, pose_status, context_status and the joined
    failure_flags of each frame from the steps' outcomes, each step only after the one before:
    in_range, decode_ok, yunet_success, detector_reason, landmark_success, ear and mar (null:
    invalid), pose_success, context_selected, crop_failed."""
    in_range, decoded, face, landmark, pose = (F.col(c) for c in ("in_range", "decode_ok", "yunet_success", "landmark_success", "pose_success"))
    ran, reason = in_range & decoded, F.coalesce(F.nullif(F.col("detector_reason"), F.lit("")), F.lit("YUNET_FACE_NOT_FOUND"))
    seen, marked = ran & face, ran & face & landmark
    flags = F.array_compact(F.array(
        F.when(~in_range, "SOURCE_INDEX_OUT_OF_RANGE"), F.when(ran & ~face, reason), F.when(seen & ~landmark, "DLIB_LANDMARK_FAILED"),
        F.when(marked & F.col("ear").isNull(), "EAR_INVALID"), F.when(marked & F.col("mar").isNull(), "MAR_INVALID"), F.when(marked & ~pose, "POSE_FAILED"),
        F.when(seen & F.col("context_selected") & F.col("crop_failed"), "CONTEXT_CROP_FAILED"),
    ))
    return frames.withColumns({
        "decode_status": F.when(~in_range, "SOURCE_INDEX_OUT_OF_RANGE").when(decoded, "OK").otherwise("NOT_RUN"),
        "detector_status": F.when(seen, "OK").when(ran, reason).otherwise("NOT_RUN"),
        "landmark_status": F.when(marked, "OK").when(seen, "DLIB_LANDMARK_FAILED").otherwise("NOT_RUN"),
        "pose_status": F.when(marked & pose, "OK").when(marked, "POSE_FAILED").otherwise("NOT_RUN"),
        "context_status": F.when(~F.col("context_selected"), "NOT_SELECTED").when(seen & F.col("crop_failed"), "CONTEXT_CROP_FAILED").when(seen, "OK").when(ran, "CONTEXT_NO_FACE").otherwise("NOT_AVAILABLE"),
        "failure_flags": F.array_join(flags, ";"),
    })


def empty_frames(keys: DataFrame, slots: int, rate: float) -> DataFrame:
    """A row for every key and slot with the defaults of a frame that nothing was run on."""
    d = keys.withColumn("canonical_index", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("target_timestamp_sec", F.col("canonical_index") / F.lit(rate))
    d = d.withColumns({c: F.lit(False) for c in ("decode_ok", "yunet_success", "landmark_success", "pose_success", "context_crop_available")})
    d = d.withColumns({f"{c}_status": F.lit("NOT_RUN") for c in ("decode", "detector", "landmark", "pose")})
    return d.withColumns({c: F.lit(float("nan")) for c in (*RATIOS, *POSE)}).withColumn("failure_flags", F.lit(""))


def with_defaults(keys: DataFrame, observed: DataFrame, slots: int, rate: float) -> DataFrame:
    """``empty_frames`` with what was observed (video_id, canonical_index and some of its columns)
    in place of the defaults."""
    e = empty_frames(keys, slots, rate)
    own = [c for c in observed.columns if c in e.columns and c not in ("video_id", "canonical_index")]
    o = observed.select("video_id", "canonical_index", *[F.col(c).alias(f"seen_{c}") for c in own])
    j = e.join(o, ["video_id", "canonical_index"], "left")
    return j.withColumns({c: F.coalesce(f"seen_{c}", c) for c in own}).drop(*[f"seen_{c}" for c in own])


def sampling_plan(targets: DataFrame, frame_counts: DataFrame) -> DataFrame:
    """Slots (video_id, canonical_index, source_frame_index) with source_index_in_range (a target
    past the end stays without a source, it isn't moved) and source_index_duplicate (a later
    slot of a source that an earlier one has)."""
    w = Window.partitionBy("video_id", "source_frame_index").orderBy("canonical_index")
    d = targets.withColumn("source_index_duplicate", F.row_number().over(w) > 1)
    return d.join(frame_counts, "video_id").withColumn("source_index_in_range", F.col("source_frame_index") < F.col("frame_count"))


def context_plan_errors(plan: DataFrame, slots: int = 32, policy: tuple[str, str] | None = None) -> DataFrame:
    """video_id, target_context_index and error: an independent check of an imputation plan.

    The plan has a row for each target slot with target_canonical_index, target_timestamp_sec,
    original_available, imputed, source_context_index, source_canonical_index,
    source_timestamp_sec, source_image_relpath, imputation_offset_context_slots,
    imputation_distance_context_slots, imputation_offset_canonical_slots.  Sources must be
    originally available (no chained imputation), the nearest ones, and described as they
    describe themselves.  Errors of a whole video have the slot null.
    """
    key = ["video_id", "target_context_index"]
    d = nearest_valid(plan, ["video_id"], "target_context_index", F.col("original_available")).withColumnRenamed("source_slot", "expected_source")
    s = plan.select("video_id", F.col("target_context_index").alias("source_context_index"), F.col("original_available").alias("s_available"), F.col("target_canonical_index").alias("s_index"), F.col("target_timestamp_sec").alias("s_time"), F.col("source_image_relpath").alias("s_path"))
    d = d.join(s, ["video_id", "source_context_index"], "left")
    step = F.col("source_context_index") - F.col("target_context_index")
    rules = [
        ("MASKS", F.col("original_available") == F.col("imputed")),
        ("CHAINED_SOURCE", F.coalesce(~F.col("s_available"), F.lit(True))),
        ("NEAREST_SOURCE", ~F.col("source_context_index").eqNullSafe(F.col("expected_source"))),
        ("SOURCE_PROVENANCE", (F.col("source_canonical_index") != F.col("s_index")) | (F.col("source_timestamp_sec") != F.col("s_time")) | (F.col("source_image_relpath") != F.col("s_path"))),
        ("OFFSETS", (F.col("imputation_offset_context_slots") != step) | (F.col("imputation_distance_context_slots") != F.abs(step)) | (F.col("imputation_offset_canonical_slots") != F.col("source_canonical_index") - F.col("target_canonical_index"))),
        ("UNSAFE_PATH", ~safe_path(F.col("source_image_relpath"))),
    ]
    if policy:
        rules.append(("POLICY", (F.col("canonical_policy_hash") != policy[0]) | (F.col("sequence_missing_policy_hash") != policy[1])))
    each = violations(d, key, rules)
    v = plan.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("target_context_index").alias("low"), F.max("target_context_index").alias("high"), F.count_distinct("target_context_index").alias("distinct"))
    dense = (F.col("n") == slots) & (F.col("low") == 0) & (F.col("high") == slots - 1) & (F.col("distinct") == slots)
    whole = violations(v, ["video_id"], [("SLOTS", ~dense)]).select("video_id", F.lit(None).cast("int").alias("target_context_index"), "rule")
    return each.select(*key, "rule").unionByName(whole).withColumnRenamed("rule", "error")


def behavior_plan(frames: DataFrame) -> DataFrame:
    """Per video its frames as arrays in order, nothing interpolated: features (six 32-bit values a
    frame, NaN where there is none), feature_valid, detector_valid, landmark_valid, pose_valid,
    behavior_valid, and longest_missing_run of the detector."""
    names = (*RATIOS, *POSE)
    value = {c: F.coalesce(finite(F.col(c)), F.lit(float("nan"))) for c in names}
    ok = {c: finite(F.col(c)).isNotNull() for c in names}
    row = F.struct(
        F.col("canonical_index").alias("i"), F.array(*[value[c].cast("float") for c in names]).alias("f"), F.array(*[ok[c] for c in names]).alias("v"),
        F.col("yunet_success").alias("d"), F.col("landmark_success").alias("l"), (F.col("pose_success") & _all([ok[c] for c in POSE])).alias("p"),
        (F.col("yunet_success") & F.col("landmark_success") & _all([ok[c] for c in RATIOS])).alias("b"),
    )
    g = frames.groupBy("video_id", "split", "label").agg(F.array_sort(F.collect_list(row)).alias("r"))
    pick = lambda k: F.transform("r", lambda x: x[k])
    from seqloom.functions.vectors import longest_true

    missing = F.transform("r", lambda x: ~x["d"])
    return g.select("video_id", "split", "label", pick("f").alias("features"), pick("v").alias("feature_valid"), pick("d").alias("detector_valid"), pick("l").alias("landmark_valid"), pick("p").alias("pose_valid"), pick("b").alias("behavior_valid"), longest_true(missing).alias("longest_missing_run"))


def _frames_where(test) -> Column:
    """How many frames i of a packed plan have test(i)."""
    return F.size(F.filter(F.sequence(F.lit(0), F.size("features") - 1), test))


def _at(name: str, i: Column) -> Column:
    return F.get(F.col(name), i)


def behavior_anomalies(plan: DataFrame) -> DataFrame:
    """Per video the frames outside the behavior mask with finite ratios, those inside without,
    feature marks that don't fit their values, and infinite values."""
    good = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    ratios = lambda i: F.forall(F.slice(_at("features", i), 1, 2), good)
    marks = F.aggregate(F.zip_with("features", "feature_valid", lambda f, v: F.size(F.filter(F.zip_with(f, v, lambda x, m: good(x) != m), lambda x: x))), F.lit(0), lambda a, b: a + b)
    infinite = F.aggregate(F.transform("features", lambda f: F.size(F.filter(f, lambda x: F.abs(x) == float("inf")))), F.lit(0), lambda a, b: a + b)
    return plan.select("video_id", _frames_where(lambda i: ~_at("behavior_valid", i) & ratios(i)).alias("false_mask_with_required_finite"), _frames_where(lambda i: _at("behavior_valid", i) & ~ratios(i)).alias("required_valid_nan"), marks.alias("feature_valid_mask_mismatch"), infinite.alias("infinity"))


def behavior_plan_errors(plan: DataFrame, frames: DataFrame, slots: int = 100) -> DataFrame:
    """video_id and error: shape, infinite values, masks that don't follow from the others, a wrong
    longest run, and values that are not those of the frames."""
    from seqloom.functions.vectors import longest_true

    a = plan.join(behavior_anomalies(plan), "video_id")
    masks = ("detector_valid", "landmark_valid", "pose_valid", "behavior_valid", "feature_valid")
    expected = lambda i: _at("detector_valid", i) & _at("landmark_valid", i) & F.forall(F.slice(_at("feature_valid", i), 1, 2), lambda x: x)
    own = behavior_plan(frames).select("video_id", F.col("features").alias("own_features"))
    j = a.join(own, "video_id", "left")
    text = lambda c: F.transform(c, lambda f: F.transform(f, lambda x: x.cast("string")))
    return _codes(j, "video_id", [
        ("SHAPE", (F.size("features") != slots) | _any([F.size(m) != slots for m in masks]) | F.exists("features", lambda f: F.size(f) != len(RATIOS) + len(POSE))),
        ("INFINITY", F.col("infinity") > 0),
        ("FEATURE_MASK", F.col("feature_valid_mask_mismatch") > 0),
        ("BEHAVIOR_MASK", _frames_where(lambda i: _at("behavior_valid", i) != expected(i)) > 0),
        ("REQUIRED_NAN", F.col("required_valid_nan") > 0),
        ("MISSING_RUN", F.col("longest_missing_run") != longest_true(F.transform("detector_valid", lambda x: ~x))),
        ("CANONICAL_VALUES", ~text("features").eqNullSafe(text("own_features"))),
    ])


def representative_slots(frames: DataFrame, reasons: DataFrame, slots: int = 100, most: int = 5) -> DataFrame:
    """video_id and up to five slots to look at, by why the video was chosen (video_id, reason):
    the longest run without a face with its neighbours, context slots that are missing, a
    single miss with its neighbours, or the clip's ends and middle.  Null where the reason
    doesn't fit the frames."""
    row = F.struct(F.col("canonical_index").alias("i"), F.col("yunet_success").alias("face"), F.col("context_selected").alias("sel"), F.col("context_crop_available").alias("crop"))
    packed = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    run = F.struct((-F.col("length")).alias("order"), F.col("start"), F.col("end"))
    r = runs(frames, ["video_id"], "canonical_index", ~F.col("yunet_success")).groupBy("video_id").agg(F.min(run).alias("long"), F.min(F.when(F.col("length") == 1, F.col("start"))).alias("single"))
    d = reasons.join(packed, "video_id").join(r, "video_id", "left")
    index = lambda test: F.transform(F.filter("r", test), lambda x: x["i"])
    valid, lost = index(lambda x: x["face"]), index(lambda x: x["sel"] & ~x["crop"])
    d = d.withColumns({"valid": valid, "lost": lost, "good": index(lambda x: x["sel"] & x["crop"]), "reasons": F.split("reason", ";")})
    has = lambda *names: F.arrays_overlap("reasons", F.array(*map(F.lit, names)))
    start, end = F.col("long.start"), F.col("long.end")
    around = F.array(F.array_max(F.filter("valid", lambda i: i < start)), start, F.floor((start + end) / 2).cast("int"), end, F.array_min(F.filter("valid", lambda i: i > end)))
    n = F.size("lost")
    some = F.transform(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1), lambda i: F.get("lost", i))
    near = F.array_min(F.transform("good", lambda g: F.struct(F.array_min(F.transform(some, lambda m: F.abs(g - m))).alias("far"), g.alias("i"))))["i"]
    single = F.filter(F.array(F.col("single") - 1, F.col("single"), F.col("single") + 1), lambda i: (i >= 0) & (i < slots))
    fixed = lambda *v: F.array(*map(F.lit, v))
    missing = F.size("r") - F.size("valid")
    chosen = (
        F.when(missing == slots, fixed(0, slots // 4, slots // 2, slots * 3 // 4, slots - 1))
        .when(has("longest_consecutive_run", "highest_missing_count") & F.col("long").isNotNull(), around)
        .when(has("highest_context_missing"), F.when(n > 0, F.concat(some, F.array(near))))
        .when(has("isolated_single_miss"), F.when(F.col("single").isNotNull(), single))
        .when(has("zero_missing_reference") & (missing == 0), fixed(0, slots // 2, slots - 1))
    )
    return d.select("video_id", F.slice(F.array_sort(F.array_distinct(F.array_compact(chosen))), 1, most).alias("slots"))


def sequence_errors(df: DataFrame, key: str, slot: str, vector: str, original: str, imputed: str, slots: int, size: int) -> DataFrame:
    """key and rule for each fault of packed sequences, given as a row a slot: dense slots, vectors
    of one size with finite values, masks that are each other's complement."""
    good = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(slot).alias("low"), F.max(slot).alias("high"), F.count_distinct(slot).alias("distinct"), F.count_if(F.size(vector) != size).alias("shape"),
        F.count_if(~F.forall(vector, good)).alias("bad"), F.count_if(F.col(original) == F.col(imputed)).alias("masks"),
    )
    dense = (F.col("n") == slots) & (F.col("low") == 0) & (F.col("high") == slots - 1) & (F.col("distinct") == slots)
    return violations(g, [key], [("SLOTS", ~dense), ("SHAPE", F.col("shape") > 0), ("NOT_FINITE", F.col("bad") > 0), ("MASKS", F.col("masks") > 0)])
