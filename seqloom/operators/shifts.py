"""Rules that name a difference between splits, models or versions.  Thresholds are fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import first_of, outside


def _count(conditions: Sequence[Column]) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def sequence_shift(total_gap: Column, any_gap: Column, p95_gap: Column, run_gap: Column, slot_gap: Column) -> Column:
    """From validation minus training: imputation rate, rate of clips with any, 95th percentile of
    imputed slots, longest run, largest gap of a slot's rate."""
    signals = _count([total_gap >= 0.01, any_gap >= 0.05, p95_gap >= 1, run_gap >= 1])
    return first_of([
        (signals >= 3, "POSSIBLE_SEQUENCE_QUALITY_SHIFT"),
        ((F.abs(total_gap) < 0.01) & (slot_gap >= 0.05), "LOCALIZED_SLOT_SHIFT"),
        ((signals > 0) | (F.abs(total_gap) >= 0.005) | (F.abs(any_gap) >= 0.03) | (slot_gap >= 0.03), "MIXED"),
    ], "NO_OBVIOUS_SEQUENCE_QUALITY_SHIFT")


def outside_metrics(medians: Sequence[Column], lows: Sequence[Column], highs: Sequence[Column]) -> Column:
    """How many medians stand outside the other side's range."""
    return _count([outside(m, a, b) for m, a, b in zip(medians, lows, highs, strict=True)])


def model_signals(n_outside: Column, dimension_p95: Column, cosine: Column) -> Column:
    """Signals of a shift of one model's features: medians outside, a large dimension shift, means
    that point elsewhere.  Two or more flag the model."""
    return n_outside + _count([dimension_p95 >= 0.5, cosine < 0.99])


def feature_shift(flagged: Column, models: int, conditional: Column, any_signal: Column) -> Column:
    """From how many models are flagged, whether a label's metrics shift (two or more) in some
    model, and whether there is any signal at all."""
    return first_of([(flagged == models, "POSSIBLE_FEATURE_DISTRIBUTION_SHIFT"), (flagged == 1, "BACKBONE_SPECIFIC_SHIFT"), (conditional, "LABEL_CONDITIONAL_SHIFT"), (any_signal, "MIXED")], "NO_OBVIOUS_FEATURE_DISTRIBUTION_SHIFT")


def temporal_pattern(split_shift: Column, redundant: Column, label_pattern: Column) -> Column:
    """One pattern's name, or MIXED for several."""
    return first_of([(_count([split_shift, redundant, label_pattern]) > 1, "MIXED"), (split_shift, "POSSIBLE_TEMPORAL_SPLIT_SHIFT"), (redundant, "POSSIBLE_TEMPORAL_REDUNDANCY"), (label_pattern, "LABEL_CONDITIONAL_TEMPORAL_PATTERN")], "NO_OBVIOUS_TEMPORAL_SHIFT")


def loss_result(top_share: Column, shared_top: Column, only_a: Column, only_b: Column, both: Column) -> Column:
    """Where a validation loss comes from: a few samples, samples hard for both models, or errors
    of one model."""
    shared, specific = shared_top >= 10, only_a + only_b > both
    return first_of([(top_share >= 0.5, "LOSS_CONCENTRATED_IN_FEW_SAMPLES"), (shared & specific, "MIXED"), (shared, "SHARED_BACKBONE_HARD_SAMPLES"), (specific, "BACKBONE_SPECIFIC_HARD_SAMPLES")], "BROAD_VALIDATION_DIFFICULTY")


def review_result(quality: Sequence[tuple[Column, Column]], brief: tuple[Column, Column], concern: tuple[Column, Column]) -> Column:
    """From pairs of rates (hard samples, controls): a pattern holds at a rate of half or more that
    is 0.2 above the controls'."""
    holds = lambda p: (p[0] >= 0.5) & (p[0] - p[1] >= 0.2)
    q = _count([holds(p) for p in quality]) > 0
    return first_of([(_count([q, holds(brief), holds(concern)]) > 1, "MIXED"), (q, "VISUAL_DATA_QUALITY_PATTERN"), (holds(brief), "BRIEF_OR_AMBIGUOUS_TEMPORAL_CUES"), (holds(concern), "POSSIBLE_LABEL_AMBIGUITY")], "NO_OBVIOUS_VISUAL_EXPLANATION")


def difference_cause(mapping_differs: Column, shapes_differ: Column, reruns: Column, batch_explains: Column) -> Column:
    """Why two versions differ, the gravest cause first."""
    return first_of([(mapping_differs, "SOURCE MAPPING BUG"), (shapes_differ, "FEATURE EXTRACTION BUG"), (reruns == 0, "UNRESOLVED"), (batch_explains, "BENIGN FLOATING-POINT / BATCH NUMERICAL DIFFERENCE")], "UNRESOLVED")
