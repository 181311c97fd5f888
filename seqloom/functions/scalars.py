"""Parsing and small scalar rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true_strict(c: Column) -> Column:
    """'True' or 'False', else an error."""
    return F.when(c == "True", True).when(c == "False", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("null")))).cast("boolean"))


def is_true_lenient(c: Column) -> Column:
    """Whether the text is 'true' in any case; anything else is false."""
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def is_true_01(c: Column) -> Column:
    """true/1, false/0 in any case; null otherwise, for the caller to reject."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def review_flag(c: Column) -> Column:
    """A review sheet's tri-state: TRUE, FALSE, blank or N.A. (null)."""
    t = F.upper(F.trim(c))
    return F.when(t == "TRUE", True).when(t == "FALSE", False)


def finite(c: Column) -> Column:
    """The number, or null for blank, unreadable, NaN and infinite ones."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c.try_cast("double")) == float("inf"), F.lit(False))


def difference(a: Column, b: Column) -> Column:
    """Absolute difference; null if either is."""
    return F.abs(a - b)


def half_up(x: Column) -> Column:
    """Nearest integer, halves up (never to even)."""
    return F.floor(x + F.lit(0.5))


def normal_name(c: Column) -> Column:
    """A column name: trimmed, lower case, hyphens and white space as underscores."""
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), r"\s+", "_")


def normal_reference(c: Column) -> Column:
    """A path reference: trimmed, forward slashes, no leading dots or slashes, lower case."""
    return F.lower(F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), r"^[./]+", ""))


def safe_path(c: Column) -> Column:
    """Whether a path is relative, without '..' parts and backslashes."""
    return ~(c.rlike(r"^/|^[A-Za-z]:|\\") | c.rlike(r"(^|/)\.\.(/|$)"))


def two_by_two(a: Column, b: Column, both: str, only_a: str, only_b: str, neither: str) -> Column:
    """The name of a 2 x 2 cell."""
    return F.when(a & b, both).when(a, only_a).when(b, only_b).otherwise(neither)


def batch_position(i: Column, total: Column, size: int) -> Column:
    """Where item i of total stands if batches of ``size`` are taken in order."""
    batch = F.floor(i / F.lit(float(size))).cast("long")
    n = F.least(F.lit(size).cast("long"), total.cast("long") - batch * size)
    return F.struct(batch.alias("batch"), (i - batch * size).cast("long").alias("position"), n.alias("batch_size"), (n < size).alias("partial"))


def labels(*pairs: tuple[Column, str]) -> Column:
    """The labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def sample_id(split: Column, video: Column, time: Column) -> Column:
    """``split_video_t1p5``: a sample's name from its split, video and time."""
    return F.concat(split, F.lit("_"), video.cast("string"), F.lit("_t"), F.replace(time.cast("string"), F.lit("."), F.lit("p")))


def crop_path(slot: Column, index: Column) -> Column:
    """A crop's place in its bundle, with zero-padded numbers."""
    return F.format_string("context_crops/ctx_%02d_k%03d.jpg", slot, index)


def fitted(text: Column, width: int = 180) -> Column:
    """The text, or its beginning with ``...`` where it is longer than ``width``."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, max(0, width - 3)), F.lit("...")))


def shown(value: Column, digits: int = 3) -> Column:
    """A number with fixed digits; ``NA`` for null."""
    return F.when(value.isNull(), "NA").otherwise(F.format_string(f"%.{digits}f", value))


def percent(value: Column) -> Column:
    """A rate as a percentage with four digits."""
    return F.concat(F.format_string("%.4f", value * 100.0), F.lit("%"))


def overridden(name: str, configured, override, run_tag: str | None, allowed=lambda v: True):
    """A setting's value for one run: the override if there is one.  One that differs from the
    configured value needs a run tag, so that a baseline's results aren't written over."""
    if override is None:
        return configured
    if type(configured) is bool and type(override) is not bool or not allowed(override):
        raise ValueError(f"{name}: {override!r} is not allowed")
    if override != configured and not run_tag:
        raise ValueError(f"{name}: a value other than {configured!r} needs a run tag")
    return override


def resolved(configured: Column, override: Column, run_tag: Column, allowed: Column) -> Column:
    """``overridden`` for a table of runs: the value of each, null where it is refused."""
    refused = ~F.coalesce(allowed, F.lit(False)) | ((override != configured) & run_tag.isNull())
    return F.when(override.isNull(), configured).when(~refused, override)


def run_folder(seed: Column, run_tag: Column) -> Column:
    """The folder of each run of a table; null for a tag that is not allowed."""
    base = F.concat(F.lit("seed_"), seed.cast("string"))
    return F.when(run_tag.isNull(), base).when(run_tag.rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$"), F.concat(base, F.lit("_"), run_tag))


def run_names(model: str, seed: int, run_tag: str | None) -> tuple[str, str]:
    """A run's folder and its name."""
    if run_tag is not None and not re.fullmatch("[A-Za-z0-9][A-Za-z0-9_-]*", run_tag):
        raise ValueError("a run tag starts with a letter or digit and has letters, digits, _ and -")
    tail = f"_{run_tag}" if run_tag else ""
    return f"seed_{seed}{tail}", f"{model}_seed{seed}{tail}"
