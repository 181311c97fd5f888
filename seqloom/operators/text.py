"""Review texts: blocks with id ranges and key: value fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = r"(?m)^REVIEW\s+(\d+)(?:~(\d+))?\s*$"


def review_blocks(df: DataFrame, text: Column) -> DataFrame:
    """One row for each id a ``REVIEW nn`` or ``REVIEW nn~mm`` block names: review_id (zero-padded),
    and its ``key:`` lines' values as a map (the text up to the next key, trimmed)."""
    parts = F.filter(F.split(text, r"(?m)(?=^REVIEW\s+\d)"), lambda p: p.rlike(HEADER))
    d = df.select(F.explode(parts).alias("block"))
    first = F.regexp_extract("block", HEADER, 1).cast("int")
    last = F.nullif(F.regexp_extract("block", HEADER, 2), F.lit("")).cast("int")
    body = F.regexp_replace("block", HEADER, "")
    fields = F.filter(F.split(body, r"(?m)(?=^[a-z_]+:)"), lambda p: p.rlike(r"^[a-z_]+:"))
    entries = F.map_from_entries(F.transform(fields, lambda p: F.struct(F.regexp_extract(p, r"^([a-z_]+):", 1), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[a-z_]+:\s*", ""), r"\s+$", "")))))
    return d.select(F.explode(F.sequence(first, F.coalesce(last, first))).alias("n"), entries.alias("fields")).select(F.format_string("%02d", "n").alias("review_id"), "fields")


def prefilled(template: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A sheet whose manual columns are blank but for known rows; all other columns as they are."""
    k = known.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    j = template.join(k, key, "left")
    return j.withColumns({c: F.coalesce(f"__{c}", F.lit("")) for c in columns}).drop(*[f"__{c}" for c in columns])
