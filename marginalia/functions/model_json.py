"""Records out of model-written JSON: strict, fenced, or wrapped in prose.

A text that parses is taken as it is; else the first fenced object, else what lies
between the first { and the last }.  Whatever is not one JSON object is null.  Items are
read one by one, so a malformed one does not spoil its array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X

GAP_LEVELS = ("high", "mid")
LOCAL_EVIDENCE = "local uploaded paper context"
_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def json_objects(frame: DataFrame, raw: str, *keep: str) -> DataFrame:
    """``keep`` and the object of each text as VARIANT column ``found``, or null.

    Candidates are unnested, so each is parsed once and code stays small."""
    text = F.col(raw)
    wrapped = F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    both = frame.select(*keep, F.explode(F.array(F.struct(text.alias("strict"), wrapped.alias("wrapped")))).alias("_t"))
    # a lenient parser stops after the first value; the text must end where the object ends
    closed = F.col("_t.wrapped").rlike(r"(?s)^\{.*\}\s*$")
    parsed = F.coalesce(F.try_parse_json("_t.strict"), F.when(closed, F.try_parse_json("_t.wrapped")))
    one = both.select(*keep, F.explode(F.array(parsed)).alias("found"))
    return one.select(*keep, F.when(F.schema_of_variant("found").startswith("OBJECT"), F.col("found")).alias("found"))


def _text(item: Column, field: str) -> Column:
    return X.clean_text(F.try_variant_get(item, f"$.{field}", "string"))


def _list(item: Column, field: str) -> Column:
    return X.clean_list(F.try_variant_get(item, f"$.{field}", "array<string>"))


def items(frame: DataFrame, raw: str, key: str, array: str) -> DataFrame:
    """One row an array element: key, pos, item, is_object."""
    found = json_objects(frame, raw, key)
    rows = found.select(key, F.posexplode(F.try_variant_get("found", f"$.{array}", "array<variant>")).alias("pos", "item"))
    return rows.withColumn("is_object", F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)))


def gap_items(frame: DataFrame, raw: str, key: str, evidence: Column | None = None) -> DataFrame:
    """Valid gap items: key, pos, title, value_level, description, evidence_papers, warnings."""
    fallback = evidence if evidence is not None else F.array(F.lit(LOCAL_EVIDENCE))
    item = F.col("item")
    rows = items(frame, raw, key, "gaps").where("is_object").select(key, "pos", _text(item, "title").alias("title"), _text(item, "description").alias("description"), F.lower(_text(item, "value_level")).alias("level"), _list(item, "evidence_papers").alias("evidence"))
    rows = rows.where("title <> '' and description <> ''")
    known, none = F.col("level").isin(*GAP_LEVELS), F.size("evidence") == 0
    warnings = F.filter(
        F.array(
            F.when(~known, F.concat(F.lit("Level of gap '"), "title", F.lit("' read as mid."))),
            F.when(none, F.concat(F.lit("Evidence of gap '"), "title", F.lit("' filled in."))),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(key, "pos", "title", F.when(known, F.col("level")).otherwise("mid").alias("value_level"), "description", F.when(none, fallback).otherwise(F.col("evidence")).alias("evidence_papers"), warnings.alias("warnings"))


EXPERIMENT_LISTS = ("datasets", "metrics", "baselines", "steps", "risks")


def experiment_items(frame: DataFrame, raw: str, key: str) -> DataFrame:
    """Valid experiment items: an objective and five non-empty lists."""
    item = F.col("item")
    rows = items(frame, raw, key, "experiments").where("is_object").select(key, "pos", _text(item, "objective").alias("objective"), *[_list(item, c).alias(c) for c in EXPERIMENT_LISTS])
    full = F.col("objective") != ""
    for c in EXPERIMENT_LISTS:
        full = full & (F.size(c) > 0)
    return rows.where(full)


def with_fallback(frame: DataFrame, valid: DataFrame, key: str, default: dict[str, Column]) -> DataFrame:
    """The valid items, and one default record for each input row without any."""
    missing = frame.select(key).join(valid.select(key).distinct(), key, "left_anti")
    filled = missing.select(key, F.lit(0).alias("pos"), *[c.alias(name) for name, c in default.items()])
    return valid.select(key, "pos", *default).unionByName(filled)


def padded_support(papers: Column) -> Column:
    """Three to five support papers: the first five, or numbered placeholders up to three."""
    n = F.size(papers)
    fill = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("fallback-support-paper-"), i.cast("string")))
    return F.when(n >= 3, F.slice(papers, 1, 5)).otherwise(F.concat(papers, F.slice(fill, F.least(n, F.lit(2)) + 1, F.greatest(3 - n, F.lit(0)))))
