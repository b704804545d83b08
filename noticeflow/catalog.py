"""The field catalog of a notice: keys, types, stages, defaults and the schemas made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions import dates, lots, money, text, types

VERSION = 2026041001


@dataclass(frozen=True)
class Field:
    key: str
    stage: str = "meta"
    type: str = "string"
    required: bool = False


# The fields of a notice, in order.
FIELDS = [
    Field("projectName"), Field("projectId"), Field("announcementDate", required=True), Field("bidOpenDate"),
    Field("budgetAmount", type="number"), Field("winnerAmount", type="number"),
    Field("estimatedAmount", "estimated_amount", required=True), Field("announcementType", required=True),
    Field("isEquipment", type="boolean"), Field("isOverseasProject", type="boolean"),
    Field("buyerAddressDetail", "address_detail"), Field("projectAddressDetail", "address_detail"), Field("deliveryAddressDetail", "address_detail"),
    *(Field(f"{who}{what}", "address_admin") for who in ("buyer", "project", "delivery") for what in ("Country", "Province", "City", "District")),
    Field("buyerName", "contacts", required=True), Field("buyerContact", "contacts"), Field("buyerPhone", "contacts"), Field("buyerEmail", "contacts"), Field("agency", "contacts"),
    Field("lotProducts", "lots", "array"), Field("lotCandidates", "lots", "array"),
]
ENVELOPE = ["announcementUrl", "announcementName", "announcementContent"]
TRUE_WORDS = ["true", "1", "yes", "是"]
UNDECIDED_WORDS = ["未知", "不确定", "unknown"]
LEGACY_STAGES = ["", "flat"]


def stage_name(stage: str | None) -> str:
    """The older names of the first stage."""
    return "meta" if (stage or "") in LEGACY_STAGES else stage


def fields(stage: str | None = None, own: list[Field] | None = None) -> list[Field]:
    return [f for f in (FIELDS if own is None else own) if stage is None or f.stage == stage_name(stage)]


def fields_from_yaml(source: str, stage: str | None = None) -> list[Field]:
    """SRC17: a catalog from YAML text: a list of fields, or a mapping that holds it as `fields`."""
    import yaml

    loaded = yaml.safe_load(source) or []
    rows = loaded.get("fields", []) if isinstance(loaded, dict) else loaded
    out = []
    for r in rows:
        if not r.get("key") or not r.get("name"):
            raise ValueError(f"a field needs key and name: {r}")
        out.append(Field(r["key"], stage_name(r.get("stage")), r.get("type", "string"), bool(r.get("required", False))))
    return [f for f in out if stage is None or f.stage == stage_name(stage)]


def item_type(f: Field) -> T.DataType:
    named = {"lotProducts": f"array<{lots.PRODUCT}>", "lotCandidates": f"array<{lots.CANDIDATE}>"}
    kinds = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>"}
    return T.DataType.fromDDL(named.get(f.key, kinds.get(f.type, "string")))


def raw_schema(stage: str, own: list[Field] | None = None) -> T.StructType:
    """The schema by which a recorded answer is read: texts, and rows of texts, coerced later."""
    named = {"lotProducts": lots.RAW_PRODUCTS, "lotCandidates": lots.RAW_CANDIDATES}
    kind = lambda f: named.get(f.key, "array<string>" if f.type == "array" else "string")
    return T.StructType([T.StructField(f.key, T.DataType.fromDDL(kind(f))) for f in fields(stage, own)])


def item_schema(own: list[Field] | None = None) -> T.StructType:
    head = [("dataId", "string"), ("version", "int"), ("inputTruncated", "boolean"), *((k, "string") for k in ENVELOPE)]
    return T.StructType([*(T.StructField(k, T.DataType.fromDDL(t)) for k, t in head), *(T.StructField(f.key, item_type(f)) for f in fields(own=own))])


def stage_prompt(stage: str, names: dict[str, str] | None = None) -> str:
    """TXT17: what a client is asked for at a stage: the fields in order, with type, need and the name
    given for them; answers are read by raw_schema and coerced, whatever they say."""
    empty = {"string": '""', "number": "null", "boolean": "true or false", "array": "[]"}
    wanted = fields(stage)
    if not wanted:
        raise ValueError(f"no fields of stage {stage}")
    lines = ["Extract these fields from the input as one JSON object:"]
    for i, f in enumerate(wanted, 1):
        lines.append(f"{i}. {f.key}{' - ' + names[f.key] if names and f.key in names else ''} ({f.type}, {empty[f.type]} if absent){' required' if f.required else ''}")
    return "\n".join([*lines, "Answer with the JSON alone."])


def default(f: Field) -> Column:
    """PRJ1: what a missing field holds."""
    if f.key == "isEquipment":
        return F.lit(True)
    kind = item_type(f)
    value = {"string": F.lit(""), "number": F.lit(None), "boolean": F.lit(False), "array": F.array()}[f.type]
    return (F.lit(None) if f.key == "bidOpenDate" else value).cast(kind)


def to_boolean(f: Field, c: Column) -> Column:
    s = F.lower(text.strip(c))
    if f.key == "isEquipment":
        return F.when((s == "") | s.isin(UNDECIDED_WORDS), True).otherwise(s.isin(TRUE_WORDS))
    return s.isin(TRUE_WORDS)


def coerced(f: Field, c: Column) -> Column:
    """PRJ3: a raw value of a field as its type."""
    if f.key == "announcementDate":
        return dates.normalize_date(c)
    if f.key == "bidOpenDate":
        return dates.bid_open_date(c)
    if f.key == "announcementType":
        return types.announcement_type_or_empty(c)
    if f.key == "lotProducts":
        return lots.products(c)
    if f.key == "lotCandidates":
        return lots.candidates(c)
    if f.type == "array":
        return F.filter(F.transform(c, text.fold_empty), lambda x: x != "")
    if f.type == "number":
        return money.to_yuan(c)
    if f.type == "boolean":
        return to_boolean(f, c)
    return text.fold_empty(c)


def conform(items: DataFrame, own: list[Field] | None = None) -> DataFrame:
    """PRJ1, PRJ2: the record's columns in order; unknown ones go, missing ones get defaults. own: the
    fields of another catalog."""
    have = set(items.columns)
    out = [(F.coalesce(F.col("dataId"), F.lit("")) if "dataId" in have else F.lit("")).alias("dataId"), F.lit(VERSION).alias("version"), (F.coalesce(F.col("inputTruncated"), F.lit(False)) if "inputTruncated" in have else F.lit(False)).alias("inputTruncated")]
    out += [(text.strip(F.col(k).cast("string")) if k in have else F.lit("")).alias(k) for k in ENVELOPE]
    for f in fields(own=own):
        out.append((F.coalesce(F.col(f.key).cast(item_type(f)), default(f)) if f.key in have else default(f)).alias(f.key))
    return items.select(*out, *(c for c in ("doc_id", "outcome_code", "detail_key") if c in have))
