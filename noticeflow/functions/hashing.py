"""The content hash of a record."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields that don't count.
NOT_HASHED = ["dataId", "version", "inputTruncated"]
#: Columns beside a record's own.
BESIDES = ["doc_id", "outcome_code", "detail_key"]


def canonical(record: dict) -> str:
    """Compact JSON with sorted keys and unescaped text."""
    return json.dumps({k: v for k, v in record.items() if k not in NOT_HASHED}, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def plain(x):
    """A row of an Arrow batch as dicts and lists; NaN, which stands for null in numbers, as None."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and x != x else x


def with_data_id(items: DataFrame, name: str = "dataId", besides: list[str] = BESIDES) -> DataFrame:
    """HSH1: items with the SHA-256 of their canonical JSON, exact to the byte: numbers print as they
    do in that form, which Spark's own JSON doesn't match, so this is an Arrow function."""
    fields = [f for f in items.columns if f not in NOT_HASHED and f not in besides]

    @F.pandas_udf(T.StringType())
    def digest(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([hashlib.sha256(canonical(plain(r)).encode()).hexdigest() for r in rows.to_dict("records")])

    return items.withColumn(name, digest(F.struct(*(F.col(f) for f in fields))))


def native_data_id(fields: dict[str, Column]) -> Column:
    """The same for texts and whole numbers alone, as built-in functions."""
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields) if k not in NOT_HASHED)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)
