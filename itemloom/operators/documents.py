"""Strict validation of JSON documents in text columns."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"int": (int,), "float": (int, float), "str": (str,), "bool": (bool,), "list": (list,), "dict": (dict,)}


def object_fault(text: str | None, fields: dict[str, str]) -> str | None:
    """Why *text* is not exactly one JSON object with exactly these keys and types (true is no int), or None."""
    if text is None:
        return "missing"
    try:
        value = json.loads(text)
    except ValueError:
        return "not_json"
    if not isinstance(value, dict):
        return "not_object"
    if value.keys() != fields.keys():
        return "keys"
    for k, t in fields.items():
        if type(value[k]) not in _TYPES[t] or (t == "float" and not math.isfinite(value[k])):
            return f"type:{k}"
    return None


def strict_object(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """*df* with reason (null if the document is valid) and valid. Spark's own parser takes trailing text, so this is Arrow-batched."""

    @F.pandas_udf("string")
    def fault(texts: pd.Series) -> pd.Series:
        return pd.Series([object_fault(t, fields) for t in texts], dtype=object)

    return df.withColumn("reason", fault(column)).withColumn("valid", F.col("reason").isNull())


def canonical_json(text: str) -> str:
    """Sorted keys, no spaces, letters kept as they are."""
    return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical(df: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical_json(t))

    return df.withColumn(name, run(column))


def signed(df: DataFrame, column: str, key: bytes, name: str = "signature") -> DataFrame:
    """HMAC-SHA256 of a text, in hex. The key travels in the closure and is never logged."""
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return df.withColumn(name, run(column))
