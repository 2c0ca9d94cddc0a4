"""Values packed and unpacked one by one, for tables that keep them so; Parquet needs neither."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def packed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: zlib.compress(v.encode()), na_action="ignore")


@F.pandas_udf(T.StringType())
def unpacked(values: pd.Series) -> pd.Series:
    """Null for what is no packed text."""

    def one(v: bytes) -> str | None:
        try:
            return zlib.decompress(v).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    return values.map(one, na_action="ignore")
