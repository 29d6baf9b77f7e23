"""Stable row identifiers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _joined(text, header_path, fname, ts_ms):
    return F.concat(
        text, F.coalesce(header_path, F.lit("")), F.coalesce(fname, F.lit("")),
        F.coalesce(ts_ms.cast("string"), F.lit("")),
    )


def stable_uid(text: Column, header_path: Column, fname: Column, ts_ms: Column) -> Column:
    """128-bit id of a section from its text, path, file and time (SHA-256 based)."""
    return F.substring(F.sha2(_joined(text, header_path, fname, ts_ms), 256), 1, 32)


@F.pandas_udf(T.StringType())
def _blake2s_128(keys: pd.Series) -> pd.Series:
    return keys.map(lambda s: hashlib.blake2s(s.encode("utf-8"), digest_size=16).hexdigest())


def stable_uid_blake2s(text: Column, header_path: Column, fname: Column, ts_ms: Column) -> Column:
    """The BLAKE2s-128 form, for tables that already hold such ids."""
    return _blake2s_128(_joined(text, header_path, fname, ts_ms))


def fallback_uid(fname: Column, header_path: Column, text: Column,
                 chunk_size: int = 1024, overlap: int = 120) -> Column:
    """``n_`` plus 24 hex digits over file, path, chunk settings and text digest."""
    key = F.concat_ws(
        "|", F.coalesce(fname, F.lit("")), F.coalesce(header_path, F.lit("/")),
        F.lit(str(chunk_size)), F.lit(str(overlap)), F.sha1(text),
    )
    return F.concat(F.lit("n_"), F.substring(F.sha1(key), 1, 24))
