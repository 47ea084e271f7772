"""Font name keys. Unicode normalisation has no Spark built-in, so these two
small string functions run as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def _nfkc(name: str) -> str:
    return unicodedata.normalize("NFKC", name.strip()).casefold()


def _folded(name: str) -> str:
    wide = unicodedata.normalize("NFKC", name)
    plain = "".join(
        ch for ch in unicodedata.normalize("NFD", wide) if not unicodedata.combining(ch)
    )
    return unicodedata.normalize("NFC", plain).casefold()


@F.pandas_udf(StringType())
def _alias_key(names: pd.Series) -> pd.Series:
    return names.map(_nfkc, na_action="ignore")


@F.pandas_udf(StringType())
def _strict_key(names: pd.Series) -> pd.Series:
    return names.map(_folded, na_action="ignore")


def _key(c: Column, plain: Column, full) -> Column:
    """Plain rule for ASCII names; only the other names travel to Python."""
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(F.when(ascii_only, plain), full(F.when(~ascii_only, c)))


def alias_key(c: Column) -> Column:
    """NFKC plus case folding of the trimmed name."""
    return _key(c, F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), _alias_key)


def strict_key(c: Column) -> Column:
    """Key without case, diacritics and width."""
    return _key(c, F.lower(c), _strict_key)


def compact_key(c: Column) -> Column:
    """Strict key reduced to letters, marks and digits."""
    return F.regexp_replace(strict_key(c), r"[^\p{L}\p{M}\p{N}]", "")


def trimmed_name(c: Column) -> Column:
    name = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(name != "", name)
