"""Scalar functions of texts and numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def titled(text: Column) -> Column:
    """The first letter of each run of letters upper, the others lower: a run ends at anything that isn't a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def fallback_name(title_id: Column) -> Column:
    """A name for a title without a label: its id without the rank, underscores as spaces, titled."""
    return titled(F.translate(F.substring(title_id, 3, 1 << 30), "_", " "))


def unscoped(text: Column, *scopes: str) -> Column:
    """A reference without its scope (`title:`, `culture:`, `faith:`, `flag:`)."""
    return F.regexp_replace(text, f"^(?:{'|'.join(scopes or ('title', 'culture', 'faith', 'flag'))}):", "")


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition of Unicode; the JVM functions of Spark have none."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(StringType())
def casefolded(text: pd.Series) -> pd.Series:
    return text.str.casefold()
