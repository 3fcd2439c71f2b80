"""Unicode normalisation, which the JVM side lacks: Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc_key(s: pd.Series) -> pd.Series:
    """NFKC, runs of white space as one space, casefolded; null stays null."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")
