"""The few functions Spark has no expression for. All are Arrow batches and opt-in."""
from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .similarity import sequence_ratio

__all__ = ["fold_nfd", "html_unescape", "sequence_ratio", "split_sections"]


@F.pandas_udf(StringType())
def fold_nfd(s: pd.Series) -> pd.Series:
    """Accent folding for scripts outside the translate table."""
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").lower().strip()

    return s.map(one)


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All named entities, where the common set of ``decode_entities`` is not enough."""
    return s.map(lambda x: None if x is None else html.unescape(x))


def split_sections(df, key: str, text: str, markers=None):
    """(key, field, segment) rows of description blobs; built from expressions, so a plain lateral explode."""
    from ..operators.pages import split_description
    from ..vocab.market import BLOB_MARKERS

    cut = split_description(text, markers or BLOB_MARKERS)
    return df.select(key, F.explode(cut).alias("field", "segment"))
