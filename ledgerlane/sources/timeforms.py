"""Text forms of timestamps other than ISO: one form per column, declared or found by counting.

A column's form is kept in the column's metadata, so that rules, loads and models parse it with
one expression and no argument. ``infer_times`` counts in one aggregate how many values fit each
form and takes the form that most values fit; whatever does not fit it is unparseable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions import exprs as X


def infer_forms(df: DataFrame, columns: Sequence[str], forms: Sequence[str] = tuple(X.TIME_FORMS)) -> dict[str, str]:
    """The form that most values of each text column fit; of equals the one named first."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return {}
    fits = [
        F.count(X.parse_form(F.col(f"`{c}`"), form)).alias(f"{i}_{j}") for i, c in enumerate(texts) for j, form in enumerate(forms)
    ]
    counts = df.agg(*fits).first()
    return {c: max(forms, key=lambda form: (counts[f"{i}_{forms.index(form)}"], -forms.index(form))) for i, c in enumerate(texts)}


def declare_times(df: DataFrame, forms: Mapping[str, str]) -> DataFrame:
    """``df`` whose named text columns are parsed in the given forms from here on."""
    for column, form in forms.items():
        if form not in X.TIME_FORMS:
            raise ValueError(f"unknown time form: {form}")
        df = df.withMetadata(column, {**df.schema[column].metadata, X.TIME_FORM: form})
    return df


def infer_times(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the form of each text column found by counting; one pass over the rows."""
    return declare_times(df, infer_forms(df, columns))
