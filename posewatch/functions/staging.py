"""Keeping an expensive expression evaluated once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, keep: Sequence[str | Column], **columns: Column) -> DataFrame:
    """Select ``keep`` and new columns that later steps refer to but never repeat.

    A filter on a derived column is pushed below the projection by copying its
    expression. Parsing a whole text is too dear for that, so the values pass
    through a one-row generator, which expressions are not copied across.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
