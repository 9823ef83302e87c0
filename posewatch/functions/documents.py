"""JSON documents written line by line, so that no row holds a list as long as a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["section", "item"]


def json_text(value: Column) -> Column:
    """The value as JSON; null is ``null``."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def document_lines(
    runs: DataFrame, members: Mapping[str, Column], lists: Mapping[str, DataFrame]
) -> DataFrame:
    """(run_id, section, item, line) of one document per run, in the order of ``ORDER``.

    ``members`` are JSON texts over ``runs``; each table of ``lists`` has (run_id, item,
    entry) with an item that orders the entries and is unique in its run. An entry is a
    line of its own; all but a run's first are led by the comma that parts them.
    """
    fixed = [F.lit("{"), *[F.concat(F.lit(f'"{name}": '), text, F.lit(",")) for name, text in members.items()]]
    sections = list(enumerate(fixed))
    tables = []
    for n, (name, entries) in enumerate(lists.items()):
        at = len(fixed) + 3 * n
        sections += [(at, F.lit(f'"{name}": [')), (at + 2, F.lit("]" if n == len(lists) - 1 else "],"))]
        first = entries.groupBy("run_id").agg(F.min("item").alias("__first"))
        comma = F.when(F.col("item") == F.col("__first"), "").otherwise(",")
        tables.append(
            entries.join(first, "run_id").select("run_id", F.lit(at + 1).alias("section"), "item", F.concat(comma, "entry").alias("line"))
        )
    sections.append((len(fixed) + 3 * len(lists), F.lit("}")))
    rows = F.array(*[F.struct(F.lit(i).alias("section"), text.alias("line")) for i, text in sections])
    out = runs.select("run_id", F.inline(rows)).select("run_id", "section", F.lit("").alias("item"), "line")
    for table in tables:
        out = out.unionByName(table)
    return out
