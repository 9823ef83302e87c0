"""Scans of prepared-input files: index groups, settings, includes, structures.

Input is (path, text), one file per row. Everything is split inside the row, so
the order of lines is kept without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch.functions import text
from posewatch.functions.settings import normalise_key


def scan_index(files: DataFrame) -> DataFrame:
    """(path, group_ord, group, pos, atom, reason) of index files.

    The text is cut in front of every header line, so each piece holds one group
    and no state has to be carried from line to line. A header gives one row with
    pos 0 and no atom; a file without groups gives one row with group_ord 0.
    """
    blank = "[" + "".join(
        rf"\x{{{c:x}}}" for c in text.SPACE_CODES if c not in text.LINE_END_CODES
    ) + "]*"
    header = rf"{blank}\[[^\n]*\]{blank}$"
    unix = F.regexp_replace("text", text.TEXT_LINE_END, "\n")
    pieces = files.select("path", F.split(unix, rf"(?dm)^(?={header})").alias("pieces"))
    lines = F.transform(F.split("piece", "\n"), text.strip)
    groups = (
        pieces.select("path", F.posexplode("pieces").alias("i", "piece"))
        .select("path", "i", lines.alias("lines"))
        .withColumn("first", F.get("lines", F.lit(0)))
        .withColumn(
            "is_group",
            F.col("first").startswith("[")
            & F.col("first").endswith("]")
            & (F.length("first") > 1),
        )
        .withColumn(
            "group",
            F.when(
                F.col("is_group"), text.strip(F.expr("substring(first, 2, length(first) - 2)"))
            ),
        )
        .withColumn(
            "words",
            F.flatten(
                F.transform(
                    F.filter(
                        F.when(F.col("is_group"), F.slice("lines", 2, F.size("lines"))).otherwise(
                            F.col("lines")
                        ),
                        lambda x: (x != "") & ~x.startswith(";"),
                    ),
                    text.words,
                )
            ),
        )
        .select("path", "i", "is_group", "group", "words")
    )
    atoms = groups.select(
        "path", "i", "is_group", "group", F.posexplode("words").alias("w", "word")
    ).withColumn("atom", text.parse_int(F.col("word")))
    atom_reason = (
        F.when(~F.col("is_group"), "atoms_before_header")
        .when(F.col("atom").isNull(), "non_integer")
        .when(F.col("atom") < 1, "not_positive")
    )
    group_ord = F.when(F.col("is_group"), F.col("i") + 1).otherwise(0)
    atom_rows = atoms.select(
        "path",
        group_ord.alias("group_ord"),
        "group",
        (F.col("w") + 1).alias("pos"),
        "atom",
        atom_reason.alias("reason"),
    )
    header_rows = groups.filter("is_group").select(
        "path",
        group_ord.alias("group_ord"),
        "group",
        F.lit(0).alias("pos"),
        F.lit(None).cast("bigint").alias("atom"),
        F.when(F.col("group") == "", "empty_group_name").alias("reason"),
    )
    any_header = F.exists(
        F.transform("pieces", lambda p: F.substring_index(p, "\n", 1)),
        lambda line: line.rlike("^" + header),
    )
    no_groups = pieces.filter(~any_header).select(
        "path",
        F.lit(0).alias("group_ord"),
        F.lit(None).cast("string").alias("group"),
        F.lit(0).alias("pos"),
        F.lit(None).cast("bigint").alias("atom"),
        F.lit("no_groups").alias("reason"),
    )
    return atom_rows.unionByName(header_rows).unionByName(no_groups)


def scan_settings(files: DataFrame) -> DataFrame:
    """(file columns, line_no, key, value, reason) of stage settings files."""
    kept = [c for c in files.columns if c != "text"]
    content = F.transform(
        F.split("text", text.TEXT_LINE_END),
        lambda line, i: F.struct(
            (i + 1).alias("line_no"), text.strip(F.substring_index(line, ";", 1)).alias("line")
        ),
    )

    def setting(x: Column) -> Column:
        sides = F.split(x["line"], "=", 2)
        return F.struct(
            x["line_no"].alias("line_no"),
            F.size(sides).alias("n"),
            text.strip(F.get(sides, F.lit(0))).alias("key"),
            text.strip(F.get(sides, F.lit(1))).alias("value"),
        )

    settings = F.transform(F.filter(content, lambda x: x["line"] != ""), setting)
    return files.select(*kept, F.inline(settings)).select(
        *kept,
        "line_no",
        F.when(F.col("n") == 2, normalise_key(F.col("key"))).alias("key"),
        F.nullif("value", F.lit("")).alias("value"),
        F.when(F.col("n") == 1, "no_equals").when(F.col("value") == "", "empty_value").alias("reason"),
    )


# Fixed value: include directive.
INCLUDE = r'(?dm)^\s*#include\s+"([^"]+)"'


def scan_includes(files: DataFrame) -> DataFrame:
    """(file columns, include) for each quoted include of a topology text."""
    kept = [c for c in files.columns if c != "text"]
    unix = F.regexp_replace("text", text.FILE_LINE_END, "\n")
    return files.select(*kept, F.explode(F.regexp_extract_all(unix, F.lit(INCLUDE), 1)).alias("include"))


def structure_atom_count(content_text: Column) -> Column:
    """The atom count on the second line of a structure file, null when it is none."""
    return text.parse_int(text.strip(F.get(F.split(content_text, text.FILE_LINE_END), F.lit(1))))
