"""Removing private paths, tokens and secrets from text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacement texts and patterns.
PATH_MARK = "<REDACTED_PATH>"
SECRET_MARK = "<REDACTED>"
ABSOLUTE_PATH = r"(?<![A-Za-z0-9_.-])/(?:[^/\s,:;]+/)*[^/\s,:;]+"
SECRET_PAIR = r"\b(token|password|secret|api[_-]?key)=\S+"
BUILD_PATH = r"(?:/[A-Za-z0-9._+~-]+)*/([A-Za-z0-9._+~-]+)"
TRIVIAL_LITERALS = {"", "/", "\\", ".", ".."}


def redact_paths(value: Column) -> Column:
    return F.regexp_replace(value, "(?U)" + ABSOLUTE_PATH, PATH_MARK)


def longest_first(values: Iterable[str]) -> list[str]:
    return sorted(set(values), key=lambda v: (-len(v), v))


def redact_log(value: Column, literals: Iterable[str] = (), tokens: Iterable[str] = ()) -> Column:
    """Known literals, then whole tokens, then ``key=value`` secrets.

    Longer literals go first so that a path is not cut by its own prefix.
    """
    out = value
    for literal in longest_first(v for v in literals if v not in TRIVIAL_LITERALS):
        out = F.replace(out, F.lit(literal), F.lit(PATH_MARK))
    for token in longest_first(v for v in tokens if v):
        pattern = rf"(?U)(?<![\w.-])\Q{token}\E(?![\w.-])"
        out = F.regexp_replace(out, pattern, SECRET_MARK)
    return F.regexp_replace(out, "(?iU)" + SECRET_PAIR, "$1=" + SECRET_MARK)


def redact_json_paths(value: Column) -> Column:
    """Redact paths in every string of a JSON text of unknown depth; keys stay."""
    pattern = re.compile(ABSOLUTE_PATH)

    def clean(node):
        if isinstance(node, str):
            return pattern.sub(PATH_MARK, node)
        if isinstance(node, list):
            return [clean(item) for item in node]
        if isinstance(node, dict):
            return {key: clean(item) for key, item in node.items()}
        return node

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(
            lambda s: None if s is None else json.dumps(clean(json.loads(s)), ensure_ascii=False)
        )

    return run(value)


def shorten_build_path(value: Column) -> Column:
    """Replace each absolute path by its last part."""
    return F.regexp_replace(value, BUILD_PATH, "$1")
