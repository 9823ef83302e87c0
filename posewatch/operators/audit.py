"""Scanning file texts and paths for content that must not be published."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewatch.functions.identity import file_suffix, safe_relative_path
from posewatch.functions.staging import staged

MIB = 1024 * 1024


@dataclass(frozen=True)
class Rule:
    """One content rule. ``detail`` is reported, or the matched text after it.

    A match of the pattern in ASCII text holds one of ``needs``, in lower case.
    """

    category: str
    detail: str
    pattern: str
    literal: bool = False
    or_literal: str | None = None  # matches too
    show_match: bool = False
    suffixes: tuple[str, ...] | None = None
    needs: tuple[str, ...] = ()


# Suffix classes and patterns of the publication policy.
TEXT_SUFFIXES = (
    "", ".cff", ".csv", ".gro", ".ini", ".itp", ".json", ".jsonl", ".md", ".mdp", ".ndx", ".py",
    ".pdbqt", ".rst", ".toml", ".top", ".txt", ".yaml", ".yml",
)
METADATA_SUFFIXES = (".cff", ".csv", ".json", ".md", ".toml", ".txt", ".yaml", ".yml")
FORBIDDEN_SUFFIXES = (
    ".cpt", ".dcd", ".edr", ".gz", ".nc", ".tar", ".tpr", ".trr", ".tgz", ".xtc", ".zip",
)
MAX_FILE_BYTES = 20 * MIB
PRIVATE_PREFIXES = ("/Users/", "/home/", "/archive/")
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CREDENTIAL = r"(?U)\b(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,})\b"
PRIVATE_KEY = "-----BEGIN PRIVATE KEY-----"
SHELL = r"(?U)\bshell\s*=\s*True\b"
ACTIVITY = {
    "activity_key": r"(?iU)\b(?:activity_type|activity_value|activity_unit)\b",
    "activity_database": r"(?iU)\b(?:PDBbind|ChEMBL|PubChem)\b",
    "activity_measure": r"(?iU)\b(?:Ki|Kd|IC50|pChEMBL)\b",
    "activity_label": (
        r"(?iU)(?:\b(?:activity_label|bioactivity_label)\b"
        r"|\blabel\s*[:=]\s*(?:active|inactive)\b|\bactive/inactive\b)"
    ),
    "activity_threshold_label": r"(?iU)\b(?:1|10)[- ]?(?:u|µ|μ)m\b",
}

NEEDS = {
    "activity_key": ("activity_",),
    "activity_database": ("pdbbind", "chembl", "pubchem"),
    "activity_measure": ("ki", "kd", "ic50", "pchembl"),
    "activity_label": ("activity_label", "label", "active/inactive"),
    "activity_threshold_label": ("um",),
}


def default_rules(forbidden: Sequence[str] = (), private: Sequence[str] = PRIVATE_PREFIXES) -> list[Rule]:
    """The content rules; project-specific literals are given by the caller."""
    rules = [Rule("private_development_content", t, t, literal=True) for t in forbidden]
    rules += [
        Rule("restricted_release_metadata", label, p, show_match=True,
             suffixes=METADATA_SUFFIXES, needs=NEEDS[label])
        for label, p in ACTIVITY.items()
    ]
    rules += [Rule("private_path_or_identity", p, p, literal=True) for p in private]
    rules += [
        Rule("email_address", "email-like value", EMAIL, needs=("@",)),
        Rule("secret", "credential-like value", CREDENTIAL, or_literal=PRIVATE_KEY,
             needs=("akia", "gho_", "ghp_", "ghs_", "ghu_")),
        Rule("forbidden_feature_or_execution", "shell execution enabled", SHELL, suffixes=(".py",), needs=("shell",)),
    ]
    return rules


def _matches(rule: Rule) -> Column:
    """Whether the pattern matches.

    In ASCII text the Unicode flags change nothing, so there the plain pattern is used,
    and only after one of the texts was found that a match holds.
    """
    text = F.col("text")
    if rule.literal:
        return text.contains(rule.pattern)
    ascii_pattern = rule.pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    quick = text.rlike(ascii_pattern)
    if rule.needs:
        present = F.lit(False)
        for needed in rule.needs:
            present = present | F.col("__lower").contains(needed)
        quick = present & quick
    return F.when(F.col("__lower").isNotNull(), quick).otherwise(text.rlike(rule.pattern))


def content_findings(
    files: DataFrame, rules: Sequence[Rule], text_suffixes: Sequence[str] = TEXT_SUFFIXES
) -> DataFrame:
    """(path, category, detail), one row per text file and rule that matches.

    The short rule list becomes one projection over the text: each text is read
    once, no join and no shuffle. ``files`` has (path, suffix, text); files with
    other suffixes are not text and have no content findings.
    """
    is_ascii = F.octet_length("text") == F.char_length("text")
    files = staged(
        files.filter(F.col("suffix").isin(*text_suffixes)), ["path", "suffix", "text"],
        __lower=F.when(is_ascii, F.lower("text")),
    )
    findings = []
    for rule in rules:
        hit = _matches(rule)
        if rule.or_literal is not None:
            hit = F.col("text").contains(rule.or_literal) | hit
        if rule.suffixes is not None:
            hit = F.col("suffix").isin(*rule.suffixes) & hit
        detail: Column = F.lit(rule.detail)
        if rule.show_match:
            detail = F.concat(
                F.lit(rule.detail + ": "), F.regexp_extract("text", rule.pattern, 0)
            )
        findings.append(
            F.when(hit, F.struct(F.lit(rule.category).alias("category"), detail.alias("detail")))
        )
    return files.select("path", F.explode(F.array_compact(F.array(*findings))).alias("f")).select(
        "path", "f.category", "f.detail"
    )


def path_findings(
    files: DataFrame,
    max_bytes: int = MAX_FILE_BYTES,
    suffixes: Sequence[str] = FORBIDDEN_SUFFIXES,
    prefixes: Sequence[str] = (),
    names: Sequence[str] = (),
) -> DataFrame:
    """Unsafe paths, forbidden suffixes, names and prefixes, oversized files.

    ``files`` has (path, size_bytes).
    """
    suffix = file_suffix(F.col("path"))
    forbidden = F.col("path").isin(*names) if names else F.lit(False)
    for prefix in prefixes:
        forbidden = forbidden | F.col("path").startswith(prefix)

    def finding(cond: Column, category: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(category).alias("category"), detail.alias("detail")))

    found = F.array(
        finding(~safe_relative_path(F.col("path")), "unsafe_member_path",
                F.lit("absolute or parent-traversing path")),
        finding(suffix.isin(*suffixes), "forbidden_extension", suffix),
        finding(F.col("size_bytes") > max_bytes, "large_file", F.col("size_bytes").cast("string")),
        finding(forbidden, "private_or_out_of_scope_path", F.lit("path must stay outside")),
    )
    return files.select("path", F.explode(F.array_compact(found)).alias("f")).select(
        "path", "f.category", "f.detail"
    )


def link_findings(files: DataFrame, needle: str, expected: Sequence[str]) -> DataFrame:
    """Files that hold a text but should not, and the reverse.

    ``expected`` is a short given list; the files without the text and not on the
    list drop out before anything is grouped.
    """
    wanted = F.col("path").isin(*expected)
    holds = F.col("text").contains(needle)
    wrong = files.filter(holds != wanted).select(
        "path", F.when(wanted, "text missing").otherwise("text unexpected").alias("detail")
    )
    absent = files.agg(
        *[F.coalesce(F.bool_or(F.col("path") == p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(expected)]
    ).select(
        F.explode(
            F.array_compact(F.array(*[F.when(~F.col(f"p{i}"), F.lit(p)) for i, p in enumerate(expected)]))
        ).alias("path")
    ).select("path", F.lit("file missing").alias("detail")) if expected else None
    return wrong if absent is None else wrong.unionByName(absent)


def finding_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """PASS only without findings; number of files looked at."""
    marks = files.select(F.lit(1).alias("file"), F.lit(0).alias("finding")).unionByName(
        findings.select(F.lit(0).alias("file"), F.lit(1).alias("finding"))
    )
    return marks.agg(
        F.coalesce(F.sum("file"), F.lit(0)).alias("files_checked"),
        F.coalesce(F.sum("finding"), F.lit(0)).alias("n_findings"),
    ).select(
        F.when(F.col("n_findings") == 0, "PASS").otherwise("FAIL").alias("status"),
        "files_checked",
        "n_findings",
    )
