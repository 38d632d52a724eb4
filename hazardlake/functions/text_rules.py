"""Flags from free-text karyotype strings (F1-F7), as Column expressions.

Both rule sets are data: a table of (flag name -> substrings), evaluated with
``contains`` / ``rlike`` / ``regexp_count``.  No Python runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's rules for identical flags).
# Generic karyotype features, evaluated on lower(strip(text)), NULL -> "".
NORMAL_KARYOTYPE_PATTERN = r"^46,(xx|xy)$"
CYTO_FLAG_RULES = [
    ("cyto_has_deletion", ["del("]),
    ("cyto_has_monosomy_7", ["-7", "monosomy 7"]),
    ("cyto_has_trisomy_8", ["+8", "trisomy 8"]),
    ("cyto_has_translocation", ["t("]),
]
ABNORMALITY_TOKEN_PATTERN = r"del\(|inv\(|dup\(|t\(|\+\d+|-\d+"

# Targeted rules, evaluated on lower(text) with spaces removed, NULL -> "".
AML_RULES = [
    ("cyto_has_complex", ["complex", "cx", "≥3", ">=3"]),
    ("cyto_has_monosomal_karyotype", ["monosomal", "mk"]),
    ("cyto_has_del5q", ["del(5q", "-5", "5q-"]),
    ("cyto_has_mono7_or_del7q", ["-7", "del(7q", "7q-"]),
    ("cyto_has_trisomy8", ["+8", "trisomy8"]),
    ("cyto_has_inv16", ["inv(16", "t(16;16"]),
    ("cyto_has_t8_21", ["t(8;21"]),
    ("cyto_has_t15_17", ["t(15;17"]),
    ("cyto_has_11q23_kmt2a", ["11q23", "kmt2a", "mll"]),
    ("cyto_has_3q_abn", ["3q", "inv(3", "t(3;3"]),
    ("cyto_has_17p", ["17p", "del(17p"]),
    ("cyto_has_20q_del", ["del(20q", "20q-"]),
    ("cyto_has_12p_abn", ["12p", "del(12p"]),
]
AML_COUNT_PATTERN = r"(del\(|inv\(|t\(|dup\(|\+\d+|-\d+)"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_all(c) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` only strips spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def normalise_text(c, remove_spaces: bool = False) -> Column:
    s = F.coalesce(_col(c), F.lit(""))
    if remove_spaces:
        return F.replace(F.lower(s), F.lit(" "), F.lit(""))
    return F.lower(strip_all(s))


def _any_contains(s: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | s.contains(n)
    return cond


def cyto_features(c) -> dict[str, Column]:
    """six generic karyotype features."""
    s = normalise_text(c)
    out = {"cyto_is_normal_karyotype": s.rlike(NORMAL_KARYOTYPE_PATTERN).cast("int")}
    for name, needles in CYTO_FLAG_RULES:
        out[name] = _any_contains(s, needles).cast("int")
    out["cyto_n_abnormalities"] = F.regexp_count(s, F.lit(ABNORMALITY_TOKEN_PATTERN)).cast("int")
    return out


def aml_rule_flags(c) -> dict[str, Column]:
    """thirteen targeted flags and a token count."""
    t = normalise_text(c, remove_spaces=True)
    out = {name: _any_contains(t, needles).cast("int") for name, needles in AML_RULES}
    out["cyto_abn_count_proxy"] = F.regexp_count(t, F.lit(AML_COUNT_PATTERN)).cast("int")
    return out
