"""Lenient numeric coercion (P5) and target casts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal / scientific literal, optionally padded with whitespace.
# try_cast alone would also accept Java suffixes such as '1.5d' or '1.5f',
# which a lenient numeric parser rejects, hence the guard.
_NUMERIC_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_INF_RE = r"^\s*[-+]?(inf|infinity)\s*$"


def to_number(c) -> Column:
    """String or numeric column -> double; anything unparsable -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    lowered = F.lower(s)
    parsed = (F.when(s.rlike(_NUMERIC_RE), F.trim(s).try_cast("double"))
              .when(lowered.rlike(_INF_RE),
                    F.when(F.trim(s).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)
