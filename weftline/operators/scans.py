"""Line scans over texts: secrets, forbidden addresses and unfinished-work markers.

All are row-local: a text is tested as a whole first, and only texts with a hit are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import text_lines

# What a secret looks like.
SECRET_PATTERNS = (
    r"(?iU)(?:api[_-]?key|access[_-]?key|client[_-]?secret|private[_ -]?key|password|passwd|secret|token|credential)"
    r"\s*[:=]\s*['\"]?([A-Za-z0-9_./+=:-]{20,})",
    r"(?iU)\bbearer\s+[A-Za-z0-9._~+/=-]{24,}",
    r"-----BEGIN [A-Z ]+PRIVATE KEY-----",
)

# Words that mark unfinished work.
MARKERS = ("TODO", "FIXME", "TBD", "REPLACE_ME", "CHANGEME")


def matching_lines(
    texts: DataFrame, patterns: Sequence[str], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, line): each line that any pattern matches, once; lines count from 1."""

    def hit(name: str):
        found = F.lit(False)
        for pattern in patterns:
            found = found | F.rlike(F.col(name), F.lit(pattern))
        return found

    lines = texts.where(hit(text)).select(key, F.posexplode(text_lines(F.col(text))).alias("_at", "_line"))
    return lines.where(hit("_line")).select(key, (F.col("_at") + 1).alias("line"))


def scan_secrets(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return matching_lines(texts, SECRET_PATTERNS, key, text)


def scan_markers(
    texts: DataFrame, key: str = "doc_id", text: str = "text", allowed: DataFrame | None = None
) -> DataFrame:
    kept = texts if allowed is None else texts.join(allowed, key, "left_anti")
    return matching_lines(kept, [rf"(?iU)\b(?:{'|'.join(MARKERS)})\b"], key, text)


def scan_addresses(
    texts: DataFrame,
    families: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    allowed: DataFrame | None = None,
) -> DataFrame:
    """(key, line, family): lines that contain a forbidden address family, allowed texts aside."""
    kept = texts if allowed is None else texts.join(allowed, key, "left_anti")
    any_hit = F.lit(False)
    for family in families:
        any_hit = any_hit | F.contains(F.col(text), F.lit(family))
    lines = kept.where(any_hit).select(key, F.posexplode(text_lines(F.col(text))).alias("_at", "_line"))
    hits = F.array_compact(
        F.array(*[F.when(F.contains(F.col("_line"), F.lit(f)), F.lit(f)) for f in families])
    )
    return lines.select(key, (F.col("_at") + 1).alias("line"), F.explode(hits).alias("family"))
