"""Small helpers for data frames with columns of unknown names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def parallelism(df: DataFrame) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small_enough(rows: int, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether a side of so many rows may be broadcast; beyond the limit both sides are shuffled."""
    return rows * row_bytes <= limit
