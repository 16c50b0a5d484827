"""What the operators share: size-checked joins and private names; tables, the shared folder and lineage cuts are the engine's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.storage import cut, shared_dir, table

__all__ = ["BROADCAST_IDS", "cut", "join_ids", "private", "renamed", "shared_dir", "table"]

#: An id set is broadcast up to this many ids (about 40 MB as a hash relation) and shuffled beyond it.
BROADCAST_IDS = 500_000


def join_ids(big: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """big joined with the written table ids on key: broadcast if its counted rows are few, else by shuffle."""
    n = ids.count()
    return big.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = "_" + name
    return name


def renamed(df: DataFrame, **cols: str) -> DataFrame:
    """Only the columns an operator reads, under private names; a column the table lacks becomes null."""
    kinds = {"doc_id": "bigint", "text": "string"}
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n, c in cols.items()])
