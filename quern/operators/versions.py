"""Versioned rows: snapshot reads, conflicts, vacuum, and log-structured merge.

A version log has a row for each write; a change log one for each put or
delete. Newest-by-key is a row number with a limit of one, which each task
applies before the shuffle, so a key with many versions sends one a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.relational import first_of, sortable


def visible(versions: DataFrame, at: int | Column, me: int | None = None, active: Iterable[int] = (), created_by: str = "created_tx", created: str = "created_ts", deleted: str | None = "deleted_ts", state: str | None = None) -> DataFrame:
    """The versions that a transaction which began at ``at`` may see.

    Its own; else those whose writer committed by then, was not active then and
    did not abort (state ``A``), unless deleted by then.
    """
    tx, own = F.col(created_by), F.lit(False) if me is None else F.col(created_by) == me
    there = F.col(created).isNotNull() & (F.col(created) <= at)
    if active := list(active):
        there = there & ~tx.isin(active)
    if state:
        there = there & (F.col(state) != "A")
    seen = own | there
    if deleted:
        seen = seen & (F.col(deleted).isNull() | (F.col(deleted) > at))
    return versions.where(seen)


def newest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of greatest ``seq`` of each key, ties by the other columns; rows without a key are left out."""
    return first_of(log, F.col(key), F.col(seq).desc_nulls_last(), *sortable(log, (key, seq)))


def as_of(versions: DataFrame, key: str, version: str, at: int | Column, gone: Column, **how) -> DataFrame:
    """The state of all keys at a moment: newest visible version, without deleted keys.

    ``gone`` marks the versions that stand for a deletion.
    """
    return newest(visible(versions, at, **how), key, version).where(~F.coalesce(gone, F.lit(False)))


def merged(log: DataFrame, key: str, seq: str, gone: Column, keep_tombstones: bool = False) -> DataFrame:
    """Log-structured merge: the last write of each key, deletions applied.

    Compaction above the bottom level keeps the tombstones.
    """
    last = newest(log, key, seq)
    return last if keep_tombstones else last.where(~F.coalesce(gone, F.lit(False)))


def point_get(log: DataFrame, key: str, value: object, seq: str, gone: Column) -> DataFrame:
    """The current row of one key; the filter reaches the scan."""
    return log.where(F.col(key) == value).orderBy(F.col(seq).desc_nulls_last(), *sortable(log, (key, seq))).limit(1).where(~F.coalesce(gone, F.lit(False)))


def compacted(levels: Iterable[DataFrame], key: str, seq: str, gone: Column, bottom: bool = True) -> DataFrame:
    """Several levels as one; only the bottom one may forget deletions."""
    whole: DataFrame | None = None
    for level in levels:
        whole = level if whole is None else whole.unionByName(level, allowMissingColumns=True)
    if whole is None:
        raise ValueError("no levels")
    return merged(whole, key, seq, gone, keep_tombstones=not bottom)


def vacuumed(versions: DataFrame, key: str, created: str, horizon: int | Column) -> DataFrame:
    """What vacuum keeps: of each key its newest version by the horizon and all later ones."""
    anchor = versions.where(F.col(created) <= horizon).groupBy(F.col(key).alias("_key")).agg(F.max(created).alias("_anchor"))
    kept = versions.join(anchor, F.col(key).eqNullSafe(F.col("_key")), "left")
    return kept.where(F.col("_anchor").isNull() | (F.col(created) >= F.col("_anchor"))).drop("_key", "_anchor")


def vacuum_counts(versions: DataFrame, key: str, created: str, horizon: int | Column) -> DataFrame:
    """scanned, kept, dropped and keys in one row."""
    total = versions.agg(F.count("*").alias("scanned"), F.count_distinct(key).alias("keys"))
    kept = vacuumed(versions, key, created, horizon).agg(F.count("*").alias("kept"))
    return total.crossJoin(kept).select("scanned", "kept", (F.col("scanned") - F.col("kept")).alias("dropped"), "keys")


def conflicts(mine: DataFrame, log: DataFrame, key: str, began: int | Column, committed: str, open_writers: Iterable[int] = (), writer: str | None = None) -> DataFrame:
    """Keys of ``mine`` that another transaction committed after I began, or is writing now."""
    late = F.col(committed) > began
    if (open_writers := list(open_writers)) and writer:
        late = late | (F.col(committed).isNull() & F.col(writer).isin(open_writers))
    return mine.select(key).distinct().join(log.where(late).select(key), key, "left_semi")


def write_conflicts(versions: DataFrame, key: str, began: str, committed: str, writer: str) -> DataFrame:
    """Write-write conflicts of a log between neighbours: (key, earlier writer, later writer).

    Two transactions conflict if the later one to commit began before the
    earlier one's commit. Of each write only its conflict with the one committed
    just before it is named; that is enough to say whether it had to fail.
    """
    order = Window.partitionBy(key).orderBy(committed, writer)
    seen = versions.withColumns({"_writer": F.lag(writer).over(order), "_committed": F.lag(committed).over(order)})
    lost = (F.col("_committed") > F.col(began)) & (F.col("_writer") != F.col(writer))
    return seen.where(lost).select(key, F.col("_writer").alias("winner"), F.col(writer).alias("loser"))


def recovered(log: DataFrame, key: str, version: str, tx: str, kind: str) -> DataFrame:
    """Replay after a crash: the writes of committed transactions, newest by key.

    ``kind`` is begin, write, commit or abort; a transaction without a commit
    lost everything.
    """
    committed = log.where(F.col(kind) == "commit").select(tx).distinct()
    return newest(log.where(F.col(kind) == "write").join(committed, tx, "left_semi"), key, version)
