"""Keyed tables: union by source, incremental ingest, overwrite by key, latest and coarsest rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(sources: dict[str, DataFrame], tag: str = "ds") -> DataFrame:
    """All sources as one, each row tagged with the name of its source; columns that a source lacks are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def fresh_rows(new: DataFrame, keys: Sequence[str], *known: DataFrame) -> DataFrame:
    """Rows of new whose key none of the known tables has."""
    return reduce(lambda rows, table: rows.join(table.select(*keys).distinct(), list(keys), "left_anti"), known, new)


def appended(old: DataFrame, new: DataFrame, keys: Sequence[str], *excluded: DataFrame) -> DataFrame:
    """old, and the rows of new that are neither in it nor excluded."""
    return old.unionByName(fresh_rows(new, keys, old, *excluded), allowMissingColumns=True)


def overwritten(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new, and the rows of old under other keys."""
    return fresh_rows(old, keys, new).unionByName(new, allowMissingColumns=True)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key, the row that is first in order; the window is cut to one row before its rows are shuffled."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def preferred_union(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """A row for each key, from the last table that has it."""
    ranked = [df.withColumn("_from", F.lit(i)) for i, df in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_by(rows, keys, [F.desc("_from")]).drop("_from")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """left joined with right, and the rows of left that find nothing there."""
    both = left.join(right.withColumn("_found", F.lit(True)), list(keys), "left")
    return both.filter("_found").drop("_found"), both.filter("_found is null").select(*left.columns)


def sharded(df: DataFrame, key: str, world: int, rank: int) -> DataFrame:
    """One of world shares of df, dealt by key."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(world)) == rank)


def resume_point(states: DataFrame, keys: Sequence[str], turn: str = "turn") -> DataFrame:
    """The turn to go on from, after the last that was kept."""
    return states.groupBy(*keys).agg((F.max(turn) + 1).alias("next_turn"))


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by object and in order of it. By a hash of oid: a deal by oid itself is left out where a join has made one, which may then turn into a broadcast that deals nothing."""
    return df.repartition(F.xxhash64("oid")).sortWithinPartitions("oid", *order)


def whole_objects(told: Callable) -> Callable[[Iterator], Iterator]:
    """For mapInArrow over rows in order of oid: told(table) is given whole objects, many at once. What is held is a batch and the object at its end."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and len(held) else table
            oid = held["oid"].to_numpy()
            last = len(oid) - int((oid == oid[-1:]).sum())  # equal ones stand together
            if last:
                yield from told(held.slice(0, last)).to_batches()
                held = held.slice(last)
        if held is not None and len(held):
            yield from told(held).to_batches()

    return read
