"""Change logs: row images, transactions, and what a table becomes by them.

An event has its transaction's ordinal, its place in it, a type and row images as structs. All orders are total:
(txn_ordinal, mutation_idx, row_idx)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.chunking import locate
from keelson.operators.numbering import numbered

#: Row events of a binary log, of all versions, by the type of mutation.
EVENT_TYPES = {
    "WRITE_ROWS_EVENTv0": "insert", "WRITE_ROWS_EVENTv1": "insert", "WRITE_ROWS_EVENTv2": "insert",
    "UPDATE_ROWS_EVENTv0": "update", "UPDATE_ROWS_EVENTv1": "update", "UPDATE_ROWS_EVENTv2": "update",
    "DELETE_ROWS_EVENTv0": "delete", "DELETE_ROWS_EVENTv1": "delete", "DELETE_ROWS_EVENTv2": "delete",
}
ORDER = ("txn_ordinal", "mutation_idx", "row_idx")


def mutation_type(event: Column, names: Mapping[str, str] = EVENT_TYPES) -> Column:
    """The type of an event by its name; null for those that aren't of rows."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[event]


def pair_images(events: DataFrame, rows: str = "rows") -> DataFrame:
    """(..., row_idx, before, after): of an update event's rows the even ones are before-images, each followed by its
    after-image; inserts have no before, deletes no after."""
    update = F.col("type") == "update"
    images = F.when(
        update, F.transform(F.sequence(F.lit(0), F.expr(f"size({rows}) div 2") - 1), lambda i: F.struct(F.get(rows, i * 2).alias("before"), F.get(rows, i * 2 + 1).alias("after")))
    ).otherwise(
        F.transform(rows, lambda r: F.struct(F.when(F.col("type") == "delete", r).alias("before"), F.when(F.col("type") == "insert", r).alias("after")))
    )
    images = F.when(F.size(rows) > 0, images)
    return events.select("*", F.posexplode(images).alias("row_idx", "__pair")).select(*[c for c in events.columns if c != rows], "row_idx", "__pair.before", "__pair.after")


def transactions(events: DataFrame, order: Sequence[str] = ("mutation_idx",), carried: Sequence[str] = ("type",)) -> DataFrame:
    """(txn_ordinal, n_mutations, mutations, log_pos): the events of each transaction in order, and its final position."""
    each = F.struct(*order, *carried)
    return events.groupBy("txn_ordinal").agg(F.count(F.lit(1)).alias("n_mutations"), F.sort_array(F.collect_list(each)).alias("mutations"), F.max("log_pos").alias("log_pos"))


def microbatches(log: DataFrame, most: int = 100, ordinal: str = "txn_ordinal", name: str = "batch") -> DataFrame:
    """log with the number of the batch of `most` transactions; ordinals count from 0 without gaps."""
    return log.withColumn(name, F.expr(f"`{ordinal}` div {int(most)}"))


def microbatches_by_time(log: DataFrame, seconds: float, most: int = 100, ordinal: str = "txn_ordinal", time: str = "time") -> DataFrame:
    """log with `span` and `part`: a batch has at most `most` transactions, and those of one span of so many seconds.

    A transaction is of the span of its first event. Spans lie on a grid, so batches are found side by side; a span without
    transactions has no batch, as a wait without any is only made longer. A span's transactions share a task."""
    first = log.groupBy(F.col(ordinal).alias("__txn")).agg(F.floor(F.unix_micros(F.min(time)) / F.lit(int(seconds * 1_000_000))).alias("span"))
    number = F.row_number().over(Window.partitionBy("span").orderBy("__txn"))
    parts = first.withColumn("part", F.floor((number - 1) / most).cast("long"))
    return log.join(parts, F.col(ordinal) == F.col("__txn")).drop("__txn")


def positions(events: DataFrame, order: str = "ordinal") -> DataFrame:
    """events with the file and position of the log after each of them: a rotate event names the file that follows and the
    position in it, every other event ends at its own `log_pos`.

    events: (ordinal, type, next_file, next_position, log_pos). Rotations bound ranges of ordinals, and each event is located in
    its own as a key is in its chunk."""
    rotations = numbered(events.where("type = 'rotate'").select(order, F.col("next_file").alias("file"), F.col("next_position").alias("__start")), [order], "__of")
    tiles = rotations.select(F.col("__of").alias("chunk_id"), F.struct(order).alias("start"))
    named = rotations.select("__of", F.col(order).alias("__at"), "file", "__start")
    out = locate(events, tiles, [order], "__of").join(named, "__of", "left")
    return out.withColumn("position", F.when(F.col(order) == F.col("__at"), F.col("__start")).otherwise(F.col("log_pos"))).drop("__of", "__at", "__start")


def images(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., order, live, row): one row for each change of a key. An update whose key changes deletes the old key and
    writes the new one; of one event the deletion counts first."""
    before, after = [F.col(f"before.`{k}`") for k in keys], [F.col(f"after.`{k}`") for k in keys]
    moved = F.lit(False)
    for b, a in zip(before, after):
        moved = moved | ~b.eqNullSafe(a)
    gone = F.struct(F.lit(0).alias("part"), *[b.alias(k) for b, k in zip(before, keys)], F.lit(False).alias("live"), F.when(F.lit(False), F.col("after")).alias("row"))
    there = F.struct(F.lit(1).alias("part"), *[a.alias(k) for a, k in zip(after, keys)], F.lit(True).alias("live"), F.col("after").alias("row"))
    parts = F.when(F.col("type") == "delete", F.array(gone)).when((F.col("type") == "update") & F.col("before").isNotNull() & moved, F.array(gone, there)).otherwise(F.array(there))
    return events.select(*ORDER, F.explode(parts).alias("e")).select(*[F.col(f"e.`{k}`").alias(k) for k in keys], F.struct(*ORDER, "e.part").alias("order"), "e.live", "e.row")


def net(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., live, row): the last change of each key. Partial aggregation keeps one row a key and task in the shuffle."""
    last = F.max_by(F.struct("live", "row"), F.col("order"))
    return changes.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.live", "__last.row")


def apply_log(target: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target after all events, the last writer of a key winning. Applying a log twice, or in parts, gives the same."""
    last = net(images(events, keys), keys)
    return apply_net(target, last, keys)


def apply_net(target: DataFrame, last: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target after the net changes (keys..., live, row)."""
    names = last.schema["row"].dataType.names
    both = target.join(last, list(keys), "full_outer").where(F.col("live").isNull() | F.col("live"))
    return both.select(*[F.when(F.col("live").isNotNull(), F.col(f"row.`{c}`")).otherwise(F.col(c)).alias(c) if c in names and c not in keys else F.col(c) for c in target.columns])
