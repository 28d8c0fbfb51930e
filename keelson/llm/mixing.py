"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Every source's rows, in an order that depends on their keys alone, are cut into blocks. A source of integer weight a
should have a of every P blocks (P the sum of the weights of the sources that still have blocks), as a fluid would.
Block k of it is released when the fluid schedule begins it and due when the fluid ends it; the earliest deadline among
the released blocks takes the next slot. As the fluid schedule is feasible, every block keeps its window, so at any slot
a source is less than one block ahead of or behind its target. A source that runs out leaves its share to the others:
no row is dropped or repeated.

After every round of P blocks the fluid amounts of all sources are whole, so rounds are scheduled by themselves; rounds
in which the same sources have the same numbers of blocks have the same schedule, and at most 2 S + 1 kinds of rounds
occur for S sources. The schedule is made once for each kind, by SQL's aggregate() over at most P slots, in one row: P and S
are of the weights' table, not of the data's size. Weights are divided by their greatest common divisor.

Defined cases: a null source is a source of its own, named by null; rows with a null key are kept and come last in
their source's order; ties and repeated rows get different places; a source without a given weight has `default`;
weights below 1 count as 1; an empty table stays empty; other columns are carried."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import numbered

ADDED = ("block", "round", "slot", "in_block")
#: Rows of the largest table that is broadcast (about 12 MB).
FEW = 1 << 18


def _weight(source: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(max(int(default), 1))
    for name, w in weights.items():
        out = F.when(source == name, F.lit(max(int(w), 1))).otherwise(out)
    return out.cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """sources (__source, __a, __n: blocks): per source and block of a kind of round: __source, __k, __kind (the first
    round of that kind), __at (the slot within the round), and the slots before that round and in each round of its kind
    (__base, __slots).

    A step looks at each source's next window alone. Slots are filled in runs of about the square root of their number, so
    that what is done isn't copied at every step: P slots and S sources take some P (S + sqrt(P)) steps."""
    one = sources.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("__source", F.lit("")).alias("o"), F.col("__source").isNull().alias("z"), F.col("__source").alias("s"), F.col("__a").alias("a"), F.col("__n").alias("n")))).alias("all"))
    ends = "flatten(transform(all, x -> array(x.n div x.a, x.n div x.a + 1)))"
    kinds = one.selectExpr("all", f"explode(array_sort(array_distinct(filter(concat(array(0L), {ends}), q -> q < array_max(transform(all, x -> (x.n + x.a - 1) div x.a)))))) AS kind")
    total = lambda what: f"aggregate({what}, 0L, (u, v) -> u + v)"
    counted = kinds.selectExpr("all", "kind", "transform(all, x -> greatest(0L, least(x.a, x.n - x.a * kind))) AS c")
    counted = counted.selectExpr("*", f"{total('c')} AS slots", f"{total('transform(all, x -> least(x.n, x.a * kind))')} AS base", f"transform(all, (x, i) -> named_struct('k', 0L, 'r', 0L, 'd', {_due('1L', 'c[i]')})) AS begin")
    # the exchange keeps what is computed above from being computed anew in every step
    counted = counted.repartition(F.col("kind"))
    choice = "array_min(transform(acc.next, (x, i) -> if(x.k < c[i] AND x.r <= t, named_struct('d', x.d, 'i', i), null)))"
    window = f"named_struct('k', x.k + 1, 'r', {_released('x.k + 1')}, 'd', {_due('x.k + 2', 'c[i]')})"
    step = f"named_struct('next', transform(old.next, (x, i) -> if(i = e.i, {window}, x)), 'done', concat(old.done, array(named_struct('i', e.i, 'k', old.next[e.i].k))))"
    nothing = "cast(array() AS array<struct<i: int, k: bigint>>)"
    # of a let-binding's stead: aggregate() over one element names what is used twice
    run = f"aggregate(sequence(first, least(first + width, slots) - 1), named_struct('next', run.next, 'done', {nothing}), (acc, t) -> aggregate(array({choice}), acc, (old, e) -> {step}))"
    done = f"""aggregate(sequence(0L, slots - 1, width), named_struct('next', begin, 'done', cast(array() AS array<array<struct<i: int, k: bigint>>>)),
        (run, first) -> aggregate(array({run}), run, (whole, part) -> named_struct('next', part.next, 'done', concat(whole.done, array(part.done))))).done"""
    filled = counted.selectExpr("*", "cast(ceil(sqrt(slots)) AS bigint) AS width").selectExpr("all", "kind", "base", "slots", f"flatten({done}) AS done")
    return filled.selectExpr("all", "kind", "base", "slots", "posexplode(done) AS (at, e)").selectExpr(
        "all[e.i].s AS __source", "e.k AS __k", "kind AS __kind", "cast(at AS bigint) AS __at", "base AS __base", "slots AS __slots"
    )


def _used(k: str) -> str:
    """The slots, times the weight of source i, that the fluid has used when it has done k of its blocks: the sum over all
    sources of min(a_j k, c_j a_i)."""
    return f"aggregate(zip_with(all, c, (y, m) -> least(y.a * ({k}), m * all[i].a)), 0L, (u, v) -> u + v)"


def _released(k: str) -> str:
    return f"{_used(k)} div all[i].a"


def _due(k: str, most: str) -> str:
    """When the fluid ends the block before the k-th; beyond the source's last block this isn't asked for."""
    return f"if({k} > {most}, 0L, ({_used(k)} + all[i].a - 1) div all[i].a)"


def _mix(docs: DataFrame, weights: dict[str, int], key: str = "doc_id", source: str = "source", block_rows: int = 16, default: int = 1) -> DataFrame:
    """(__row, block, round, slot, in_block) of every row.

    Rows are shuffled once, to be numbered. Where a block goes follows from the sources' sizes and the plan, which are
    broadcast if their counted bound allows it (FEW rows) and joined by shuffle beyond it."""
    common = gcd(*(max(int(w), 1) for w in weights.values()), max(int(default), 1))
    weights, default = {k: max(int(w), 1) // common for k, w in weights.items()}, max(int(default), 1) // common
    whole_rows = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.col(source).alias("__src"))
    sizes = whole_rows.groupBy(F.col("__src").alias("__source")).agg(F.count(F.lit(1)).alias("__rows"))
    sources = sizes.select("__source", _weight(F.col("__source"), weights, default).alias("__a"), F.expr(f"(__rows + {int(block_rows) - 1}) div {int(block_rows)}").alias("__n"))
    whole = sources.agg(F.count(F.lit(1)).alias("__s"), F.sum("__a").alias("__p"), F.collect_list(F.struct(F.col("__a").alias("a"), F.col("__n").alias("n"))).alias("__all"))
    bound = whole.select("__s", "__p").first()
    rows = whole_rows.withColumn("__order", F.coalesce(F.md5(F.col("__key").cast("string").cast("binary")), F.lit("~")))
    # 4096 buckets of the order, and that of null keys, for each source
    rows = numbered(rows, ["__src"], [F.col("__order"), F.col("__key")], F.substring("__order", 1, 3), "__number", few=bound["__s"] * 4097 <= FEW).drop("__order")
    rows = rows.withColumn("block", F.expr(f"__number div {int(block_rows)}")).withColumn("in_block", F.col("__number") % block_rows).drop("__number")
    kinds = "array_distinct(flatten(array(array(0L), flatten(transform(__all, x -> array(x.n div x.a, x.n div x.a + 1))))))"
    rows = rows.withColumn("__a", _weight(F.col("__src"), weights, default)).withColumn("round", F.expr("block div __a")).withColumn("__j", F.expr("block % __a"))
    rows = rows.withColumn("__all", whole.select("__all").scalar()).withColumn("__of", F.expr(f"array_max(filter({kinds}, q -> q <= round))")).drop("__all")
    # a kind of round has at most P blocks, and there are at most 2 S + 1 kinds
    plan = schedule(sources).withColumnRenamed("__source", "__s")
    plan = F.broadcast(plan) if (2 * bound["__s"] + 1) * (bound["__p"] or 0) <= FEW else plan
    placed = rows.join(plan, F.col("__src").eqNullSafe(F.col("__s")) & (F.col("__j") == F.col("__k")) & (F.col("__of") == F.col("__kind")))
    slot = F.col("__base") + (F.col("round") - F.col("__of")) * F.col("__slots") + F.col("__at")
    return placed.select("__row", "block", "round", slot.alias("slot"), "in_block")


def mix(docs: DataFrame, weights: dict[str, int], **named) -> DataFrame:
    """docs with block (of its source), round, slot (of the mix) and in_block; ordering by (slot, in_block) is the mix.
    Columns of docs that bear one of these names give way."""
    placed = _mix(docs, weights, **named)
    return placed.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ADDED], *ADDED)


def placed(docs: DataFrame, name: str = "position") -> DataFrame:
    """docs, read from files that were written in the order of a mix, with each row's place in it, from 0: files in the order of
    their names, rows as they lie in them. Null where docs aren't read from files."""
    files = len(docs.inputFiles())
    if not files:
        return docs.withColumn(name, F.lit(None).cast("long"))
    metadata = docs.metadataColumn("_metadata")
    rows = docs.select("*", metadata["file_path"].alias("__file"), metadata["row_index"].alias("__at"))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are files
    starts = rows.groupBy(F.col("__file").alias("__of")).agg(F.count(F.lit(1)).alias("__n")).select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = rows.join(F.broadcast(starts) if files <= FEW else starts, F.col("__file") == F.col("__of"))
    return out.select(*[c for c in docs.columns if c != name], (F.col("__start") + F.col("__at")).alias(name))


def mixed(docs: DataFrame, weights: dict[str, int], **named) -> DataFrame:
    """docs in the order of the mix, with their own columns."""
    return _mix(docs, weights, **named).orderBy("slot", "in_block").select("__row.*")
