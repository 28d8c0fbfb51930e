"""Queries: keyed differences, chunks and checksums."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.shardhash import in_shard, shard_hash
from keelson.model import coerced
from keelson.operators.checksum import checksums, mismatched, row_sum
from keelson.operators.chunking import chunks, locate, page, scan
from keelson.operators.diff import diff, diff_via_checksum, flat, key_difference, no_diff, summary
from keelson.operators.diff import diff_within as within
from keelson.plans.inputs import CUSTOMER, DOCUMENTS, LINES, LINES_COLUMNS, LINES_SQL, ORDERS, PART, diff_sql, lines
from keelson.plans.registry import query
from keelson.sources.tables import table

_SIZE = 5000


def _plain(pair):
    return diff_sql(pair.sql, (pair.key,), pair.columns)


@query(_plain(ORDERS))
def diff_orders(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*ORDERS.both(spark, sf), ORDERS.spec))


@query(_plain(CUSTOMER))
def diff_customer(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*CUSTOMER.both(spark, sf), CUSTOMER.spec))


@query(_plain(PART))
def diff_part(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*PART.both(spark, sf), PART.spec))


@query(_plain(DOCUMENTS))
def diff_documents(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*DOCUMENTS.both(spark, sf), DOCUMENTS.spec))


@query(diff_sql(LINES_SQL, LINES.keys, LINES_COLUMNS))
def diff_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*lines(spark, sf), LINES))


@query(diff_sql(ORDERS.sql, ("o_orderkey",), tuple(c for c in ORDERS.columns if c != "o_totalprice")))
def diff_ignore_columns(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*ORDERS.both(spark, sf), replace(ORDERS.spec, ignore_columns=("o_totalprice",))))


@query(diff_sql(ORDERS.sql + ", s2 AS (SELECT * FROM s WHERE o_orderpriority = '1-URGENT')", ("o_orderkey",), ORDERS.columns, s="s2"))
def diff_source_where(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*ORDERS.both(spark, sf), replace(ORDERS.spec, source_where="o_orderpriority = '1-URGENT'")))


@query(diff_sql(ORDERS.sql + ", t2 AS (SELECT * FROM t WHERE o_totalprice > 100000)", ("o_orderkey",), ORDERS.columns, t="t2"))
def diff_target_where(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*ORDERS.both(spark, sf), replace(ORDERS.spec, target_where="o_totalprice > 100000")))


def _all_diffs(spark: SparkSession, sf: str) -> DataFrame:
    parts = [diff(*p.both(spark, sf), p.spec).select(F.lit(p.name).alias("table"), "type") for p in (ORDERS, CUSTOMER, PART)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ALL = " UNION ALL ".join(f"SELECT '{p.name}' AS \"table\", type FROM ({_plain(p)})" for p in (ORDERS, CUSTOMER, PART))


@query(f'SELECT "table", type, count(*) AS diffs FROM ({_ALL}) GROUP BY ALL')
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary(_all_diffs(spark, sf))


@query(f'SELECT "table", type, count(*) AS diffs FROM ({_ALL}) GROUP BY ROLLUP ("table", type)')
def diff_summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    return summary(_all_diffs(spark, sf), totals=True)


@query(diff_sql(ORDERS.sql + ", s2 AS (SELECT * FROM s WHERE false)", ("o_orderkey",), ORDERS.columns, s="s2"))
def diff_empty_source(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return flat(diff(source.where(F.lit(False)), target, ORDERS.spec))


@query(diff_sql(ORDERS.sql, ("o_orderkey",), ORDERS.columns, t="s"))
def diff_identical(spark: SparkSession, sf: str) -> DataFrame:
    source = ORDERS.source(spark, sf)
    return flat(diff(source, source, ORDERS.spec))


@query("SELECT 'insert' AS type, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def no_diff_read(spark: SparkSession, sf: str) -> DataFrame:
    return no_diff(ORDERS.source(spark, sf), replace(ORDERS.spec, ignore_columns=("o_orderpriority",), source_where="o_orderstatus = 'F'"))


@query(f"WITH {ORDERS.sql} SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'source' ELSE 'target' END AS side FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    return key_difference(*ORDERS.both(spark, sf), ["o_orderkey"])


@query(_plain(ORDERS))
def diff_looked_at_again(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return flat(within(source, target, ORDERS.spec, diff(source, target, ORDERS.spec)))


@query("SELECT o_orderkey, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, TRY_CAST(o_orderpriority AS BIGINT) AS number FROM orders")
def coerced_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that hold digits are numbers, text that doesn't is null, times are text to the second."""
    rows = ORDERS.source(spark, sf).select(F.col("o_orderkey").cast("string").cast("binary").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("number"))
    shape = spark.createDataFrame([], "o_orderkey bigint, price double, at string, number bigint").schema
    return coerced(rows, shape)


def _chunk_sql(ctes: str, source: str, keys: tuple[str, ...], size: int, table: str) -> str:
    """Chunks by row numbers; keys' bounds in columns start_ and end_."""
    k = ", ".join(keys)
    end = ", ".join(f"lead({x}) OVER (ORDER BY no) AS end_{x}" for x in keys)
    last = "(SELECT * FROM n ORDER BY " + ", ".join(f"{x} DESC" for x in keys) + " LIMIT 1)"
    beyond = {x: (f"{x} + 1" if x == keys[-1] else x) for x in keys}
    data_end = ", ".join(f"CASE WHEN no = (SELECT max(no) FROM d) THEN (SELECT {beyond[x]} FROM l) ELSE end_{x} END AS end_{x}" for x in keys)
    return f"""WITH {ctes}{', ' if ctes else ''}n AS (SELECT {k}, row_number() OVER (ORDER BY {k}) AS rn FROM {source}), l AS {last},
d AS (SELECT (rn - 1) // {size} AS no, {k} FROM n WHERE (rn - 1) % {size} = 0),
e AS (SELECT no, {', '.join(f'{x} AS start_{x}' for x in keys)}, {end} FROM d),
f AS (SELECT no, {', '.join(f'start_{x}' for x in keys)}, {data_end} FROM e)
SELECT '{table}' AS "table", CAST(0 AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS seq, {', '.join(f'NULL AS start_{x}, start_{x} AS end_{x}' for x in keys)}, true AS is_first, false AS is_last, CAST(0 AS BIGINT) AS size FROM f WHERE no = 0
UNION ALL SELECT '{table}', no + 1, no, {', '.join(f'start_{x}, end_{x}' for x in keys)}, false, false, least({size}, (SELECT max(rn) FROM n) - no * {size}) FROM f
UNION ALL SELECT '{table}', (SELECT max(no) FROM d) + 2, rn // {size}, {', '.join(f'{beyond[x]}, NULL' for x in keys)}, false, true, 0 FROM l"""


def _flat_chunks(tiles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    bounds = [F.col(f"{side}.{k}").alias(f"{side}_{k}") for k in keys for side in ("start", "end")]
    return tiles.select("table", "chunk_id", "seq", *bounds, "is_first", "is_last", "size")


_ORDER_CHUNKS = _chunk_sql("", "orders", ("o_orderkey",), _SIZE, "orders")


@query(_ORDER_CHUNKS)
def chunks_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_chunks(chunks(ORDERS.source(spark, sf), ["o_orderkey"], _SIZE, "orders"), ("o_orderkey",))


@query(_chunk_sql(LINES_SQL, "s", LINES.keys, 1000, "lineitem"))
def chunks_composite(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_chunks(chunks(lines(spark, sf)[0], LINES.keys, 1000, "lineitem"), LINES.keys)


@query("SELECT 'orders' AS \"table\", CAST(0 AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS start_o_orderkey, CAST(NULL AS BIGINT) AS end_o_orderkey, true AS is_first, true AS is_last, CAST(0 AS BIGINT) AS size")
def chunks_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_chunks(chunks(ORDERS.source(spark, sf).where(F.lit(False)), ["o_orderkey"], _SIZE, "orders"), ("o_orderkey",))


@query(f"SELECT count(*) AS chunks, sum(size)::BIGINT AS size, max(size) AS largest, min(size) FILTER (NOT is_first AND NOT is_last) AS smallest FROM ({_chunk_sql('', 'customer', ('c_custkey',), 100, 'customer')})")
def chunk_sizes(spark: SparkSession, sf: str) -> DataFrame:
    tiles = chunks(CUSTOMER.source(spark, sf), ["c_custkey"], 100, "customer")
    inner = F.when(~F.col("is_first") & ~F.col("is_last"), F.col("size"))
    return tiles.agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("size"), F.max("size").alias("largest"), F.min(inner).alias("smallest"))


@query(f"WITH {ORDERS.sql}, c AS ({_ORDER_CHUNKS}) SELECT t.o_orderkey, c.chunk_id FROM t JOIN c ON (c.start_o_orderkey IS NULL OR t.o_orderkey >= c.start_o_orderkey) AND (c.end_o_orderkey IS NULL OR t.o_orderkey < c.end_o_orderkey)")
def chunk_membership(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    return locate(target.select("o_orderkey"), chunks(source, ["o_orderkey"], _SIZE, "orders"), ["o_orderkey"])


@query(f"WITH {LINES_SQL} SELECT * FROM s WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber >= 3)) AND (l_orderkey < 2000 OR (l_orderkey = 2000 AND l_linenumber < 2)) AND l_quantity > 5")
def chunk_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan(lines(spark, sf)[0], LINES.keys, (100, 3), (2000, 2), "l_quantity > 5")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 4321 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return page(ORDERS.source(spark, sf).select("o_orderkey", "o_custkey"), ["o_orderkey"], (4321,), 100)


_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_CRC_TEXT = {"o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')"}


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT)), lambda c, b: xor(c >> 8, x[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


_CELLS = " ".join(f"xor({_crc(_CRC_TEXT.get(c, f'CAST({c} AS VARCHAR)'))}," for c in ORDERS.columns) + " 0" + ")" * len(ORDERS.columns)


@query(f"WITH crc AS (SELECT {_TABLE} AS x), c AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // {_SIZE} + 1 AS chunk_id, * FROM orders) SELECT chunk_id, count(*) AS n, bit_xor({_CELLS})::BIGINT AS checksum FROM c, crc GROUP BY chunk_id")
def chunk_checksum_crc32(spark: SparkSession, sf: str) -> DataFrame:
    source = ORDERS.source(spark, sf)
    sums = source.select("o_orderkey", row_sum(source, list(ORDERS.columns), "crc32").alias("__sum"))
    return checksums(locate(sums, chunks(source, ["o_orderkey"], _SIZE), ["o_orderkey"]), None)


_BY_CHUNK = f"WITH {ORDERS.sql}, c AS ({_ORDER_CHUNKS}), d AS ({_plain(ORDERS)}) SELECT DISTINCT c.chunk_id FROM d JOIN c ON (c.start_o_orderkey IS NULL OR d.o_orderkey >= c.start_o_orderkey) AND (c.end_o_orderkey IS NULL OR d.o_orderkey < c.end_o_orderkey)"


@query(_BY_CHUNK)
def checksum_mismatched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    source, target = ORDERS.both(spark, sf)
    tiles = chunks(source, ["o_orderkey"], _SIZE, "orders")
    sums = [x.select("o_orderkey", row_sum(x, list(ORDERS.columns)).alias("__sum")) for x in (source, target)]
    return mismatched(*(locate(x, tiles, ["o_orderkey"]) for x in sums), None)


@query(_plain(ORDERS))
def diff_via_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff_via_checksum(*ORDERS.both(spark, sf), ORDERS.spec))


@query(_plain(PART))
def diff_via_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff_via_checksum(*PART.both(spark, sf), PART.spec, "crc32"))


def _swapped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two regions swap their names: XOR of cells can't see it."""
    s = table(spark, sf, "region").select("r_regionkey", "r_name")
    other = s.select((1 - F.col("r_regionkey")).alias("r_regionkey"), F.col("r_name").alias("other"))
    return s, s.join(other, "r_regionkey", "left").select("r_regionkey", F.coalesce("other", "r_name").alias("r_name"))


@query("SELECT 'update' AS type, a.r_regionkey, a.r_name, a.r_regionkey AS target_r_regionkey, b.r_name AS target_r_name FROM region a JOIN region b ON a.r_regionkey = 1 - b.r_regionkey")
def swap_seen_by_diff(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff(*_swapped(spark, sf), replace(ORDERS.spec, name="region", keys=("r_regionkey",))))


@query("SELECT 'update' AS type, r_regionkey, r_name, r_regionkey AS target_r_regionkey, r_name AS target_r_name FROM region WHERE false")
def swap_missed_by_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return flat(diff_via_checksum(*_swapped(spark, sf), replace(ORDERS.spec, name="region", keys=("r_regionkey",)), "crc32"))


@query("""SELECT 'update' AS type, o_orderkey FROM orders WHERE (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) OR (o_orderkey % 7 = 0 AND o_orderkey % 3 = 0)
OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0""")
def diff_mixed_types(spark: SparkSession, sf: str) -> DataFrame:
    """The target has fractions for whole numbers, times for texts and texts for numbers: what reading them in the source's types
    would lose, and what can't be read, are differences; the same number as a text is none."""
    o, k = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at")), F.col("o_orderkey")
    at, number = F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.when(k % 7 != 0, k % 1000)
    source = o.select("o_orderkey", number.cast("int").alias("number"), at.alias("at"), (k * 3).alias("code"))
    more = number.cast("double") + F.when(k % 11 == 0, 0.5).otherwise(0.0)
    target = o.select(
        k.cast("string").cast("binary").alias("o_orderkey"),
        F.when((k % 7 == 0) & (k % 3 == 0), F.lit(float(1 << 40))).otherwise(more).alias("number"),
        F.when(k % 13 == 0, F.timestamp_micros(F.unix_micros("at") + 500_000)).otherwise(F.col("at")).alias("at"),
        F.when(k % 17 == 0, "abc").when(k % 19 == 0, F.concat((k * 3).cast("string"), F.lit(".7"))).otherwise((k * 3).cast("string")).alias("code"),
    )
    return diff(source, target, ORDERS.spec).select("type", "o_orderkey")


@query("SELECT 'update' AS type, o_orderkey FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 71 = 0")
def crc32_sees_small_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of a thousandth and of a tenth of a second, through the CRC32 gate."""
    k = F.col("o_orderkey")
    source = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at"))
    target = source.withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 53 == 0, 0.001).otherwise(0.0))
    target = target.withColumn("at", F.when(k % 71 == 0, F.timestamp_micros(F.unix_micros("at") + 100_000)).otherwise(F.col("at")))
    return diff_via_checksum(source, target, ORDERS.spec, "crc32").select("type", "o_orderkey")


@query("SELECT 'update' AS type, NULL::BIGINT AS n_nationkey, n_regionkey + 1 AS n_regionkey FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'delete', n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 7")
def diff_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A row without a key is found again: here its number differs, and another row is in the target alone."""
    n = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") > 0, F.col("n_nationkey")).cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey"))
    source = n.where("n_nationkey IS NULL OR n_nationkey <> 7").withColumn("n_regionkey", F.col("n_regionkey") + F.col("n_nationkey").isNull().cast("int"))
    found = diff(source, n, replace(ORDERS.spec, name="nation", keys=("n_nationkey",)))
    return found.select("type", "n_nationkey", "row.n_regionkey")


@query()
def shard_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.lower(F.lpad(F.hex(shard_hash(F.col("c_custkey"))), 16, "0")).alias("hash"))


@query()
def shard_filter_diff(spark: SparkSession, sf: str) -> DataFrame:
    source, target = CUSTOMER.both(spark, sf)
    one = lambda df: df.where(in_shard(F.col("c_custkey"), "-80"))
    return flat(diff(one(source), one(target), CUSTOMER.spec))
