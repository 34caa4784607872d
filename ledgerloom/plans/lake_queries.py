"""Queries over raw rows: ids, references, scans of texts, swaps, ranges and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, evm
from ..operators import ids, reshape, swaps
from ..operators.rates import frontier
from ..operators.tags import latest_mapping
from ..sources import lake, scan
from ..sources.projection import lines, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(block.alias("block_id"), F.col("o_orderkey").alias("index"), "o_custkey", "o_totalprice")


@query("select date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, o_orderkey as index, row_number() over (order by o_orderdate, o_orderkey) - 1 tx_id from orders")
def raw_transaction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.transaction_ids(_orders(spark, sf_dir)).select("block_id", "index", "tx_id")


_BLOCKS = """with t as (select date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, row_number() over (order by o_orderdate, o_orderkey) - 1 tx_id, o_orderkey from orders)
    select block_id, string_agg(tx_id || ':1:' || (select count(*) from lineitem where l_orderkey = o_orderkey), ',' order by tx_id) txs from t group by block_id"""


@query(_BLOCKS)
def raw_block_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("index")).agg(F.collect_list(F.lit(1)).alias("outputs"))
    txs = reshape.transaction_ids(_orders(spark, sf_dir)).join(count, "index", "left")
    txs = txs.withColumns({"inputs": F.array(F.lit(1)), "outputs": F.coalesce("outputs", F.array().cast("array<int>")), "total_input": F.lit(0), "total_output": F.lit(0)})
    shown = F.transform("txs", lambda t: F.concat_ws(":", *[t[c].cast("string") for c in ("tx_id", "no_inputs", "no_outputs")]))
    return reshape.block_summaries(txs).select("block_id", F.array_join(shown, ",").alias("txs"))


def _hashed(key: str):
    return F.unhex(F.md5(F.col(key).cast("string").cast("binary")))


@query(
    """select md5(l_orderkey::varchar) spending_tx, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::int - 1 spending_input_index,
    md5(l_partkey::varchar) spent_tx, substr(md5(l_partkey::varchar), 1, 5) spent_tx_prefix, l_suppkey::int spent_output_index from lineitem"""
)
def raw_spending_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("n", _hashed("l_partkey").alias("spent_transaction_hash"), F.col("l_suppkey").cast("int").alias("spent_output_index"))
    txs = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("inputs")).withColumn("tx_hash", _hashed("l_orderkey"))
    _, spent = reshape.spending_tables(txs)
    return spent.select(F.lower(F.hex("spending_tx_hash")).alias("spending_tx"), "spending_input_index", F.lower(F.hex("spent_tx_hash")).alias("spent_tx"), "spent_tx_prefix", "spent_output_index")


@query("select l_orderkey, l_partkey, p_retailprice, p_name from lineitem left join part on l_partkey = p_partkey and l_suppkey % 2 = p_partkey % 2")
def raw_resolved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ins = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("spent_tx_hash"), (F.col("l_suppkey") % 2).alias("spent_output_index"))
    outs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tx_hash"), (F.col("p_partkey") % 2).alias("index"), F.col("p_name").alias("address"), F.col("p_brand").alias("type"), F.col("p_retailprice").alias("value"))
    out = reshape.resolved_inputs(ins, outs, strict=False)
    return out.select("l_orderkey", F.col("spent_tx_hash").alias("l_partkey"), F.col("value").alias("p_retailprice"), F.col("address").alias("p_name"))


@query("select s_suppkey, '0x' || substr(md5(s_name) || md5(s_name || 'x'), 1, 40) address, 'evm' kind from supplier")
def address_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit("0x"), F.substring(F.concat(F.md5("s_name"), F.md5(F.concat("s_name", F.lit("x")))), 1, 40))
    wrong = F.lit(" 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb or bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5")
    texts = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("pay to "), address, F.lit(", not "), wrong, F.lit(" again "), address).alias("text"))
    return scan.addresses_in(texts, "s_suppkey", "text")


#: An address of each kind, each with its checksum, and what each kind is called.
SAMPLES = (
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "p2pkh"),
    ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "p2sh"),
    ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "segwit"),
    ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "evm"),
    ("TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t", "tron"),
)


@query(
    "select doc_id, case doc_id % 6 " + " ".join(f"when {i} then '{a}'" for i, (a, _) in enumerate(SAMPLES)) + " else '0x' || md5(doc_id::varchar) || '01234567' end address, case doc_id % 6 "
    + " ".join(f"when {i} then '{k}'" for i, (_, k) in enumerate(SAMPLES)) + " else 'evm' end kind from documents"
)
def address_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in whole documents, each of which gets one put into its middle, and one with a wrong checksum at its end."""
    n = F.col("doc_id") % 6
    planted = F.coalesce(*[F.when(n == i, F.lit(a)) for i, (a, _) in enumerate(SAMPLES)], F.concat(F.lit("0x"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("01234567")))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    whole = F.concat(F.substr(text, F.lit(1), half), F.lit(" "), planted, F.lit(" "), F.substr(text, half + 1), F.lit(" 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb"))
    return scan.addresses_in(table(spark, sf_dir, "documents").select("doc_id", whole.alias("text")), "doc_id", "text")


@query(
    """with l as (select l_orderkey, p_brand, sum(cast(round(l_quantity) as bigint)) q, sum(cast(round(l_extendedprice * 100) as bigint)) c from lineitem join part on p_partkey = l_partkey group by all)
    select l_orderkey tx_id, 'me' sender, 'coin' asset_in, sum(c)::bigint amount_in, max(p_brand) asset_out, sum(q)::bigint amount_out from l group by l_orderkey having count(*) = 1"""
)
def transaction_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines(spark, sf_dir).join(parts, F.col("p_partkey") == F.col("l_partkey"))
    paid = rows.select(F.col("l_orderkey").alias("tx_id"), F.lit("me").alias("sender"), F.lit("me").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("target"), F.lit("coin").alias("asset"), F.col("cents").alias("amount"))
    got = rows.select("l_orderkey", F.lit("me"), F.concat(F.lit("S"), "l_suppkey"), F.lit("me"), "p_brand", F.round("l_quantity").cast("long"))
    return swaps.swaps(paid.union(got))


@query("with b as (select distinct date_diff('day', date '1995-01-01', o_orderdate::date)::int b from orders) select b + 1 gap_start, nxt - 1 gap_end from (select b, lead(b) over (order by b) nxt from b) where nxt > b + 1")
def missing_block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.missing_ranges(_orders(spark, sf_dir), "block_id")


@query("with b as (select distinct date_diff('day', date '1995-01-01', o_orderdate::date)::int b from orders) select max(b) frontier from b where b < (select min(b) from b where b % 17 = 16)")
def rate_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _orders(spark, sf_dir).select("block_id").distinct()
    return frontier(blocks, blocks.filter("block_id % 17 <> 16"))


@query(
    """with n as (select l_suppkey, count(*) c from lineitem group by l_suppkey) select 'large' side, count(*) as rows, count(distinct l_suppkey) keys from lineitem join n using (l_suppkey) where c > 600
    union all select 'small', count(*), count(distinct l_suppkey) from lineitem join n using (l_suppkey) where c <= 600"""
)
def oversized_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, large = lake.oversized_keys(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey"), ["l_suppkey"], 600)
    count = lambda df, name: df.agg(F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("keys")).select(F.lit(name).alias("side"), "rows", "keys")
    return count(large, "large").union(count(small, "small"))


@query("select 'net' network, o_custkey address, arg_max(o_orderpriority, o_orderkey) priority, max(o_orderkey) o_orderkey from orders group by o_custkey")
def latest_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of several records of a key, of an old and a new table."""
    rows = table(spark, sf_dir, "orders").select(F.lit("net").alias("network"), F.col("o_custkey").alias("address"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return latest_mapping(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"), "o_orderkey")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then '76a914' || lpad(lower(hex(o_custkey)), 40, '0') || '88ac' when o_orderkey % 3 = 1 then '0014' || lpad(lower(hex(o_custkey)), 40, '0') else '6a00' end script, case o_orderkey % 3 when 0 then 'p2pkh' when 1 then 'p2wpkh' else 'nulldata' end kind, case when o_orderkey % 3 < 2 then lpad(lower(hex(o_custkey)), 40, '0') end payload from orders")
def script_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lpad(F.lower(F.hex("o_custkey")), 40, "0")
    script = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("76a914"), body, F.lit("88ac"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("0014"), body)).otherwise("6a00")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", script.alias("script"))
    return rows.select("o_orderkey", "script", codecs.script_type(F.col("script")).alias("kind"), codecs.script_payload(F.col("script")).alias("payload"))


@query("select l_orderkey, l_linenumber, (cast(round(l_extendedprice * 100) as hugeint) * 1000000007 * 1000003)::varchar as value from lineitem")
def uint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as 256-bit hexadecimal digits and read again."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(12,0)")
    number = cents * F.lit(1_000_000_007).cast("decimal(10,0)") * F.lit(1_000_003).cast("decimal(7,0)")
    high, low = F.floor(number / F.lit(2**48).cast("decimal(15,0)")).cast("long"), (number % F.lit(2**48).cast("decimal(15,0)")).cast("long")
    digits = F.lpad(F.concat(F.hex(high), F.lpad(F.hex(low), 12, "0")), 64, "0")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evm.uint(digits).cast("string").alias("value"))


@query("select 'hashed' kind, count(distinct p_name) addresses, count(distinct p_name) ids, 0 shared from part union all select 'remainder', count(distinct p_name), 5, 5 from part")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from a hash of the name, and from its remainder by 5, which many names share."""
    hashed = ids.hash_ids(table(spark, sf_dir, "part").select("p_name"), "p_name")

    def counted(df: DataFrame, kind: str) -> DataFrame:
        shared = ids.id_collisions(df, "p_name").withColumn("shared", F.lit(1)).select("address_id", "shared")
        joined = df.groupBy("address_id").agg(F.count("*").alias("n")).join(shared, "address_id", "left")
        return joined.agg(F.sum("n").alias("addresses"), F.count("*").alias("ids"), F.count("shared").cast("int").alias("shared")).select(F.lit(kind).alias("kind"), "addresses", "ids", "shared")

    return counted(hashed, "hashed").union(counted(hashed.withColumn("address_id", F.pmod("address_id", F.lit(5))), "remainder"))


@query("select o_custkey, o_orderstatus, o_orderkey, rank from (select o_custkey, o_orderstatus, o_orderkey, dense_rank() over (order by o_totalprice desc) rank from orders) where rank <= 10")
def largest_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").select(F.col("o_totalprice")).distinct().orderBy(F.desc("o_totalprice")).limit(10)
    ranked = top.groupBy().agg(F.sort_array(F.collect_list("o_totalprice"), False).alias("all"))  # ten values
    ranked = ranked.select(F.posexplode("all").alias("p", "o_totalprice")).select((F.col("p") + 1).cast("long").alias("rank"), "o_totalprice")
    return table(spark, sf_dir, "orders").join(F.broadcast(ranked), "o_totalprice").select("o_custkey", "o_orderstatus", "o_orderkey", "rank")
