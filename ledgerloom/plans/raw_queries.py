"""Queries over raw rows of chains: planted mixing rounds, reshaped tables, traces, and the second kind of account chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, evm
from ..operators import heuristics, reshape, tron
from ..plans.stage import new_folder
from ..sources.lake import Lake
from ..sources.projection import lines, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _part(address: str, value: Column, count: int, start: int = 0) -> Column:
    """``count`` inputs or outputs with addresses of their own."""
    return F.transform(F.sequence(F.lit(start), F.lit(start + count - 1)), lambda i: F.struct(F.array(F.concat(F.lit(address), i.cast("string"))).alias("address"), (value + i * 0).cast("long").alias("value"), F.lit(0).alias("address_type")))


def _rest(count: int, start: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(F.array(F.concat(F.lit("r"), (i + start).cast("string"))).alias("address"), (345_678 + i * 1000).cast("long").alias("value"), F.lit(0).alias("address_type")))


@query(
    """select o_orderkey tx_id, false stonewall, s = 0 joinmarket, s = 0 wasabi_10, s in (0, 1) wasabi_11, s = 2 wasabi_20, case when s = 2 then 2 end wasabi_20_participants, s = 3 whirlpool,
    case when s = 3 then 1000000::bigint end whirlpool_pool, s = 4 whirlpool_tx0, case when s = 4 then 1000000::bigint end whirlpool_tx0_pool from (select o_orderkey, o_orderkey % 8 s from orders)"""
)
def mixing_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a transaction of the shape of one mixing protocol, or of none."""
    n = F.lit(1)
    bare = F.array(F.struct(F.array().cast("array<string>").alias("address"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("address_type")))
    coin = lambda v: F.lit(v) * n
    shapes = [
        (_part("i", coin(11_000_000), 12), F.concat(_part("o", coin(10_000_000), 12), _rest(12, 0))),
        (_part("i", coin(31_000_000), 12), F.concat(_part("o", coin(10_000_000), 4), _part("p", coin(20_000_000), 5), _part("q", coin(40_000_000), 4), _rest(12, 0))),
        (_part("i", coin(900_000), 24), F.concat(_part("o", coin(1_000_003), 3), _part("p", coin(2_000_003), 3), _part("q", coin(3_000_003), 3), _rest(4, 0))),
        (F.concat(_part("i", coin(1_000_000), 3), _part("j", coin(1_000_500), 2)), _part("o", coin(1_000_000), 5)),
        (_part("i", coin(3_100_000), 1), F.concat(_part("o", coin(1_000_500), 3), _part("f", coin(50_000), 1), bare)),
    ]
    shape, kind = F.col("o_orderkey") % 8, "array<struct<address: array<string>, value: bigint, address_type: int>>"
    pick = lambda at, plain: F.coalesce(*[F.when(shape == i, s[at].cast(kind)) for i, s in enumerate(shapes)], plain.cast(kind))
    txs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.lit(False).alias("coinbase"), pick(0, _part("i", coin(70_000), 1)).alias("inputs"), pick(1, F.concat(_part("o", coin(40_000), 1), _part("p", coin(29_000), 1))).alias("outputs"))
    return heuristics.mixing(txs).drop("joinmarket_participants", "wasabi_11_confidence")


_TRON = """with o as (
    select md5(o_orderkey::varchar) tx_hash, date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, o_orderkey k, 'C' || o_custkey from_address,
        case when o_orderkey % 11 <> 0 then 'S' || (o_orderkey % 10) end to_address, case when o_orderkey % 11 = 0 then 'N' || o_orderkey end made, cast(round(o_totalprice * 100) as bigint) as value,
        o_orderkey % 97 + 1 fee, case when o_orderkey % 13 = 0 then 0 else 1 end status, row_number() over (partition by o_orderdate::date order by o_orderkey) - 1 i from orders
), ln as (
    select *, cast(round(l_extendedprice * 100) as bigint) cents, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 n from lineitem
), t as (
    select tx_hash, block_id, i * 100 + n trace_index, 'S' || l_suppkey caller, 'C' || (l_partkey % 100) receiver, cents as value, case when n % 4 = 3 then 'create' else 'call' end note,
        coalesce(l_quantity::int % 7 = 0, false) rejected, l_partkey % 9 = 0 token from ln join o on k = l_orderkey
), moving as (select * from t where not rejected and note = 'call' and not token
), tok as (select block_id, i trace_index, from_address, to_address, 'T' || (k % 3) ticker, value from o where k % 17 = 0 and to_address is not null
), seen as (
    select from_address a, (block_id, false, i - 1000000, true) f from o union all select coalesce(to_address, made), (block_id, false, i - 1000000, false) from o
    union all select caller, (block_id, false, trace_index, true) from moving union all select receiver, (block_id, false, trace_index, false) from moving
    union all select from_address, (block_id, true, trace_index, true) from tok union all select to_address, (block_id, true, trace_index, false) from tok
), ids as (select a address, row_number() over (order by min(f), a) address_id from seen group by a)
"""


class Tron:
    """The tables of the second kind of account chain, made from orders and their lines."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from pyspark.sql import Window

        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        key = F.col("o_orderkey")
        orders = table(spark, sf_dir, "orders").withColumn("block_id", day)
        place = F.row_number().over(Window.partitionBy("block_id").orderBy("o_orderkey")) - 1
        self.txs = orders.select(
            F.md5(key.cast("string").cast("binary")).alias("tx_hash"),
            "block_id",
            key.alias("k"),
            place.alias("transaction_index"),
            F.concat(F.lit("C"), "o_custkey").alias("from_address"),
            F.when(key % 11 != 0, F.concat(F.lit("S"), key % 10)).alias("to_address"),
            F.when(key % 11 == 0, F.concat(F.lit("N"), key)).alias("receipt_contract_address"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("value"),
            (key % 97 + 1).alias("fee"),
            F.when(key % 13 == 0, 0).otherwise(1).alias("receipt_status"),
        )
        rows = lines(spark, sf_dir).join(self.txs.select("k", "tx_hash", "block_id", "transaction_index"), F.col("k") == F.col("l_orderkey"))
        odd = F.col("l_quantity").cast("int") % 7
        self.traces = rows.select(
            "tx_hash",
            "block_id",
            (F.col("transaction_index") * 100 + F.col("n")).alias("trace_index"),
            F.concat(F.lit("S"), "l_suppkey").alias("caller_address"),
            F.concat(F.lit("C"), F.col("l_partkey") % 100).alias("transferto_address"),
            F.col("cents").alias("call_value"),
            F.when(F.col("n") % 4 == 3, "create").otherwise("call").alias("note"),
            F.when(odd == 0, True).when(odd > 1, False).alias("rejected"),
            F.when(F.col("l_partkey") % 9 == 0, 5).alias("call_token_id"),
        )
        some = self.txs.filter((F.col("k") % 17 == 0) & F.col("to_address").isNotNull())
        self.tokens = some.select("block_id", F.col("transaction_index").alias("trace_index"), "from_address", "to_address", F.concat(F.lit("T"), F.col("k") % 3).alias("ticker"), "value")

    @property
    def ids(self) -> DataFrame:
        return tron.address_ids(tron.known_receivers(self.txs), tron.moving_traces(self.traces), self.tokens, 1_000_000)


@query(_TRON + "select address, address_id from ids")
def trx_address_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tron(spark, sf_dir).ids


@query(_TRON + "select count(*) addresses, count(*) ids from ids")
def trx_address_ids_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tron.address_ids_by_hash(Tron(spark, sf_dir).ids.select("address"), "address", 7)
    return made.agg(F.count_distinct("address").alias("addresses"), F.count_distinct("address_id").alias("ids"))


@query(_TRON + "select address_id from ids where address in (select made from o where status = 1 union select receiver from t where not rejected and note = 'create')")
def trx_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Tron(spark, sf_dir)
    return tron.contracts(x.txs, x.traces, x.ids)


@query(
    _TRON
    + """select a address, currency, sum(v)::bigint balance from (select to_address a, 'coin' currency, value v from o where status = 1 union all select from_address, 'coin', -value from o where status = 1 union all select from_address, 'coin', -fee from o
    union all select receiver, 'coin', value from moving union all select caller, 'coin', -value from moving union all select to_address, ticker, value from tok union all select from_address, ticker, -value from tok) where a is not null group by all"""
)
def trx_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Tron(spark, sf_dir)
    return tron.balances(x.txs, x.traces, x.tokens).withColumn("balance", F.col("balance").cast("long"))


@query(
    _TRON
    + """select tx_hash, block_id, trace_index::int trace_index, s.address_id src_id, d.address_id dst_id, value, value::double * (block_id % 5 + 1)::double / 1e6 usd
    from (select tx_hash, block_id, null trace_index, from_address a, to_address b, value from o where status = 1 union all select tx_hash, block_id, trace_index, caller, receiver, value from moving) left join ids s on s.address = a left join ids d on d.address = b"""
)
def trx_encoded_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Tron(spark, sf_dir)
    rates = x.txs.select("block_id").distinct().withColumn("fiat_values", F.array(F.lit(0.0), (F.col("block_id") % 5 + 1).cast("double")))
    return tron.encoded(x.txs, x.traces, x.ids, rates).withColumn("usd", F.get("fiat_values", F.lit(1))).drop("fiat_values")


_SCRIPTS = "case l_linenumber % 4 when 0 then 'pubkeyhash' when 1 then 'scripthash' when 2 then 'nulldata' else 'odd' end"


@query(
    """with ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 n from lineitem)
    select l_orderkey tx_id, substr(md5(l_orderkey::varchar), 1, 5) tx_prefix, (l_orderkey // 1000)::int tx_id_group, n::int n, case when l_linenumber % 4 <> 2 then 'S' || l_suppkey end address, cast(round(l_extendedprice * 100) as bigint) as value,
    case l_linenumber % 4 when 0 then 2 when 1 then 4 when 2 then 6 end address_type, lpad(lower(hex(l_suppkey)), 8, '0') script from ln"""
)
def raw_utxo_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("l_linenumber") % 4 == i, F.lit(k)) for i, k in enumerate(("pubkeyhash", "scripthash", "nulldata", "odd"))])
    addresses = F.when(F.col("l_linenumber") % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("S"), "l_suppkey")))
    one = F.struct("n", F.struct(addresses.alias("addresses"), F.col("cents").alias("value"), kind.alias("type"), F.lpad(F.hex("l_suppkey"), 8, "0").alias("script_hex")).alias("o"))
    rows = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.array_sort(F.collect_list(one)).alias("each"))
    rows = rows.select("tx_id", F.unhex(F.md5(F.col("tx_id").cast("string").cast("binary"))).alias("tx_hash"), F.transform("each", lambda x: x["o"]).alias("outputs"))
    shaped = reshape.raw_utxo_transactions(rows.withColumn("inputs", F.slice("outputs", 1, 0)), 1000)
    out = shaped.select("tx_id", "tx_prefix", "tx_id_group", F.posexplode("outputs").alias("n", "o"))
    return out.select("tx_id", "tx_prefix", "tx_id_group", "n", F.get("o.address", F.lit(0)).alias("address"), "o.value", "o.address_type", F.lower(F.hex("o.script")).alias("script"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then '' else md5(o_orderkey::varchar) end topic0, (date_diff('day', date '1995-01-01', o_orderdate::date) // 100)::int block_id_group from orders")
def raw_account_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    topics = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))))).otherwise(F.array().cast("array<binary>"))
    logs = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("block_id"), topics.alias("topics"), F.lit(1).alias("partition"))
    return reshape.in_group(reshape.prepared_logs(logs), 100).select("o_orderkey", F.lower(F.hex("topic0")).alias("topic0"), "block_id_group")


@query(
    """with b as (select date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, o_orderkey, row_number() over (partition by o_orderdate::date order by o_orderkey) - 1 i, 'C' || o_custkey a from orders)
    select block_id, i + 1000000000 trace_index, null trace_address, a to_address, (o_orderkey * 1000000000)::varchar as value, 'reward' trace_type, block_id // 100 block_id_group from b
    union all select block_id, i, '0,' || i, a, '5', 'call', block_id // 100 from b"""
)
def raw_account_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, and the rewards of withdrawals written as traces."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    one = F.struct("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("address"), F.col("o_orderkey").alias("amount"))
    blocks = table(spark, sf_dir, "orders").groupBy(day.alias("block_id")).agg(F.array_sort(F.collect_list(one)).alias("withdrawals"))
    calls = blocks.select("block_id", F.posexplode("withdrawals").alias("trace_index", "w"))
    calls = calls.select("block_id", "trace_index", F.array(F.lit(0), F.col("trace_index")).alias("trace_address"), F.col("w.address").alias("to_address"), F.lit(5).cast("decimal(38,0)").alias("value"), F.lit("call").alias("trace_type"), F.lit(0).alias("partition"))
    out = reshape.raw_traces(calls, blocks, 100)
    return out.withColumns({"value": F.col("value").cast("string"), "trace_index": F.col("trace_index").cast("long"), "block_id_group": F.col("block_id_group").cast("long")})


@query(
    """with ln as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 n, case when l_quantity::int % 5 = 0 then 0 else 1 end s from lineitem),
    t as (select k, n, s, case when n = 0 then '/' when n % 2 = 1 then '/' || (n // 2) || '/' else '/' || ((n - 1) // 2) || '/0/' end path from ln)
    select k tx_hash, n::int n, case when s = 0 or exists (select 1 from t a where a.k = t.k and a.s = 0 and starts_with(t.path, a.path)) then 0 else 1 end status from t"""
)
def failed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of a tree three levels deep; one fails with any trace above it."""
    n = F.col("n")
    path = F.when(n == 0, F.array().cast("array<int>")).when(n % 2 == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(F.array(F.floor((n - 1) / 2).cast("int"), F.lit(0)))
    traces = lines(spark, sf_dir).select(F.col("l_orderkey").alias("tx_hash"), "n", path.alias("trace_address"), F.when(F.col("l_quantity").cast("int") % 5 == 0, 0).otherwise(1).alias("status"))
    return evm.failed_by_parent(traces).select("tx_hash", "n", "status")


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber % 5 in (0, 1) and l_suppkey % 2 = 0")
def undecodable_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer logs of known contracts with a topic too few, or with data that is no number."""
    word = F.lpad(F.hex("l_partkey"), 64, "0")
    topics = F.when(F.col("l_linenumber") % 5 == 0, F.array(F.lit(evm.TRANSFER), word)).otherwise(F.array(F.lit(evm.TRANSFER), word, word))
    data = F.when(F.col("l_linenumber") % 5 == 1, F.lit("0x")).otherwise(word)
    logs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("address"), topics.alias("topics"), data.alias("data"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("contract"), F.lit("T").alias("ticker"))
    return evm.undecodable(logs, known).select("l_orderkey", "l_linenumber")


@query(
    """select o_orderkey, kind from (select o_orderkey, case o_orderkey % 9 when 0 then 'p2pkh' when 1 then 'p2sh' when 2 then 'p2wpkh' when 3 then 'p2wsh' when 4 then 'p2tr' when 5 then 'p2pk' when 6 then 'multisig' when 7 then 'nulldata' else 'nonstandard' end kind from orders)"""
)
def script_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of output script, told by its bytes."""
    body = lambda n: F.lpad(F.lower(F.hex("o_custkey")), n, "0")
    made = ("76a914", 40, "88ac"), ("a914", 40, "87"), ("0014", 40, ""), ("0020", 64, ""), ("5120", 64, ""), ("2102", 64, "ac"), ("512102", 64, "51ae"), ("6a04", 8, ""), ("ff", 10, "")
    script = F.coalesce(*[F.when(F.col("o_orderkey") % 9 == i, F.concat(F.lit(a), body(n), F.lit(b))) for i, (a, n, b) in enumerate(made)])
    return table(spark, sf_dir, "orders").select("o_orderkey", codecs.script_type(script).alias("kind"))


@query("select s_suppkey, '0x' || substr(md5(s_name) || md5(s_name || 'x'), 1, 40) address, '0x' || substr(md5(s_name) || md5(s_name || 'x'), 1, 40) back, 34 length from supplier")
def tron_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written in the other chain's form and read back."""
    address = F.concat(F.lit("0x"), F.substring(F.concat(F.md5("s_name"), F.md5(F.concat("s_name", F.lit("x")))), 1, 40))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", address.alias("address")).withColumn("other", codecs.tron_address(F.col("address")))
    return rows.select("s_suppkey", "address", codecs.evm_address(F.col("other")).alias("back"), F.length("other").alias("length"))


@query(
    """select o_orderkey, date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id, case when o_orderkey % 2 = 0 then 'first' else 'second' end origin from orders
    where date_diff('day', date '1995-01-01', o_orderdate::date) <= 2000"""
)
def lake_merge_and_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake table after an append, a merge of which half the keys are there, an overwrite, a compaction and a discard of the last blocks."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("block_id"), F.floor(day / 500).cast("int").alias("part"))
    lake = Lake(spark, new_folder(spark, "lake"))
    lake.append("blocks", rows.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("first")), "part")
    lake.merge_new("blocks", rows.withColumn("origin", F.lit("second")), ["o_orderkey"], "part")
    lake.compact("blocks", "part", 1)
    lake.discard_above("blocks", 2000, "part")
    return lake.read("blocks").select("o_orderkey", "block_id", "origin")


@query("select chunk, count(*) n from (select date_diff('day', date '1995-01-01', o_orderdate::date) // 90 chunk from orders) group by chunk")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return reshape.chunks(table(spark, sf_dir, "orders").select(day.alias("block_id")), 90).groupBy("chunk").agg(F.count("*").alias("n"))


@query("select max(b) + 1 no_blocks, 788918400 + max(b)::bigint * 86400 as timestamp, (select count(*) from lineitem) no_txs from (select date_diff('day', date '1995-01-01', o_orderdate::date)::int b from orders)")
def raw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    blocks = table(spark, sf_dir, "orders").select(day.alias("block_id")).distinct().withColumn("timestamp", F.lit(788_918_400) + F.col("block_id").cast("long") * 86_400)
    return reshape.summary(blocks, table(spark, sf_dir, "lineitem"))
