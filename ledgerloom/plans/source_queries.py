"""Queries over sources and sinks: packs, flat files, sinks that fall behind, long contract types, memos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import abi, memo
from ..plans.stage import new_folder
from ..sources import packs
from ..sources.lake import Lake, catch_up, divergence, write_all
from ..sources.projection import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each nation: label and actor of its header hold for customers that don't say their own."""
    key = F.col("c_custkey")
    own = F.struct(F.col("c_name").alias("identifier"), F.when(key % 3 == 0, F.col("c_mktsegment")).alias("label"), F.when(key % 5 == 0, F.lit(20)).alias("confidence"))
    held = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(own).alias("tags"))
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return nation.join(held, "c_nationkey").select(F.col("n_name").alias("title"), F.when(F.col("c_nationkey") % 4 != 0, F.col("n_name")).alias("label"), F.lit(50).alias("confidence"), "tags")


_PACK_SQL = """select n_name title, case when c_custkey % 3 = 0 then c_mktsegment when c_nationkey % 4 <> 0 then n_name end as label, case when c_custkey % 5 = 0 then 20 else 50 end confidence, c_name identifier
    from customer join nation on n_nationkey = c_nationkey"""


@query(_PACK_SQL)
def tagpack_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.tags_of_packs(_packs(spark, sf_dir))


@query(f"select title, identifier, 'label' missing from ({_PACK_SQL}) where label is null")
def tagpack_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packs.incomplete(packs.tags_of_packs(_packs(spark, sf_dir)), ("label", "confidence", "identifier"))
    return found.select("title", "identifier", F.array_join("missing", ",").alias("missing"))


_FLAT = "o_orderkey, o_orderpriority || ' \"' || o_orderstatus || '\", ' || o_custkey"


@query(f"select 'csv' kind, {_FLAT} note, o_totalprice price_total, '[' || o_custkey || ',' || o_orderkey || ']' keys from orders union all select 'json', {_FLAT}, o_totalprice, '[' || o_custkey || ',' || o_orderkey || ']' from orders")
def flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with quotes, commas, structs and arrays written as files and read again."""
    note = F.concat("o_orderpriority", F.lit(' "'), "o_orderstatus", F.lit('", '), "o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), F.struct(F.col("o_totalprice").alias("total")).alias("price"), F.array("o_custkey", "o_orderkey").alias("keys"))
    csv, json = new_folder(spark, "flat"), new_folder(spark, "flat")
    packs.write_flat(rows, csv)
    packs.write_flat(rows, json, "json")
    back = packs.read_flat(spark, csv, "o_orderkey long, note string, price_total double, keys string").withColumn("kind", F.lit("csv"))
    nested = packs.read_flat(spark, json, "o_orderkey long, note string, price struct<total: double>, keys array<long>", "json")
    return back.unionByName(nested.select(F.lit("json").alias("kind"), "o_orderkey", "note", F.col("price.total").alias("price_total"), F.to_json("keys").alias("keys")))


@query("select o_orderkey, date_diff('day', date '1995-01-01', o_orderdate::date)::int block_id from orders")
def sinks_caught_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that stopped inside a block gets what it lacks from the other one, each row once."""
    block = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", block.alias("block_id"))
    a, b = (Lake(spark, new_folder(spark, "sink")) for _ in range(2))
    write_all([a, b], "orders", rows.filter("block_id < 900"))
    a.append("orders", rows.filter("block_id >= 900"))
    b.append("orders", rows.filter("block_id = 900 and o_orderkey % 2 = 0"))
    catch_up(a, b, "orders", ["o_orderkey"])
    if len(set(divergence(a, ["orders"]).values()) | set(divergence(b, ["orders"]).values())) > 1:
        raise ValueError("the sinks differ")
    return b.read("orders")


@query("select p_partkey, p_name as note, lower(hex(p_brand)) payload, case when p_partkey % 7 <> 0 then '[\"' || p_size || '\",\"' || p_partkey || '\"]' end amounts, p_size::varchar price from part")
def decoded_long_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with text, bytes and arrays encoded and decoded again; every seventh is cut in its array, which is null then."""
    word = lambda n: F.lower(F.lpad(F.hex(n), 64, "0"))
    padded = lambda c: F.rpad(F.lower(F.hex(F.col(c).cast("binary"))), 128, "0")
    size = lambda c: word(F.octet_length(c).cast("long"))
    # Four words of the head, then three parts: text and bytes of 96 bytes each with their lengths, and two numbers.
    head = F.concat(word(F.lit(128)), word(F.lit(224)), word(F.lit(320)), word("p_size"))
    tail = F.concat(size("p_name"), padded("p_name"), size("p_brand"), padded("p_brand"), word(F.lit(2)), word("p_size"), word("p_partkey"))
    signature = "note(string,bytes,uint256[],uint256)"
    known = {signature: {"name": "note", "params": [("note", "string"), ("payload", "bytes"), ("amounts", "uint256[]"), ("price", "uint256")]}}
    whole = F.concat(F.lit(abi.selector(signature)), head, tail)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, whole).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 64)).alias("input"))
    out = abi.decode_calls(rows, known)
    get = lambda k: F.try_element_at("arguments", F.lit(k))
    return out.select("p_partkey", get("note").alias("note"), get("payload").alias("payload"), get("amounts").alias("amounts"), get("price").alias("price"))


@query("select p_partkey, case when p_partkey % 4 <> 3 then 'swap' end action, case when p_partkey % 4 <> 3 then 'NET.' || p_brand end asset, case when p_partkey % 4 <> 3 then p_name end receiver, case when p_partkey % 4 = 1 then p_size::varchar end bound from part")
def bridge_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos in data outputs, with lengths of either kind; every fourth script is cut."""
    key = F.col("p_partkey")
    text = F.concat(F.when(key % 2 == 0, "=").otherwise("SWAP"), F.lit(":NET."), "p_brand", F.lit(":"), "p_name", F.when(key % 4 == 1, F.concat(F.lit(":"), "p_size")).otherwise(":"))
    size = F.lpad(F.hex(F.octet_length(text)), 2, "0")
    script = F.concat(F.lit("6a"), F.when(key % 4 == 0, size).when(key % 4 == 3, F.lit("4b")).when(key % 4 == 1, F.concat(F.lit("4c"), size)).otherwise(F.concat(F.lit("4d"), size, F.lit("00"))), F.hex(F.encode(text, "UTF-8")))
    rows = table(spark, sf_dir, "part").select("p_partkey", memo.memo_parts(memo.memo(script)).alias("m"))
    return rows.select("p_partkey", "m.action", "m.asset", "m.receiver", "m.bound")


@query(
    """with r as (select o_orderdate::date as d, round(max(o_totalprice) * 4) / 4 v from orders group by all), f as (select (date '1995-01-01' + i::int)::date as d, (1 + i % 8) / 8.0 p from range(0, 1500, 2) t(i))
    select d::varchar as day, 'EUR' currency, v as value from r union all select r.d::varchar, 'USD', v * p from r join f using (d)"""
)
def cross_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.round(F.max("o_totalprice") * 4) / 4).alias("value"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int"))
    fx = spark.range(0, 1500, 2).select(day.alias("day"), F.lit("USD").alias("currency"), ((1 + F.col("id") % 8) / 8.0).alias("per_base"))
    return packs.cross_rates(rates, fx, "EUR").withColumn("day", F.col("day").cast("string"))
