"""From lake rows to raw tables: dense transaction ids, references between transactions, prepared logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ids

#: Numbers of the output script kinds.
SCRIPT_TYPES = {"nonstandard": 0, "pubkey": 1, "pubkeyhash": 2, "multisig_pubkey": 3, "scripthash": 4, "multisig": 5, "nulldata": 6, "witness_v0_keyhash": 7, "witness_v0_scripthash": 8, "witness_unknown": 9, "witness_v1_taproot": 10}


def transaction_ids(txs: DataFrame, start: int = 0) -> DataFrame:
    """Dense tx_id in the order of (block_id, index): a window inside blocks plus the counts of blocks before.

    Counts have a row for each block and are summed by blocks of blocks first, so no task
    orders more than a group of them.
    """
    counts = txs.groupBy("block_id").agg(F.count("*").alias("_n")).withColumn("_g", F.expr("block_id div 10000"))
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    before_group = F.coalesce(F.sum("_gn").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_in", inside).join(groups.select("_g", before_group.alias("_bg")), "_g").select("block_id", (F.col("_in") + F.col("_bg")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy("index")) - 1
    return txs.withColumn("_place", place).join(offsets, "block_id").withColumn("tx_id", (F.col("_before") + F.col("_place") + start).cast("long")).drop("_place", "_before")


def script_type_id(kind: Column) -> Column:
    """The number of a script kind; null for kinds that have none."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SCRIPT_TYPES.items()])


def resolved_inputs(inputs: DataFrame, outputs: DataFrame, strict: bool = True) -> DataFrame:
    """Inputs (spent_tx_hash, spent_output_index) with address, type and value of the output they spend.

    Outputs of the same batch count. ``strict`` raises while running if one isn't found;
    otherwise such inputs come back with nulls.
    """
    made = outputs.select(F.col("tx_hash").alias("spent_tx_hash"), F.col("index").alias("spent_output_index"), "address", "type", "value", F.lit(True).alias("_found"))
    out = inputs.join(made, ["spent_tx_hash", "spent_output_index"], "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no output "), F.col("spent_output_index").cast("string"), F.lit(" of "), F.hex("spent_tx_hash")))
        out = out.withColumn("value", F.when(F.col("_found"), F.col("value")).otherwise(missing.cast("long")))
    return out.drop("_found")


def spending_tables(txs: DataFrame, prefix_length: int = 5) -> tuple[DataFrame, DataFrame]:
    """(spending, spent_in): which output each input spends, by the prefix of either transaction's hash."""
    each = txs.select(F.col("tx_hash").alias("spending_tx_hash"), F.posexplode("inputs").alias("spending_input_index", "i"))
    rows = each.select("spending_tx_hash", "spending_input_index", F.col("i.spent_transaction_hash").alias("spent_tx_hash"), F.col("i.spent_output_index").alias("spent_output_index")).filter("spent_tx_hash is not null")
    by = lambda c: ids.prefix(F.hex(c), prefix_length, upper=False)
    return rows.withColumn("spending_tx_prefix", by("spending_tx_hash")), rows.withColumn("spent_tx_prefix", by("spent_tx_hash"))


def block_summaries(txs: DataFrame) -> DataFrame:
    """For each block its transactions in order, with the sizes and totals of each."""
    each = F.struct("tx_id", F.size("inputs").alias("no_inputs"), F.size("outputs").alias("no_outputs"), "total_input", "total_output")
    return txs.groupBy("block_id").agg(F.array_sort(F.collect_list(each)).alias("txs"))


def prepared_logs(logs: DataFrame) -> DataFrame:
    """topic0 is the first topic, or empty bytes, never null."""
    return logs.withColumn("topic0", F.coalesce(F.get("topics", F.lit(0)), F.lit(b"")))


def with_receipts(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    return txs.join(receipts, "tx_hash", "left")


def flat(df: DataFrame, separator: str = "_") -> DataFrame:
    """Structs as columns of their own, at every depth, as flat files need them."""
    from pyspark.sql.types import StructType

    out, nested = [], False
    for f in df.schema.fields:
        if isinstance(f.dataType, StructType):
            nested = True
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{separator}{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return flat(df.select(*out), separator) if nested else df


def in_group(rows: DataFrame, size: int, lake_only: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Lake rows as raw rows: the group of the block, without columns that only the lake has."""
    return rows.drop(*lake_only).withColumn("block_id_group", ids.block_group(F.col("block_id"), size))


def raw_utxo_transactions(txs: DataFrame, size: int, prefix_length: int = 5) -> DataFrame:
    """Transactions as they are stored: numbers for script kinds, scripts as bytes, prefix and group.

    Inputs and outputs have addresses, value, type (a name) and script_hex. Those of a kind
    without addresses have null addresses; a kind without a number has a null one.
    """

    def one(x: Column) -> Column:
        addresses = F.when(F.size(x["addresses"]) > 0, x["addresses"])
        return F.struct(addresses.alias("address"), x["value"].alias("value"), script_type_id(x["type"]).alias("address_type"), F.unhex(x["script_hex"]).alias("script"))

    shaped = txs.withColumns({c: F.transform(c, one) for c in ("inputs", "outputs")})
    return shaped.withColumns({"tx_prefix": ids.prefix(F.hex("tx_hash"), prefix_length, upper=False), "tx_id_group": ids.id_group(F.col("tx_id"), size)})


def raw_account_transactions(txs: DataFrame, size: int, prefix_length: int = 5) -> DataFrame:
    """Account transactions with their prefix, group, and access list as (address, storage_keys)."""
    entries = F.transform("access_list", lambda x: F.struct(x["address"].alias("address"), x["storageKeys"].alias("storage_keys")))
    return in_group(txs, size).withColumns({"tx_hash_prefix": ids.prefix(F.hex("tx_hash"), prefix_length, upper=False), "access_list": entries})


def raw_traces(traces: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Traces and the rewards that withdrawals pay, with the path of each trace as text."""
    from ..functions.evm import withdrawals

    path = F.array_join(F.transform("trace_address", lambda n: n.cast("string")), ",")
    return in_group(traces.withColumn("trace_address", path).unionByName(withdrawals(blocks), allowMissingColumns=True), size)


def raw_fees(fees: DataFrame, prefix_length: int = 5) -> DataFrame:
    """Fees with the prefix by which they are stored; missing parts are 0."""
    parts = [c for c in fees.columns if c != "tx_hash"]
    return fees.fillna(0, parts).withColumn("tx_hash_prefix", ids.prefix(F.hex("tx_hash"), prefix_length, upper=False))


def with_types(txs: DataFrame, types: DataFrame) -> DataFrame:
    """Transactions with their type, from a table (tx_hash, transaction_type)."""
    return txs.join(types, "tx_hash", "left")


def configuration(**values) -> list[tuple[str, str]]:
    """Settings of a run as (key, value) rows, in the order of their names, nulls left out."""
    return [(k, str(v)) for k, v in sorted(values.items()) if v is not None]


def summary(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """One row: no_blocks (the highest and one), no_txs, and the timestamp of the last block."""
    heights = blocks.agg((F.max("block_id") + 1).alias("no_blocks"), F.max_by("timestamp", "block_id").alias("timestamp"))
    return heights.crossJoin(txs.agg(F.count("*").alias("no_txs")))  # one row each


def chunks(rows: DataFrame, size: int, column: str = "block_id") -> DataFrame:
    """Rows with the fixed-size chunk that they are handled in."""
    return rows.withColumn("chunk", F.floor(F.col(column) / size).cast("long"))


def periods(start: str, end: str, spark) -> DataFrame:
    """(day, first_second, last_second) of every day from ``start`` to ``end``, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    begin = F.unix_date("day").cast("long") * 86_400
    return days.select("day", begin.alias("first_second"), (begin + 86_399).alias("last_second"))


def merged_content(tables: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of several block ranges as one table of each name; a range without a table adds no rows."""
    out: dict[str, DataFrame] = {}
    for one in tables:
        for name, df in one.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out
