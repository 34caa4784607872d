"""Events and calls of contracts, decoded by a table of signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import keccak256
from .evm import address_of, uint


def topic(signature: str) -> str:
    """The first topic of an event, such as ``Transfer(address,address,uint256)``, as digits."""
    return keccak256(signature.encode()).hex()


def selector(signature: str) -> str:
    """The first four bytes of a call's input, as digits."""
    return topic(signature)[:8]


def _read(kind: str, word: Column) -> Column:
    if kind == "address":
        return address_of(word)
    if kind == "bool":
        return F.when(uint(word).isNotNull(), (uint(word) != 0).cast("string"))
    return uint(word).cast("string") if kind.startswith("uint") else F.lower(word)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row.

    A column that is named twice stands in the plan twice, with all it is made of; offsets,
    lengths and words, each named by what follows, would multiply to thousands of copies.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _at(data: Column, digits: Column) -> Column:
    """Where the word begins that an offset of bytes points to; null beyond the data."""
    return _once(_once(digits, uint), lambda offset: F.when(offset * 2 + 64 <= F.length(data), (offset * 2).cast("int")))


def long_value(kind: str, data: Column, place: int) -> Column:
    """A parameter of a type of any length, whose offset is the word number ``place`` of ``data``.

    ``bytes`` as digits, ``string`` as text, and arrays of one-word types, such as
    ``uint256[]``, as a JSON array of texts. Null if an offset or a length leads beyond the
    data. ``data`` is without the selector.
    """

    def body(data: Column, start: Column, count: Column) -> Column:
        left = F.length(data) - start - 64
        if kind.endswith("[]"):
            n = F.when(count * 64 <= left, count.cast("int"))
            index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
            return F.to_json(F.transform(index, lambda i: _once(F.substring(data, start + 65 + i * 64, F.lit(64)), lambda word: _read(kind[:-2], word))))
        digits = F.when(count * 2 <= left, F.lower(F.substring(data, start + 65, (count * 2).cast("int"))))
        return digits if kind == "bytes" else F.try_validate_utf8(F.unhex(digits).cast("string"))

    def counted(data: Column, start: Column) -> Column:
        return _once(_once(F.substring(data, start + 1, F.lit(64)), uint), lambda count: body(data, start, count))

    return _once(data, lambda data: _once(_at(data, F.substring(data, 1 + 64 * place, 64)), lambda start: counted(data, start)))


def _param(kind: str, data: Column, place: int) -> Column:
    if kind in ("bytes", "string") or kind.endswith("[]"):
        return long_value(kind, data, place)
    return _once(F.substring(data, 1 + 64 * place, 64), lambda word: _read(kind, word))


def _arguments(params: list) -> Callable[[Column], Column]:
    return lambda data: F.create_map(*[x for i, (label, kind) in enumerate(params) for x in (F.lit(label), _param(kind, data, i))])


def decode_events(logs: DataFrame, events: dict[str, dict]) -> DataFrame:
    """``logs`` with event and arguments (a map from name to text), for known events only.

    ``logs`` has topics (array of digits) and data (digits). ``events`` maps a signature to
    its name and its parameters, each (name, type, indexed): types that fill one word, and
    where not indexed also bytes, string and arrays of one-word types.
    The dictionary is written into the plan, so nothing is joined or sent around.
    """
    first, name, found = F.get("topics", F.lit(0)), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for signature, event in events.items():
        at_topic, at_data, pairs = 1, 0, []
        for label, kind, indexed in event["params"]:
            value = _read(kind, F.get("topics", F.lit(at_topic))) if indexed else _param(kind, F.col("data"), at_data)
            at_topic, at_data = at_topic + indexed, at_data + (not indexed)
            pairs += [F.lit(label), value]
        hit = (first == topic(signature)) & (F.size("topics") == at_topic) & (F.length("data") >= 64 * at_data)
        name, found = F.when(hit, event["name"]).otherwise(name), F.when(hit, F.create_map(*pairs)).otherwise(found)
    return logs.withColumns({"event": name, "arguments": found}).filter("event is not null")


def decode_calls(txs: DataFrame, calls: dict[str, dict]) -> DataFrame:
    """``txs`` with function and arguments from their input (digits); null where it isn't known."""
    data, name, found = F.col("input"), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for signature, call in calls.items():

        hit = F.lower(F.substring(data, 1, 8)) == selector(signature)
        name, found = F.when(hit, call["name"]).otherwise(name), F.when(hit, _once(F.substring(data, F.lit(9), F.length(data)), _arguments(call["params"]))).otherwise(found)
    return txs.withColumns({"function": name, "arguments": found})


PAIR_CREATED = {"PairCreated(address,address,address,uint256)": {"name": "PairCreated", "params": [("token0", "address", True), ("token1", "address", True), ("pair", "address", False), ("n", "uint256", False)]}}


def exchange_pairs(logs: DataFrame) -> DataFrame:
    """(pair, token0, token1) of the pairs that exchange factories have announced."""
    found = decode_events(logs, PAIR_CREATED)
    return found.select(*[F.try_element_at("arguments", F.lit(k)).alias(k) for k in ("pair", "token0", "token1")]).distinct()
