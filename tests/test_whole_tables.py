"""Queries that take whole tables, against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_EVEN, Decimal

from ledgerloom.functions import codecs
from ledgerloom.operators import tags
from ledgerloom.plans import lake_queries, lookup_queries, serving_queries, tag_queries
from ledgerloom.sources import scan
from ledgerloom.sources.projection import Ledger, table


def test_every_block_is_summarised(spark, sf_dir):
    lines = Counter(r[0] for r in table(spark, sf_dir, "lineitem").select("l_orderkey").collect())
    want = defaultdict(list)
    orders = sorted((r.o_orderdate, r.o_orderkey) for r in table(spark, sf_dir, "orders").collect())
    for n, (day, key) in enumerate(orders):
        want[str(day)[:10]].append(f"{n}:1:{lines[key]}")
    got = [r.txs for r in lake_queries.raw_block_summaries(spark, sf_dir).orderBy("block_id").collect()]
    assert got == [",".join(want[day]) for day in sorted(want)]


def test_documents_are_scanned_for_addresses_of_every_kind(spark, tmp_path):
    b58 = lambda version, fill: codecs.base58check_encode(bytes([version]) + bytes([fill]) * 20)
    good = [b58(0, 7), b58(5, 8), b58(0x30, 9), b58(0x41, 10), "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0x" + "5a" * 20]
    good += [codecs.segwit_encode(net, v, bytes([v + 3]) * size) for net in ("bc", "tb", "ltc") for v, size in ((0, 20), (0, 32), (1, 32))]
    broken = [a[:-1] + ("q" if a[-1] != "q" else "p") for a in good if not a.startswith("0x")] + ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAeD"]
    texts = [f"pay {a}, then {a}." for a in good] + [f"not {a} please" for a in broken] + [" ".join(good), "x" + good[0], "", None]
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    words = [(i, w) for i, t in enumerate(texts) for w in set(re.findall("[0-9A-Za-z]+", t or ""))]
    want = sorted((i, w, codecs.valid_address(w)) for i, w in words if codecs.valid_address(w))
    got = sorted(tuple(r) for r in scan.addresses_in(table(spark, path, "documents"), "doc_id", "text").select("doc_id", "address", "kind").collect())
    assert got == want and {w for _, w, _ in want} == set(good) and len({k for _, _, k in want}) > 4


def test_every_ledger_row_has_its_fiat_values(spark, sf_dir):
    x = Ledger(spark, sf_dir, keep=True)
    rates = {r.block_id: r.fiat_values for r in x.rates.collect()}
    cents = lambda worth: float(Decimal(repr(worth)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))
    want = []
    for r in x.ledger.collect():
        eur, usd = ([None if v is None else cents(r.value / 100.0 * v) for v in rates.get(r.block_id) or (None, None)])
        want.append((r.address_id, r.tx_id, r.value, eur, usd))
    got = [tuple(r) for r in lookup_queries.QUERIES["fiat_on_read"](spark, sf_dir, x).select("address_id", "tx_id", "value", "eur", "usd").collect()]
    assert Counter(got) == Counter(want) and max(r[0] for r in got) > 20


def test_labels_of_all_segments_are_compared(spark, sf_dir):
    grams = lambda label: {f"  {w} "[i : i + 3] for w in re.findall("[0-9a-z]+", label.lower()) for i in range(len(w) + 1)}

    def pairs(labels):
        sets = {x: grams(x) for x in labels}
        return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and sets[a] & sets[b]}

    labels = ["", "--", "one", "one two", "ONE", "zz", "two", "Two three"]
    got = tags.similar_labels(spark.createDataFrame([(x,) for x in labels * 2], "label string")).collect()
    assert {(r.a, r.b): round(r.s, 9) for r in got} == pairs(labels) and len(got) == len(pairs(labels))
    segments = [r.label for r in tag_queries.Tags(spark, sf_dir).tags.select("label").distinct().collect()]
    got = tag_queries.QUERIES["tag_label_similarity"](spark, sf_dir).collect()
    assert {(r.a, r.b): r.s for r in got} == pairs(segments) and len(got) == len(pairs(segments))
    assert any(not r.a.startswith("BUILDING") for r in got)


def test_outputs_of_every_transaction_are_listed_in_order(spark, sf_dir):
    x = Ledger(spark, sf_dir, keep=True)
    want = {r.tx_id: ",".join(f"{n}:{o.address[0]}:{o.value}" for n, o in enumerate(r.outputs)) for r in x.txs.select("tx_id", "outputs").collect()}
    got = serving_queries.QUERIES["transaction_outputs"](spark, sf_dir, x).collect()
    assert {r.tx_id: r.io for r in got} == want and len(got) == len(want) > 3
