"""The corpus operators against brute force, and their behaviour on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, grams, language_id, line_dedup, mixing, near_dedup, pii, quotation, substring_dedup, toxicity, vector_search, words
from ledgerloom.llm.common import ship
from ledgerloom.operators.components import connected_components
from ledgerloom.llm.perfect_hash import PerfectHash, Shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(texts.items()) if isinstance(texts, dict) else list(texts), schema)


def prose(rng, n):
    return " ".join(rng.choice(["ba", "lo", "mi", "tera", "quos", "Nel", "ost", "uri", "vack", "sel"]) + rng.choice(["", "n", "ra", "x"]) for _ in range(n))


# words


def test_words_match_the_regular_expression_on_odd_texts():
    import pyarrow as pa

    texts = [None, "", " ", "\n\t\x0b\x0c\r", "a", " a", "a ", "ä ö b\x1fc", "Ω" * 9, "x" * 5000 + " y", "A b\nC\td"]
    for lower in (False, True):
        got = words.words_of(pa.array(texts, pa.string()), lower)
        for i, text in enumerate(texts):
            want = WORD.findall((text or "").translate(ASCII_LOWER) if lower else text or "")
            at = np.arange(got.first[i], got.first[i + 1])
            assert got.text(at).decode() == " ".join(want)
    same = words.words_of(pa.array(["foo bar", "bar foo foo"], pa.string()))
    assert same.hash[0] == same.hash[3] == same.hash[4] and same.hash[1] == same.hash[2] != same.hash[0]


def test_windows_are_the_same_wherever_they_start():
    h = words.mix(np.arange(300, dtype=np.uint64) % np.uint64(60))
    for size in (1, 5, 8, 20, 50):
        w = words.windows(h, size)
        assert len(w) == 300 - size + 1 and (w[:100] == w[60:160]).all() and len(np.unique(w)) == 60


# line dedup


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    h1[1], h2[1] = h1[0], h2[0] + np.uint64(1)  # one word alone may repeat
    found = PerfectHash.build(h1, h2).find(h1, h2)
    assert sorted(found.tolist()) == list(range(5000))
    shard = Shard.load(Shard.build(h1, h2, np.arange(5000)).dump())
    assert (shard.counts(h1, h2) == np.arange(5000)).all()
    assert not shard.counts(h2, h1).any()


def brute_lines(texts, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return [[x for x in (t or "").split("\n") if seen[key(x)] < min_docs] for t in texts]


@pytest.mark.parametrize("loaded_bytes", [1 << 20, 0])
def test_line_dedup_matches_brute_force_by_either_way_of_probing(spark, loaded_bytes):
    rng = random.Random(3)
    texts = [None, "", "\n\n", "Same Line\nown", "  same line \t\nSAME LINE", "é same line"]
    texts += ["\n".join(rng.choice(["same line", "Header", "footer ", "", f"own {i} {j}"]) for j in range(rng.randrange(1, 9))) for i in range(60)]
    texts += ["copy\nof\nall"] * 12
    rows = [(i if i else None, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_docs=5, loaded_bytes=loaded_bytes).collect()}
    assert len(out) == len(texts)
    for i, kept in enumerate(brute_lines(texts, 5)):
        r = out[i if i else None]
        n = len((texts[i] or "").split("\n"))
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), n, n - len(kept))


def test_line_dedup_on_no_rows(spark):
    out = line_dedup.dedup_lines(docs_of(spark, {}))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"] and out.count() == 0


# substring dedup


def test_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def brute_passages(rows, window):
    first = {}
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            if i is not None:
                run = tuple(w[k : k + window])
                first[run] = min(first.get(run, i), i)
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (50, 51, 49, 70, 120)]
    rows = [(None, passages[3]), (-3, passages[1]), (0, None), (1, ""), (2, " \n ")]
    for i in range(3, 60):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[10][1]), (71, rows[10][1]), (72, passages[0] + " " + passages[0]), (73, passages[4]), (73, passages[4]), (74, "one word " * 400)]
    rows += [(80, "one word " * 300)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.whole_sha256 if r.kept is None else hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect())
    want = Counter((i, n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, n, m, kept in brute_passages(rows, 50))
    assert got == want
    assert sum(m for _, _, m, _ in brute_passages(rows, 50)) > 1000


def test_substring_dedup_on_no_rows(spark):
    assert substring_dedup.repeated_passages(docs_of(spark, {})).count() == 0


# near dedup


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, percent=75):
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sets = [(i, shingles(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                i2, j2 = find(i), find(j)
                root[max(i2, j2)] = min(i2, j2)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, "one two three"), (5, "   ")]
    for group in range(12):
        base = prose(rng, rng.randrange(30, 200)).split()
        for copy in range(rng.randrange(2, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "xx"])
            rows.append((10 + 10 * group + copy, " ".join(w)))
    rows += [(500 + i, "exactly the same text in all of these rows") for i in range(30)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_settle_chains_without_a_centre(spark):
    """Documents that are linked only through each other, in buckets larger than a block."""
    base = [f"w{k}" for k in range(120)]
    rows, rng = [], random.Random(1)
    for i in range(700):
        w = list(base)
        for at in rng.sample(range(120), 3 if i % 2 else 8):
            w[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = "some words that are in every one of these rows here"
    out = near_dedup.near_duplicates(spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (9, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False), (9, 9, True)]
    assert near_dedup.near_duplicates(docs_of(spark, {})).count() == 0


def test_near_dedup_screens_texts_that_no_pair_needs(spark, monkeypatch):
    rows = spark.range(0, 40_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    keys = rows.filter("doc_id % 4 = 0")
    for most, passed_most in ((1 << 27, 12_000), (1 << 16, 16_000)):  # as many bits as it wants, and fewer
        monkeypatch.setattr(near_dedup, "SCREEN_MOST", most)
        passed = near_dedup._screen(keys)(rows)
        assert passed.join(keys, ["doc_id", "text_hash"]).count() == 10_000 and passed.count() < passed_most
    assert near_dedup._screen(keys.limit(0))(rows).count() == 0


def test_components_of_a_long_path_and_of_none(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# top k


def test_top_k_is_exact_with_ties_duplicates_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 2)]) for i in range(400)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (450, rows[1][1]), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [float("nan")] * 6)]
    rows += [(551, [float("inf")] * 6), (600, [1e30, -1e30, 0.0, 0.0, 0.0, 5.0]), (601, [0.5, 0.5]), (None, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for bytes_ in (1 << 20, 200):
        got = defaultdict(list)
        for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0, group_bytes=bytes_, share_bytes=bytes_).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        for q in [i for i in good if i % 50 == 0]:
            scores = sorted((-clamp(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])], q
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# PII


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_match_the_plain_expressions(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "x.y%z@q-r.st.uv", "@", "a@b", "_d@e.f", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005"]
    bits += ["+1 (389) 555-5010", "+49 30 1234567", "+1", "++12 34 56 78 90", "é", "\U0001f600", " ", "\n", ".", "-", "abc", "7", "(", ")", "GB82 WEST 1234 5698 7654 32", "123-45-6789"]
    texts = ["", None] + ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    out = pii.find_pii(docs_of(spark, dict(enumerate(texts)))).collect()
    assert len(out) == len(texts)
    for r in out:
        got = [(s.kind, s.start, s.end) for s in r.pii if s.kind in ("email", "ip", "card", "phone")]
        assert got == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]


def test_pii_long_texts_checks_and_context(spark):
    texts = {1: "a" * 200_000, 2: "1" * 200_000, 3: "a.b" * 60_000 + "@x" + ".y" * 60_000, 4: "1." * 100_000, 5: "a@b.co " * 3000, 6: "+1 " + "( " * 50_000}
    texts |= {7: "IBAN GB82 WEST 1234 5698 7654 32.", 8: "GB82 WEST 1234 5698 7654 33", 9: "ssn 123-45-6789", 10: "part 123-45-6789", 11: "> 1" * 10}
    out = {r.doc_id: r.pii for r in pii.find_pii(docs_of(spark, texts)).collect()}
    # The plain expressions take time with the square of such texts, so what they'd find is written down.
    want = {1: [], 2: [], 6: [], 4: [("ip", 8 * k, 8 * k + 7) for k in range(25_000)], 5: [("email", 7 * k, 7 * k + 6) for k in range(3000)]}
    for i, spans in want.items():
        assert [(s.kind, s.start, s.end) for s in out[i]] == spans
    assert [(s.kind, s.start, s.end) for s in out[3]] == [("email", 0, len(texts[3]))]
    assert [(s.kind, s.start, s.end) for s in out[7]] == [("iban", 5, 32)] and not out[8]
    assert [s.kind for s in out[9]] == ["ssn"] and not out[10]
    assert pii.find_pii(docs_of(spark, {})).count() == 0


def test_pii_ibans_end_at_their_countrys_length(spark):
    german, british, norwegian, maltese = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    after = ["", ".", " Please pay", " 2024 paid", " BIC ABC", " A", " 7", "\nNOW", f" {german}", " 30 EUR AT 12 O CLOCK", ", ref X1"]
    cases = [("iban ", iban, tail) for iban in (german, british, norwegian, maltese) for tail in after] + [("account XX12 ", german, " Please"), ("iban AB 12 ", british, " ABC")]
    out = {r.doc_id: r.pii for r in pii.find_pii(docs_of(spark, {i: "".join(c) for i, c in enumerate(cases)})).collect()}
    for i, (head, iban, tail) in enumerate(cases):
        want = [(len(head), len(head) + len(iban))]
        want += [(want[0][1] + 1, want[0][1] + 1 + len(german))] if german in tail else []
        assert [(s.start, s.end) for s in out[i] if s.kind == "iban"] == want, cases[i]
    wrong = ["iban DE89370400440532013001 Please", "iban DE8937040044053201300 0X", "iban xDE89370400440532013000", "iban DE89370400440532013000a"]
    assert not any(s.kind == "iban" for r in pii.find_pii(docs_of(spark, dict(enumerate(wrong)))).collect() for s in r.pii)


def test_second_hashes_dont_follow_from_the_first(spark):
    df = spark.createDataFrame([(w,) for w in ("", "a", "a line", "x" * 100)], "unit string")
    pair = F.get(line_dedup._hashes(F.array("unit"), 0), F.lit(0))
    # Spark seeds the hash of each argument with that of those before it, so this one needs no text but its h1.
    chained = F.xxhash64("unit", F.lit(1))
    rows = quotation._hashed(df).select("h1", "h2", pair.alias("p"), chained.alias("c"), F.xxhash64("unit").alias("first")).collect()
    assert all(r.h1 == r.p.h1 == r.first and r.c not in (r.h2, r.p.h2) for r in rows)
    assert len({r.h2 for r in rows} | {r.h1 for r in rows}) == 2 * len(rows)


# mixing


def test_mixing_draws_poisson_counts_that_follow_the_weights(spark):
    rows = [(i, f"t{i}", "big" if i < 6000 else "small" if i < 8000 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"big": 1.0, "small": 1.0}, total=8000.0, seed=3)
    counts = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"big", "small"} and all(abs(n - 4000) < 250 for n in counts.values())
    per = Counter(r.n for r in out.filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert abs(per[2] / 2000 - np.exp(-2) * 2) < 0.05 and abs(per[1] / 2000 - np.exp(-2) * 2) < 0.05
    again = mixing.mix(df.repartition(5), {"big": 1.0, "small": 1.0}, total=8000.0, seed=3)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in again.collect()}


def test_mixing_high_rates_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "x", None, 9), (1, None, "a", 9)], "doc_id long, text string, source string, REPLICA int")
    out = mixing.mix(df, {"a": 1.0}, total=500.0, seed=1)
    assert 400 < out.count() < 600 and {r.source for r in out.select("source").distinct().collect()} == {"a"}
    assert sorted(r.replica for r in out.collect()) == list(range(1, out.count() + 1))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df).filter("source is null or source = 'a'").count() == mixing.mix(df).count()


# quotations


def test_quotes_are_linked_and_taken_out(spark):
    rows = [
        (1, 0, "user", "How do I  sort a list?\nIt is long."),
        (1, 1, "assistant", "Use sorted()."),
        (1, 2, "user", "> how do i sort a list?\n> It is long.\n\nThat was my question.\nOn Monday, A wrote:\n>> use SORTED().\nThanks"),
        (1, 7, "assistant", "no quote here"),
        (2, 0, "user", "> Use sorted().\nwhy?"),
        (2, 1, "user", "> nobody said this\nok"),
        (3, None, "user", "> Use sorted()."),
        (None, 1, "user", None),
        (4, 1, None, ">>>>" * 5000),
    ]
    out = quotation.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(got) == len(rows)
    r = got[1, 2]
    assert r.clean_text == "That was my question.\n\nThanks" and (r.n_quotes, r.max_level, r.n_linked) == (2, 2, 2)
    assert (r.reply_to_conv, r.reply_to_turn, r.position) == (1, 0, 3) and r.chat.startswith("<|user|>\nThat")
    assert (got[1, 7].reply_to_turn, got[1, 7].position) == (2, 4)
    assert (got[2, 0].reply_to_conv, got[2, 0].reply_to_turn, got[2, 0].clean_text) == (1, 1, "why?")
    assert (got[2, 1].reply_to_conv, got[2, 1].reply_to_turn, got[2, 1].n_linked) == (2, 0, 0)
    assert got[1, 0].reply_to_conv is None and got[3, None].position is None and got[None, 1].clean_text == ""
    assert got[4, 1].max_level == 0 or got[4, 1].clean_text == ""
    assert quotation.link_quotes(out.select("conv_id", "turn", "role", "text").limit(0)).count() == 0


def test_positions_rank_across_blocks(spark):
    turns = [(1, t) for t in random.Random(2).sample(range(-2000, 4000), 900)]
    got = {r.turn: r.position for r in quotation.positions(spark.createDataFrame(turns + turns[:9], "conv_id long, turn long")).collect()}
    assert got == {t: i + 1 for i, t in enumerate(sorted(t for _, t in turns))}


# decontamination


def brute_hits(texts, items, threshold=0.75):
    out = set()
    for d, text in texts.items():
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        for i, item in items.items():
            v = WORD.findall((item or "").translate(ASCII_LOWER))
            if not v or not w:
                continue
            k = min(5, len(v))
            grams_of = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))  # noqa: E731, B023
            b, n = grams_of(v), min(len(v), len(w))
            if not any(tuple(w[j : j + k]) in b for j in range(len(w) - k + 1)):
                continue
            for s in range(len(w) - n + 1):
                a = grams_of(w[s : s + n])
                if a and sum((a & b).values()) >= threshold * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(13)
    items = {i: prose(rng, rng.randrange(8, 60)) for i in range(30)} | {90: None, 91: "", 92: "just four words here"}
    texts = {0: None, 1: "", 2: "nothing"}
    for d in range(3, 120):
        w = prose(rng, rng.randrange(0, 150)).split()
        if d % 2:
            piece = items[rng.randrange(30)].split()
            for _ in range(rng.randrange(0, 3)):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece if d % 3 else piece[: len(piece) * 9 // 10]
        texts[d] = " ".join(w).upper() if d % 5 == 0 else " ".join(w)
    texts[200] = "x just four words here y"
    df = spark.createDataFrame([(d, t, "old") for d, t in texts.items()], "doc_id long, text string, HITS string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_hits(texts, items)
    for pass_bytes in (1 << 20, 1500):
        out = decontaminate.find_items(df, bench, pass_bytes=pass_bytes).collect()
        assert len(out) == len(texts) and {(r.doc_id, h.item_id) for r in out for h in r.hits} == want
    assert len(want) > 20
    assert decontaminate.find_items(df, bench.limit(0)).filter(F.size("hits") > 0).count() == 0


def test_block_index_finds_all_within_the_radius():
    rng, radius = np.random.default_rng(4), decontaminate.RADIUS
    base = rng.integers(0, 2**64, (300, 4), dtype=np.uint64)
    base[20:40] = base[17]
    index = decontaminate.BlockIndex(base)
    some = []
    for n in (0, 5, radius - 1, radius, radius + 1):
        one = base[17].copy()
        for bit in rng.choice(256, n, replace=False):
            one[bit // 64] ^= np.uint64(1 << int(bit % 64))
        some.append(one)
    at, member = index.near(np.array(some))
    for i, one in enumerate(some):
        near = np.flatnonzero(np.bitwise_count(base ^ one).sum(axis=1) <= radius)
        assert member[at == i].tolist() == near.tolist() and (17 in near) == (i < 4)


def test_the_radius_holds_at_the_threshold():
    """Exact chance that a bit differs, for all numbers of features and as many changed as a similarity of 0.75 lets."""

    def differs(n, d):
        sums = lambda k: {2 * i - k: math.comb(k, i) / 2**k for i in range(k + 1)}
        out = 0.0
        for s, p in sums(n - d).items():
            up = sum(q for x, q in sums(d).items() if s + x > 0)
            out += p * 2 * up * (1 - up)
        return out

    p = max(differs(n, n - math.ceil(n * 6 / 7 - 1e-9)) for n in [*range(1, 120), 300])
    assert p < 0.173
    assert sum(math.comb(256, i) * 0.173**i * 0.827 ** (256 - i) for i in range(decontaminate.RADIUS + 1, 257)) < 2e-7


def test_ranks_count_in_sliding_windows():
    rng = np.random.default_rng(3)
    for n, span in ((1, 1), (40, 7), (40, 40), (200, 13)):
        x = rng.integers(0, 6, n).astype(np.uint64)
        back, ahead = decontaminate.ranks(x, span)
        assert back.tolist() == [int((x[max(0, i - span + 1) : i + 1] == x[i]).sum()) for i in range(n)]
        assert ahead.tolist() == [int((x[i : i + span] == x[i]).sum()) for i in range(n)]


def test_decontamination_of_lists_boilerplate_and_runs_of_one_word(spark):
    rng, vocab = random.Random(17), [f"w{i}" for i in range(900)]
    items = {}
    for i in range(16):
        n = (8, 14, 30, 90)[i // 4]
        base = rng.sample(vocab, max(2, n // 6))
        items[i] = (rng.sample(vocab, n), [rng.choice("abc") for _ in range(n)], ["x"] * (n * 6 // 7) + rng.sample(vocab, n - n * 6 // 7), (base * 8)[:n])[i % 4]
    items[20], items[21] = rng.sample(vocab, 200), rng.sample(vocab, 400)
    texts = {}
    for d in range(120):
        w = list(items[rng.randrange(16)])
        m = max(1, int(len(w) * rng.uniform(0.02, 0.2)))
        edit = d % 5
        if edit == 0:
            w[len(w) - m :] = ["x"] * m
        elif edit == 1:
            w[:m] = ["qq"] * m
        elif edit == 2:
            w[rng.randrange(len(w))] = "zz"
        elif edit == 3:
            del w[:m]
        else:
            w[len(w) // 2 : len(w) // 2] = ["a"] * m
        around = [[rng.choice([*vocab[:50], "a", "x"]) for _ in range(rng.randrange(0, 30))] for _ in range(2)]
        texts[d] = " ".join(around[0] + w + around[1])
    want = brute_hits(texts, {i: " ".join(w) for i, w in items.items()})
    # The last part of long items as one repeated word: similarities of 0.774, 0.758 and 0.776.
    for k, (i, n, m) in enumerate(((20, 200, 25), (20, 200, 27), (21, 400, 50))):
        texts[200 + k] = " ".join(items[i][: n - m] + ["x"] * m)
        want.add((200 + k, i))
    bench = [(i, " ".join(w)) for i, w in items.items()]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = decontaminate.find_items(df, spark.createDataFrame(bench + bench[:3] + [(7, "another text of the same item id here")], "item_id long, text string")).collect()
    assert [(r.doc_id, h.item_id) for r in sorted(out) for h in r.hits] == sorted(want)


def test_decontamination_of_a_very_long_text(spark):
    rng = random.Random(2)
    item = [f"v{i}" for i in range(50)]
    text = " ".join([*item, *(f"w{rng.randrange(5000)}" for _ in range(300_000)), *item])
    rows = spark.createDataFrame([(1, text), (2, "x " * 100_000)], "doc_id long, text string")
    out = {r.doc_id: r.hits for r in decontaminate.find_items(rows, spark.createDataFrame([(1, " ".join(item)), (2, "x " * 30)], "item_id long, text string")).collect()}
    assert [(h.item_id, h.start, h.similarity) for h in out[1]] == [(1, 0, 1.0)] and [(h.item_id, h.start) for h in out[2]] == [(2, 0)]


# toxicity and language, on the given tables


def crc(i):
    return zlib.crc32(str(i).encode()) % 3


def test_toxicity_holds_on_rows_it_did_not_learn_from(spark, sf001):
    docs, labels = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    rows = [(out[r.doc_id].score, r.toxic) for r in labels.collect() if crc(r.doc_id) == 1]
    good, bad = ([s for s, t in rows if t == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert np.mean([s >= 0.7 for s in bad]) < 0.05


def test_toxicity_locates_sentences_and_takes_any_row(spark):
    clean = ["the day is fine. we walk home.", "read the book! then sleep.", "a cat sat\non the mat."]
    bad = ["the day is fine. you are a horrid goblin. we walk.", "horrid goblin!", "read it.\nhorrid horrid goblin\nsleep."]
    texts = [f"{t} number {i}" for i in range(30) for t in clean] + [f"{t} number {i}" for i in range(30) for t in bad]
    model = toxicity.fit(texts, [0] * 90 + [1] * 90)
    rows = {1: "ah é. Fine here. You HORRID goblin! Bye.", 2: None, 3: "", 4: "fine.", 5: "?!.\n" * 20_000}
    out = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows), model).collect()}
    assert out[1].score > 0.7 and [rows[1][s.start : s.end].strip() for s in out[1].offending] == ["You HORRID goblin!"]
    assert all(out[i].score < 0.5 and not out[i].offending for i in (2, 3, 4, 5))
    empty = toxicity.train(docs_of(spark, {}), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs_of(spark, {1: "horrid"}), empty).collect()] == [0.0]
    assert toxicity.score(docs_of(spark, {}), model).count() == 0


def test_language_holds_on_rows_it_did_not_learn_from(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    model = language_id.train(docs)
    rows = [r for r in language_id.predict(docs, model).collect() if crc(r.doc_id) == 1 and r.lang]
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    model = language_id.fit(["the house and the garden"] * 3 + ["das haus und der garten"] * 3, ["en"] * 3 + ["de"] * 3)
    rows = {1: None, 2: "", 3: "123 !? --", 4: "中", 5: "the garden", 6: "DER GARTEN " * 20_000}
    df = docs_of(spark, rows).withColumn("SCORE", F.lit("old"))
    out = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred in ("en", "de")
    assert (out[5].lang_pred, out[6].lang_pred) == ("en", "de")
    none = language_id.train(spark.createDataFrame([], DOCS))
    assert [r.lang_pred for r in language_id.predict(docs_of(spark, {1: "text"}), none).collect()] == ["und"]


def test_sampled_ids_are_bounded_and_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(500)], "doc_id long, lang string")
    ids = grams.sample_ids(df, "lang", 40)
    assert len(ids) == 40 and sum(i % 10 == 0 for i in ids) == 20


# words without known collisions


def thue_morse(n, turned=False):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text.translate(str.maketrans("ab", "ba")) if turned else text


def test_words_that_polynomials_confuse_stay_apart(spark):
    import pyarrow as pa

    for n in (8, 128, 1024, 2048, 4096):
        got = words.words_of(pa.array([f"{thue_morse(n)} {thue_morse(n, True)} {thue_morse(n)}"]), check=True)
        assert got.hash[0] == got.hash[2] != got.hash[1] and got.check[0] == got.check[2] != got.check[1]
    texts = {2 * k + t: " ".join([thue_morse(n, bool(t)), *(f"u{n}" for _ in range(49))]) for k, n in enumerate((1024, 2048, 4096)) for t in (0, 1)}
    df = docs_of(spark, texts)
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeated_passages(df, 50).collect()} == dict.fromkeys(texts, 0)
    short = docs_of(spark, {i: " ".join(t.split()[:1] * 5) for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(short).collect()} == {i: i for i in texts}
    hits = decontaminate.find_items(short, short.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "item_id")).collect()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in hits} == {i: [i] if i % 2 == 0 else [] for i in texts}


def test_rows_that_share_an_id_are_judged_each(spark):
    a, b = "some words that are in every one of these rows here", "quite another text with words of its own in it"
    rows = [(4, a, 1), (9, a, 2), (9, b, 3), (9, b, 4), (None, a, 5), (7, None, 6), (7, " ", 7), (4, a.upper(), 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT int")
    out = near_dedup.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == Counter([(4, 4, True), (4, 4, True), (9, 4, False), (9, 9, True), (9, 9, True), (None, None, True), (7, 7, True), (7, 7, True)])
    stay = near_dedup.without_copies(df)
    assert stay.columns == df.columns
    got = sorted((r.doc_id or -1, (r.text or "").lower().strip()) for r in stay.collect())
    assert got == sorted([(4, a), (9, b), (-1, a), (7, ""), (7, "")])


def test_top_k_with_a_vector_that_many_rows_have(spark):
    rng = np.random.default_rng(5)
    common = [0.5, 0.25, -0.5, 0.125]
    rows = [(i, common if i % 3 else [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in range(600)] + [(50, common)] * 8 + [(1, common)] * 3 + [(1000 + i, common) for i in range(3)]
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    out = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 50 == 0).collect()
    got = defaultdict(Counter)
    for r in out:
        got[r.query_id][r["rank"], r.vec_id, r.score] += 1
    for q in {i for i, _ in good if i % 50 == 0}:
        want = Counter()
        for v in {tuple(v) for i, v in good if i == q}:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)
            want.update((n + 1, i, -s) for n, (s, i) in enumerate(scores[:5]))
        assert got[q] == want, q
    assert max(r.n_read for r in out) < 200


# models against naive scorers


def letters_of(text):
    return [b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in (text or "").encode()]


def gram_id(gram, bits):
    return ((int.from_bytes(bytes(gram), "big") + (len(gram) << 56)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)


def test_toxicity_scores_are_noisy_or_of_sentences(spark):
    bad = ["the day is fine. you are a horrid goblin. we walk.", "horrid goblin!", "read it.\nhorrid horrid goblin\nsleep."]
    model = toxicity.fit([f"{t} number {i}" for i in range(9) for t in bad] + [f"the day {i} is fine. read!" for i in range(30)], [1] * 27 + [0] * 30)
    rows = {0: "A HORRID goblin? Fine day.\nhorrid", 1: None, 2: "é goblins... horridly; fine", 3: "nothing here", 4: bad[2], 5: "", 6: "gob lin hor rid. goblin goblin"}
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, rows), model).collect()}
    for i, text in rows.items():
        data, letters, clean, sentence, features = (text or "").encode(), letters_of(text), 1.0, 0, defaultdict(set)
        for at in range(len(letters)):
            sentence += at > 0 and data[at] in b"\n\r!.?"
            for n in toxicity.SIZES:
                gram = letters[at : at + n]
                if len(gram) == n and 32 not in gram[1:] and model.used[gram_id(gram, toxicity.BITS)]:
                    features[sentence].add(gram_id(gram, toxicity.BITS))
        for found in features.values():
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[f]) for f in found))))
        assert abs(got[i] - (1 - clean)) < 1e-5, text


def test_language_scores_are_kernel_ridge_over_landmarks(spark):
    texts = ["the house and the garden", "a garden of the house", "das haus und der garten", "im garten das haus", "la maison et le jardin", "un jardin dans la maison"]
    labels = ["en", "en", "de", "de", "fr", "fr"]
    grams_of = lambda t: {gram_id(letters_of(t)[i : i + n], language_id.BITS) for n in language_id.SIZES for i in range(len(letters_of(t)) - n + 1)}
    kernel = lambda a, b: len(grams_of(a) & grams_of(b)) / max(1, len(grams_of(a)) * len(grams_of(b))) ** 0.5
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    values, vectors = np.linalg.eigh(k)
    whiten = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    y = np.array([[float(l == one) for one in ("de", "en", "fr")] for l in labels])
    beta = np.linalg.solve((k @ whiten).T @ (k @ whiten) + language_id.RIDGE * len(texts) * np.eye(whiten.shape[1]), (k @ whiten).T @ y)
    rows = dict(enumerate([*texts, "der große garten", "maison", "HOUSE and jardin!"]))
    out = {r.doc_id: r for r in language_id.predict(docs_of(spark, rows), language_id.fit(texts, labels)).collect()}
    for i, text in rows.items():
        scores = np.array([kernel(text, t) for t in texts]) @ whiten @ beta
        assert out[i].lang_pred == ("de", "en", "fr")[scores.argmax()] and abs(out[i].score - min(1, max(0, scores.max()))) < 1e-3


def test_samples_of_repeated_ids_are_the_same_in_every_run(spark):
    rows = [(i % 40, f"text {i % 7} of {i}", "en" if i % 2 else "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = language_id.train(df, 20), language_id.train(df.repartition(5), 20)
    assert one.languages == two.languages and (one.weights == two.weights).all()
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert (toxicity.train(df, labels, 20).weights == toxicity.train(df.repartition(3), labels, 20).weights).all()


# PII beside the base kinds


def brute_extra(text):
    """IBANs and social security numbers; context reaches to the next match of the kind."""
    lengths = {c: n for table in (pii.IBAN_LENGTHS, pii.UNREGISTERED_LENGTHS) for n, names in table.items() for c in names.split()}
    ibans, at = [], 0
    while at < len(text):
        m = re.compile(r"[A-Z]{2}[0-9]{2}").match(text, at)
        end = at
        if m and m[0][:2] in lengths and not (at and re.match("[A-Za-z0-9]", text[at - 1])):
            whole = re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{lengths[m[0][:2]] - 4}}}(?![A-Za-z0-9])").match(text, at)
            if whole:
                end = whole.end()
                ibans.append((at, end))
        at = max(at + 1, end)
    numbers = [m.span() for m in re.finditer(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", text)]
    out = []
    for kind, spans, score, words_ in (("iban", ibans, 0.7, "iban|account|bank|konto|cuenta|compte"), ("ssn", numbers, 0.3, r"\bssn\b|social security|tax id")):
        for i, (a, b) in enumerate(spans):
            left, right = text[spans[i - 1][1] if i else 0 : a], text[b : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
            total = score + 0.2 * bool(re.search(words_, f"{left[-40:]} {right[:40]}".lower()))
            plain = text[a:b].replace(" ", "")
            if total >= 0.5 and (kind == "ssn" or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1):
                out.append((kind, a, b, total))
    return out


def test_pii_query_gives_every_span_score_and_digest(spark, tmp_path):
    from ledgerloom.llm import queries

    rng = random.Random(12)
    bits = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001", "NO9386011117947", "SSN 123-45-6789", "123-45-6789", "000-12-3456", "ssn:", "account", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "é", "iban", " . ", "X", "tax id 219-09-9999"]
    texts = ["", None] + ["".join(rng.choice(bits) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    docs_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op4_pii"](spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for r in out.collect():
        text = texts[r.doc_id] or ""
        base, extra = base_spans(text), brute_extra(text)
        order = [k.name for k in pii.KINDS]
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in sorted(spans, key=lambda s: (order.index(s[0]), s[1])))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and r.spans == listed(base + extra), text
        assert (r.n_iban, r.n_ssn) == tuple(sum(s[0] == k for s in extra) for k in ("iban", "ssn"))
        scores = dict(zip(r.spans.split(","), r.scores, strict=True)) if r.spans else {}
        assert all(abs(scores[f"{k}:{a}:{b}"] - score) < 0.01 for k, a, b, score in extra)


# quotations against a plain linker


def brute_links(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.translate(ASCII_LOWER)).strip(" ")

    def parse(text):
        lines = []
        for line in (text or "").replace("\x01", " ").replace("\x02", " ").split("\n"):
            marks = re.match(r"(?:>[> ]*)?", line)[0]
            lines.append((marks.count(">"), line[len(marks) :]))
        runs = []
        for i, (level, body) in enumerate(lines):
            following = lines[i + 1][0] if i + 1 < len(lines) else 0
            body = "" if level == 0 and following > 0 and re.match(quotation.INTRODUCES, body) else body
            if runs and lines[i - 1][0] == level:
                runs[-1][1] += "\n" + body
            else:
                runs.append([level, body])
        return "\n".join(b for lv, b in runs if lv == 0).strip(" \t\n\x0b\x0c\r"), [(lv, b) for lv, b in runs if lv and norm(b)]

    units = lambda body: {u for u in [norm(body), *map(norm, body.split("\n"))] if u}
    said, turns, parsed = defaultdict(dict), defaultdict(set), [parse(r[3]) for r in rows]
    for (conv, turn, *_), (clean, _) in zip(rows, parsed, strict=True):
        if conv is not None and turn is not None:
            turns[conv].add(turn)
            for u in units(clean) if clean else ():
                said[u][conv] = min(said[u].get(conv, turn), turn)
    out = []
    for (conv, turn, role, _), (clean, quotes) in zip(rows, parsed, strict=True):
        found, place, before = [], None, None
        if conv is not None and turn is not None:
            order = sorted(turns[conv])
            place = order.index(turn) + 1
            before = order[place - 2] if place > 1 else None
            for nth, (level, body) in enumerate(quotes):
                origins = []
                for u in units(body):
                    if said.get(u, {}).get(conv, turn) < turn:
                        origins.append((len(u), (1, conv, said[u][conv])))
                    elif said.get(u) and min(said[u].items())[0] < conv:
                        origins.append((len(u), (0, *min(said[u].items()))))
                if origins:
                    size, origin = max(origins)
                    found.append((level, size, -nth, origin))
        direct = [f[1:] for f in found if f[0] == 1]
        reply = max(direct)[2][1:] if direct else (conv, before) if before is not None else (None, None)
        out.append((conv, turn, clean, len(quotes), max([lv for lv, _ in quotes], default=0), len(found), *reply, place, f"<|{role or ''}|>\n{clean}"))
    return out


def test_quotes_are_linked_as_a_plain_linker_links_them(spark, sf_dir):
    rng = random.Random(21)
    phrases = ["How do I sort?", "Use sorted().", "thanks  a lot", "See the docs\nand read them", "no", "Überall hier", "It is long."]
    rows = []
    for conv in range(12):
        for turn in rng.sample(range(-3, 30), 9):
            parts = []
            for _ in range(rng.randrange(1, 5)):
                level, body = rng.choice([0, 0, 1, 1, 2]), rng.choice(phrases)
                if level and rng.random() < 0.3:
                    parts.append("On Monday, A wrote:")
                parts += [(">" * level + " " * (level > 0)) + line for line in body.split("\n")]
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join(parts)))
    rows += [rows[0], (3, None, "user", "> no"), (None, 2, "user", "> no"), (4, 100, "user", None), (5, 100, "user", ""), (6, 100, "user", "> > a\x01b\n>"), (7, 100, "user", "> Use sorted().\n" * 3000)]
    rows += [(100 + i, 0, "user", "the same phrase of all\n> the same phrase of all") for i in range(60)]
    for given in (rows, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        df = spark.createDataFrame([(*r, "old") for r in given], "conv_id long, turn long, role string, text string, CHAT string")
        out = quotation.link_quotes(df)
        assert out.columns[:4] == ["conv_id", "turn", "role", "text"]
        names = ("conv_id", "turn", "clean_text", "n_quotes", "max_level", "n_linked", "reply_to_conv", "reply_to_turn", "position", "chat")
        assert Counter(tuple(r[n] for n in names) for r in out.collect()) == Counter(brute_links(given))


# registered queries against brute force


def test_registered_queries_match_brute_force(spark, sf_dir):
    from ledgerloom.llm import queries

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op2_substring_dedup"](spark, sf_dir).collect())
    assert got == [(i, n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, n, m, kept in brute_passages(docs, 50)]
    want = brute_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_minhash_near_dedup"](spark, sf_dir).collect()} == want
    hits = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, sf_dir).collect()}
    assert hits == brute_hits(dict(docs), items)
