"""Conversations from messages that quote each other, with DataFrame functions only.

Leading ``>`` marks give every line its quote level; lines of one level in a row make a
passage. Normalised passages and lines of what messages say themselves are indexed by
hash, each by its first message in all and in its conversation, so a phrase that a third
of all messages hold is one row of the index. Quoted passages are looked up there. A
message replies to the original of what it quotes at level 1, else to the message before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, without

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Turns that are ranked together before the counts of such blocks are summed.
BLOCK = 256
#: A line such as "On Monday, A wrote:" right above a quote introduces it.
INTRODUCES = r"^(?:On|Am|Le|El) .{1,200}(?:wrote|schrieb|écrit|escribió)[^:]{0,80}:\s*$"


def _norm(text: Column) -> Column:
    """A-Z in lower case, white space at the ends gone and inside one blank."""
    return F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "), F.lit(WHITE))


def _lines(text: Column) -> Column:
    """(level, body) of each line."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(?:>[> ]*+)?", 0)
        return F.struct(F.length(F.regexp_replace(marks, " +", "")).alias("level"), F.substr(line, F.length(marks) + 1).alias("body"))

    return F.transform(F.split(text, "\n", -1), one)


def _passages(lines: Column) -> Column:
    """(level, body) of each run of lines of one level; introductions of a quote are left out."""

    def mark(line: Column, i: Column) -> Column:
        after, before = F.get(lines, i + 1), F.get(lines, i - 1)
        introduces = (line["level"] == 0) & (F.coalesce(after["level"], F.lit(0)) > 0) & line["body"].rlike(INTRODUCES)
        starts = (i == 0) | (before["level"] != line["level"])
        head = F.when(starts, F.concat(F.lit("\x01"), line["level"].cast("string"), F.lit("\x02"))).otherwise("\n")
        return F.concat(head, F.when(introduces, "").otherwise(line["body"]))

    runs = F.filter(F.split(F.array_join(F.transform(lines, mark), ""), "\x01", -1), lambda r: r != "")
    return F.transform(runs, lambda r: F.struct(F.substring_index(r, "\x02", 1).cast("int").alias("level"), F.substr(r, F.instr(r, F.lit("\x02")) + 1).alias("body")))


def _units(body: Column) -> Column:
    """The passage and its lines, normalised, without empty ones."""
    return F.filter(F.array_distinct(F.concat(F.array(_norm(body)), F.transform(F.split(body, "\n", -1), _norm))), lambda u: u != "")


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with passages: array of (level, body)."""
    # The two control characters that mark passages can't be told from the text's own, which become blanks.
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02", "  ")
    return messages.withColumn("lines", _lines(text)).withColumn("passages", _passages(F.col("lines"))).drop("lines")


def _hashed(units: DataFrame) -> DataFrame:
    return units.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")})


def positions(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, position): the rank of each turn in its conversation, from 1.

    Turns are ranked inside blocks, and blocks by the sums of their counts, so that no task
    orders a whole conversation, however long.
    """
    from pyspark.sql import Window

    turns = messages.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = turns.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn")))
    return inside.join(sizes, ["conv_id", "block"]).select("conv_id", "turn", (F.col("before") + F.col("nth")).cast("int").alias("position"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages in reply order, without what they quote.

    ``messages`` has conv_id, turn, role, text. Adds clean_text (own lines, without
    introductions of quotes, white space at the ends gone), n_quotes (passages at level 1 or
    deeper), max_level, n_linked (quoted passages with an original found), reply_to_conv and
    reply_to_turn, position (rank of the turn in the conversation, equal for equal turns)
    and chat, the message as ``<|role|>`` and its clean text.

    A passage is looked up whole, else by its longest line found; an original is an earlier
    message of the conversation, else of any (a smaller conv_id), the first that says it. A
    message that quotes nothing known replies to the one before it; the first to none.
    Null text is empty; with a null conv_id or turn a message has no place, quotes nothing
    and is quoted by none. Repeated rows all come back.
    """
    added = ("clean_text", "n_quotes", "max_level", "n_linked", "reply_to_conv", "reply_to_turn", "position", "chat")
    messages = without(messages, *added, "passages", "lines", "message_hash")
    placed = parse(messages)
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    quotes = F.filter("passages", lambda p: (p["level"] > 0) & (_norm(p["body"]) != ""))
    placed = placed.withColumns({"clean_text": F.btrim(own, F.lit(WHITE)), "quotes": quotes, "message_hash": F.xxhash64("text")})
    usable = placed.filter("conv_id is not null and turn is not null")

    quoted = usable.filter(F.size("quotes") > 0).select("conv_id", "turn", "message_hash", F.posexplode("quotes").alias("nth", "q"))
    quoted = quoted.withColumn("level", F.col("q.level")).select("conv_id", "turn", "message_hash", "nth", "level", F.explode(_units(F.col("q.body"))).alias("unit"))
    quoted = stored(_hashed(quoted).select("conv_id", "turn", "message_hash", "nth", "level", "h1", "h2", F.char_length("unit").alias("size")).distinct(), "quoted")

    # Only phrases that some message quotes are worth a row of the index. What is joined with a phrase is
    # written before, so that both sides of the join are shuffles and a phrase that many say can be split.
    wanted = stored(quoted.select("h1", "h2").distinct(), "wanted")
    said = _hashed(usable.filter("clean_text != ''").select("conv_id", "turn", F.explode(_units(F.col("clean_text"))).alias("unit"))).select("conv_id", "turn", "h1", "h2")
    said = said.join(wanted, ["h1", "h2"], "left_semi")
    inside = said.groupBy("h1", "h2", "conv_id").agg(F.min("turn").alias("own_turn"))
    inside = stored(inside, "said")
    anywhere = stored(inside.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "own_turn")).alias("first")), "anywhere")
    found = quoted.join(inside, ["h1", "h2", "conv_id"], "left").join(anywhere, ["h1", "h2"], "left")
    here = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.lit(1).alias("same"), "conv_id", F.col("own_turn").alias("turn")))
    there = F.when(F.col("first.conv_id") < F.col("conv_id"), F.struct(F.lit(0).alias("same"), F.col("first.conv_id").alias("conv_id"), F.col("first.own_turn").alias("turn")))
    found = found.withColumn("origin", F.coalesce(here, there)).filter("origin is not null")
    best = F.max_by("origin", F.struct("size", "origin"))
    passages = found.groupBy("conv_id", "turn", "message_hash", "nth", "level").agg(best.alias("origin"), F.max("size").alias("size"))
    reply = F.max_by("origin", F.when(F.col("level") == 1, F.struct("size", -F.col("nth"))))
    replies = stored(passages.groupBy("conv_id", "turn", "message_hash").agg(F.count("*").alias("n_linked"), reply.alias("origin")), "replies")
    discard(quoted, wanted, inside, anywhere)

    order = stored(positions(messages), "positions")
    previous = order.select("conv_id", F.col("turn").alias("previous_turn"), (F.col("position") + 1).alias("position"))
    order = order.join(previous, ["conv_id", "position"], "left")
    out = placed.join(order, ["conv_id", "turn"], "left").join(replies, ["conv_id", "turn", "message_hash"], "left")
    out = out.withColumns(
        {
            "n_quotes": F.size("quotes"),
            "max_level": F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)),
            "n_linked": F.coalesce("n_linked", F.lit(0).cast("bigint")),
            "reply_to_conv": F.coalesce("origin.conv_id", F.when(F.col("previous_turn").isNotNull(), F.col("conv_id"))),
            "reply_to_turn": F.coalesce("origin.turn", "previous_turn"),
            "chat": F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit("|>\n"), "clean_text"),
        }
    )
    return out.select(*[F.col(f"`{c}`") for c in messages.columns], *added)
