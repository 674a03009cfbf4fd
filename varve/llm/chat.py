r"""Chat formatting with a grammar that survives a round trip.

Rendered conversation: one turn after another, each

    ### <role>: <text></turn>\n          the text as it is
    ### <role>:\ <text></turn>\n         the text escaped

A deterministic parser splits at ``</turn>`` and reads the header of each piece. A conversation is
rendered plain, parsed again and compared with its source; where they differ, the turns that hold
the end mark are escaped, and if that does not suffice every turn is, until both are identical.
Escaping puts a backslash before a backslash, before ``###`` and inside ``</turn>``; dropping each
backslash that precedes a character undoes it. Roles are always escaped, colons included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
_ESCAPES = r"\\|###|(?<=<)/(?=turn>)"
_ROLE_ESCAPES = r"\\|:|###|(?<=<)/(?=turn>)"
_HEADER = r"(?s)^\n?### ((?:[^\\:]++|\\.)*+):(\\?) (.*)$"


def escape(text: Column, pattern: str = _ESCAPES) -> Column:
    return F.regexp_replace(text, pattern, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parse_turns(rendered: Column) -> Column:
    """Rendered text as an array of (role, text, raw, escaped); raw is the piece with its header."""
    pieces = F.split(rendered, END)
    # behind the last end mark only a line feed may follow
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        escaped = F.regexp_extract(piece, _HEADER, 2) != ""
        text = F.regexp_extract(piece, _HEADER, 3)
        return F.struct(
            unescape(F.regexp_extract(piece, _HEADER, 1)).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"), piece.alias("raw"), escaped.alias("escaped")
        )

    return F.transform(turns, one)


def _pieces(turns: Column, which) -> Column:
    """Each turn as (piece, the text's offset in it, its length, flags)."""

    def one(t: Column) -> Column:
        head = F.concat(F.lit("### "), escape(t["role"], _ROLE_ESCAPES), F.when(which(t), F.lit(":\\ ")).otherwise(F.lit(": ")))
        body = F.when(which(t), escape(t["text"])).otherwise(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.length(head).alias("skip"), F.length(body).alias("chars"), (t["role"] == "assistant").alias("learn")
        )

    return F.transform(turns, one)


def _rendered(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def _identical(rendered: Column, turns: Column) -> Column:
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return F.transform(parse_turns(rendered), plain) == F.transform(turns, plain)


def _spans(pieces: Column) -> Column:
    """Loss spans of assistant texts: turn number, start and length in code points of the whole."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<turn:int,start:bigint,chars:bigint,skip:int>>").alias("spans"), F.lit(0).alias("turn"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct(acc["turn"].alias("turn"), (acc["at"] + p["skip"]).alias("start"), p["chars"].cast("long").alias("chars"), p["skip"].alias("skip"))
        spans = F.when(p["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(p["piece"])).alias("at"), spans.alias("spans"), (acc["turn"] + 1).alias("turn"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: formatted text, loss spans and how far escaping went (0, 1 or 2).

    Reads conv_id, turn, role and text; other columns are ignored. A null role or text is empty, a
    null turn sorts first, a null conv_id is a conversation of its own, equal turn numbers are
    ordered by role and text, repeated rows stay repeated turns. No rows give no rows. A rendered
    conversation is one value, so it must fit Spark's limit for a string.
    """
    source = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn("p0", _pieces(F.col("turns"), lambda t: F.lit(False))).withColumn("s0", _rendered(F.col("p0")))
    chats = chats.withColumn("ok0", _identical(F.col("s0"), F.col("turns")))
    marked = lambda t: t["text"].contains(END)
    chats = chats.withColumn("p1", F.when(F.col("ok0"), F.col("p0")).otherwise(_pieces(F.col("turns"), marked)))
    chats = chats.withColumn("s1", _rendered(F.col("p1"))).withColumn("ok1", F.col("ok0") | _identical(F.col("s1"), F.col("turns")))
    chats = chats.withColumn("p2", F.when(F.col("ok1"), F.col("p1")).otherwise(_pieces(F.col("turns"), lambda t: F.lit(True)))).withColumn("formatted", _rendered(F.col("p2")))
    chats = chats.withColumn("intact", F.col("ok1") | _identical(F.col("formatted"), F.col("turns")))
    level = F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).when(F.col("intact"), 2).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return chats.select("conv_id", "formatted", _spans(F.col("p2")).alias("loss_spans"), level.cast("int").alias("escape_level"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of every turn and of all text under the loss mask, from formatted output alone."""
    parsed = formatted.withColumn("turns", parse_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def learnt(span: Column) -> Column:
        turn = F.get(F.col("turns"), span["turn"])
        # behind the first turn a piece starts with the line feed that ends the one before
        begin = span["skip"] + F.when(span["turn"] > 0, 2).otherwise(1)
        masked = F.substring(turn["raw"], begin, span["chars"].cast("int"))
        return F.when(turn["escaped"], unescape(masked)).otherwise(masked)

    parsed = parsed.withColumn("learnt", F.array_join(F.transform("loss_spans", learnt), ""))
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "escape_level",
    )
