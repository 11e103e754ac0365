"""Chat formatting [native]: relational formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and rendered. Adjacent turns of one role share a block:

    <s>ROLE[INST]TEXT[AND]TEXT...[/INST]</s>

``<s>`` opens a block, ``[INST]`` ends its role, ``[AND]`` divides the turns merged into it, ``[/INST]</s>`` closes it.
Inside roles and texts each of these control strings gets one more backslash after its first character (those that
already have n backslashes there get n + 1), so nothing in a text can be taken for a control string and ``unescape``
gives back the very text.

Everything takes time in proportion to a conversation's length: offsets are folded block by block, and texts under the
loss mask are cut from bytes, where a place needs no counting of characters.

Defined cases: null text or role is empty; ties of (conv_id, turn) are ordered by role, then text; repeated rows stay;
a null conv_id is a conversation of its own; an empty table gives an empty result; columns beside conv_id, turn, role
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns folded into offsets at a time; a fold's list is copied with each turn it takes.
BLOCK = 256
CONTROL = r"s>|/s>|INST\]|/INST\]|AND\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): (start, length) of loss_role's texts in 0-based code points of formatted, and the same in bytes."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        first = (i == 0) | (F.try_element_at("turns", F.greatest(i, F.lit(1)))["role"] != x["role"])
        last = (i == F.size("turns") - 1) | (F.try_element_at("turns", i + 2)["role"] != x["role"])
        head = F.when(first, F.concat(F.lit("<s>"), escape(x["role"]), F.lit("[INST]"))).otherwise(F.lit("[AND]"))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.when(last, F.lit("[/INST]</s>")).otherwise(F.lit("")).alias("tail"), (x["role"] == loss_role).alias("loss"))

    # element_at counts from 1: i is the turn before turn i, i + 2 the one after; the ends are caught first
    pieces = F.transform("turns", lambda x, i: piece(x, i))
    return convs.select("conv_id", pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        _spans().alias("loss_spans"),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _spans() -> Column:
    """Spans of the loss texts: running offsets folded over the turns of a block, and over blocks."""
    size = lambda p, of: F.struct(of(p["head"]).cast("long").alias("head"), of(p["body"]).cast("long").alias("body"), of(p["tail"]).cast("long").alias("tail"))
    sizes = F.transform("pieces", lambda p: F.struct(size(p, F.length).alias("chars"), size(p, F.octet_length).alias("bytes"), p["loss"].alias("loss")))
    none = F.array().cast("array<struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>>")
    fold = lambda at, byte, spans: F.struct(at.alias("at"), byte.alias("byte"), spans.alias("spans"))

    def turn(acc: Column, p: Column) -> Column:
        c, b = p["chars"], p["bytes"]
        span = F.struct((acc["at"] + c["head"]).alias("start"), c["body"].alias("length"), (acc["byte"] + b["head"]).alias("byte_start"), b["body"].alias("byte_length"))
        return fold(acc["at"] + c["head"] + c["body"] + c["tail"], acc["byte"] + b["head"] + b["body"] + b["tail"], F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]))

    def block(acc: Column, turns: Column) -> Column:
        return _bound(F.aggregate(turns, fold(acc["at"], acc["byte"], none), turn), lambda r: fold(r["at"], r["byte"], F.array_append(acc["spans"], r["spans"])))

    zero = fold(F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast("array<array<struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>>>"))
    blocks = lambda of: F.transform(F.sequence(F.lit(1), F.size(of), F.lit(BLOCK)), lambda k: F.slice(of, k, BLOCK))
    return _bound(sizes, lambda of: F.flatten(F.aggregate(blocks(of), zero, block, lambda acc: acc["spans"])))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct(role, text)>, formatted, loss_spans) from formatted text alone: the inverse of format_chats."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")

    parts = F.flatten(F.transform(blocks, _turns))
    return formatted.select("conv_id", "formatted", "loss_spans", parts.alias("turns"))


def _turns(block: Column) -> Column:
    """Turns of one block '<s>ROLE[INST]TEXT[AND]TEXT[/INST]' (the closing </s> is already split off)."""
    halves = F.split(block, r"\[INST\]")
    role = unescape(F.substring(halves[0], 4, 1 << 30))
    body = F.regexp_replace(halves[1], r"\[/INST\]$", "")
    return F.transform(F.split(body, r"\[AND\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Per conversation the counts and digests that are read back from the formatted text and its loss mask."""
    back = parse_chats(formatted)
    under = lambda raw, s: F.decode(F.substr(raw, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "UTF-8")
    loss = _bound(F.encode("formatted", "UTF-8"), lambda raw: F.array_join(F.transform("loss_spans", lambda s: unescape(under(raw, s))), ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
