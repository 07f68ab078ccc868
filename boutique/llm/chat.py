r"""Operator 6, chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of the same
role are merged into blocks with array functions; the blocks are joined into one string:

    <turn>role<text>first text<next>second text</turn><turn>...

All control strings start with ``<``. In roles and texts ``&`` is written ``&amp;`` and
``<`` is written ``&lt;``, so texts can't imitate a control string and everything can be
read back. The loss mask is a list of code-point intervals of the formatted string, one for
each assistant text.

Collecting is map-side first (one list per task and conversation). A conversation becomes
one string, hence one row, as the format demands; array work is linear in its turns (the
running lengths are summed in chunks).

Defined cases: null texts and null roles are empty; turns are sorted by (turn, role, text),
a null turn first, so ties and repeated rows are all kept in a fixed order; a null conv_id
is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<turn>", "<text>", "<next>", "</turn>"
LEARNED = "assistant"
_CHUNK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _sums_before(lengths: Column) -> Column:
    """For an array of longs: the sum of all earlier elements, for each element. Summed in
    chunks, since growing one array element by element would take quadratic time."""

    def running(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(values, start, lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before")))

    n_chunks = F.ceil(F.size(lengths) / F.lit(_CHUNK)).cast("int")
    chunks = F.transform(F.filter(F.sequence(F.lit(0), n_chunks), lambda c: c < n_chunks),
                         lambda c: running(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))))
    outer = running(F.transform(chunks, lambda c: c["sum"]))["before"]
    return F.flatten(F.zip_with(chunks, outer, lambda c, o: F.transform(c["before"], lambda x: x + o)))


def collect_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: sorted array of (turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merge_turns(turns: Column) -> Column:
    """Blocks (role, texts): runs of adjacent turns of one role."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(
        (i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1))), F.array(F.size(turns)))
    return F.transform(F.arrays_zip(places.alias("first"), ends.alias("end")), lambda p: F.struct(
        F.get(turns, p["first"])["role"].alias("role"),
        F.transform(F.slice(turns, p["first"] + 1, p["end"] - p["first"]), lambda t: t["text"]).alias("texts")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: array of (first, end) code-point intervals under the loss."""
    blocks = collect_turns(conversations).select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    # One piece per text: what stands before it, the text, whether it is learned.
    pieces = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda t, j: F.struct(
        F.when(j > 0, F.lit(NEXT)).otherwise(F.concat(
            F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(b["role"]), F.lit(TEXT))).alias("lead"),
        escape(t).alias("text"), (b["role"] == LEARNED).alias("learned")))))
    pieces = blocks.select("conv_id", pieces.alias("pieces"))
    placed = pieces.select(
        "conv_id", "pieces",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END)).alias("formatted"),
        _sums_before(F.transform("pieces", lambda p: (F.length(p["lead"]) + F.length(p["text"])).cast("long"))).alias("starts"))
    loss = F.transform(F.filter(F.zip_with("pieces", "starts", lambda p, s: F.struct(
        p["learned"].alias("learned"), (s + F.length(p["lead"])).alias("first"),
        (s + F.length(p["lead"]) + F.length(p["text"])).alias("end"))), lambda x: x["learned"]),
        lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end")))
    return placed.select("conv_id", "formatted", loss.alias("loss"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: what a formatted string and its mask say."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: F.startswith(b, F.lit(TURN)))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, TEXT, -1), NEXT, -1), lambda t: F.struct(
            unescape(F.replace(F.substring_index(b, TEXT, 1), F.lit(TURN), F.lit(""))).alias("role"), unescape(t).alias("text")))))
    return learned(formatted.select("conv_id", "formatted", "loss", turns.alias("turns"))).drop("loss")


def learned(formatted: DataFrame) -> DataFrame:
    """Adds loss_text, the texts under the mask, unescaped. The string is cut at its control
    strings once; the pieces and the mask's intervals are put in one order by position, in
    which an interval stands right before the piece that it begins in. (Substrings by
    position from the string's start would take quadratic time.)"""
    lead = lambda p: F.substring_index(p, ">", 1)  # noqa: E731 - of a piece "turn>...", the control string
    pieces = F.transform(F.filter(F.split("formatted", "<", -1), lambda p, k: k > 0), lambda p: F.struct(
        (F.length(lead(p)) + 2).cast("long").alias("skip"), (F.length(p) + 1).cast("long").alias("all"), p.alias("piece")))
    cut = formatted.withColumn("_pieces", pieces)
    cut = cut.withColumn("_starts", _sums_before(F.transform("_pieces", lambda p: p["all"])))
    texts = F.zip_with("_pieces", "_starts", lambda p, s: F.struct(
        (s + p["skip"]).alias("at"), F.lit(1).alias("kind"), p["skip"].alias("n"), p["piece"].alias("piece")))
    marks = F.transform("loss", lambda m: F.struct(
        m["first"].alias("at"), F.lit(0).alias("kind"), (m["end"] - m["first"]).alias("n"), F.lit("").alias("piece")))
    cut = cut.withColumn("_placed", F.array_sort(F.concat(texts, marks)))
    under = F.filter(F.transform("_placed", lambda x, k: F.when(
        (k > 0) & (x["kind"] == 1) & (F.get("_placed", k - 1)["kind"] == 0) & (F.get("_placed", k - 1)["at"] == x["at"]),
        F.substring(x["piece"], x["n"].cast("int"), F.get("_placed", k - 1)["n"].cast("int")))), lambda x: x.isNotNull())
    return cut.withColumn("loss_text", unescape(F.array_join(under, ""))).drop("_pieces", "_starts", "_placed")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the output."""
    read = read_conversations(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
