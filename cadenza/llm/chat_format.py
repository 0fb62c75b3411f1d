"""Operator 2, chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role are merged by an array aggregation; the merged turns are concatenated:

    ### role: first text</part>second text</turn>\\n### role: text</turn>\\n

The control strings `##` (of the header), `</turn>` and `</part>` are escaped
wherever a role or a text holds them, by a backslash behind their first
character.  A text that already holds an escaped form gets a further backslash,
so that reading back, which takes one away, is exact.  A role's `:` becomes
`%3A` and its `%` becomes `%25`, so that a header ends at its first `: `.

The loss mask is an array of [start, end) spans in code points of the formatted
string, one for each assistant text.

Defined cases: a null text is an empty one, and so is a null role; rows with the
same turn are ordered by role, then text (a null turn comes first); rows with a
null conv_id are one conversation; an empty table gives no rows; time is linear in the turns of a
conversation.  Other columns
are not looked at.  A conversation is one value by contract, so its rows meet in
one task however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, END, PART = "### ", "</turn>\n", "</part>"
ASSISTANT = "assistant"
#: Pieces that one fold sums, and code points of a chunk that spans are read from; the result is the same with any.
PREFIX_BLOCK, CHUNK = 256, 4096


def escape(text: Column) -> Column:
    """Adds a backslash to every control string, escaped or not: no `##`, `</turn>` or `</part>` is left."""
    text = F.regexp_replace(text, r"#(\\*)(?=#)", r"#\\$1")
    return F.regexp_replace(text, r"<(\\*)/(turn|part)>", r"<\\$1/$2>")


def unescape(text: Column) -> Column:
    """Takes one backslash from every escaped control string."""
    text = F.regexp_replace(text, r"<\\(\\*)/(turn|part)>", "<$1/$2>")
    return F.regexp_replace(text, r"#\\(\\*)(?=#)", "#$1")


def escape_role(role: Column) -> Column:
    """As escape(), and without any colon."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def gather(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: array<struct<role, text>>."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start, end>> (code points, end exclusive)."""
    merged = merged_turns(gather(conversations))
    escaped = F.transform("merged", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(HEADER), escape_role(m["role"]), F.lit(": ")).alias("head"), F.transform(m["texts"], escape).alias("texts")))
    blocks = F.transform("escaped", lambda m: F.concat(m["head"], F.array_join(m["texts"], PART), F.lit(END)))
    # every text's length, header and closing string: spans are running sums over these pieces
    pieces = F.flatten(F.transform("escaped", lambda m: F.transform(m["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.length(m["head"])).otherwise(F.lit(0)).alias("before"),
        F.length(t).alias("size"),
        F.when(i == F.size(m["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(len(PART))).alias("after"),
        (m["role"] == ASSISTANT).alias("loss"),
    ))))
    return (
        merged.select("conv_id", escaped.alias("escaped"))
        .select("conv_id", F.array_join(blocks, "").alias("formatted"), pieces.alias("pieces"))
        .select("conv_id", "formatted", parts("pieces", PREFIX_BLOCK).alias("parts"))
        .select("conv_id", "formatted", F.transform("parts", walked).alias("walked"))
        .select("conv_id", "formatted", "walked", block_starts("walked").alias("starts"))
        .select("conv_id", "formatted", F.flatten(F.transform("walked", lambda w, i: F.transform(w["spans"], lambda s: F.struct((s["start"] + F.get("starts", i)).alias("start"), (s["end"] + F.get("starts", i)).alias("end"))))).alias("loss_spans"))
    )


def parts(column: str, size: int) -> Column:
    """An array cut into arrays of `size` elements (the last one smaller)."""
    n = F.floor((F.size(column) + size - 1) / size)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.slice(column, (i * size + 1).cast("int"), F.lit(size)))).otherwise(F.array())


def walked(pieces: Column) -> Column:
    """The length of some pieces and the loss spans in them, counted from their start.

    An array that grows by one element is copied as a whole, so a fold works on PREFIX_BLOCK pieces at most.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["before"]
        end = begin + p["size"]
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + p["after"]).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, walk)


def block_starts(column: str) -> Column:
    """Where each of the walked parts starts: running sums of their lengths."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
    return F.aggregate(column, start, lambda acc, w: F.struct((acc["at"] + w["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])


def merged_turns(gathered: DataFrame) -> DataFrame:
    """conv_id, merged: array<struct<role, texts>> with adjacent turns of one role together."""
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.get("turns", i - 2)["role"]))
    ends = F.transform("first", lambda _, k: F.coalesce(F.get("first", k + 1), F.size("turns") + 1))
    merged = F.transform(F.arrays_zip(F.col("first").alias("a"), F.col("ends").alias("b")), lambda z: F.struct(
        F.element_at("turns", z["a"])["role"].alias("role"),
        F.transform(F.slice("turns", z["a"], z["b"] - z["a"]), lambda t: t["text"]).alias("texts"),
    ))
    return gathered.withColumn("first", first).withColumn("ends", ends).select("conv_id", merged.alias("merged"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Inverse of format_conversations: conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted."""
    blocks = F.slice(F.split("formatted", END, -1), 1, F.size(F.split("formatted", END, -1)) - 1)

    def turns(block: Column) -> Column:
        head = F.instr(block, ": ")
        role = unescape_role(F.substring(block, F.lit(len(HEADER) + 1), head - len(HEADER) - 1))
        body = F.substring(block, head + 2, F.length(block))
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def under(span: Column) -> Column:
        low, high = F.floor(span["start"] / CHUNK), F.floor((F.greatest(span["end"], span["start"] + 1) - 1) / CHUNK)
        # the size stands here so that the optimizer sees two uses of the chunks and doesn't cut them anew for each span
        near = F.array_join(F.slice("chunks", (low + 1).cast("int"), F.least(high + 1, F.size("chunks")).cast("int") - low.cast("int")), "")
        return unescape(F.substring(near, (span["start"] - low * CHUNK + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    # a place in a long string is found by counting from its start, so spans are read from chunks
    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    cut = formatted.select("conv_id", "formatted", "loss_spans", chunks.alias("chunks"))
    return cut.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.transform("loss_spans", under).alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from what read_back() finds in the output."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
