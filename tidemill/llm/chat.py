"""Chat formatting in budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Inside texts a backslash stands before each backslash and after the first character of what could begin a control
#: string of a common template, so no control string is left whole.
ESCAPED = r"\\|(?<=<)(?=\||/?s>|<?/?SYS>>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """An estimate of a turn's tokens: words, numbers and marks, and four for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")) + 4


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, block, rank, role, text, system (text of the leading system turn, if the conversation has more), written.

    Turns are dealt by ranges of their order, so a conversation of any length is spread over tasks; a block is what one task
    has of it. Ranks are places inside a block plus the sizes of the blocks before; only rows of (conversation, block) meet
    to add these up and to hand the system turn on.
    """
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A text's beginning sorts as the text does, and keeps the sample that finds the ranges small.
    dealt = materialize(rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).withColumn("block", F.spark_partition_id()), "turns")
    blocks = dealt.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.min(F.struct("turn", "role", "text")).alias("first"))
    order = Window.partitionBy("conv_id").orderBy("block")
    led = (F.first("first.role").over(order) == "system") & (F.sum("n").over(Window.partitionBy("conv_id")) > 1)
    blocks = blocks.select("conv_id", "block", (F.sum("n").over(order) - F.col("n")).alias("offset"), F.when(led, F.first("first.text").over(order)).alias("system"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    numbered = _beside(dealt.withColumn("place", place), materialize(blocks, "blocks")).withColumn("rank", F.col("place") + F.col("offset"))
    return numbered.filter("rank > 1 OR system IS NULL").drop("place", "offset", "turn")


def _beside(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block's row."""
    b = blocks.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    return rows.join(b, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")


def _placed(conversations: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """The turns with tokens, before (tokens of the conversation before), place (the span) and starts, written."""
    rows = _numbered(conversations).withColumns({"tokens": turn_tokens(F.col("text")), "system_tokens": F.when(F.col("system").isNull(), 0).otherwise(turn_tokens(F.col("system")))})
    room = F.greatest(F.lit(budget // 4), F.lit(budget - history_tokens) - F.col("system_tokens"))
    rows = rows.withColumn("half", (room / 2).cast("long"))
    rows = materialize(rows.withColumn("large", (F.col("tokens") > F.col("half")).cast("long")), "numbered")
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens"), F.sum("large").alias("large"), F.max_by(F.struct("tokens", "large"), "rank").alias("last"))
    order = Window.partitionBy("conv_id").orderBy("block")
    sums = sums.select("conv_id", "block", (F.sum("tokens").over(order) - F.col("tokens")).alias("tokens_before"), (F.sum("large").over(order) - F.col("large")).alias("large_before"), F.lag("last").over(order).alias("last"))
    rows = _beside(rows, materialize(sums, "sums"))

    block = Window.partitionBy("conv_id", "block").orderBy("rank")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def span(before: Column, larges: Column, large: Column) -> Column:
        return F.struct(F.floor(before / F.col("half")).alias("cell"), (2 * larges + large).alias("large"))

    before = F.col("tokens_before") + F.sum("tokens").over(so_far) - F.col("tokens")
    larges = F.col("large_before") + F.sum("large").over(so_far) - F.col("large")
    rows = rows.withColumn("before", before).withColumn("place", span(F.col("before"), larges, F.col("large")))
    behind = span(F.col("tokens_before") - F.col("last.tokens"), F.col("large_before") - F.col("last.large"), F.col("last.large"))
    former = F.coalesce(F.lag("place").over(block), F.when(F.col("last").isNotNull(), behind))
    kept = ("conv_id", "rank", "role", "text", "tokens", "system", "system_tokens", "before", "place")
    return materialize(rows.select(*kept, F.coalesce(former != F.col("place"), F.lit(True)).alias("starts")), "placed")


def format_windows(conversations: DataFrame, *, budget: int = 1024, history_turns: int = 2, history_tokens: int = 128) -> DataFrame:
    """One row per window: conv_id, span, n_repeated, tokens, formatted, loss.

    Turns go in the order (turn, role, text). Prefix sums of their estimated tokens over the conversation choose the spans:
    with room = budget less the system turn and history_tokens (a quarter of the budget at least), a turn of over half the
    room is a span of its own, and others share one if their prefix sums begin in the same half room; so no window but one
    of a single long turn exceeds the budget, and each turn is new in exactly one window. A window repeats the
    conversation's leading system turn, if it is not new there, and up to history_turns turns before its first, as far as
    history_tokens reach; the first n_repeated turns of a window are repeated ones. span is the number of a window's first
    new turn in its conversation.

    formatted: BEGIN role newline text END newline for each turn, texts and roles escaped. loss: (start, length) in
    characters of formatted, from 1, of each new assistant text.

    Windows depend on the order of turns and their tokens only, not on how rows are dealt: see _numbered. History is joined
    by turn number, one row for each repeated turn. Null texts and roles are empty; a null turn comes before all others;
    null conv_ids are one conversation; repeated rows are turns of their own; an empty table gives no rows; other columns
    are not read.
    """
    rows = _placed(conversations, budget, history_tokens)
    first = rows.filter("starts").select(F.col("conv_id").alias("_conv"), F.col("rank").alias("_first"), F.col("place").alias("_place"), F.col("before").alias("_before"), F.col("tokens").alias("_tokens"))
    earlier = first.withColumn("_rank", F.explode(F.array(*[F.col("_first") - h for h in range(1, history_turns + 1)]))) if history_turns else first.withColumn("_rank", F.lit(0)).limit(0)
    left = F.least(F.lit(history_tokens), F.lit(budget) - F.col("system_tokens") - F.col("_tokens"))
    past = rows.join(earlier, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("rank") == F.col("_rank"))).filter(F.col("_before") - F.col("before") <= left)
    columns = ("conv_id", "rank", "role", "text", "tokens", "system", "system_tokens")
    turns = rows.select(*columns, "place", F.lit(False).alias("repeated")).unionByName(past.select(*columns, F.col("_place").alias("place"), F.lit(True).alias("repeated")))

    turns = turns.withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(BEGIN), F.regexp_replace(escape(F.col("role")), "\n", r"\\n"), F.lit("\n")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    inside = Window.partitionBy("conv_id", "place").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("start", F.sum(F.char_length("piece")).over(inside) - F.char_length("piece") + F.char_length("head"))
    learned = (F.col("role") == "assistant") & ~F.col("repeated")
    found = turns.groupBy("conv_id", "place").agg(
        F.min(F.when(~F.col("repeated"), F.col("rank"))).cast("long").alias("span"),
        F.any_value("system").alias("system"),
        F.count_if("repeated").alias("n_repeated"),
        (F.sum("tokens") + F.max("system_tokens")).alias("tokens"),
        F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(learned, F.struct("start", F.char_length("body").alias("length"))))).alias("loss"),
    )
    lead = F.col("system").isNotNull()
    found = found.withColumn("prefix", F.when(lead, F.concat(F.lit(BEGIN + "system\n"), escape(F.col("system")), F.lit(END + "\n"))).otherwise(""))
    return found.select(
        "conv_id",
        "span",
        (F.col("n_repeated") + (lead & (F.col("span") > 2)).cast("long")).alias("n_repeated"),  # new in the window of turn 2
        "tokens",
        F.concat("prefix", F.array_join("pieces.piece", "")).alias("formatted"),
        F.transform("loss", lambda x: F.struct((x["start"] + F.char_length("prefix") + 1).cast("int").alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, span, place, role, text of each new turn, from the formatted strings.

    Windows of any conversations; no windows give no rows.
    """
    parts = windows.select("conv_id", "span", "n_repeated", F.posexplode(F.split("formatted", r"<\|im_start\|>")).alias("place", "part"))
    parts = parts.filter("place > n_repeated")  # what precedes the first mark is empty
    cut = F.instr("part", "\n")
    role = unescape(F.regexp_replace(F.expr("left(part, instr(part, '\n') - 1)"), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
    body = F.substring(F.col("part"), cut + 1, F.char_length("part") - cut - len(END) - 1)
    return parts.select("conv_id", "span", "place", role.alias("role"), unescape(body).alias("text"))


def read_loss(windows: DataFrame) -> DataFrame:
    """conv_id, span, text: what lies under a window's loss mask, unescaped and joined.

    A window without an assistant turn has the empty text; no windows give no rows.
    """
    spans = F.transform("loss", lambda x: F.substring(F.col("formatted"), x["start"], x["length"]))
    return windows.select("conv_id", "span", unescape(F.array_join(spans, "")).alias("text"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: read back from windows.

    A digest is of a conversation's whole text, so its turns meet in one row here, and only here.
    """

    def joined(rows: Column, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x[text]), "")

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line")
    turns = read_turns(windows).groupBy("conv_id").agg(F.count("*").alias("n_turns"), sha(joined(F.struct("span", "place", turn), "line")).alias("turns_sha256"))
    loss = read_loss(windows).groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("loss_chars"), sha(joined(F.struct("span", "text"), "text")).alias("loss_sha256"))
    size = windows.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    for more in (loss, size):
        more = more.withColumnRenamed("conv_id", "_conv")
        turns = turns.join(more, turns["conv_id"].eqNullSafe(more["_conv"])).drop("_conv")
    return turns
