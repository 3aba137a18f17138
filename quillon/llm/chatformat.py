"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns. Running sums of the turns' token counts choose the spans: a
new window begins with the turn at which the sum would pass the room that the system turn and, from the second
window on, the history leave. Every window begins with the conversation's opening system turn, then repeats turns
that end the window before, as many as the history budget and the window's own turns leave room for, then has its
own turns. The loss mask covers the text of its own assistant turns, so repeated targets are masked out and each is
learned once. A turn is never cut: a window exceeds the budget only if one own turn and the system turn alone do.

The template is ``<turn:ROLE>\\nTEXT</turn>\\n``. Inside texts and roles, a backslash becomes ``\\s`` and the
``<`` of a marker ``\\l`` (in roles also ``>``: ``\\g``), so no text can close or open a turn and reading back
is exact.

Defined results: null texts and roles count as empty; turns are ordered by turn, then role, then text (null turns
first); repeated rows are turns of their own; very long texts stay whole, in a window of their own where they exceed
the budget; rows with a null conv_id are one conversation; a conversation of one system turn has it as its own turn;
an empty table gives no rows; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY = 1024, 192
#: Tokens that a turn's markers take.
OVERHEAD = 4
OPEN, MIDDLE, CLOSE = "<turn:", ">\n", "</turn>\n"


def count_tokens(text: Column) -> Column:
    """Words and single signs, as a stand-in for a tokenizer that needs no Python."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(out, F.lit("<turn"), F.lit("\\lturn")), F.lit("</turn"), F.lit("\\l/turn"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def _cuts(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(key, cuts): the places of the turns that begin a window, but for the first."""
    room = F.greatest(F.lit(1), budget - F.coalesce(F.max("system.n"), F.lit(0)))
    listed = turns.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("t"), room.alias("room"))

    def add(acc: Column, turn: Column) -> Column:
        space = F.greatest(F.lit(1), F.col("room") - F.when(F.size(acc.cuts) > 0, history).otherwise(0))
        full = (acc.sum > 0) & (acc.sum + turn.n > space)
        return F.struct(F.when(full, turn.n).otherwise(acc.sum + turn.n).alias("sum"), F.when(full, F.concat(acc.cuts, F.array(turn["at"]))).otherwise(acc.cuts).alias("cuts"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("cuts"))
    return listed.select("key", F.aggregate("t", start, add, lambda acc: acc.cuts).alias("cuts"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 1), formatted, n_repeated (leading turns that an earlier window has), loss (spans
    of code points under the loss mask: start, length) and tokens."""
    turns = conversations.select(F.struct("conv_id").alias("key"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = Window.partitionBy("key")
    order = whole.orderBy("turn", "role", "text")
    turns = turns.withColumn("at", F.row_number().over(order)).withColumn("of", F.count("*").over(whole))
    turns = turns.withColumn("opening", (F.col("at") == 1) & (F.col("role") == "system") & (F.col("of") > 1))
    turns = turns.withColumn("n", (count_tokens(F.col("text")) + OVERHEAD).cast("long"))
    turns = turns.withColumn("system", F.max(F.when(F.col("opening"), F.struct("text", "n"))).over(whole)).where(~F.col("opening"))
    turns = turns.join(_cuts(turns, budget, history), "key")
    turns = turns.withColumn("window", F.size(F.filter("cuts", lambda c: c <= F.col("at"))) + 1).drop("cuts")
    left = F.sum("n").over(Window.partitionBy("key", "window").orderBy(F.desc("at")))
    following = F.sum("n").over(whole.orderBy("window").rangeBetween(1, 1))
    spare = F.least(F.lit(history), budget - F.coalesce(F.col("system.n"), F.lit(0)) - F.col("following"))
    turns = turns.withColumn("left", left).withColumn("following", following)
    again = F.col("following").isNotNull() & (F.col("left") <= spare)
    copies = F.array_compact(F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("repeated")), F.when(again, F.struct((F.col("window") + 1).alias("w"), F.lit(True).alias("repeated")))))
    placed = turns.select("key", "system", "at", "role", "text", "n", F.explode(copies).alias("c")).select("*", F.col("c.w").alias("window"), "c.repeated").drop("c")
    header = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MIDDLE))
    placed = placed.withColumn("body", escape(F.col("text"))).withColumn("header", header)
    head = F.concat(F.lit(OPEN + "system" + MIDDLE), escape(F.col("system.text")), F.lit(CLOSE))
    placed = placed.withColumn("head", F.coalesce(head, F.lit("")))
    placed = placed.withColumn("turn_text", F.concat("header", "body", F.lit(CLOSE)))
    before = Window.partitionBy("key", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.length("head") + F.coalesce(F.sum(F.length("turn_text")).over(before), F.lit(0)) + F.length("header")
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    placed = placed.withColumn("span", F.when(target, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    out = placed.groupBy("key", "window").agg(
        F.max("head").alias("head"),
        F.sort_array(F.collect_list(F.struct("at", "turn_text"))).alias("turns"),
        F.sum(F.col("repeated").cast("long")).alias("again"),
        F.sort_array(F.collect_list("span")).alias("loss"),
        (F.sum("n") + F.coalesce(F.max("system.n"), F.lit(0))).alias("tokens"),
    )
    text = F.concat("head", F.array_join(F.transform("turns", lambda t: t.turn_text), ""))
    repeated = F.col("again") + F.when((F.col("head") != "") & (F.col("window") > 1), 1).otherwise(0)
    return out.select("key.conv_id", F.col("window").cast("long").alias("window"), text.alias("formatted"), repeated.alias("n_repeated"), "loss", F.col("tokens").cast("long").alias("tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, as structs of role and text."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), MIDDLE, 1)
    body = lambda p: p.substr(F.length(role(p)) + len(OPEN) + len(MIDDLE) + 1, F.lit(1 << 30))
    return F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(formatted.substr((s.start + 1).cast("int"), s.length.cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, each turn once: counts and hashes."""
    turns = read_turns(F.col("formatted"))
    new = F.slice(turns, F.col("n_repeated").cast("int") + 1, F.size(turns))
    rows = formatted.select("conv_id", "window", new.alias("new"), read_loss(F.col("formatted"), F.col("loss")).alias("targets"), F.length("formatted").alias("chars"))
    rows = rows.select("conv_id", "window", F.size("new").alias("n"), F.array_join(F.transform("new", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("text"), F.array_join("targets", "").alias("target"), "chars")
    parts = F.sort_array(F.collect_list(F.struct("window", "text", "target")))
    got = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), parts.alias("p"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    text, target = joined("text"), joined("target")
    return got.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
