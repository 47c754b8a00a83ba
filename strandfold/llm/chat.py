"""Chat formatting with Spark expressions only: collected turn structs are sorted, adjacent turns of one role are merged
into a block by array functions, and blocks are concatenated.

Template of a block: ``<|turn|>ROLE<|role|>TEXT<|more|>TEXT<|end|>\\n``. Control strings that occur inside a role or a
text get one backslash more after their first character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``),
which takes away every control string and can be undone exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import fresh, running_spans

# The markers of this template, then the control strings of other templates that are taken away as well.
TURN, ROLE, MORE, END = "<|turn|>", "<|role|>", "<|more|>", "<|end|>"
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "|[]()<>/" else c for c in text)


def _rests() -> dict[str, str]:
    controls = [TURN, ROLE, MORE, END, *FOREIGN]
    return {first: "|".join(_quoted(c[1:]) for c in controls if c[0] == first) for first in "<["}


def escape(text: Column) -> Column:
    """One backslash more after the first character of every (already escaped) control string."""
    return reduce(lambda c, x: F.regexp_replace(c, rf"\{x[0]}(\\*+)(?={x[1]})", rf"{x[0]}\\$1"), _rests().items(), text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, rf"\{x[0]}\\(\\*+)(?={x[1]})", rf"{x[0]}$1"), _rests().items(), text)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: `conv`, formatted string, loss_spans array<struct<start,end>> (code points of
    `formatted`, end exclusive, one span for each text of role `learn`).

    Turns are ordered by turn, ties by role and text, null turns first. A null role or text counts as empty. Repeated rows
    stay as turns of their own. Rows of a null conversation id form one conversation. An empty table gives no rows; other
    columns are ignored.
    """
    (turns_col,) = fresh(df, "turns")
    turns = df.groupBy(F.col(conv)).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias(turns_col)
    )
    starts, blocks, parts = fresh(df, "starts", "blocks", "parts")
    t = F.col(turns_col)
    positions = F.sequence(F.lit(1), F.size(t))
    # 1-based positions at which a new role begins, then the slices between them.
    turns = turns.withColumn(starts, F.filter(positions, lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"])))
    s = F.col(starts)
    turns = turns.withColumn(blocks, F.transform(s, lambda at, i: F.slice(t, at, F.coalesce(F.get(s, i + 1), F.size(t) + 1) - at)))

    def part(body: Column, loss: Column) -> Column:
        return F.struct(body.alias("s"), loss.alias("loss"))

    no = F.lit(False)

    def block_parts(block: Column) -> Column:
        who = F.get(block, F.lit(0))["role"]
        body = F.flatten(F.transform(block, lambda x, i: F.array(part(F.when(i == 0, F.concat(F.lit(TURN), escape(who), F.lit(ROLE))).otherwise(F.lit(MORE)), no), part(escape(x["text"]), who == F.lit(learn)))))
        return F.concat(body, F.array(part(F.lit(END + "\n"), no)))

    turns = turns.withColumn(parts, F.flatten(F.transform(F.col(blocks), block_parts)))
    pieces = F.transform(F.col(parts), lambda p: F.struct(F.lit(0).alias("skip"), F.length(p["s"]).alias("size"), p["loss"].alias("keep"), F.lit(0).alias("value")))
    spans = F.transform(running_spans(pieces, "int"), lambda x: F.struct(x["start"], x["end"]))
    return turns.select(F.col(conv), F.array_join(F.transform(F.col(parts), lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation: the original turns."""
    q = lambda marker: F.lit(_quoted(marker))

    def turns_of(block: Column) -> Column:
        halves = F.split(block, q(ROLE))
        body = F.regexp_replace(F.get(halves, F.lit(1)), _quoted(END) + "\n$", "")
        return F.transform(F.split(body, q(MORE)), lambda x: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, q(TURN))
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped.

    Cutting a string walks it from its start, so n spans are cut from about sqrt(n) sections, not each from the whole.
    """
    cut = lambda s, start, end: F.substr(s, (start + 1).cast("int"), (end - start).cast("int"))
    few = F.greatest(F.ceil(F.sqrt(F.size(spans))), F.lit(1)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / few).cast("int")), lambda i: F.slice(spans, i * few + 1, few))

    def texts(group: Column) -> Column:
        start = F.get(group, F.lit(0))["start"]
        # A lambda around the section makes it one value, cut once for all spans of the group.
        section = F.array(cut(formatted, start, F.element_at(group, -1)["end"]))
        return F.flatten(F.transform(section, lambda s: F.transform(group, lambda x: unescape(cut(s, x["start"] - start, x["end"] - start)))))

    return F.when(F.size(spans) > 0, F.array_join(F.flatten(F.transform(groups, texts)), "")).otherwise(F.when(spans.isNotNull(), F.lit("")))
