r"""Chat formatting with a grammar that is checked by a round trip.

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>\n"

Inside roles and texts, "<", any number of backslashes and "|" is a control mark; an escaped one has
one backslash more. Roles also escape line ends. The parser is deterministic: it splits at the turn
marks, takes the role up to the first line end and the text up to the last end mark, and takes one
backslash from every escaped mark.

Conversations are rendered as they are first, reparsed, and compared with their source. Where the
turns that come back differ, all turns are escaped, which changes those with control marks; escaping is
injective, so the loop ends there, and round_trip says that the last comparison held. All of it is
built-in column expressions, linear in a conversation's turns and characters: what a lambda needs from
outside it is bound once, and running sums go over blocks of turns.

Defined results: null roles and texts count as empty; turns are ordered by turn, then role, then
text, so ties and repeated rows (which stay) have one order; turns with a null number come first;
rows with a null id are one conversation with a null id; texts of any length are kept whole; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import let, running_sums

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escape(role), r"<(\\*)n", r"<$1\\n"), "\n", "<n")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.regexp_replace(role, "<n", "\n"), r"<(\\*)\\n", r"<$1n"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw, start>>: the turns of a formatted conversation, their contents
    unescaped, raw as they stand, and where raw starts (0-based, in characters)."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        tail = F.length(F.lit(END)) + 1
        raw = F.substr(part, F.length(role) + 2, F.greatest(F.lit(0), F.length(part) - F.length(role) - 1 - tail))
        return F.struct(
            unescape_role(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw"),
            F.length(role).alias("role_length"), F.length(part).alias("part_length"),
        )

    return F.transform(parts, turn)


def _well_formed(formatted: Column) -> Column:
    """Whether every turn ends with the end mark, so that nothing was lost by taking it off."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    return F.forall(parts, lambda p: F.endswith(p, F.lit(f"{END}\n")) & (F.size(F.split(p, r"<\|im_end\|>", -1)) == 2))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, round_trip, and turns: what the parser reads back (role, text, and raw, the
    text as it stands in formatted), with loss_start and loss_length of the assistant's raw texts in
    formatted (null for other roles)."""
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("source"))

    def rendered(escaped: bool) -> Column:
        one_turn = lambda t: render_turn(escape_role(t["role"]), escape(t["text"])) if escaped else render_turn(t["role"], t["text"])
        return F.concat_ws("", F.transform("source", one_turn))

    def same(formatted: Column) -> Column:
        pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
        return _well_formed(formatted) & (F.transform(parse(formatted), pair) == F.transform("source", pair))

    # A try that held is kept.
    held = let(rendered(False), lambda f: F.struct(f.alias("f"), same(f).alias("held")))
    again = let(rendered(True), lambda f: F.struct(f.alias("f"), same(f).alias("held")))
    out = grouped.withColumn("_try", let(held, lambda h: F.when(h["held"], h).otherwise(again)))
    out = out.select("conv_id", F.col("_try.f").alias("formatted"), F.col("_try.held").alias("round_trip"))
    marks = len(START)

    def told(turns: Column) -> Column:
        starts = running_sums(F.transform(turns, lambda t: t["part_length"] + marks))
        said = lambda t, at: F.struct(
            t["role"].alias("role"),
            t["text"].alias("text"),
            t["raw"].alias("raw"),
            F.when(t["role"] == "assistant", at + marks + t["role_length"] + 1).alias("loss_start"),
            F.when(t["role"] == "assistant", F.length(t["raw"])).alias("loss_length"),
        )
        return F.zip_with(turns, starts, said)

    return out.select("conv_id", "formatted", "round_trip", let(parse(F.col("formatted")), told).alias("turns"))
