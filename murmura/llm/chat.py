r"""Chat formatting in Spark expressions only.

A conversation is its turn structs, collected and sorted. Adjacent turns of one role are merged into a run, which stands
under one header:

    ### role:\n text </turn>\n text </turn>\n

Control strings inside roles and texts are escaped, so the output reads back exactly: ``\`` becomes ``\b``, ``###``
``\h``, ``</turn>`` ``\e``, and in roles ``:`` ``\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def escaped(c: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def formatted_chats(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments (array of piece and loss flag, whose pieces join to ``formatted``).

    Turns go by turn, then role, then text, so ties and repeated rows have one order; a null turn goes first, a null
    role or text is empty, a null conv_id is a conversation, no rows give none, texts of any length are whole, and other
    columns are left aside. A conversation is one row of the result, so it has to fit a task."""
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", merged_runs(F.col("turns")).alias("runs"))

    def pieces(run: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
        head = piece(F.concat(F.lit(HEAD), escaped(run["role"], ROLE_ESCAPES), F.lit(HEAD_END)), F.lit(False))
        said = F.transform(run["texts"], lambda text: F.array(piece(escaped(text), run["role"] == loss_role), piece(F.lit(TURN_END), F.lit(False))))
        return F.concat(F.array(head), F.flatten(said))

    return chats.select("conv_id", F.flatten(F.transform("runs", pieces)).alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments"
    )


def merged_runs(turns: Column) -> Column:
    """Runs (role, texts) of sorted ``turns``: a turn of the last run's role adds its text there, another begins a run."""

    def step(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        begun = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        same = F.when(F.size(runs) > 0, last["role"] == t["role"]).otherwise(F.lit(False))
        return F.when(same, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(F.concat(runs, F.array(begun)))

    return F.aggregate(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), step)


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def turns_of(run: Column) -> Column:
        role = unescaped(F.substring_index(run, HEAD_END, 1), ROLE_ESCAPES)
        body = F.substr(run, F.instr(run, HEAD_END) + len(HEAD_END))
        texts = F.split(body, TURN_END)
        return F.transform(
            F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(F.filter(F.split(formatted, HEAD), lambda r: r != ""), turns_of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["piece"])), "")
