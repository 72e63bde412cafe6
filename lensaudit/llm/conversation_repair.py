"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Windows mark
the faults of its turns, a sorted array of turns is folded by ``aggregate()``, and the fold
carries the cheapest edits that lead to each of four states: nothing said yet, a system turn,
a user turn, an assistant turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space, ends of sentences, and the costs of the edits.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Turns that are folded before their edits are added to what came before: strings of edits
#: are copied once for each such chunk, not once for each turn.
CHUNK = 256
_NEVER = 1 << 50
_STATES = ("none", "system", "user", "assistant")
# Edits are told apart by the role they give, in the order of their initials: Delete, Insert a
# user (I) or an assistant (J), Keep, Rerole to user (R) or assistant (S).
_TOLD, _SHOWN = "JS", "IR"


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of damaged turns.

    crc32 of ``conv_id:turn``, modulo 20: 0 marks the turn as gone, 1 empties its text, 2 removes
    ``[.!?]``, 3 repeats it, 4 makes it a user's. Null ids and turns read as one space in that text,
    null roles and texts are one space. An empty table gives an empty one.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text"))
    code = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    copies = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("_code", code).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_code") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def _add(state: Column, cost: int | Column, edits: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), state["rank"].alias("rank"), F.concat(state["edits"], F.lit(edits)).alias("edits"))


def _inserted(acc: Column) -> Column:
    """The states before a turn, with what may be inserted there. More never pays."""
    none, system, user, assistant = (acc[s] for s in _STATES)
    return F.struct(
        none.alias("none"),
        system.alias("system"),
        F.least(user, *(_add(x, INSERT, "I") for x in (none, system, assistant))).alias("user"),
        F.least(assistant, _add(user, INSERT, "J"), *(_add(x, 2 * INSERT, "IJ") for x in (none, system))).alias("assistant"),
    )


def _step(acc: Column, row: Column) -> Column:
    """The states after a turn: deleted, kept, or with another role."""
    none, system, user, assistant = (acc[s] for s in _STATES)
    keep = F.when(row["must_go"], _NEVER).otherwise(F.when(row["truncated"], TRUNCATED).otherwise(0)).cast("long")
    as_is = lambda initial: keep + F.when(row["initial"] == initial, 0).otherwise(_NEVER)
    gone = lambda x: _add(x, DELETE, "D")
    before_user = (none, system, assistant)
    return F.struct(
        gone(none).alias("none"),
        F.least(gone(system), _add(none, as_is("s"), "K")).alias("system"),
        F.least(gone(user), *(_add(x, as_is("u"), "K") for x in before_user), *(_add(x, keep + REROLE, "R") for x in before_user)).alias("user"),
        F.least(gone(assistant), _add(user, as_is("a"), "K"), _add(user, keep + REROLE, "S")).alias("assistant"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.aggregate(F.array(F.lit(0)), value, lambda x, _: body(x))


def _fold(rows: Column) -> Column:
    """Cheapest edits (cost, edits) of sorted turns; of equal costs, those whose initials come first.

    After the same number of turns, and before insertions, the edits of no state begin with all
    those of another; so a chunk may compare the rank of what came before it, then its own edits.
    """
    start = F.struct(*(F.struct(F.lit(0 if s == "none" else _NEVER).cast("long").alias("cost"), F.lit(1).alias("rank"), F.lit("").alias("edits")).alias(s) for s in _STATES))

    def chunk(acc: Column, part: Column) -> Column:
        before = F.array_sort(F.array_distinct(F.array(*(acc[s]["edits"] for s in _STATES))))
        ranked = F.struct(*(F.struct(acc[s]["cost"].alias("cost"), F.array_position(before, acc[s]["edits"]).cast("int").alias("rank"), F.lit("").alias("edits")).alias(s) for s in _STATES))
        after = F.aggregate(part, ranked, lambda x, row: _let(_inserted(x), lambda y: _step(y, row)))
        whole = lambda x: F.struct(x["cost"].alias("cost"), F.lit(1).alias("rank"), F.concat(F.element_at(before, x["rank"]), x["edits"]).alias("edits"))
        return _let(after, lambda x: F.struct(*(whole(x[s]).alias(s) for s in _STATES)))

    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(rows, i, CHUNK))
    narrow = F.transform(chunks, lambda part: F.transform(part, lambda r: F.struct(r["must_go"].alias("must_go"), r["truncated"].alias("truncated"), r["initial"].alias("initial"))))
    return F.aggregate(narrow, start, chunk, lambda acc: F.least(acc["none"], _inserted(acc)["assistant"]))


def _repaired(rows: Column, edits: Column) -> Column:
    """Turns after their edits, ``role:text`` each, joined by newlines."""
    own = lambda r, e: F.when(e.endswith("K"), F.concat(F.lit("\n"), r["role"], F.lit(":"), r["text"])).when(e.endswith("R"), F.concat(F.lit("\nuser:"), r["text"])).when(e.endswith("S"), F.concat(F.lit("\nassistant:"), r["text"])).otherwise("")
    new = lambda e: F.replace(F.replace(F.regexp_replace(e, "[DKRS]", ""), F.lit("I"), F.lit("\nuser:")), F.lit("J"), F.lit("\nassistant:"))
    by_turn = F.regexp_extract_all(edits, F.lit("[IJ]*[DKRS]"), F.lit(0))
    pieces = F.zip_with(rows, by_turn, lambda r, e: F.concat(new(e), own(r, e)))
    return F.concat(F.array_join(pieces, ""), new(F.regexp_extract(edits, "[IJ]*$", 0)))


def repair(convs: DataFrame, gone: str | None = None) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired (its turns after the edits).

    Turns are taken by turn (nulls first), then role, then text; rows that agree in all are
    duplicates of the first. Rows where the column ``gone`` is true take no part, but their
    conversations are returned: one without other rows has zeros and empty texts. A null conv_id is
    a conversation of its own. Null roles and texts are one space, so such texts are blank. Other
    columns, whatever their names, are ignored; an empty table gives an empty result. One task reads
    a conversation, as its result is one text: the turns of one must stay under 2 GB.
    """
    lost = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), lost.alias("gone"))
    # What is gone comes last, so it is before no other turn; one shuffle serves windows and groups.
    by_turn = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(by_turn)
    rows = rows.withColumns({
        "pos": F.row_number().over(by_turn), "initial": initial, "blank": trimmed == "",
        "illegal": before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au"), "open": ~F.substring(trimmed, -1, 1).isin(*ENDS),
    })
    seen = F.min("pos").over(Window.partitionBy("conv_id", "role", "text")) < F.col("pos")
    duplicate = ~F.col("blank") & seen
    rows = rows.withColumns({"duplicate": duplicate, "truncated": ~F.col("blank") & ~duplicate & F.col("open")})
    turn = F.struct("pos", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated", "role", "text")
    here = ~F.col("gone")
    count = lambda c: F.count(F.when(here & F.col(c), 1))
    held = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(here, F.col("turn"))) - F.min(F.when(here, F.col("turn"))) + 1, F.lit(0)).alias("span"), F.size(F.collect_set(F.when(here, F.col("turn")))).cast("long").alias("turns"),
        *(count(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.array_sort(F.collect_list(F.when(here, turn))).alias("rows"),
    )
    best = held.withColumn("best", _fold(F.col("rows")))
    done = best.withColumn("repaired", _repaired(F.col("rows"), F.col("best.edits")))
    return done.select(
        "conv_id", (F.col("span") - F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.translate("best.edits", _TOLD, _SHOWN).alias("audit"), F.expr("substring(repaired, 2)").alias("repaired"),
    )
