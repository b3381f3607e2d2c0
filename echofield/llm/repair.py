"""Conversation structure repair: the cheapest edits that give alternating turns.

Rows of a conversation stand by turn, nulls first; rows of one turn by role and text.
Each has at most one fault, its first of: blank, duplicate (role and text seen earlier),
truncated (no ``.!?`` at its end). Windows derive them. A repaired conversation is empty
or reads user, assistant and so on to an assistant, with or without a system turn in
front; roles count by their first letter. Keep costs 0, Rerole to user or assistant 1,
Delete 2, Insert an empty turn 5; blank and duplicate rows must go, and a truncated one
that stays costs 5.

The search is a fold in Spark SQL. ``aggregate()`` carries one (cost, steps) struct for
each of four states: empty, after the system turn, after a user, after an assistant.
``least`` takes the cheapest and, among equals, the first by letter; structs are ordered
like that. The steps hold each edit's letter with the role it makes, so that they tell
the repaired text; without those roles they are the audit. Of two different step strings
the edits differ before the roles do, so the order is the audit's.

A fold's strings grow with its rows, so a conversation is cut into segments of ``SEGMENT``
rows. A segment is folded from every state that it can begin in (the first one from empty
only), and a second fold chains the segments. The windows and both groupings share one
shuffle, by conversation; windows spill to disk. The repaired text is one value by its
definition, as its hash is of all of it: a conversation has to fit in a row.

Defined results: null roles and texts are one space, in the hashed ``conv_id:turn`` a null
is one, too; a null conv_id is a conversation. Repeated rows are rows of their own. Without
rows after the damage counts are 0, the audit is empty and the hash is that of ''. An empty
table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OTHER_SPACES

RE_ROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows of a segment.
SEGMENT = 256
#: More than any conversation's edits cost.
NEVER = 1 << 60

SPACES = " " + OTHER_SPACES
KEPT, MARKED, GONE = "kept", "truncated", "gone"
FAULTS = ("blank", "duplicate", "truncated")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and alive after the damage; dropped rows stay as not alive."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("alive"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Each row with its place in the conversation, its initial, the one before, and its fault."""
    same = Window.partitionBy("conv_id", "alive", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    order = Window.partitionBy("conv_id", "alive").orderBy(F.asc_nulls_first("turn"), "role", "text", "nth")
    initial = F.substring("role", 1, 1)
    ended = F.rtrim("text", F.lit(SPACES))
    marked = F.when(ended == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    return (
        rows.withColumn("nth", F.row_number().over(same))
        .withColumn("fault", marked)
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("initial", initial)
        .withColumn("before", F.lag(initial).over(order))
        .withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
    )


def _state(cost: Column, steps: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), steps.alias("steps"))


def _then(state: Column, cost: int, steps: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["steps"], F.lit(steps)))


NAMES = ("empty", "system", "user", "assistant")


def _states(values) -> Column:
    return F.struct(*(v.alias(n) for n, v in zip(NAMES, values, strict=True)))


def _start(k: int) -> Column:
    return _states(_state(F.lit(0 if k == j else NEVER), F.lit("")) for j in range(4))


def _inserted(s: Column) -> Column:
    """States after any inserts: a user in front of an assistant's turn, or the other way round."""
    user = F.least(s["user"], *(_then(s[n], INSERT, "Iu") for n in ("empty", "system", "assistant")))
    return _states((s["empty"], s["system"], user, F.least(s["assistant"], _then(s["user"], INSERT, "Ia"))))


def _edited(s: Column, row: Column) -> Column:
    """States after one row, without inserts in front of it."""

    def able(when: Column, state: Column, cost: int, steps: str) -> Column:
        extra = F.when(row["kind"] == MARKED, cost + CUT_OFF).otherwise(cost)
        stays = when & (row["kind"] != GONE)
        return _state(F.when(stays, state["cost"] + extra).otherwise(F.lit(NEVER)), F.concat(state["steps"], F.lit(steps)))

    before_user = [s[n] for n in ("empty", "system", "assistant")]
    always = F.lit(True)
    return _states(
        (
            _then(s["empty"], DELETE, "D"),
            F.least(_then(s["system"], DELETE, "D"), able(row["initial"] == "s", s["empty"], 0, "K")),
            F.least(_then(s["user"], DELETE, "D"), *(x for b in before_user for x in (able(row["initial"] == "u", b, 0, "K"), able(always, b, RE_ROLE, "Ru")))),
            F.least(_then(s["assistant"], DELETE, "D"), able(row["initial"] == "a", s["user"], 0, "K"), able(always, s["user"], RE_ROLE, "Ra")),
        )
    )


def _folded(rows: Column, k: int) -> Column:
    """The four states after rows, from state k before them."""

    def step(s: Column, row: Column) -> Column:
        # In two lambdas, so that what was inserted is computed once.
        return F.aggregate(F.array(_inserted(s)), _start(0), lambda _, t: _edited(t, row))

    return F.aggregate(rows, _start(k), step)


def _chained(s: Column, segment: Column) -> Column:
    """States after a segment: the cheapest way through any state before it."""

    def through(name: str) -> Column:
        ways = [_state(F.least(s[b]["cost"] + segment[k][name]["cost"], F.lit(NEVER)), F.concat(s[b]["steps"], segment[k][name]["steps"])) for k, b in enumerate(NAMES)]
        return F.least(*ways)

    return _states(through(n) for n in NAMES)


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each segment: its turns in order, counts, and its ways from each state."""
    alive, fault = F.col("alive"), F.col("fault")
    kind = F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", MARKED).otherwise(KEPT)
    turn = F.struct("place", "role", "text", "initial", kind.alias("kind"))
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    cut = (
        rows.withColumn("segment", F.when(alive, F.floor(F.col("place") / SEGMENT)).otherwise(0))
        .groupBy("conv_id", "segment")
        .agg(
            F.array_sort(F.collect_list(F.when(alive, turn))).alias("turns"),
            F.min(F.when(alive, F.col("turn"))).alias("least"),
            F.max(F.when(alive, F.col("turn"))).alias("most"),
            F.count_if(alive & F.col("new_turn")).alias("different"),
            *(F.count_if(alive & (fault == f)).alias(f) for f in FAULTS),
            F.count_if(alive & F.col("before").isNotNull() & ~legal).alias("illegal"),
        )
    )
    first = F.array(_folded(F.col("turns"), 0), *(_start(-1) for _ in NAMES[1:]))
    later = F.array(*(_folded(F.col("turns"), k) for k in range(len(NAMES))))
    return cut.withColumn("ways", F.when(F.col("segment") == 0, first).otherwise(later))


def _lines(turns: Column, steps: Column) -> Column:
    """The repaired conversation's lines, each with a newline behind it."""
    inserts = "(?:I[ua])*"

    def made(steps: Column) -> Column:
        return F.replace(F.replace(steps, F.lit("Iu"), F.lit("user:\n")), F.lit("Ia"), F.lit("assistant:\n"))

    def line(pair: Column) -> Column:
        turn, step = pair["turns"], pair["steps"]
        own = (
            F.when(F.endswith(step, F.lit("K")), F.concat(turn["role"], F.lit(":"), turn["text"], F.lit("\n")))
            .when(F.endswith(step, F.lit("Ru")), F.concat(F.lit("user:"), turn["text"], F.lit("\n")))
            .when(F.endswith(step, F.lit("Ra")), F.concat(F.lit("assistant:"), turn["text"], F.lit("\n")))
            .otherwise("")
        )
        return F.concat(made(F.regexp_extract(step, f"^({inserts})", 1)), own)

    each = F.regexp_extract_all(steps, F.lit(inserts + "(?:D|K|R[ua])"), F.lit(0))
    last = made(F.regexp_extract(steps, f"({inserts})$", 1))
    return F.concat(F.array_join(F.transform(F.arrays_zip(turns.alias("turns"), each.alias("steps")), line), ""), last)


def repaired(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: faults, cheapest edits, their cost, and the text they make."""
    rows = faults(damaged(conversations).repartition("conv_id"))
    totals = ("different", *FAULTS, "illegal")
    whole = (
        _segments(rows)
        .groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("segment", "ways", "turns"))).alias("segments"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
            *(F.sum(c).alias(c) for c in totals),
        )
    )
    chained = F.aggregate("segments", _start(0), lambda s, x: _chained(s, x["ways"]), lambda s: F.least(s["empty"], s["assistant"], _then(s["user"], INSERT, "Ia")))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("different"), F.lit(0)).cast("long")
    return whole.withColumn("best", chained).select(
        "conv_id",
        gaps.alias("gaps"),
        *FAULTS,
        "illegal",
        F.col("best.cost").alias("cost"),
        F.translate("best.steps", "ua", "").alias("audit"),
        _lines(F.flatten(F.transform("segments", lambda x: x["turns"])), F.col("best.steps")).alias("lines"),
    )


def repair(conversations: DataFrame) -> DataFrame:
    """``repaired`` with the text's hash in place of its lines."""
    text = F.substring("lines", F.lit(1), F.length("lines") - 1)
    return repaired(conversations).withColumn("repaired_sha256", F.sha2(text.cast("binary"), 256)).drop("lines")
