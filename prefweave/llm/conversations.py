"""Conversation structure repair: the cheapest edits, found by an auction for shortest paths, as whole repaired turns."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from prefweave.llm.storage import written

# What edits cost, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
# Where a conversation may stand: nothing yet, or after a system, user or assistant turn. It may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Turns whose prices one auction settles before the turns ahead of them are looked at.
BLOCK = 16


def _arcs(code: str) -> list[list[tuple[str, int, int]]]:
    """For each of the four states before a turn of this code, the arcs (letter, cost, how many nodes ahead).

    Codes: x is a turn that has to go; else s, u, a or o (any other role), in upper case where the turn is truncated. `$` is
    the end, behind the last turn.
    """
    arcs: list[list[tuple[str, int, int]]] = []
    for state in range(4):
        here = [("I", INSERT, STEPS[state, role] - state) for role in "ua" if (state, role) in STEPS]
        if code == "$":
            if state in (NOTHING, ASSISTANT):
                here.append(("", 0, 4 - state))
        else:
            here.append(("D", DELETE, 4))
            if code != "x":
                extra = TRUNCATED if code.isupper() else 0
                if (state, code.lower()) in STEPS:
                    here.append(("K", KEEP + extra, 4 + STEPS[state, code.lower()] - state))
                here += [("R", REROLE + extra, 4 + STEPS[state, role] - state) for role in "ua" if (state, role) in STEPS]
        arcs.append(sorted(here))
    return arcs


ARCS = {code: _arcs(code) for code in "xsuaoSUAO$"}


def _settle(origin: int, ahead: int, price: array, codes: str) -> None:
    """Auction from `origin` to any node from `ahead` on, whose prices are exact already; then that of `origin` is, too.

    The path ends at its last node. If that node's price is below the cheapest arc out of it and the price behind the arc, the
    price rises to that and the path is contracted by the node; otherwise the path is extended along that arc.
    """
    path = [origin]
    while path[-1] < ahead:
        node = path[-1]
        least, target = None, node
        for _, cost, offset in ARCS[codes[node >> 2]][node & 3]:
            value = cost + price[node + offset]
            if least is None or value < least:
                least, target = value, node + offset
        if price[node] < least:
            price[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(target)


def prices(codes: str) -> array:
    """Dual prices of the lattice of a conversation: node 4 * i + state stands before turn i; the last node is the end.

    No price exceeds the cost of an arc and the price behind it, and the price of the first node is the cost of the cheapest
    repair. Blocks of turns are settled from the last to the first, each from all states before it, against the exact prices
    behind it, so the work is linear in the turns.
    """
    codes += "$"
    price = array("q", bytes(8 * (4 * len(codes) + 1)))
    high = len(codes)
    while high:
        low = max(0, high - BLOCK)
        # The least exact price behind the block is no more than any of its nodes' distance.
        behind = price[4 * high : 4 * high + 4] if high < len(codes) else price[-1:]
        for node in range(4 * low, 4 * high):
            price[node] = min(behind)
        for state in range(4) if low else (NOTHING,):
            _settle(4 * low + state, 4 * high, price, codes)
        high = low
    return price


@lru_cache(maxsize=1 << 13)
def repair_plan(codes: str) -> tuple[int, str]:
    """(cost, audit): the least cost of a repair, and the ASCII-least string of edits, letter by letter, that has it.

    Along a cheapest repair every arc is tight: its cost is the difference of the prices at its ends. So the trace keeps, among
    the tight arcs from which the end can be reached by tight arcs, those of the least letter, from all states that the
    same letters lead to.
    """
    price, codes = prices(codes), codes + "$"
    end = 4 * len(codes)
    good = bytearray(end + 1)
    good[end] = 1

    def tight(node: int) -> list[tuple[str, int]]:
        arcs = ARCS[codes[node >> 2]][node & 3]
        return [(letter, node + to) for letter, cost, to in arcs if price[node] == cost + price[node + to] and good[node + to]]

    for layer in range(4 * (len(codes) - 1), -1, -4):
        # Inserted turns lead on within a layer: at most two follow one another on a cheapest repair.
        for state in (ASSISTANT, USER, ASSISTANT, SYSTEM, NOTHING):
            if tight(layer + state):
                good[layer + state] = 1
    audit, front = [], {0}
    while end not in front:
        arcs = [arc for node in front for arc in tight(node)]
        letter = min(arcs)[0]
        audit.append(letter)
        front = {node for other, node in arcs if other == letter}
    return price[0], "".join(audit)


def _plan_column(codes: Column) -> Column:
    def run(batch: pa.Array) -> pa.Array:
        plans = [repair_plan(c or "") for c in batch.to_pylist()]
        arrays = [pa.array([p[0] for p in plans], pa.int64()), pa.array([p[1] for p in plans], pa.string())]
        return pa.StructArray.from_arrays(arrays, ["cost", "audit"])

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "cost bigint, audit string")(codes)


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns with their place in the conversation and what is wrong with each, as a written table.

    Columns: conv, pos (from 0, by turn, null ones first, then role and text), role, text, code without duplicates (see
    `_arcs`), same (a digest of role and text), blank, truncated, illegal (the initials of its role and the one before are
    none of su, ua, au), turn, next_turn (it begins a turn number of its own). A null role or text is one blank.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    placed = rows.select(
        "conv", "turn", "role", "text", (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
        initial.alias("_initial"), F.lag(initial).over(order).alias("_before"), F.lag("turn").over(order).alias("_last_turn"),
        (said == "").alias("blank"), F.right(said, F.lit(1)).isin(".", "!", "?").alias("_ended"),
    )
    kind = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("o")
    return written(
        placed.select(
            "conv", "pos", "role", "text", "turn", "blank",
            (~F.col("blank") & ~F.col("_ended")).alias("truncated"),
            F.when(F.col("blank"), "x").when(F.col("_ended"), kind).otherwise(F.upper(kind)).alias("code"),
            F.substring(F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)), 1, 16).alias("same"),
            ((F.col("pos") > 0) & ~F.concat("_before", "_initial").isin(*LEGAL)).alias("illegal"),
            (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_last_turn"))).alias("next_turn"),
        )
    )


def audits(ordered: DataFrame) -> DataFrame:
    """One row per conversation of `ordered_turns`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Each turn counts under its first fault: blank (nothing but blanks), duplicate (role and text stood in an earlier turn),
    truncated (the last sign is none of . ! ?). `gaps` counts turn numbers missing between the least and the greatest.
    `audit` has a letter per edit: Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant turn.

    Texts stay where they are. Of each turn one letter meets the others of its conversation, as it does in the audit itself.
    """
    again = F.row_number().over(Window.partitionBy("conv", "same").orderBy("pos")) > 1
    told = (
        ordered.select("conv", "pos", "turn", "code", "same", "blank", "truncated", "illegal", "next_turn")
        .withColumn("duplicate", again & ~F.col("blank"))
        .withColumn("code", F.when(F.col("duplicate"), "x").otherwise(F.col("code")))
    )
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda t: t["code"])
    span = F.max("turn") - F.min("turn") + 1 - F.count_if("next_turn")
    found = told.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"),
        F.count_if(F.col("truncated") & ~F.col("duplicate")).alias("truncated"), F.count_if("illegal").alias("illegal"),
        F.array_join(letters, "").alias("codes"),
    )
    return found.withColumn("plan", _plan_column(F.col("codes"))).select("*", "plan.*").drop("codes", "plan")


def _applier(kind: pa.DataType):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns come by conversation and place, the audit before the first of them."""
        conv, audit, at, last, place = None, "", 0, "", 0
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, last, place
            while at < len(audit) and audit[at] == "I":
                last = "a" if last == "u" else "u"
                out.append((conv, place, ROLES[last], ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for key, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if pos < 0:
                    inserted()
                    conv, audit, at, last, place = key, text, 0, "", 0
                    continue
                inserted()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                last = role[:1] if letter == "K" else "a" if last == "u" else "u"
                out.append((conv, place, role if letter == "K" else ROLES[last], text))
                place += 1
            if out:
                yield pa.RecordBatch.from_arrays(_columns(out, kind), ["conv", "pos", "role", "text"])
                out.clear()
        inserted()
        if out:
            yield pa.RecordBatch.from_arrays(_columns(out, kind), ["conv", "pos", "role", "text"])

    return apply


def _columns(rows: list[tuple], kind: pa.DataType) -> list[pa.Array]:
    return [pa.array(values, t) for values, t in zip(zip(*rows), (kind, pa.int64(), pa.string(), pa.string()))]


def repaired_turns(ordered: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv, pos, role, text): the turns of all conversations after the edits of their audits, numbered from 0.

    The turns of a conversation come out of one partition, in order, one conversation after the other. They are streamed: a task
    holds one batch and one audit, however long the conversation is. Conversations repaired to nothing have no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    plans = audited.select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = plans.unionByName(ordered.select("conv", "pos", "role", "text"))
    kind = ordered.schema["conv"].dataType
    schema = StructType([StructField("conv", kind), StructField("pos", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInArrow(_applier(to_arrow_type(kind)), schema)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of the `role:text` of `repaired_turns`, joined by line feeds: hashed turn by turn as they come."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = repaired.schema["conv"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if pos == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], arrow), pa.array([d[1] for d in done])], ["conv", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()])], ["conv", "sha256"])

    return repaired.mapInArrow(run, StructType([StructField("conv", kind), StructField("sha256", StringType())]))
