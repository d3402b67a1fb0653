"""Conversation structure repair: the cheapest edits that give a conversation its grammar.

The roles' initials of a repaired conversation read ``(s?(ua)+)?``.  Wu and Manber's
bit-parallel idea serves for costs in place of errors: one integer for each turn holds
16 cost layers of four bits, a bit for each state of the grammar from which the rest of
the conversation can be finished at that cost, and one shift and one mask carry all
layers over a turn.  Layers are relative to the turn's least cost; states differ by ten
at most, so 16 layers leave nothing out, whatever the conversation's length.  The first
layer that has the start state gives the cost; a walk over the bits takes the first
letter, in the order D, I, K, R, that keeps to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of edits; a truncated turn that stays adds as much as a new role.
RENAME, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3

_START, _SYSTEM, _USER, _ASSISTANT = 1, 2, 4, 8
_EACH, _ALL = 0x1111_1111_1111_1111, (1 << 64) - 1
_FOLLOW = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


class Turn(NamedTuple):
    """What the repair needs to know of a turn: its role's initial, whether it has to go, whether its text is cut off."""

    initial: str
    must_go: bool
    truncated: bool


def _before(layers: int, initial: str) -> int:
    """The states that a kept turn leads into ``layers``."""
    if initial == "u":
        return ((layers >> 2) & _EACH) * (_START | _SYSTEM | _ASSISTANT)
    if initial == "a":
        return ((layers >> 3) & _EACH) * _USER
    return (layers >> 1) & _EACH if initial == "s" else 0


def _settled(layers: int, base: int) -> tuple[int, int]:
    """Add insertions (two in a row at most are of use), then let the lowest layer be one with a state."""
    for _ in range(2):
        layers |= (_before(layers, "u") | _before(layers, "a")) << 4 * INSERT
    layers &= _ALL
    while not layers & 15:
        layers, base = layers >> 4 | 15 << 60, base + 1
    return layers, base


def cost_layers(turns: list[Turn]) -> list[tuple[int, int]]:
    """For each turn, and for the end, (layers, cost of the lowest layer): what it takes to finish from there."""
    out = [_settled(_EACH * (_START | _ASSISTANT), 0)]
    for turn in reversed(turns):
        after, base = out[-1]
        layers = after << 4 * DELETE
        if not turn.must_go:
            extra = TRUNCATED * turn.truncated
            layers |= _before(after, turn.initial) << 4 * extra
            layers |= (_before(after, "u") | _before(after, "a")) << 4 * (RENAME + extra)
        out.append(_settled(layers, base))
    return out[::-1]


def _cost_from(layers: tuple[int, int], state: int) -> int:
    bits = layers[0] // state & _EACH
    return layers[1] + ((bits & -bits).bit_length() - 1) // 4


def cheapest_edits(turns: list[Turn]) -> tuple[int, str]:
    """(cost, audit): the least of the cheapest sequences of Delete, Insert, Keep and Rerole, by initials."""
    layers = cost_layers(turns)
    at, state = 0, _START
    cost = left = _cost_from(layers[0], _START)
    audit = []
    while at < len(turns) or left:
        follows = _ASSISTANT if state == _USER else _USER
        turn = turns[at] if at < len(turns) else None
        extra = TRUNCATED * turn.truncated if turn else 0
        kept = _FOLLOW.get((state, turn.initial)) if turn and not turn.must_go else None
        if turn and _cost_from(layers[at + 1], state) == left - DELETE:
            letter, at, left = "D", at + 1, left - DELETE
        elif _cost_from(layers[at], follows) == left - INSERT:
            letter, state, left = "I", follows, left - INSERT
        elif kept and _cost_from(layers[at + 1], kept) == left - extra:
            letter, at, state, left = "K", at + 1, kept, left - extra
        else:
            letter, at, state, left = "R", at + 1, follows, left - RENAME - extra
        audit.append(letter)
    return cost, "".join(audit)


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[dict[str, str]]:
    """The repaired (role, text) rows."""
    out, at = [], 0
    system = False
    for letter in audit:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if (len(out) - system) % 2 else "user"
        out.append({"role": role, "text": text})
        system = system or len(out) == 1 and letter == "K" and role[:1] == "s"
    return out


def examine(rows: list[tuple[int | None, str, str]]) -> dict:
    """Faults, cost, audit and repaired rows of one conversation: (turn, role, text) in order."""
    turns, seen, numbers = [], set(), set()
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for number, role, text in rows:
        last = _LAST.search(text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else ""
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        turns.append(Turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if number is not None:
            numbers.add(number)
    cost, audit = cheapest_edits(turns)
    return faults | {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "illegal": sum(a.initial + b.initial not in _LEGAL for a, b in pairwise(turns)),
        "cost": cost, "audit": audit, "repaired": apply_edits([r[1:] for r in rows], audit),
    }


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired``.

    Turns stand by number, null first; equal numbers by role, then text.  Null roles and
    texts count as one blank, so a null text is a blank turn.  A role whose initial isn't
    s, u or a can only be renamed or deleted; an empty role has no initial.  A null id is
    one conversation.  Other columns are left out, an empty table gives no rows.

    Conversations are dealt out by id and read in order; a task holds the turns of one at
    a time, and 64 bits of layers for each turn.
    """
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    ordered = rows.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, own, id_type, schema = [], [], [], None, None

        def table() -> pa.RecordBatch:
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
            pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            types = [pa.int64()] * 6 + [pa.string(), pair]
            out = [pa.array(ids, id_type), *(pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True))]
            ids.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(out, ["id", *names])

        current = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and key != current:
                    ids.append(current)
                    found.append(examine(own))
                    own = []
                current = key
                own.append(tuple(turn))
            if len(found) >= 1000:
                yield table()
        if own:
            ids.append(current)
            found.append(examine(own))
        if found:
            yield table()

    return ordered.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults on purpose, by ``crc32(conv_id:turn) % 20``.

    0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it
    the user's; nulls of role, text and number count as one blank there.
    """
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = rows.withColumn("damage", kind).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
