"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A legal conversation is empty, or an optional system turn and then pairs of a
user and an assistant turn.  Turns may be kept, given another role, deleted, or
inserted empty; blank and repeated turns must go.

Secondary-sorted streaming: rows are shuffled by conversation once and sorted
by turn.  One pass reads them from the last turn to the first and carries the
cheapest cost from each of the four states of the role order across Arrow
batches; it writes on each row one byte, the best move from each state.  These
back pointers stay with their rows: Spark's sort brings them into the order of
turns and spills them to disk with the rows, so a giant conversation needs no
more memory than a short one.  The second pass reads forward and carries only
the state; it follows the pointers and emits the edited turns.  Both passes and
the sorts run in the tasks of the one shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The edits' costs and initials, in ASCII order, and the characters that end a sentence or are blank.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
EDITS = "DIKR"
BLANK_CHARS, ENDS = "\\x20\\x09-\\x0D", ".!?"
LEGAL_PAIRS = ("su", "ua", "au")

# States of the role order: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
TURN_AFTER = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled turn leads
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)  # to an accepted state by inserting


def kept(state: int, initial: str) -> int | None:
    """The state after a turn that stays as it is, if it may."""
    if initial == "s":
        return SYSTEM if state == START else None
    after = TURN_AFTER[state]
    return after if initial == ("u" if after == USER else "a") else None


def moves(initial: str, fault: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The cheapest cost from each state before a turn, given those behind it, and the first edit of each packed in two bits.

    Of edits that cost the same the ASCII-least is taken; every edit leads to
    one state, so this gives the ASCII-least string of edits.
    """
    must_go = fault in ("blank", "duplicate")
    extra = TRUNCATED if fault == "truncated" else 0
    options = []
    for state in range(4):
        found = {"D": DELETE + ahead[state]}
        if not must_go:
            after = kept(state, initial)
            if after is not None:
                found["K"] = extra + ahead[after]
            found["R"] = REROLE + extra + ahead[TURN_AFTER[state]]
        options.append(found)
    least = [min(found.values()) for found in options]
    user, assistant = min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])
    inserted = (INSERT + user, INSERT + user, INSERT + assistant, INSERT + user)
    cost, packed = [], 0
    for state, found in enumerate(options):
        found["I"] = inserted[state]
        best = min(found.values())
        cost.append(best)
        packed |= next(i for i, edit in enumerate(EDITS) if found.get(edit) == best) << 2 * state
    return tuple(cost), packed


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Last turn first: adds the back pointers."""
    at, ahead = (), AT_END  # no conversation's key is a tuple
    known: dict[tuple, tuple] = {}
    for batch in batches:
        out = []
        for key, initial, fault in zip(batch["key"].tolist(), batch["initial"].tolist(), batch["fault"].tolist()):
            if key != at:
                at, ahead = key, AT_END
            # costs differ from each other by a bounded number, so few cases recur
            low = min(ahead)
            case = (initial if initial in ("s", "u", "a") else "", fault, tuple(c - low for c in ahead))
            if case not in known:
                known[case] = moves(*case)
            cost, packed = known[case]
            ahead = tuple(c + low for c in cost)
            out.append(packed)
        yield batch.drop(columns="initial").assign(moves=out)


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First turn first: follows the pointers and emits the edits, a conversation's closing insertions after its last turn."""
    columns = ["key", "seq", "edit", "cost", "fault", "turn", "source_role", "role", "text"]
    at, state, seq = (), START, 0

    def insert(state: int) -> tuple[int, tuple]:
        after = TURN_AFTER[state]
        return after, ("I", INSERT, "", None, None, ROLE_OF[after], "")

    for batch in batches:
        out = []
        for key, turn, role, text, fault, packed in zip(*(batch[c].tolist() for c in ("key", "turn", "role", "text", "fault", "moves"))):
            if key != at:
                while at != () and state not in ACCEPTED:
                    state, row = insert(state)
                    out.append((at, seq, *row))
                    seq += 1
                at, state, seq = key, START, 0
            while True:
                edit = EDITS[packed >> 2 * state & 3]
                if edit != "I":
                    break
                state, row = insert(state)
                out.append((key, seq, *row))
                seq += 1
            extra = TRUNCATED if fault == "truncated" else 0
            if edit == "D":
                row = (DELETE, fault, turn, role, None, None)
            elif edit == "K":
                state = kept(state, role[:1])
                row = (extra, fault, turn, role, role, text)
            else:
                state = TURN_AFTER[state]
                row = (REROLE + extra, fault, turn, role, ROLE_OF[state], text)
            out.append((key, seq, edit, *row))
            seq += 1
        yield pd.DataFrame(out, columns=columns)
    out = []
    while at != () and state not in ACCEPTED:
        state, row = insert(state)
        out.append((at, seq, *row))
        seq += 1
    yield pd.DataFrame(out, columns=columns)


def edits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key, seq, edit, cost, fault, turn, source_role, role, text: every edit of every conversation.

    key and turn are the conversation and the turn as strings; seq counts a
    conversation's edits from 0; edit is K(eep), R(erole), D(elete) or I(nsert);
    role and text are those of the repaired turn (null if deleted), source_role
    that of the turn before (null if inserted).  fault is the first that holds
    of blank, duplicate (its role and text were seen earlier) and truncated (it
    doesn't end with a sentence's end), or empty.

    The rows of a conversation are one after another and in order, in one task.
    Turns are ordered by turn, nulls first, those of one turn by role and text.
    A null conversation is one of its own; null roles and texts count as one
    space; repeated rows are duplicates; an empty table gives no rows; other
    columns are ignored.  Role initials other than s, u and a fit nowhere.
    """
    space = F.lit(" ")
    role, text = F.coalesce(F.col(role_col).cast("string"), space), F.coalesce(F.col(text_col).cast("string"), space)
    rows = turns.select(F.col(conv_col).cast("string").alias("key"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.repartition("key")
    again = W.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first())  # in the same tasks
    rows = rows.withColumn("seen", F.row_number().over(again))
    stripped = F.regexp_replace("text", f"[{BLANK_CHARS}]+\\z", "")
    fault = (
        F.when(stripped == "", "blank").when(F.col("seen") > 1, "duplicate")
        .when(~F.lit(ENDS).contains(F.right(stripped, F.lit(1))), "truncated").otherwise(""))
    rows = rows.select("key", "turn", "role", "text", "seen", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    names = ("turn", "role", "text", "seen")
    last_first = rows.sortWithinPartitions(F.desc_nulls_last("key"), *(F.desc_nulls_last(c) for c in names))
    as_strings = [F.col("turn").cast("string").alias("turn") if c == "turn" else F.col(c) for c in rows.columns]
    kind = turns.schema[turn_col].dataType.simpleString()
    schema = "key string, turn string, role string, text string, seen int, fault string, moves int"
    pointed = last_first.select(*as_strings).mapInPandas(_backward, schema).withColumn("turn", F.col("turn").cast(kind))
    in_order = pointed.sortWithinPartitions(F.asc_nulls_first("key"), *(F.asc_nulls_first(c) for c in names))
    as_strings = [F.col("turn").cast("string").alias("turn") if c == "turn" else F.col(c) for c in pointed.columns]
    return in_order.select(*as_strings).mapInPandas(
        _forward, "key string, seq long, edit string, cost int, fault string, turn string, source_role string, role string, text string")


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    at, s = (), None

    def closed() -> tuple:
        gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
        return at, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], s["audit"].decode("ascii"), s["hash"].hexdigest()

    for batch in batches:
        out = []
        for key, edit, cost, fault, turn, source, role, text in zip(
                *(batch[c].tolist() for c in ("key", "edit", "cost", "fault", "turn", "source_role", "role", "text"))):
            if key != at:
                if s is not None:
                    out.append(closed())
                at = key
                s = dict(blank=0, duplicate=0, truncated=0, illegal=0, cost=0, first=0, last=0, turns=0, initial=None,
                         audit=bytearray(), hash=hashlib.sha256(), any=False)
            s["audit"] += edit.encode("ascii")
            s["cost"] += cost
            if fault:
                s[fault] += 1
            if edit != "I":
                if s["initial"] is not None and s["initial"] + source[:1] not in LEGAL_PAIRS:
                    s["illegal"] += 1
                s["initial"] = source[:1]
                if turn is not None:
                    number = int(turn)
                    if not s["turns"]:
                        s["first"], s["turns"] = number, 1
                    elif number != s["last"]:
                        s["turns"] += 1
                    s["last"] = number
            if edit != "D":
                s["hash"].update((("\n" if s["any"] else "") + role + ":" + text).encode())
                s["any"] = True
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([closed()] if s is not None else [], columns=columns)


def report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``turns``, made of its edits as they stream by.

    conv_id; gaps (integers between the first and the last turn that no row
    has); how many turns are blank, duplicate, truncated; illegal (neighbours
    whose roles may not follow each other); the edits' cost; audit (their
    initials in order); repaired_sha256 (of the repaired ``role:text`` lines).
    Turns must be integers.  Nulls, repeated rows and empty tables as in
    ``edits``; null turns don't count for gaps.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    longs = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    out = edits(turns, conv_col, turn_col, role_col, text_col).mapInPandas(_summaries, f"key string, {longs}, audit string, repaired_sha256 string")
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", "conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentences' ends, 3 repeats
    it, 4 makes it a user's.  Nulls count as one space, but null ids and turns stay.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("code != 0").withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
