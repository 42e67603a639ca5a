"""Conversation repair against a search over all edit strings, and against a plain reading."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from callscope.llm import queries, repair

LEGAL = re.compile(r"(?:s?(?:ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, most):
    """(cost, audit, repaired lines) of every legal string of edits with at most ``most`` insertions."""
    wrong = faults(rows)

    def go(i, cost, audit, lines, left):
        initials = "".join(line[:1] for line in lines)
        if i == len(rows):
            if LEGAL.fullmatch(initials):
                yield cost, audit, lines
        else:
            role, text = rows[i]
            yield from go(i + 1, cost + 4, audit + "D", lines, left)
            if wrong[i] not in ("blank", "duplicate"):
                extra = 3 if wrong[i] == "truncated" else 0
                yield from go(i + 1, cost + extra, audit + "K", [*lines, f"{role}:{text}"], left)
                for other in ("user", "assistant"):
                    yield from go(i + 1, cost + extra + 3, audit + "R", [*lines, f"{other}:{text}"], left)
        if left:
            for other in ("user", "assistant"):
                yield from go(i, cost + 3, audit + "I", [*lines, f"{other}:"], left - 1)

    return go(0, 0, "", [], most)


def plain_report(rows):
    """rows: (turn, role, text) in order."""
    pairs = [(r, t) for _, r, t in rows]
    turns = {t for t, _, _ in rows if t is not None}
    wrong = faults(pairs)
    cost, audit, lines = min(every_edit(pairs, len(pairs) + 2 if len(pairs) < 4 else 3), key=lambda e: (e[0], e[1]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(wrong.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_edits_are_the_cheapest_of_all(spark):
    rng = random.Random(11)
    rows, convs = [], {}
    for c in range(150):
        conv = []
        for turn in range(rng.randrange(1, 6)):
            conv.append((rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", "assistant", "user", "tool", ""]),
                         rng.choice(["Yes.", "No", " \t", "", "Why?\n", "é!", "x" * 50])))
        convs[c] = in_order(conv)
        rows += [(c, *r, "clash") for r in conv]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df).collect()}
    assert got == {c: plain_report(conv) for c, conv in convs.items()}


def test_edits_hold_the_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hi."), (1, 2, "user", "What"), (1, 2, "user", "What"), (1, 9, "user", "So?")]
    got = repair.edits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    kept = [(r["role"], r["text"]) for r in got if r["edit"] != "D"]
    assert LEGAL.fullmatch("".join(r[0] for r, _ in kept)) and kept[0] == ("system", "Be brief.")
    assert [r["seq"] for r in got] == list(range(len(got))) and {r["key"] for r in got} == {"1"}
    assert [r["fault"] for r in got if r["edit"] != "I"] == ["", "", "truncated", "duplicate", ""]
    assert all((r["role"], r["text"]) == (None, None) for r in got if r["edit"] == "D")


def test_giant_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(3, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(5000)] + [(4, 0, "user", "x."), (4, 1, "assistant", "y.")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r["conv_id"]: r for r in repair.report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # an assistant first and a user last: both have a missing partner, or go
    assert got[3]["audit"] == "I" + "K" * 5000 + "I" and got[3]["cost"] == 6
    assert got[3]["repaired_sha256"] == hashlib.sha256(
        "\n".join(["user:", *(f"{r}:{t}" for _, _, r, t in rows[:5000]), "assistant:"]).encode()).hexdigest()
    assert got[4]["audit"] == "KK" and got[4]["cost"] == 0


def test_nulls_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, "user", "a."), (None, 1, None, None), (5, None, "user", "q?"), (5, None, "assistant", "z."), (2**60 + 1, 2**60 + 1, "user", "q?")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in repair.report(df).collect()}
    assert set(got) == {None, 5, 2**60 + 1}
    assert (got[None]["blank"], got[None]["audit"], got[None]["gaps"]) == (1, "KDI", 0)
    assert got[5]["gaps"] == 0 and got[5]["audit"] == plain_report(in_order([r[1:] for r in rows[2:4]]))[-2]
    assert got[2**60 + 1]["gaps"] == 0
    assert repair.report(df.limit(0)).count() == 0 and repair.edits(df.limit(0)).count() == 0


def plainly_damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        of = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        of += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: in_order(rows) for c, rows in out.items()}


def test_query_on_conversations_of_every_damage(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t if c % 9 else None, ("user", "assistant")[t % 2] if t or c % 3 else "system", rng.choice([f"Turn {t}.", "Same?", None, "cut of"]))
            for c in [*range(60), None] if c is not None for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "x."), (None, 1, None, "y.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "lost."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:9] for r in got.collect()} == {c: plain_report(of) for c, of in plainly_damaged(rows).items()}
    assert plainly_damaged(rows)[gone] == []


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = repair.report(df)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1
