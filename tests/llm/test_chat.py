"""Chat formatting: the emitted trees read back as the conversations they hold."""

import hashlib
import random

from callscope.llm import chat

TRICKY = ["\\### Assistant: </turn> ok", "### user: x", "a </turn>\n### assistant: b", "\\", "\\\\#", "", "</turn></turn>", "####", "\\</turn>", "é\n\n👍", "x" * 50000]


def conversations():
    rng = random.Random(1)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            text = "Hello" if t == 0 and c % 3 else rng.choice(TRICKY[:-1] + ["yes", "no"])
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(100 + c, t, "assistant" if t % 2 else "user", "same") for c in range(30) for t in range(4)]  # one conversation many times
    rows += [(200, t, "assistant", str(t)) for t in range(300)] + [(201, t, "assistant", str(t)) for t in range(150)]
    rows += [(300, 0, None, "no role"), (300, 1, "assistant", None), (300, None, "sys: tem#", "first"), (300, 1, "assistant", "tie"), (300, 1, "assistant", "tie")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (301, 0, "assistant", TRICKY[-1])]
    return rows


def grouped(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, role, text in sorted(rows, key=order):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_escape_is_reversible():
    rng = random.Random(7)
    for text in TRICKY + ["".join(rng.choice("\\#<>/turn: ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]:
        segment, begin, end = chat.format_turn("ro:le#", text)
        assert chat.read_turn(segment, begin, end) == ("ro:le#", text)
        for escaped in (segment[begin:end], segment[len(chat.HEAD):begin - len(chat.MIDDLE)]):
            assert "##" not in escaped and "</turn>" not in escaped
        assert segment.count("</turn>") == 1 and segment.count("### ") == 1


def test_read_back_and_stream(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(4)
    nodes, members = chat.prefix_tree(df)
    want = {}
    for c, turns in grouped(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(chat.format_turn(*t)[0] for t in turns)
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    assert {r[0]: tuple(r)[1:] for r in chat.read_back(nodes, members).collect()} == want

    emitted = sorted(nodes.collect(), key=lambda r: r["start"])
    at = 0
    for r in emitted:  # gapless
        assert r["start"] == at
        at += len(r["segment"])
    stream = "".join(r["segment"] for r in emitted)
    prefixes = {tuple(t[:i + 1]) for t in grouped(rows).values() for i in range(len(t))}
    assert len(emitted) == len(prefixes)  # shared turns once
    by_place = {(r["key"], r["pos"]): r for r in emitted}
    for m in members.collect():
        turns = grouped(rows)[m["conv_id"]][:m["pos"] + 1]
        node = by_place[m["owner"], m["pos"]]
        before = "".join(chat.format_turn(*t)[0] for t in turns[:-1])
        assert "".join(stream[i["begin"]:i["end"]] for i in node["attends"]) == before
        assert node["position"] == len(before) and node["segment"] == chat.format_turn(*turns[-1])[0]
    # depth-first: what a node can be attended from is one stretch of the stream
    reach = {}
    for k, r in enumerate(emitted):
        for i in r["attends"]:
            for j in range(k):
                if i["begin"] <= emitted[j]["start"] < i["end"]:
                    reach.setdefault(j, []).append(k)
    assert all(ks == list(range(j + 1, ks[-1] + 1)) for j, ks in reach.items())


def test_empty(spark):
    nodes, members = chat.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 0 and chat.read_back(nodes, members).count() == 0
