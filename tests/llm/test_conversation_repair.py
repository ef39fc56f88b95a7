import hashlib
import itertools
import random
import re

import pytest

from concord.llm import conversation_repair as c

CONVS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repairs(rows, found, insertions=2):
    """Every way to edit the rows: (cost, audit, repaired rows)."""
    gaps = [[p for n in range(insertions + 1) for p in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    edits = [("D", "Ku", "Ra", "Ru") if f in ("", "truncated") else ("D",) for f in found]
    for filled in itertools.product(*gaps):
        for chosen in itertools.product(*edits):
            cost, audit, out = 0, "", []
            for i, new in enumerate(filled):
                cost, audit, out = cost + 3 * len(new), audit + "I" * len(new), out + [(r, "") for r in new]
                if i < len(rows):
                    e, (role, text) = chosen[i], rows[i]
                    cost += {"D": 4, "K": 0, "R": 3}[e[0]] + 3 * (e != "D" and found[i] == "truncated")
                    audit += e[0]
                    if e != "D":
                        out.append((role if e[0] == "K" else "user" if e == "Ru" else "assistant", text))
            yield cost, audit, out


def brute(rows, insertions=2):
    found = faults(rows)
    cost, audit, out = min(x for x in repairs(rows, found, insertions) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in x[2])))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), out


def edge_rows():
    r = random.Random(5)
    texts = ["Fine.", "Fine! ", "cut", "", " \t", "Why?", "no end\n", "日本。", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", "uncle"]
    convs = {i: [(t, r.choice(roles[:3] * 4 + roles), r.choice(texts)) for t in range(r.randint(1, 4))] for i in range(60)}
    convs[-7] = [(0, "user", "Hi."), (0, "user", "Hi."), (0, "assistant", "Yo."), (None, "system", "Be kind."), (9, None, None), (9, "assistant", "cut")]
    convs[None] = [(None, "user", "Hi."), (3, "assistant", "Hello."), (None, "assistant", None)]
    convs[99] = [(-(1 << 63), "user", "Hi."), ((1 << 63) - 1, "assistant", "Hello.")]
    return convs


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return [(r, x) for _, r, x in sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, *r) for i, rows in edge_rows().items() for r in rows], CONVS)


def test_reports_equal_every_possible_repair(spark, edge):
    got = {r["conv_id"]: r for r in c.repair_reports(edge.selectExpr("*", "1 AS kind", "2 AS conv", "3 AS size")).collect()}
    want = edge_rows()
    assert got.keys() == want.keys()
    for i, rows in want.items():
        turns = {t for t, _, _ in rows if t is not None}
        gaps = min((1 << 63) - 1, max(turns) - min(turns) + 1 - len(turns)) if turns else 0
        assert tuple(got[i])[1:] == (gaps, *brute(ordered(rows), 2 if len(rows) < 4 else 1)[0]), (i, rows)


def test_repaired_turns_are_the_report_s_text(spark, edge):
    rows = c.repaired_turns(edge).collect()
    reports = {r["conv_id"]: r for r in c.repair_reports(edge).collect()}
    for i, report in reports.items():
        mine = sorted((r for r in rows if r["conv_id"] == i), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == report["repaired_sha256"]
        assert "".join(r["edit"] for r in mine) == report["audit"].replace("D", "")
        assert all(r["turn"] is None for r in mine if r["edit"] == "I")


def test_long_conversations_spill_and_cross_batches(spark, monkeypatch):
    """One conversation over many Arrow batches, rows and backpointers spilled: the same result."""
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"{t}!"])) for t in range(3000)]
    convs = spark.createDataFrame([*rows, (2, 0, "user", "Hi."), (2, 1, "assistant", "Yo.")], CONVS).repartition(5)
    want = sorted(map(tuple, c.repair_reports(convs).collect()))
    frames = [x for x in _frames(c, rows)]
    for held, pointers in ((1 << 30, 1 << 30), (200, 64)):
        monkeypatch.setattr(c, "HELD_BYTES", held)
        monkeypatch.setattr(c, "POINTER_BYTES", pointers)
        import tempfile, os
        folder = tempfile.mkdtemp(prefix="run-")
        out = list(c._reports(folder)(iter(frames)))[-1]
        assert tuple(out.iloc[0])[2:] == want[0][1:]
        assert not os.listdir(folder)  # what was spilled is gone


def _frames(c, rows):
    import pandas as pd
    found = faults([(role, text) for _, _, role, text in rows])
    names = ["", "blank", "duplicate", "truncated"]
    kinds = [c.INITIALS[role[0]] + 4 * names.index(f) for (_, _, role, _), f in zip(rows, found)]
    all_rows = pd.DataFrame({"conv": 1, "no_conv": False, "turn": [t for _, t, _, _ in rows], "no_turn": False, "role": [x[2] for x in rows],
                             "text": [x[3] for x in rows], "present": True, "kind": kinds, "size": [len(x[3]) + 20 for x in rows]})
    return [all_rows.iloc[i: i + 170] for i in range(0, len(rows), 170)]


def test_dropped_conversations_stay_and_empty_tables(spark):
    convs = spark.createDataFrame([(4, 1, "user", "Hi.", False), (4, 2, "user", "Hi.", None), (5, 1, "user", "Hi.", True), (5, 2, "assistant", "Yo.", False)],
                                  CONVS + ", present boolean")
    got = {r["conv_id"]: tuple(r)[1:] for r in c.repair_reports(convs, "present").collect()}
    assert got[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[5][-3:-1] == (3, "KI")
    assert c.repair_reports(convs.limit(0)).count() == 0 and c.repaired_turns(convs.limit(0)).count() == 0


def test_damage_is_by_the_checksum(spark):
    import zlib
    rows = [(i, t, "assistant", "One. Two! x?") for i in range(40) for t in range(4)] + [(None, None, None, None)]
    got = c.damaged(spark.createDataFrame(rows, CONVS)).collect()
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = [g for g in got if g["conv_id"] == conv and g["turn"] == turn]
        text = " " if text is None else text
        assert len(mine) == (2 if d == 3 else 1) and {g["present"] for g in mine} == {d != 0}
        assert mine[0]["text"] == ("" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        assert mine[0]["role"] == ("user" if d == 4 else " " if role is None else role)
