"""Repair of conversations against SQL and against a search of all edits."""

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np

from brontide.llm import dialogs
from tests.llm.util import both, equal

KIND = "conv_id long, turn long, role string, text string"
TEXTS = ["Fine.", "Fine.", "cut off", "", " \t\n", None, "Why?  ", "no end \n", "a.b", "!"]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]


def rows_of(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for t in range(int(rng.integers(1, 9))):
            turn = None if rng.random() < 0.05 else int(t + (rng.random() < 0.1))
            out.append((c, turn, ROLES[int(rng.integers(len(ROLES)))] if rng.random() < 0.5 else ("user", "assistant")[t % 2], TEXTS[int(rng.integers(len(TEXTS)))] if rng.random() < 0.5 else f"Turn {t}."))
    return out


def searched(rows: list[tuple]) -> tuple[int, str, str]:
    """(cost, audit, digest) by a search of all edits, cheapest and least first."""
    seen, marks = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        gone = blank or (role, text) in seen
        seen.add((role, text))
        marks.append((gone, 0 if gone or re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else 1))
    best = None
    todo = [(0, "", 0, "", ())]
    done = set()
    while todo:
        cost, audit, k, roles, lines = heapq.heappop(todo)
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
            break
        state = (k, roles[-1:] if len(roles) > 1 else roles)
        if state in done:
            continue
        done.add(state)
        options = [("I", 2, x, f"{r}:", 0) for x, r in (("u", "user"), ("a", "assistant"))]
        if k < len(rows):
            _, role, text = rows[k]
            gone, rest = marks[k]
            options.append(("D", 3, "", None, 1))
            if not gone:
                options += [("K", rest, role[:1] or "?", f"{role}:{text}", 1), *[("R", 2 + rest, x, f"{r}:{text}", 1) for x, r in (("u", "user"), ("a", "assistant"))]]
        for letter, more, x, line, used in options:
            if re.fullmatch(r"s?(ua)*u?", roles + x):
                heapq.heappush(todo, (cost + more, audit + letter, k + used, roles + x, lines if line is None else (*lines, line)))
    return best


def test_same_as_sql(spark, tmp_path):
    rows = rows_of(300, 1) + [(None, 1, "user", "Hm."), (None, None, None, None), (7, 2, "user", "Fine."), (7, 2, "user", "Fine.")]
    got, want = both(spark, tmp_path, "op13_conversation_repair", conversations=spark.createDataFrame(rows, KIND).repartition(5))
    # pandas reads ids beside a null as floats
    got, want = (x.assign(conv_id=x["conv_id"].str.replace(".0", "")) for x in (got, want))
    assert len(got) == 301 and equal(got, want)


def test_same_as_a_search_of_all_edits(spark):
    rows = [(c, t, r or " ", x if x is not None else " ") for c, t, r, x in rows_of(60, 2)]
    got = {r["conv_id"]: r for r in dialogs.repair(spark.createDataFrame(rows, KIND)).collect()}
    for c, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = sorted([r[1:] for r in own], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == searched(own)


def test_long_conversation_in_pieces(spark):
    """A conversation of many pieces has the repair it has as one."""
    rows = [(k // 7000, t, r, x) for k, (_, t, r, x) in enumerate(rows_of(3000, 3))]
    rows = [(c, k, r, f"{x} {k % 900}" if x else x) for k, (c, _, r, x) in enumerate(rows)]
    table = spark.createDataFrame(rows, KIND)
    whole, cut = (sorted(map(str, dialogs.repair(table, piece_rows=n).collect())) for n in (10**9, 300))
    assert whole == cut and len(whole) == 2
    one = [(r or " ", x if x is not None else " ") for c, _, r, x in rows if c == 0]
    told = next(r for r in dialogs.repair(table).collect() if r["conv_id"] == 0)
    assert told["blank"] == sum(not x.strip(" \t\n") for _, x in one) and len(told["audit"].replace("I", "")) == len(one)


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(40) for t in range(5)]
    got = {}
    for r in dialogs.damage(spark.createDataFrame(rows, KIND)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "Yes No")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(fate, [(role, text)])
        assert got.get((c, t)) == want


def test_odd_tables(spark):
    assert dialogs.repair(spark.createDataFrame([], KIND)).collect() == []
    rows = spark.createDataFrame([("a", 1, "user", "x" * 3_000_000 + ".", 1), ("b", None, None, None, 2)], "conv_id string, turn int, role string, text string, piece int")
    got = {r["conv_id"]: r for r in dialogs.repair(rows).collect()}
    assert got["a"]["audit"] == "KI" and got["b"]["audit"] == "D" and got["b"]["gaps"] == 0
    all_gone = dialogs.repair(rows, rows.limit(0)).collect()
    assert {(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in all_gone} == {(c, 0, "", hashlib.sha256(b"").hexdigest()) for c in "ab"}


def test_states_are_few():
    automaton = dialogs.Automaton()
    rng = np.random.default_rng(4)
    automaton.scan("".join(rng.choice(list("bdsuaxSUAX"), 200_000)), dialogs.END)
    assert len(automaton.vectors) < 200
