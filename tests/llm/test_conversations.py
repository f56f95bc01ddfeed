"""Operator 11 against a search over all edits in plain Python, and its SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from examloom.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, rid string, block string"
SPACE = "\t\n\x0b\x0c\r "


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def steps(state: str, role: str) -> str | None:
    """The grammar's next state, named by what came last."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, role[:1]))


def cheapest(rows: list[tuple[str, str, str | None]]) -> tuple[int, str, list[str]]:
    """(cost, audit, lines) of rows (role, text, fault): every state's best way, row by row; (cost, audit) are compared as such."""
    best: dict[str, tuple] = {"": (0, "", [])}

    def better(into, state, way):
        if state is not None and (state not in into or way[:2] < into[state][:2]):
            into[state] = way
            return True
        return False

    def with_inserts(ways):
        ways, again = dict(ways), True
        while again:
            again = False
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    again |= better(ways, steps(state, role), (cost + 5, audit + "I", [*lines, f"{role}:"]))
        return ways

    for role, text, fault in rows:
        after: dict[str, tuple] = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            better(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            better(after, steps(state, role), (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                better(after, steps(state, other), (cost + extra + 1, audit + "R", [*lines, f"{other}:{text}"]))
        best = after
    return min((w for s, w in with_inserts(best).items() if s in ("", "a")), key=lambda w: w[:2])


def plainly(rows: list[tuple]) -> dict:
    """Reports by conversation of rows (conv_id, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        own = sorted(((c, t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = text.rstrip(SPACE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        turns = {t for _, t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOd", min_size=1, max_size=14))
def test_segments_as_search(kinds):
    """Whole rows in one segment, and cut in two: the same cost and audit as a search over all edits."""
    fault = lambda k: "blank" if k == "d" else "truncated" if k.isupper() else None
    cost, audit, _ = cheapest([(k.lower(), "x", fault(k)) for k in kinds])
    for cut in range(len(kinds)):
        parts = [p for p in (kinds[:cut], kinds[cut:]) if p]
        ways = [cv.segment(p) for p in parts]
        got, states = cv.path([w[0] for w in ways], [w[1] for w in ways])
        text = "".join(w[2][4 * p + q] for w, p, q in zip(ways, states, states[1:], strict=False)) + "I" * len(cv.CLOSING[states[-1]])
        assert (got, text) == (cost, audit)


def talks(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, r.choice([t, t, t, None, r.randint(0, 12)]), role, r.choice(["Yes.", "No", "", " \n", None, "Why?", "é!", f"own {t}.", "Yes.  \t"])))
    rows += [(None, t, "user" if t % 2 else "assistant", f"t {t}.") for t in range(5)] + [(100, 1, "system", "only.")] + [(101, None, "user", "same.")] * 5
    for n in (63, 64, 65, 200, 700):  # one, two and more segments
        rows += [(1000 + n, t, ["user", "assistant"][t % 2] if r.random() < 0.9 else "system", r.choice(["Yes.", f"{t}.", f"{t}", f"{t}!"])) for t in range(n)]
    return rows + [(2000, 3, "user", "x" * 200_000 + "."), (2000, 4, "assistant", "y" * 200_000)]


def test_repair(spark):
    rows = talks(5)
    want = plainly(rows)
    report, turns = cv.repair(spark.createDataFrame([(*r, "?", "?") for r in rows], SCHEMA).repartition(5))
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in report.collect()}
    assert got == {c: w[:7] for c, w in want.items()}
    lines: dict = {}
    for r in turns.orderBy("rid", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {c: w[8] for c, w in want.items() if w[8]}
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in cv.digests(turns).collect()}
    assert hashes == {c: w[7] for c, w in want.items() if w[8]}


def test_nothing(spark):
    report, turns = cv.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == turns.count() == cv.digests(turns).count() == 0


def test_damage(spark):
    rows = talks(6)
    got = cv.damaged(spark.createDataFrame([(*r, "?", "?") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_damage(rows), key=str)


@pytest.mark.parametrize("odd_rows", [False, True])
def test_query(spark, sf, tmp_path, odd_rows):
    """The query on the given table, and on odd rows with unique turns, against plain Python and SQL."""
    from examloom.llm.oracles import OP11
    from examloom.llm.queries import op11_conversation_repair

    if odd_rows:
        seen, rows = set(), []
        for r in talks(7):
            if r[:2] not in seen:
                rows.append(r)
            seen.add(r[:2])
        sf = str(tmp_path)
        spark.createDataFrame([(*r, "?", "?") for r in rows], SCHEMA).repartition(3).write.parquet(f"{sf}/conversations.parquet")
    else:
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = plainly(plain_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: after.get(c, empty)[:8] for c in {r[0] for r in rows}}
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    df = op11_conversation_repair(spark, sf)
    assert [k for _, k in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in df.collect()} == want
    files = f"{sf}/conversations.parquet/*.parquet" if odd_rows else f"{sf}/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{files}'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(f"select conv_id, {', '.join(columns)} from ({OP11})").fetchall()} == want
