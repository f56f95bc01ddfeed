"""Operator 11, repair of conversations: the cheapest edits that make a conversation's roles follow ``(s?(ua)+)?``.

Rows are put in order over all conversations and cut into segments of at most 2**SEGMENT_BITS rows of one conversation, so that no task holds a
conversation. For a segment, layers of ascending cost hold, for each of its rows, a bitset of (grammar state before the row, state behind the segment) that
exactly this cost can connect; a layer follows from earlier ones by shifts and masks. The first layer that holds a pair gives its cost, and walking
the bits from the front gives its least audit. A conversation's path goes through the sixteen costs of each of its segments: backwards for the cost that is
still to come, then forwards, where the first accepting cost is met; audits of one segment that end in different states differ within it, so they need comparing there only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.order import in_order
from examloom.storage import materialize

#: Grammar states: nothing yet, behind a system turn, behind a user turn, behind an assistant turn. The first and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where keeping a row of a role initial leads.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Roles to insert behind the last row, by state.
CLOSING = {START: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}
SEGMENT_BITS = 6
BLANKS = "\t\n\x0b\x0c\r "
LEGAL = ("su", "ua", "au")
#: Bit 4 * q + p of a set stands for the way from state p to state q; SAME has those that stay.
_EACH, SAME = 0x1111, 0x8421


def _before_user(ways: int) -> int:
    at = (ways >> USER) & _EACH
    return at | at << SYSTEM | at << ASSISTANT


def _before_assistant(ways: int) -> int:
    return ((ways >> ASSISTANT) & _EACH) << USER


_BEFORE_KEPT = {"s": lambda ways: (ways >> SYSTEM) & _EACH, "u": _before_user, "a": _before_assistant, "o": lambda ways: 0}


def layers(rows: str) -> list[list[int]]:
    """layers[c][t]: the ways of a cost of exactly c from before row t to behind the last row, until every way that exists is seen.

    ``rows``: role initials (s, u, a, o for any other), capital where truncated, d where a row must go. Rows may be inserted before a row only.
    """
    n, found, seen = len(rows), [], 0
    nothing = [0] * (n + 1)
    ways = {(p, q) for p in range(4) for q in (p, USER, ASSISTANT)} | ({(START, SYSTEM)} if "s" in rows.lower() else set())
    goal = sum(1 << (4 * q + p) for p, q in ways)
    while seen != goal:
        at = len(found)
        earlier = lambda k: found[at - k] if at >= k else nothing  # noqa: B023, E731
        here = [0] * n + [SAME if at == 0 else 0]
        one, two, five, six = earlier(REROLE), earlier(DELETE), earlier(INSERT), earlier(TRUNCATED + REROLE)
        for t in range(n - 1, -1, -1):
            x, some = rows[t], two[t + 1]
            if x != "d":
                kept, changed = (here, one) if x.islower() else (five, six)
                some |= _BEFORE_KEPT[x.lower()](kept[t + 1])
                some |= _before_user(changed[t + 1]) | _before_assistant(changed[t + 1])
            here[t] = some | _before_user(five[t]) | _before_assistant(five[t])
        found.append(here)
        seen |= here[0]
    return found


def trace(rows: str, found: list[list[int]], p: int, q: int, cost: int) -> str:
    """The ASCII-least audit of a way of least cost: at each step the first of D, I, K, R that some way goes on from."""
    out, t, state = [], 0, p
    open_ = lambda cost, t, state: cost >= 0 and found[cost][t] >> (4 * q + state) & 1
    while t < len(rows):
        x = rows[t]
        extra = TRUNCATED if x.isupper() else 0
        after, kept = ASSISTANT if state == USER else USER, KEPT.get((state, x.lower()))
        if open_(cost - DELETE, t + 1, state):
            edit, cost = "D", cost - DELETE
        elif open_(cost - INSERT, t, after):
            edit, cost, state, t = "I", cost - INSERT, after, t - 1
        elif x != "d" and kept is not None and open_(cost - extra, t + 1, kept):
            edit, cost, state = "K", cost - extra, kept
        else:
            edit, cost, state = "R", cost - extra - REROLE, after
        out.append(edit)
        t += 1
    return "".join(out)


@lru_cache(maxsize=1 << 15)
def segment(rows: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[str | None, ...]]:
    """(costs, order of the audits from each state, audits) of the ways through a segment, at 4 * p + q; a cost of -1 where there is no way."""
    found = layers(rows)
    costs = [next((c for c, layer in enumerate(found) if layer[0] >> (4 * q + p) & 1), -1) for p in range(4) for q in range(4)]
    audits = [trace(rows, found, i // 4, i % 4, c) if c >= 0 else None for i, c in enumerate(costs)]
    order = [sum(o is not None and o < a for o in audits[i // 4 * 4 : i // 4 * 4 + 4]) if a is not None else -1 for i, a in enumerate(audits)]
    return tuple(costs), tuple(order), tuple(audits)


def path(costs: list[list[int]], order: list[list[int]]) -> tuple[int, list[int]]:
    """(least cost, states before each segment and behind the last) of the ASCII-least way through a conversation's segments."""
    to_come = [[INSERT * len(CLOSING[s]) for s in range(4)]]
    for c in reversed(costs):
        to_come.append([min(c[4 * p + q] + to_come[-1][q] for q in range(4) if c[4 * p + q] >= 0) for p in range(4)])
    to_come.reverse()
    states = [START]
    for i, (c, o) in enumerate(zip(costs, order, strict=True)):
        p = states[-1]
        states.append(min((o[4 * p + q], q) for q in range(4) if c[4 * p + q] >= 0 and c[4 * p + q] + to_come[i + 1][q] == to_come[i][p])[1])
    return to_come[0][START], states


@lru_cache(maxsize=1 << 15)
def edits(audit: str, state: int, initials: str) -> list[dict]:
    """What an audit does to each row of a segment entered in ``state``: roles inserted before it, its edit and its new role."""
    out, before = [], []
    for edit in audit:
        after = ASSISTANT if state == USER else USER
        name = "user" if after == USER else "assistant"
        if edit == "I":
            before.append(name)
            state = after
            continue
        if edit == "K":
            state = KEPT[state, initials[len(out)]]
        elif edit == "R":
            state = after
        out.append({"before": before, "edit": edit, "role": name if edit == "R" else None})
        before = []
    return out


_WAYS = T.StructType([T.StructField("costs", T.ArrayType(T.IntegerType())), T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("audits", T.ArrayType(T.StringType()))])
_PATH = T.StructType([T.StructField("cost", T.LongType()), T.StructField("states", T.ArrayType(T.IntegerType()))])
_EDIT = T.StructType([T.StructField("before", T.ArrayType(T.StringType())), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())])
_ARROW_WAYS = pa.struct([("costs", pa.list_(pa.int32())), ("order", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])
_ARROW_PATH = pa.struct([("cost", pa.int64()), ("states", pa.list_(pa.int32()))])
_ARROW_EDITS = pa.list_(pa.struct([("before", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string())]))


@F.arrow_udf(_WAYS)
def _ways(rows: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("costs", "order", "audits"), segment(x), strict=True)) for x in rows.to_pylist()], _ARROW_WAYS)


@F.arrow_udf(_PATH)
def _path(costs: pa.Array, order: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("cost", "states"), path(c, o), strict=True)) for c, o in zip(costs.to_pylist(), order.to_pylist(), strict=True)], _ARROW_PATH)


@F.arrow_udf(T.ArrayType(_EDIT))
def _edits(audit: pa.Array, state: pa.Array, rows: pa.Array) -> pa.Array:
    return pa.array([edits(a, s, r.lower()) for a, s, r in zip(audit.to_pylist(), state.to_pylist(), rows.to_pylist(), strict=True)], _ARROW_EDITS)


def damaged(talks: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by the hash of id and turn modulo 20: 0 drops a row, 1 empties its text, 2 takes out full stops, question and
    exclamation marks, 3 repeats it, 4 makes its role ``user``. Nulls count as one space in the hash, in roles and in texts."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.filter(F.col("kind") != 0).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return rows.drop("col")


def _neighbours(values: Column, wrong) -> Column:
    """How many neighbours in an array ``wrong`` holds of."""
    n = F.size(values) - 1
    return F.size(F.filter(F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), wrong), lambda x: x))


def _joined(values: Column) -> Column:
    return F.array_join(values, "")


def repair(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of ``talks`` (conv_id, turn, role, text).

    The report has one row for each conversation: conv_id; gaps, the turn numbers that are missing between the least and the greatest; blank, duplicate and truncated, its rows by their first fault;
    illegal, neighbours whose role initials aren't su, ua or au; cost and audit of its cheapest edits. The turns are the repaired rows: conv_id, conversation (its key, never null), block, rid and place (their order), alone (whether its conversation is one segment), role and text.

    Rows go by turn, nulls first, then by role, then by the SHA-256 of role and text; a null conv_id is a conversation of its own; null roles and texts
    are one space. Repeated rows are duplicates. An empty table gives empty results; other columns aren't read. Rows are told to be
    equal by that digest. Each conversation's audit is one value, so it alone is bounded by what a value can hold.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    initial, last = F.substring("role", 1, 1), F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conversation"), "*", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
        initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    )
    rows = in_order(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]).withColumn("block", F.shiftright("rid", SEGMENT_BITS))
    here = ["conversation", "block"]

    again = rows.groupBy("conversation", "digest").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    seen = F.col("first").isNotNull() & (F.col("rid") > F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    marked = rows.join(again, ["conversation", "digest"], "left").withColumn("fault", fault)
    held = marked.groupBy(*here).agg(
        F.array_sort(F.collect_list(F.struct("rid", "turn", "initial", code.alias("code")))).alias("r"), F.first("conv_id").alias("conv_id"), *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated"))
    )
    held = held.withColumn("turns", F.filter("r.turn", lambda t: t.isNotNull())).withColumn("initials", F.col("r.initial"))
    held = held.select(
        *here, "conv_id", "blank", "duplicate", "truncated", F.col("r.rid").alias("rids"), _joined(F.col("r.code")).alias("rows"), F.size(F.array_distinct("turns")).cast("long").alias("n_turns"), F.array_min("turns").alias("lo"),
        F.array_max("turns").alias("hi"), F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("last"), _neighbours(F.col("initials"), lambda a, b: ~F.concat(a, b).isin(*LEGAL)).cast("long").alias("illegal"),
    )
    held = materialize(held.withColumn("w", _ways(F.col("rows"))).select(*held.columns, "w.*"))

    whole = held.groupBy("conversation").agg(
        F.first("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array_sort(F.collect_list(F.struct("block", "costs", "order", "lo", "hi", "first", "last"))).alias("s"),
    )
    meeting = _neighbours(F.col("s"), lambda a, b: ~F.concat(a["last"], b["first"]).isin(*LEGAL))
    shared = _neighbours(F.col("s"), lambda a, b: F.coalesce(a["hi"] == b["lo"], F.lit(False)))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - (F.col("n_turns") - shared), F.lit(0)).cast("long")
    whole = whole.select("conversation", "conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + meeting).alias("illegal"), gaps.alias("gaps"), F.col("s.block").alias("blocks"), _path(F.col("s.costs"), F.col("s.order")).alias("p"))
    whole = materialize(whole.select("*", "p.*").drop("p"))

    n = F.size("blocks")
    way = F.arrays_zip("blocks", F.slice("states", F.lit(1), n).alias("enter"), F.slice("states", F.lit(2), n).alias("leave"))
    ways = whole.select("conversation", (n == 1).alias("alone"), F.element_at("blocks", -1).alias("end"), F.explode(way).alias("w")).select("conversation", "alone", "end", F.col("w.blocks").alias("block"), "w.enter", "w.leave")
    closing = F.when(F.col("block") == F.col("end"), F.get(F.array(*(F.array(*map(F.lit, CLOSING[s])).cast("array<string>") for s in range(4))), F.col("leave"))).otherwise(F.array().cast("array<string>"))
    ways = held.select(*here, "rids", "rows", "audits").join(ways, here).select(*here, "alone", "rids", "rows", "enter", F.get("audits", 4 * F.col("enter") + F.col("leave")).alias("audit"), closing.alias("closing"))

    audits = ways.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("block", F.concat("audit", F.repeat(F.lit("I"), F.size("closing"))).alias("audit")))).alias("a"))
    report = whole.join(audits.select("conversation", _joined(F.col("a.audit")).alias("audit")), "conversation").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    done = ways.select(*here, "alone", "rids", "closing", _edits(F.col("audit"), F.col("enter"), F.col("rows")).alias("edits"))
    edit = F.element_at("edits", F.array_position("rids", F.col("rid")).cast("int"))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = lambda roles: F.transform(roles, lambda r: turn(r, F.lit("")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    own = F.when(F.col("e.edit") == "D", none).otherwise(F.array(turn(F.coalesce("e.role", "role"), F.col("text"))))
    behind = F.when(F.col("rid") == F.element_at("rids", -1), empty(F.col("closing"))).otherwise(none)
    turns = rows.select(*here, "conv_id", "rid", "role", "text").join(done, here).select(*here, "conv_id", "rid", "alone", "role", "text", "closing", "rids", edit.alias("e"))
    turns = turns.select(*here, "conv_id", "rid", "alone", F.posexplode(F.concat(empty(F.col("e.before")), own, behind)).alias("place", "t")).select("conv_id", *here, "rid", "place", "alone", "t.role", "t.text")
    return report, turns


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's lines, which follow one another, joined by line breaks."""
    key, ident, digest = None, None, None
    names = ["conv_id", "repaired_sha256"]
    for batch in batches:
        out = []
        for c, i, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if c == key:
                digest.update(b"\n")
            else:
                if digest is not None:
                    out.append((ident, digest.hexdigest()))
                key, ident, digest = c, i, hashlib.sha256()
            digest.update(line.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([digest.hexdigest()])], names=names)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns that ``repair`` gave: ``role:text`` of each, joined by line breaks. Conversations without turns have no row.

    A conversation of one segment is hashed where its rows are. A hash goes over its bytes one after the other, so a longer one's turns come to one
    task in their order; they pass through it in batches, none of them is held.
    """
    line = turns.select("conv_id", "conversation", "block", "rid", "place", "alone", F.concat("role", F.lit(":"), "text").alias("line"))
    short = line.filter("alone").groupBy("conversation", "block").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("rid", "place", "line"))).alias("l"))
    short = short.select("conv_id", F.sha2(F.array_join("l.line", "\n").cast("binary"), 256).alias("repaired_sha256"))
    long = in_small_batches(line.filter("not alone").select("conversation", "conv_id", "line", "rid", "place").repartition("conversation").sortWithinPartitions("conversation", "rid", "place"))
    return short.unionByName(long.mapInArrow(_hashes, "conv_id long, repaired_sha256 string"))
