"""What is settled in rounds of joins, against the loops over rows in order that define it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from examloom import order, rounds
from examloom.operators import grading, reconcile, stitch
from examloom.operators.stitch import PASSING_REASONS

GENERIC = ("which", "what")


def loop_stitched(rows: list[dict]) -> list[tuple]:
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: r["pos"]):
        prior = next((o for o in reversed(out) if not o["continuation"] and r["page"] - 1 in o["pages"]), None) if r["continuation"] else None
        if prior is None:
            out.append({**r, "pages": {r["page"]}, "joined": 0, "needs_review": (r["needs_review"] or "orphaned_page_continuation") if r["continuation"] else r["needs_review"]})
            continue
        shifted = "" if r["correct_index"] == "" else str(len(prior["options"]) + int(r["correct_index"]))
        reasons = [x for x in (prior["needs_review"], r["needs_review"]) if x not in PASSING_REASONS]
        prior["correct_index"] = prior["correct_index"] or shifted
        prior["options"] = prior["options"] + r["options"]
        prior["needs_review"] = reasons[0] if reasons else ("no_visible_answer" if prior["correct_index"] == "" else "")
        prior["pages"].add(r["page"])
        prior["joined"] += 1
    return [(o["run_id"], o["pos"], o["options"], o["correct_index"], o["needs_review"], o["joined"]) for o in out]


def loop_deduped(rows: list[dict]) -> list[tuple]:
    by_label, by_content, best = {}, {}, {}
    for i, r in enumerate(sorted(rows, key=lambda r: r["pos"])):
        label, content = r["label"] or f"row-{i + 1}", (r["question"].lower().strip(), tuple(r["options"]))
        score = len(r["question"]) + len("".join(r["options"])) + (1_000_000 if r["correct_index"] else 0)
        key = by_label.get(label) or by_content.get(content) or f"label:{label}"
        if key not in best or score > best[key][-1]:
            best[key] = (r["run_id"], r["pos"], label, score)
        by_label[label] = by_content[content] = key
    return list(best.values())


def loop_reconciled(rows: list[dict]) -> list[tuple]:
    kept, out = [], []

    def generic(q):
        return len(q["anchor"]) < 12 or q["anchor"].startswith(GENERIC)

    def twin(q):
        for k in kept:
            if k["win"] == q["win"] or abs(k["page"] - q["page"]) > 1:
                continue
            if q["label"] and k["label"] == q["label"]:
                return k, "duplicate_label"
            if q["anchor"] and not generic(k) and not generic(q) and (k["anchor"].startswith(q["anchor"]) or q["anchor"].startswith(k["anchor"])):
                return k, "duplicate_anchor"
        return None, None

    rows = sorted(rows, key=lambda q: (q["win"], q["ordinal"]))
    for q in (q for q in rows if q["is_core"]):
        k, rule = twin(q)
        out.append((q["run_id"], q["ref"], q["page"], rule or "kept", k and k["ref"]))
        if k is None:
            kept.append(q)
    owned = {p: sum(k["page"] == p for k in kept) for p in {k["page"] for k in kept}}
    for w in sorted({q["win"] for q in rows if not q["is_core"]}):
        seen = [q for q in rows if not q["is_core"] and q["win"] == w]
        aligned = {q["page"] for q in seen if twin(q)[0] is not None}
        for q in seen:
            p = q["page"]
            covered = p in aligned and sum(x["page"] == p for x in seen) <= owned.get(p, 0)
            k, rule = twin(q)
            if k is None and not covered and not (not q["label"] and generic(q) and p in owned):
                kept.append(q)
                out.append((q["run_id"], q["ref"], p, "kept", None))
            else:
                out.append((q["run_id"], q["ref"], p, rule or ("covered_reread" if covered else "page_not_owned"), k and k["ref"]))
    return out


def by_run(rows: list[dict], loop) -> list[tuple]:
    return sorted((x for run in sorted({r["run_id"] for r in rows}) for x in loop([r for r in rows if r["run_id"] == run])), key=str)


def got(df, columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_stitched(spark):
    r, rows = random.Random(1), []
    for run in range(80):
        page = 0
        for pos in range(r.randint(1, 25)):
            page += r.choice([0, 0, 1, 1, 1, 2])
            n = r.randint(0, 3)
            rows.append({"run_id": run, "pos": pos * 2, "page": page, "continuation": r.random() < 0.7, "options": [f"o{pos}{i}" for i in range(n)], "correct_index": r.choice(["", "", "0", "2"]), "needs_review": r.choice(["", "no_visible_answer", "options_cut_at_page_break", "key_unclear", "not_mcq"])})
    df = spark.createDataFrame(rows, "run_id long, pos long, page long, continuation boolean, options array<string>, correct_index string, needs_review string").repartition(3)
    want = by_run(rows, loop_stitched)
    assert got(stitch.stitched_rows(df), ("run_id", "pos", "options", "correct_index", "needs_review", "joined")) == want
    assert got(stitch.stitched_exactly(df), ("run_id", "pos", "options", "joined")) == sorted(((w[0], w[1], w[2], w[5]) for w in want), key=str)
    assert stitch.stitched_rows(df.limit(0)).count() == 0


def test_deduped(spark):
    r, rows = random.Random(2), []
    for run in range(60):
        for pos in range(1, r.randint(2, 40)):
            rows.append({"run_id": f"r{run}", "pos": pos * 3, "label": r.choice(["", None, "1", "2", "3", "4", "row-2", "row-7"]), "question": r.choice(["One", "one ", "Two", "three", ""]), "options": r.choice([["a"], ["a", "b"], []]), "correct_index": r.choice(["", "1"])})
    # One content and one label that most rows have.
    rows += [{"run_id": "hot", "pos": i, "label": str(i) if i % 3 else "same", "question": "one" if i % 5 else f"q{i}", "options": [], "correct_index": ""} for i in range(1, 2500)]
    df = spark.createDataFrame(rows, "run_id string, pos int, label string, question string, options array<string>, correct_index string").repartition(4)
    assert got(stitch.deduped(df), ("run_id", "pos", "id", "score")) == by_run(rows, loop_deduped)
    assert stitch.deduped(df.limit(0)).count() == 0


def test_reconciled(spark):
    r, rows = random.Random(3), []
    anchors = ["a man of twenty", "a man of twenty five", "a woman of thirty", "which of these things", "short", "", "an old anchor text", "an old anchor"]
    for run in range(120):
        for win in range(r.randint(1, 6)):
            for ordinal in range(r.randint(0, 7)):
                rows.append({"run_id": f"r{run}", "win": win, "ordinal": ordinal, "is_core": r.random() < 0.5, "page": win * 2 + r.randint(0, 3), "ref": f"w{win}q{ordinal}", "label": r.choice(["", "", "1", "2", "3", "4", "5"]), "anchor": r.choice(anchors)})
    df = spark.createDataFrame(rows, "run_id string, win int, ordinal int, is_core boolean, page int, ref string, label string, anchor string").repartition(3)
    found = got(reconcile.reconciled(df), ("run_id", "ref", "page", "rule", "twin_ref"))
    want = by_run(rows, loop_reconciled)
    assert found == want
    assert {w[3] for w in want} == {"kept", "duplicate_label", "duplicate_anchor", "covered_reread", "page_not_owned"}
    assert reconcile.reconciled(df.limit(0)).count() == 0


def test_served(spark):
    r, rows, want = random.Random(4), [], []
    for g in range(60):
        edges = {(a, b): r.choice([0.5, 0.5, 0.75, 1.0]) for a in range(r.randint(1, 12)) for b in range(12) if r.random() < 0.4}
        rows += [(f"g{g}", a, b, s) for (a, b), s in edges.items()]
        used = set()
        for a in sorted({a for a, _ in edges}):
            free = [(-s, b) for (x, b), s in edges.items() if x == a and b not in used]
            if free:
                s, b = min(free)
                used.add(b)
                want.append((f"g{g}", a, b, -s))
    rows += [("chain", i, i + k, 1.0 - k / 2) for i in range(1, 30) for k in (0, 1)] + [("chain", 0, 1, 1.0)]
    want += [("chain", 0, 1, 1.0)] + [("chain", i, i + 1, 0.5) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "exam string, ref_id long, var_id long, score double").repartition(3)
    assert got(grading.greedy_alignment(df, "exam"), ("exam", "ref_id", "var_id", "score")) == sorted(want, key=str)
    assert grading.greedy_alignment(df.limit(0), "exam").count() == 0


def test_served_in_few_passes(spark, monkeypatch):
    """A long row of takers that put each other off takes a fixed number of tables, not one for each; lists of any length, null groups and batches that end amid a list are as a loop has them."""
    from examloom import rounds

    written = []
    monkeypatch.setattr(rounds, "materialize", lambda d, write=rounds.materialize: written.append(write(d)) or written[-1])
    rows = [("chain", i, i + k, 1.0 - k / 2) for i in range(1, 40) for k in (0, 1)] + [("chain", 0, 1, 1.0)]
    want = [("chain", 0, 1, 1.0)] + [("chain", i, i + 1, 0.5) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "exam string, ref_id long, var_id long, score double").repartition(3)
    assert got(grading.greedy_alignment(df, "exam"), ("exam", "ref_id", "var_id", "score")) == sorted(want, key=str)
    assert len(written) == 2
    # All of "all" want the same items in the same order, more than are gone through at first.
    monkeypatch.setattr(rounds, "PACKED", 4)
    monkeypatch.setattr(rounds, "WISHES", 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        some = [("all", a, b, 1.0 - b / 200) for a in range(90) for b in range(100, 180)] + [(None, 5, 6, 0.5), (None, 5, 7, 0.5), (None, 8, 6, 1.0), ("few", 1, 2, 1.0), ("few", 2, 2, 1.0), ("few", 3, 2, 0.5)]
        want = [("all", a, 100 + a, 1.0 - (100 + a) / 200) for a in range(80)] + [(None, 5, 6, 0.5), ("few", 1, 2, 1.0)]
        df = spark.createDataFrame(some, "exam string, ref_id long, var_id long, score double").repartition(5)
        written.clear()
        assert got(grading.greedy_alignment(df, "exam"), ("exam", "ref_id", "var_id", "score")) == sorted(want, key=str)
        assert len(written) == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_independent(spark):
    r = random.Random(5)
    edges = {(max(a, b), min(a, b)) for a, b in ((r.randrange(200), r.randrange(200)) for _ in range(400)) if a != b} | {(i + 1, i) for i in range(300, 330)}
    dropped: set[int] = set()
    for n in sorted({n for e in edges for n in e}):
        if any(a == n and b not in dropped for a, b in edges):
            dropped.add(n)
    assert {x["node"] for x in rounds.first_independent(spark.createDataFrame(list(edges), "node long, earlier long")).collect()} == dropped


def test_order(spark, monkeypatch):
    """Previous rows and ranks over many partitions and blocks, with one key of most rows."""
    monkeypatch.setattr(order, "BLOCK_BITS", 3)
    r = random.Random(6)
    rows = [("a" if r.random() < 0.8 else r.choice("bcd"), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    ordered = sorted(rows)
    before = {row: None if i == 0 else ordered[i - 1] for i, row in enumerate(ordered)}
    for x in order.with_previous(df, [F.col("k").asc(), F.col("v").asc()], ["k", "v"]).collect():
        assert before[x["k"], x["v"]] == (x["previous"] and tuple(x["previous"]))
    within = {(x["k"], x["v"]): x["rank"] for x in order.ranked_within(df, "k", [F.col("v").desc()]).collect()}
    assert within == {(k, v): sum(a == k and b >= v for a, b in rows) for k, v in rows}
    assert order.with_previous(df.limit(0), [F.col("v").asc()], ["v"]).count() == 0
