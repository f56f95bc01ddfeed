from __future__ import annotations

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from examloom.operators import answers, assembly, reconcile, review, stitch, store, telemetry
from examloom.sources import files


def test_continuation_chain_needs_the_exact_form(spark):
    rows = spark.createDataFrame([(1, 0, 1, False, ["a", "b"]), (1, 1, 2, True, ["c"]), (1, 2, 3, True, ["d"]), (1, 3, 9, True, ["z"])], "run_id long, pos long, page long, continuation boolean, options array<string>")
    got = {r["pos"]: (r["options"], r["reason"]) for r in stitch.stitched_exactly(rows).collect()}
    assert got == {0: (["a", "b", "c", "d"], ""), 3: (["z"], "orphaned_page_continuation")}


def test_dedupe_follows_label_and_content(spark):
    rows = [("r", 1, "80", "What?", ["x", "y"], ""), ("r", 2, "", "what? ", ["x", "Y"], "1"), ("r", 3, "80", "Longer what?", ["x", "y"], "")]
    df = spark.createDataFrame(rows, "run_id string, pos int, label string, question string, options array<string>, correct_index string")
    got = [tuple(r) for r in stitch.deduped(df).collect()]
    assert [g[:2] for g in got] == [("r", 2)]
    assert stitch.deduped(df.repartition(3)).count() == 1


def test_reconcile_rescues_and_drops(spark):
    cols = "run_id string, win int, ordinal int, is_core boolean, page int, ref string, label string, anchor string"
    rows = [
        ("r", 0, 0, True, 1, "w0q0", "1", "A young man presents with chest pain"),
        ("r", 0, 1, True, 2, "w0q1", "2", "A woman presents with headache today"),
        ("r", 1, 0, True, 3, "w1q0", "3", "A child presents with fever and rash"),
        ("r", 1, 1, False, 2, "w1q1", "2", "something else entirely here"),
        ("r", 1, 2, False, 2, "w1q2", "", "which"),
        ("r", 1, 3, False, 4, "w1q3", "58", "The last question of the whole page"),
    ]
    got = {r["ref"]: r["rule"] for r in reconcile.reconciled(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"w0q0": "kept", "w0q1": "kept", "w1q0": "kept", "w1q1": "duplicate_label", "w1q2": "page_not_owned", "w1q3": "kept"}


def test_reconcile_takes_the_first_kept_and_looks_at_three_pages(spark):
    """The twin is the one that was kept first, not the one on the lowest page; and a long run doesn't take the square of its rows."""
    cols = "run_id string, win int, ordinal int, is_core boolean, page int, ref string, label string, anchor string"
    rows = [("r", 0, 0, True, 3, "a", "7", "x"), ("r", 1, 0, True, 1, "b", "7", "x"), ("r", 2, 0, True, 2, "c", "7", "x"), ("r", 3, 0, False, 1, "d", "7", "x")]
    got = {r["ref"]: (r["rule"], r["twin_ref"]) for r in reconcile.reconciled(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": ("kept", None), "b": ("kept", None), "c": ("duplicate_label", "a"), "d": ("duplicate_label", "b")}
    n = 20_000
    long = spark.range(n).selectExpr("'r' run_id", "int(id div 10) win", "int(id % 10) ordinal", "true is_core", "int(id div 3) page", "string(id) ref", "'' label", "concat('what is meant by the word ', id) anchor")
    began = time.monotonic()
    assert reconcile.reconciled(long).filter("rule = 'kept'").count() == n
    assert time.monotonic() - began < 20


def test_windows_cover_pages_once(spark):
    pages = spark.createDataFrame([("r", p) for p in (1, 2, 4, 7, 8)], "run_id string, page int")
    got = reconcile.planned_windows(pages, 2).collect()
    cores = sorted((r["win"], r["page"]) for r in got if r["role"] == "core")
    assert cores == [(0, 1), (0, 2), (1, 4), (1, 7), (2, 8)]
    assert sorted(r["page"] for r in got if r["win"] == 1 and r["role"] == "context") == [2, 8]


def test_final_flags_of_all_rows(spark):
    """Against brute force, over every document: none is filtered away."""
    from examloom.plans import catalogue
    from examloom.sources import relations

    sf, want = "/root/testdata/sf0.001", {}
    for r in relations.exam_rows(relations.read(spark, sf, "documents")).collect():
        rest, style = [o.lstrip() for o in r["options"]], r["doc_id"] % 5
        labels = [(f"{chr(65 + i)}. ", f"({chr(97 + i)}) ", f"{i + 1}. ", ("i. ", "ii. ", "iii. ", "iv. ", "v. ")[i], "")[style] for i in range(len(rest))]
        merge = style == 0 and len(rest) > 1 and all(re.fullmatch("[a-z]+", o) for o in rest)
        bare = len(rest) > 1 and all(rest) and not merge
        flag = "incomplete_options" if len(rest) < 2 else "options_cut_at_page_break" if r["pos"] % 5 == 4 else r["needs_review"] or ("" if r["question"].strip() else "empty_question") or ("possible_merge" if merge else "")
        want[r["id"]] = ("|".join(rest if bare and style < 4 else [k + o for k, o in zip(labels, r["options"], strict=True)]), flag)
    got = {r["id"]: (r["options"], r["needs_review"]) for r in catalogue.queries()["final_flags_all_rows"](spark, sf).collect()}
    assert got == want and sum(f == "incomplete_options" for _, f in got.values()) > 0


def test_candidates_meet_under_rare_tokens(spark):
    """A word that every text holds makes no pairs of its own; the pairs are those of brute force."""
    from examloom.operators import grading

    texts = {i: {"common", *(f"word{(i * k) % 97}x" for k in range(1, 8)), *(f"own{i // 3}n{k}" for k in range(6))} for i in range(300)}
    df = spark.createDataFrame([(i, " ".join(sorted(t))) for i, t in texts.items()], "id long, text string")
    found = grading.similarity_candidates(df.filter("id % 3 = 0"), df.filter("id % 3 <> 0"))
    score = lambda a, b: len(texts[a] & texts[b]) / max(len(texts[a]), len(texts[b]))
    want = {(a, b): score(a, b) for a in texts for b in texts if a % 3 == 0 and b % 3 and score(a, b) >= 0.5}
    assert want and {(r["ref_id"], r["var_id"]): r["score"] for r in found.collect()} == pytest.approx(want)
    # Sets of few and of many tokens, empty and null texts; both sides from one table.
    r = random.Random(8)
    texts = {i: {r.choice("abcdefghijkl") * 3 + str(r.randrange(4)) for _ in range(r.choice([0, 1, 2, 5, 20, 40]))} for i in range(150)}
    df = spark.createDataFrame([(i, " ".join(sorted(t))) for i, t in texts.items()] + [(900, None), (901, "of no it")], "id long, text string")
    for least in (0.5, 0.8, 1.0):
        found = grading.similarity_candidates(df, df, least, ascending=True)
        want = {(a, b): score(a, b) for a in texts for b in texts if a < b and texts[a] and texts[b] and score(a, b) >= least}
        assert {(x["ref_id"], x["var_id"]): x["score"] for x in found.collect()} == pytest.approx(want)


def test_mode_ties_go_to_the_larger(spark):
    rows = spark.createDataFrame([("a", ["x"] * n) for n in (2, 2, 4, 4)] + [("b", ["x"] * n) for n in (2, 3, 4, 5)] + [("c", ["x"])], "run_id string, options array<string>")
    assert {r["run_id"]: r["mode"] for r in answers.modal_option_count(rows).collect()} == {"a": 4, "b": None, "c": None}


def test_overlays_are_idempotent(spark):
    rows = spark.createDataFrame([(1, "r", 1, "1", "q", ["a", "b"], "", "blank", "", ""), (2, "r", 2, "2", "q2", ["a", "b"], "5", "", "", "")], "doc_id long, run_id string, pos int, id string, question string, options array<string>, correct_index string, needs_review string, year string, image_url string")
    picks = spark.createDataFrame([(1, 1), (2, 9)], "doc_id long, pick int")
    once = review.resolved(rows, picks).drop("resolved")
    twice = review.resolved(once, picks).drop("resolved")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r["doc_id"]: (r["correct_index"], r["needs_review"]) for r in once.collect()} == {1: ("1", ""), 2: ("5", "")}


def test_names_probe_what_is_taken(spark):
    names = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a.pdf", "A.pdf", "a-2.pdf", "a.pdf"])], "batch int, seq long, file_name string")
    assert [r["name"] for r in review.bundle_names_exactly(names, "batch").orderBy("seq").collect()] == ["a", "A-2", "a-2-2", "a-3"]


def test_store_log(spark):
    log = spark.createDataFrame([("r", "1", 1, "x", False), ("r", "1", 2, "y", False), ("r", "2", 3, "z", False), ("r", "2", 4, "z", True)], "run_id string, row_id string, seq long, value string, deleted boolean")
    assert [(r["row_id"], r["value"]) for r in store.current(log, "run_id", "row_id").collect()] == [("1", "y")]
    own, backup = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    once = store.restored(own, backup, "id")
    assert sorted((r["id"], r["v"]) for r in store.restored(once, backup, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_topic_lines(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["  early", "Heart", "\tvalves", "", "  rhythm", "Lung"])], "file string, line int, text string")
    got = [(r["topic"], r["subtopic"]) for r in files.topic_list(lines).orderBy("line").collect()]
    assert got == [("early", ""), ("Heart", ""), ("Heart", "valves"), ("Heart", "rhythm"), ("Lung", "")]


def test_exam_lines_expect_the_next_number(spark):
    text = ["junk", "1. First?", "more", "A) x", "B) y", "7. not a question", "2. Second?", "A. z"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line int, text string")
    got = [(r["number"], r["question"], r["options"]) for r in files.exam_lines(lines).collect()]
    assert got == [(1, "First? more", ["x", "y 7. not a question"]), (2, "Second?", ["z"])]


def test_responses_and_csv(spark, tmp_path):
    r = spark.createDataFrame([(1, '```json\n{"a": 1}\n```'), (2, "{broken"), (3, "[]")], "id int, text string")
    assert {x["id"]: x["bad"] for x in files.parsed_responses(r).collect()} == {1: False, 2: True, 3: False}
    files.write_csv(spark.createDataFrame([('a "q", b', "")], "x string, y string").coalesce(1), str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part*")).read_bytes()
    assert part == b'x,y\r\n"a ""q"", b",\r\n'


def test_streams_agree_with_batches(spark, tmp_path):
    from examloom.streaming import telemetry as streams

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(hours=7 * i), "error" if i % 5 else "ok", i % 2, float(i), "m") for i in range(60)]
    schema = "seq long, t timestamp, event string, run_id long, ms double, model string"
    log = spark.createDataFrame(rows, schema)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert result(streams.daily_quota(stream), "quota", "complete") == sorted(map(tuple, telemetry.daily_quota(log).collect()))
    assert result(streams.failure_streaks(stream), "streaks", "append") == sorted(map(tuple, telemetry.failure_streaks(log).collect()))
    timings = telemetry.run_timings(log).select("run_id", "total_ms", "n")
    assert result(streams.run_timings(stream), "timings", "complete") == sorted(map(tuple, timings.collect()))
    assert timings.filter(F.col("n") == 0).count() == 0


def test_assembly(spark):
    from examloom.operators import assembly

    q = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, ref string, page int")
    boxes = spark.createDataFrame([("r", "a", (1.0, 2.0, 3.0, 4.0))], "run_id string, ref string, box struct<ymin double, xmin double, ymax double, xmax double>")
    evidence = spark.createDataFrame([("r", "b", "inline_marks")], "run_id string, ref string, evidence string")
    got = {r["ref"]: (tuple(r["box"]), r["evidence"]) for r in assembly.assembled(q, boxes, evidence).collect()}
    assert got == {"a": ((1.0, 2.0, 3.0, 4.0), "none"), "b": ((0.0, 0.0, 1000.0, 1000.0), "inline_marks")}
    answered = spark.createDataFrame([("r", "a", 9), ("r", "zz", 1)], "run_id string, ref string, page int")
    accepted, left = assembly.boxes_in(q, answered)
    assert [(r["ref"], r["page"]) for r in accepted.collect()] == [("a", 1)] and [r["ref"] for r in left.collect()] == ["b"]
    files_ = spark.createDataFrame([("x/exam/p1.png",), ("x/exam/deep/p2.png",), ("y/p.png",)], "path string")
    roots = spark.createDataFrame([("x/exam",), ("x/exam/deep",)], "root string")
    assert {r["path"]: r["root"] for r in assembly.grouped_files(files_, roots).collect()} == {"x/exam/p1.png": "x/exam", "x/exam/deep/p2.png": "x/exam/deep"}
    keys = spark.createDataFrame([("f", "k1", "a"), ("f", "k2", "zz"), ("g", "k3", "zz")], "folder string, file string, stem string")
    exams = spark.createDataFrame([("f", "e1", "a"), ("f", "e2", "b"), ("g", "e3", "c")], "folder string, file string, stem string")
    assert {r["key"]: r["exam"] for r in assembly.key_owners(keys, exams).collect()} == {"k1": "e1", "k2": None, "k3": "e3"}
    assets = spark.createDataFrame([("r", "p1", 1, 5, 5, ["1"]), ("r", "p2", 9, 5, 5, ["2"]), ("r", "p3", 1, 0, 5, []), ("r", "p4", 1, 5, 5, ["3"])], "run_id string, path string, page int, width int, height int, linked array<string>")
    pages = spark.createDataFrame([("r", 1)], "run_id string, page int")
    made = spark.createDataFrame([("r", "p1")], "run_id string, path string")
    assert {r["path"]: r["reason"] for r in assembly.crop_failures(assets, pages, made).collect()} == {"p2": "page_missing", "p3": "empty_box", "p4": "not_produced"}
    rows = spark.createDataFrame([("r", 0, "1", ""), ("r", 1, "9", "p3")], "run_id string, chunk int, id string, image_url string")
    assert sorted((r["chunk"], r["path"]) for r in assembly.chunk_assets(assets, rows).collect()) == [(0, "p1"), (1, "p3")]


def test_next_unresolved_in_one_pass(spark):
    """The next open row, from the start again behind the last; no frame is gone through anew for each row."""
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, True), ("c", 1, False)], "run_id string, pos int, open boolean")
    got = assembly.next_unresolved(rows, F.col("open"))
    assert {(r["run_id"], r["pos"]): r["next_open"] for r in got.collect()} == {("a", 1): 2, ("a", 2): 4, ("a", 3): 4, ("a", 4): 2, ("b", 1): None, ("c", 1): None}
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()


def test_pairs_are_counted_in_blocks(spark, monkeypatch):
    """Copies are compared as one text, nothing is written per token, and pairs of one or two tables are those of brute force."""
    from examloom.operators import grading

    r = random.Random(4)
    base = [[f"tok{r.randrange(400)}" for _ in range(r.choice([1, 3, 30, 90]))] for _ in range(40)]
    texts = {i: set(r.sample(b, max(1, len(b) * 9 // 10)) if i % 2 else b) for i, b in enumerate(r.choice(base) for _ in range(240))}
    df = spark.createDataFrame([(i, " ".join(sorted(t, key=lambda x: (hash(x) + i) % 7))) for i, t in texts.items()], "id long, text string")
    written = []
    monkeypatch.setattr(grading, "materialize", lambda d, write=grading.materialize: written.append(write(d)) or written[-1])
    alike = lambda a, b: len(texts[a] & texts[b]) / max(len(texts[a]), len(texts[b]))
    want = {(a, b): alike(a, b) for a in texts for b in texts if a < b and alike(a, b) >= 0.5}
    found = grading.similarity_candidates(df, df, ascending=True)
    assert {(x["ref_id"], x["var_id"]): x["score"] for x in found.collect()} == pytest.approx(want) and 1.0 in want.values()
    assert max(w.count() for w in written) <= len(texts) + len(want)
    found = grading.similarity_candidates(df.filter("id % 3 = 0"), df.filter("id % 3 > 0"))
    both = {(min(p), max(p)): s for p, s in ((((x["ref_id"], x["var_id"])), x["score"]) for x in found.collect())}
    assert both == pytest.approx({p: s for p, s in want.items() if (p[0] % 3 == 0) != (p[1] % 3 == 0)})


def test_blocks_meet_where_sizes_allow(spark, monkeypatch):
    """Sets of like size lie together, blocks that can't hold a pair don't meet, and sets of all sizes in many blocks have the pairs of brute force, of one and of two tables."""
    import numpy as np

    from examloom.operators import grading, overlaps

    sizes, counts = np.array([1, 2, 3, 9, 10, 30, 400, 401, 5000]), np.array([50, 9, 1, 400, 1, 90, 70, 70, 3])
    monkeypatch.setattr(overlaps, "LEAST_ELEMENTS", 1000)
    one = overlaps.Blocks.of(sizes, counts)
    n = np.repeat(sizes, counts)
    at = one.places(np.arange(len(n)), n)
    blocks = one.all()
    assert set(at.tolist()) <= set(range(len(blocks))) and all(blocks[b][0] <= k <= blocks[b][1] for b, k in zip(at.tolist(), n.tolist(), strict=True))
    meet = overlaps.cells([one], 0.5)
    assert {tuple(sorted((int(at[i]), int(at[j])))) for i in range(len(n)) for j in range(i) if n[j] >= n[i] / 2} <= set(meet) and len(meet) == len(set(meet))
    assert not [c for c in meet if blocks[c[1]][0] > 2 * blocks[c[0]][1]] and len(meet) < len(blocks) * (len(blocks) + 1) // 2
    # Beginnings are looked up for sets that can be partners alone.
    small, large = ((np.arange(k), np.full(k, m), np.tile(np.arange(m, dtype=np.int32), k)) for k, m in ((50, 40), (20, 90)))
    looked = []
    monkeypatch.setattr(overlaps, "spans", lambda *a, real=overlaps.spans: looked.append(1) or real(*a))
    assert not list(overlaps.met(small, large, 0.5, False)) and not looked
    monkeypatch.undo()
    monkeypatch.setattr(overlaps, "LEAST_ELEMENTS", 200)
    monkeypatch.setattr(overlaps, "PAIRS", 7)
    r = random.Random(11)
    pool = [f"w{k}x" for k in range(60)]
    texts = {i: set(r.sample(pool[: r.randrange(k, 61)], k)) for i, k in enumerate(r.choice([1, 2, 3, 5, 8]) if i < 60 else r.randrange(4, 50) if i < 120 else 8 for i in range(160))}
    df = spark.createDataFrame([(i, " ".join(sorted(t))) for i, t in texts.items()], "id long, text string").repartition(3)
    alike = lambda a, b: len(texts[a] & texts[b]) / max(len(texts[a]), len(texts[b]))
    for least in (0.5, 0.9):
        want = {(a, b): alike(a, b) for a in texts for b in texts if a < b and alike(a, b) >= least}
        assert {(x["ref_id"], x["var_id"]): x["score"] for x in grading.similarity_candidates(df, df, least, ascending=True).collect()} == pytest.approx(want) and want
    want = {(a, b): alike(a, b) for a in texts for b in texts if a % 3 == 0 and alike(a, b) >= 0.5}
    assert {(x["ref_id"], x["var_id"]): x["score"] for x in grading.similarity_candidates(df.filter("id % 3 = 0"), df).collect()} == pytest.approx(want)


def test_overlaps_of_sets_of_any_size():
    """Sets whose elements share buckets, of few and very many elements; every pair that can be alike is found."""
    import numpy as np

    from examloom.operators import overlaps

    r = np.random.default_rng(5)
    pool = np.sort(r.choice(5000, 900, replace=False))
    sets = [np.sort(r.choice(pool[: r.choice([4, 20, 900])], r.choice([1, 2, 15, 20]), replace=True)) for _ in range(120)] + [np.sort(r.choice(pool, 600)) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    one = overlaps.unpacked([overlaps.packed(np.arange(100), n[:100], np.concatenate(sets[:100])), overlaps.packed(np.arange(100, 150), n[100:], np.concatenate(sets[100:]))])
    assert (one[2] == np.concatenate(sets)).all() and (one[1] == n).all()
    for least in (0.5, 0.8):
        found = {(int(a), int(b)) for i, j in overlaps.met(one, one, least, True) for a, b in zip(i, j, strict=True)}
        count = lambda a, b: sum(min(np.sum(sets[a] == v), np.sum(sets[b] == v)) for v in np.intersect1d(sets[a], sets[b]))
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if count(a, b) >= least * max(n[a], n[b]) - 1e-9}
        assert want and want <= found
        assert {(int(a), int(b)) for i, j in overlaps.met(one, one, least, False) for a, b in zip(i, j, strict=True) if a < b} == found
