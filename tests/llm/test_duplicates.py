"""Operators 1, 4 and 10, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from examloom.llm import fingerprint, jaccard_join, suffix_dedup
from examloom.llm.components import components
from examloom.llm.quality import classify_quality
from examloom.llm.toxicity import classify_toxicity


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def near_copies():
    """A chain of texts that are each near the next but not to all, a large group of near copies, and passages that many share."""
    rows, base = [], words(1, 150).split(" ")
    for i in range(12):
        rows.append((100 + i, " ".join(base)))
        base[10 * i + 5] = f"edit{i}"
    group = words(2, 100).split(" ")
    for i in range(400):
        copy = list(group)
        copy[(7 * i) % 100] = f"w{i}"
        if i % 3 == 0:
            copy[(7 * i + 31) % 100] = f"v{i}"
        rows.append((1000 + i, " ".join(copy)))
    passage = words(3, 30)
    rows += [(5000 + i, words(50 + i, 60) + " " + passage) for i in range(150)]
    return [*rows, (9000, "a b c"), (9001, "A  b\tc"), (9002, ""), (9003, None), (9004, "a b c d e"), (9005, "a b c d e f")]


def test_jaccard_against_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    sets = brute_sets(rows)
    want = brute_components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    assert len({want[i] for i in range(100, 112)}) == 1


def test_many_classes_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_IDS", 0)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(brute_sets(rows))
    found = jaccard_join.jaccard_components(df)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    copies = found.filter("doc_id <> component_id")
    assert {r["doc_id"] for r in jaccard_join.without(df, copies).collect()} == {i for i, c in want.items() if i == c}


def test_odd_rows_in_the_join(spark, odd, none):
    got = jaccard_join.jaccard_components(odd).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == odd.count()
    assert by[1][1] == by[2][1] == by[3][1] == by[4][1] == 1 and by[12][1] == by[13][1] == 12
    assert by[7] == (0, 7) and by[8] == (0, 8) and by[9] == (0, 9) and by[10] == by[11] == (1, 10) and by[None][1] is None
    assert jaccard_join.jaccard_components(none).count() == 0


def test_several_texts_under_one_id(spark):
    """Half of each text of id 1 makes no text that is near to one of them; a near copy of the second is linked with it alone."""
    a, b = words(21, 60), words(22, 60)
    half = " ".join(a.split(" ")[:30] + b.split(" ")[:30])
    rows = [(1, a), (1, b), (1, b), (2, half), (3, b + " more"), (4, words(23, 60)), (4, words(23, 60) + " end"), (None, b)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["component_id"])
    assert len(got) == len(rows)
    assert by == {1: [1, 1, 1], 2: [2], 3: [1], 4: [4, 4], None: [None]}


def test_fragments_follow_the_order(spark):
    rows = [(g, n, 1, h) for n in range(40) for g, h in ((n << 57, 2), (-(n << 57), 2), (n, 5), (1000 + n, 9))]
    df = spark.createDataFrame(rows, "gram long, node long, n long, holders long")
    got = df.select("holders", "gram", jaccard_join.fragment_of(df).alias("f")).orderBy("holders", "gram").collect()
    assert [r["f"] for r in got] == sorted(r["f"] for r in got)
    assert {r["f"] for r in got} == {0, 1, 2, 3} and max(sum(r["f"] == f for r in got) for f in range(4)) <= 60


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (8, 7), (2, 10), (10, 11), (11, 2), *((20 + i, 21 + i) for i in range(40))]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 2: 2, 10: 2, 11: 2, **{20 + i: 20 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def cut(df):
    return {r["doc_id"]: (r["n_bytes"], sum(r["lengths"]), len(r["starts"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}


def test_repeats_against_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t in near_copies() if i < 5100] + [(6000, "x" * 999), (6001, "ab" * 400), (6002, words(77, 40) * 3), (6003, words(77, 40)), (6004, "é" * 120), (6005, "zé" * 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_repeats(rows)
    assert cut(df) == want
    # With hot anchors, which are merged in parts first.
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    assert cut(df) == want


def test_a_line_in_many_texts_is_spread(spark, monkeypatch):
    """A line of 60 bytes with other text around it: its windows are all different and must not meet under one route."""
    line = words(8, 30)[:60]
    rows = [(i, words(1000 + i, 20) + line + words(5000 + i, 20)) for i in range(300)]
    rows += [(400 + i, words(1000 + i, 20) + line + words(9000 + i, 20)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1 << 13)
    most = []
    real = type(df).repartition

    def seen(self, *a):
        if "route" in self.columns:
            most.append(self.filter("bytes is not null or windows = 0").groupBy(*a).agg(F.sum(F.greatest("windows", F.lit(1))).alias("n")).agg(F.max("n")).first()[0])
        return real(self, *a)

    monkeypatch.setattr(type(df), "repartition", seen)
    assert cut(df) == brute_repeats(rows)
    assert most and max(most) <= 5 * suffix_dedup.PLACES


def test_an_anchor_in_most_texts_is_spread(spark):
    """More texts with a line than make it hot in one task: no (hash, salt) meets many rows, and the result is that of brute force."""
    line = words(8, 30)[:95]
    rows = [(i, words(1000 + i, 6) + line + words(5000 + i, 6)) for i in range(1300)] + [(2000, words(1000, 6) + line + words(5000, 6)), (-5, words(1, 12) + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen = df.mapInArrow(suffix_dedup.anchor_rows, "hash long, doc_id long, times long, salt int")
    by = seen.groupBy("hash").agg(F.count("doc_id").alias("n"), F.count_if(F.expr("doc_id is null and salt = 0")).alias("sums"), F.sum(F.when(F.expr("salt = 0 and doc_id is null"), F.col("times"))).alias("t"), F.sum(F.when(F.expr("doc_id is not null"), F.col("times"))).alias("all"))
    assert by.filter("n > 500 and (sums <> 1 or t <> all)").count() == 0 < by.filter("n > 500").count()
    sizes = seen.groupBy("hash", "salt").count()
    assert sizes.agg(F.max("count")).first()[0] <= suffix_dedup.HOT and sizes.filter("salt > 0").agg(F.max("count")).first()[0] <= 10
    assert cut(df) == cut(df.repartition(3)) == brute_repeats(rows)


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kind in ("long", "int"):
            df = spark.range(5).selectExpr(f"cast(id as {kind}) doc_id", "'x' text", "'y' source")
            for carry in (False, True):
                plan = suffix_dedup.remove_repeats(df, carry=carry)._jdf.queryExecution().executedPlan().toString()
                assert "ReusedExchange" in plan, (kind, carry)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_odd_rows_in_the_dedup(spark, odd, none):
    got = suffix_dedup.remove_repeats(odd, carry=True).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    want = brute_repeats([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (None, 18)])
    for i, w in want.items():
        assert (by[i]["n_bytes"], sum(by[i]["lengths"]), len(by[i]["starts"])) == w[:3], i
    assert [sum(r["lengths"]) for r in got if r["doc_id"] == 18] == [0, 0]
    assert by[None]["lengths"] == [] and by[1]["carried"]["windows"] == "?"
    assert suffix_dedup.remove_repeats(none).count() == 0


@settings(max_examples=120, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 3), min_size=1, max_size=8), st.lists(st.integers(1, 3), min_size=1, max_size=400)), st.integers(1, 4))
def test_suffix_array_and_common_prefixes(values, times):
    x = np.array(values * times, np.int16)
    sa, new = suffix_dedup.suffix_array(x)
    lcp = suffix_dedup.common_prefixes(x, sa, new, lanes=5)
    keys = [tuple(x[i : i + 100]) for i in sa]
    assert sorted(sa.tolist()) == list(range(len(x)))
    for k in range(1, len(x)):
        assert keys[k - 1] <= keys[k]
        n = 0
        while n < min(len(keys[k - 1]), len(keys[k])) and keys[k - 1][n] == keys[k][n]:
            n += 1
        assert lcp[k] == n


def test_prefixes_counted_from_where_the_sort_left_them():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 4, n) for n in (30, 70, 99, 100, 101, 127, 128, 300)]
    x = np.concatenate([pieces[i] for i in rng.integers(0, len(pieces), 60)]).astype(np.int16)
    shared = np.zeros(len(x), np.int16)
    sa, new = suffix_dedup.suffix_array(x, shared=shared)
    whole, some = suffix_dedup.common_prefixes(x, sa, new, lanes=5), suffix_dedup.common_prefixes(x, sa, new, lanes=7, shared=shared)
    assert np.array_equal(whole >= 100, some >= 100) and np.all(some <= whole)
    assert np.all((shared <= whole) & ((whole < 2 * shared) | (whole < 7) | ~new)) and np.any((whole >= 100) & new)


def test_copies_of_a_slice_are_sorted_once(monkeypatch):
    """400 copies of one slice and parts of it: a copy's windows are told by those of the slice that is sorted."""
    text = words(5, 60).encode()
    rows = [(7, i, 3 * i, 40, text[:139]) for i in range(400, 0, -1)] + [(7, 900, 5, 20, text[10:129]), (7, 900, 5, 20, text[10:129]), (7, -3, 8, 25, text[30:154]), (9, 1, 0, 40, text[:139][::-1])]
    random.Random(1).shuffle(rows)
    table = pa.Table.from_pylist([dict(zip(suffix_dedup.SLICE.names, r, strict=True)) for r in rows], schema=suffix_dedup.SLICE)
    sizes = []
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sizes.append(len(a)) or real(a, *args, **kw))
    got = suffix_dedup.merge_slices(table).to_pylist()
    assert sizes and max(sizes) <= 40 + 20 + 25 + 40
    windows = sorted((r, i, s + k, b[k : k + 100]) for r, i, s, n, b in rows for k in range(n))
    earliest = {}
    for _, i, s, b in sorted(windows, key=lambda w: w[1:3]):
        earliest.setdefault(b, (i, s))
    assert {(g["doc_id"], g["start"] + k) for g in got for k in range(g["windows"])} == {(i, s) for _, i, s, b in windows if earliest[b] != (i, s)}


def brute_winnow(grams, window=fingerprint.WINDOW):
    """Places that windows choose, the rightmost of equal ones."""
    out = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[i : i + window]
        low = min(part)
        place = i + max(j for j, g in enumerate(part) if g == low)
        if not out or out[-1] != (low, place):
            out.append((low, place))
    return out


def test_fingerprints_against_brute_force(spark, odd):
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    hashed = odd.filter("doc_id is not null").select("doc_id", fingerprint.winnow(F.col("text")).alias("p"), F.transform(w, lambda x: F.xxhash64(x)).alias("w"))
    grams = F.when(F.size("w") == 0, F.array().cast("array<long>")).when(F.size("w") < 5, F.array(F.xxhash64("w"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get(F.col("w"), i + j) for j in range(5)))))
    for r in hashed.withColumn("g", grams).collect():
        got = [(v >> 31, (1 << 31) - 1 - (v & ((1 << 31) - 1))) for v in r["p"]]
        assert got == brute_winnow([g & 0xFFFFFFFF for g in r["g"]]), r["doc_id"]


def test_fingerprint_documents(spark, odd, none, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 3)
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(t) // 3
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest(), i
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        of = {k: set(re.findall(r"([0-9A-F]+):", rows[i][k])) for k in ("fingerprint", "edited_fingerprint")}
        then = set(re.findall(r"([0-9A-F]+):", rows[order[(k + 1) % len(order)]]["fingerprint"]))
        for name, other in (("near_edited", of["edited_fingerprint"]), ("near_next", then)):
            both, either = of["fingerprint"] & other, of["fingerprint"] | other
            assert rows[i][name] == pytest.approx(len(both) / len(either) if either else 1.0), (i, name)
    whole = {r["text"]: r["p"] for r in spark.createDataFrame([((t[: len(t) - len(t) // 3] + texts[order[(k + 1) % len(order)]][: len(t) // 3]),) for k, (i, t) in enumerate((i, texts[i]) for i in order)], "text string").select("text", fingerprint.shown(fingerprint.winnow(F.col("text"))).alias("p")).collect()}
    for k, i in enumerate(order):
        t = texts[i]
        assert rows[i]["edited_fingerprint"] == whole[t[: len(t) - len(t) // 3] + texts[order[(k + 1) % len(order)]][: len(t) // 3]]
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != "" and rows[2]["near_next"] == 1 and rows[8]["fingerprint"] == ""
    assert fingerprint.fingerprint_documents(odd).count() == odd.count()
    assert fingerprint.fingerprint_documents(none).count() == 0


def test_successors_wherever_ids_lie(spark, monkeypatch):
    """Outlying ids, one id with a third of the rows, and many rows without one: blocks stay small and no successor is lost."""
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 10)
    ids = [*range(200), 1 << 60, -(1 << 62), (1 << 62) + 5, *[77] * 150, *[None] * 100]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    most = fingerprint.placed(df.withColumn("tie", F.xxhash64("text"))).groupBy("place", "part").count().agg(F.max("count")).first()[0]
    assert most <= 40
    got = fingerprint.with_successors(df, ["text"]).select("doc_id", "text", "following.text").collect()
    assert len(got) == len(rows)
    after = {r[1]: r[2] for r in got}
    of = {t: i for i, t in rows}
    seen, at = [], rows[200][1]
    for _ in rows:
        seen.append(at)
        at = after[at]
    assert len(set(seen)) == len(rows)
    start = seen.index(f"text {ids.index((1 << 62) + 5)}")
    order = [of[t] for t in seen[start:] + seen[:start]]
    assert order == sorted((i for i in ids if i is not None), reverse=True) + [None] * 100


def test_pipeline(spark, odd, none, labels, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.materialize(stage(spark, docs, sf))
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
        if name in ("quality", "toxicity"):
            judge, keep = (classify_quality, "score >= 0.3") if name == "quality" else (classify_toxicity, "score < 0.5")
            want = judge(before, spark.read.parquet(f"{sf}/labels.parquet")).filter(keep)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in want.collect()), name
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in brute_components(brute_sets(rows)).items() if i == c}
        if name == "repeated_passages":
            want = brute_repeats([(r["doc_id"], r["text"]) for r in before.collect()])
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
            assert sum(len(r["text"].encode()) for r in docs.collect()) == pytest.approx(sum(w[0] - w[1] for w in want.values()), abs=20)
    assert p.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()
    assert p.run(spark, sf).count() >= docs.count()
    for name, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        # A stage may reject all of so few rows, but not fail on them.
        assert stage(spark, odd, sf).count() >= (0 if name in ("quality", "toxicity") else 1), name
