"""Operator 4, n-gram Jaccard join by vertical partitioning.

A document is its set of word 5-grams, as 64-bit hashes. Documents whose sets agree in size and in 128 bits of hashes are one class; classes have numbers
of their own, and are joined:

1. *First fragment.* Of each set, the least quarter of the hashes is dealt out by hash. A partner at the threshold shares
   all but a fifth of a set, so a class that shares too few of this fragment with any other has no partner at all.
2. *Postings.* What is left is dealt out in full; 5-grams of one class only can't overlap and fall out. The others have
   an order, rarest first, and partners share one of each set's first 5-grams in it (its prefix).
3. *Blocks.* Classes lie in blocks of about BLOCK. The order, rarest first, is cut into fragments of about as many postings each; for
   two blocks, each fragment gives a matrix of partial overlaps on its own, and the matrices are summed per pair of blocks and
   held against the threshold. Only a spanning forest of the links found leaves a pair of blocks.
4. *Two rounds.* The first joins classes with the commonest holder of their prefixes. The second has what is left: all pairs
   of blocks that share a prefix 5-gram between different components. So no pair that could link two components is left out,
   and the many links within a group of near copies need not be found.

A 5-gram of many sets is counted by partial sums and joined, never gathered under a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.components import components
from examloom.llm.text_arrays import LOWER, MIX_A, MIX_B, byte_values, flat, groups, mixed, span_hashes, words
from examloom.storage import materialize

K = 5
#: Threshold in hundredths.
ALIKE = 80
BLOCK = 256
FRAGMENTS = 4
TEXT_BYTES = 1 << 20
#: So many ids or classes or fewer (8 or 40 bytes each) are broadcast to the texts; more are joined by a shuffle.
FEW_IDS = 500_000

SETS = "doc_id long, n long, key_a long, key_b long, grams array<long>"
POSTED = "gram long, node long, n long"


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every row's distinct word k-grams, in order of row and hash; A-Z count as a-z. Fewer words than k are one gram."""
    s, e, row = words(data, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = span_hashes(byte_values(LOWER[data]), s, e)
    n = len(w)
    at = np.arange(n)
    first = np.searchsorted(row, row, "left")
    count = np.searchsorted(row, row, "right") - first
    size = np.minimum(count, k)
    starts = np.flatnonzero(at - first + size <= count)
    h = np.zeros(len(starts), np.uint64)
    for j in range(k):
        inside = j < size[starts]
        h = np.where(inside, mixed(h * MIX_A + w[np.minimum(starts + j, n - 1)]), h)
    h = mixed(h + size[starts].astype(np.uint64) * MIX_B)
    order = np.lexsort((h, row[starts]))
    r, h = row[starts][order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def fragment_size(n: np.ndarray) -> np.ndarray:
    """How many of n grams the first fragment has: those that may be missing, one more, and a twentieth."""
    return np.minimum(n, n - -(-n * ALIKE // 100) + 1 + n // 20)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, set sizes, row of each gram, grams) of a few texts at a time: what leaves a task leaves it in small pieces."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for lo, hi in groups(offsets, TEXT_BYTES):
            r, h = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield batch.column("doc_id").slice(lo, hi - lo), np.bincount(r, minlength=hi - lo), r, h


def set_keys(n: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """128 bits that stand for each set; ``h``: the grams of sets of ``n``, one after the other."""
    cuts = np.append(0, np.cumsum(n))
    sums = [np.append(np.uint64(0), np.cumsum(x)) for x in (h, mixed(h ^ MIX_B))]
    return [mixed(x[cuts[1:]] - x[cuts[:-1]]).view(np.int64) for x in sums]


def first_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SETS of (doc_id, text): a set's size, 128 bits that stand for it, and its first fragment."""
    for ids, n, r, h in _blocks(batches):
        cuts = np.append(0, np.cumsum(n))
        keys = map(pa.array, set_keys(n, h))
        sizes = fragment_size(n)
        first = pa.array(h[np.arange(len(h)) - cuts[r] < sizes[r]].view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), first)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *keys, lists], names=["doc_id", "n", "key_a", "key_b", "grams"])


def class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTED of (doc_id, text, node, n, key_a, key_b): a row for each gram of each text that is of its row's class; a text of another class under the same id has none."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        node, *own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "key_a", "key_b"))
        for lo, hi in groups(offsets, TEXT_BYTES):
            r, h = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = np.bincount(r, minlength=hi - lo)
            same = np.logical_and.reduce([x == y[lo:hi] for x, y in zip((n, *set_keys(n, h)), own, strict=True)])
            keep = same[r]
            r, h = r[keep], h[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[lo:hi][r]), pa.array(n[r].astype(np.int64))], names=["gram", "node", "n"])


def missing_at_most(n: Column) -> Column:
    """How many grams of a set of n a partner may lack."""
    return n - F.ceil(n * ALIKE / 100)


def shared_grams(spread: DataFrame) -> DataFrame:
    """(gram, holders) of the grams that several rows hold: partial sums leave a task, not a common gram's rows."""
    return spread.groupBy("gram").agg(F.count("*").alias("holders")).filter("holders > 1")


def survivors(sets: DataFrame) -> DataFrame:
    """doc_id, n and keys of the sets whose first fragment shares enough grams with other rows; copies of one set count as others here."""
    keys = ["doc_id", "n", "key_a", "key_b"]
    spread = sets.select(*keys, F.explode("grams").alias("gram"))
    fragment = F.least(F.col("n"), missing_at_most(F.col("n")) + 1 + F.floor(F.col("n") / 20))
    hits = spread.join(shared_grams(spread), "gram").groupBy(*keys).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") >= fragment - missing_at_most(F.col("n"))).select(*keys)


def postings(docs: DataFrame, able: DataFrame) -> DataFrame:
    """(gram, node, n, holders): the grams of the classes ``able`` (node, doc_id, n, key_a, key_b) that several of them hold.

    Each class is read from one document. Of several texts under one id, those count whose sets are in ``able``.
    """
    able = able.select("doc_id", "node", "n", "key_a", "key_b")
    classes = able.count()
    mine = docs.select("doc_id", "text").join(F.broadcast(able) if classes <= FEW_IDS else able, "doc_id")
    held = mine.mapInArrow(class_sets, POSTED)
    if mine.select("doc_id").count() != classes:
        # Repeated rows of a document are one holder.
        held = held.distinct()
    return held.join(shared_grams(held), "gram").select("gram", "node", "n", "holders")


def prefixes(posted: DataFrame) -> DataFrame:
    """(gram, node): each set's first grams in the order of (holders, gram); those of one holder come before all posted ones."""
    order = Window.partitionBy("node").orderBy("holders", "gram")
    ranked = posted.withColumn("place", F.row_number().over(order)).withColumn("posted", F.count("*").over(Window.partitionBy("node")))
    alone = F.col("n") - F.col("posted")
    return ranked.filter(alone + F.col("place") <= missing_at_most(F.col("n")) + 1).select("gram", "node")


def fragment_of(posted: DataFrame) -> Column:
    """The fragment of a posting: the order (holders, gram) is cut where about a FRAGMENTS-th of all postings lies behind each cut.

    Grams are even in the range of 64-bit numbers, so a share of those with one number of holders is a share of that range. Three numbers of
    holders and their counts go to the driver.
    """
    shares = [f / FRAGMENTS for f in range(1, FRAGMENTS)]
    at = posted.agg(F.percentile_approx("holders", shares).alias("at")).first()["at"] or []
    if not at:
        return F.lit(0)
    counts = posted.agg(F.count("*").alias("n"), *(F.struct(F.count_if(F.col("holders") < h).alias("below"), F.count_if(F.col("holders") == h).alias("here")).alias(f"c{i}") for i, h in enumerate(at))).first()
    out = F.lit(0)
    for i, (h, share) in enumerate(zip(at, shares, strict=True)):
        part = min(1.0, max(0.0, (share * counts["n"] - counts[f"c{i}"]["below"]) / max(1, counts[f"c{i}"]["here"])))
        cut = min((1 << 63) - 1, int(part * (1 << 64)) - (1 << 63))
        out = out + ((F.col("holders") > h) | ((F.col("holders") == h) & (F.col("gram") >= cut))).cast("int")
    return out


def packed(members: DataFrame, posted: DataFrame, order: Column) -> DataFrame:
    """(block, fragment, sets) from (node, block): what each block's sets hold of each fragment ``order``, as array<struct<node, n, grams>>."""
    held = posted.join(members, "node").groupBy("block", "node", "n").agg(*(F.collect_list(F.when(order == f, F.col("gram"))).alias(f"g{f}") for f in range(FRAGMENTS)))
    fragments = F.explode(F.array(*(F.struct(F.lit(f).alias("fragment"), F.col(f"g{f}").alias("grams")) for f in range(FRAGMENTS))))
    rows = held.select("block", "node", "n", fragments.alias("f")).select("block", "f.fragment", F.struct("node", "n", "f.grams").alias("set"))
    # About BLOCK sets each.
    return rows.groupBy("block", "fragment").agg(F.array_sort(F.collect_list("set")).alias("sets"))


def _incidence(sets: list, universe: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(universe)), np.float32)
    for i, grams in enumerate(sets):
        m[i, np.searchsorted(universe, grams)] = 1
    return m


def overlaps(left: Column, right: Column) -> Column:
    """Partial overlaps of two blocks' sets in one fragment: int32 matrix, row by row."""

    @F.arrow_udf(T.BinaryType())
    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = ([np.asarray(s["grams"].values, np.int64) for s in side] for side in (x, y))
            u = np.intersect1d(np.concatenate(x), np.concatenate(y))
            x, y = ([g[np.isin(g, u, assume_unique=True)] for g in side] for side in (x, y))
            m = np.zeros((len(x), len(y)), np.float32)
            for lo in range(0, len(u), 8192):
                part = u[lo : lo + 8192]
                mx, my = (_incidence([g[(g >= part[0]) & (g <= part[-1])] for g in side], part) for side in (x, y))
                m += mx @ my.T
            out.append(m.astype(np.int32).tobytes())
        return pa.array(out, pa.binary())

    return counted(left, right)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the bipartite (or, for a block with itself, plain) graph."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = int(left[i]), int(right[j])
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def links_between(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): links of pairs of blocks (i, j), a spanning forest for each pair."""
    x, y = blocks.select(F.col("block").alias("i"), "fragment", F.col("sets").alias("left")), blocks.select(F.col("block").alias("j"), "fragment", F.col("sets").alias("right"))
    met = pairs.join(x, "i").join(y, ["j", "fragment"])
    slim = lambda side: F.transform(side, lambda s: F.struct(s["node"].alias("node"), s["n"].alias("n")))
    partial = met.select("i", "j", slim("left").alias("left"), slim("right").alias("right"), overlaps(F.col("left"), F.col("right")).alias("partial"))

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        a, b = ([np.array([s[k] for s in group[side].iloc[0]], np.int64) for k in ("node", "n")] for side in ("left", "right"))
        total = sum(np.frombuffer(p, np.int32).astype(np.int64) for p in group["partial"]).reshape(len(a[0]), len(b[0]))
        alike = 100 * total >= ALIKE * (a[1][:, None] + b[1][None, :] - total)
        alike &= a[0][:, None] != b[0][None, :]
        return pd.DataFrame(_forest(alike, a[0], b[0]), columns=["a", "b"], dtype="int64")

    return partial.groupBy("i", "j").applyInPandas(summed, "a long, b long")


def chunks(members: DataFrame, key: str, together: str) -> DataFrame:
    """(node, block) from (node, ``key``, ``together``): the nodes of a key are dealt to as many blocks as make about BLOCK each, by a hash of ``together``."""
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    run = F.pmod(F.xxhash64(together), F.col("parts"))
    return members.join(sizes, key).select("node", F.concat_ws("/", F.col(key).cast("string"), run.cast("string")).alias("block"))


def class_links(posted: DataFrame) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    heads = materialize(prefixes(posted))
    order = fragment_of(posted)
    # A block's key is the holder that most of a set's prefix grams name; holders are the least nodes.
    named = heads.join(heads.groupBy("gram").agg(F.min("node").alias("holder")), "gram")
    votes = named.groupBy("node", "holder").agg(F.count("*").alias("votes"))
    key = materialize(votes.groupBy("node").agg(F.max_by("holder", F.struct("votes", -F.col("holder").cast("double"))).alias("key")))
    first = materialize(chunks(key, "key", "node"))
    blocks = materialize(packed(first, posted, order))
    names = first.select(F.col("block").alias("j")).distinct()
    start = F.concat(F.substring_index("j", "/", 1), F.lit("/0"))
    pairs = names.select(F.explode(F.array_distinct(F.array("j", start))).alias("i"), "j")
    found = materialize(links_between(pairs, blocks))
    so_far = components(found)
    # Second round: blocks of one component where it fills them, mixed ones for the rest.
    placed = key.join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed)
    large = placed.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= BLOCK)
    placed = placed.join(large, "component", "left")
    own = F.when(F.col("size").isNotNull(), F.concat(F.lit("c"), F.col("component"))).otherwise(F.concat(F.lit("k"), F.col("key")))
    # A small component stays in one block.
    placed = placed.select("node", "component", own.alias("key"), F.when(F.col("size").isNotNull(), F.col("node")).otherwise(F.col("component")).alias("together"))
    placed = materialize(placed.join(chunks(placed, "key", "together"), "node"))
    # Blocks meet under a gram, whatever number of their sets hold it, if there are two components among them.
    seen = heads.join(placed, "node").groupBy("gram", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_grams = seen.groupBy("gram").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least <> most").select("gram")
    seen = materialize(seen.join(open_grams, "gram"))
    a, b = seen.alias("a"), seen.alias("b")
    mixed_pair = F.least("a.lo", "b.lo") < F.greatest("a.hi", "b.hi")
    open_pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.block") <= F.col("b.block")) & mixed_pair)
    open_pairs = open_pairs.select(F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()
    open_pairs = materialize(open_pairs)
    needed = open_pairs.select(F.explode(F.array("i", "j")).alias("block")).distinct()
    again = materialize(packed(placed.select("node", "block").join(needed, "block", "left_semi"), posted, order))
    return components(found.unionByName(materialize(links_between(open_pairs, again))))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows with one of ``ids`` (doc_id): few are broadcast to the texts, more are joined by a shuffle."""
    ids = materialize(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    Null and empty texts, and those of white space only, have no shingles and are linked with nothing. Rows that repeat a
    doc_id count each: equal texts are one class, and different texts under one id are sets of their own, each with the component of
    its own set. An empty table gives an empty result; only doc_id and text are read, and rows without a doc_id have no component.
    """
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(docs.mapInArrow(first_fragments, SETS))
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    keys = ["n", "key_a", "key_b"]
    classes = materialize(sets.filter(able).groupBy(*keys).agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))
    likely = survivors(sets.filter(able)).select(*keys).distinct()
    posted = materialize(postings(docs, materialize(classes.join(likely, keys))))
    linked = class_links(posted).join(classes, "node").select("component", *keys, "doc_id")
    linked = materialize(linked)
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    classes = classes.join(linked.join(least, "component").select(*keys, "least"), keys, "left").select(*keys, F.coalesce("least", "doc_id").alias("component_id"))
    named = sets.filter(able).select("doc_id", *keys).join(classes, keys).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # Rows without an id or a shingle stay out of the join, where they would all meet in one task.
    return named.unionByName(sets.filter(~able).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
