"""Operator 10, document fingerprints by winnowing, in DataFrame expressions only.

The hashes of all k-grams of words go through a window of ``WINDOW`` of them; each window keeps its least hash, the
rightmost of equal ones, with its position. Two texts that share ``WINDOW + K - 1`` words in a row share a
fingerprint of them, and shared runs below K words are never seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: A power of two: minima are doubled up.
WINDOW = 8
#: Rows of a block when texts meet their successors, unless that makes more than MOST_BLOCKS of them.
BLOCK_ROWS, MOST_BLOCKS = 512, 50_000
#: Ids are cut at so many quantiles at most, and between them evenly.
PLACES = 4096
_PLACES = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<bigint>: hash (32 bits) above the position counted down (31 bits), so that the least value has the least hash and among equals the rightmost place.

    Words are runs of characters other than white space. Fewer than ``k`` of them are one k-gram, none give an empty array;
    fewer k-grams than a window are one window.
    """
    words = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def grams(w: Column) -> Column:
        def packed(h: Column, i: Column) -> Column:
            return F.shiftleft(h.bitwiseAND(F.lit((1 << 32) - 1)), 31).bitwiseOR(F.lit(_PLACES) - i)

        few = F.array(packed(F.xxhash64(w), F.lit(0)))
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: packed(F.xxhash64(*(w[i + j] for j in range(k))), i))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, few).otherwise(many)

    def halved(step: int) -> Callable[[Column], Column]:
        return lambda g: F.transform(g, lambda x, i: F.least(x, F.get(g, i + step)))

    least, step = let(words, grams), 1
    while step < window:
        least = let(least, halved(step))
        step *= 2
    # The last windows are cut short by the end of the text; whole ones come first.
    whole = let(least, lambda m: F.slice(m, 1, F.greatest(F.least(F.size(m), F.lit(1)), F.size(m) - (window - 1))))
    return let(whole, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.coalesce(F.get(m, i - 1), F.lit(-1)))))


def hashes(prints: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(prints, lambda v: F.shiftright(v, 31)))


def shown(prints: Column) -> Column:
    """A fingerprint as text: hexadecimal hash and word position of each entry."""
    return F.array_join(F.transform(prints, lambda v: F.concat(F.hex(F.shiftright(v, 31)), F.lit(":"), (F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash sets, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def ranges(cuts: list[int], lo: int, hi: int, parts: int) -> list[tuple[int, float, int, bool]]:
    """(first id, width of a part, parts, whether rows are told apart by their hashes) of ranges that cover lo to hi, from ``cuts`` at even quantiles.

    An id at several cuts has as many times the rows of a range: it is a range of its own, with as many times the parts.
    """
    times: dict[int, int] = {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    hot = {c for c, n in times.items() if n > 1}
    firsts = sorted({lo, *times, *(c + 1 for c in hot if c < hi)})
    ends = [*firsts[1:], hi + 1]
    return [(a, max(1.0, (b - a) / parts), parts * times[a] if a in hot else parts, a in hot) for a, b in zip(firsts, ends, strict=True)]


def placed(rows: DataFrame) -> DataFrame:
    """Adds place and part to rows with doc_id and tie (a hash): by descending doc_id and tie, rows of one (place, part) follow one another, and
    pairs follow in descending order. A pair has about BLOCK_ROWS rows, or as many as MOST_BLOCKS pairs make it.

    Ids are cut at quantiles of all rows' ids, so it doesn't matter where they lie; quantiles are approximate, but the order is exact.
    """
    sizes = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    blocks = max(1, min(MOST_BLOCKS, sizes["n"] // BLOCK_ROWS))
    nulls = max(1, blocks * (sizes["n"] - sizes["ids"]) // max(1, sizes["n"]))
    level = lambda parts: F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts).cast("int"), parts - 1)
    if not sizes["ids"]:
        return rows.withColumn("place", F.lit(-1)).withColumn("part", level(F.lit(nulls)))
    many = min(PLACES, blocks)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many).alias("c")).first()["c"] if many > 1 else []
    found = ranges(list(cuts), sizes["lo"], sizes["hi"], -(-blocks // many))
    # The first ids in runs of 64: a row looks through the heads of the runs, and then through one run.
    firsts = [r[0] for r in found]
    runs = [firsts[i : i + 64] for i in range(0, len(firsts), 64)]
    constant = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    reached = lambda edges: F.size(F.filter(edges, lambda e: e <= F.col("doc_id")))
    run = reached(constant([r[0] for r in runs], "array<bigint>"))
    place = (run - 1) * 64 + reached(F.get(constant(runs, "array<array<bigint>>"), run - 1)) - 1
    table = F.broadcast(rows.sparkSession.createDataFrame([(i, float(f[0]), f[1], f[2], f[3]) for i, f in enumerate(found)] + [(-1, 0.0, 1.0, nulls, True)], "place int, first double, width double, parts int, tied boolean"))
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place)).join(table, "place")
    even = F.least(F.floor((F.col("doc_id").cast("double") - F.col("first")) / F.col("width")).cast("int"), F.col("parts") - 1)
    return rows.withColumn("part", F.when(F.col("tied"), level(F.col("parts"))).otherwise(even)).drop("first", "width", "parts", "tied")


def with_successors(rows: DataFrame, columns: list[str], tie: str = "text") -> DataFrame:
    """Adds ``following``, a struct of the next row's ``columns`` by descending doc_id; the first row follows the last.

    Null ids come last; rows with one id, or without, come in the order of a hash of ``tie``. Each block of rows also gets the
    first row of the next block, so that all successors are found within blocks.
    """
    rows = placed(rows.withColumn("tie", F.xxhash64(tie)))
    here = ["place", "part"]
    heads = rows.groupBy(*here).agg(F.max(F.struct("doc_id", "tie")).alias("head")).collect()
    # At most one row for each block.
    order = sorted(heads, key=lambda r: (-r["place"], -r["part"]))
    above = [(r["place"], r["part"], *r["head"], order[i - 1]["place"], order[i - 1]["part"]) for i, r in enumerate(order)]
    table = F.broadcast(rows.sparkSession.createDataFrame(above, "place int, part int, head long, head_tie long, above int, above_part int"))
    own, other = (F.struct(F.col(a).alias("place"), F.col(b).alias("part"), F.lit(g).alias("guest")) for a, b, g in (("place", "part", 0), ("above", "above_part", 1)))
    first = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    kept = [c for c in rows.columns if c not in here]
    seated = rows.join(table, here).select(*kept, F.explode(F.when(first, F.array(own, other)).otherwise(F.array(own))).alias("at")).select(*kept, "at.*")
    following = F.lead(F.struct(*columns)).over(Window.partitionBy(*here).orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()))
    return seated.withColumn("following", following).filter(F.col("guest") == 0).drop(*here, "guest", "tie")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike it is to the edited text's and the next document's.

    The edited text has its last third replaced by as much of the next document's start. Null texts count as empty and have an
    empty fingerprint; repeated rows, and several texts under one id, are treated each (the next of a row may be its own copy); an empty table gives an empty result; only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("prints", winnow(F.col("text")))
    out = with_successors(rows, ["text", "prints"]).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("following.text", F.lit(1), third))
    out = out.select("doc_id", "n_chars", "prints", F.col("following.prints").alias("next_prints"), edited.alias("edited"))
    out = out.withColumn("edited_prints", winnow(F.col("edited")))
    own = hashes(F.col("prints"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("prints")).alias("fingerprint"),
        shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_prints"))).alias("near_edited"),
        likeness(own, hashes(F.col("next_prints"))).alias("near_next"),
    )
