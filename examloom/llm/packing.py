"""Operator 5, packing: shortest pack first over the histogram of lengths.

Documents become pieces of at most ``CAPACITY`` tokens. Only the number of pieces of each length goes to the driver.
There, lengths are placed from the longest down, each time into the packs with the most room left; packs with
the same contents are one pattern with a count, so the work depends on the capacity, not on the data.
Finished patterns come back as a table of slots, and the pieces join it by their length and their rank among the
pieces of that length.
"""

from __future__ import annotations

import heapq
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.bpe import byte_symbols
from examloom.llm.pretokens import Encoder, dropping_spaces, strings
from examloom.storage import materialize

CAPACITY = 4096
#: Id behind each document's tokens.
END = 2
#: Pieces of one length are ranked in parts of about so many.
PART_ROWS = 100_000
PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))
SLOT = "length int, first_rank long, packs long, first_sequence long, offset long"


class WordCodec:
    """Ids of lower-casing, white-space dropping vocabularies: their library encodes each distinct word once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.last = self._last_tokens()
        self.encoder = Encoder(dropping_spaces, self._words)

    def _last_tokens(self) -> np.ndarray | None:
        """For each id, whether it ends a word; None where a vocabulary doesn't say so for all words."""
        suffix, vocab = getattr(self.library.model, "end_of_word_suffix", None), self.library.get_vocab(with_added_tokens=False)
        if not suffix or not all(c + suffix in vocab for c in byte_symbols()):
            return None
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return last

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        done = [self._some(words[lo : lo + 4096]) for lo in range(0, max(1, len(words)), 4096)]
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def _some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # As one text with spaces between the words, which fall out: a call for each word takes about twice as long.
        if self.last is not None:
            ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        # A word that the library takes apart. Its results are objects of some hundred bytes a word.
        each = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(counts.sum())), counts

    @staticmethod
    def normal(text: str) -> str:
        # One lower-case form for each capital: a final sigma is not treated apart, as str.lower() alone would.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # A text that spells out a special token goes to the library whole.
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        out = list(self.encoder.all(["" if i in set(odd) else self.normal(t) for i, t in enumerate(texts)]))
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


@cache
def word_codec(path: str) -> WordCodec:
    """One per Python worker and file."""
    return WordCodec(path)


def token_pieces(text: Column, path: str, capacity: int = CAPACITY) -> Column:
    """array<struct<start, doc_tokens, ids>>: a text's ids and END, cut every ``capacity`` ids; ids are little-endian unsigned 32-bit."""

    def part(texts: list[str]) -> pa.Array:
        starts, totals, parts, offsets = [], [], [], [0]
        for ids in word_codec(path).encode(texts):
            ids = np.append(ids, END).astype("<u4")
            for lo in range(0, len(ids), capacity):
                starts.append(lo)
                totals.append(len(ids))
                parts.append(ids[lo : lo + capacity].tobytes())
            offsets.append(len(starts))
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(parts, pa.binary())], names=["start", "doc_tokens", "ids"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    @F.arrow_udf(PIECES)
    def cut(column: pa.Array) -> pa.Array:
        done = [part(texts) for texts in strings(column)]
        return pa.concat_arrays(done) if done else part([])

    return cut(text)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, doc_tokens, ids of every piece; null and empty texts are the one id END."""
    return in_small_batches(docs).select("doc_id", F.explode(token_pieces(F.col("text"), path)).alias("piece")).select("doc_id", "piece.*")


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs that hold the histogram's pieces, by shortest pack first.

    Each step uses up a length or a group of equal packs and adds at most one group, so there are never more groups than lengths.
    """
    done: list[tuple[int, tuple[int, ...]]] = []
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []

    def add(count: int, pack: tuple[int, ...], left: int) -> None:
        if left == 0:
            done.append((count, pack))
            return
        if left not in room:
            room[left] = []
            heapq.heappush(order, -left)
        room[left].append((count, pack))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            if order and -order[0] >= length:
                left = -order[0]
                count, pack = room[left].pop()
                if not room[left]:
                    del room[left]
                    heapq.heappop(order)
                n = min(todo, count)
                if n < count:
                    add(count - n, pack, left)
                add(n, (*pack, length), left - length)
            else:
                # As many new packs as these pieces need among themselves.
                each = capacity // length
                n, rest = divmod(todo, each)
                if n:
                    add(n, (length,) * each, capacity - each * length)
                if rest:
                    add(1, (length,) * rest, capacity - rest * length)
                n = todo
            todo -= n
    return done + [x for left in sorted(room) for x in room[left]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of a length go, by rank: rows of SLOT. A slot holds ``packs`` pieces, one in each of as many sequences."""
    out, used, sequence = [], {}, 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, count, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, and any other columns); each has at most ``capacity`` tokens.

    Equal rows are placed each. An empty table gives an empty one. Pieces of one length are ranked in parts of about PART_ROWS, so that a length that
    many pieces have is not one task; a piece looks for its slot among those of a bucket of ranks, of which there are about two.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = slots(patterns(histogram, capacity))
    wide: dict[int, int] = {}
    for length, *_ in placed:
        wide[length] = wide.get(length, 0) + 1
    # A bucket is as wide as a slot of the length is on average.
    wide = {n: max(1, histogram[n] // k) for n, k in wide.items()}
    table = spark.createDataFrame([(b, *x) for x in placed for b in range(x[1] // wide[x[0]], (x[1] + x[2] - 1) // wide[x[0]] + 1)], f"bucket long, {SLOT}")
    # At most ``capacity`` rows.
    plan = F.broadcast(spark.createDataFrame([(n, -(-k // PART_ROWS), wide.get(n, 1)) for n, k in histogram.items()], "length int, parts int, wide long"))
    parted = pieces.join(plan, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int"))
    ranked = parted.withColumn("rank_in_part", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start")) - 1)
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = ranked.join(sizes, ["length", "part"]).withColumn("rank", F.col("rank_in_part") + F.col("before")).withColumn("bucket", F.expr("rank div wide"))
    r, s = ranked.alias("r"), F.broadcast(table).alias("s")
    here = (F.col("r.length") == F.col("s.length")) & (F.col("r.bucket") == F.col("s.bucket")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("packs"))
    return r.join(s, here).select(*(f"r.{c}" for c in pieces.columns), (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("s.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, *digests: Column) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id and offset of every piece, and ``digests`` of its ids.

    Pieces are written once, without their ids unless ``digests`` asks for them. Null and empty texts are one piece of the one id END; repeated rows,
    and texts under one id, are placed each; an empty table gives an empty result; only doc_id and text are read.
    """
    cut = tokenize(docs, path).withColumn("length", F.expr("cast(length(ids) div 4 as int)"))
    return pack(materialize(cut.select("doc_id", "start", "length", "doc_tokens", *digests)))
