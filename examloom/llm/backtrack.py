"""Operator 13, byte-level BPE from a file of ranks, encoded by backtracking over longest matches.

The bytes of a pre-token are mapped to Latin-1, one character each, and an Aho-Corasick automaton of all tokens names the longest
token that starts at each byte. The encoder goes from left to right and takes the longest token that its left neighbour
tolerates, else the next shorter one; where none is left it gives the neighbour up and marks the place as a dead end, so that
no place is tried twice. Two tokens tolerate each other if merging their joined bytes gives just these two; the answer
is kept for each pair. A row of tokens all of whose neighbours tolerate each other is what merging the whole
pre-token by ranks gives, and there is only one.
"""

from __future__ import annotations

import base64
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.llm.batches import in_small_batches
from examloom.llm.pretokens import Encoder, keeping_spaces, strings

#: A task forgets what it knows about pairs when it knows so many.
MOST_PAIRS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(raw: bytes, ranks: dict[bytes, int], fewest: int = 1) -> list[bytes]:
    """The parts that are left when the adjacent pair of lowest rank is merged, the leftmost of equals, until none has a rank or ``fewest`` are left."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > fewest:
        found = [(rank, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (rank := ranks.get(pair[0] + pair[1])) is not None]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Codec:
    """Encodes and decodes texts as a file of ranks says, without special tokens."""

    def __init__(self, path: str):
        self.prepare(read_ranks(path))

    def prepare(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no rank for bytes {missing}")
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        # The two parts of a token's last merge. A token that merging never makes can only be a whole pre-token.
        halves = {b: merged(b, self.ranks, 2) for b in self.ranks if len(b) > 1}
        halves = {b: h for b, h in halves.items() if len(h) == 2}
        made = {b: i for b, i in self.ranks.items() if len(b) == 1 or b in halves}
        self.left_part, self.right_part = ({self.ranks[b]: self.ranks[h[k]] for b, h in halves.items()} for k in (0, 1))
        self.automaton = ahocorasick.Automaton()
        for b, i in made.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix of a token.
        self.shorter = {i: next((made[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in made), None) for b, i in made.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sizes = {i: len(b) for b, i in self.ranks.items()}
        self.encoder = Encoder(keeping_spaces, self.encode_words)
        self.pieces = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], object)

    def tolerated(self, left: int, right: int) -> bool:
        """Whether nothing merges across the seam of two tokens: merges are undone from the last one back, and at each moment the two pieces at
        the seam must have no rank that comes before the merge in which one of them goes up. Of equal ranks the left one comes first."""
        ranks, size_of = self.ranks, self.bytes_of
        left_until = right_until = len(ranks) + max(left, right)
        while True:
            rank = ranks.get(size_of[left] + size_of[right])
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            part, other = self.right_part.get(left), self.left_part.get(right)
            if part is None and other is None:
                return True
            if other is None or (part is not None and left > right):
                left, left_until = part, left
            else:
                right, right_until = other, right

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        longest = [0] * n
        # Matches come by ascending end, so the last one from a start is its longest.
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - size] = token
        sizes, shorter, pairs = self.sizes, self.shorter, self.pairs
        dead = bytearray(n + 1)
        ids: list[int] = []
        last, at, token = -1, 0, longest[0]
        while True:
            end = at + sizes[token]
            if not dead[end]:
                known = last < 0 or pairs.get((last, token))
                if known is None:
                    known = pairs[last, token] = self.tolerated(last, token)
                if known:
                    ids.append(token)
                    if end == n:
                        break
                    last, at, token = token, end, longest[end]
                    continue
            token = shorter[token]
            if token is None:
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                last = ids[-1] if ids else -1
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        return ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [self.encode_word(w.encode("utf-8", "surrogatepass")) for w in words]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for ids in coded for i in ids), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return list(self.encoder.all(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids].tolist())


@cache
def codec(path: str) -> Codec:
    """One per Python worker and file."""
    return Codec(path)


def round_trip(text: Column, path: str) -> Column:
    """struct<ids: array<int>, decoded: binary>: ids of each text (null: empty) and the bytes that they stand for."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(kind)
    def both(column: pa.Array) -> pa.Array:
        c, rows, decoded = codec(path), [], []
        for texts in strings(column):
            for ids in c.encode(texts):
                rows.append(ids.astype(np.int32))
                decoded.append(c.decode(ids))
        offsets = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *rows])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    return both(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that each array of ids stands for; null gives null, an id without a token nothing."""

    @F.arrow_udf(T.BinaryType())
    def decoded(column: pa.Array) -> pa.Array:
        c = codec(path)
        most = len(c.pieces)
        return pa.array([None if x is None else c.decode(np.array([i for i in x if i is not None and 0 <= i < most], np.int64)) for x in column.to_pylist()], pa.binary())

    return decoded(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded bytes of every document.

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table an empty one; other columns aren't read.
    Texts are cut into the matches of ``public_tokenizers.PATTERN``, each encoded by itself, whole and of any length.
    """
    return in_small_batches(docs).select("doc_id", round_trip(F.col("text"), path).alias("r")).select("doc_id", "r.ids", "r.decoded")
