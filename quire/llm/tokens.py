"""Token ids of texts by a public byte-level BPE.

Method: prefix dynamic programming. For every byte prefix of a piece (what the vocabulary's
pre-tokenizer pattern cuts off) there is exactly one last token with which the prefix's
encoding can end: the candidate whose joint with the encoding before it would not have been
merged otherwise. The table of last tokens gives the ids by walking back, lets bytes be
appended by going on with it (``Prefix.append``) and lets a text be encoded again near an edit
alone (``reencode``): pieces before the edit keep their ids, and within the edited piece all
prefixes before the edit keep their last tokens.

Pieces repeat, so each Python worker keeps the ids of pieces it has seen in a bounded table;
that is a memo, not a condition: a piece that isn't there is encoded anew.

Defined results: null and empty texts give an empty list; strings that look like special
tokens are ordinary text; texts of any length are encoded whole; repeated rows give equal ids.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie; every entry takes another place as an argument.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The vocabulary of byte_bpe_50k as ranks.
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a worker's memo holds before it starts again.
MEMO = 400_000


class Vocabulary:
    """Ranks, and for each token the pair of tokens whose merge made it."""

    def __init__(self, path: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.made: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for token, i in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1:
                # tokens are learnt in order of rank: the parts a token is merged from are its encoding by lower ranks
                parts = self._merge(token, i)
                if len(parts) == 2:
                    self.made[i] = parts
                    self.pair[parts] = i

    def _merge(self, token: bytes, below: int) -> tuple[int, ...]:
        ids = [self.rank[token[k : k + 1]] for k in range(len(token))]
        while len(ids) > 1:
            best = min(((self.rank.get(self.bytes[a] + self.bytes[b], below), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), default=(below, 0))
            if best[0] >= below:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return tuple(ids)

    def joins(self, left: int, right: int) -> bool:
        """Whether the two can stand side by side: no merge across their joint would have come first."""
        limit = 1 << 60  # a merge across the joint counts if its rank is below
        while True:
            if self.pair.get((left, right), limit) < limit:
                return False
            # undo the later of the two merges beside the joint; of equal ranks the left one comes first
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and left in self.made:
                    limit, left = left, self.made[left][1]
                    break
                if side == "right" and right in self.made:
                    limit, right = right + 1, self.made[right][0]
                    break
            else:
                return True


class Prefix:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Goes on with the table; prefixes there are final."""
        v, rank, joins = self.v, self.v.rank, self.v.joins
        data = self.data + more
        last = self.last
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                token = rank.get(data[start:end])
                if token is not None and (start == 0 or joins(last[start - 1], token)):
                    last.append(token)
                    break
        self.data = data

    def cut(self, length: int) -> None:
        """Keeps the first bytes alone; their last tokens hold."""
        self.data = self.data[:length]
        del self.last[length:]

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.v.bytes[token])
        return out[::-1]


class Encoder:
    """Texts to ids, with a memo of pieces."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex

        self.v = Vocabulary(path)
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.most = memo

    def piece(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.v.rank.get(data)
            ids = [whole] if whole is not None and (len(data) == 1 or whole in self.v.made) else Prefix(self.v, data).ids()
            if len(self.memo) >= self.most:
                self.memo.clear()
            if len(piece) < 200:
                self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for p in self.pieces(text):
            ids = memo.get(p)
            out += self.piece(p) if ids is None else ids
        return out

    def reencode(self, text: str, ids: list[int], start: int, end: int, new: str) -> list[int]:
        """Ids of text[:start] + new + text[end:], from those of text; only pieces about the edit are encoded."""
        changed = text[:start] + new + text[end:]
        old, now = self.pieces(text), self.pieces(changed)
        head = 0
        at = 0
        while head < min(len(old), len(now)) and old[head] == now[head] and at + len(old[head]) <= start:
            at += len(old[head])
            head += 1
        tail = 0
        while tail < min(len(old), len(now)) - head and old[-1 - tail] == now[-1 - tail]:
            tail += 1
        size = lambda ps: sum(len(self.piece(p)) for p in ps)
        before = size(old[:head])
        after = size(old[len(old) - tail :])
        middle = [i for p in now[head : len(now) - tail] for i in self.piece(p)]
        return ids[:before] + middle + (ids[len(ids) - after :] if after else [])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


def ids(text: Column, vocabulary: str = BYTE_BPE_50K, folder: str = FOLDER) -> Column:
    """The ids of a text as array<int>."""
    path = f"{folder}/{vocabulary}"

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.to_pylist():
                if t:
                    flat.extend(e.encode(t))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))

    return F.coalesce(encode(text), F.array().cast("array<int>"))


def n_ids(text: Column, vocabulary: str = BYTE_BPE_50K, folder: str = FOLDER) -> Column:
    """How many ids a text has; only the number leaves Python."""
    path = f"{folder}/{vocabulary}"

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for batch in batches:
            yield pa.array([len(e.encode(t)) if t else 0 for t in batch.to_pylist()], pa.int64())

    return F.coalesce(count(text), F.lit(0).cast("bigint"))


def with_ids(df: DataFrame, column: str = "text", out: str = "ids", vocabulary: str = BYTE_BPE_50K, folder: str = FOLDER) -> DataFrame:
    return df.withColumn(out, ids(F.col(column), vocabulary, folder))
