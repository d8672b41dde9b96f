"""Byte-level BPE: whole texts to token ids and back.

A text is cut by a pre-tokenization pattern and every match is merged by itself.  A segment tree over
the match's byte positions keeps, at its root, the leftmost pair of least rank.  A merge
changes three leaves (the merged position, its live left neighbour, the position that dies) and
repairs their paths to the root, so n bytes take O(n log n).  The trees of many matches lie in
one NumPy array and step together, as do a long match's own merges in plain lists; matches seen before come from a bounded cache.

Cases: null text counts as empty and gives an empty id list; very long texts are encoded whole, and a match of a megabyte
takes a minute; of pairs of equal rank the leftmost is merged first; ids and texts of repeated rows are repeated; other columns
of the input, whatever their names, are neither read nor returned; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import Remembered, table, text_batches

#: Matches that a Python worker remembers.
CACHE = 200_000
#: Longer matches are not remembered.
CACHE_BYTES = 48
#: Matches whose trees step together, and bytes of one that has a tree of plain lists.
TOGETHER, LONG = 16_384, 512
_NONE = np.iinfo(np.int64).max


class Codec:
    """Ranks of a vocabulary as arrays; one for each vocabulary file and Python worker."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.match, self.memory = ranks, regex.compile(pattern).findall, Remembered(CACHE, CACHE_BYTES)
        self.bytes_of = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.base = max(ranks.values()) + 1
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(merged, np.int64)[order]
        tokens = {rank: token for token, rank in ranks.items()}
        self.tokens = known = [tokens.get(i, b"") for i in range(self.base)]
        self.length = np.array([len(t) for t in known], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.blob = np.frombuffer(b"".join(known), np.uint8)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            cls._made[path, pattern] = cls(ranks, pattern)
        return cls._made[path, pattern]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or a value above all ranks."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian int32) of matches of at most `width` bytes, all in one set of trees."""
        n, width = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        raw = np.zeros((n, width), np.uint8)
        size = np.array([len(p) for p in pieces])
        raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.bytes_of[raw]
        live = np.arange(width) < size[:, None]
        after = np.tile(np.arange(1, width + 1), (n, 1))  # a row's own size: no live right neighbour
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        pair = np.full((n, width), _NONE, np.int64)
        pair[:, :-1] = np.where(live[:, 1:], self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1), _NONE)
        place = np.arange(width)
        tree[:, width:] = np.where(pair < _NONE, pair * width + place, _NONE) if n else pair
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best % width
            gone = after[rows, at]
            ids[rows, at] = best // width
            live[rows, gone] = False
            right = after[rows, gone]
            after[rows, at] = right
            has_right = right < size[rows]
            before[rows[has_right], right[has_right]] = at[has_right]
            left = before[rows, at]
            has_left = left >= 0
            self._put(tree, width, rows, gone, np.full(len(rows), _NONE))
            new = np.full(len(rows), _NONE)
            new[has_right] = self.pair_rank(ids[rows[has_right], at[has_right]], ids[rows[has_right], right[has_right]])
            self._put(tree, width, rows, at, new)
            r, a, b = rows[has_left], left[has_left], at[has_left]
            self._put(tree, width, r, a, self.pair_rank(ids[r, a], ids[r, b]))
            rows = rows[tree[rows, 1] < _NONE]
        flat, ends = ids[live].astype("<i4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_long(self, raw: bytes) -> bytes:
        """Ids of one long match: the same tree in plain lists."""
        n, ranks, tokens = len(raw), self.ranks, self.tokens
        width, none = 1 << (n - 1).bit_length(), _NONE
        ids: list[int | None] = self.bytes_of[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = np.frombuffer(raw, np.uint8).astype(np.int64)
        pair = self.pair_rank(self.bytes_of[first[:-1]], self.bytes_of[first[1:]])
        leaves = np.full(width, none, np.int64)
        leaves[: n - 1] = np.where(pair < none, np.where(pair < none, pair, 0) * width + np.arange(n - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *[x for level in reversed(levels) for x in level.tolist()]]

        def put(at: int) -> None:
            right = after[at]
            rank = ranks.get(tokens[ids[at]] + tokens[ids[right]]) if ids[at] is not None and right < n else None
            node, value = at + width, none if rank is None else rank * width + at
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = other if other < value else value
                node >>= 1
                if tree[node] == value:
                    break  # nothing above changes
                tree[node] = value

        while (best := tree[1]) < none:
            rank, at = divmod(best, width)
            gone = after[at]
            ids[at], ids[gone] = rank, None
            after[at] = right = after[gone]
            if right < n:
                before[right] = at
            put(gone), put(at)
            if before[at] >= 0:
                put(before[at])
        return np.array([i for i in ids if i is not None], "<i4").tobytes()

    @staticmethod
    def _put(tree: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """Set one leaf of each row and repair the path above it."""
        known = rank < _NONE
        tree[rows, at + width] = np.where(known, np.where(known, rank, 0) * width + at, _NONE)
        node = (at + width) >> 1
        while node.size and node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of matches that the cache lacks; short ones go into it."""
        found: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                found[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                found[piece] = self.merge_long(raw)
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, group in groups.items():
            step = max(1, min(TOGETHER, (TOGETHER * 16) >> bits))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                found.update(zip((p for p, _ in part), self.merge([r for _, r in part]), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian int32."""
        parts = [self.match(t) for t in texts]
        return self.memory.joined(parts, self.learn)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids."""
        out = []
        for i in range(0, len(ids), TOGETHER):
            part = ids[i : i + TOGETHER]
            length = self.length[part]
            ends = np.cumsum(length)
            out.append(self.blob[np.repeat(self.start[part] - (ends - length), length) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; `path`: a rank file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                ids = codec.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that id lists stand for; a null list gives null, an unknown id no bytes."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(path, pattern)
        for lists in batches:
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            out = [codec.decode(flat[a:b]) if ok else None for a, b, ok in zip([0, *ends[:-1]], ends, lists.is_valid().to_pylist(), strict=True)]
            yield pa.array(out, pa.binary())

    return run(ids)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(table(spark, sf_dir, "documents"), path, pattern)
    decoded = coded.select("doc_id", "ids", decode(F.col("ids"), path, pattern).alias("decoded"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
