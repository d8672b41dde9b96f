"""Best-fit packing of token sequences, by hierarchical residual rounds.

Round 0 runs where the texts are read: a task turns its texts into ids, cuts those that are longer than a
sequence into full pieces and a rest, and packs the pieces best-fit decreasing.  Bins that are full or
nearly so are final.  The emptiest others of each task (at most CARRY) go up a tree: each node takes the bins of FAN
nodes below as items, packs them best-fit again and passes its own emptiest on.

CARRY bounds what a node holds, not how well it packs.  After best-fit at most one bin is half full or less: the first item
of a second one would have fitted into the first.  Two bins fit together only if one of them is half full or less, so a node joins no
more pairs than it has nodes below, and each such bin finds room, if anywhere, in the emptiest others, of which CARRY come up
from every node: bins that stay below would never have been used.  On 10,000 documents 32 tasks take 1.003 and 211 tasks (of 47
documents each) 1.014 times as many sequences as the tokens fill, with CARRY as without any bound.

Cases: null text counts as empty and gives the end token alone; a special token that a text spells out gets its id, as the tokenizer
gives it; very long texts are encoded whole and cut into full pieces; of
items of equal size the first comes first, and of bins with equal room the last; a null id is kept; repeated rows are packed one
by one; other columns, whatever their names, are neither read nor returned; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import Remembered, stored, table, text_batches

#: Bins with less room than this are final at once.
NEARLY = 8
#: Underfull bins that a node passes on, and nodes that one above it takes in.
CARRY, FAN = 1024, 8
#: Pieces that a task packs at once.
AT_ONCE = 200_000


class WordIds:
    """Ids of whole texts, by the tokenizer's own encoding of what stands between blanks.

    The tokenizer's pattern never spans white space and its normalizers act on each run of other characters
    by itself, so the ids of a text are those of its blank-separated parts in order.  Marks after a letter or
    digit begin a match of their own, so a part's ids are those of its core and of the marks behind it.  The
    tokenizer lowers letters one by one: texts of Latin-1 characters, where Python does the same, are lowered first.

    The tokenizer finds its special tokens in raw text, before anything else, so texts are split at them and each gets its own id, as
    it does there.  With plain=True a text that spells one out is bytes like any other.
    """

    MARKS = ".,!#$%&*|;:?"
    _made: dict[tuple[str, bool], WordIds] = {}

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {} if plain else {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a match
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Remembered(800_000, 48)

    @classmethod
    def of(cls, path: str, plain: bool = False) -> WordIds:
        if (path, plain) not in cls._made:
            cls._made[path, plain] = cls(path, plain)
        return cls._made[path, plain]

    def tokenize(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of each part; those of letters alone, one match each, are encoded many in a string."""
        letters, found = [p for p in parts if p.isalpha()], {}
        for i in range(0, len(letters), 200):
            chunk = letters[i : i + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(chunk):
                raw = ids.tobytes()
                found.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(chunk, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        others = [p for p in parts if p not in found]
        for i in range(0, len(others), 20_000):
            chunk = others[i : i + 20_000]
            found.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(chunk, self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False), strict=True))
        return found

    def learn(self, words: set[str]) -> dict[str, bytes]:
        split = {}
        for w in words:
            core = w.rstrip(self.MARKS)
            split[w] = (core, w[len(core) :]) if core and ends_match(core[-1]) else (w, "")
        ids = self.tokenize({p for pair in split.values() for p in pair}.difference(self.words.known))
        known = self.words.known
        return ids | {w: (ids[core] if core in ids else known[core]) + (ids[marks] if marks in ids else known[marks]) for w, (core, marks) in split.items()}

    @staticmethod
    def lowered(text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.special and any(x in t for t in texts for x in self.special):
            split = [self.at_special.split(t) for t in texts]  # every other part is a special token
            ids = iter(self.encode_plain([p for s in split for p in s[::2]]))
            return [b"".join(self.special[p] if i % 2 else next(ids) for i, p in enumerate(s)) for s in split]
        return self.encode_plain(texts)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        parts = [self.lowered(t).replace("\n", " ").split(" ") for t in texts]
        return self.words.joined(parts, self.learn)


def ends_match(char: str) -> bool:
    """True for letters and digits that the tokenizer's normalizers leave letters and digits."""
    return char.isalnum() and (char < "\u0100" or unicodedata.normalize("NFC", char).lower()[-1].isalnum())


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of each item and each bin's fill."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []  # bit r of rooms: some bin has exactly r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at_least = rooms >> size
        if at_least:
            room = size + (at_least & -at_least).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        if left := room - size:
            with_room[left].append(b)
            rooms |= 1 << left
    return bin_of, offset, fill


def emptiest(fill: list[int], capacity: int) -> np.ndarray:
    """Which bins go up the tree."""
    fill = np.asarray(fill)
    order = np.argsort(fill, kind="stable")[:CARRY]
    out = np.zeros(len(fill), bool)
    out[order] = fill[order] <= capacity - NEARLY
    return out


def local_pack(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Round 0: a row for each piece, with its bin, its place there, and for a bin's first piece the bin's fill and whether it goes up."""

    def packed(rows: list[tuple], task: int, first: int) -> tuple[pa.RecordBatch, int]:
        ids, piece, start, length, crc = zip(*rows, strict=True)
        bin_of, offset, fill = best_fit(np.array(length), capacity)
        up = emptiest(fill, capacity)
        number = (task << 36) + first + bin_of
        columns = [pa.array(ids, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(number), pa.array(offset), pa.array(np.asarray(fill, np.int64)[bin_of]), pa.array(up[bin_of]), pa.array(np.full(len(rows), task, np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields]), first + len(fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        coder, task, rows, first = WordIds.of(path), TaskContext.get().partitionId(), [], 0
        tail, width = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            kind = batch.column(0).type
            for at, texts in text_batches(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                for doc, raw in zip(ids, coder.encode(texts), strict=True):
                    raw += tail
                    for k in range(0, len(raw), width):
                        part = raw[k : k + width]
                        rows.append((doc, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
                if len(rows) >= AT_ONCE:
                    out, first = packed(rows, task, first)
                    rows = []
                    yield out
        if rows:
            yield packed(rows, task, first)[0]

    kind = None
    fields = [f"id {df.schema[id_col].dataType.simpleString()}", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "bin bigint", "offset bigint", "fill bigint", "up boolean", "node bigint"]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(fields))


def merge_round(bins: DataFrame, capacity: int) -> DataFrame:
    """One level of the tree: bins of FAN nodes are packed as items; each row stays with the bin of round 0 that it is about."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        items = part.groupby("bin", sort=True)["fill"].first()
        bin_of, offset, fill = best_fit(items.to_numpy(), capacity)
        up = emptiest(fill, capacity)
        name = np.zeros(len(fill), np.int64)
        name[bin_of[::-1]] = items.index.to_numpy()[::-1]  # a bin keeps the smallest number in it
        at = items.index.get_indexer(part["bin"])
        b = bin_of[at]
        return pd.DataFrame({"from_bin": part["from_bin"], "bin": name[b], "shift": part["shift"] + offset[at], "fill": np.asarray(fill, np.int64)[b], "up": up[b], "node": part["node"]})

    above = bins.withColumn("node", F.floor(F.col("node") / FAN).cast("bigint"))
    return above.groupBy("node").applyInPandas(run, bins.schema)


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = stored(local_pack(df, path, capacity, end_id, id_col, text_col), "pieces")
    top = pieces.agg(F.max("node")).first()[0]
    bins = pieces.where("up and offset = 0").select(F.col("bin").alias("from_bin"), "bin", F.lit(0).cast("bigint").alias("shift"), "fill", "up", "node")
    moved = None
    while top is not None and top > 0:
        bins, top = stored(merge_round(bins, capacity), "bins"), top // FAN
        final = bins if top == 0 else bins.where("not up")
        moved = final if moved is None else moved.unionByName(final)
        bins = bins.where("up")
    own = F.col("id").alias(id_col)  # any name, also one of those used here
    if moved is None:
        return pieces.select(own, "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    moved = moved.select(F.col("from_bin"), F.col("bin").alias("to_bin"), "shift")
    joined = pieces.join(moved, pieces["bin"] == moved["from_bin"], "left")
    return joined.select(own, "piece", "start", "length", "ids_crc32", F.coalesce("to_bin", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(layout: DataFrame, df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; ids must be unique in df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds.of(path)
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                coded = [np.frombuffer(x + end_id.to_bytes(4, "little"), np.int32) for x in coder.encode(texts)]
                ends = pa.array(np.cumsum([0, *map(len, coded)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(coded)))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    coded = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    placed = layout.join(coded, layout[id_col] == coded["id"]).select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
