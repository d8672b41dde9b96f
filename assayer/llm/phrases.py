"""Collocations: frequent phrases, scored by how much more often their parts meet than stand alone.

Every scan splits texts with numpy: folded bytes, word starts, one separator between words of a piece, a line break between pieces.

Candidates are Apriori-safe and come level by level.  For each length a scan hashes the phrases whose shorter parts may be
frequent, Spark sums the counts of each hash, and hashes below the least count go: a collision can only keep a phrase.
The hashes that stay are looked up by a bitmap of at most BITMAP bits, with an exact semi-join behind it, so the next
length and the phrases' names come from bounded memory whatever the table's size.

Counting is by double-array tries.  Candidates are sorted and cut into shards of SHARD keys; a task builds the trie of a shard
and up to AT_ONCE tries are broadcast to a scan.  There the states of all word starts advance together, a byte a level; those
that leave the trie drop out; at each word's end the accepting states are counted by bincount, and the tasks' vectors of counts are
summed, shard by shard.  More candidates than AT_ONCE shards take further scans, of the languages in question alone.

Cases: null and empty texts have no words; a null language is `und`; repeated rows count each; very long texts are cut at line
breaks or marks, where no phrase goes on; a phrase's words may be of any length; ties go by score, count and bytes of the phrase,
which are unique; doc_id and other columns, whatever their names, are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import forget, stored, table, text_batches

#: Bytes that end a piece.
MARKS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, one blank, and a line break for each mark.
FOLD = bytes(10 if i in MARKS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Folded bytes that a scan handles at once; hashes, and words, that a task holds before it passes them on.
RUN, HELD, WORDS = 400_000, 600_000, 200_000
#: Bits of a bitmap: for each hash, and at most.
SPREAD, BITMAP = 32, 1 << 27
#: Keys of a trie, and tries that a scan holds; keys of a vector of counts, and vectors that a task sums.
SHARD, AT_ONCE, BLOCK, FAN = 200_000, 6, 4096, 256

_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """(language, folded text) of a batch in runs of about RUN bytes; longer texts are cut where a piece ends."""
    langs, texts, size = [], [], 0
    for at, some in text_batches(batch.column(1), RUN):
        for lang, text in zip(batch.column(0).slice(at, len(some)).to_pylist(), some, strict=True):
            rest = text.encode().translate(FOLD)
            while rest:
                cut = len(rest)
                if cut > RUN:
                    cut = rest.rfind(b"\n", 0, RUN) + 1 or rest.find(b"\n", RUN) + 1 or cut
                langs.append(lang)
                texts.append(rest[:cut])
                rest, size = rest[cut:], size + cut
                if size >= RUN:
                    yield langs, texts
                    langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


class Words:
    """The words of a run: `bytes` has them with one byte behind each, a blank where the piece goes on and a line break elsewhere."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ended = raw == 10
        word = ~(ended | (raw == 32))
        edge = np.diff(word.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lines = np.cumsum(ended, dtype=np.int32)
        self.on = np.zeros(len(starts), bool)  # the piece goes on behind the word
        self.on[:-1] = lines[starts[1:] - 1] == lines[ends[:-1] - 1]
        word[ends] = True
        self.bytes = raw[word]
        self.ends = np.cumsum(ends - starts + 1) - 1
        self.starts = self.ends - (ends - starts)
        self.bytes[self.ends] = np.where(self.on, 32, 10)
        self.langs = list(dict.fromkeys(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        of_text = np.array([number[x] for x in langs], np.int32)
        self.lang = of_text[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")]

    def hashes(self) -> np.ndarray:
        """One for each word of a language."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        powers, back = _powers(len(self.bytes) + 1)
        sums = np.cumsum((self.bytes + np.uint64(1)) * powers[: len(self.bytes)])  # of a word's bytes: a difference, moved to the start
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        own = (sums[self.ends - 1] - before) * back[self.starts]
        salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], np.uint64)
        return mixed(own ^ salt[self.lang])

    def phrases(self, n: int, kept: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of the phrases of n words; with a bitmap those whose two parts of n - 1 words it holds."""
        part = own = self.hashes()
        good, shorter = np.ones(len(own), bool), own
        for k in range(2, n + 1):  # what comes round from the start lies behind a last word, where no piece goes on
            good &= np.roll(self.on, 2 - k)
            shorter, part = part, mixed(part * _ODD + np.roll(own, 1 - k))
        if kept is not None and len(own):
            held = kept.has(shorter)
            good &= held & np.roll(held, -1)
        at = np.flatnonzero(good)
        return at, part[at]

    def first(self, at: np.ndarray, n: int, h: np.ndarray) -> np.ndarray:
        """Places of the first of each phrase of n words, and of any that has the hash of another phrase; texts are compared byte by byte."""
        if not len(at):
            return at
        _, one, of = np.unique(h, return_index=True, return_inverse=True)
        start, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        same = (size == size[one][of]) & (self.lang[at] == self.lang[at[one]][of])
        hit = np.flatnonzero(same)
        step = np.arange(size[hit].sum()) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit])
        differ = self.bytes[np.repeat(start[hit], size[hit]) + step] != self.bytes[np.repeat(start[one][of][hit], size[hit]) + step]
        same[hit] = ~np.logical_or.reduceat(differ, np.cumsum(size[hit]) - size[hit])
        return np.union1d(one, np.flatnonzero(~same))


_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of an odd number, and of its inverse, modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * RUN), x, np.uint64)])) for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64))]
    return _tables


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Bitmap:
    """Two bits for each hash; what it lacks was not put in."""

    def __init__(self, bits: int):
        self.mask, self.words = np.uint64(bits - 1), np.zeros(bits // 64, np.uint64)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h & self.mask, (h >> np.uint64(32)) * np.uint64(3) & self.mask

    def put(self, h: np.ndarray) -> None:
        for p in self.places(h):
            np.bitwise_or.at(self.words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = self.places(h)
        one = lambda p: (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)
        return (one(a) & one(b)).astype(bool)


class DoubleArray:
    """A trie of byte strings: from state s by byte c to base[s] + c, if check there is s.  Cells hold both; leaves hold -1 - key."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @classmethod
    def build(cls, keys: list[bytes]) -> DoubleArray:
        """Of sorted different keys, none of which begins another."""
        text = np.frombuffer(b"".join(keys), np.uint8)
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        at = np.cumsum(size) - size
        shared = np.zeros(len(keys), np.int64)  # bytes that a key shares with the one before
        live, depth = np.arange(1, len(keys)), 0
        while len(live := live[np.minimum(size[live], size[live - 1]) > depth]):
            live = live[text[at[live] + depth] == text[at[live - 1] + depth]]
            depth += 1
            shared[live] = depth
        new = size - shared  # nodes that begin with a key; the root is node 0
        first = 1 + np.cumsum(new) - new
        key = np.repeat(np.arange(len(keys)), new)
        node = np.arange(1, 1 + len(key))
        depth_of = shared[key] + node - first[key] + 1
        label = text[at[key] + depth_of - 1].astype(np.int64)
        parent = node - 1
        for d in np.unique(shared):
            of = np.flatnonzero(shared == d)
            made = np.maximum.accumulate(np.where((shared < d) & (size >= d), np.arange(len(keys)), 0))
            owner = made[of]
            parent[first[of] - 1] = first[owner] + d - shared[owner] - 1 if d else 0
        order = np.argsort(parent, kind="stable")
        parents, begin, many = np.unique(parent[order], return_index=True, return_counts=True)
        labels = label[order]
        room = int(1.25 * len(node)) + 600
        base, used, claim, rng = np.zeros(len(parents), np.int64), np.zeros(room, bool), np.zeros(room, np.int64), np.random.default_rng(0)
        used[0] = True
        for least, most in ((65, 256), (33, 64), (17, 32), (9, 16), (5, 8), (3, 4), (2, 2), (1, 1)):
            todo = np.flatnonzero((many >= least) & (many <= most))
            while len(todo):
                n = many[todo]
                of = np.repeat(np.arange(len(todo)), n)
                child = np.arange(len(of)) + np.repeat(begin[todo] - (np.cumsum(n) - n), n)
                tried = rng.integers(1, room - 256, len(todo))
                slot = tried[of] + labels[child]
                claim[slot] = of
                clash = np.bincount(of, used[slot] | (claim[slot] != of), len(todo)) > 0
                base[todo[~clash]] = tried[~clash]
                used[slot[~clash[of]]] = True
                todo = todo[clash]
        state = np.zeros(len(node) + 1, np.int64)
        state[node[order]] = np.repeat(base, many) + labels
        cells = np.zeros((room, 2), np.int32)
        cells[:, 1] = -1
        cells[state[node], 1] = state[parent]
        cells[state[parents], 0] = base
        cells[state[first + new - 1], 0] = -1 - np.arange(len(keys))
        return cls(cells)

    def follow(self, state: int, path: bytes) -> int:
        """The state behind a path, -1 if the trie lacks it."""
        for c in path:
            to = int(self.cells[state, 0]) + c
            if self.cells[to, 1] != state:
                return -1
            state = to
        return state

    def found(self, text: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Keys (each once for each occurrence) that lead from `state` along the text from `at` to a word's end."""
        cells = self.cells.view(np.int64)[:, 0]  # the check above, the base below
        base, out = self.cells[state, 0].astype(np.int64), []
        while len(at):
            c = text[at]
            over = np.flatnonzero((c == 32) | (c == 10))
            if len(over):
                cell = cells[base[over] + 10]
                out.append(-1 - cell[(cell >> 32) == state[over]].astype(np.int32))
            to = base + c
            cell = cells[to]
            go = np.flatnonzero(((cell >> 32) == state) & (c != 10))
            at, state, base = at[go] + 1, to[go], cell[go].astype(np.int32).astype(np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def source(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "phrase", "f"])
            seen.clear()

        for batch in batches:
            for langs, texts in runs(batch):
                for lang, text in zip(langs, texts, strict=True):
                    seen.setdefault(lang, Counter()).update(text.split())  # of white space a folded text has blanks and line breaks alone
                if sum(map(len, seen.values())) >= WORDS:
                    yield from out()
        yield from out()

    return rows.mapInArrow(count, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_hashes(rows: DataFrame, n: int, least: int, kept: Bitmap | None) -> DataFrame:
    """(h): hashes whose phrases of n words occur `least` times or more together."""
    sent = None if kept is None else rows.sparkSession.sparkContext.broadcast(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = None if sent is None else sent.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for run in runs(batch):
                words = Words(*run)
                held.append(words.phrases(n, below)[1])
                size += len(held[-1])
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        yield out()

    return rows.mapInArrow(count, "h bigint, c bigint").repartition("h").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h")


def bitmap(hashes: DataFrame, count: int) -> Bitmap:
    """Of all hashes of a table; filled in blocks, so the driver holds the bitmap and a block."""
    out = Bitmap(1 << min(BITMAP.bit_length() - 1, max(16, (SPREAD * count).bit_length())))
    blocks = -(-max(1, count) // HELD)
    for b in range(blocks):
        block = hashes.where(F.pmod(F.col("h"), F.lit(blocks)) == b) if blocks > 1 else hashes
        out.put(block.toArrow().column("h").to_numpy().view(np.uint64))
    return out


def named(rows: DataFrame, n: int, kept: Bitmap, lower: Bitmap | None, hashes: DataFrame) -> DataFrame:
    """(lang, phrase): the phrases of n words that have one of the hashes."""
    sent = rows.sparkSession.sparkContext.broadcast((kept, lower))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, below = sent.value
        for batch in batches:
            for part in runs(batch):
                words = Words(*part)
                at, h = words.phrases(n, below)
                good = wanted.has(h)
                at, h = at[good], h[good].view(np.int64)
                at, h = (x[words.first(at, n, h)] for x in (at, h))
                if len(at):
                    text = words.bytes.tobytes()
                    phrases = [text[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at + n - 1].tolist(), strict=True)]
                    langs = pa.array(words.langs, pa.string()).take(pa.array(words.lang[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(h), langs, pa.array(phrases, pa.binary()).cast(pa.string())], names=["h", "lang", "phrase"])

    return rows.mapInArrow(run, "h bigint, lang string, phrase string").distinct().join(hashes, "h", "left_semi").select("lang", "phrase")


def sharded(candidates: DataFrame, total: int) -> DataFrame:
    """(shard, key, lang, phrase): sorted candidates, cut into shards of SHARD keys at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            i = n + np.arange(batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(begin + i // SHARD), pa.array((i % SHARD).astype(np.int32)), batch.column(0), batch.column(1)], names=["shard", "key", "lang", "phrase"])

    return candidates.repartitionByRange(-(-5 * total // (4 * SHARD)), "lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(cut, "shard bigint, key int, lang string, phrase string")


def tries(shards: DataFrame) -> DataFrame:
    """(shard, langs, low, high, cells): the double array of each shard, and the least and greatest first two bytes of its phrases; a key is its language's number in four bytes, the phrase, a line break."""

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        langs = list(dict.fromkeys(part["lang"].to_pylist()))
        number = {x: i.to_bytes(4, "big") for i, x in enumerate(langs)}
        keys = [number[x] + p + b"\n" for x, p in zip(part["lang"].to_pylist(), part["phrase"].cast(pa.binary()).to_pylist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        trie = DoubleArray.build([keys[i] for i in order])
        leaf = trie.cells[:, 0] < 0
        trie.cells[leaf, 0] = -1 - part["key"].to_numpy()[np.array(order)[-1 - trie.cells[leaf, 0]]]
        pairs = [int.from_bytes(k[4:6].ljust(2, b"\n"), "big") for k in keys]
        return pa.table({"shard": part["shard"][:1], "langs": pa.array([langs], pa.list_(pa.string())), "low": pa.array([min(pairs)], pa.int32()), "high": pa.array([max(pairs)], pa.int32()), "cells": pa.array([trie.cells.tobytes()], pa.binary())})

    return shards.groupBy("shard").applyInArrow(build, "shard bigint, langs array<string>, low int, high int, cells binary")


def counted(rows: DataFrame, built: DataFrame) -> DataFrame:
    """(shard, key, f): how often each key of the tries occurs; AT_ONCE tries a scan, and the tasks' counts summed as vectors, a tree of FAN a level."""
    names = sorted(r["shard"] for r in built.select("shard").collect())  # a number for each trie
    tasks, out = rows.rdd.getNumPartitions(), None
    for i in range(0, len(names), AT_ONCE):
        some = built.where(F.col("shard").isin(names[i : i + AT_ONCE])).toArrow().to_pylist()
        langs = sorted({x for r in some for x in r["langs"]})
        of_lang = rows.where(F.col("lang").isin(langs)) if len(names) > AT_ONCE and len(langs) < 1000 else rows
        found = of_lang.mapInArrow(_counting(rows.sparkSession.sparkContext.broadcast(some)), "shard bigint, block int, task bigint, counts binary")
        out = found if out is None else out.unionByName(found)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        out = out.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("shard", "block", "task").applyInArrow(_summed, out.schema)
    return out.mapInArrow(_keys, "shard bigint, key int, f bigint")


def _summed(part: pa.Table) -> pa.Table:
    total = np.zeros(len(part["counts"][0].as_py()) // 8, np.int64)
    for c in part["counts"]:
        total += np.frombuffer(c.as_py(), np.int64)
    return part.slice(0, 1).set_column(3, "counts", pa.array([total.tobytes()], pa.binary()))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "counts")), strict=True):
            counts = np.frombuffer(counts, np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array((block * len(counts) + at).astype(np.int32)), pa.array(counts[at])], names=["shard", "key", "f"])


def _counting(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some, roots, sums = [], [], []
        for r in sent.value:
            trie = DoubleArray(np.frombuffer(r["cells"], np.int32).reshape(-1, 2))
            some.append(trie)
            roots.append({x: trie.follow(0, i.to_bytes(4, "big")) for i, x in enumerate(r["langs"])})
            sums.append(np.zeros(-(-SHARD // BLOCK) * BLOCK, np.int64))
        for batch in batches:
            for part in runs(batch):
                words = Words(*part)
                begin = words.bytes[words.starts].astype(np.int32) << 8 | words.bytes[words.starts + 1]
                for r, trie, root, total in zip(sent.value, some, roots, sums, strict=True):
                    state = np.array([root.get(x, -1) for x in words.langs], np.int64)[words.lang]
                    at = np.flatnonzero((state >= 0) & (begin >= r["low"]) & (begin <= r["high"]))
                    total += np.bincount(trie.found(words.bytes, words.starts[at], state[at]), minlength=len(total))
        for r, total in zip(sent.value, sums, strict=True):
            blocks = total.reshape(-1, BLOCK)
            full = np.flatnonzero(blocks.any(1))
            if len(full):
                column = lambda x: pa.array(np.full(len(full), x, np.int64))
                yield pa.RecordBatch.from_arrays([column(r["shard"]), pa.array(full.astype(np.int32)), column(TaskContext.get().partitionId()), pa.array([blocks[i].tobytes() for i in full.tolist()], pa.binary())], names=["shard", "block", "task", "counts"])

    return count


def frequencies(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, f): every word, and every phrase of 2 to `longest` words that occurs `least` times or more."""
    words = stored(word_counts(rows), "words")
    below, names, scratch = None, None, []
    for n in range(2, longest + 1):
        hashes = stored(frequent_hashes(rows, n, least, below), "hashes")
        scratch.append(hashes)
        total = hashes.count()
        if not total:
            break
        kept = bitmap(hashes, total)
        found = stored(named(rows, n, kept, below, hashes), "named")
        scratch.append(found)
        names = found if names is None else names.unionByName(found)
        below = kept
    words = words.withColumn("words", F.lit(1))
    total = 0 if names is None else names.count()
    if not total:
        return words
    cut = stored(sharded(names, total), "shards")
    built = stored(tries(cut), "tries")
    sums = stored(counted(rows, built).join(cut, ["shard", "key"]).where(F.col("f") >= least).select("lang", "phrase", "f", F.size(F.split("phrase", " ")).alias("words")), "phrases")
    for t in (*scratch, cut, built):
        forget(t)
    return words.unionByName(sums)


def collocations(df: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    every = frequencies(source(df, lang_col, text_col), longest, least)
    n = every.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))  # a row for each language
    phrases = every.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    piece = lambda a, b: F.array_join(F.slice(parts, a, b), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("*", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = lambda name, f: every.where(F.col("f") >= least).select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products have up to 38 digits
    cuts = cuts.withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    inside = phrases.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))
