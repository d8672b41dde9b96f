"""Leakage-safe splits, frozen holdouts and hygiene of evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import hash_bucket
from assayer.operators.joins import with_key
from assayer.sources.scratch import drop, kept


def assign_splits(items: DataFrame, fractions: dict[str, float], seed: str, key: Column) -> DataFrame:
    """A split for each row by hash of its group: no shuffle, and a group is never divided."""
    total, edge = sum(fractions.values()), 0.0
    u = hash_bucket(F.concat(F.lit(f"{seed}:"), key))
    names = list(fractions)
    out = F
    for name in names[:-1]:
        edge += fractions[name] / total
        out = out.when(u < edge, name)
    return items.withColumn("split", out.otherwise(names[-1]) if len(names) > 1 else F.lit(names[0]))


def generator_key(group: str = "grp", label: str = "label", kind: str = "kind") -> Column:
    """Generated items go by generator, so each is wholly in one split."""
    return F.when((F.col(label) == "ai_generated") & F.col(kind).isNotNull(), F.concat(F.lit("generator:"), F.col(kind))).otherwise(F.col(group))


def split_leakage(items: DataFrame, group: str = "grp", split: str = "split") -> DataFrame:
    """Groups in more than one split."""
    return items.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n")).where("n > 1")


def build_lock(items: DataFrame, digest: str) -> DataFrame:
    """One row for each content; contents under several ids are marked as refused."""
    return items.groupBy(digest).agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("refused", F.col("copies") > 1)


def check_lock(items: DataFrame, lock: DataFrame, digest: str, holdout: str = "holdout") -> DataFrame:
    """Holdout rows that the lock lacks, and locked contents under another split."""
    joined = items.join(lock.select(digest, F.lit(True).alias("locked")), digest, "left")
    problem = F.when((F.col("split") == holdout) & F.col("locked").isNull(), "not in lock").when((F.col("split") != holdout) & F.col("locked"), "locked under another split")
    return joined.withColumn("problem", problem).where("problem is not null").select("id", "split", "problem")


def capped_sample(items: DataFrame, owner: str, group: str, per_owner: int, per_group: int, seed: str) -> DataFrame:
    """In the order of a seeded hash: at most so many of each owner, then of each group."""
    u = hash_bucket(F.concat(F.lit(f"{seed}:"), F.col("id")))
    ranked = items.withColumn("u", u).withColumn("r", F.row_number().over(W.partitionBy(owner, group).orderBy("u", "id"))).where(F.col("r") <= per_owner)
    return ranked.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy("u", "id"))).where(F.col("r") <= per_group).drop("r", "u")


def fingerprint(items: DataFrame, split: str, fields: list[str], ranges: int = 4) -> DataFrame:
    """(split, fingerprint): a digest that any change of a row changes, whatever the order: of the digests of hash ranges (by so many hexadecimal digits)."""
    rows = items.select(split, F.sha2(F.concat_ws("|", *fields).cast("binary"), 256).alias("h"))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"), 256)
    parts = rows.groupBy(split, F.substring("h", 1, ranges).alias("range")).agg(digest("h").alias("part"))
    return parts.groupBy(split).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "part"))), lambda x: x["part"]), "").cast("binary"), 256).alias("fingerprint"))


def contamination(docs: DataFrame, passages: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, item_id, shared, coverage): passages of which a document has a share of the distinct word runs."""
    def shingles(df: DataFrame, key: str) -> DataFrame:
        w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
        runs = F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, words), " ")))
        return df.select(key, w.alias("w")).where(F.size("w") >= words).select(key, F.explode(F.array_distinct(runs)).alias("h"))

    of = kept(shingles(passages, "item_id"), "passages")  # its size known, Spark broadcasts it if it is small
    size = of.groupBy("item_id").agg(F.count("*").alias("size"))
    shared = shingles(docs, "doc_id").join(of, "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return shared.join(size, "item_id").select("doc_id", "item_id", "shared", (F.col("shared") / F.col("size")).alias("coverage"))


def fit_guard(rows: DataFrame, locked: DataFrame, split: str) -> DataFrame:
    """(split, rows, frozen, refused): nothing is fitted on the holdout, nor where rows of it carry another split's name."""
    hit = rows.join(locked.select("id").distinct().withColumn("_locked", F.lit(True)), "id", "left")
    n = hit.agg(F.count("*").alias("rows"), F.count_if("_locked").alias("frozen"))
    return n.select(F.lit(split).alias("split"), "rows", "frozen", ((F.lit(split) == "holdout") | (F.col("frozen") > 0)).alias("refused"))


def variants(docs: DataFrame, text: str = "text", group: str = "grp") -> DataFrame:
    """Tagged copies of each text, as it may be passed on; a copy keeps its original's group."""
    t = F.col(text)
    words = F.split(t, " ")
    half = F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " ")
    copies = {"original": t, "cut_80": F.substring(t, F.lit(1), F.floor(F.length(t) * F.lit(0.8)).cast("int")), "half": half, "lower": F.lower(t), "blanks": F.regexp_replace(t, r"\s+", " "), "bare": F.regexp_replace(t, r"[.,;:!?]", "")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), c.alias("copy")) for k, c in copies.items()]))
    return docs.select("id", group, each.alias("x")).select("id", group, "x.tag", "x.copy")


def quota_plan(counts: DataFrame, quotas: dict[str, int], each: int) -> list[tuple[str, int]]:
    """Sources to read, in order: always the one with most wanted rows a byte, `each` at most of a class from one source.

    counts: (source, class, rows, bytes), summed up on Spark; only sources that hold a wanted class come to the driver, and a
    quota is filled by the time that many of them are chosen.
    """
    small = counts.where(F.col("class").isin(*quotas)).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("class", "rows"))).alias("rows"), F.max("bytes").alias("bytes"))
    rest = {r["source"]: (r["rows"], r["bytes"]) for r in small.collect()}
    want, plan = dict(quotas), []
    while rest and any(n > 0 for n in want.values()):
        gain = {k: sum(min(rows.get(c, 0), each, n) for c, n in want.items() if n > 0) for k, (rows, _) in rest.items()}
        best = min(rest, key=lambda k: (-gain[k] / rest[k][1], k))
        if not gain[best]:
            break
        rows, _ = rest.pop(best)
        want = {c: n - min(rows.get(c, 0), each, max(0, n)) for c, n in want.items()}
        plan.append((best, gain[best]))
    return plan


def drop_near(items: DataFrame, reference: DataFrame, distance: int) -> DataFrame:
    """(id, near_duplicate_of, distance): each item's nearest within the distance among other sets' codes (id, code); null: it is kept."""
    from assayer.operators.retrieval import hamming_nearest, once

    hits = hamming_nearest(once(items), once(reference), distance).select(F.col("a_code").alias("code"), F.col("b_id").alias("near_duplicate_of"), F.col("distance"))
    return items.select("id", "code").join(hits, "code", "left").select("id", "near_duplicate_of", "distance")


def near_groups(items: DataFrame, distance: int) -> DataFrame:
    """(id, group): items (id, code) share a group if links within the distance lead from one to the other; the least id names it.

    Equal codes are one row before that, and codes that link to many do not gather in a task: labels spread by least values, along links
    that only keep together what is linked.
    """
    from assayer.operators.retrieval import hamming_links

    codes = kept(items.groupBy("code").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "codes")
    links = kept(hamming_links(codes.select(F.col("rep").alias("id"), "code"), distance), "links")
    labels = kept(codes.select("code", F.col("code").alias("root")), "labels")
    while True:
        seen = links.join(labels.withColumnRenamed("code", "other"), "other").groupBy("code").agg(F.min("root").alias("least"))
        after = labels.join(seen, "code", "left").select("code", F.least("root", F.coalesce("least", "root")).alias("next"), "root")
        jump = after.select(F.col("code").alias("next"), F.col("next").alias("further"))
        moved = kept(after.join(jump, "next", "left").select("code", F.least("next", F.coalesce("further", "next")).alias("next"), "root"), "labels")
        still = moved.where("next < root").limit(1).count() == 0
        drop(labels)
        labels = moved.select("code", F.col("next").alias("root"))
        if still:
            break
    drop(links)
    own = codes.join(labels, "code")
    named = own.groupBy("root").agg(F.min("rep").alias("group"))
    groups = kept(own.join(named, "root").select("code", "copies", "group"), "groups")
    return with_key(items.select("id", "code"), groups, "code", "copies").select("id", "group")
