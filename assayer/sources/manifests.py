"""Manifests, predictions, locks and calibrations as files: written by Spark, read back with their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources import longfiles

#: A file up to this many bytes is read whole.
WHOLE = 64 << 20
#: Labels and splits that a manifest may hold.
LABELS, SPLITS = ["real", "manipulated", "ai_generated"], ["val", "test", "holdout"]
KNOWN = "id string, file string, label string, group string, kind string, generator string, mask string, split string, tags array<string>"


def write_manifest(items: DataFrame, path: str) -> None:
    """One JSON object a line; fields without a value are left out, and so are empty tags."""
    tags = F.when(F.size("tags") > 0, F.col("tags")) if "tags" in items.columns else None
    (items.withColumn("tags", tags) if tags is not None else items).write.option("ignoreNullFields", "true").json(path)


def scan_manifest(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Items with defaults: id and group are the file, a generated item's generator its kind; fields of other names are kept in `extra`.

    A label that is none of LABELS fails the read when it is reached.
    """
    if multiline:
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    else:
        raw = spark.read.text(path).where(F.trim("value") != "")
    known = raw.select(F.from_json("value", KNOWN).alias("x"), F.from_json("value", "map<string,string>").alias("all"))
    names = [f.split()[0] for f in KNOWN.split(", ")]
    label = F.when(F.col("x.label").isin(*LABELS), F.col("x.label")).otherwise(F.raise_error(F.concat(F.coalesce("x.file", F.lit("?")), F.lit(": label must be one of "), F.lit(", ".join(LABELS)))))
    filled = lambda c: F.nullif(F.col(f"x.{c}"), F.lit(""))
    return known.select(
        F.coalesce(filled("id"), F.col("x.file")).alias("id"), F.col("x.file").alias("file"), label.alias("label"), F.coalesce(filled("group"), F.col("x.file")).alias("group"), F.col("x.kind").alias("kind"),
        F.coalesce(filled("generator"), F.when(F.col("x.label") == "ai_generated", F.col("x.kind"))).alias("generator"), F.col("x.mask").alias("mask"), F.col("x.split").alias("split"), F.coalesce("x.tags", F.array().cast("array<string>")).alias("tags"),
        F.map_filter("all", lambda k, _: ~k.isin(*names)).alias("extra"),
    )


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, split, targets, detectors) of JSON lines, blank ones skipped."""
    schema = "id string, split string, targets struct<manipulation: boolean, ai_generation: boolean>, detectors map<string, struct<execution_status: string, raw_score: double, duration_ms: double>>"
    return spark.read.schema(schema).json(path).where("id is not null")


def problems(items: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem): repeated ids, unknown splits, files and masks that are not among files (path), groups in several splits."""
    twice = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    split = items.where(F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS)).select("id", F.concat(F.lit("unknown split "), "split").alias("problem"))
    gone = lambda c, what: items.where(F.col(c).isNotNull()).join(files.select(F.col("path").alias(c)).distinct(), c, "left_anti").select("id", F.lit(f"{what} missing").alias("problem"))
    leaks = items.where("split is not null").groupBy("group").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1).select(F.col("group").alias("id"), F.concat(F.lit("group in several splits: "), F.array_join("s", ", ")).alias("problem"))
    return twice.unionByName(split).unionByName(gone("file", "file")).unionByName(gone("mask", "mask")).unionByName(leaks)


def digests(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE, step: int = longfiles.STEP) -> DataFrame:
    """(name, bytes, sha256) of every file in a folder; one without bytes is not listed by Spark.

    A file of more than `whole` bytes is not read by one task, but by steps (`longfiles`); if its name is that of a packed file or a line
    of it is too long it is read whole, and then fails over 2 GB.
    """
    read = lambda source: spark.read.format(source).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    long = (F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").rlike(longfiles.PACKED)  # of the listing: of others nothing is read
    files, name = read("binaryFile").load(path), F.substring_index("path", "/", -1).alias("name")
    digest = lambda rows: rows.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    short = digest(files.where(~long))
    listed = files.where(long).select("path", "length", F.col("_metadata.file_path").alias("file"))
    if listed.isEmpty():
        return short
    lines = read("text").options(lineSep="\n", **longfiles.LINE).load(path).where(long)
    found = longfiles.digests(spark, lines, listed, step)
    if left := [r.file for r in found.where("sha256 is null").join(listed, "path").select("file").collect()]:
        short = short.unionByName(digest(files.where(F.col("_metadata.file_path").isin(left))))
    return short.unionByName(found.where("sha256 is not null").select(name, F.col("length").alias("bytes"), "sha256"))


def checked(files: DataFrame, sums: DataFrame) -> DataFrame:
    """(name, status): verified, mismatch or unlisted, by a list of sums (value: digest, blanks, name)."""
    line = r"^([0-9a-f]{64})\s+\*?(.+)$"
    listed = sums.select(F.regexp_extract("value", line, 1).alias("expected"), F.regexp_extract("value", line, 2).alias("name")).where("expected <> ''")
    status = F.when(F.col("expected").isNull(), "unlisted").when(F.col("expected") == F.col("sha256"), "verified").otherwise("mismatch")
    return files.join(listed, "name", "left").select("name", status.alias("status"))


def write_lock(items: DataFrame, path: str, schema: int = 1) -> None:
    """A frozen holdout (id, label, sha256): its files, and a header with their number and the digest of all; contents that occur twice are refused."""
    from assayer.operators.splits import fingerprint

    files = items.groupBy("sha256").agg(F.min("id").alias("id"), F.min("label").alias("label"), F.count("*").alias("n"))
    once = F.when(F.col("n") == 1, F.col("sha256")).otherwise(F.raise_error(F.concat(F.col("id"), F.lit(" has the same bytes as another item"))))
    files.select(once.alias("sha256"), "id", "label").write.json(f"{path}/files")
    whole = fingerprint(items.withColumn("_all", F.lit("all")), "_all", ["sha256"])
    items.agg(F.count("*").alias("count")).crossJoin(whole).select(F.lit(schema).alias("schema"), "count", F.col("fingerprint").alias("holdout_sha256")).coalesce(1).write.json(f"{path}/header")  # one row


def read_lock(spark: SparkSession, path: str, schema: int = 1) -> tuple[DataFrame, DataFrame]:
    """(files, header); another schema is an error."""
    header = spark.read.schema("schema int, count bigint, holdout_sha256 string").json(f"{path}/header")
    if (found := header.first()) is None or found["schema"] != schema:
        raise ValueError(f"unknown schema of a lock: {found}")
    return spark.read.schema("sha256 string, id string, label string").json(f"{path}/files"), header
