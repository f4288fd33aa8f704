"""Readers and writers: registries, parse caches, line-delimited records, tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = (
    "row_ord int, doc_id string, short_name string, file string, subject string, framework string, volume string, jurisdiction string, issuer string, doc_type string, doc_role string, "
    "effective_from date, effective_to date, status string, supersedes array<string>, superseded_by array<string>, revises array<string>, revised_by array<string>, applicability string, "
    "authority_rank int, source_url string, notes string, verified boolean"
)
SCHEMA_VERSION = 4


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML registry as rows in file order; a file of another schema version is an error."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    held = yaml.safe_load(text)
    if held.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema_version is {held.get('schema_version')!r}; {SCHEMA_VERSION} is read")
    names = [c.strip().split()[0] for c in REGISTRY.split(",")]
    known = set(names) - {"row_ord"}
    rows = []
    for i, doc in enumerate(held.get("documents", [])):
        if extra := set(doc) - known:
            raise ValueError(f"{doc.get('doc_id')}: unknown fields {sorted(extra)}")
        rows.append((i, *((doc.get(n) or []) if n in ("supersedes", "superseded_by", "revises", "revised_by") else doc.get(n) for n in names[1:])))
    return spark.createDataFrame(rows, REGISTRY)


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A CSV with header; empty and NaN values are NULL."""
    return spark.read.option("header", True).option("sep", separator).option("nanValue", "NaN").option("nullValue", "").schema(schema).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str, separator: str = ",") -> None:
    """S24."""
    read_csv(spark, source, schema, separator).write.mode("overwrite").option("compression", "snappy").parquet(target)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON; malformed lines give rows of NULL."""
    return spark.read.schema(schema).json(path)


def append_records(df: DataFrame, path: str) -> bool:
    """Append JSON lines and say whether that worked; an audit never stops an answer."""
    try:
        df.write.mode("append").json(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def newest(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """The path of the file that was changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0]


def parse_keys(files: DataFrame, parser_version: str) -> DataFrame:
    """(doc_id, sha16, parser): what a parse of each file is kept under."""
    return files.select("doc_id", F.substring(F.sha2(F.col("content"), 256), 1, 16).alias("sha16"), F.lit(parser_version).alias("parser"))


def cache_status(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, cached, n_stale): whether a file's parse is held, and older ones of it."""
    held = cache.select("doc_id", "sha16", "parser").distinct()
    fresh = keys.join(held.withColumn("cached", F.lit(True)), ["doc_id", "sha16", "parser"], "left")
    stale = stale_entries(keys, cache).groupBy("doc_id").agg(F.count("*").alias("n_stale"))
    return fresh.join(stale, "doc_id", "left").select("doc_id", F.coalesce("cached", F.lit(False)).alias("cached"), F.coalesce("n_stale", F.lit(0)).alias("n_stale"))


def cache_misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose current content is not parsed yet."""
    return keys.join(cache.select("doc_id", "sha16", "parser").distinct(), ["doc_id", "sha16", "parser"], "left_anti")


def stale_entries(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Parses of content or parsers that are no longer current."""
    return cache.select("doc_id", "sha16", "parser").distinct().join(keys, ["doc_id", "sha16", "parser"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows but for those that new ones replace."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_document(df: DataFrame, doc_id: str) -> DataFrame:
    """S12."""
    return df.filter(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def store_stats(chunks: DataFrame) -> DataFrame:
    """Exact counts of chunks and parents."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("parent_id").alias("n_parents"))


def merged_labels(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Labels read back by row number: what is new fills in, what is there stays."""
    return rows.join(labels.select(key, F.col(label).alias("new_")), key, "left").withColumn(label, F.coalesce("new_", label)).drop("new_")


def generated(df: DataFrame, prompt: Column, generate: Callable[[list[str]], list[str]], out: str = "reply") -> DataFrame:
    """``df`` with what a model replies to each prompt; the model is any function of a batch."""
    import pandas as pd

    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(generate(prompts.tolist()))

    run.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "string")(prompt))


def missing_files(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is not in a folder's listing."""
    return registry.join(listing.select("file").distinct(), "file", "left_anti")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, path, length) of a folder, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length")


def replaced(df: DataFrame, path: str, keep: int = 2, by: tuple[str, ...] | list[str] = ()) -> str:
    """Write a whole new version beside the old ones, then name it.

    Rows go to a folder of the writer's own first; one rename makes it a version, so readers see
    the old version or the new one and never a part, and a writer that fails leaves what was there.
    Of two writers that meet, the one whose name is taken takes the next. ``keep`` versions stay
    for readers that began before.
    """
    import uuid

    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    own = hadoop.Path(f"{path}/_writing-{uuid.uuid4().hex}")
    try:
        writer = df.write.mode("error")
        (writer.partitionBy(*by) if by else writer).parquet(own.toString())
        while True:
            held = _versions(fs, root)
            target = f"{path}/v{(held[-1] if held else 0) + 1:06d}"
            if not fs.exists(hadoop.Path(target)) and fs.rename(own, hadoop.Path(target)):
                break
    finally:
        fs.delete(own, True)
    for old in held[: max(0, len(held) + 1 - keep)]:
        fs.delete(hadoop.Path(f"{path}/v{old:06d}"), True)
    return target


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions of a table that ``replaced`` writes."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _versions(root.getFileSystem(spark._jsc.hadoopConfiguration()), root)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a table that ``replaced`` writes."""
    held = versions(spark, path)
    if not held:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{held[-1]:06d}")


def _versions(fs, root) -> list[int]:
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def prompt_text(spark: SparkSession, path: str, labels: tuple[str, ...] = (), **vocabulary: str) -> tuple[str, str]:
    """(text, sha16) of a prompt file with vocabulary put in; a label it should have and lacks is an error."""
    import hashlib

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    for name, value in vocabulary.items():
        text = text.replace("{" + name + "}", value)
    if lacking := [x for x in labels if x not in text]:
        raise ValueError(f"{path} lacks {lacking}")
    return text, hashlib.sha256(text.encode()).hexdigest()[:16]


def why_unavailable(probe: Callable[[], object]) -> str:
    """Why a model cannot be asked, or an empty string."""
    try:
        probe()
    except Exception as error:  # noqa: BLE001  any failure is an answer here
        return f"{type(error).__name__}: {error}"
    return ""
