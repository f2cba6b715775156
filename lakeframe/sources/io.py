"""Sources and sinks: frames, series, references, documents with front matter, record search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_frame(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV or parquet by suffix, with a declared schema; nothing else is read."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True)
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"{path}: only .csv and .parquet are read")


def read_series(spark: SparkSession, path: str, time: str, value: str) -> DataFrame:
    reader = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return reader.select(F.to_timestamp(time).alias("ds"), F.col(value).cast("double").alias("y"))


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Write the admitted frame as it is and read it back: the reference that drift is measured against."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def parse_front_matter(df: DataFrame, text: str, tag_separator: str = ",") -> DataFrame:
    """meta (key to value), tags and body of texts that begin with a block of "key: value" lines between "---" lines.

    Texts without such a block, or whose block is never closed, are skipped.
    """
    whole = df.where(F.col(text).rlike(r"(?s)\A---\n.*?\n---"))
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    meta = F.str_to_map(block, F.lit("\n"), F.lit(": "))
    tags = F.split(F.regexp_extract(F.element_at(meta, "tags"), r"(?s)\A\[(.*)\]\Z", 1), tag_separator)
    return whole.withColumn("meta", meta).withColumn("tags", tags).withColumn("body", F.regexp_replace(text, r"(?s)\A---\n.*?\n---", ""))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(id, meta, tags, body) of the markdown files under path, by id: that of the front matter, else the file's name."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("_name"), F.regexp_replace("value", "\r\n", "\n").alias("text"))
    parsed = parse_front_matter(files, "text")
    return parsed.select(F.coalesce(F.element_at("meta", "id"), "_name").alias("id"), "meta", F.transform("tags", lambda t: F.trim(t)).alias("tags"), F.trim(F.regexp_replace("body", r"\A\n+|\n+\Z", "")).alias("body")).orderBy("id")


def find_records(df: DataFrame, equal: dict[str, str], text_columns: list[str], substring: str, time: str, key: str, newest: bool = True, limit: int = 25) -> DataFrame:
    """Rows that match all filters, by time, at most limit of them, each with the number of all matches."""
    found = df
    for c, v in equal.items():
        found = found.where(F.col(c) == v)
    found = found.where(F.lower(F.concat_ws("\n", *text_columns)).contains(substring.lower()))
    top = found.orderBy(F.desc(time) if newest else F.asc(time), key).limit(min(limit, 25))
    return top.crossJoin(F.broadcast(found.agg(F.count("*").alias("n_matches"))))  # one row


def orphans(fact: DataFrame, key: str, dim: DataFrame, id_: str, name: str) -> DataFrame:
    """How many rows of fact have a key that dim lacks."""
    return fact.select(key).join(dim.select(F.col(id_).alias(key)), key, "left_anti").agg(F.lit(name).alias("reference"), F.count("*").alias("n_orphans")).select("reference", "n_orphans")
