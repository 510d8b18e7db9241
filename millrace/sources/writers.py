"""Sinks: write once, sealed, resumable."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.durable import children, exists, read_text, rename, write_text
from millrace.operators.contracts import ContractError


def write_once(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write to a path that must not exist yet; kind: parquet, json, csv or orc."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)


def write_report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one CSV file of any file system; more than most rows are
    an error, and so is a file that exists."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ContractError(f"a report has at most {most} rows")
    write_text(df.sparkSession, path, rows.to_csv(index=False))


def canonical_json(value: object) -> str:
    """JSON with sorted keys and without spaces: equal values give equal texts;
    numbers that are not finite are an error."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def fingerprint(value: object) -> str:
    """The SHA-256 of a value's canonical JSON: of a request, a configuration or
    the inputs of a run."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(path: str, value: object, spark: SparkSession | None = None) -> None:
    """A JSON document with sorted keys, put in place at once, on any file system
    if a session is given."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, indent=1)
    if spark is not None:
        write_text(spark, path, text, replace=True)
        return
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, suffix=".part") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def canonical_rows(df: DataFrame) -> DataFrame:
    """(json) of every row: its fields in the order of their names, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_canonical(df: DataFrame, path: str) -> None:
    """One JSON object a line with fields in the order of their names, to a path
    that must not exist; it appears as a whole or not at all."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part-{fingerprint([path, sorted(df.columns)])[:8]}"
    canonical_rows(df).write.mode("overwrite").text(part)
    rename(spark, part, path)


def commit_generation(df: DataFrame, folder: str) -> str:
    """Write a table as the next generation below folder and point CURRENT at it;
    earlier generations stay as they are.  The path of the generation."""
    spark = df.sparkSession
    taken = [int(n[4:]) for n in children(spark, folder) if n.startswith("gen-") and n[4:].isdigit()]
    name = f"gen-{max(taken, default=0) + 1:06d}"
    write_once(df, f"{folder.rstrip('/')}/{name}")
    write_text(spark, f"{folder.rstrip('/')}/CURRENT", name, replace=True)
    return f"{folder.rstrip('/')}/{name}"


def current_generation(spark: SparkSession, folder: str) -> DataFrame:
    """The table of the generation that CURRENT names."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{read_text(spark, folder.rstrip('/') + '/CURRENT')}")


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or
    partitioning: count and sums of two hashes of each row."""
    names = sorted(df.columns)
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)"))
    r = df.agg(F.count(F.lit(1)).alias("n"), h(0).alias("a"), h(1).alias("b")).first()
    return hashlib.sha256(json.dumps([names, r["n"], str(r["a"]), str(r["b"])]).encode()).hexdigest()


def seal(df: DataFrame, path: str, meta: Mapping[str, object]) -> str:
    """Write a table once, with its digest and meta beside it; the digest."""
    write_once(df, path)
    digest = content_digest(df.sparkSession.read.parquet(path))
    write_json(f"{path.rstrip('/')}.meta.json", dict(meta) | {"content_digest": digest}, df.sparkSession)
    return digest


def unseal(spark: SparkSession, path: str) -> DataFrame:
    """A sealed table, after checking its digest."""
    df = spark.read.parquet(path)
    if content_digest(df) != json.loads(read_text(spark, f"{path.rstrip('/')}.meta.json"))["content_digest"]:
        raise ContractError(f"{path} isn't what was sealed")
    return df


def remaining(inputs: DataFrame, done: DataFrame, identity: str) -> DataFrame:
    """The inputs that have no result yet."""
    return inputs.join(done.select(identity).distinct(), identity, "left_anti")


def append_remaining(inputs: DataFrame, score, path: str, identity: str) -> DataFrame:
    """Score what path doesn't hold yet, append it, and read all results."""
    spark = inputs.sparkSession
    if any(f.endswith(".parquet") for f in children(spark, path)):
        inputs = remaining(inputs, spark.read.parquet(path), identity)
    score(inputs).write.mode("append").parquet(path)
    return spark.read.parquet(path)
