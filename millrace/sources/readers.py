"""Scans: JSON lines, CSV, manifests with files, git logs and patches, bundles."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.durable import qualified
from millrace.functions import text as X
from millrace.operators.contracts import ContractError, repeated_keys, require_columns, require_empty

#: Largest file of a manifest and largest patch, in bytes.
LARGEST_FILE = 2_000_000
SNAPSHOT = ("changes", "edits", "features", "labels", "splits")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped and a line that isn't
    an object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def split_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines, and (file, line) of the lines that are none: not
    an object, or with a value that its field can't take.  Blank lines are
    neither."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.btrim("line") != "")
    fields = spark.createDataFrame([], schema).schema
    wide = T.StructType([*fields, T.StructField("__bad", T.StringType())])
    parsed = text.withColumn("r", F.from_json("line", wide, {"columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.btrim("line").startswith("{")
    return parsed.filter(~bad).select(*[F.col(f"r.`{n}`") for n in fields.names]), parsed.filter(bad).select("file", "line")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One document a file."""
    return spark.read.json(path, multiLine=True)


def read_snapshot(spark: SparkSession, folder: str, names: Sequence[str] = SNAPSHOT) -> dict[str, DataFrame]:
    """The tables of a snapshot folder by name; no data is read yet."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a header, all text, renamed by columns (new name: name in the
    file); a leading byte-order mark is dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    require_columns(raw, list(columns.values()))
    return raw.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(change_id, label) of a label sheet: empty is unlabelled (null), 0 and 1
    are labels, anything else and a repeated id are errors."""
    rows = read_csv(spark, path, {"change_id": "change_id", "label": "label"}).withColumn("label", F.btrim(F.coalesce("label", F.lit(""))))
    require_empty(rows.filter(~F.col("label").isin("", "0", "1")), "labels must be 0, 1 or empty")
    require_empty(repeated_keys(rows, "change_id"), "repeated change_id")
    return rows.select("change_id", F.when(F.col("label") != "", F.col("label").cast("int")).alias("label"))


#: Up to so many files are read by name; more by reading their folder.
NAMED = 100_000


def _folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, length) of all files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring("path", len(qualified(spark, root)) + 2, 1 << 30).alias("__name"), F.col("path").alias("__path"), F.col("length").alias("__length"))


def _contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content) of files of a folder: those named, if they are few."""
    names = [r[0] for r in files.select("__path").distinct().limit(NAMED + 1).collect()]
    reader = spark.read.format("binaryFile")
    whole = reader.option("recursiveFileLookup", "true").load(root) if len(names) > NAMED else reader.load(names) if names else None
    if whole is None:
        return spark.createDataFrame([], "__path string, content binary")
    return whole.filter(F.col("length") <= LARGEST_FILE).select(F.col("path").alias("__path"), "content")


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str], file_column: str = "diff_path") -> DataFrame:
    """Rows of a CSV manifest with the text of the file each names (relative to
    the manifest, on any file system) and, where there is none, the reason:
    path_escapes, file_too_large or file_missing.  Files that no row names
    aren't read."""
    root = path.rsplit("/", 1)[0] if "/" in path else "."
    rows = read_csv(spark, path, {c: c for c in columns})
    name = F.btrim(F.col(file_column))
    escapes = name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)") | (F.coalesce(name, F.lit("")) == "")
    there = _folder_files(spark, root).join(rows.select(name.alias("__name")).filter("__name is not null").distinct(), "__name")
    texts = there.join(_contents(spark, root, there.filter(F.col("__length") <= LARGEST_FILE)), "__path", "left").select("__name", "__length", F.decode("content", "utf-8").alias("content"))
    joined = rows.join(texts, name == F.col("__name"), "left")
    reason = F.when(escapes, "path_escapes").when(F.col("__length").isNull(), "file_missing").when(F.col("__length") > LARGEST_FILE, "file_too_large")
    return joined.select(*columns, F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason"))


def _safe_member(name: str) -> None:
    if name.startswith("/") or ".." in name.split("/"):
        raise ContractError(f"unsafe member {name}")


def read_zip_csv(archive: str, member: str, sha256: str | None = None, most: int = 200_000_000, ratio: float = 200.0) -> list[dict[str, str]]:
    """Rows of one CSV member of an archive, small and on the driver.  Refused are
    an archive of another digest, links, members with an absolute path or one
    that leaves the archive, and a member larger than most or than ratio times
    its compressed size."""
    if sha256 is not None:
        with open(archive, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != sha256:
                raise ContractError("the archive isn't the one expected")
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            _safe_member(info.filename)
            if (info.external_attr >> 28) == 0xA:
                raise ContractError(f"unsafe member {info.filename}")
        info = z.getinfo(member)
        if info.file_size > most or info.file_size > ratio * max(info.compress_size, 1):
            raise ContractError(f"{member} is too large")
        return list(csv.DictReader(io.StringIO(z.read(member).decode("utf-8-sig"))))


def write_bundle(files: Mapping[str, bytes], path: str) -> dict[str, str]:
    """A tar archive of small files with a manifest of their digests as its first
    member, bytes equal for equal files; the digests."""
    digests = {n: hashlib.sha256(files[n]).hexdigest() for n in sorted(files)}
    members = {"manifest.json": json.dumps(digests, sort_keys=True).encode(), **{n: files[n] for n in sorted(files)}}
    with tarfile.open(path, "x") as t:
        for name, data in members.items():
            _safe_member(name)
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return digests


def read_bundle(path: str) -> dict[str, bytes]:
    """The files of such an archive, after checking each against the manifest;
    links, unsafe, unlisted and missing members are errors."""
    with tarfile.open(path) as t:
        members = t.getmembers()
        for m in members:
            _safe_member(m.name)
            if not m.isfile():
                raise ContractError(f"unsafe member {m.name}")
        data = {m.name: t.extractfile(m).read() for m in members}
    want = json.loads(data.pop("manifest.json", b"null"))
    if want is None or set(want) != set(data) or any(hashlib.sha256(data[n]).hexdigest() != d for n, d in want.items()):
        raise ContractError(f"{path} doesn't match its manifest")
    return data


def verify_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, problem) of files against a manifest (path, sha256): changed,
    missing or not listed.  Only listed files are read."""
    there = _folder_files(spark, folder)
    listed = manifest.select(F.col("path").alias("__name"), F.lower("sha256").alias("sha256"))
    wanted = there.join(listed.select("__name"), "__name")
    names = [r[0] for r in wanted.select("__path").distinct().limit(NAMED + 1).collect()]
    reader = spark.read.format("binaryFile")
    whole = reader.option("recursiveFileLookup", "true").load(folder) if len(names) > NAMED else reader.load(names) if names else None
    found = whole.select(F.col("path").alias("__path"), F.sha2("content", 256).alias("found")) if whole is not None else spark.createDataFrame([], "__path string, found string")
    both = there.join(found, "__path", "left").join(listed, "__name", "full_outer")
    problem = F.when(F.col("__path").isNull(), "missing").when(F.col("sha256").isNull(), "not_listed").when(F.col("found") != F.col("sha256"), "changed")
    return both.select(F.col("__name").alias("path"), problem.alias("problem")).filter("problem is not null")


def select_commits(commits: DataFrame, at: str, since: str | None = None, until: str | None = None, most: int | None = None, parents: str | None = None) -> DataFrame:
    """The commits of a scan: at or after since, before until, without merges if
    parents names the column of parent ids (an array), and of these the latest
    most (of equal times by all columns)."""
    out = commits
    if since is not None:
        out = out.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col(at) < F.lit(until).cast("timestamp"))
    if parents is not None:
        out = out.filter(F.size(F.coalesce(F.col(parents), F.array().cast("array<string>"))) < 2)
    if most is not None:
        out = out.orderBy(F.desc(at), *sorted(c for c in commits.columns if c != at)).limit(most)
    return out


def parse_commits(log: DataFrame, block: str) -> DataFrame:
    """(commit, parents, dev, at, message, diff) from blocks of a commit scan: a
    header line commit|parents|author|seconds, the message, and, from the first
    file header on, the unified diff."""
    head = F.split(F.substring_index(block, "\n", 1), r"\|")
    body = F.regexp_replace(block, r"(?s)^[^\n]*\n?", "")
    message = F.regexp_extract(body, r"(?s)^(.*?)(?=(?m:^)diff --git |\z)", 1)
    diff = F.substring(body, F.length(message) + 1, F.length(body))
    return log.select(
        head[0].alias("commit"), F.filter(F.split(head[1], " "), lambda x: x != "").alias("parents"), head[2].alias("dev"), head[3].try_cast("bigint").alias("at"),
        F.regexp_replace(message, r"\s+$", "").alias("message"), F.regexp_replace(diff, r"\n+$", "").alias("diff"),
    )


def parse_numstat(log: DataFrame, block: str) -> DataFrame:
    """(commit, dev, at, file, added, deleted) from blocks of a numstat log, each
    a header line commit|author|seconds and lines of added, deleted and path
    separated by tabs.  Binary files have 0 lines; a rename gives its new path."""
    part = F.split(block, "\n")
    head = F.split(part[0], r"\|")
    rows = log.select(head[0].alias("commit"), head[1].alias("dev"), head[2].cast("bigint").alias("at"), F.explode(F.slice(part, 2, F.size(part))).alias("line")).filter(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    cell = F.split("line", "\t", 3)
    number = lambda i: F.coalesce(cell[i].try_cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select("commit", "dev", "at", X.renamed_to(cell[2]).alias("file"), number(0).alias("added"), number(1).alias("deleted"))


PATCH_LINES = "commit string, file string, op string, line_order int, text string"


def parse_patches(log: DataFrame, identity: str, patch: str) -> DataFrame:
    """(commit, file, op, line_order, text) of the changed lines of unified
    patches.  Lines count inside hunks only; a deleted file keeps its old name.
    Each patch is read once from top to bottom, so this runs over Arrow batches."""

    def lines(text: str) -> Iterator[tuple[str, str, str]]:
        file, inside = None, False
        for line in text.split("\n"):
            if line.startswith("diff --git "):
                file, inside = None, False
            elif line.startswith("@@"):
                inside = file is not None
            elif not inside and line[:6] in ("+++ b/", "--- a/"):
                file = line[6:]
            elif inside and line[:1] == "+":
                yield file, "add", line[1:]
            elif inside and line[:1] == "-":
                yield file, "delete", line[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for commit, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(commit, f, op, k, t) for k, (f, op, t) in enumerate(lines(text or ""))]
            if out:
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["commit", "file", "op", "line_order", "text"])

    return log.select(F.col(identity).cast("string"), F.col(patch).cast("string")).mapInArrow(run, PATCH_LINES)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """The run records of a catalogue (one JSON document each): for every
    variant and seed the one that finished last; two finished runs of the same
    time are an error."""
    runs = read_json(spark, pattern).filter("status = 'finished'")
    latest = runs.groupBy("variant_id", "seed").agg(F.max("finished_at").alias("finished_at"))
    last = runs.join(latest, ["variant_id", "seed", "finished_at"])
    require_empty(repeated_keys(last, "variant_id", "seed"), "two runs of one variant and seed")
    return last


def synthetic_changes(spark: SparkSession, n: int) -> DataFrame:
    """n made-up changes, one a day, for demonstrations: pairs share a group and
    the label follows from the id."""
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86_400)
    key = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).select(
        F.format_string("demo:%016x", "id").alias("change_id"), F.concat(F.lit("group-"), F.floor(F.col("id") / 2).cast("string")).alias("group_id"), day.alias("prediction_at"), (day + F.expr("interval 2 days")).alias("label_available_at"),
        F.pmod(F.conv(F.substring(key, 1, 2), 16, 10).cast("int"), F.lit(2)).alias("label"), F.lit(True).alias("synthetic"),
    )
