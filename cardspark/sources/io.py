"""Sources and sinks (IO2 to IO8)."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import truncate_material
from .shared import written

SKIPPED_DIRS = (".obsidian", ".trash", ".git", "node_modules")
MOST_LEVELS, MOST_BYTES = 8, 2**20  # of notes
FILES_A_TASK, BYTES_A_TASK = 1024, 2**24  # about, that are read in one task
#: Extensions that are read as text.
TEXT_EXTENSIONS = "txt md markdown json yaml yml xml csv html css js jsx ts tsx py java go rs c cc cpp h hpp cs rb php swift kt scala sh sql toml ini vue svelte dart lua r m proto graphql".split()


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def _path(url: Column) -> Column:
    """Without scheme and host, which a root and the paths below it may spell differently."""
    return F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of a folder that driver and executors mount; None for one in a store."""
    if not root.startswith("file:") and ("://" in root or not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")):
        return None
    return os.path.abspath(re.sub(r"^file:(//)?", "", root))


def _entries(batches: Iterator[pa.RecordBatch], base: bytes) -> Iterator[pa.RecordBatch]:
    """Folders, relative to base -> the folders and notes in them."""
    schema = pa.schema([("folder", pa.bool_()), ("at", pa.binary()), ("length", pa.int64()), ("mtime_ms", pa.int64())])

    def found() -> Iterator[tuple]:
        for at in (at for batch in batches for at in batch.column("at").to_pylist()):
            with os.scandir(os.path.join(base, at)) as entries:
                for e in entries:
                    if e.name.startswith(b".") or e.name.decode("utf-8", "replace") in SKIPPED_DIRS:
                        continue
                    if e.is_dir():
                        yield True, os.path.join(at, e.name), None, None
                    elif e.name.lower().endswith(b".md") and e.is_file() and 1 <= (st := e.stat()).st_size <= MOST_BYTES:
                        yield False, os.path.join(at, e.name), st.st_size, st.st_mtime_ns // 10**6

    for some in batched(found(), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _contents(batches: Iterator[pa.RecordBatch], base: bytes) -> Iterator[pa.RecordBatch]:
    """Adds the files' contents, some 8 MB at a time."""
    for batch in batches:
        first, held, contents = 0, 0, []
        for i, at in enumerate(batch.column("at").to_pylist(), 1):
            with open(os.path.join(base, at), "rb") as f:
                contents.append(f.read())
            held += len(contents[-1])
            if held >= 2**23 or i == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.slice(first, i - first).columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                first, held, contents = i, 0, []


def _walked(spark: SparkSession, base: str, most: int | None) -> DataFrame:
    """Notes below a mounted folder. Folders are listed level by level, and files then read, in tasks; the driver sees neither."""
    root, levels = os.fsencode(base), []
    folders = spark.createDataFrame([(b"",)], "at binary")
    for _ in range(MOST_LEVELS + 1):
        level = written(folders.mapInArrow(lambda b: _entries(b, root), "folder boolean, at binary, length bigint, mtime_ms bigint"))
        levels.append(level.where("not folder").drop("folder"))
        folders = level.where("folder").select("at")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(min(n, 1024))
    files = reduce(DataFrame.unionByName, levels)
    files = files if most is None else files.orderBy("at").limit(most)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-n // FILES_A_TASK), -(-size // BYTES_A_TASK))
    rows = files.repartition(tasks, "at").mapInArrow(lambda b: _contents(b, root), "at binary, length bigint, mtime_ms bigint, content binary")
    return rows.withColumn("rel_path", F.col("at").cast("string"))


def _stored(spark: SparkSession, root: str, most: int | None) -> DataFrame:
    """Notes below a folder that Spark's readers alone reach; they leave out names that start with `_`, too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = spark.createDataFrame([(root,)], "r string").select(F.regexp_replace(_path(F.col("r")), r"/+\z", "").alias("r"))
    rows = files.join(F.broadcast(where)).withColumn("p", _path(F.col("path"))).withColumn("rel_path", F.expr("substring(p, locate(r, p) + length(r) + 1)"))  # where: one row
    parts = F.split("rel_path", "/")
    rows = rows.where(F.lower("rel_path").endswith(".md") & F.col("length").between(1, MOST_BYTES) & (F.size(parts) - 1 <= MOST_LEVELS) & ~F.exists(parts, lambda x: x.startswith(".") | x.isin(*SKIPPED_DIRS)))
    rows = rows if most is None else rows.orderBy("rel_path").limit(most)
    return rows.withColumn("mtime_ms", F.unix_millis("modificationTime"))


def scan_notes(spark: SparkSession, root: str, most: int | None = 1000) -> DataFrame:
    """IO2: markdown notes below a folder: rel_path, size, size_kb, mtime_ms, raw. Hidden and tool folders, more than eight levels, and files over 1 MiB are left out; the first `most` by path, None: all."""
    base = _mounted(spark, root)
    rows = _walked(spark, base, most) if base else _stored(spark, root, most)
    return rows.select("rel_path", F.col("length").alias("size"), F.greatest(F.lit(1), F.round(F.col("length") / 1024)).cast("int").alias("size_kb"), "mtime_ms", F.col("content").cast("string").alias("raw"))


def select_files(files: DataFrame, most: int = 30, max_bytes: int = 50 * 2**20) -> DataFrame:
    """IO3: files(folder, name, size, depth, content) -> one text per folder of its first files that may be read."""
    ok = extension(F.col("name")).isin(*TEXT_EXTENSIONS) & ~F.col("name").startswith(".") & (F.col("depth") <= 5) & (F.col("size") < max_bytes)
    rows = files.where(ok).withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy("name"))).where(F.col("n") <= most)
    part = F.struct("n", F.concat(F.lit("### "), F.col("name"), F.lit("\n"), F.col("content"), F.lit("\n")).alias("t"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("text"))


def archive_text(files: DataFrame, most: int = 30, max_bytes: int = 50 * 2**20) -> DataFrame:
    """IO4: files(path, content) -> path, text, error, of zip archives and slide decks; slides follow each other by name."""

    def one(path: str, content: bytes) -> tuple[str | None, str | None]:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            return None, "not an archive"
        if path.lower().endswith(".pptx"):
            slides = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
            text = "\n".join(" ".join(re.findall(r"<a:t>([^<]*)</a:t>", z.read(n).decode("utf-8", "replace"))) for n in slides)
            return (None, "no text") if len(text.strip()) < 10 else (text, None)
        names = [i.filename for i in z.infolist() if not i.is_dir() and i.filename.rsplit(".", 1)[-1].lower() in TEXT_EXTENSIONS and i.file_size < max_bytes][:most]
        return "".join(f"### {n}\n{z.read(n).decode('utf-8', 'replace')}\n" for n in names), None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, *one(p, c)) for p, c in part.itertuples(index=False, name=None)], columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def repo_digest(repos: DataFrame, commits: DataFrame, files: DataFrame, most_commits: int = 30, most_files: int = 10, limit: int = 8000) -> DataFrame:
    """IO5: repos(repo, description, language, readme), commits(repo, at, message), files(repo, path, content) -> one text per repository."""
    line = F.split("message", "\n")[0]
    c = commits.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), "message"))).where(F.col("n") <= most_commits)
    c = c.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    f = files.where(extension(F.col("path")).isin(*TEXT_EXTENSIONS) & (F.octet_length("content") < 50_000)).withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where(F.col("n") <= most_files)
    body = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.substring("content", 1, limit))
    f = f.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("b")))), lambda x: x["b"]), "\n").alias("blobs"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.col("repo")), "description", "language", "readme")
    return repos.join(c, "repo", "left").join(f, "repo", "left").select("repo", truncate_material(F.concat_ws("\n\n", head, "log", "blobs")).alias("text"))


EVENT = "struct<session_id:string,seq:bigint,ts:timestamp,type:string,text:string,role:string>"


def speech_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """IO6: one JSON event a line; lines that do not parse or have no type are dropped; the role is self by default."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    rows = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("type is not null")
    return rows.withColumn("role", F.coalesce("role", F.lit("self")))


def write_notes(notes: DataFrame, root: str) -> None:
    """IO7: notes(project, filename, content) as text files under root/project=../filename=..; other files stay as they are."""
    notes.select("project", "filename", F.col("content").alias("value")).write.mode("append").partitionBy("project", "filename").option("lineSep", "\n").text(root)


def write_files(files: DataFrame, root: str) -> None:
    """files(rel_path, content) as files of these names below a folder that all executors mount; each is written aside and then renamed, so a task that runs again leaves whole files."""
    base = re.sub(r"^file:(//)?", "", root.rstrip("/"))
    if "://" in base:
        raise ValueError("files of given names need a mounted folder")

    def put(rows) -> None:
        there = set()
        for rel_path, content in rows:
            path = f"{base}/{rel_path}"
            folder = os.path.dirname(path)
            if folder not in there:
                os.makedirs(folder, exist_ok=True)
                there.add(folder)
            aside = f"{folder}/.{uuid.uuid4().hex}.part"
            with open(aside, "wb") as f:
                f.write((content or "").encode())
            os.replace(aside, path)

    files.select("rel_path", "content").foreachPartition(put)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """IO8: rows of updates replace those of target with equal keys or join them; columns in keep stay as target has them."""
    u = updates.select(*[F.col(k).alias(k) for k in keys], F.struct(*updates.columns).alias("_u"))
    t = target.select(*[F.col(k).alias(k) for k in keys], F.struct(*target.columns).alias("_t"))
    rows = t.join(u, keys, "full")
    new = lambda c: F.coalesce(F.col("_t")[c], F.col("_u")[c]) if c in keep else F.when(F.col("_u").isNotNull(), F.col("_u")[c]).otherwise(F.col("_t")[c])
    return rows.select(*[(F.col(c) if c in keys else new(c)).alias(c) for c in target.columns])
