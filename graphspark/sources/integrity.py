"""Locks, registers, strict JSON and archives: sources that check what they read."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_path

LOCK = r"^([0-9a-f]{64})  (\S.*)$"


def scan_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, content and sha256 of files below a root with one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lstrip(".") for e in extensions]))
    return kept.select("path", "content", F.sha2("content", 256).alias("sha256"))


def parse_lock(lines: DataFrame, column: str = "value") -> DataFrame:
    """sha, path and fault of each line of a lock: malformed, unsafe, duplicate or null."""
    line = F.col(column)
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$")).select(F.regexp_extract(line, LOCK, 1).alias("sha"), F.regexp_extract(line, LOCK, 2).alias("path"))
    twice = rows.groupBy("path").agg(F.count("*").alias("n"))
    return rows.join(twice, "path").select("sha", "path", F.when(F.col("sha") == "", "malformed").when(~safe_path(F.col("path")), "unsafe").when(F.col("n") > 1, "duplicate").alias("fault"))


def check_lock(lock: DataFrame, files: DataFrame) -> DataFrame:
    """path and state (missing, unexpected, changed) of all that differs; files: path, sha256."""
    j = lock.select("path", "sha").join(files.select("path", "sha256"), "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha").isNull(), "unexpected").when(F.col("sha") != F.col("sha256"), "changed")
    return j.select("path", state.alias("state")).where("state IS NOT NULL")


def render_lock(files: DataFrame) -> DataFrame:
    """One line per file in the order of paths."""
    return files.select("path", "sha256").orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def bound_content(files: DataFrame, lock: DataFrame) -> DataFrame:
    """Contents whose hash is the locked one; any other fails the query."""
    j = files.join(lock.select("path", "sha"), "path")
    ok: Column = F.when(F.col("sha256") == F.col("sha"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("hash differs: "), "path")).cast("binary"))
    return j.select("path", ok.alias("content"))


def strict_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """value and fault: JSON with a key twice, or with NaN or an infinity, is a fault."""

    def refuse(pairs: list[tuple[str, object]]) -> dict:
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError("duplicate key")
        return dict(pairs)

    def no_constant(name: str) -> None:
        raise ValueError(f"constant {name}")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            faults = []
            for text in batch["value"]:
                try:
                    json.loads(text, object_pairs_hook=refuse, parse_constant=no_constant)
                    faults.append(None)
                except (ValueError, TypeError) as e:
                    faults.append("duplicate key" if "duplicate" in str(e) else "constant" if "constant" in str(e) else "malformed")
            yield batch.assign(fault=faults)

    return texts.select(F.col(column).alias("value")).mapInPandas(check, "value string, fault string")


def exact_keys(text: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no other."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def zip_members(files: DataFrame) -> DataFrame:
    """archive, member, size and sha256 of every member of zip archives (path, content)."""
    import hashlib

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        data = z.read(info)
                        rows.append((path, info.filename, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256"])

    return files.select("path", "content").mapInPandas(members, "archive string, member string, size long, sha256 string")


def id_list(column: Column) -> Column:
    """Ids of a register cell, parted by semicolons, commas, bars or space."""
    return F.filter(F.split(column, r"[;,|\s]+"), lambda x: x != "")


def register_faults(register: DataFrame, key: str, refs: str, known: DataFrame) -> DataFrame:
    """fault, id and ref: ids found twice, and references to none of ``known`` (column id)."""
    twice = register.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("fault"), "id", F.lit(None).cast("string").alias("ref"))
    used = register.select(F.col(key).alias("id"), F.explode(id_list(F.col(refs))).alias("ref"))
    lost = used.join(known.select(F.col("id").alias("ref")), "ref", "left_anti").select(F.lit("unknown reference").alias("fault"), "id", "ref")
    return twice.unionByName(lost)


def decoded(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``text``: bytes as UTF-8; of bytes that aren't, those that don't fit are
    passed over."""

    def lenient(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    slow = F.pandas_udf(lenient, "string")
    fine = F.col(column).cast("string")
    # only bytes that aren't valid leave the engine
    good = rows.where(F.is_valid_utf8(fine)).withColumn("text", fine)
    return good.unionByName(rows.where(~F.is_valid_utf8(fine)).withColumn("text", slow(F.col(column))))


def csv_rows(lines: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """Cells of CSV lines as strings; a quote within a quoted cell is written twice."""
    cells = F.from_csv(F.col(column), ", ".join(f"`{n}` string" for n in names), {"escape": '"'})
    return lines.select(cells.alias("_c")).select("_c.*")


def scoped(files: DataFrame, lock: DataFrame, scope: str) -> DataFrame:
    """Files (path) of a scope: book is what the lock names, archive what it doesn't, all both."""
    if scope == "all":
        return files
    if scope not in ("book", "archive"):
        raise ValueError(f"unknown scope {scope}")
    return files.join(lock.select("path").distinct(), "path", "left_semi" if scope == "book" else "left_anti")


def union_by_path(formal: DataFrame, optional: DataFrame) -> DataFrame:
    """path and sha256 of both, one row a path: a hash stands above none, and two hashes of
    one path fail the query."""
    both = formal.select("path", "sha256").unionByName(optional.select("path", "sha256"))
    one = both.groupBy("path").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("_other"))
    same = F.when(F.col("sha256") == F.col("_other"), F.col("sha256")).when(F.col("_other").isNull(), None)
    return one.select("path", same.otherwise(F.raise_error(F.concat(F.lit("conflicting hashes: "), F.col("path").cast("string"))).cast("string")).alias("sha256"))
