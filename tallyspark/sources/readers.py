"""Readers. Files are read as text columns; types are decided by the operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as tx, web
from tallyspark.operators import ingest, register
from tallyspark.sources import resolve

ENCODINGS = ["UTF-8", "ISO-8859-1"]
#: Columns that say where a row stands.
PLACE = ("file_name", "row_pos")


def _literal(file_path: str) -> str:
    """A path as Spark reports it, as a pattern that matches this file alone."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(file_path))


def header_groups(spark: SparkSession, path: str, by: dict[str, str] | None = None) -> list[tuple[str, bool, list[str]]]:
    """Files below `path` that begin with the same line, as (value of `by`, whether that line is the whole header, patterns), by their first path.

    One scan of text lines that keeps a line a file. A header with a line break inside quotes makes its file a group of
    its own. Files without a line are left out. `by` splits groups further, by file (a missing file: an empty value).
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("row"), "value")
    first = lines.filter((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "row").alias("header"))
    groups: dict[tuple, list[str]] = {}
    for r in first.orderBy("file").collect():  # a row a file: no more than Spark's own list of files
        own = r["file"] if r["header"].count('"') % 2 else ""
        groups.setdefault((r["header"], own, (by or {}).get(r["file"], "")), []).append(_literal(r["file"]))
    return [(encoding, not own, files) for (_, own, encoding), files in groups.items()]


def _read(spark: SparkSession, files: str | list[str], encoding: str, multi_line: bool, one_line_header: bool = False) -> DataFrame:
    def reader(lines: bool):
        options = {"header": True, "inferSchema": False, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": lines}
        return spark.read.options(**options)

    if multi_line and one_line_header:  # names from the first line alone; Spark's own look at a file of many lines takes its name for a pattern
        raw = reader(True).schema(reader(False).csv(files[:1]).schema).csv(files)
    else:
        raw = reader(multi_line).csv(files)
    # rows of a block are read in order, so the running number orders them inside it
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    # a file's own columns of these names get another one
    own = [F.col(f"`{c}`").alias(f"{c} (file)" if c.lower() in PLACE else c) for c in raw.columns]
    return raw.select(*own, F.col("_metadata.file_name").alias("file_name"), place.alias("row_pos"))


def delimited_groups(spark: SparkSession, path: str, encoding: str | dict[str, str] = "UTF-8", multi_line: bool = True) -> list[tuple[list[str], DataFrame]]:
    """(files, rows) for each header below `path`: files with other columns, or the same in another order, are read apart."""
    usual = encoding if isinstance(encoding, str) else ENCODINGS[0]
    groups = header_groups(spark, path, None if isinstance(encoding, str) else encoding)
    return [(files, _read(spark, files, own or usual, multi_line, whole)) for own, whole, files in groups] or [([path], _read(spark, path, usual, multi_line))]


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_delimited(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Delimited files with header, all columns as strings, plus `file_name` and `row_pos`.

    Each file's columns go by its own header; a column that a file doesn't have is null in its rows. A cell in quotes may
    hold line breaks; files are then the unit of parallelism. Large files without such cells can be split with
    `multi_line=False`. `row_pos` sorts by path of the file, block and row, however Spark packs the files.
    """
    rows = _together([part for _, part in delimited_groups(spark, path, encoding, multi_line)])
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in PLACE], *PLACE)


def _by_header(groups: list[tuple[list[str], DataFrame]], columns: Callable[[DataFrame], dict], needed: tuple[str, ...], rows: Callable[[DataFrame], DataFrame],
               keep: tuple[str, ...]) -> DataFrame:
    """`rows` of each group under the columns that its own header gives; a file without a needed column is named in the error."""
    parts = []
    for files, raw in groups:
        names = ", ".join(files[:3]) + (f" and {len(files) - 3} more" if len(files) > 3 else "")
        try:
            mapping = columns(raw)
        except ValueError as error:
            raise ValueError(f"{names}: {error}") from error
        missing = [f for f in needed if not mapping.get(f)]
        if missing:
            raise ValueError(f"{names}: no column for {', '.join(missing)} among {[c for c in raw.columns if c not in PLACE]}")
        parts.append(rows(resolve.select_resolved(raw, mapping, keep)))
    return _together(parts)


def _broken(spark: SparkSession, path: str) -> DataFrame:
    """Files below `path` with bytes that the first encoding doesn't have."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), ~F.is_valid_utf8("value") | F.contains("value", F.lit("\ufffd")))
    return lines.toDF("file", "broken").filter("broken").select("file").distinct()


def pick_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that every file below `path` is valid in; the last one decodes every byte.

    A clean file is read to its end for this; large sources name their encoding instead.
    """
    return ENCODINGS[1] if _broken(spark, path).limit(1).count() else ENCODINGS[0]


def read_ledger(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Ledger rows; header and encoding are found for each file."""
    found = encoding or {r["file"]: ENCODINGS[1] for r in _broken(spark, path).collect()}
    groups = delimited_groups(spark, path, found)
    return _by_header(groups, lambda raw: resolve.resolve_ledger(raw.drop(*PLACE)), ("memo",), ingest.ledger_rows, ("row_pos",))


def _header(columns: Callable[[list[str]], dict], *apart: str | None) -> Callable[[DataFrame], dict]:
    return lambda raw: columns([c for c in raw.columns if c not in {*PLACE, *apart}])


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    groups = delimited_groups(spark, path)
    rows = _by_header(groups, _header(resolve.bank_columns), ("date", "description"), ingest.bank_csv_rows, ("row_pos", "file_name"))
    return rows.withColumn("bank", web.bank_from_file_name(F.col("file_name")))


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    return _by_header(delimited_groups(spark, path), _header(resolve.tabular_columns), ("description",), ingest.tabular_rows, ("row_pos",))


def read_coa(spark: SparkSession, path: str) -> DataFrame:
    return ingest.coa_rows(read_delimited(spark, path).drop(*PLACE))


def _register_rows(spark: SparkSession, path: str, client: str | None) -> DataFrame:
    keep = ("row_pos",) if client is None else ("row_pos", client)
    rows = _by_header(delimited_groups(spark, path), _header(resolve.register_columns, client), (), lambda raw: raw, keep)
    for field in register.INFO:
        if field not in rows.columns:
            rows = rows.withColumn(field, F.lit(None).cast("string"))
    return rows.withColumn("client_id", F.lit(0) if client is None else F.col(client).cast("int"))


def read_register(spark: SparkSession, path: str, client: str | None = None) -> DataFrame:
    """One row per normalised check number; a later row replaces an earlier one."""
    return register.register_by_check(_register_rows(spark, path, client))


def read_check_payees(spark: SparkSession, path: str, client: str | None = None) -> DataFrame:
    return register.check_payees(_register_rows(spark, path, client))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text lines without NUL characters; every kind of line end separates lines. A line that is not UTF-8 is read as ISO-8859-1."""
    raw = F.col("value")
    decoded = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(raw.cast("binary"), ENCODINGS[1]))
    return spark.read.text(path).select(F.regexp_replace(decoded, "[\\u0000\\r]", "").alias("value"))


def read_rules(spark: SparkSession, path: str, client_id: int) -> DataFrame:
    """Rules of one client; the filter prunes partitions."""
    return spark.read.parquet(path).filter(F.col("client_id") == client_id)


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_delimited(spark, path).drop(*PLACE)
    filled = F.coalesce(*[tx.blank_to_null(F.col(f"`{c}`")) for c in raw.columns]).isNotNull()
    return raw.filter(filled)
