"""Report tables and other delimited files."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.labels import lenient_double
from ..operators.frames import compute_once, drop_columns
from ..schemas import ESCALATE, NO_ESCALATE, REPORTS, UNTRAINED_COLUMNS
from .headers import first_lines

# Names of the known dataset versions, delimiters in order of preference, and the
# id spellings that are unified when folders are read.
DATASETS = ("v1 - ambiguous", "v1 - clear", "v2")
ENCODING = "ISO-8859-1"
DELIMITERS = ("\t", ";", ",")
ID_SPELLINGS = {"Accident_Id": "Num_Acc", "accident_id": "Num_Acc"}


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: StructType = REPORTS, multi_line: bool = True
) -> DataFrame:
    """CSV with header; columns are taken by name from ``schema``.

    ``multi_line`` allows quoted line breaks, for which one task reads a file; without it large files are split.
    """
    return spark.read.csv(
        paths if isinstance(paths, str) else list(paths),
        schema=schema,
        header=True,
        multiLine=multi_line,
        escape='"',
        enforceSchema=False,
    )


def read_reports(spark: SparkSession, version: str, registry: Mapping[str, str], schema: StructType = REPORTS) -> DataFrame:
    """Report table of a dataset version; ``registry`` maps versions to paths."""
    if version not in registry:
        raise ValueError(f"unknown dataset version: {version!r}; known: {sorted(registry)}")
    return read_csv(spark, registry[version], schema)


def read_runs(spark: SparkSession, paths: Sequence[str] | str, schema: StructType | None = None, multi_line: bool = True) -> dict[str, DataFrame]:
    """One DataFrame per run file, each row marked with its ``run_id`` (the path).

    Without a schema all columns are read as text.
    """
    found = {}
    for path in [paths] if isinstance(paths, str) else paths:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        df = reader.schema(schema).csv(path) if schema else reader.csv(path)
        found[path] = df.withColumn("run_id", F.lit(path))
    return found


def union_runs(runs: Mapping[str, DataFrame]) -> DataFrame:
    """All runs in one table; columns missing from a run are null."""
    out = None
    for df in runs.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs to read")
    return out


def delimiter_of(header: str) -> str:
    """First of tab, semicolon, comma that occurs in the header line."""
    for delimiter in DELIMITERS:
        if delimiter in header:
            return delimiter
    raise ValueError(f"unknown delimiter in header: {header!r}")


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines (``value``, decoded) of all files."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return raw.select(F.decode(F.col("value").cast("binary"), ENCODING).alias("value"))


def _read_dialect(spark: SparkSession, paths: str | Sequence[str], header: str) -> DataFrame:
    """Latin-1 lines as columns of texts named by ``header``.

    A short line is filled with nulls, a line with more fields than the header is skipped, and so are lines
    that repeat the header; an empty field is null.  All fields are parsed before any is chosen, so the rows do not depend
    on the columns that are used.  Quoted fields may hold delimiters and doubled quotes, but no
    line breaks; a line with an open quote is skipped.
    """
    delimiter = delimiter_of(header)
    names = next(csv.reader([header], delimiter=delimiter))
    # A mark after the last field tells how many fields there are, empty ones included.
    fields, mark = [f"_{i}" for i in range(len(names) + 1)], "\x02"
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    lines = _lines(spark, paths).where((F.col("value") != header) & (F.trim("value") != ""))
    row = F.from_csv(F.concat("value", F.lit(delimiter + mark)), ", ".join(f"{f} string" for f in fields), options)
    parsed = compute_once(lines, {"_row": row})
    fits = F.array_contains(F.array(*[F.col("_row")[f] for f in fields]), mark)
    return parsed.where(fits).select(*[F.nullif(F.col("_row")[f], F.lit(mark)).alias(n) for f, n in zip(fields, names)])


def decimal_comma(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers written with a decimal comma as doubles; other texts become null."""
    return df.withColumns({c: lenient_double(F.regexp_replace(F.trim(F.col(c)), ",", ".")) for c in columns})


def read_csv_dialect(spark: SparkSession, path: str, numeric: Sequence[str] = ()) -> DataFrame:
    """Latin-1 file, or files with one header, with sniffed delimiter; ``numeric`` uses decimal commas."""
    headers = set(header_lines(spark, path).values())
    if len(headers) != 1:
        raise ValueError(f"{len(headers)} different headers in {path}; use read_folder")
    df = _read_dialect(spark, path, headers.pop())
    return decimal_comma(df, [c for c in numeric if c in df.columns])


def fix_single_column(df: DataFrame) -> DataFrame:
    """Unpack a table that was read as one column although its header holds several names.

    Missing fields become null, surplus fields are dropped; other tables are returned as they are.
    """
    if len(df.columns) != 1:
        return df
    header = df.columns[0]
    delimiter = next((d for d in (",", "\t") if d in header), None)
    if delimiter is None:
        return df
    pieces: Column = F.split(F.col(f"`{header}`").cast("string"), delimiter)
    names = [n.strip() for n in header.split(delimiter)]
    return unify_ids(df.select(*[F.get(pieces, i).alias(n) for i, n in enumerate(names)]))


def unify_ids(df: DataFrame, spellings: Mapping[str, str] = ID_SPELLINGS) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in spellings.items() if old in df.columns})


def header_lines(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, str]:
    """First line of every file below ``paths``, in one job that reads no further; files without lines are left out."""
    return {unquote(r["path"]): bytes(r["line"]).decode(ENCODING) for r in first_lines(spark, paths).collect()}


def read_folder(spark: SparkSession, folder: str, numeric: Sequence[str] = ()) -> DataFrame:
    """All files of a folder as one table.

    Files are grouped by header line, so each dialect is read by one scan whatever the number of
    files; id spellings are unified and columns missing from a dialect are null.
    """
    by_header: dict[str, list[str]] = {}
    for path, header in sorted(header_lines(spark, folder).items()):
        by_header.setdefault(header, []).append(path)
    out = None
    for header, paths in by_header.items():
        df = unify_ids(fix_single_column(_read_dialect(spark, paths, header)))
        df = decimal_comma(df, [c for c in numeric if c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files in {folder}")
    return out


def read_prepared(
    spark: SparkSession,
    path: str,
    drop: Sequence[str] = UNTRAINED_COLUMNS,
    numeric: Sequence[str] = ("confidence", "n_risk_factors", "n_missing_information"),
    strict: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Processed signals for training: unused columns dropped, features as doubles, ``label`` 0/1.

    A truth text outside the two labels gives a null label here; evaluation rejects it.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    df = drop_columns(df, drop, strict)
    truth = F.col("expected_action")
    label = F.when(truth == ESCALATE, F.lit(1)).when(truth == NO_ESCALATE, F.lit(0))
    return df.withColumns({**{c: lenient_double(c) for c in numeric}, "label": label}).drop("expected_action")
