"""CSV folder -> canonical tables.

Only file names, one header line and a one-row profile per file reach the
driver; the rows are typed lazily by Spark.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bazaarlens.functions.text import slug_name
from bazaarlens.sources.quoted_lines import read_quoted
from bazaarlens.sources.specs import TABLES, TableSpec

log = logging.getLogger(__name__)

DELIMITERS = (",", ";", "\t", "|")
DEFAULT_FOLDERS = ("bases", "data")

# Cell texts read as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Date layouts accepted besides ISO 8601.
DATE_LAYOUTS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class FileProfile:
    encoding: str
    delimiter: str
    multiline: bool


@dataclass(frozen=True)
class LoadedTable:
    name: str
    path: str
    profile: FileProfile
    data: DataFrame


# ---------------------------------------------------------------- discovery
def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """CSV paths directly under ``folder`` on any Hadoop file system; none if there is no such folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
    try:
        found = files.load(folder).select("path").collect()  # names alone: no content is read
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["path"] for r in found)


def find_folder(spark: SparkSession, root: str, candidates: tuple[str, ...] = DEFAULT_FOLDERS) -> str:
    """First candidate folder under ``root`` that holds a CSV file."""
    for name in candidates:
        folder = f"{root.rstrip('/')}/{name}"
        if list_csv(spark, folder):
            return folder
    raise FileNotFoundError(f"no CSV file under {root} in any of {', '.join(candidates)}")


def _base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def assign_files(paths: list[str], specs: tuple[TableSpec, ...] = TABLES) -> dict[str, str]:
    """Table name -> file. Shortest file name wins, then the alphabet; no file serves twice."""
    free = list(paths)
    chosen: dict[str, str] = {}
    for spec in specs:
        fitting = []
        for path in free:
            stem = slug_name(_base_name(path).rsplit(".", 1)[0])
            if all(t in stem for t in spec.file_has) and not any(t in stem for t in spec.file_lacks):
                fitting.append(path)
        if fitting:
            best = min(fitting, key=lambda p: (len(_base_name(p)), _base_name(p)))
            chosen[spec.name] = best
            free.remove(best)
    return chosen


# ------------------------------------------------------------------ reading
def profile_file(spark: SparkSession, path: str) -> FileProfile:
    """Encoding, delimiter and quoted line breaks, from one splittable pass.

    A file that is not valid UTF-8 throughout is read as ISO-8859-1. A line with
    an odd number of quotes can mean that some field holds a line break; only then are
    lines joined to records before they are parsed.
    """
    lines = spark.read.text(path)
    header = lines.first()
    text = header["value"] if header else ""
    delimiter = max(DELIMITERS, key=text.count) if any(d in text for d in DELIMITERS) else ","
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    facts = lines.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("multiline"),
    ).first()
    return FileProfile("UTF-8" if facts["utf8"] else "ISO-8859-1", delimiter, facts["multiline"])


def read_raw(spark: SparkSession, path: str, profile: FileProfile) -> DataFrame:
    """Every column as text, header names as found (the UTF-8 mark is dropped).

    Of a file with quoted line breaks the multi-line reader gives the header only; the rows come from splits.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", profile.delimiter)
        .option("encoding", profile.encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", profile.multiline)
        .option("mode", "PERMISSIVE")
    )
    df = reader.csv(path)
    return read_quoted(spark, path, df.columns, profile.delimiter, profile.encoding) if profile.multiline else df


def rename_headers(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Slug the headers, then map accepted aliases to canonical names.

    A canonical name already present wins; otherwise the first alias found does.
    """
    df = df.toDF(*[slug_name(name.lstrip("﻿")) for name in df.columns])
    present = set(df.columns)
    renames = {}
    for canonical, aliases in spec.aliases.items():
        if canonical in present:
            continue
        alias = next((a for a in aliases if a in present), None)
        if alias is not None:
            renames[alias] = canonical
            present = present - {alias} | {canonical}
    return df.withColumnsRenamed(renames) if renames else df


def _known(value: Column) -> Column:
    return F.when(~value.isin(*MISSING_TEXTS), value)


def parse_date(value: Column) -> Column:
    """Timestamp without zone; what cannot be read becomes null."""
    text = F.trim(value)
    iso = text.try_cast("timestamp_ntz")
    others = [F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in DATE_LAYOUTS]
    return F.coalesce(iso, *others)


def parse_number(value: Column) -> Column:
    text = F.trim(value)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def type_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared dates plus any column named like one; declared numbers; the rest stays text."""
    typed = []
    for name in df.columns:
        value = _known(F.col(name))
        if name in spec.dates or "date" in name or "timestamp" in name:
            value = parse_date(value)
        elif name in spec.numbers:
            value = parse_number(value)
        typed.append(value.alias(name))
    return df.select(*typed)


def require_columns(df: DataFrame, spec: TableSpec, path: str) -> None:
    missing = [name for name in spec.columns if name not in df.columns]
    if missing:
        raise ValueError(f"{_base_name(path)}, read as `{spec.name}`, lacks required columns {missing}")


def load_table(spark: SparkSession, spec: TableSpec, path: str) -> LoadedTable:
    profile = profile_file(spark, path)
    df = rename_headers(read_raw(spark, path, profile), spec)
    require_columns(df, spec, path)
    return LoadedTable(spec.name, path, profile, type_columns(df, spec))


def load_folder(spark: SparkSession, folder: str) -> dict[str, LoadedTable]:
    """All tables found in ``folder``. A missing optional table only warns."""
    paths = list_csv(spark, folder)
    files = assign_files(paths)
    absent = [spec.name for spec in TABLES if spec.required and spec.name not in files]
    if absent:
        raise FileNotFoundError(f"required tables {absent} not found; files present: {[_base_name(p) for p in paths]}")
    for spec in TABLES:
        if spec.name not in files:
            log.warning("no file for optional table %s in %s", spec.name, folder)
    return {spec.name: load_table(spark, spec, files[spec.name]) for spec in TABLES if spec.name in files}


# ----------------------------------------------------------------- metadata
SUMMARY_TYPE = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("delimiter", T.StringType()),
        T.StructField("encoding", T.StringType()),
    ]
)


def load_summary(spark: SparkSession, loaded: dict[str, LoadedTable]) -> DataFrame:
    """One row per loaded table: file, delimiter, encoding, row count."""
    facts = [(t.name, _base_name(t.path), t.profile.delimiter, t.profile.encoding) for t in loaded.values()]
    counts = row_counts({name: table.data for name, table in loaded.items()})
    return spark.createDataFrame(facts, SUMMARY_TYPE).join(counts, "table_name", "left")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows (an empty table counts 0)."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts
