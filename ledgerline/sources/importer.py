"""A folder of statement exports, whatever is in it: every file has an outcome, and none stops the others.

Files are read as lines, so a large one is as many tasks as it has splits. Each file's first line is its header and tells
its dialect; rows of all dialects are read in that one pass. Lines don't show where a quoted value that spans them ends, nor
where OFX blocks do: files that hold either are read whole, a file at a time.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.ids import synthesised_id
from ledgerline.functions.money import to_cents
from ledgerline.functions.text import let
from ledgerline.sources.statements import AMOUNTS, DIALECTS, FIELDS, GLOB, looks_like_ofx, parse_ofx
from ledgerline.storage import once

#: Columns of a line that are looked at; exports have about a dozen.
MOST_COLUMNS = 64
#: What is wrong with a file.
UNREADABLE, UNKNOWN = "drop.unreadable", "drop.unknown-format"
#: The columns that dialects read.
_READ = sorted({c for _, required, optional, _ in DIALECTS for c in (*required, *optional)})
_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "\0", "maxColumns": "20480"}
_BOM = "﻿"


@dataclass(frozen=True)
class Imported:
    """rows: (file, line, dialect, FIELDS..., synthesised); files: (file, bytes, outcome, dialect, rows, bad, synthesised, code, note), one row each."""

    rows: DataFrame
    files: DataFrame

    @property
    def rejected(self) -> DataFrame:
        """The files of which nothing could be read, and why."""
        return self.files.filter("outcome = 'error'").select("file", "bytes", "code", "note")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value): n grows within a block of a file."""
    read = spark.read.option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def _values(line: Column, width: int = MOST_COLUMNS) -> Column:
    """A line's first values, width of them; those that it doesn't have are null."""
    columns = ", ".join(f"c{i} string" for i in range(width))
    return let(F.from_csv(line, F.lit(columns), _OPTIONS), lambda parsed: F.array(*[parsed[f"c{i}"] for i in range(width)]))


def _any_value(values: Column) -> Column:
    return F.exists(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")


def _split(rows: DataFrame, widths: list[int]) -> DataFrame:
    """rows with their values, as many as their header has names; those of lines without any value are left out.

    widths are those of the headers. A line of as many values as are asked for is parsed without an exception inside, which
    costs more than all the rest; only lines that are blank as far as the header goes are looked at further.
    """
    own = F.lit(None).cast("array<string>")
    for width in widths:
        own = F.when(F.least(F.size("names"), F.lit(MOST_COLUMNS)) == width, _values(F.col("value"), width)).otherwise(own)
    # exploded, as a filter would parse the line a second time
    kept = let(own, lambda v: F.when(F.when(_any_value(v), True).otherwise(_any_value(_values(F.col("value")))), F.array(v)))
    return rows.select("file", "line", "dialect", "at", F.explode(kept).alias("values"))


def _names(line: Column) -> Column:
    """A header's names, without what a file may begin with and white space around them."""
    names = F.transform(F.filter(_values(F.regexp_replace(line, f"^{_BOM}", "")), lambda x: x.isNotNull()), F.trim)
    return F.when(F.trim(F.coalesce(line, F.lit(""))) != "", names)


def _dialect(names: Column) -> Column:
    """The first dialect whose columns are all among names."""
    out = F.lit(None).cast("string")
    for name, required, _, _ in reversed(DIALECTS):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0, F.lit(name)).otherwise(out)
    return out


def _facts(lines: DataFrame) -> DataFrame:
    """(file, names, dialect, whole, at): whole files can't be read by lines; at has the places of the columns that dialects read, 0 for none."""
    head = F.regexp_replace("value", f"^{_BOM}", "")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    ofx = looks_like_ofx(head) | F.upper(F.ltrim(F.col("value"))).startswith("<OFX>")
    per = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "n")).alias("head"), F.bool_or(ofx).alias("ofx"), F.bool_or(odd).alias("odd"))
    names = _names(F.col("head"))
    dialect = F.when(F.col("ofx"), "ofx").otherwise(_dialect(names))
    told = per.select("file", names.alias("names"), dialect.alias("dialect"), (F.col("ofx") | F.col("odd")).alias("whole"))
    return told.withColumn("at", F.struct(*[_place(c).alias(c) for c in _READ]))


def _place(name: str) -> Column:
    """Where the last column of that name is."""
    back = F.array_position(F.reverse("names"), F.lit(name)).cast("int")
    return F.when(back > 0, F.size("names") - back + 1).otherwise(0)


def _cell(name: str) -> Column:
    """A row's value under the last column of that name."""
    at = F.col("at")[name]
    return F.when(at > 0, F.try_element_at("values", at))


def _by_dialect(values: DataFrame) -> DataFrame:
    """FIELDS of (file, line, dialect, at, values), each row by its file's dialect."""
    named = values.select("file", "line", "dialect", *[_cell(c).alias(c) for c in _READ])

    def by_dialect(own: dict[str, Column], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for name, value in own.items():
            out = F.when(F.col("dialect") == name, value).otherwise(out)
        return out

    told = named.withColumn("__money", to_cents(by_dialect({name: AMOUNTS[name]() for name, *_ in DIALECTS}, "string")))  # read once for both of its columns
    made = {name: columns(F.col("__money")) for name, _, _, columns in DIALECTS}
    return told.select("file", "line", "dialect", *[by_dialect({n: own[f] for n, own in made.items() if f in own}, "bigint" if f == "amount_cents" else "string").alias(f) for f in FIELDS])


def _numbered(lines: DataFrame) -> DataFrame:
    """lines with their number in the file, from 0: counted within blocks, then over a file's blocks."""
    per = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("n")) - 1
    return lines.withColumn("__own", own).join(per.select("file", "block", before.alias("__before")), ["file", "block"]).select("file", (F.col("__own") + F.col("__before")).alias("line"), "value")


def _csv_records(files: DataFrame) -> DataFrame:
    """(file, line, values) of whole CSV texts (file, value), the header first; line counts records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for k, row in enumerate(csv.reader(io.StringIO(text.removeprefix(_BOM), newline=""))):
                    rows.append((k, row))
                    if len(rows) == 4096:
                        yield _records(file, rows)
                        rows = []
                if rows:
                    yield _records(file, rows)

    return files.mapInArrow(run, "file string, line long, values array<string>")


def _records(file: str, rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.list_(pa.string()))], names=["file", "line", "values"])


def import_folder(spark: SparkSession, path: str) -> Imported:
    """Every export under path, in any mixture of dialects and of anything else.

    A file's outcome is ok, partial if an amount couldn't be read, or error: its header names no dialect's columns
    (UNKNOWN), it has no header row, which is so for an empty file too (UNKNOWN), or it can't be read (UNREADABLE). A later
    name of repeated columns counts; missing values are null; rows longer than the header lose what is beyond it.
    """
    lines = _lines(spark, path)
    # scans skip empty files, the file index lists them
    listed = spark.createDataFrame([(re.sub(r"^(\w+):///", r"\1:/", f),) for f in lines.inputFiles()], "file string")
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    listed = listed.join(sizes, "file", "left").select("file", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    facts = once(_facts(lines), "import-facts")
    by_line = lines.join(facts.filter("not whole and dialect is not null").select("file", "names", "dialect"), "file", "left_semi")
    widths = [r["n"] for r in facts.filter("not whole and dialect is not null").select(F.least(F.size("names"), F.lit(MOST_COLUMNS)).alias("n")).distinct().collect()]  # MOST_COLUMNS at most
    rows = _numbered(by_line).filter("line > 0").join(facts.select("file", "names", "dialect", "at"), "file")
    found = _by_dialect(_split(rows, widths))
    whole = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(r["file"])) for r in facts.filter("whole and dialect is not null").select("file").collect()]  # no more than the file index lists
    if whole:
        texts = spark.read.option("ignoreCorruptFiles", "true").text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(facts.select("file", "dialect"), "file")
        quoted = _csv_records(texts.filter("dialect <> 'ofx'").select("file", "value")).filter((F.col("line") > 0) & _any_value(F.col("values"))).join(facts.select("file", "dialect", "at"), "file")
        ofx = parse_ofx(texts.filter("dialect = 'ofx'").select("file", "value")).withColumn("dialect", F.lit("ofx"))
        found = found.unionByName(_by_dialect(quoted)).unionByName(ofx.select(found.columns))
    made = F.col("external_id").isNull()
    found = once(found.withColumn("synthesised", made).withColumn("external_id", F.coalesce("external_id", synthesised_id(F.col("line"), "file"))), "import-rows")
    per = found.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("amount_cents").isNull()).alias("bad"), F.count_if("synthesised").alias("synthesised"))
    own = listed.join(facts.withColumn("__read", F.lit(True)), "file", "left").join(per, "file", "left")
    code = F.when(F.col("__read").isNull() & (F.col("bytes") > 0), UNREADABLE).when(F.col("dialect").isNull(), UNKNOWN)
    note = F.when(code == UNREADABLE, "the file can't be read").when(F.col("names").isNull() & code.isNotNull(), "the file has no header row").when(code.isNotNull(), F.concat(F.lit("no dialect claims these columns: "), F.array_join(F.array_sort("names"), ", ")))
    outcome = F.when(code.isNotNull(), "error").when(F.coalesce("bad", F.lit(0)) > 0, "partial").otherwise("ok")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return Imported(found, own.select("file", "bytes", outcome.alias("outcome"), "dialect", count("rows"), count("bad"), count("synthesised"), code.alias("code"), note.alias("note")))
