"""Tables whose every change is one commit: readers see all of it or nothing, and a crash loses nothing.

    root/data/<table>/<id>/part_month=2026-08/part-...   staged folders, never changed once written
    root/commits/<version>.json                     which folders make up each table

Data is staged first. The commit record is written beside its place and renamed into it, which fails if another writer
has taken the version; until then no reader looks at what is staged. A reader keeps the folders of the version that it
began with, whatever is committed meanwhile, until vacuum() deletes what no kept version names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators.observations import first_of_each
from ledgerline.storage import files, path_of

UNDATED, PARTITION = "0000-00", "part_month"
#: Batches with that many digests at most look them up one by one, which Parquet's Bloom filters answer; larger ones are joined.
FEW = 64
#: Rows of a batch that are looked at for that; one of more rows is joined.
MOST_ROWS = 1024
#: Folders of one month that tidy() leaves alone.
MOST_FOLDERS = 16


class Conflict(RuntimeError):
    """Another commit has changed a table since it was read."""


@dataclass(frozen=True)
class Keyed:
    """How an append-only table is known: a row's keys, a digest of them, which of equal ones stays, and its month, which follows from the keys.

    made tells the digest, and before it keys that follow from other columns, for batches without them: they are added where
    rows are stored, and not moved before. dealt are the keys that rows meet by, if not all; those few that agree in them are told apart there.
    """

    keys: tuple[str, ...]
    digest: str
    order: tuple[str, ...]
    month: str
    made: dict[str, Callable[[], Column]] = field(default_factory=dict)
    dealt: tuple[str, ...] = ()

    def completed(self, rows: DataFrame) -> DataFrame:
        """rows with what is made."""
        for name, column in self.made.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, column())
        return rows


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)

    def folders(self, table: str) -> list[dict]:
        return self.tables.get(table, {}).get("folders", [])


def month_of(text: str) -> str:
    """SQL: the month that a date or instant in text begins with."""
    return f"CASE WHEN {text} RLIKE '^[0-9]{{4}}-[0-9]{{2}}' THEN substring({text}, 1, 7) ELSE '{UNDATED}' END"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str) -> list[str]:
        fs, at = files(self.spark, path), path_of(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _text(self, path: str) -> str:
        stream = files(self.spark, path).open(path_of(self.spark, path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """Of the versions that are kept, oldest first."""
        return [int(n[:-5]) for n in self._files(f"{self.root}/commits") if re.fullmatch(r"\d{20}\.json", n)]

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an earlier one."""
        if number is None:
            number = max(self.numbers(), default=0)
        return Version(number, json.loads(self._text(f"{self.root}/commits/{number:020d}.json"))["tables"]) if number else Version()

    def table(self, name: str, schema: StructType | None = None, months: list[str] | None = None, at: Version | None = None) -> DataFrame:
        """A table as of a version (the newest), of some months only if they are given; without any rows, schema tells its columns."""
        at = at or self.version()
        schema = StructType.fromJson(at.tables[name]["schema"]) if name in at.tables else schema
        if schema is None:
            raise KeyError(f"no table {name} in {self.root}")
        paths = [f"{f['path']}/{PARTITION}={m}" for f in at.folders(name) for m in f["months"] if months is None or m in months]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame, month: str | None = None, digest: str | None = None) -> dict:
        """Write rows where no reader looks; returns their folder. Undated and unpartitioned rows are one month, UNDATED."""
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        dated = rows.withColumn(PARTITION, F.expr(month) if month else F.lit(UNDATED))
        out = dated.write.partitionBy(PARTITION).option("compression", "zstd")  # half of snappy's size, as digests are half noise
        if digest:
            # as large as a file's rows need; else each file of each month has one of a megabyte, or, with five candidates, of 64 KiB
            out = out.options(**{f"parquet.bloom.filter.enabled#{digest}": "true", "parquet.bloom.filter.adaptive.enabled": "true", f"parquet.bloom.filter.candidates.number#{digest}": "12"})
        out.parquet(path)
        return {"path": path, "months": [n.removeprefix(f"{PARTITION}=") for n in self._files(path) if n.startswith(f"{PARTITION}=")], "schema": rows.schema.jsonValue()}

    def _publish(self, base: Version, tables: dict[str, dict]) -> Version:
        """The commit itself."""
        place = f"{self.root}/commits/{base.number + 1:020d}.json"
        beside = f"{self.root}/commits/.{uuid.uuid4().hex}"
        fs = files(self.spark, beside)
        stream = fs.create(path_of(self.spark, beside), False)
        stream.write(bytearray(json.dumps({"tables": tables}).encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(path_of(self.spark, beside), path_of(self.spark, place), none)
        except Exception as e:
            fs.delete(path_of(self.spark, beside), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base.number + 1} is taken") from e
            raise
        return Version(base.number + 1, tables)

    def commit(self, change: Callable[[Version], dict[str, dict] | None], tries: int = 10) -> Version:
        """Stage and publish: change(version) returns the new entries of the tables that it changes, or None for none.

        If another writer publishes first, change is asked again on top of that.
        """
        for _ in range(tries):
            base = self.version()
            changed = change(base)
            if not changed:
                return base
            try:
                return self._publish(base, base.tables | changed)
            except Conflict:
                for name, entry in changed.items():
                    self._delete([f["path"] for f in entry["folders"] if f not in base.folders(name)])
        raise Conflict(f"{tries} times another writer was first")

    def _delete(self, paths: list[str]) -> None:
        for p in paths:
            files(self.spark, p).delete(path_of(self.spark, p), True)

    @staticmethod
    def _entry(folders: list[dict], schema: dict) -> dict:
        return {"folders": [{k: f[k] for k in ("path", "months")} for f in folders if f["months"]], "schema": schema}

    def staged(self, entry: dict) -> DataFrame:
        """The rows that stage() has written, for who makes more of them before they are published."""
        paths = [f"{entry['path']}/{PARTITION}={m}" for m in entry["months"]]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, build: str | None = None, **tables: DataFrame | dict) -> Version:
        """All of these tables anew, as rows or as stage() has written them, and with them a folder of other files (a path of new_build()), in one commit."""
        staged = {name: rows if isinstance(rows, dict) else self.stage(name, rows) for name, rows in tables.items()}
        entries = {name: self._entry([s], s["schema"]) for name, s in staged.items()}
        if build:
            entries["build"] = {"folders": [{"path": build, "months": []}], "schema": StructType().jsonValue()}
        return self._publish_over(entries)

    def _publish_over(self, entries: dict[str, dict]) -> Version:
        """Publish whole tables, whatever they were before."""
        while True:
            base = self.version()
            try:
                return self._publish(base, base.tables | entries)
            except Conflict:
                continue

    def new_build(self) -> str:
        """A path for files that replace() will publish."""
        return f"{self.root}/data/build/{uuid.uuid4().hex}"

    def build(self) -> str:
        """The published folder of files."""
        return self.version().folders("build")[0]["path"]

    def append_new(self, batches: dict[str, DataFrame], keyed: dict[str, Keyed]) -> dict[str, int]:
        """Append the rows whose keys aren't stored yet, to all tables in one commit; returns how many each. Again, it adds none.

        Whether a key is stored is asked of the batch's months alone, however long the table's history is.
        """
        added: dict[str, int] = {}

        def change(base: Version) -> dict[str, dict] | None:
            out = {}
            for name, batch in batches.items():
                new = self._new(name, batch, keyed[name], base)
                staged = self.stage(name, new, keyed[name].month, keyed[name].digest)
                added[name] = self.spark.read.parquet(*[f"{staged['path']}/{PARTITION}={m}" for m in staged["months"]]).count() if staged["months"] else 0
                if staged["months"]:
                    out[name] = self._entry([*base.folders(name), staged], staged["schema"])
                else:
                    self._delete([staged["path"]])
            return out

        self.commit(change)
        return added

    def _new(self, name: str, batch: DataFrame, keyed: Keyed, base: Version) -> DataFrame:
        """batch's rows of keys that aren't stored, each once: one shuffle of them and of the stored keys, whose digests are moved as bytes."""
        order, dealt = [c for c in keyed.order if c in batch.columns], keyed.dealt or keyed.keys
        if not base.folders(name):
            rows = keyed.completed(batch.repartition(*dealt))  # dealt out unsorted: repeats are few
            return first_of_each(rows, list(keyed.keys), order)
        asked = keyed.completed(batch)
        months = [r["month"] for r in asked.select(F.expr(keyed.month).alias("month")).distinct().collect()]  # as many as the batch spans
        stored = self.table(name, asked.schema, months, base)
        some = [r["digest"] for r in asked.select(F.col(keyed.digest).alias("digest")).limit(MOST_ROWS + 1).collect()]
        few = list(dict.fromkeys(some))
        if few and len(some) <= MOST_ROWS and len(few) <= FEW and None not in few:
            stored = stored.filter(_any_of(F.col(keyed.digest), few))
        rest = {f"__{k}": F.unhex(F.md5(F.col(k).cast("string"))) for k in keyed.keys if k not in dealt}
        known = stored.select(*dealt, *[c.alias(k) for k, c in rest.items()], F.lit(0).alias("__new"))
        both = batch.withColumn("__new", F.lit(1)).unionByName(known, allowMissingColumns=True)
        rows = keyed.completed(both.repartition(*dealt))
        told = rows.withColumns({k: F.when(F.col("__new") == 1, c).otherwise(F.col(k)) for k, c in rest.items()})
        first = first_of_each(told, [*dealt, *rest], ["__new", *order]).filter("__new = 1")
        return first.select(*asked.columns)

    def tidy(self, name: str, keyed: Keyed) -> Version:
        """Months of more than MOST_FOLDERS folders into one folder each; rows stay as they are."""

        def change(base: Version) -> dict[str, dict] | None:
            crowded = [m for m in {m for f in base.folders(name) for m in f["months"]} if sum(m in f["months"] for f in base.folders(name)) > MOST_FOLDERS]
            if not crowded:
                return None
            rows = self.table(name, months=crowded, at=base)
            staged = self.stage(name, rows.repartitionByRange(F.expr(keyed.month), keyed.digest), keyed.month, keyed.digest)
            left = [f | {"months": [m for m in f["months"] if m not in crowded]} for f in base.folders(name)]
            return {name: self._entry([*left, staged], base.tables[name]["schema"])}

        return self.commit(change)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all versions but the newest `keep`, and what none of these names; returns the folders. Not while a writer stages."""
        numbers = self.numbers()
        named = {f["path"] for n in numbers[-keep:] for t in self.version(n).tables.values() for f in t["folders"]}
        gone = [p for t in self._files(f"{self.root}/data") for d in self._files(f"{self.root}/data/{t}") if (p := f"{self.root}/data/{t}/{d}") not in named]
        self._delete([f"{self.root}/commits/{n:020d}.json" for n in numbers[:-keep]])
        self._delete(gone)
        return gone


def _any_of(column: Column, values: list) -> Column:
    """One equality a value, as those are what a Bloom filter can answer."""
    return reduce(lambda a, b: a | b, [column == v for v in values])
