"""Ordered rule files and their compilation into expressions: the first rule that matches wins."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import collapsed, let

FOLDER = Path(__file__).resolve().parent
#: What the key of an account that no rule names begins with; its native id follows.
UNMAPPED = "unmapped:"


def _read(path: Path | str | None, default: str) -> dict:
    return tomllib.loads((Path(path) if path else FOLDER / default).read_text())


@dataclass(frozen=True)
class Ordered:
    """(label, fragments) in file order. A fragment is looked for anywhere in the folded text."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]

    def match(self, text: Column) -> Column:
        """The label of the first entry with a fragment in text, else null."""
        none = F.lit(None).cast("string")
        return let(F.lower(text), lambda low: F.coalesce(*[F.when(_any(low, fragments), F.lit(label)) for label, fragments in self.entries if fragments], none))

    def match_spaced(self, text: Column) -> Column:
        """match() with runs of white space as one space, as banks pad descriptions."""
        return self.match(collapsed(F.coalesce(text, F.lit(""))))


def _any(text: Column, fragments: tuple[str, ...]) -> Column:
    found = text.contains(fragments[0].lower())
    for f in fragments[1:]:
        found = found | text.contains(f.lower())
    return found


@dataclass(frozen=True)
class Accounts:
    """The accounts a user has named: key -> name, kind, institution and the sources' own ids."""

    entries: tuple[tuple[str, dict], ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        """(native, account_key, display_name, kind, institution): one row a native id, its first account."""
        rows = [(n, k, i, b.get("name"), b.get("kind", "other"), b.get("institution")) for i, (k, b) in enumerate(self.entries) for n in b.get("native", [])]
        df = spark.createDataFrame(rows, "native string, account_key string, ord int, display_name string, kind string, institution string")
        first = F.min_by(F.struct("account_key", "display_name", "kind", "institution"), "ord").alias("a")
        return df.groupBy("native").agg(first).select("native", "a.*")

    def shared(self) -> list[str]:
        """The keys of accounts that several native ids may be rows of; any other account's rows are all of one."""
        own: dict[str, set[str]] = {}
        for k, b in self.entries:
            own.setdefault(k, set()).update(b.get("native", []))
        return sorted(k for k, natives in own.items() if len(natives) > 1 or k.startswith(UNMAPPED))


@dataclass(frozen=True)
class Rules:
    """All that a projection reads besides its input."""

    categories: Ordered
    merchants: Ordered
    flows: Ordered
    accounts: Accounts = Accounts()
    tz: str = "America/New_York"


def load(categories: Path | str | None = None, merchants: Path | str | None = None, flows: Path | str | None = None, accounts: Path | str | None = None, tz: str = "America/New_York") -> Rules:
    sections = lambda raw: Ordered(tuple((k, tuple(b.get("patterns", []))) for k, b in raw.items()))
    return Rules(
        categories=sections(_read(categories, "categories.toml")),
        merchants=Ordered(tuple((k, tuple(v)) for k, v in _read(merchants, "merchants.toml").items())),
        flows=sections(_read(flows, "flows.toml")),
        accounts=Accounts(tuple(_read(accounts, "accounts.toml").items())),
        tz=tz,
    )
