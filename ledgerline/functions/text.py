"""Merchant names out of bank descriptions, and other text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What processors put before a merchant's name, and what networks put after it, in the order
# in which they are tried; words that keep capitals or small letters.
PREFIXES = (
    r"(?i)^(?:sq\s*\*|tst\*|tst\s*\*|py\s*\*|paypal\s*\*|sp\s+|ic\*\s*|dd\s*\*|ext\s*\*|"
    r"pos\s+debit|pos\s+purchase|debit\s+card\s+purchase|checkcard|visa\s+dda\s+pur|"
    r"purchase\s+authorized\s+on|recurring\s+payment|web\s+authorized\s+pmt|"
    r"aplpay\s*|apple\s+pay\s*|gpay\s*\*?|sumup\s*\*|toasttab\s*\*?|clover\s*\*?|"
    r"www\.|https?://)\s*"
)
LEADING_DATE = r"^\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\s+"
TRAILERS = (
    r"\s+#\s*\d+\s*$",
    r"\s+\d{3}[- ]?\d{3}[- ]?\d{4}\s*$",
    r"(?i)\s+x{2,}\d+\s*$",
    r"(?i)\s+[a-z0-9]*\d[a-z0-9]{5,}\s*$",
    r"\s+\d{4,}\s*$",
    r"(?i)[\s,]+[a-z .]+\s+[a-z]{2}\s*$",
    r"(?i)\s+usa?\s*$",
    r"\s+\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\s*$",
)
#: How a text ends that has any trailer: less to look for than each of them.
TRAILED = r"(?i)(?:\d|\s[a-z]{2}|\susa|\d[a-z0-9]{5,})\s*$"
KEEP_UPPER = ("usa", "us", "nyc", "mta", "cvs", "amc", "rei", "h&m", "bp", "ups", "dsw", "kfc", "ihop", "att", "hbo", "ikea", "aaa", "tj")
KEEP_LOWER = ("of", "the", "and", "at", "on", "in", "for", "de", "la", "le")
PASSES = 3
#: Small letters that case folding changes further.
FOLDED = {c: c.casefold() for c in map(chr, range(128, 0x20000)) if c.lower() == c != c.casefold()}


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used: plans stay small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space; what is one already isn't touched."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def _edges(text: Column) -> Column:
    return F.btrim(text, F.lit(" ,-"))


def without_prefixes(text: Column) -> Column:
    """Processor marks and a date stamp off the front, up to three layers of them."""
    for _ in range(PASSES):
        text = F.trim(F.regexp_replace(F.regexp_replace(text, PREFIXES, ""), LEADING_DATE, ""))
    return text


def tidied(text: Column) -> Column:
    return _edges(F.regexp_replace(F.regexp_replace(text, r"[*_|]+", " "), r"\s+", " "))


def without_trailers(text: Column) -> Column:
    """Store numbers, phone numbers, masked cards, references, places and dates off the end; a pass that leaves nothing is void.

    A pass that changes nothing is the last one, and one is not begun where no trailer can be.
    """

    def shortened(kept: Column, passes: int) -> Column:
        shorter = kept
        for pattern in TRAILERS:
            shorter = _edges(F.regexp_replace(shorter, pattern, ""))
        done = let(shorter, lambda x: F.when((x == "") | (x == kept), kept).otherwise(shortened(x, passes - 1) if passes > 1 else x))
        if passes < PASSES:  # its edges are off
            return F.when(kept.rlike(TRAILED), done).otherwise(kept)
        bare = _edges(kept)
        return F.when(kept.rlike(TRAILED) | bare.rlike(TRAILED), done).otherwise(F.when(bare == "", kept).otherwise(bare))

    return let(text, lambda whole: shortened(whole, PASSES))


def stripped(description: Column) -> Column:
    return _edges(collapsed(without_trailers(tidied(without_prefixes(collapsed(F.coalesce(description, F.lit(""))))))))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def titlecase(text: Column) -> Column:
    """Capitals by word; some words keep all or none, hyphens part words, an apostrophe ends one."""

    def one(word: Column, at: Column) -> Column:
        low = F.lower(word)
        return (
            F.when(low.isin(*KEEP_UPPER), F.upper(word))
            .when(low.isin(*KEEP_LOWER) & (at > 0), low)
            .when(word.contains("'"), F.concat(_capital(F.substring_index(word, "'", 1)), F.lit("'"), F.lower(F.substring(word, F.instr(word, "'") + 1, F.length(word)))))
            .when(word.contains("-"), F.array_join(F.transform(F.split(word, "-"), _capital), "-"))
            .otherwise(_capital(word))
        )

    return F.array_join(F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), one), " ")


def merchant_name(description: Column, alias: Column | None = None) -> Column:
    """The display name: an alias if there is one, else what is left after stripping, if that has a letter."""
    name = let(stripped(description), lambda clean: F.when(clean.rlike(r"\p{L}"), titlecase(clean)))
    blank = F.coalesce(F.trim(description), F.lit("")) == ""
    return F.when(~blank, F.coalesce(alias, name) if alias is not None else name)


def _ranges(marks: list[str]) -> str:
    """What stands for marks in a character class, as few ranges."""
    codes, ranges = sorted(map(ord, marks)), []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def _beyond_ascii(ranges: str) -> str:
    """A class of ranges that ASCII fails at once."""
    return rf"[\x{{80}}-\x{{10FFFF}}&&[{ranges}]]"


def folded(text: Column) -> Column:
    """Unicode case folding: small letters, and what else stands for them (ß as ss)."""
    single = [c for c, to in FOLDED.items() if len(to) == 1]
    several = [c for c, to in FOLDED.items() if len(to) > 1 and c != "ß"]
    one = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*[F.lit(FOLDED[c]) for c in several]))
    rare = _ranges(several)
    parts = lambda low: F.transform(F.regexp_extract_all(low, F.lit(f"[{rare}]|[^{rare}]+"), F.lit(0)), lambda x: F.coalesce(F.try_element_at(one, x), x))
    spread = lambda low: F.when(low.rlike(_beyond_ascii(rare)), F.array_join(parts(low), "")).otherwise(low)
    swapped = lambda low: F.when(low.rlike(_beyond_ascii(_ranges(single))), F.translate(low, "".join(single), "".join(FOLDED[c] for c in single))).otherwise(low)
    return let(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), lambda low: let(swapped(low), spread))


def merchant_key(name: Column) -> Column:
    """The joinable form of a name: folded, no punctuation or loose accents, single spaces; null if nothing is left."""
    return let(collapsed(F.regexp_replace(folded(name), r"(?U)[^\p{L}\p{N}_\s]", "")), lambda key: F.when(key != "", key))


def last_four(text: Column, default: str) -> Column:
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def redacted(text: Column) -> Column:
    """Credentials in addresses replaced."""
    return F.regexp_replace(text, r"(https?://)[^/@\s]+@", "$1***@")


def truthy(text: Column) -> Column:
    return F.coalesce(text.isin("1", "true", "yes"), F.lit(False))
