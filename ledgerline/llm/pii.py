"""Format-preserving pseudonyms for validated numbers and dates, by a keyed Feistel permutation.

Found, validated and replaced within their own format:
card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social security numbers (ranges), phone numbers
(ten digits with separators, optional country code, kept), IPv4 addresses (octets), mail addresses (local
part), and dates from 1900 to 2099 (year-month-day with - or /, month/day/year, day.month.year; real
calendar days only). What fails its validation stays as it is. Digits around a card (an expiry, a code) may
look like more groups of it: the leftmost, then longest run of whole groups that validates is the card, and
the rest stays. An IBAN ends at its country's length; of an unknown country, at the last space where it
validates.

Each kind has a domain on which the replacement is a bijection for a given key, so equal values get equal
pseudonyms in every document, whatever their separators, and different values never collide. Check digits
are computed anew, so results validate too. All of it is built-in SQL expressions.

Null texts stay null; texts without a match, empty ones too, stay equal. Repeated rows are treated alike.
Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_B, _E = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
SSN = rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}"
PHONE = rf"{_B}(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_E}"
IPV4 = r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9]|\.\d)"
DATE = r"(?<![A-Za-z0-9/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![A-Za-z0-9/-]|\.\d)"
#: What a card or IBAN that is long enough doesn't run into over a space or hyphen: other kinds, or the next card.
_KINDS = rf"{SSN}|{PHONE}|{IPV4}|{DATE}"
CARD = rf"{_B}\d(?:[ -]?\d){{12}}(?:(?:[ -](?!{_KINDS}|\d{{4}}(?:[ -]?\d){{9}}))?\d){{0,6}}{_E}"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LANDS = "|".join(lands.replace(" ", "|") for lands in IBAN_LENGTHS.values())
_KNOWN = "|".join(rf"(?:{lands.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}{_E}" for n, lands in IBAN_LENGTHS.items())
IBAN = rf"{_B}(?:{_KNOWN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{11}}(?:(?: (?!{_KINDS}|\d{{13,19}}{_E}))?[A-Z0-9]){{0,19}}{_E})"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}"
#: In the order in which they are tried at a place.
ANY = "|".join(f"(?:{p})" for p in (MAIL, IPV4, DATE, SSN, PHONE, CARD, IBAN))


def _prf(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_number(value: Column, a: int, b: int, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a * b - 1: an alternating Feistel network over value div b and value mod b."""
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + F.pmod(_number(_prf(key, kind, i, s["r"])), F.lit(a)), F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_number(_prf(key, kind, i, s["l"])), F.lit(b)), F.lit(b)).cast("long").alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permute_text(text: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the texts with the same pattern of digits, capitals, small letters and other marks.

    A Feistel network over the text's halves: each letter or digit of one half moves, within its class, by an
    amount that depends on the whole other half. Other marks stay.
    """
    cut = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def moved(half: Column, digest: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(digest, F.pmod(i, F.lit(15)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            at = F.ascii(c)
            to = F.when(at.between(48, 57), 48 + F.pmod(at - 48 + by, F.lit(10))).when(at.between(65, 90), 65 + F.pmod(at - 65 + by, F.lit(26))).when(at.between(97, 122), 97 + F.pmod(at - 97 + by, F.lit(26)))
            return F.when(to.isNotNull(), F.char(to)).otherwise(c)

        return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(moved(s["l"], _prf(key, kind, i, s["r"])).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), moved(s["r"], _prf(key, kind, i, s["l"])).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _refill(template: Column, chars: Column, wanted: str) -> Column:
    """template with its characters of the class `wanted` replaced, in order, by those of chars."""
    parts = F.split(template, "")

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(wanted)
        return F.struct((s["n"] + hit.cast("int")).alias("n"), F.concat(s["out"], F.when(hit, F.substring(chars, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _pieces(x: Column, starts: Column, valid, new) -> Column:
    """x with its first valid piece replaced: pieces of whole groups, by start, then longest first; null if none is valid."""
    mark = lambda i: F.substring(x, i, F.lit(1)).isin(" ", "-")
    ends = F.filter(F.sequence(F.length(x), F.lit(1)), lambda i: (i == F.length(x)) | mark(i + 1))
    pieces = F.flatten(F.transform(F.filter(starts, lambda i: (i == 1) | mark(i - 1)), lambda a: F.transform(F.filter(ends, lambda b: b >= a), lambda b: F.struct(a.alias("a"), F.substring(x, a, b - a + 1).alias("piece")))))
    first = F.when(valid(x), F.struct(F.lit(1).alias("a"), x.alias("piece"))).otherwise(F.get(F.filter(pieces, lambda p: valid(p["piece"])), F.lit(0)))
    return F.when(first.isNotNull(), _with(first, lambda p: F.concat(F.substring(x, F.lit(1), p["a"] - 1), new(p["piece"]), F.substring(x, p["a"] + F.length(p["piece"]), F.length(x)))))


def card_within(x: Column, key: str) -> Column:
    """A run of digit groups with the card number among them replaced; null if there is none."""
    return _pieces(x, F.sequence(F.lit(1), F.length(x)), lambda p: F.length(_digits(p)).between(13, 19) & _luhn(_digits(p)), lambda p: card(p, key))


def iban_within(x: Column, key: str) -> Column:
    """An IBAN, of an unknown country also with words after it; null if there is none."""
    def valid(p: Column) -> Column:
        own = F.regexp_replace(p, " ", "")
        return F.length(own).between(15, 34) & (_mod97(F.concat(F.substring(own, F.lit(5), F.length(own)), F.substring(own, 1, 4))) == 1)

    return F.when(x.rlike(f"^(?:{_LANDS})"), iban(x, key)).otherwise(_pieces(x, F.array(F.lit(1)), valid, lambda p: iban(p, key)))


def card(x: Column, key: str) -> Column:
    """The number with all but its last digit permuted and the Luhn digit set anew; null if it isn't valid."""
    own = _digits(x)
    body = permute_text(F.substring(own, F.lit(1), F.length(own) - 1), key, "card")
    tails = F.array(*[F.lit(str(d)) for d in range(10)])
    full = _with(body, lambda b: F.concat(b, F.element_at(F.filter(tails, lambda d: _luhn(F.concat(b, d))), 1)))
    return F.when(F.length(own).between(13, 19) & _luhn(own), _refill(x, full, "[0-9]"))


def _mod97(x: Column) -> Column:
    """Of an account number with letters as 10 to 35."""
    return F.aggregate(F.split(x, ""), F.lit(0).cast("long"), lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97).cast("long"))


def iban(x: Column, key: str) -> Column:
    own = F.regexp_replace(x, " ", "")
    land, body = F.substring(own, 1, 2), F.substring(own, F.lit(5), F.length(own))
    new = _with(permute_text(body, key, "iban"), lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(_mod97(F.concat(body, F.substring(own, 1, 4))) == 1, _refill(x, new, "[A-Z0-9]"))


def ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = permute_number(value, 898 * 99, 9999, key, "ssn")

    def show(v: Column) -> Column:
        high = F.floor(v / 9999).cast("long")
        a = F.floor(high / 99).cast("long")
        return F.concat(F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lit("-"), F.lpad((high % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _with(new, show))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def phone(x: Column, key: str) -> Column:
    """The last ten digits permuted; the country code before them stays."""
    own = _digits(x)
    code = F.substring(own, F.lit(1), F.length(own) - 10)
    return F.when(F.length(own) >= 10, _refill(x, F.concat(code, permute_text(F.right(own, F.lit(10)), key, "phone")), "[0-9]"))


def ipv4(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
    new = permute_number(value, 65536, 65536, key, "ipv4")
    show = lambda v: F.concat_ws(".", *[(F.floor(v / 256**k).cast("long") % 256).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.forall(parts, lambda p: p <= 255), _with(new, show))


def mail(x: Column, key: str) -> Column:
    at = F.instr(x, "@")
    return F.concat(permute_text(F.substring(x, F.lit(1), at - 1), key, "mail"), F.substring(x, at, F.length(x)))


def date(x: Column, key: str) -> Column:
    """Days of 1900 to 2099 permuted among themselves, 29 February among the other 48 of them."""
    sep = F.regexp_extract(x, "[-/.]", 0)
    parts = F.split(x, "[-/.]")
    first = F.length(parts[0]) == 4
    y = F.when(first, parts[0]).otherwise(parts[2])
    m = F.when(first, parts[1]).when(sep == ".", parts[1]).otherwise(parts[0])
    d = F.when(first, parts[2]).when(sep == ".", parts[0]).otherwise(parts[1])
    iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    year = y.cast("long")
    leap_day = (m.cast("int") == 2) & (d.cast("int") == 29)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    index = (year - 1900) * 365 + F.dayofyear(day) - 1 - F.when(leap & (m.cast("int") > 2), 1).otherwise(0)
    plain = permute_number(index.cast("long"), 250, 292, key, "date")
    rare = permute_number(F.floor((year - 1904) / 4).cast("long"), 7, 7, key, "leap-day")

    def show(v: Column) -> Column:
        on = F.date_add(F.lit("2001-01-01").cast("date"), (v % 365).cast("int"))
        yy = F.when(leap_day, v * 4 + 1904).otherwise(F.floor(v / 365) + 1900).cast("long").cast("string")
        mm = F.when(leap_day, F.lit(2)).otherwise(F.month(on)).cast("string")
        dd = F.when(leap_day, F.lit(29)).otherwise(F.dayofmonth(on)).cast("string")
        mm = F.when(F.length(m) == 2, F.lpad(mm, 2, "0")).otherwise(mm)
        dd = F.when(F.length(d) == 2, F.lpad(dd, 2, "0")).otherwise(dd)
        return F.when(first, F.concat(yy, sep, mm, sep, dd)).when(sep == ".", F.concat(dd, sep, mm, sep, yy)).otherwise(F.concat(mm, sep, dd, sep, yy))

    return F.when(year.between(1900, 2099) & day.isNotNull(), _with(F.when(leap_day, rare).otherwise(plain), show))


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one matched value; itself if it doesn't validate."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    new = F.when(x.contains("@"), mail(x, key)).when(whole(IPV4), ipv4(x, key)).when(whole(DATE), date(x, key)).when(whole(SSN), ssn(x, key)).when(whole(PHONE), phone(x, key)).when(whole(CARD), card_within(x, key)).when(whole(IBAN), iban_within(x, key))
    return F.coalesce(new, x)


def mask(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col's personal numbers and dates replaced; other columns and all rows as they are.

    key: a secret; who has it can reverse the pseudonyms, and the same key links values over runs.
    """
    return _masked(docs, key, text_col, *_free_names(docs)).select(docs.columns)


def _free_names(docs: DataFrame) -> tuple[str, str]:
    """Two column names that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return tuple([name for k in range(len(taken) + 2) if (name := f"own_{k}") not in taken][:2])


def _masked(docs: DataFrame, key: str, text_col: str, found_col: str, new_col: str) -> DataFrame:
    text = F.col(text_col)
    found = F.when(text.rlike(r"\d\d\d|@|\d[/.]\d"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn(found_col, found)
    docs = docs.withColumn(new_col, F.transform(found_col, lambda x: pseudonym(x, key)))
    woven = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(new_col), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    return docs.withColumn(text_col, F.when(F.size(found_col) > 0, woven).otherwise(text))


def mask_report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_numbers, n_dates): masked texts and how many values were replaced."""
    out = _masked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key, "text", "found", "new")
    changed = F.filter(F.arrays_zip("found", "new"), lambda p: p["found"] != p["new"])
    dates = F.size(F.filter(changed, lambda p: p["found"].rlike(f"^(?:{DATE})$")))
    return out.select("doc_id", "text", (F.size(changed) - dates).cast("long").alias("n_numbers"), dates.cast("long").alias("n_dates"))
