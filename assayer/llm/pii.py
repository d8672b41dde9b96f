"""Format-preserving pseudonyms for personal data, in DataFrame operations alone.

Candidates are found by one pattern and checked by their own rules: payment cards (16 digits, or 15 from 34 and 37) by Luhn's sum,
IBANs by their remainder, North American phone numbers by +1 and ten digits or by separators and their first digits, social
security numbers by their reserved parts, IPv4 addresses by their octets, dates of 1900 to 2099 (2024-02-29, 29.02.2024) by the
calendar.  A valid value is permuted by a keyed Feistel network within the set of valid values of its format, so equal values get
equal pseudonyms in all documents, different ones different pseudonyms, and the layout stays.  The two halves of a network lie in
[0, a) and [0, b) with a * b values in the set, which needs no cycle walking: the 73,049 days, for one, are 17 * 4,297.
E-mail addresses and quoted secrets are no numbers: keyed digests replace them, letter case aside, and all others stay as they
are.  Not found: IPv6 addresses, phone numbers of other countries, dates with slashes or month names.

A candidate that fails its check may hide a value that begins within it (a card behind a wrong account number).  Such a text is searched
again, the failed candidates' first characters set apart, until no candidate fails: PASSES times at most, which suffices, as
a candidate holds no more groups in which others can begin.  Patterns begin at the start of a run of their own characters and
their repetitions give nothing back, so that a word of any length takes linear time.

The key comes from spark.assayer.pii.key; where that is unset a session has a random one, and pseudonyms of different
sessions are then not linked.  It stands in the query's plan: keep event logs as safe as the key.

Cases: null text stays null and empty text empty; numbers that fail their check stay; a text without valid values comes
back unchanged, and very long ones are searched whole; U+0001 to U+0004 in a text are kept; repeated rows get equal results and
ties do not occur; other columns, whatever their names, are neither read nor returned by pseudonyms(), and kept by replace();
an empty table gives an empty one.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import table

#: The session's setting that holds the key.
CONF = "spark.assayer.pii.key"
ROUNDS = 8
#: A valid value's characters are set apart by DONE, a failed candidate's first one by TRIED, while a text is searched.
DONE, TRIED, PASSES = "\u0003", "\u0004", 10
#: Characters of an IBAN by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}"  # marks before the first letter stay
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
PHONE = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
LOCAL = r"(?<![\d+.-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[.-])[2-9]\d\d[.-]\d{4}(?![\d-])"
DATE = r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
DOTTED = r"(?<![\d.])(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d(?!\.?\d)"
_GROUPS = "|".join(rf"(?:{codes.replace(' ', '|')})\d\d(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_GROUPS})(?![A-Za-z0-9@])"
CARD = r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d.]*\d)"
SHORT = r"(?<![\d.])3[47]\d\d([ -]?)\d{6}\1\d{5}(?![\d.]*\d)"
SECRET = r"(?<=\b(?:token|secret|password|api_key|apikey) ?[=:] ?\")[A-Za-z0-9+/_-]{16,}(?=\")"
ANY = "|".join([EMAIL, IP, PHONE, LOCAL, SSN, DATE, DOTTED, CARD.replace(r"\1", r"\2"), SHORT.replace(r"\1", r"\3"), IBAN, SECRET]).replace("(?<![", f"(?<![{TRIED}")
#: The days of 1900 to 2099 are _YEARS[0] * _YEARS[1].
_YEARS = (17, 4_297)
_made: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The session's key."""
    found = spark.conf.get(CONF, None)
    return found or _made.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def keyed(key: str, tweak: str, *parts: Column) -> Column:
    """A number below 2^52 from a keyed digest."""
    text = F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("bigint")


def feistel(key: str, tweak: str, left: Column, right: Column, a: int | Column, b: int | Column) -> tuple[Column, Column]:
    """A keyed permutation of the pairs in [0, a) x [0, b)."""
    state = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(((s["l"] + keyed(key, tweak, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + keyed(key, tweak, i, s["l"])) % b).alias("r")))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step)
    return end["l"], end["r"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refill(value: Column, digits: Column) -> Column:
    """The value's layout with other digits."""
    marks = F.split(value, "")
    placed = F.aggregate(marks, F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), lambda s, c: F.when(c.rlike(r"\d"), F.struct(F.concat(s["s"], F.substring(digits, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i"))))
    return placed["s"]


def luhn(digits: Column) -> Column:
    """The check sum modulo 10 of a string of digits, the check digit included."""
    reversed_digits = F.split(F.reverse(digits), "")
    doubled = F.transform(reversed_digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10


def _digits(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def card(value: Column, key: str) -> Column:
    """The first digit stays; the check digit follows from the others."""
    d = digits_of(value)
    left, right = feistel(key, "card", F.substring(d, 2, 7), F.substring(d, 9, 7), 10**7, 10**7)
    body = F.concat(F.substring(d, 1, 1), _digits(left, 7), _digits(right, 7))
    return F.when(luhn(d) == 0, refill(value, F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")))).otherwise(value)


def short_card(value: Column, key: str) -> Column:
    """The first two digits stay; the check digit follows from the others."""
    d = digits_of(value)
    left, right = feistel(key, "short card", F.substring(d, 3, 6), F.substring(d, 9, 6), 10**6, 10**6)
    body = F.concat(F.substring(d, 1, 2), _digits(left, 6), _digits(right, 6))
    return F.when(luhn(d) == 0, refill(value, F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")))).otherwise(value)


def phone(value: Column, key: str) -> Column:
    d = digits_of(value)
    left, right = feistel(key, "phone", F.substring(d, 2, 5), F.substring(d, 7, 5), 10**5, 10**5)
    return refill(value, F.concat(F.lit("1"), _digits(left, 5), _digits(right, 5)))


def local_phone(value: Column, key: str) -> Column:
    """800 area codes, 800 exchanges, 10,000 lines."""
    part = lambda at, n: F.substring(digits_of(value), at, n).cast("bigint")
    left, right = feistel(key, "local phone", (part(1, 3) - 200) * 100 + part(7, 2), (part(4, 3) - 200) * 100 + part(9, 2), 80_000, 80_000)
    return refill(value, F.concat(_digits(F.floor(left / 100) + 200, 3), _digits(F.floor(right / 100) + 200, 3), _digits(left % 100, 2), _digits(right % 100, 2)))


def remainder(account: Column) -> Column:
    """Modulo 97 of an account number's digits, letters counting 10 to 35."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (s * 100 + F.ascii(c) - 55) % 97).otherwise(s)
    return F.aggregate(F.split(account, ""), F.lit(0), step)


def iban(value: Column, key: str) -> Column:
    """Country, letters and layout stay; the digits behind the check digits move, and these follow."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    head, tail = F.substring(bare, 1, 2), F.substring(bare, 5, 40)
    d = digits_of(tail)
    n = F.length(d)
    first = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    left, right = feistel(key, "iban", F.coalesce(F.substring(d, F.lit(1), first).try_cast("bigint"), F.lit(0)), F.coalesce(F.substring(d, first + 1, n).try_cast("bigint"), F.lit(0)), size(first), size(n - first))
    digits = F.concat(F.when(first > 0, F.lpad(left.cast("string"), first, F.lit("0"))).otherwise(""), F.when(n > first, F.lpad(right.cast("string"), n - first, F.lit("0"))).otherwise(""))
    check = F.lpad((98 - remainder(F.concat(refill(tail, digits), head, F.lit("00")))).cast("string"), 2, "0")
    return F.when(remainder(F.concat(tail, F.substring(bare, 1, 4))) == 1, refill(value, F.concat(check, digits))).otherwise(value)


def ssn(value: Column, key: str) -> Column:
    """898 areas (000, 666 and those from 900 are reserved), 99 groups, 9,999 serials."""
    part = lambda at, n: F.substring(value, at, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    left, right = feistel(key, "ssn", area * 99 + part(5, 2) - 1, part(8, 4) - 1, 898 * 99, 9_999)
    new = F.floor(left / 99)
    return F.concat_ws("-", _digits(new + F.when(new >= 665, 2).otherwise(1), 3), _digits(left % 99 + 1, 2), _digits(right + 1, 4))


def ip(value: Column, key: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    left, right = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(left / 256), left % 256, F.floor(right / 256), right % 256)])


def date(value: Column, key: str, layout: str = "yyyy-MM-dd") -> Column:
    """Days that do not exist stay."""
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(F.try_to_date(value, layout), first).cast("bigint")
    left, right = feistel(key, "date", F.floor(day / _YEARS[1]), day % _YEARS[1], *_YEARS)
    return F.coalesce(F.date_format(F.date_add(first, (left * _YEARS[1] + right).cast("int")), layout), value)


def dotted_date(value: Column, key: str) -> Column:
    return date(value, key, "dd.MM.yyyy")


def digest(value: Column, key: str, tweak: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), value).cast("binary"), 256)


def email(value: Column, key: str) -> Column:
    bare = F.regexp_extract(value, "[A-Za-z0-9].*", 0)
    return F.concat(F.regexp_extract(value, "^[._%+-]*", 0), F.lit("user-"), F.substring(digest(F.lower(bare), key, "email"), 1, 16), F.lit("@example.invalid"))


def secret(value: Column, key: str) -> Column:
    return F.substring(F.repeat(digest(value, key, "secret"), 4), F.lit(1), F.length(value))


def pseudonym(value: Column, key: str) -> Column:
    """What replaces a candidate; itself if it fails its check."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    rules = ((EMAIL, email), (IP, ip), (PHONE, phone), (LOCAL, local_phone), (SSN, ssn), (DATE, date), (DOTTED, dotted_date), (CARD, card), (SHORT, short_card), (IBAN, iban))
    out = F
    for pattern, rule in rules:
        out = out.when(whole(pattern), rule(value, key))
    return out.otherwise(secret(value, key))


def searched(text: Column, key: str) -> Column:
    """struct<text, found, again>: valid values replaced and set apart; again: some candidate failed, and its first character is set apart."""
    parts = F.split(F.regexp_replace(text, f"({ANY})", "\u0001$1\u0001"), "\u0001")
    pairs = F.transform(parts, lambda p, i: F.struct(p.alias("old"), F.when(i % 2 == 1, pseudonym(p, key)).alias("new")))
    apart = lambda x: F.concat(F.array_join(F.split(x, ""), DONE), F.lit(DONE))
    shown = lambda x: F.when(x["new"].isNull(), x["old"]).when(x["new"] != x["old"], apart(x["new"])).otherwise(F.concat(F.substring(x["old"], 1, 1), F.lit(TRIED), F.substring(x["old"], F.lit(2), F.length(x["old"]))))
    count = lambda q, good: F.size(F.filter(q, lambda x: good(x["new"], x["old"])))
    once = F.transform(F.array(pairs), lambda q: F.struct(F.array_join(F.transform(q, shown), "").alias("text"), count(q, lambda a, b: a != b).alias("found"), (count(q, lambda a, b: a == b) > 0).alias("again")))
    return once[0]


def replaced(rows: DataFrame, text_col: str, key: str, text_as: str, found_as: str) -> DataFrame:
    """The rows with two more columns, the text with pseudonyms and how many values changed.  Step by step, so that each expression is planned once."""
    text = F.col(text_col)
    odd = text.rlike("[\u0001-\u0004]")
    safe = text
    for mark, name in (("\u0002", "b"), ("\u0001", "a"), (DONE, "c"), (TRIED, "d")):
        safe = F.replace(safe, F.lit(mark), F.lit("\u0002" + name))
    more = lambda s, _: F.when(s["again"], F.transform(F.array(searched(s["text"], key)), lambda x: F.struct(x["text"].alias("text"), (s["found"] + x["found"]).alias("found"), x["again"].alias("again")))[0]).otherwise(s)
    begin = F.struct(F.when(odd, safe).otherwise(text).alias("text"), F.lit(0).alias("found"), text.rlike(r"[\d@]|[=:] ?\"").alias("again"))
    out = rows.withColumn(found_as, F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), begin, more))
    found = F.col(found_as)
    plain = F.regexp_replace(found["text"], f"[{DONE}{TRIED}]", "")
    for mark, name in (("\u0001", "a"), (DONE, "c"), (TRIED, "d"), ("\u0002", "b")):  # no change where there is no U+0002
        plain = F.replace(plain, F.lit("\u0002" + name), F.lit(mark))
    return out.withColumns({text_as: F.when(found["found"] > 0, plain).otherwise(text), found_as: F.coalesce(found["found"], F.lit(0))})


def unused(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def replace(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of df, with pseudonyms in the text."""
    found = unused(df, "n_replaced")
    return replaced(df, text_col, key, text_col, found).drop(found)


def pseudonyms(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_replaced)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return replaced(rows, "text", key, "new", "n_replaced").select(F.col("id").alias(id_col), F.col("new").alias("text"), "n_replaced")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data."""
    return pseudonyms(table(spark, sf_dir, "documents"), key_of(spark))
