"""Text, URL, token and content functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value planned and computed once however often it stands there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def url_clean(url: Column) -> Column:
    """Without utm_* parameters; blank values stay."""
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_")), "&")
    return F.when(F.instr(url, "?") == 0, url).otherwise(F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), fragment))


def url_domain(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.when(found != "", found)


def _entities() -> tuple[str, str]:
    """The standard's table of named characters as JSON: names with their semicolon, and those that may lack it."""
    import json
    from html.entities import html5

    return tuple(json.dumps({k: v for k, v in html5.items() if k.endswith(";") == whole}) for whole in (True, False))


#: What the numbers 128 to 159 stand for in HTML 5: characters of windows-1252, or themselves.
_C1 = [bytes([i]).decode("windows-1252", errors="ignore") or chr(i) for i in range(0x80, 0xA0)]


def unescaped(text: Column) -> Column:
    """Named and numbered character references as characters, in one pass, as HTML 5 reads them; what is none stays.

    A name without a semicolon may be the start of a longer word.  Numbers that stand for no character give U+FFFD, and control characters vanish.
    """
    named, bare = (F.from_json(F.lit(t), "map<string,string>") for t in _entities())
    number = lambda ref: F.when(ref.rlike("^#[xX]"), F.conv(F.regexp_extract(ref, "^#[xX]0*([0-9A-Fa-f]{0,8})", 1), 16, 10)).otherwise(F.regexp_extract(ref, "^#0*([0-9]{0,9})", 1)).try_cast("bigint")
    no_char = lambda n: n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    control = lambda n: n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = lambda n: F.when(no_char(n), "\ufffd").when(n.between(0x80, 0x9F), F.get(F.split(F.lit("\0".join(_C1)), "\0"), (n - 0x80).cast("int"))).when(n == 13, "\r").when(control(n), "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def of(part: Column) -> Column:
        """What a text behind an ampersand becomes."""
        digits, name = F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", 0), F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        begun = lambda w: F.get(F.filter(F.transform(F.sequence(F.least(F.length(w), F.lit(6)), F.lit(2), F.lit(-1)), lambda k: F.left(w, k)), lambda x: F.map_contains_key(bare, x)), F.lit(0))
        short = let(name, lambda w: F.when(F.length(w) >= 2, let(begun(w), lambda k: F.when(k.isNotNull(), F.concat(F.element_at(bare, k), F.substring(part, F.length(k) + 1, F.length(part))))))
        )
        rest = lambda ref: F.substring(part, F.length(ref) + 1, F.length(part))
        by_name = F.when(name.endswith(";"), let(name, lambda w: F.concat(F.try_element_at(named, w), rest(w))))
        return F.when(digits != "", F.concat(let(number(digits), char), rest(digits))).otherwise(F.coalesce(by_name, short, F.concat(F.lit("&"), part)))

    pieces = lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), of), ""))
    return F.when(text.contains("&"), let(F.split(text, "&"), pieces)).otherwise(text)


def html_to_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]+>", " ")), r"(?U)\s+", " "))


def truncate_text(text: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


#: How citations, addresses, times, numbers and the ends of sentences are written.
CITED = r"[\[【［〔]\s*(T\d+(?:\s*[,;，、]\s*T\d+)*)\s*[\]】］〕]"
ADDRESS = r"https?://[^\s<>\"'\[\]\)【】［］〔〕]+"
TIME = r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?|\b\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}"
NUMBER = r"(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?!\w)%?"
BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9*\-•\"(])"
LIST_MARK = r"^\s*(?:[-*•]\s*)?\d+[.)](?=\s)"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))


def citations(text: Column) -> Column:
    """Cited ids in order, each bracket's ids one by one."""
    return F.flatten(F.transform(every(text, CITED, 1), lambda c: F.regexp_extract_all(c, F.lit(r"T\d+"), F.lit(0))))


def addresses(text: Column) -> Column:
    """URLs without the marks that end a sentence."""
    return F.transform(every(text, ADDRESS), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def times(text: Column) -> Column:
    return every(text, TIME)


def numbers(text: Column) -> Column:
    """Numbers as written, with separators and percent signs; those within identifiers are none."""
    return every(text, NUMBER)


def number_value(token: Column) -> Column:
    return F.regexp_replace(token, "[,%]", "").cast("double")


def number_tolerance(token: Column) -> Column:
    """Half a unit of the last printed place."""
    return 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(token, r"\.(\d+)", 1))) + 1e-9


def sentences(text: Column) -> Column:
    """Sentences of each line, in order."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.split(line, BREAK))
    return F.filter(F.flatten(lines), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def is_claim(sentence: Column) -> Column:
    """Headings, list labels and bare punctuation state nothing."""
    bare = F.trim(F.regexp_replace(F.trim(sentence), r"^[#*\->• ]+", ""))
    return ~F.trim(sentence).rlike(r"^(?:#+\s.*|\*\*[^*]+\*\*:?)$") & bare.rlike("[A-Za-z]{3}") & ~bare.endswith(":")


#: Fixed value: the reason that stands for a database's message.
DATABASE_ERROR = "a database error occurred while saving this step"
#: Characters that end a path within a reason, and how paths begin: a drive, a share, a folder under the root (no URL).
_NO_PATH = r"'\"\],;)"
_BEGINS = {"drive": r"(?<!\w)[A-Za-z]:[\\/]", "share": r"\\\\", "root": rf"(?<![\w.:/])/[^/\n{_NO_PATH}]+/"}


def _paths(begins: str, between: str) -> str:
    """Folders, which may have blanks in their names, up to the last separator of the line, and a name without any."""
    return rf"{begins}(?:[^{between}\n{_NO_PATH}]*[{between}])*[^\s\\/{_NO_PATH}]*"


def scrub(reason: Column, most: int = 240) -> Column:
    """A reason without statements and file paths, on one line and not too long."""
    said = F.substring_index(reason, "[SQL:", 1)
    hidden = said
    for kind, begins in _BEGINS.items():
        hidden = F.regexp_replace(hidden, _paths(begins, "/" if kind == "root" else r"\\/"), "<file>")
    hidden = F.when(said.contains("/") | said.contains("\\"), hidden).otherwise(said)  # a path has a separator
    words = F.array_join(F.filter(F.split(hidden, r"\s+"), lambda w: w != ""), " ")
    short = F.transform(F.array(words), lambda w: F.when(F.length(w) > most, F.concat(F.left(w, F.lit(most - 1)), F.lit("…"))).otherwise(w))[0]  # bound to a name: used three times, made once
    of_database = F.exists(F.array(F.lit("Session's transaction has been rolled back"), F.lit("(sqlite3.")), lambda mark: F.contains(said, mark))
    return F.when((reason != "") & of_database, DATABASE_ERROR).otherwise(short)


def stated_date(value: Column) -> Column:
    """struct<iso, precision> of a date as metadata writes it; nulls where it is none. No zone is added."""
    v = F.trim(value)
    camera = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(v, r"^(\d{4}:\d{2}:\d{2}[ T]\d{2}:\d{2}:\d{2})", 1), "T", " "), F.lit("yyyy:MM:dd HH:mm:ss"))
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd"))
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(F.rpad(F.regexp_replace(F.regexp_replace(v, r"(?:Z|[+-]\d{2}:\d{2})$", ""), "T", " "), 19, ":00"), F.lit("yyyy-MM-dd HH:mm:ss")))
    text = F.coalesce(F.date_format(camera, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(day, "yyyy-MM-dd"), F.date_format(iso, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.struct(text.alias("iso"), F.when(text.isNull(), F.lit(None).cast("string")).when(camera.isNull() & day.isNotNull(), "day").otherwise("second").alias("precision"))


def capture_time(stamp: Column) -> Column:
    """An archive's 14 digits as a time in UTC."""
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))


#: Blocks of IPv4 addresses that are not globally routable (first address, prefix length), and exceptions within them.
NOT_PUBLIC = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
ROUTED = ["192.0.0.9", "192.0.0.10"]
_QUAD = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"


def ipv4_number(address: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.split(address, r"\.")
    return F.when(address.rlike(f"^{_QUAD}$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x.cast("bigint")))


#: Blocks of IPv6 addresses within 2000::/3, the globally routed unicast space, that are not public, and exceptions within them (longest prefix decides).
NOT_PUBLIC_6 = [("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("3fff::", 20)]
ROUTED_6 = [("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28)]


def ipv6_halves(address: Column) -> Column:
    """struct<high, low>, the 128 bits of an IPv6 literal as two longs; null for anything else.  The last 32 bits may be a dotted quad."""
    in_hex = lambda n: F.lower(F.concat_ws(":", F.hex(F.shiftright(n, 16)), F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
    plain = lambda bare: let(ipv4_number(F.regexp_extract(bare, r"([0-9.]+)$", 1)), lambda quad: F.when(bare.contains(".") & quad.isNotNull(), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), in_hex(quad))).when(~bare.contains("."), bare))
    well = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"

    def sides(text: Column) -> Column:
        """What stands before and behind the double colon."""
        return F.transform(F.split(text, "::"), lambda s: F.filter(F.split(s, ":"), lambda g: g != ""))

    def halves(text: Column, s: Column) -> Column:
        left, right = F.get(s, F.lit(0)), F.coalesce(F.get(s, F.lit(1)), F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        half = lambda groups, at: F.aggregate(F.slice(groups, at, 4), F.lit(0).cast("bigint"), lambda n, g: F.shiftleft(n, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")))
        of = let(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), right), lambda groups: F.struct(half(groups, 1).alias("high"), half(groups, 5).alias("low")))
        return F.when(text.rlike(well) & F.when(text.contains("::"), missing > 0).otherwise(missing == 0), of)

    return let(F.lower(F.substring_index(address, "%", 1)), lambda bare: let(plain(bare), lambda text: let(sides(text), lambda s: halves(text, s))))


def _block_6(halves: Column, block: str, prefix: int) -> Column:
    import ipaddress

    n = int(ipaddress.IPv6Address(block))
    high, low = n >> 64, n & (2**64 - 1)
    signed = lambda x: x - 2**64 if x >> 63 else x
    if prefix <= 64:
        return F.shiftrightunsigned(halves["high"], 64 - prefix) == F.lit(high >> 64 - prefix).cast("bigint")
    return (halves["high"] == F.lit(signed(high)).cast("bigint")) & (F.shiftrightunsigned(halves["low"], 128 - prefix) == F.lit(signed(low >> 128 - prefix)).cast("bigint"))


def _ipv4_is_public(n: Column) -> Column:
    value, inside = lambda q: sum(int(x) << 8 * (3 - i) for i, x in enumerate(q.split("."))), F.lit(False)
    for first, prefix in NOT_PUBLIC:
        inside = inside | n.between(value(first), value(first) + (1 << (32 - prefix)) - 1)
    return ~inside | n.isin(*map(value, ROUTED))


def ip_is_public(address: Column) -> Column:
    """Whether a literal address is globally routable unicast; null where it is none.  An IPv4 address mapped into IPv6 is judged as itself."""
    rules = sorted([(*b, False) for b in NOT_PUBLIC_6] + [(*b, True) for b in ROUTED_6] + [("2000::", 3, True)], key=lambda b: -b[1])

    def six(halves: Column) -> Column:
        out = F
        for block, prefix, public in rules:
            out = out.when(_block_6(halves, block, prefix), public)
        mapped = (halves["high"] == 0) & (F.shiftrightunsigned(halves["low"], 32) == 0xFFFF)
        return F.when(mapped, let(halves["low"].bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), _ipv4_is_public)).when(halves.isNotNull(), out.otherwise(False))

    four = let(ipv4_number(F.substring_index(address, "%", 1)), lambda n: F.when(n.isNotNull(), _ipv4_is_public(n)))
    return F.when(address.contains(":"), let(ipv6_halves(address), six)).otherwise(four)


def url_policy(url: Column) -> Column:
    """'allowed', or the first rule that a URL breaks; names are not resolved."""
    u = F.trim(url)
    scheme, authority = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    public = let(F.regexp_replace(host, r"[\[\]]", ""), ip_is_public)
    return (
        F.when(url.isNull() | (F.length(url) > 2048), "too long or missing").when(~scheme.isin("http", "https"), "scheme").when(authority.contains("@"), "credentials")
        .when(host == "", "no host").when((port != "") & ~port.isin("80", "443"), "port").when(public == F.lit(False), "not public").otherwise("allowed")
    )


#: The names under which a page declares its images.
DECLARED = ["og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src"]


def image_links(html: Column, base: Column) -> Column:
    """Declared images first, then those shown, resolved against the page, without tracking parameters, each once in order."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    value = lambda tag, name: F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*'([^']*)'", 1), F.lit("")))
    named = lambda t: F.lower(F.coalesce(value(t, "property"), value(t, "name"), F.lit(""))).isin(*DECLARED)
    declared = F.transform(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<(?:meta|link)\b[^>]*>"), F.lit(0)), lambda t: (F.lower(F.substring(t, 2, 4)) == "link") & (F.lower(F.coalesce(value(t, "rel"), F.lit(""))) == "image_src") | (F.lower(F.substring(t, 2, 4)) == "meta") & named(t)), lambda t: F.coalesce(value(t, "content"), value(t, "href")))
    shown = F.filter(F.transform(tags("img"), lambda t: F.coalesce(value(t, "src"), value(t, "data-src"))), lambda x: ~x.startswith("data:"))
    root, folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    whole = lambda x: F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x).when(x.startswith("//"), F.concat(scheme, x)).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(root, F.lit("/"))), x))
    found = F.transform(F.filter(F.concat(declared, shown), lambda x: x.isNotNull()), lambda x: url_clean(whole(F.trim(x))))
    return F.array_distinct(F.filter(found, lambda u: u.rlike("^https?:")))


#: What a file's first bytes tell (hexadecimal bytes at a place, type), in this order.
SIGNATURES = [(1, "FFD8FF", "image/jpeg"), (1, "89504E470D0A1A0A", "image/png"), (1, "49492A00", "image/tiff"), (1, "4D4D002A", "image/tiff")]
CONTAINERS = [("57454250", "image/webp"), ("41564920", "video/x-msvideo"), ("57415645", "audio/wav")]
BRANDS = [("71742020", "video/quicktime"), ("4D344120", "audio/mp4"), ("4D344220", "audio/mp4")]


def media_type(content: Column) -> Column:
    """The type by a file's own bytes, never the declared one; null where no signature matches."""
    at = lambda place, hexa: F.hex(F.substring(content, place, len(hexa) // 2)) == hexa
    kind = F
    for place, hexa, name in SIGNATURES:
        kind = kind.when(at(place, hexa), name)
    for hexa, name in CONTAINERS:
        kind = kind.when(at(1, "52494646") & at(9, hexa), name)
    for hexa, name in BRANDS:
        kind = kind.when(at(5, "66747970") & at(9, hexa), name)
    second = F.conv(F.hex(F.substring(content, 2, 1)), 16, 10).cast("int")
    sync = at(1, "FF") & (second.bitwiseAND(F.lit(0xE0)) == 0xE0)
    kind = kind.when(at(5, "66747970"), "video/mp4").when(at(1, "1A45DFA3"), "video/x-matroska").when(at(1, "494433"), "audio/mpeg")
    return kind.when(sync & (second.bitwiseAND(F.lit(6)) == 0), "audio/aac").when(sync, "audio/mpeg")
