"""Text and byte functions as Spark columns; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkglass.functions.limits import DISPLAY_CHARS, ELEMENTS, TAG_CHARS

#: Characters that are not shown as they are.
INVISIBLE = r"[\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}\x{61c}\x{feff}]"
#: These and controls, the latter one by one: Java looks those up in a table, and compares a character with each range.
ODD = "[" + "".join(rf"\x{{{c:x}}}" for c in (*range(9), 11, 12, *range(14, 32), *range(0x7F, 0xA0))) + INVISIBLE[1:]
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def bind(f, value: Column) -> Column:
    """f(value) with value worked out once: a lambda's variable is, an expression that it names may be worked out again at each place."""
    return F.get(F.transform(F.array(value), f), 0)


def display_text(value: Column, most: int = DISPLAY_CHARS) -> Column:
    """The first characters of a value, those that aren't shown replaced one by one, and how many there are more."""
    shown = lambda x: F.regexp_replace(x, ODD, "�")
    clean = shown(F.substring(value, 1, most))
    more = F.concat(clean, F.lit("… ("), (F.length(value) - most).cast("string"), F.lit(" characters longer)"))
    return F.when(F.octet_length(value) <= most, shown(value)).when(F.length(value) > most, more).otherwise(clean)  # bytes are counted already


def low_bytes(value: Column) -> Column:
    """The low byte of each UTF-16 unit of a text; null stays null."""
    return F.unhex(F.regexp_replace(F.hex(F.encode(value, "UTF-16BE")), "..(..)", "$1"))


def decode_entities(value: Column) -> Column:
    """The five named entities and numeric ones, each decoded once. Split at entities, decode the
    parts that are one, and join again."""
    entity = r"&(?:#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);"
    parts = F.split(value, f"(?={entity})")

    def one(part: Column) -> Column:
        found = F.regexp_extract(part, f"^{entity}", 0)
        name = F.regexp_extract(part, "^&([a-zA-Z]+);", 1)
        digits = F.regexp_extract(part, "^&#([0-9]+);", 1)
        hexes = F.regexp_extract(part, "^&#x([0-9a-fA-F]+);", 1)
        number = F.when(F.length(F.regexp_replace(hexes, "^0+", "")) > 6, F.lit(-1).cast("long")).when(hexes != "", F.conv(F.concat(F.lit("0"), hexes), 16, 10).cast("long"))
        number = F.coalesce(number, F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 7, F.lit(-1).cast("long")).when(digits != "", digits.cast("long")))
        fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        code = F.lpad(F.hex(F.when(fine, number).otherwise(F.lit(0xFFFD).cast("long"))), 8, "0")
        char = F.decode(F.unhex(code), "UTF-32BE")
        known = F.lit(None).cast("string")
        for k, v in NAMED.items():
            known = F.when(name == k, F.lit(v)).otherwise(known)
        rest = F.substring(part, F.length(found) + 1, F.length(part))
        return F.when(found == "", part).when(number.isNotNull(), F.concat(char, rest)).when(known.isNotNull(), F.concat(known, rest)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def strip_noise(xml: Column) -> Column:
    """Without comments, processing instructions and declarations; an open one takes the rest. CDATA
    sections are left to the walker, which escapes them."""
    return F.regexp_replace(xml, r"(?s)<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<!(?!\[CDATA\[|--)[^>]*(?:>|\z)", "")


def start_tags(xml: Column, local: str, most: int = 200_000) -> Column:
    """Start tags of a local name, with any prefix, as they are written; longer ones than TAG_CHARS are
    left out. Quantifiers are possessive: the matcher would nest once a character otherwise."""
    quoted = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)(<(?:[A-Za-z_][\w.-]*+:)?{local}(?=[\s/>]){quoted}>)"), F.lit(1))
    return F.slice(F.filter(found, lambda t: F.length(t) <= TAG_CHARS), 1, most)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value as written, in quotes of either kind, empty if there is none."""
    pattern = rf"""(?s)[\s](?:[\w.-]++:)?{name}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')"""
    return F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))


def element_text(xml: Column, local: str, most: int = 4000) -> Column:
    """Text of the first element of this name that isn't blank, tags dropped, entities decoded, trimmed; null if none
    of the first ELEMENTS has any."""
    inner = F.slice(F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:[A-Za-z_][\w.-]*:)?{local}(?:\s[^>]*)?>(.*?)</"), F.lit(1)), 1, ELEMENTS)
    plain = lambda x: F.regexp_replace(decode_entities(F.regexp_replace(x, "<[^>]*>", "")), r"^\s+|\s+$", "")
    return F.substring(F.get(F.filter(F.transform(inner, plain), lambda x: x != ""), 0), 1, most)


def format_bytes(n: Column) -> Column:
    half_up = lambda x, d: F.format_string(f"%.{d}f", F.round(x, d))
    kib, mib = n / 1024, n / (1024 * 1024)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes")))
        .when(n < 10 * 1024, F.concat(half_up(kib, 1), F.lit(" KiB"))).when(n < 1024 * 1024, F.concat(half_up(kib, 0), F.lit(" KiB")))
        .when(n < 10 * 1024 * 1024, F.concat(half_up(mib, 2), F.lit(" MiB"))).otherwise(F.concat(half_up(mib, 1), F.lit(" MiB")))
    )


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many or one + 's'}")))


def describe_location(kind: Column, offset: Column, length: Column, path: Column) -> Column:
    """Where a finding stands: its first byte and how many it takes, its path, or nowhere."""
    at = F.concat(F.lit("offset "), F.format_number(offset, 0))
    return (
        F.when((kind == "bytes") & (length > 0), F.concat(at, F.lit(", "), F.format_number(length, 0), F.when(length == 1, " byte").otherwise(" bytes")))
        .when(kind == "bytes", at).when(kind == "structure", path).otherwise(F.lit("no place in the bytes"))
    )


def list_names(names: Column, most: int = 4) -> Column:
    """Different names in order of first sight, most of them listed."""
    u = F.array_distinct(names)
    more = F.concat(F.array_join(F.slice(u, 1, most), ", "), F.lit(" and "), (F.size(u) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(u) > most, more).otherwise(F.array_join(u, ", "))


def lower_first(label: Column) -> Column:
    """The first letter in lower case where the second is; acronyms have a capital or a digit there."""
    second = F.substring(label, 2, 1)
    return F.when((second >= "a") & (second <= "z"), F.concat(F.lower(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))).otherwise(label)


def exif_date(value: Column) -> Column:
    return F.regexp_replace(value, r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}:\d{2}:\d{2})", "$1-$2-$3 $4")


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSSOHH'mm' as YYYY-MM-DD HH:mm:SS and its zone; other text stays."""
    pattern = r"^D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Zz+-])?(\d{2})?'?(\d{2})?"
    g = lambda k, d: F.coalesce(F.nullif(F.regexp_extract(value, pattern, k), F.lit("")), F.lit(d))
    sign = F.regexp_extract(value, pattern, 7)
    zone = F.when(F.lower(sign) == "z", F.lit(" UTC")).when(sign != "", F.concat(F.lit(" UTC"), sign, g(8, "00"), F.lit(":"), g(9, "00"))).otherwise(F.lit(""))
    return F.when(value.rlike(pattern), F.concat(g(1, ""), F.lit("-"), g(2, "01"), F.lit("-"), g(3, "01"), F.lit(" "), g(4, "00"), F.lit(":"), g(5, "00"), F.lit(":"), g(6, "00"), zone)).otherwise(value)


def extension(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^\\/]*)$", 1)
    return F.substring(F.lower(F.regexp_extract(base, r"^.+\.([^.]+)$", 1)), 1, 16)


def download_name(name: Column, fmt: Column) -> Column:
    """A name for a copy that differs from the original's and suits any file system."""
    stem = F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"(?<!^)\.[^.]*$", "")).otherwise(name)
    stem = F.regexp_extract(stem, r"([^\\/]*)$", 1)
    clean = F.regexp_replace(stem, r"[\x{0}-\x{1f}\x{7f}-\x{9f}" + INVISIBLE[1:], "")
    clean = F.substring(F.regexp_replace(F.regexp_replace(clean, r'[<>:"/\\|?*]+', "_"), r"^[.\s]+|[.\s]+$", ""), 1, 80)
    clean = F.when(clean.rlike("(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])$"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.concat(F.when(clean == "", F.lit("file")).otherwise(clean), F.lit(".experimental-copy."), F.when(fmt == "jpeg", F.lit("jpg")).otherwise(F.lit("png")))
