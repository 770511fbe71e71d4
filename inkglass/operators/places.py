"""Relations of places: tags, name tokens and byte patterns with the offsets at which they stand.

All three cut a text into pieces by one regular expression, whose pieces in a row are the whole text.
Only the pieces' lengths and short keys are dealt by row; a running sum of the lengths gives each piece
its offset. Nothing is searched again from the start, however long the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.functions.limits import TAG_CHARS
from inkglass.operators.pdf_tokens import STOP, WATCHED, unescaped


def pieces(text: Column, pattern: str) -> Column:
    """The parts of a text in a row; pattern must match at every place."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def offsets(rows: DataFrame, key: str, length: str = "length", by: str = "k") -> DataFrame:
    """rows with `at`: the sum of the lengths of all pieces before, in the order of `by`."""
    before = W.partitionBy(key).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


#: A start tag, text up to the next `<`, or a lone `<`. Quantifiers are possessive.
TAG_PIECES = r"""(?s)<(?:[A-Za-z_][\w.-]*+:)?[A-Za-z_][\w.-]*+(?=[\s/>])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
START_NAME, CLOSE_NAME = r"^<([A-Za-z_][\w.:-]*)", r"^</([A-Za-z_][\w.:-]*)"


def tags(rows: DataFrame, key: str, markup: Column) -> DataFrame:
    """key, name, start, stop, close of every start tag: its offsets in characters (stop is after `>`), and that of the
    first `</name` after it, which may begin a longer name and may stand in another tag; nesting is not followed. Null if there is none.

    Cases: tags longer than TAG_CHARS are left out, closing tags of any length count. Comments are not looked
    for: strip_noise() takes them out. Null and empty texts give no rows; rows with equal keys are one text in
    an undefined order, so keys must differ."""
    own = rows.select(F.col(key).alias("key"), F.coalesce(markup, F.lit("")).alias("text")).select("key", pieces(F.col("text"), TAG_PIECES).alias("tags"), F.split("text", "(?=</)").alias("closes"))
    # a closing tag counts for each beginning of its name that has the length of a start tag's name
    sizes = F.array_distinct(F.transform("tags", lambda p: F.length(F.regexp_extract(p, START_NAME, 1))))
    name = F.regexp_extract("piece", START_NAME, 1)
    starts = own.select("key", F.posexplode("tags").alias("k", "piece")).select("key", "k", F.length("piece").alias("length"), F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>")).alias("names"))
    closed = F.regexp_extract("piece", CLOSE_NAME, 1)
    begun = F.transform(F.filter("sizes", lambda n: (n > 0) & (n <= F.length(closed))), lambda n: F.substring(closed, F.lit(1), n))
    closes = own.select("key", sizes.alias("sizes"), F.posexplode("closes").alias("k", "piece")).select("key", "k", F.length("piece").alias("length"), begun.alias("names"))
    # a start tag has its place at its end, so that a closing tag within it isn't after it
    opened = offsets(starts, "key").select("key", "at", "length", F.lit(False).alias("closing"), (F.col("at") + F.col("length")).alias("place"), F.explode("names").alias("name"))
    ended = offsets(closes, "key").select("key", "at", "length", F.lit(True).alias("closing"), F.col("at").alias("place"), F.explode("names").alias("name"))
    after = W.partitionBy("key", "name").orderBy("place", "closing").rowsBetween(1, W.unboundedFollowing)
    found = opened.unionByName(ended).withColumn("close", F.min(F.when(F.col("closing"), F.col("at"))).over(after))
    return found.where(~F.col("closing") & (F.col("length") <= TAG_CHARS)).select(F.col("key").alias(key), "name", F.col("at").alias("start"), F.col("place").alias("stop"), "close")


#: A slash with up to 48 characters of a name, `#` and two hexadecimal digits counting as one; or anything up to the next slash.
TOKEN_PIECES = rf"(?s)/(?:#[0-9A-Fa-f]{{2}}|[^{STOP}]){{0,48}}+|[^/]++"
#: Bytes after /ID that are looked at, and characters of an identifier.
ID_BYTES, ID_CHARS = 200, "{2,128}"
HEX_IDS = rf"^\s*\[\s*<([0-9A-Fa-f\s]{ID_CHARS})>\s*<([0-9A-Fa-f\s]{ID_CHARS})>\s*\]"


def tokens(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """key, at (byte offset of the slash), token (decoded) and next (ID_BYTES bytes that follow an ID token) of all name tokens of binary contents.

    Cases: a slash alone gives an empty token. Escapes are decoded before the bound of 48 characters. Null or
    empty contents give no rows; keys must differ."""
    cut = rows.select(F.col(key).alias("key"), F.posexplode(pieces(F.decode(F.coalesce(content, F.lit(b"")), "ISO-8859-1"), TOKEN_PIECES)).alias("k", "piece"))
    name = F.when(F.startswith("piece", F.lit("/")), unescaped(F.substr("piece", F.lit(2))))
    told = cut.select("key", "k", F.length("piece").alias("length"), name.alias("token"), F.left("piece", F.lit(ID_BYTES)).alias("first"))
    # what follows is in the piece after it: an identifier has no slash
    follows = F.lead(F.when(F.col("token").isNull(), F.col("first"))).over(W.partitionBy("key").orderBy("k"))
    found = offsets(told.withColumn("next", F.when(F.col("token") == "ID", F.coalesce(follows, F.lit("")))), "key")
    return found.where("token IS NOT NULL").select(F.col("key").alias(key), "at", "token", "next")


def watched(found: DataFrame, names: tuple[str, ...] = WATCHED) -> DataFrame:
    """Those of tokens() that are on a watch list."""
    listed = found.sparkSession.createDataFrame([(n,) for n in names], "token string")
    return found.join(F.broadcast(listed), "token", "left_semi")


def trailer_ids(found: DataFrame, key: str) -> DataFrame:
    """key, id_first, id_second of the last /ID with two hexadecimal strings, and literal: if any has other strings; of keys with either."""
    hexadecimal = F.col("next").rlike(HEX_IDS)
    one = lambda k: F.lower(F.regexp_replace(F.regexp_extract("next", HEX_IDS, k), r"\s", ""))
    rows = found.where("token = 'ID'").withColumn("ids", F.when(hexadecimal, F.struct("at", one(1).alias("a"), one(2).alias("b"))))
    rows = rows.withColumn("literal", ~hexadecimal & F.col("next").rlike(r"^\s*\[\s*\("))
    sums = rows.groupBy(key).agg(F.max("ids").alias("ids"), F.bool_or("literal").alias("literal")).where("ids IS NOT NULL OR literal")
    return sums.select(key, F.col("ids.a").alias("id_first"), F.col("ids.b").alias("id_second"), "literal")


def quoted(pattern: bytes) -> str:
    """A regular expression of exactly these bytes, as ISO-8859-1."""
    return "".join(f"\\x{b:02x}" for b in pattern)


def occurrences(rows: DataFrame, key: str, content: Column, patterns: dict[str, bytes]) -> DataFrame:
    """key, pattern (its name), at of all places of byte patterns in binary contents, overlapping ones too.

    Contents are cut before every place of any pattern. Which patterns stand there is told by the bytes at the cut,
    as many as the longest pattern has. Cases: an empty pattern is refused. Null or empty contents give no rows;
    equal patterns of two names give a row each; keys must differ."""
    if not all(patterns.values()):
        raise ValueError("a pattern has at least one byte")
    most = max(map(len, patterns.values()))
    text = F.decode(F.coalesce(content, F.lit(b"")), "ISO-8859-1")
    # longer alternatives first don't matter: any of them makes a cut
    cut = rows.select(F.col(key).alias("key"), text.alias("text")).select("key", "text", F.split("text", "(?=" + "|".join(sorted(map(quoted, patterns.values()))) + ")").alias("parts"))
    # the bytes at a cut may go on in later pieces: each is a byte at least, so `most` pieces have them
    ahead = F.transform("parts", lambda p, i: F.struct(F.length(p).alias("length"), F.left(F.array_join(F.slice("parts", i + 1, most), ""), F.lit(most)).alias("head")))
    placed = offsets(cut.select("key", F.posexplode(ahead).alias("k", "x")).select("key", "k", "x.length", "x.head"), "key")
    named = F.array_compact(F.array(*(F.when(F.startswith("head", F.decode(F.lit(p), "ISO-8859-1")), F.lit(n)) for n, p in patterns.items())))
    return placed.select(F.col("key").alias(key), F.explode(named).alias("pattern"), "at")
