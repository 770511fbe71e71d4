"""Queries over places, ranges, parts, files and jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.functions import limits, text
from inkglass.functions.catalog import CATEGORIES
from inkglass.operators import byte_ranges, parts, places
from inkglass.operators.pdf_tokens import WATCHED
from inkglass.plans import findings as model
from inkglass.plans import queries as core
from inkglass.plans import removal
from inkglass.plans.queries import table
from inkglass.shared import new_folder
from inkglass.sources import files, ranges
from inkglass.sources.whole import whole_files
from inkglass.streaming import jobs
from inkglass.streaming.progress import BatchProgress


def tag_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M5: every start tag of all pages with its offsets and that of its closing tag."""
    return places.tags(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


# offsets by list sums, closing tags by a search in what follows
TAG_PLACES_SQL = rf"""
    WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<(?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*(?:[\s/](?:[^<>"'']|"[^"]*"|''[^'']*'')*)?>|</[A-Za-z_][\w.:-]*|[^<]+|<') AS x FROM pages),
    t AS (SELECT page_id, html, unnest(x) AS piece, unnest(list_transform(x, lambda s: length(s))) AS n, generate_subscripts(x, 1) AS k FROM p),
    o AS (SELECT page_id, html, piece, n, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_extract(piece, '^<([A-Za-z_][\w.:-]*)', 1) AS name FROM t),
    c AS (SELECT *, instr(substr(html, CAST(start + n + 1 AS BIGINT)), '</' || name) AS later FROM o WHERE name <> '' AND n <= {limits.TAG_CHARS})
    SELECT page_id, name, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, CASE WHEN later > 0 THEN CAST(start + n + later - 1 AS BIGINT) END AS close FROM c"""

#: Tokens with escapes, also across the bound of 48 characters, and the pieces of text that they replace.
LONG_TOKEN = "/" + "".join(f"#{b:02X}" for b in b"Metadata" * 6) + "x"
REPLACED = ((" the ", "/Java#53cript /3D /OCProperties "), (" and ", f" {LONG_TOKEN}/#55RI/Met#61data/Met#zzdata "), (" in ", " /ID[<0A 0b>\n<c1 D2>] "), (" of ", " /ID [(a)(b)]/ID "))


def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: each document's whole text with name tokens in place of some words."""
    made = F.col("text")
    for word, token in REPLACED:
        made = F.replace(made, F.lit(word), F.lit(token))
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(made, "UTF-8").alias("content"))


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """watched name tokens with their byte offsets."""
    return places.watched(places.tokens(token_documents(spark, sf_dir), "doc_id", F.col("content"))).select("doc_id", "at", "token")


def made_tokens_sql() -> str:
    made = "text"
    for word, token in REPLACED:
        quoted = token.replace("'", "''").replace("\n", "' || chr(10) || '")
        made = f"replace({made}, '{word}', '{quoted}')"
    return f"""m AS (SELECT doc_id, {made} AS s FROM documents),
    t AS (SELECT doc_id, s, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM (SELECT *, regexp_extract_all(s, '(?s)/(?:#[0-9A-Fa-f]{{2}}|[^\\x00\\t\\n\\f\\r ()<>\\[\\]{{}}/%]){{0,48}}|[^/]+') AS x FROM m)),
    o AS (SELECT doc_id, k, piece, coalesce(sum(octet_length(encode(piece))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, coalesce(lead(piece) OVER (PARTITION BY doc_id ORDER BY k), '') AS next FROM t)"""


# hexadecimal escapes of printable characters only, which is what the documents get
DECODED_SQL = "list_reduce(list_prepend(piece[2:], range(32, 127)::VARCHAR[]), lambda s, c: replace(replace(s, printf('#%02X', CAST(c AS INTEGER)), chr(CAST(c AS INTEGER))), printf('#%02x', CAST(c AS INTEGER)), chr(CAST(c AS INTEGER))))"
TOKEN_PLACES_SQL = f"""WITH {made_tokens_sql()}, d AS (SELECT doc_id, pos, {DECODED_SQL} AS token FROM o WHERE starts_with(piece, '/'))
    SELECT doc_id, CAST(pos AS BIGINT) AS at, token FROM d WHERE token IN ({', '.join(f"'{w}'" for w in WATCHED)})"""


def trailer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last hexadecimal identifiers of each document, and if it has literal ones."""
    return places.trailer_ids(places.tokens(token_documents(spark, sf_dir), "doc_id", F.col("content")), "doc_id")


TRAILER_SQL = rf"""WITH {made_tokens_sql()},
    i AS (SELECT doc_id, pos, regexp_extract(left(next, 200), '^\s*\[\s*<([0-9A-Fa-f\s]{{2,128}})>\s*<([0-9A-Fa-f\s]{{2,128}})>\s*\]', ['a', 'b']) AS x, regexp_matches(left(next, 200), '^\s*\[\s*\(') AS literal FROM o WHERE piece = '/ID'),
    g AS (SELECT doc_id, arg_max(x, pos) FILTER (x.a <> '') AS x, bool_or(literal) AS literal FROM i GROUP BY doc_id)
    SELECT doc_id, lower(regexp_replace(x.a, '\s', '', 'g')) AS id_first, lower(regexp_replace(x.b, '\s', '', 'g')) AS id_second, literal FROM g WHERE x IS NOT NULL OR literal"""

def low_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, with characters beyond ASCII and beyond 16 bits before it, as low bytes."""
    made = text.low_bytes(F.concat(F.lit("Ā€ÿ😀"), F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(made).cast("long").alias("n_bytes"), F.sha2(made, 256).alias("sha256"))


# units of code points, above 16 bits as two
LOW_BYTES_SQL = """
    WITH c AS (SELECT doc_id, list_transform(string_split('Ā€ÿ😀' || text, ''), lambda x: unicode(x)) AS c FROM documents),
    u AS (SELECT doc_id, flatten(list_transform(c, lambda p: CASE WHEN p > 65535 THEN [((p - 65536) // 1024) % 256, (p - 65536) % 256] ELSE [p % 256] END)) AS u FROM c)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n_bytes, sha256(unhex(array_to_string(list_transform(u, lambda b: printf('%02X', CAST(b AS INTEGER))), ''))) AS sha256 FROM u"""

#: Byte patterns, some of which overlap themselves or one another.
PATTERNS = {"pdf": b"%PDF-", "zip": b"PK\x03\x04", "url": b"http", "aa": b"aa", "ana": b"ana", "an": b"an", "umlaut": "ü".encode(), "stop": b". "}


def byte_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and where each pattern stands in each document's bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    found = places.occurrences(docs, "doc_id", F.col("content"), PATTERNS)
    return found.groupBy("doc_id", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.sum("at").alias("total"))


# every place of every document is tried
PATTERNS_SQL = f"""
    WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), p(pattern, x) AS (VALUES {', '.join(f"('{n}', '{b.hex().upper()}')" for n, b in PATTERNS.items())}),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * max(map(len, PATTERNS.values()))}) AS w FROM (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 AS BIGINT))) AS i FROM d))
    SELECT doc_id, pattern, count(*) AS n, min(i) AS first, max(i) AS last, CAST(sum(i) AS BIGINT) AS total FROM w JOIN p ON starts_with(w, x) GROUP BY doc_id, pattern"""

PART_BUDGET = 3000


def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as numbered parts, put together under a budget; of every seventh conversation the second is missing."""
    turns = table(spark, sf_dir, "conversations").where("NOT (conv_id % 7 = 3 AND turn = 1)")
    rows = turns.select("conv_id", (F.col("turn") - F.min("turn").over(W.partitionBy("conv_id")) + 1).alias("number"), F.encode("text", "UTF-8").alias("data"))
    found = parts.joined(rows, "conv_id", "number", "data", PART_BUDGET)
    return found.select("conv_id", "n_parts", "complete", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


PARTS_SQL = f"""
    WITH t AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) + 1 AS number, coalesce(text, '') AS s FROM conversations WHERE NOT (conv_id % 7 = 3 AND turn = 1)),
    g AS (SELECT conv_id, count(*) AS n_parts, list_sort(list(number)) = range(1, count(*) + 1) AND sum(octet_length(encode(s))) <= {PART_BUDGET} AS complete, string_agg(s, '' ORDER BY number) AS whole, first(s ORDER BY number, s) AS one FROM t GROUP BY conv_id)
    SELECT conv_id, n_parts, complete, CAST(octet_length(encode(CASE WHEN complete THEN whole ELSE one END)) AS BIGINT) AS n_bytes, sha256(CASE WHEN complete THEN whole ELSE one END) AS sha256 FROM g"""


def crc_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRC-32 of each conversation from those of its turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
    return parts.crc_of_parts(turns, "conv_id", "turn", "data")


# the CRC of the whole, byte by byte, with the usual table
CRC_SQL = """
    WITH k AS MATERIALIZED (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
    h AS (SELECT conv_id, hex(encode(string_agg(coalesce(text, ''), '' ORDER BY turn))) AS h FROM conversations GROUP BY conv_id),
    b AS (SELECT conv_id, list_transform(range(0, CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)) AS b FROM h)
    SELECT conv_id, len(b) AS n_bytes, CASE WHEN len(b) = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, k[xor(c, x) % 256 + 1])), 4294967295) END AS crc32 FROM b, k"""


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, k, offset, length, size: the byte range of every line (with its end) of every document. Of some the range is missing, too long, or beyond the end."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), F.posexplode(F.split(F.concat("text", F.lit("\n")), "(?<=\n)")).alias("k", "line"))
    rows = byte_ranges_offsets(docs.withColumn("n", F.octet_length(F.encode("line", "UTF-8"))).where("n > 0"))
    longer = F.when(F.col("file_id") % 3 == 1, 5 * (F.col("k") % 3)).otherwise(0)
    return rows.where("NOT (file_id % 3 = 0 AND k % 4 = 1)").select("file_id", "k", (F.col("at") - F.when(F.col("file_id") % 10 == 7, 3).otherwise(0)).alias("offset"), (F.col("n") + longer).cast("long").alias("length"), "size")


def byte_ranges_offsets(rows: DataFrame) -> DataFrame:
    return places.offsets(rows, "file_id", "n")


def range_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes, overlaps and what lies outside of all documents' ranges."""
    rows = line_ranges(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"))
    return byte_ranges.tiling(rows.select("file_id", "offset", "length"), sizes)


LINES_SQL = """l AS (SELECT doc_id AS file_id, octet_length(encode(text)) AS size, unnest(string_split(text, chr(10))) || chr(10) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    a AS (SELECT *, octet_length(encode(line)) AS n, coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
    r AS (SELECT file_id, k, CAST(pos - CASE WHEN file_id % 10 = 7 THEN 3 ELSE 0 END AS BIGINT) AS start, CAST(pos - CASE WHEN file_id % 10 = 7 THEN 3 ELSE 0 END + n + CASE WHEN file_id % 3 = 1 THEN 5 * (k % 3) ELSE 0 END AS BIGINT) AS stop, size FROM a WHERE NOT (file_id % 3 = 0 AND k % 4 = 1))"""
# a fold over each file's sorted ranges
TILING_SQL = f"""
    WITH {LINES_SQL},
    g AS (SELECT d.doc_id AS file_id, octet_length(encode(d.text)) AS size, coalesce(list(struct_pack(s := start, e := stop) ORDER BY start, stop DESC) FILTER (start IS NOT NULL), []) AS x FROM documents d LEFT JOIN r ON r.file_id = d.doc_id GROUP BY ALL),
    f AS (SELECT file_id, size, list_reduce(list_prepend(struct_pack(s := CAST(0 AS BIGINT), e := CAST(0 AS BIGINT), m := CAST(NULL AS BIGINT), rows := CAST([] AS STRUCT(kind VARCHAR, s BIGINT, e BIGINT)[])), list_transform(x, lambda y: struct_pack(s := y.s, e := y.e, m := CAST(NULL AS BIGINT), rows := CAST([] AS STRUCT(kind VARCHAR, s BIGINT, e BIGINT)[])))),
        lambda a, y: struct_pack(s := y.s, e := y.e, m := greatest(coalesce(a.m, 0), y.e), rows := list_concat(a.rows,
            CASE WHEN least(y.s, size) > greatest(coalesce(a.m, 0), 0) THEN [struct_pack(kind := 'hole', s := greatest(coalesce(a.m, 0), 0), e := least(y.s, size))] ELSE [] END,
            CASE WHEN y.s < coalesce(a.m, 0) AND a.m IS NOT NULL THEN [struct_pack(kind := 'overlap', s := y.s, e := least(y.e, a.m))] ELSE [] END,
            CASE WHEN y.s < 0 THEN [struct_pack(kind := 'outside', s := y.s, e := least(y.e, 0))] ELSE [] END,
            CASE WHEN y.e > size THEN [struct_pack(kind := 'outside', s := greatest(y.s, size), e := y.e)] ELSE [] END))) AS t FROM g),
    o AS (SELECT file_id, unnest(t.rows) AS y FROM f UNION ALL SELECT file_id, struct_pack(kind := 'hole', s := coalesce(t.m, 0), e := size) FROM f WHERE coalesce(t.m, 0) < size)
    SELECT file_id, y.kind AS kind, y.s AS start, y.e AS stop FROM o"""


def findings_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V5 by place: every tenth of a document's bytes is a finding; lines of even numbers are removed, some of which overlap. How much of each finding is gone."""
    size = F.octet_length(F.encode("text", "UTF-8")).cast("long")
    tenth = F.floor(F.col("size") / 10).cast("long")
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seq"))
    found = made.select("file_id", "seq", (F.col("seq") * tenth).alias("offset"), F.when(F.col("seq") == 9, F.lit(0)).otherwise(tenth + F.col("seq")).alias("length"))
    removed = line_ranges(spark, sf_dir).where("k % 2 = 0").select(F.col("file_id").cast("string").alias("file_id"), "offset", "length")
    return byte_ranges.by_place(found, removed)


# every byte range of a file against every other
BY_PLACE_SQL = f"""
    WITH {LINES_SQL},
    f AS (SELECT doc_id AS file_id, j AS seq, j * (octet_length(encode(text)) // 10) AS s, j * (octet_length(encode(text)) // 10) + CASE WHEN j = 9 THEN 0 ELSE octet_length(encode(text)) // 10 + j END AS e FROM documents, range(10) AS q(j)),
    m AS (SELECT file_id, start, stop, coalesce(max(stop) OVER (PARTITION BY file_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) AS reached FROM r WHERE k % 2 = 0),
    u AS (SELECT file_id, greatest(start, reached) AS start, stop FROM m WHERE stop > reached),
    c AS (SELECT f.file_id, f.seq, f.s, f.e, sum(greatest(0, least(f.e, u.stop) - greatest(f.s, u.start))) AS covered, bool_or(f.s >= u.start AND f.s < u.stop) AS at_start FROM f LEFT JOIN u ON u.file_id = f.file_id GROUP BY ALL)
    SELECT CAST(file_id AS VARCHAR) AS file_id, CAST(seq AS INTEGER) AS seq, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CASE WHEN e = s AND at_start THEN 'gone' WHEN e = s THEN 'kept' WHEN covered = e - s THEN 'gone' WHEN covered > 0 THEN 'cut' ELSE 'kept' END AS state FROM c"""


def ranged_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files are by their ends alone. The documents behind signatures are written as files first."""
    folder = new_folder(spark, "files")
    made = core.made_files(spark, sf_dir)
    ranges.write_copies(made.select(F.concat("file_id", F.lit("."), F.lower(F.regexp_extract("name", r"([^./]+)$", 1))).alias("name"), "content"), folder)
    found = ranges.detected(ranges.read_ranges(spark, folder).where("size > 0"))
    return found.select("name", "size", "detected_format", "detected_type", "detected_label", "extension_check", "refusal", "bytes_read")


RANGED_SQL = f"""
    WITH made AS ({core.MADE_SQL}), d AS (SELECT doc_id || '.' || lower(regexp_extract(name, '([^./]+)$', 1)) AS name, length(h) // 2 AS size, {core.DETECT_SQL} AS k FROM made),
    e AS (SELECT *, regexp_extract(name, '([^.]*)$', 1) AS extension, ['png','jpeg',NULL,NULL,NULL,NULL,NULL,NULL,'pdf',NULL][k + 1] AS f FROM d)
    SELECT CASE WHEN ends_with(name, '.') THEN rtrim(name, '.') ELSE name END AS name, CAST(size AS BIGINT) AS size, f AS detected_format,
        ['image/png','image/jpeg','image/gif','image/webp','video/mp4 or image/heic','application/zip','image/tiff','application/x-ole-storage','application/pdf','unknown'][k + 1] AS detected_type,
        ['PNG picture','JPEG picture','GIF picture','WebP picture','media file with an ftyp box','ZIP package','TIFF picture','OLE compound file','PDF file','content without a known signature'][k + 1] AS detected_label,
        CASE WHEN f IS NULL OR extension = '' THEN 'unknown' WHEN (f = 'png' AND extension = 'png') OR (f = 'jpeg' AND extension IN ('jpg', 'jpeg', 'jpe', 'jfif')) OR (f = 'pdf' AND extension = 'pdf') THEN 'match' ELSE 'mismatch' END AS extension_check,
        CASE WHEN f IS NULL THEN 'unsupported-format' END AS refusal, CAST(least(size, CASE WHEN k = 5 THEN {limits.SNIFF_BYTES + ranges.TAIL_BYTES} ELSE {limits.SNIFF_BYTES} END) AS BIGINT) AS bytes_read FROM e WHERE size > 0"""

def folder_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as files and read back whole; empty ones are left out by their length, before they are opened."""
    folder = new_folder(spark, "files")
    made = core.made_files(spark, sf_dir)
    ranges.write_copies(made.select(F.concat(F.lit("f"), "file_id", F.lit("."), F.lower(F.regexp_extract("name", r"([^./]+)$", 1))).alias("name"), "content"), folder)
    return files.fingerprint(files.as_files(whole_files(spark, folder, limits.FILE_BYTES))).drop("file_id", "declared_type", "declared_type_check")


FOLDER_SQL = f"""
    WITH p AS ({core.FINGERPRINT_SQL}), n AS (SELECT *, 'f' || file_id || '.' || lower(regexp_extract(name, '([^./]+)$', 1)) AS own FROM p WHERE size > 0),
    e AS (SELECT * EXCLUDE (name, extension), rtrim(own, '.') AS name, regexp_extract(own, '([^.]*)$', 1) AS extension FROM n)
    SELECT name, size, detected_format, detected_type, detected_label, recognised_unsupported, extension,
        CASE WHEN detected_format IS NULL OR extension = '' THEN 'unknown' WHEN (detected_format = 'png' AND extension = 'png') OR (detected_format = 'jpeg' AND extension IN ('jpg', 'jpeg', 'jpe', 'jfif')) OR (detected_format = 'pdf' AND extension = 'pdf') THEN 'match' ELSE 'mismatch' END AS extension_check, sha256, refusal FROM e"""

#: Names that no file may have, or not everywhere; %d stands for a number.
ODD_NAMES = ("copy %d.jpg", "a/b/../%d.png", "what? %d*.jpg", " .%d. ", "con.%d", "x\\y:%d")


def written_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text written as a file under a safe name, and read back."""
    folder = new_folder(spark, "copies")
    docs = table(spark, sf_dir, "documents")
    names = F.replace(core.pick(ODD_NAMES, F.col("doc_id")), F.lit("%d"), F.col("doc_id").cast("string"))
    ranges.write_copies(docs.select(names.alias("name"), F.encode("text", "UTF-8").alias("content")), folder)
    found = whole_files(spark, folder)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


WRITTEN_SQL = """SELECT ['copy ' || doc_id || '.jpg', doc_id || '.png', 'what_ ' || doc_id || '_.jpg', CAST(doc_id AS VARCHAR), 'file_con.' || doc_id, 'y_' || doc_id][1 + doc_id % 6] AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents WHERE text <> ''"""

#: What the kinds of events are taken for, and the seconds of a job.
MESSAGES = {"view": "start", "click": "progress", "purchase": "result", "error": "error", "signup": "cancel"}
JOB_SECONDS = 6 * 3600


def job_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: events as messages to a job control for each user; every fifth one names the generation before."""
    events = table(spark, sf_dir, "events")
    kinds = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("message_id"), F.get(F.array(F.element_at(kinds, F.col("event_type"))), 0).alias("kind"))
    begun = F.count_if(F.col("kind") == "start").over(W.partitionBy("key").orderBy("at", "message_id"))
    rows = rows.withColumn("generation", F.when(F.col("kind") != "start", begun - F.when(F.col("message_id") % 5 == 0, 1).otherwise(0)))
    folder = new_folder(spark, "jobs")
    rows.write.parquet(f"{folder}/messages")
    jobs.run_available(spark, f"{folder}/messages", f"{folder}/outcomes", f"{folder}/checkpoint", rows.schema, JOB_SECONDS)
    return spark.read.schema(jobs.ROWS).parquet(f"{folder}/outcomes").select("key", F.unix_millis("at").alias("at_ms"), "generation", "outcome", "message_id")


# a fold over each user's events; timers go off up to the last event of all
JOB_SQL = f"""
    WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id AS id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MESSAGES.items())} END AS kind FROM events),
    g AS (SELECT *, count(*) FILTER (kind = 'start') OVER (PARTITION BY user_id ORDER BY t, id) - CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS named FROM e),
    o AS (SELECT user_id, list(struct_pack(t := t, id := id, kind := kind, named := named) ORDER BY t, id) AS x FROM g GROUP BY user_id),
    b AS (SELECT user_id, list_transform(x, lambda y: struct_pack(t := y.t, id := y.id, kind := y.kind, named := y.named, gen := CAST(0 AS BIGINT), live := false, begun := CAST(0 AS BIGINT), due := CAST(0 AS BIGINT), rows := CAST([] AS STRUCT(tm BIGINT, gen BIGINT, what VARCHAR, id BIGINT)[]))) AS x FROM o),
    f AS (SELECT user_id, list_reduce(list_prepend(struct_pack(t := CAST(0 AS BIGINT), id := CAST(0 AS BIGINT), kind := '', named := CAST(0 AS BIGINT), gen := CAST(0 AS BIGINT), live := false, begun := CAST(0 AS BIGINT), due := CAST(0 AS BIGINT), rows := CAST([] AS STRUCT(tm BIGINT, gen BIGINT, what VARCHAR, id BIGINT)[])), x),
        lambda s, y: struct_pack(t := y.t, id := y.id, kind := y.kind, named := y.named, gen := CASE WHEN y.kind = 'start' THEN s.gen + 1 ELSE s.gen END,
            live := y.kind = 'start' OR (s.live AND y.t < s.due AND (y.named <> s.gen OR y.kind = 'progress')), begun := CASE WHEN y.kind = 'start' THEN y.id ELSE s.begun END, due := CASE WHEN y.kind = 'start' THEN y.t + {JOB_SECONDS * 1000} ELSE s.due END,
            rows := list_concat(s.rows, CASE WHEN s.live AND y.t >= s.due THEN [struct_pack(tm := s.due, gen := s.gen, what := 'timeout', id := s.begun)] ELSE [] END,
                CASE WHEN y.kind = 'start' AND s.live AND y.t < s.due THEN [struct_pack(tm := y.t, gen := s.gen, what := 'superseded', id := s.begun)] ELSE [] END,
                CASE WHEN y.kind = 'start' THEN [struct_pack(tm := y.t, gen := s.gen + 1, what := 'started', id := y.id)]
                    WHEN s.live AND y.t < s.due AND y.named = s.gen THEN [struct_pack(tm := y.t, gen := s.gen, what := CASE WHEN y.kind = 'cancel' THEN 'cancelled' ELSE y.kind END, id := y.id)]
                    ELSE [struct_pack(tm := y.t, gen := y.named, what := 'stale', id := y.id)] END))) AS s FROM b),
    r AS (SELECT user_id, unnest(s.rows) AS y FROM f UNION ALL SELECT user_id, struct_pack(tm := s.due, gen := s.gen, what := 'timeout', id := s.begun) FROM f WHERE s.live AND s.due <= (SELECT max(t) FROM e))
    SELECT CAST(user_id AS VARCHAR) AS key, y.tm AS at_ms, y.gen AS generation, y.what AS outcome, y.id AS message_id FROM r"""


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: files, bytes, refusals and findings that passed the stages of one job, which looks for files whose name or type is wrong."""
    progress = BatchProgress()
    count = F.count(F.lit(1))
    made = progress.stage("reading", core.made_files(spark, sf_dir), files=count, bytes=F.sum(F.octet_length("content")).cast("long"))
    prints = progress.stage("detecting", files.fingerprint(made), files=count, refusals=F.count("refusal"), recognised=F.count_if("recognised_unsupported"))
    found = progress.stage("finding", files.mismatches(prints), findings=count, characters=F.sum(F.length("value")).cast("long"))
    found.write.parquet(new_folder(spark, "mismatches"))
    return spark.createDataFrame(progress.figures(), "stage string, figure string, n long")


PROGRESS_SQL = f"""
    WITH p AS ({core.FINGERPRINT_SQL}), m AS ({core.MISMATCH_SQL})
    SELECT 'reading' AS stage, 'files' AS figure, count(*) AS n FROM p UNION ALL SELECT 'reading', 'bytes', CAST(sum(size) AS BIGINT) FROM p UNION ALL SELECT 'detecting', 'files', count(*) FROM p UNION ALL SELECT 'detecting', 'refusals', count(refusal) FROM p
    UNION ALL SELECT 'detecting', 'recognised', count(*) FILTER (recognised_unsupported) FROM p UNION ALL SELECT 'finding', 'findings', count(*) FROM m UNION ALL SELECT 'finding', 'characters', CAST(sum(length(value)) AS BIGINT) FROM m"""


def kinds_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of the categories that a file has notes of."""
    return model.kinds_text(core.share_notes(spark, sf_dir))


KINDS_SQL = f"""WITH n AS ({core.NOTES_SQL}), c AS (SELECT file_id, category, min(place) AS place FROM n WHERE category <> 'unsupported' GROUP BY ALL)
    SELECT file_id, 'Found in this file: ' || string_agg(replace(category, '-', ' '), ', ' ORDER BY place) || '.' AS kinds FROM c GROUP BY file_id"""


def selection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices that can't be made. Every sixth file chooses nothing, every fourth one a group that it may not offer."""
    offers = core.removal_offers(spark, sf_dir)
    reports = core.made_reports(spark, sf_dir)
    chosen = offers.where("default_on").select("file_id", "grp").unionByName(reports.where("CAST(file_id AS BIGINT) % 4 = 0").select("file_id", F.lit("xmp").alias("grp"))).where("CAST(file_id AS BIGINT) % 6 <> 0")
    return removal.selection_errors(reports, chosen, offers)


SELECTION_SQL = f"""
    WITH o AS ({core.OFFERS_SQL}), r AS ({core.REPORTS_SQL}),
    c AS (SELECT DISTINCT file_id, grp FROM (SELECT file_id, grp FROM o WHERE default_on UNION ALL SELECT file_id, 'xmp' FROM r WHERE CAST(file_id AS BIGINT) % 4 = 0) WHERE CAST(file_id AS BIGINT) % 6 <> 0)
    SELECT file_id, 'nothing-chosen' AS error, CAST(NULL AS VARCHAR) AS grp FROM r WHERE file_id NOT IN (SELECT file_id FROM c)
    UNION ALL SELECT file_id, 'not-offered', grp FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file_id = c.file_id AND o.grp = c.grp)"""


QUERIES = {f.__name__: f for f in (ranged_detection, folder_fingerprints, written_copies, job_control, batch_progress, tag_places, token_places, trailer_ids, low_bytes, byte_patterns, joined_parts, crc_of_parts, range_tiling, findings_by_place, kinds_sentences, selection_errors)}
ORACLES = {
    "ranged_detection": RANGED_SQL, "folder_fingerprints": FOLDER_SQL, "written_copies": WRITTEN_SQL, "job_control": JOB_SQL, "batch_progress": PROGRESS_SQL, "tag_places": TAG_PLACES_SQL, "token_places": TOKEN_PLACES_SQL, "trailer_ids": TRAILER_SQL, "low_bytes": LOW_BYTES_SQL, "byte_patterns": PATTERNS_SQL,
    "joined_parts": PARTS_SQL, "crc_of_parts": CRC_SQL, "range_tiling": TILING_SQL, "findings_by_place": BY_PLACE_SQL, "kinds_sentences": KINDS_SQL, "selection_errors": SELECTION_SQL,
}
