"""Queries over the driver's tables for the native operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import text
from inkglass.functions.catalog import CATEGORIES, entries
from inkglass.operators import package_health, pdf_tokens, png_rules, segments
from inkglass.plans import findings as model
from inkglass.plans import removal
from inkglass.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Leading bytes (hex), one kind for each remainder of doc_id.
HEADS = ("89504e470d0a1a0a", "ffd8ffe0", "474946383961", "52494646000000005745425056503820", "0000001866747970", "504b0304", "49492a00", "4d4d002a", "d0cf11e0", "255044462d312e37", "0a0a255044462d", "")
NAMES = ("a.PNG", "b.jpg", "c.gif", "d/e.webp", "f.mp4", "g.docx", "h.tiff", "noext", ".hidden", "x.pdf", "y.jpg", "z.")


def pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes behind a signature that its id picks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("file_id"), pick(NAMES, F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 5 == 0, "image/png").alias("declared_type"),
        F.concat(F.unhex(pick(HEADS, F.col("doc_id"))), F.encode("text", "UTF-8")).alias("content"),
    )


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D3-D5, S1, S4 over all documents."""
    return files.fingerprint(made_files(spark, sf_dir))


DETECT_SQL = """CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 0 WHEN starts_with(h, 'FFD8FF') THEN 1 WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 2
    WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 3 WHEN substr(h, 9, 8) = '66747970' THEN 4 WHEN starts_with(h, '504B0304') OR starts_with(h, '504B0506') THEN 5
    WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 6 WHEN starts_with(h, 'D0CF11E0') THEN 7 WHEN regexp_matches(left(h, 2058), '^(..)*?255044462D') THEN 8 ELSE 9 END"""
MADE_SQL = f"""SELECT doc_id, {sql_list(NAMES)}[1 + doc_id % 12] AS name, CASE WHEN doc_id % 5 = 0 THEN 'image/png' END AS declared_type,
    upper({sql_list(HEADS)}[1 + doc_id % 12]) || hex(encode(text)) AS h FROM documents"""
FINGERPRINT_SQL = f"""
    WITH made AS ({MADE_SQL}), d AS (SELECT *, {DETECT_SQL} AS k FROM made),
    e AS (SELECT *, regexp_extract(lower(regexp_extract(name, '([^/\\\\]*)$', 1)), '^.+\\.([^.]+)$', 1) AS extension,
        ['png','jpeg',NULL,NULL,NULL,NULL,NULL,NULL,'pdf',NULL][k + 1] AS f,
        ['image/png','image/jpeg','image/gif','image/webp','video/mp4 or image/heic','application/zip','image/tiff','application/x-ole-storage','application/pdf','unknown'][k + 1] AS mime,
        ['PNG picture','JPEG picture','GIF picture','WebP picture','media file with an ftyp box','ZIP package','TIFF picture','OLE compound file','PDF file','content without a known signature'][k + 1] AS label FROM d)
    SELECT CAST(doc_id AS VARCHAR) AS file_id, name, declared_type, CAST(length(h) // 2 AS BIGINT) AS size, f AS detected_format, mime AS detected_type, label AS detected_label, k BETWEEN 2 AND 7 AS recognised_unsupported, extension,
        CASE WHEN f IS NULL OR extension = '' THEN 'unknown' WHEN (f = 'png' AND extension = 'png') OR (f = 'jpeg' AND extension IN ('jpg', 'jpeg', 'jpe', 'jfif')) OR (f = 'pdf' AND extension = 'pdf') THEN 'match' ELSE 'mismatch' END AS extension_check,
        CASE WHEN f IS NULL OR declared_type IS NULL THEN 'unknown' WHEN declared_type = mime THEN 'match' ELSE 'mismatch' END AS declared_type_check,
        sha256(unhex(h)) AS sha256, CASE WHEN f IS NULL THEN 'unsupported-format' END AS refusal FROM e"""


def mismatch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    return files.mismatches(fingerprint(spark, sf_dir))


MISMATCH_SQL = f"""WITH p AS ({FINGERPRINT_SQL}) SELECT file_id, 'file.type-mismatch' AS code, 'The content is a ' || detected_label || ', but '
    || concat_ws(' and ', CASE WHEN extension_check = 'mismatch' THEN 'the name ends in .' || extension END, CASE WHEN declared_type_check = 'mismatch' THEN 'the declared type is ' || declared_type END) || '.' AS value,
    'File name and type' AS source FROM p WHERE extension_check = 'mismatch' OR declared_type_check = 'mismatch'"""


def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7."""
    docs = table(spark, sf_dir, "documents")
    odd = F.concat(F.lit("a\u0001b​c\u0085\t"), F.col("text"))
    return docs.select("doc_id", text.display_text(odd).alias("shown"))


DISPLAY_SQL = r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace('a' || chr(1) || 'b' || chr(8203) || 'c' || chr(133) || chr(9) || text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', chr(65533), 'g'),
    '[\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}\x{61c}\x{feff}]', chr(65533), 'g') AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || '… (' || (length(s) - 400) || ' characters longer)' ELSE s END AS shown FROM c"""


def start_tag_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3, M6 on links."""
    pages = table(spark, sf_dir, "pages")
    tags = text.start_tags(F.col("html"), "a")
    rows = pages.select("page_id", tags.alias("tags")).withColumn("hrefs", F.array_distinct(F.filter(F.transform("tags", lambda t: text.attribute(t, "href")), lambda v: v != "")))
    return rows.select("page_id", F.size("tags").cast("long").alias("n_tags"), F.size("hrefs").cast("long").alias("n_values"), F.array_join(F.slice("hrefs", 1, 20), " ").alias("first_values"))


TAGS_SQL = r"""WITH t AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a(?:[\s/](?:[^<>"'']|"[^"]*"|''[^'']*'')*)?>'), lambda x: length(x) <= 4000) AS tags FROM pages),
    u AS (SELECT page_id, t.i, regexp_extract(tags[t.i], '\shref\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(tags[t.i], '\shref\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 2) AS v FROM t t0, unnest(range(1, len(tags) + 1)) AS t(i) WHERE t0.page_id IS NOT NULL),
    f AS (SELECT page_id, v, min(i) AS i FROM u WHERE v != '' GROUP BY page_id, v), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM f),
    g AS (SELECT page_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) FILTER (k <= 20) AS s FROM r GROUP BY page_id)
    SELECT t.page_id, CAST(len(tags) AS BIGINT) AS n_tags, CAST(coalesce(n, 0) AS BIGINT) AS n_values, coalesce(s, '') AS first_values FROM t LEFT JOIN g USING (page_id)"""


def extension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3, D4 on URLs without their query."""
    pages = table(spark, sf_dir, "pages").withColumn("e", text.extension(F.regexp_replace("url", "[?#].*$", "")))
    fmt = pick(("jpeg", "png", "pdf", "docx", "html"), F.col("page_id"))
    return pages.select("page_id", F.col("e").alias("extension"), files.extension_check(F.when(fmt != "html", fmt), F.col("e")).alias("extension_check"))


EXTENSION_SQL = r"""WITH e AS (SELECT page_id, substr(lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\]*)$', 1), '^.+\.([^.]+)$', 1)), 1, 16) AS extension, ['jpeg','png','pdf','docx',NULL][1 + page_id % 5] AS f FROM pages)
    SELECT page_id, extension, CASE WHEN f IS NULL OR extension = '' THEN 'unknown' WHEN f = 'jpeg' AND extension IN ('jpg','jpeg','jpe','jfif') OR f = 'png' AND extension = 'png' OR f = 'pdf' AND extension = 'pdf' OR f = 'docx' AND extension IN ('docx','docm','dotx','dotm') THEN 'match' ELSE 'mismatch' END AS extension_check FROM e"""


def strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1."""
    clean = text.strip_noise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("sha256"))


NOISE_SQL = r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<![^>\[-][^>]*(?:>|\z)', '', 'g') AS s FROM pages) SELECT page_id, CAST(length(s) AS BIGINT) AS n_chars, sha256(s) AS sha256 FROM c"""


def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, B10."""
    return table(spark, sf_dir, "pages").select("page_id", text.element_text(F.col("html"), "title").alias("title"))


ELEMENT_SQL = r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<title(?:\s[^>]*)?>(.*?)</', 1)[1:20], lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS x FROM pages),
    d AS (SELECT page_id, list_filter(list_transform(x, lambda s: trim(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s != '') AS x FROM t)
    SELECT page_id, substr(x[1], 1, 4000) AS title FROM d"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 (all names, over the corpus) on pages."""
    found = table(spark, sf_dir, "pages").select(F.explode(pdf_tokens.names(F.col("html"))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


TOKENS_SQL = r"""WITH t AS (SELECT unnest(regexp_extract_all(html, '/([^\x00\t\n\f\r ()<>\[\]{}/%]{1,48})', 1)) AS token FROM pages) SELECT token, count(*) AS n FROM t GROUP BY token"""

CATALOG_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in (i, *e)) + ")" for i, e in enumerate(entries()[:-1])) + ") AS c(i, code, category, label, privacy, grp, transformation)"
N_CODES = len(entries()) - 1


def raw_findings(spark: SparkSession, sf_dir: str, shown: bool = False) -> DataFrame:
    """Four to twelve findings a document, whose text they have (shown: as display text, worked out once a document), with codes
    that its id picks; some carry overrides."""
    docs = table(spark, sf_dir, "documents")
    if shown:
        docs = docs.withColumn("text", text.display_text(F.col("text")))
    code = F.element_at(F.array(*[F.lit(e[0]) for e in entries()[:-1]]), ((F.col("doc_id") * 7 + F.col("j") * 29) % N_CODES + 1).cast("int"))
    rows = docs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), 3 + F.col("doc_id") % 9)).alias("j"))
    return rows.select(
        F.col("doc_id").cast("string").alias("file_id"), (F.col("doc_id") * 16 + F.col("j")).alias("seq"), code.alias("code"), F.col("text").alias("value"), F.concat(F.lit("part "), F.col("j").cast("string")).alias("source"),
        F.when(F.col("doc_id") % 11 == 0, "-").when(F.col("doc_id") % 13 == 0, "exif").alias("grp"), F.when(F.col("doc_id") % 7 == 0, "suspicious").alias("status"), F.when(F.col("j") % 2 == 0, "bytes").alias("kind"), (F.col("doc_id") * 3).alias("offset"), (F.col("j") * 100).cast("long").alias("length"),
    )


RAW_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS file_id, doc_id * 16 + j AS seq, c.code, text AS value, 'part ' || j AS source, doc_id, j, c.category, c.label, c.privacy,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'exif' ELSE c.grp END AS grp, c.grp AS own_grp, c.transformation AS own, CASE WHEN doc_id % 7 = 0 THEN 'suspicious' ELSE 'verified' END AS status
    FROM (SELECT *, unnest(range(4 + doc_id % 9)) AS j FROM documents) JOIN {CATALOG_SQL} ON CAST(c.i AS BIGINT) = (doc_id * 7 + j * 29) % {N_CODES}"""
RESOLVED_SQL = f"""SELECT *, CASE WHEN grp IS NOT NULL THEN 'removable' WHEN own_grp IS NULL THEN own ELSE 'unsupported' END AS transformation FROM ({RAW_SQL})"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.resolve(raw_findings(spark, sf_dir, shown=True), shown=True)


def catalog_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    found = resolved(spark, sf_dir)
    return found.select("file_id", "seq", "code", "category", "label", "value", "source", "kind", "status", "confidence", "privacy", "grp", "transformation", "removable")


CATALOG_FINDINGS_SQL = f"""SELECT file_id, seq, code, category, label, value, source, CASE WHEN j % 2 = 0 THEN 'bytes' ELSE 'none' END AS kind, status, 'high' AS confidence, privacy, grp, transformation, transformation = 'removable' AS removable
    FROM (SELECT * REPLACE (CASE WHEN length(value) > 400 THEN substr(value, 1, 400) || '… (' || (length(value) - 400) || ' characters longer)' ELSE value END AS value) FROM (SELECT * REPLACE (regexp_replace(regexp_replace(value, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', chr(65533), 'g'), '[\\x{{200b}}-\\x{{200f}}\\x{{2028}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}\\x{{61c}}\\x{{feff}}]', chr(65533), 'g') AS value) FROM ({RESOLVED_SQL})))"""


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4's ranks, R7."""
    return model.category_counts(resolved(spark, sf_dir))


ROLLUP_SQL = f"SELECT file_id, category, count(*) AS n, CAST(list_position({sql_list(CATEGORIES)}, category) AS INTEGER) AS rank FROM ({RESOLVED_SQL}) GROUP BY file_id, category"


def capped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 with a cap of 6 and 3 more for essential codes."""
    return model.capped(resolved(spark, sf_dir), 6, 3).select("file_id", "seq", "id", "code")


# the list as a fold over each file's rows, not as windows
CAPPED_SQL = f"""
    WITH f AS (SELECT file_id, seq, code, regexp_matches(code, '^(jpeg|png|pdf)\\.(limit|truncated|invalid-segment|invalid|trailing-data|order|malformed)$|^image\\.') AS e FROM ({RESOLVED_SQL})),
    l AS (SELECT file_id, list(struct_pack(seq := seq, code := code, e := e) ORDER BY seq) AS x FROM f GROUP BY file_id),
    r AS (SELECT file_id, list_reduce(x, lambda s, y: struct_pack(n := CASE WHEN s.n < CASE WHEN y.e THEN 9 ELSE 6 END OR NOT s.told THEN s.n + 1 ELSE s.n END, told := s.told OR s.n >= CASE WHEN y.e THEN 9 ELSE 6 END,
        rows := CASE WHEN s.n < CASE WHEN y.e THEN 9 ELSE 6 END THEN list_append(s.rows, struct_pack(seq := y.seq, id := y.code || '#' || (s.n + 1), code := y.code))
            WHEN NOT s.told THEN list_append(s.rows, struct_pack(seq := y.seq, id := 'limit#' || (s.n + 1), code := 'limit.findings')) ELSE s.rows END),
        struct_pack(n := CAST(0 AS BIGINT), told := false, rows := CAST([] AS STRUCT(seq BIGINT, id VARCHAR, code VARCHAR)[]))) AS s FROM (SELECT file_id, x FROM l))
    SELECT file_id, o.seq, o.id, o.code FROM (SELECT file_id, unnest(s.rows) AS o FROM r)"""


def name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different sources of each language in order of their first document."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("at")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("s"))
    return first.select("lang", text.list_names(F.transform("s", lambda x: text.lower_first(F.concat(F.lit("Source "), x["source"])))).alias("names"))


NAMES_SQL = """WITH s AS (SELECT lang, source, min(doc_id) AS pos FROM documents GROUP BY lang, source), l AS (SELECT lang, list('source ' || source ORDER BY pos) AS s FROM s GROUP BY lang)
    SELECT lang, CASE WHEN len(s) > 4 THEN array_to_string(s[1:4], ', ') || ' and ' || (len(s) - 4) || ' more' ELSE array_to_string(s, ', ') END AS names FROM l"""


def share_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return model.share_notes(resolved(spark, sf_dir))


NOTES_SQL = f"""
    WITH f AS (SELECT *, CASE WHEN category = 'location' AND code = 'exif.gps-position' THEN 'gps' WHEN category = 'location' THEN 'place' WHEN category = 'identity' THEN 'identity' WHEN category = 'time' THEN 'time' WHEN category = 'device-software' THEN 'device'
        WHEN category = 'document-properties' THEN 'properties' WHEN category = 'embedded-content' THEN 'embedded' WHEN category = 'active-features' THEN 'active' WHEN category = 'unsupported' AND code LIKE '%.limit' THEN 'limits' WHEN category = 'unsupported' THEN 'unsupported' END AS id FROM ({RESOLVED_SQL})),
    n AS (SELECT file_id, id, any_value(category) AS category, count(*) AS n, count(*) FILTER (status = 'verified') AS fine, bool_or(contains(value, '°')) AS odd FROM f WHERE id IS NOT NULL GROUP BY file_id, id),
    l AS (SELECT file_id, id, label, min(seq) AS pos FROM f WHERE id IS NOT NULL GROUP BY ALL), m AS (SELECT file_id, id, list(CASE WHEN regexp_matches(label, '^.[a-z]') THEN lower(label[1]) || label[2:] ELSE label END ORDER BY pos) AS s FROM l GROUP BY file_id, id)
    SELECT file_id, CAST(list_position(['gps','place','identity','time','device','properties','embedded','active','limits','unsupported'], id) AS INTEGER) AS place, id, category, CASE WHEN id = 'gps' AND fine > 0 THEN fine ELSE n END AS n,
        CASE WHEN id != 'gps' THEN NULL WHEN fine > 0 THEN 'position' WHEN odd THEN 'out-of-range' ELSE 'undecodable' END AS detail,
        CASE WHEN id IN ('gps', 'active', 'limits') THEN NULL WHEN len(list_distinct(s)) > 4 THEN array_to_string(s[1:4], ', ') || ' and ' || (len(s) - 4) || ' more' ELSE array_to_string(s, ', ') END AS names FROM n JOIN m USING (file_id, id)"""


def presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4."""
    return model.presented(resolved(spark, sf_dir)).select("file_id", "seq", "place")


PRESENTED_SQL = f"SELECT file_id, seq, CAST(row_number() OVER (PARTITION BY file_id ORDER BY list_position({sql_list(CATEGORIES)}, category), code LIKE '%.limit' DESC, seq) AS INTEGER) AS place FROM ({RESOLVED_SQL})"


def bounded_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    return model.bounded(raw_findings(spark, sf_dir), "file_id", "seq", whole=7, first=5).select("file_id", "seq", "n", "rank")


BOUNDED_SQL = f"SELECT file_id, seq, n, CAST(rank AS INTEGER) AS rank FROM (SELECT file_id, seq, count(*) OVER (PARTITION BY file_id) AS n, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rank FROM ({RAW_SQL})) WHERE n <= 7 OR rank <= 5"


def made_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each file of raw_findings(), some of which refuse copies."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    return rows.select(F.col("k").cast("string").alias("file_id"), F.when(F.col("k") % 2 == 0, "jpeg").otherwise("png").alias("format"), F.when(F.col("k") % 10 == 3, "unsound").alias("copy_refusal"))


REPORTS_SQL = "SELECT CAST(k AS VARCHAR) AS file_id, CASE WHEN k % 2 = 0 THEN 'jpeg' ELSE 'png' END AS format, CASE WHEN k % 10 = 3 THEN 'unsound' END AS copy_refusal FROM (SELECT doc_id AS k FROM documents)"


def removal_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1."""
    return removal.offered(resolved(spark, sf_dir), made_reports(spark, sf_dir))


GROUPS_SQL = "(VALUES " + ", ".join(f"('{f}', '{g}', {i}, {str(d).lower()})" for i, (f, g, d) in enumerate(removal.GROUPS)) + ") AS g(format, grp, place, default_on)"
OFFERS_SQL = f"SELECT f.file_id, f.grp, g.place, g.default_on, count(*) AS n FROM ({RESOLVED_SQL}) f JOIN ({REPORTS_SQL}) r USING (file_id) JOIN {GROUPS_SQL} ON g.format = r.format AND g.grp = f.grp WHERE r.copy_refusal IS NULL GROUP BY ALL"


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that are on by default, for every file that offers them."""
    return removal_offers(spark, sf_dir).where("default_on").select("file_id", "grp")


def removal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that stay and go, by category."""
    found, selected = resolved(spark, sf_dir), chosen(spark, sf_dir)
    gone = removal.removed_by(found, selected).select("file_id", "category", F.lit("removed").alias("fate"))
    stay = removal.remaining_after(found, selected).select("file_id", "category", F.lit("staying").alias("fate"))
    return gone.unionByName(stay).groupBy("file_id", "category", "fate").agg(F.count(F.lit(1)).alias("n"))


PLAN_SQL = f"""WITH f AS ({RESOLVED_SQL}), s AS (SELECT file_id, grp FROM ({OFFERS_SQL}) WHERE default_on), m AS (SELECT f.*, f.transformation = 'removable' AND EXISTS (SELECT 1 FROM s WHERE s.file_id = f.file_id AND s.grp = f.grp) AS gone FROM f)
    SELECT file_id, category, CASE WHEN gone THEN 'removed' ELSE 'staying' END AS fate, count(*) AS n FROM m WHERE gone OR category != 'structural' GROUP BY ALL"""


def after_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy's inspection might find: two removals missed, some values changed."""
    found, selected = resolved(spark, sf_dir), chosen(spark, sf_dir)
    rows = removal.is_chosen(found, selected).where("NOT removed OR seq % 50 = 0")
    return rows.withColumn("value", F.when(F.col("seq") % 37 == 0, F.lit("changed")).otherwise(F.col("value"))).drop("removed")


AFTER_SQL = f"""SELECT file_id, code, label, CASE WHEN seq % 37 = 0 THEN 'changed' ELSE value END AS value FROM (SELECT f.*, f.transformation = 'removable' AND EXISTS (SELECT 1 FROM (SELECT file_id, grp FROM ({OFFERS_SQL}) WHERE default_on) s WHERE s.file_id = f.file_id AND s.grp = f.grp) AS gone FROM ({RESOLVED_SQL}) f) WHERE NOT gone OR seq % 50 = 0"""


def verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs, counted, with the verdict of each file."""
    diffs = removal.differences(resolved(spark, sf_dir), after_findings(spark, sf_dir), chosen(spark, sf_dir))
    return removal.with_verdict(removal.finding_checks(made_reports(spark, sf_dir), diffs))


DIFF_SQL = f"""
    WITH f AS (SELECT f.*, f.transformation = 'removable' AND EXISTS (SELECT 1 FROM (SELECT file_id, grp FROM ({OFFERS_SQL}) WHERE default_on) s WHERE s.file_id = f.file_id AND s.grp = f.grp) AS gone FROM ({RESOLVED_SQL}) f), a AS ({AFTER_SQL}),
    m AS (SELECT f.*, EXISTS (SELECT 1 FROM a WHERE a.file_id = f.file_id AND a.code = f.code AND a.label = f.label AND a.value IS NOT DISTINCT FROM f.value) AS there FROM f),
    w AS (SELECT a.file_id, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE a.file_id = f.file_id AND a.code = f.code AND a.label = f.label AND a.value IS NOT DISTINCT FROM f.value) GROUP BY a.file_id),
    c AS (SELECT file_id, count(*) FILTER (gone AND there) AS s, count(*) FILTER (transformation = 'preserved' AND NOT there AND NOT (code = 'exif.orientation' AND starts_with(value, '1'))) AS l FROM m GROUP BY file_id),
    k AS (SELECT r.file_id, coalesce(s, 0) AS s, coalesce(w.n, 0) AS n, coalesce(l, 0) AS l FROM ({REPORTS_SQL}) r LEFT JOIN c USING (file_id) LEFT JOIN w USING (file_id)),
    u AS (SELECT file_id, 'selected-removed' AS id, s AS n FROM k UNION ALL SELECT file_id, 'nothing-new', n FROM k UNION ALL SELECT file_id, 'kept-as-planned', l FROM k)
    SELECT file_id, id, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n, bool_and(n = 0) OVER (PARTITION BY file_id) AS all_passed FROM u"""


def byte_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 on a manifest made of documents."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("file_id"), pick(("keep", "remove", "rewrite-from", "rewrite-to"), F.col("doc_id")).alias("action"), F.octet_length("text").cast("long").alias("bytes"))
    return removal.byte_accounting(rows)


ACCOUNTING_SQL = """WITH r AS (SELECT source, ['keep','remove','rewrite-from','rewrite-to'][1 + doc_id % 4] AS a, octet_length(encode(text)) AS b FROM documents)
    SELECT source AS file_id, CAST(coalesce(sum(b) FILTER (a = 'keep'), 0) AS BIGINT) AS kept, CAST(coalesce(sum(b) FILTER (a = 'remove'), 0) AS BIGINT) AS removed, CAST(coalesce(sum(b) FILTER (a = 'rewrite-from'), 0) AS BIGINT) AS rewritten_from, CAST(coalesce(sum(b) FILTER (a = 'rewrite-to'), 0) AS BIGINT) AS rewritten_to FROM r GROUP BY source"""

TYPES = ("IHDR", "PLTE", "IDAT", "tEXt", "sRGB", "iCCP", "IDAT", "gAMA", "IEND", "fdAT")


def made_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("conv_id") * 31 + F.col("turn") * 17
    kind = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 != 0), "IHDR").otherwise(pick(TYPES, at))
    length = F.when((kind == "IHDR") & (F.col("conv_id") % 7 != 0), 13).when((kind == "IEND") & (F.col("conv_id") % 5 != 0), 0).otherwise(F.length("text"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), kind.alias("type"), length.cast("long").alias("length"))


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over chunk rows made of conversations (message = chunk)."""
    return png_rules.itemised(png_rules.order_issues(made_chunks(spark, sf_dir)), 3)


# the specification's rules, each told by a look at all chunks before
CHUNKS_SQL = f"""
    t AS (SELECT conv_id AS file_id, turn AS seq, CASE WHEN turn = 0 AND conv_id % 3 != 0 THEN 'IHDR' ELSE {sql_list(TYPES)}[1 + (conv_id * 31 + turn * 17) % 10] END AS type, length(text) AS n FROM conversations),
    c AS (SELECT file_id, seq, type, CASE WHEN type = 'IHDR' AND file_id % 7 != 0 THEN 13 WHEN type = 'IEND' AND file_id % 5 != 0 THEN 0 ELSE n END AS length FROM t),
    r AS (SELECT a.*, (SELECT count(*) FROM c b WHERE b.file_id = a.file_id AND b.seq < a.seq) AS k, (SELECT min(b.seq) FROM c b WHERE b.file_id = a.file_id AND b.seq < a.seq AND b.type = 'IDAT') AS idat, (SELECT count(*) FROM c b WHERE b.file_id = a.file_id AND b.seq < a.seq AND b.type = 'PLTE') > 0 AS plte,
        (SELECT count(*) FROM c b WHERE b.file_id = a.file_id AND b.seq < a.seq AND b.type = a.type) AS same FROM c a),
    i AS (SELECT file_id, 'first-not-ihdr' AS rule, seq, true AS fatal FROM r WHERE k = 0 AND type != 'IHDR' UNION ALL SELECT file_id, 'ihdr-length', seq, true FROM r WHERE k = 0 AND type = 'IHDR' AND length != 13
        UNION ALL SELECT file_id, 'repeated', seq, type IN ('IHDR', 'PLTE') FROM r WHERE same > 0 AND type IN ('IHDR', 'PLTE', 'sRGB', 'iCCP', 'gAMA')
        UNION ALL SELECT file_id, 'idat-not-together', seq, true FROM r WHERE type = 'IDAT' AND EXISTS (SELECT 1 FROM c b WHERE b.file_id = r.file_id AND b.seq > r.idat AND b.seq < r.seq AND b.type NOT IN ('IDAT', 'fdAT'))
        UNION ALL SELECT file_id, 'plte-after-idat', seq, true FROM r WHERE type = 'PLTE' AND idat IS NOT NULL UNION ALL SELECT file_id, 'colour-late', seq, false FROM r WHERE type IN ('sRGB', 'iCCP', 'gAMA') AND (idat IS NOT NULL OR plte)
        UNION ALL SELECT file_id, 'iend-data', seq, false FROM r WHERE type = 'IEND' AND length != 0
        UNION ALL SELECT file_id, 'no-idat', NULL, true FROM c GROUP BY file_id HAVING count(*) FILTER (type = 'IDAT') = 0 AND count(*) FILTER (type = 'IEND') > 0
        UNION ALL SELECT file_id, 'two-profiles', NULL, false FROM c GROUP BY file_id HAVING count(*) FILTER (type = 'iCCP') > 0 AND count(*) FILTER (type = 'sRGB') > 0)"""
CHUNK_SQL = f"""
    WITH {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq NULLS LAST, rule) AS rank FROM i)
    SELECT file_id, CAST(rank AS INTEGER) AS rank, rule, seq, CAST(NULL AS BIGINT) AS more FROM n WHERE rank <= 3 UNION ALL SELECT file_id, 4, 'more', NULL, count(*) - 3 FROM n GROUP BY file_id HAVING count(*) > 3"""


def chunk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the order of a file's chunks alone makes it unsound."""
    return png_rules.verdicts(made_chunks(spark, sf_dir))


VERDICTS_SQL = f"WITH {CHUNKS_SQL} SELECT f.file_id, count(i.rule) AS issues, coalesce(bool_or(i.fatal), false) AS unsound FROM (SELECT DISTINCT file_id FROM c) f LEFT JOIN i USING (file_id) GROUP BY f.file_id"


def file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6, in thousandths of a percent."""
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("n_chars").alias("size"))
    found = model.file_map(resolved(spark, sf_dir), sizes)
    return found.select("file_id", "seq", "category", F.floor(F.col("left_pct") * 1000).cast("long").alias("left_m"), F.floor(F.col("width_pct") * 1000).cast("long").alias("width_m"))


MAP_SQL = f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, n_chars AS size FROM documents)
    SELECT f.file_id, f.seq, f.category, CAST(floor(least(99.4::DOUBLE, 100.0::DOUBLE * (f.doc_id * 3) / greatest(size, 1)::DOUBLE) * 1000) AS BIGINT) AS left_m, CAST(floor(greatest(0.6::DOUBLE, 100.0::DOUBLE * (f.j * 100) / greatest(size, 1)::DOUBLE) * 1000) AS BIGINT) AS width_m FROM ({RESOLVED_SQL}) f JOIN s USING (file_id) WHERE j % 2 = 0"""


def package_health_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on entries made of documents (source = package)."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 41 == 0, "../").otherwise(""), F.lit("word/"), (F.col("doc_id") % 400).cast("string"))
    rows = docs.select(F.col("source").alias("file_id"), name.alias("name"), (F.col("doc_id") % 3).cast("int").alias("flags"), (F.col("n_chars") % 9).alias("compressed"), F.col("n_chars").alias("uncompressed"))
    return package_health.health(rows)


HEALTH_SQL = """WITH e AS (SELECT source AS file_id, CASE WHEN doc_id % 41 = 0 THEN '../' ELSE '' END || 'word/' || (doc_id % 400) AS name, doc_id % 3 AS flags, n_chars % 9 AS c, n_chars AS u FROM documents),
    g AS (SELECT file_id, count(*) AS n_entries, count(*) - count(DISTINCT name) AS n_duplicates, count(*) FILTER (name LIKE '../%') AS n_odd, coalesce(max(u // nullif(c, 0)), 0) AS worst_ratio, count(*) FILTER (flags % 2 = 1) AS n_encrypted, CAST(sum(u) AS BIGINT) AS declared_total FROM e GROUP BY file_id)
    SELECT *, n_duplicates > 0 OR n_odd > 0 OR worst_ratio > 1000 OR declared_total > 536870912 AS suspicious FROM g"""


def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11-B13."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.col("n_chars") * F.col("n_chars"))
    kind = pick(("bytes", "structure", "none"), F.col("doc_id"))
    return docs.select("doc_id", text.format_bytes(F.col("n")).alias("size"), text.plural(F.col("doc_id") % 3, "entry", "entries").alias("counted"), text.describe_location(kind, F.col("n_chars"), (F.col("doc_id") % 5).cast("long"), F.col("source")).alias("place"))


SHOWN_SQL = """WITH d AS (SELECT *, n_chars * n_chars AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 10240 THEN printf('%.1f', round(n / 1024, 1)) || ' KiB' WHEN n < 1048576 THEN printf('%.0f', round(n / 1024)) || ' KiB' WHEN n < 10485760 THEN printf('%.2f', round(n / 1048576, 2)) || ' MiB' ELSE printf('%.1f', round(n / 1048576, 1)) || ' MiB' END AS size,
        (doc_id % 3) || CASE WHEN doc_id % 3 = 1 THEN ' entry' ELSE ' entries' END AS counted,
        CASE WHEN doc_id % 3 = 0 THEN 'offset ' || format('{:,}', n_chars) || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ', 1 byte' ELSE ', ' || (doc_id % 5) || ' bytes' END
             WHEN doc_id % 3 = 1 THEN source ELSE 'no place in the bytes' END AS place FROM d"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, F5 on dates made of order dates."""
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    exif = F.concat(F.date_format(day, "yyyy:MM:dd"), F.lit(" 12:34:56"))
    pdf = F.concat(F.lit("D:"), F.date_format(day, "yyyyMMdd"), pick(("", "0102", "010203Z", "010203+05'30'"), F.col("o_orderkey")))
    return orders.select("o_orderkey", text.exif_date(exif).alias("exif"), text.pdf_date(pdf).alias("pdf"))


DATES_SQL = """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 12:34:56' AS exif, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || [' 00:00:00', ' 01:02:00', ' 01:02:03 UTC', ' 01:02:03 UTC+05:30'][CAST(1 + o_orderkey % 4 AS BIGINT)] AS pdf FROM orders"""


def hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the same content by hash, and the first of them."""
    prints = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return prints.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


DUPLICATES_SQL = "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"

def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for copies of files named as the pages' URLs end."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.download_name(F.regexp_replace("url", "^https?://", ""), pick(("jpeg", "png"), F.col("page_id"))).alias("name"))


DOWNLOAD_SQL = r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages), s AS (SELECT page_id, regexp_extract(CASE WHEN strpos(u, '.') > 1 THEN left(u, length(u) - strpos(reverse(u), '.')) ELSE u END, '([^/\\]*)$', 1) AS s FROM u),
    c AS (SELECT page_id, left(regexp_replace(regexp_replace(s, '[<>:"/\\|?*]+', '_', 'g'), '^[.\s]+|[.\s]+$', '', 'g'), 80) AS c FROM s)
    SELECT page_id, CASE WHEN c = '' THEN 'file' ELSE c END || '.experimental-copy.' || CASE WHEN page_id % 2 = 0 THEN 'jpg' ELSE 'png' END AS name FROM c"""


def trailing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after each document's bytes."""
    docs = table(spark, sf_dir, "documents").withColumn("b", F.encode("text", "UTF-8"))
    whole = F.concat("b", F.unhex(pick(("ffd8ffe0", "89504e47", "504b0304", "25504446", "00010203", "0001"), F.col("doc_id"))))
    return docs.select("doc_id", files.describe_trailing(whole, F.octet_length("b")).alias("kind"))


TRAILING_SQL = "SELECT doc_id, ['starts with a JPEG signature', 'starts with a PNG signature', 'starts with a ZIP signature', 'starts with a PDF signature', 'starts with no known signature', ''][1 + doc_id % 6] AS kind FROM documents"
MARKERS = (0xE0, 0xE1, 0xFE, 0xE2, 0xDB, 0xED, 0xE1, 0xE5, 0xC2, 0xC4)
PAYLOADS = ("4a46494600", "457869660000", "", "4943435f50524f46494c4500", "00", "50686f746f73686f7020332e3000", "58", "59", "08", "00")


def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as segments, looked up and numbered by kind."""
    rows = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") + F.col("turn") * 3
    made = rows.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.element_at(F.array(*map(F.lit, MARKERS)), (at % 10 + 1).cast("int")).alias("marker"), F.unhex(pick(PAYLOADS, at)).alias("payload"))
    found = segments.first_of_kind(segments.classified(made), "file_id", "kind", "seq")
    return found.select("file_id", "seq", "kind", "grp", "nth", "duplicate", segments.is_frame(F.col("marker")).alias("frame"))


SEGMENT_SQL = """WITH s AS (SELECT conv_id AS file_id, turn AS seq, 1 + (conv_id + turn * 3) % 10 AS k FROM conversations),
    c AS (SELECT file_id, seq, ['jfif','exif','comment','icc','structure','photoshop','app-other','app-other','structure','structure'][k] AS kind, [NULL,'exif','comments',NULL,NULL,'iptc','other-segments','other-segments',NULL,NULL][k] AS grp, k = 9 AS frame FROM s)
    SELECT * EXCLUDE (frame), CAST(row_number() OVER (PARTITION BY file_id, kind ORDER BY seq) AS INTEGER) AS nth, row_number() OVER (PARTITION BY file_id, kind ORDER BY seq) > 1 AS duplicate, frame FROM c"""


def profile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as numbered parts with a byte limit."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") > 1), 2).otherwise(1)).alias("number"), F.when(F.col("conv_id") % 3 == 0, 3).otherwise(4).alias("total"), F.octet_length("text").cast("long").alias("size"))
    return segments.numbered_parts(rows, "file_id", "number", "total", "size", 3000)


PARTS_SQL = """WITH p AS (SELECT conv_id AS file_id, turn + CASE WHEN conv_id % 5 = 0 AND turn > 1 THEN 2 ELSE 1 END AS number, CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 4 END AS total, octet_length(encode(text)) AS size FROM conversations),
    t AS (SELECT a.*, (SELECT sum(b.size) FROM p b WHERE b.file_id = a.file_id AND b.number <= a.number) AS s FROM p a)
    SELECT file_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) = any_value(total) AND min(number) = 1 AND max(number) = count(*) AS whole FROM t WHERE s <= 3000 GROUP BY file_id"""


def compared_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a folder of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    new = docs.where("doc_id % 10 != 3").withColumn("content", F.when(F.col("doc_id") % 10 == 4, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content")))
    return segments.compared_folders(docs.where("doc_id % 10 != 5"), new)


FOLDERS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'changed' WHEN 5 THEN 'unexpected' ELSE 'same' END AS state FROM documents"


def support_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10 and the support of each made report."""
    reports = made_reports(spark, sf_dir)
    return reports.select("file_id", model.support_label(F.when(F.col("file_id").cast("int") % 7 == 0, "pdf").otherwise(F.col("format")), F.col("copy_refusal")).alias("label"))


SUPPORT_SQL = f"SELECT file_id, CASE WHEN CAST(file_id AS INTEGER) % 7 = 0 THEN 'inspection only' WHEN copy_refusal IS NOT NULL THEN 'inspection only for this file' ELSE 'inspection and copy' END AS label FROM ({REPORTS_SQL})"


def pdf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw facts of bytes made of documents with end marks and ids."""
    docs = table(spark, sf_dir, "documents")
    head = F.concat(F.lit("%PDF-1."), (F.col("doc_id") % 8).cast("string"), F.lit("\n"))
    marks = F.repeat(F.lit("%%EOF\n"), (F.col("doc_id") % 4).cast("int"))
    ids = F.concat(F.lit("/ID [<AA"), (F.col("doc_id") % 10).cast("string"), F.lit("0> <BB>]\n"))
    found = pdf_tokens.raw_facts(F.encode(F.concat(head, F.regexp_replace("text", "%", ""), F.lit("\n"), ids, ids, marks), "UTF-8"))
    return docs.select("doc_id", found.alias("f")).select("doc_id", "f.version", F.col("f.eof_count").cast("long").alias("eof_count"), "f.eof_at_end", "f.id_first", "f.id_second", F.col("f.revisions").cast("long").alias("revisions"))


PDF_SQL = "SELECT doc_id, '1.' || (doc_id % 8) AS version, doc_id % 4 AS eof_count, doc_id % 4 > 0 AS eof_at_end, 'AA' || (doc_id % 10) || '0' AS id_first, 'BB' AS id_second, greatest(0, doc_id % 4 - 1) AS revisions FROM documents"


QUERIES = {
    "fingerprint": fingerprint, "mismatch_findings": mismatch_findings, "display_text": display_text, "start_tag_attrs": start_tag_attrs, "extension_check": extension_check, "strip_noise": strip_noise, "element_text": element_text, "token_counts": token_counts,
    "catalog_findings": catalog_findings, "category_rollup": category_rollup, "capped_findings": capped_findings, "name_list": name_list, "share_notes": share_notes, "presented": presented, "bounded_list": bounded_list, "removal_offers": removal_offers,
    "removal_plan": removal_plan, "verify_diff": verify_diff, "byte_accounting": byte_accounting, "chunk_order": chunk_order, "chunk_verdicts": chunk_verdicts, "file_map": file_map, "package_health": package_health_query, "shown_sizes": shown_sizes, "dates": dates, "hash_duplicates": hash_duplicates,
    "download_names": download_names, "trailing_kinds": trailing_kinds, "segment_kinds": segment_kinds, "profile_parts": profile_parts, "compared_folders": compared_folders, "support_labels": support_labels, "pdf_facts": pdf_facts,
}
ORACLES = {
    "fingerprint": FINGERPRINT_SQL, "mismatch_findings": MISMATCH_SQL, "display_text": DISPLAY_SQL, "start_tag_attrs": TAGS_SQL, "extension_check": EXTENSION_SQL, "strip_noise": NOISE_SQL, "element_text": ELEMENT_SQL, "token_counts": TOKENS_SQL,
    "catalog_findings": CATALOG_FINDINGS_SQL, "category_rollup": ROLLUP_SQL, "capped_findings": CAPPED_SQL, "name_list": NAMES_SQL, "share_notes": NOTES_SQL, "presented": PRESENTED_SQL, "bounded_list": BOUNDED_SQL, "removal_offers": OFFERS_SQL,
    "removal_plan": PLAN_SQL, "verify_diff": DIFF_SQL, "byte_accounting": ACCOUNTING_SQL, "chunk_order": CHUNK_SQL, "chunk_verdicts": VERDICTS_SQL, "file_map": MAP_SQL, "package_health": HEALTH_SQL, "shown_sizes": SHOWN_SQL, "dates": DATES_SQL, "hash_duplicates": DUPLICATES_SQL,
    "download_names": DOWNLOAD_SQL, "trailing_kinds": TRAILING_SQL, "segment_kinds": SEGMENT_SQL, "profile_parts": PARTS_SQL, "compared_folders": FOLDERS_SQL, "support_labels": SUPPORT_SQL, "pdf_facts": PDF_SQL,
}
