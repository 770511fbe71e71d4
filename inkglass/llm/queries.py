"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.llm import decontaminate, exact_copies, jaccard_regions, line_edits, line_rules, minimax_shards, pair_index_bpe, quotes, repair_files, token_alignment, url_rules, vector_codes, warc_members
from inkglass.llm.common import table

#: Where the vocabulary files of public tokenizers are, on every machine.
TOKENIZERS = os.environ.get("INKGLASS_TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op1_repair_token_files(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return repair_files.token_shards(table(spark, sf_dir, "documents"), f"{tokenizers}/word_bpe_49k.json")


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per message: its links, its place in reply order and the hash of its text without quotes."""
    found = quotes.link(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", F.sha2("clean_text", 256).alias("clean_sha256"), "max_level", "n_quoted_lines", "n_passages", "n_linked", "quoted_conv", "quoted_turn", "parent_turn", "root_turn", "depth")


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines that are not empty, and the numbers of those removed."""
    return line_edits.report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.assign(table(spark, sf_dir, "documents"), shards=40)


def op6_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.join(table(spark, sf_dir, "documents"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op8_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_members.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_pair_index_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return pair_index_bpe.round_trip(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json")


def op11_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_repair_token_files, op2_quotation_links, op3_line_edit_join, op4_decontaminate, op5_minimax_shards, op6_jaccard_regions, op7_line_rules, op8_warc_members, op9_url_rules, op10_pair_index_bpe, op11_exact_copies, op12_token_alignment, op13_vector_codes)}

def codes_sql(rounds: int) -> str:
    """Operator 13 in SQL: a pair of relations (nearest entries, new codebook) for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, min(gap) AS gap, arg_min(e, gap * 100 + e) AS e FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS gap FROM v JOIN b{k} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT o.p, o.e, o.j, coalesce(m.c, o.c) AS c FROM b{k} o LEFT JOIN (SELECT p, e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM v JOIN a{k} USING (r, p) GROUP BY p, e, j) m USING (p, e, j))""")
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding, len(embedding) // 8 AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        v AS MATERIALIZED (SELECT r, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, 8 * w + 1)) AS i FROM k)),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x AS c FROM v WHERE r <= 16),
        {", ".join(steps)},
        codes AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
        books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN codes USING (r), books"""


ORACLES = {
    # fast enough over whole tables at sf0.01 (windows of items against words in place)
    "op4_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        k AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
        lengths AS (SELECT DISTINCT n FROM k),
        d AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS s FROM w, lengths WHERE len(w) >= n),
        h AS (SELECT d.doc_id, d.i, d.n, k.item_id FROM d JOIN k ON d.s = k.s AND d.n = k.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM h GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_jaccard_regions": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        c AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, min(doc_id) AS id, any_value(s) AS s FROM s GROUP BY 1),
        m AS (SELECT s.doc_id, min(c.id) AS class FROM s JOIN c ON md5(array_to_string(list_sort(s.s), chr(10))) = c.c GROUP BY 1),
        e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM c),
        f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
        o AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN f USING (x) JOIN e b USING (x) WHERE a.id < b.id GROUP BY ALL),
        l AS (SELECT a, b FROM o WHERE 100 * shared >= 80 * (na + nb - shared)),
        g AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
        r(x, y) AS (SELECT id, id FROM c UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x),
        k AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.y, w.doc_id) AS component_id, coalesce(m.class, w.doc_id) AS class_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k ON k.x = m.class""",
    # a document is a distinct text of its host; lines are compared by their normalised form
    "op7_line_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
        n AS (SELECT *, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words, regexp_replace(lower(line), '[^\pL\pM\pN]+', '', 'g') AS letters FROM l),
        m AS (SELECT *, CASE WHEN letters <> '' THEN letters ELSE regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', '', 'g') END AS norm FROM n),
        hosts AS (SELECT source, count(DISTINCT text) AS n_docs FROM d GROUP BY source),
        often AS (SELECT source, norm, count(DISTINCT text) AS n FROM m WHERE norm <> '' GROUP BY source, norm HAVING count(DISTINCT text) >= 10),
        above AS (SELECT o.source, o.norm FROM often o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE o.n >= h.n_docs * 0.01),
        lines AS (SELECT doc_id, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines, coalesce(sum(words) FILTER (above.norm IS NOT NULL), 0) AS n_removed_words
            FROM m LEFT JOIN above ON m.norm = above.norm AND m.source IS NOT DISTINCT FROM above.source GROUP BY doc_id),
        windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS s FROM d),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM windows) WHERE k > 1),
        repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
        base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words FROM d JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM base""",
    "op8_warc_members": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p),
        bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(CAST(('0x' || h[i]) AS INTEGER) + 16), 4)), '') AS bits FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(bits[5 * k + j] AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER))) AS BIGINT)]), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM bits""",
    "op9_url_rules": r"""
        WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        m AS (SELECT h.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict FROM h JOIN r ON ((h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)) GROUP BY h.page_id)
        SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, CASE WHEN regexp_matches(url, '(?i)([?&](sessionid|phpsessid|jsessionid)=|/calendar/[0-9]{4}/|/(login|signin|logout)([/?#]|$)|/cart/(add|remove)([/?#]|$)|^https?://([^/?#]*\.)?adserver\.|\.(jpe?g|png|gif|webp|svg)([?#]|$))') THEN 'block' ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN m USING (page_id)""",
    "op11_exact_copies": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op13_vector_codes": codes_sql(6),
}
