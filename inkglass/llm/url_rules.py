r"""Operator 9: URL filters, pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression. The tokens that its matches must have whole (runs of ASCII letters
and digits in lower case) are read from the parsed pattern, as alternatives, each a set of tokens. The
tokens that occur in rules are counted over all URLs, each alternative is filed under its rarest
token, and a URL's own tokens fetch the candidate rules. Only those run their regular expressions. A
rule that needs no token is a candidate for every URL; the default rules have none such.

Host rules (host, path, verdict) come first: the longest rule that fits decides. Other URLs
get the verdict of the pattern rules: block if one fits, else allow.

Rules are lists or tables. Up to RULE_BYTES of text they are sent to all tasks. Beyond, they stay a
table: URL tokens are joined with the tokens under which rules are filed, and each candidate rule comes
to its URL as a row; only rules without a token are then sent to all tasks, and of these more than RULE_BYTES
are refused. Results are the same. `pattern_literals.list_rule` reads lines of filter lists.

Cases: a null URL or one without :// has an empty host and path, fits no host rule and is
allowed unless a pattern rule fits. Rules are tried in their order, in tables the order of their rows. Repeated
rows give repeated rows. An empty table gives none. Of other columns none is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import cut, light
from inkglass.llm.pattern_literals import alternatives

#: Text of rules that is sent to all tasks, at most.
RULE_BYTES = 8_000_000
#: (host, path, verdict)
HOST_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: (name, pattern over the URL): what is seldom worth crawling.
PATTERN_RULES = (
    ("session", r"(?ia)[?&](sessionid|phpsessid|jsessionid)="),
    ("calendar", r"(?ia)/calendar/[0-9]{4}/"),
    ("login", r"(?ia)/(login|signin|logout)([/?#]|$)"),
    ("cart", r"(?ia)/cart/(add|remove)([/?#]|$)"),
    ("tracker", r"(?ia)^https?://([^/?#]*\.)?adserver\."),
    ("image", r"(?ia)\.(jpe?g|png|gif|webp|svg)([?#]|$)"),
)
TOKEN = re.compile(r"[0-9a-z]+")


class Rule(NamedTuple):
    name: str
    kind: str
    length: int
    verdict: str
    pattern: str
    alternatives: tuple[tuple[str, ...], ...]


def lower(s: str) -> str:
    """A-Z only."""
    return s if s.islower() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the rules see them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A host rule as a pattern over 'host path', with the host's tokens."""
    own, tokens = lower(host), tuple(sorted(set(TOKEN.findall(lower(host)))))
    return Rule(own + path, "host", len(own + path), verdict, r"(?s)(?:[^ ]*\.)?" + re.escape(own) + " " + re.escape(path), (tokens,) if tokens else ())


def pattern_rule(name: str, pattern: str) -> Rule:
    return Rule(name, "pattern", 0, "block", pattern, alternatives(pattern))


def rule_list(host_rules: Iterable, pattern_rules: Iterable) -> list[Rule]:
    return [host_rule(*r) for r in host_rules] + [pattern_rule(*r[:2]) for r in pattern_rules]


def rule_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by the rarest token of each alternative, and those without one."""
    index: dict[str, list[int]] = {}
    always = []
    for k, rule in enumerate(rules):
        if not all(rule.alternatives) or not rule.alternatives:
            always.append(k)
            continue
        for token in {min(a, key=lambda t: (counts.get(t, 0), t)) for a in rule.alternatives}:
            index.setdefault(token, []).append(k)
    return index, always


@lru_cache(100_000)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def fitting(url: str | None, host: str, path: str, candidates: Iterable[Rule]) -> tuple[Rule | None, str | None]:
    """The longest host rule and the first pattern rule of these that fit."""
    whole, best, blocked = f"{host} {path}", None, None
    for rule in candidates:
        if rule.kind == "host":
            if host and (best is None or rule.length > best.length) and compiled(rule.pattern).match(whole):
                best = rule
        elif blocked is None and url is not None and compiled(rule.pattern).search(url):
            blocked = rule.name
    return best, blocked


def decide(url: str | None, rules: list[Rule], index: dict[str, list[int]], always: list[int]) -> tuple:
    """(host, path, rule, verdict, name of the pattern rule, rules tried)."""
    host, path = split_url(url)
    candidates = sorted({k for t in set(TOKEN.findall(lower(url or ""))) for k in index.get(t, ())} | set(always))
    best, blocked = fitting(url, host, path, map(rules.__getitem__, candidates))
    if best:
        return host, path, best.name, best.verdict, None, len(candidates)
    return host, path, None, "block" if blocked else "allow", blocked, len(candidates)


HOST_COLUMNS, PATTERN_COLUMNS = ("host", "path", "verdict"), ("name", "pattern")
SPLIT = "page_id {}, host string, path string, rule string, verdict string, pattern_rule string, n_tried int"
RULES = "kind string, name string, length long, verdict string, pattern string, alternatives array<array<string>>"


def text_bytes(rules: DataFrame | list, columns: tuple[str, ...]) -> int:
    if isinstance(rules, DataFrame):
        return rules.agg(F.sum(F.octet_length(F.to_json(F.struct(*columns))))).first()[0] or 0
    return sum(len(str(r).encode()) for r in rules)


def listed(rules: DataFrame | list, columns: tuple[str, ...]) -> list[tuple]:
    return [tuple(r) for r in rules.select(*columns).collect()] if isinstance(rules, DataFrame) else rules


def tokens(url: str) -> Column:
    """The different tokens of a URL; A-Z only become lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([0-9a-z]+)"), F.lit(1)))


def judge(pages: DataFrame, host_rules: DataFrame | Iterable = HOST_RULES, pattern_rules: DataFrame | Iterable = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule, n_tried of every URL. Tables of rules have the columns
    host, path, verdict and name, pattern."""
    host_rules, pattern_rules = (r if isinstance(r, DataFrame) else list(r) for r in (host_rules, pattern_rules))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    if text_bytes(host_rules, HOST_COLUMNS) + text_bytes(pattern_rules, PATTERN_COLUMNS) > RULE_BYTES:
        return judge_by_join(own, host_rules, pattern_rules)
    rules = rule_list(listed(host_rules, HOST_COLUMNS), listed(pattern_rules, PATTERN_COLUMNS))
    return judge_by_list(own, rules)


def judge_by_list(own: DataFrame, rules: list[Rule]) -> DataFrame:
    import pyarrow as pa

    spark = own.sparkSession
    wanted = sorted({t for rule in rules for a in rule.alternatives for t in a})
    known = light(spark.createDataFrame([(t,) for t in wanted], "t string"))
    counts = {r["t"]: r["n"] for r in own.select(F.explode(tokens("url")).alias("t")).join(known, "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a rule token at most
    index, always = rule_index(rules, counts)
    told = spark.sparkContext.broadcast((rules, index, always))

    def run(batches):
        for batch in batches:
            found = [decide(u, *told.value) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.string()) for i in range(5)), pa.array([x[5] for x in found], pa.int32())], names=["page_id", "host", "path", "rule", "verdict", "pattern_rule", "n_tried"])

    return own.mapInArrow(run, SPLIT.format(dict(own.dtypes)["page_id"]))


def rule_table(spark, host_rules: DataFrame | list, pattern_rules: DataFrame | list) -> DataFrame:
    """All rules with their alternatives and a number in their order."""
    import pyarrow as pa

    def made(kind: str, make, columns: tuple[str, ...]):
        def run(batches):
            for batch in batches:
                rules = [make(*row.values()) for row in batch.to_pylist()]
                names = ["kind", "name", "length", "verdict", "pattern", "alternatives"]
                yield pa.RecordBatch.from_pydict({n: [getattr(r, n) for r in rules] for n in names}, schema=pa.schema([*((n, pa.int64() if n == "length" else pa.string()) for n in names[:-1]), (names[-1], pa.list_(pa.list_(pa.string())))]))
        return run

    parts = []
    for kind, make, columns, rules in (("host", host_rule, HOST_COLUMNS, host_rules), ("pattern", pattern_rule, PATTERN_COLUMNS, pattern_rules)):
        frame = rules.select(*columns) if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r[: len(columns)]) for r in rules], ", ".join(f"{c} string" for c in columns))
        parts.append(frame.mapInArrow(made(kind, make, columns), RULES))
    return cut(parts[0].unionByName(parts[1]).withColumn("rid", F.monotonically_increasing_id()), "url-rules")


def judge_by_join(own: DataFrame, host_rules: DataFrame | list, pattern_rules: DataFrame | list) -> DataFrame:
    """The same for rules that stay a table."""
    import pyarrow as pa

    spark = own.sparkSession
    rules = rule_table(spark, host_rules, pattern_rules)
    free = (F.size("alternatives") == 0) | F.exists("alternatives", lambda a: F.size(a) == 0)
    loose = rules.where(free)
    if text_bytes(loose, ("name", "pattern")) > RULE_BYTES:
        raise ValueError(f"the rules without a token have more than {RULE_BYTES} bytes, which is the most that is sent to tasks")
    always = [Rule(r.name, r.kind, r.length, r.verdict, r.pattern, ()) for r in loose.orderBy("rid").collect()]
    order = [r.rid for r in loose.select("rid").orderBy("rid").collect()]

    urls = cut(own.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    words = urls.select("row", F.explode(tokens("url")).alias("t"))
    parts = rules.where(~free).select("rid", F.posexplode("alternatives").alias("k", "a")).select("rid", "k", F.explode("a").alias("t"))
    counts = words.join(parts.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))
    filed = cut(parts.join(counts, "t", "left").groupBy("rid", "k").agg(rarest.alias("x")).select("rid", F.col("x.t").alias("t")).distinct(), "url-filed")
    pairs = words.join(filed, "t").select("row", "rid").distinct().join(rules.drop("alternatives"), "rid").join(urls.select("row", "url"), "row")

    def tried(batches):
        for batch in batches:
            rows = batch.to_pylist()
            fits = [fitting(r["url"], *split_url(r["url"]), [Rule(r["name"], r["kind"], r["length"], r["verdict"], r["pattern"], ())]) != (None, None) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "rid", "kind", "name", "length", "verdict")), pa.array(fits, pa.bool_())], names=["row", "rid", "kind", "name", "length", "verdict", "fits"])

    held = pairs.mapInArrow(tried, "row long, rid long, kind string, name string, length long, verdict string, fits boolean")
    longest = F.max(F.when(F.col("fits") & (F.col("kind") == "host"), F.struct("length", (-F.col("rid")).alias("first"), "name", "verdict")))
    first = F.min(F.when(F.col("fits") & (F.col("kind") == "pattern"), F.struct("rid", "name")))
    found = held.groupBy("row").agg(longest.alias("host_rule"), first.alias("pattern_rule"), F.count(F.lit(1)).alias("n"))

    def decided(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                host, path = split_url(r["url"])
                best, blocked = r["host_rule"], r["pattern_rule"]
                # rules without a token: of equally long host rules and of pattern rules the first counts
                free_best, _ = fitting(None, host, path, always)
                if free_best and (not best or (free_best.length, -order[always.index(free_best)]) > (best["length"], best["first"])):
                    best = free_best._asdict()
                free_blocked = next(((k, a.name) for k, a in zip(order, always, strict=True) if a.kind == "pattern" and r["url"] is not None and compiled(a.pattern).search(r["url"])), None)
                name = min(x for x in (free_blocked, blocked and (blocked["rid"], blocked["name"])) if x)[1] if free_blocked or blocked else None
                n = (r["n"] or 0) + len(always)
                out.append((host, path, best["name"], best["verdict"], None, n) if best else (host, path, None, "block" if name else "allow", name, n))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([x[i] for x in out], pa.string()) for i in range(5)), pa.array([x[5] for x in out], pa.int32())], names=["page_id", "host", "path", "rule", "verdict", "pattern_rule", "n_tried"])

    return urls.join(found, "row", "left").select("page_id", "url", "host_rule", "pattern_rule", "n").mapInArrow(decided, SPLIT.format(dict(own.dtypes)["page_id"]))
