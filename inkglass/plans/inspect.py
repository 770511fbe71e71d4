"""Inspection of files: bytes to reports, findings and coverage; copies and their verification.

Walkers turn one file's bytes into rows in Python, a few files at a time (files are large, so
Arrow batches are cut to BATCH rows before they get there). Everything after that is DataFrame
code in plans.findings and plans.removal. A file that a walker can't take gives an error row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkglass.functions import limits
from inkglass.operators import docx, jpeg, pdf, png
from inkglass.operators.bytesio import Findings, TimeLimitError, time_limit
from inkglass.plans import findings as model
from inkglass.plans import removal
from inkglass.shared import small_batches
from inkglass.sources import files

FINDING = "code string, source string, value string, kind string, offset long, length long, path string, status string, confidence string, category string, label string, grp string, transformation string"
REPORT = f"file_id string, format string, width long, height long, orientation int, structurally_unsound boolean, copy_refusal string, error string, findings array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in FINDING.split(', ')))}>>, coverage array<struct<area:string,state:string,note:string>>"
NO_FINDING = {x.split()[0]: None for x in FINDING.split(", ")}
WALKERS = {"jpeg": jpeg.inspect, "png": png.inspect, "pdf": pdf.inspect, "docx": docx.inspect}


def format_of(data: bytes) -> str | None:
    """The format to walk; the rules are those of sources.files.detect and of the ZIP directory."""
    if data.startswith(png.SIGNATURE):
        return "png"
    if data.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if data[:4] in (b"PK\3\4", b"PK\5\6"):
        return "docx" if len(data) <= limits.FORMAT_BYTES["docx"] and docx.looks_like_docx(docx.directory(data)["entries"]) else None
    other = data[:6] in (b"GIF87a", b"GIF89a") or data[:4] in (b"II*\0", b"MM\0*", b"\xd0\xcf\x11\xe0") or data[4:8] == b"ftyp" or (data[:4] == b"RIFF" and data[8:12] == b"WEBP")
    return "pdf" if not other and b"%PDF-" in data[:1029] else None


def inspect_bytes(data: bytes) -> dict:
    """A report with its findings and coverage."""
    sink, fmt, error, report = Findings(), None, None, {}
    try:
        with time_limit(limits.SECONDS):
            if not data:
                error = "empty-file"
            elif (fmt := format_of(data)) is None:
                error = "zip-too-large" if data[:2] == b"PK" and len(data) > limits.FORMAT_BYTES["docx"] else "unsupported-format"
            elif len(data) > limits.FORMAT_BYTES[fmt]:
                error = "format-too-large"
            else:
                report = WALKERS[fmt](data, sink)
    except TimeLimitError:
        error, report = "time-limit", {"structurally_unsound": True, "copy_refusal": "the file took too long"}
    except Exception as e:  # one bad file must not end a stage; its text may hold content, so only its kind is told
        error = f"internal-{type(e).__name__}"
        report = {"structurally_unsound": True, "copy_refusal": "the file could not be walked"}
    keys = ("width", "height", "orientation", "structurally_unsound", "copy_refusal")
    return {"format": fmt, "error": error, **{k: report.get(k) for k in keys}, "findings": [NO_FINDING | row for row in sink.rows], "coverage": [dict(zip(("area", "state", "note"), a, strict=True)) for a in sink.areas]}


def together(rows: Iterator[dict], schema, most: int = 2 << 20) -> Iterator:
    """Record batches of rows, closed once they have some 2 MB of values."""
    import pyarrow as pa

    part, size = [], 0
    for row in rows:
        part.append(row)
        found = row.get("findings") or (row.get("copy") or {}).get("findings") or ()
        size += 400 * (1 + len(found) + len(row.get("manifest") or ())) + sum(len(f["value"] or "") for f in found) + len(row.get("output") or b"") + row.get("kept_bytes", 0)
        if size >= most:
            yield pa.RecordBatch.from_pylist(part, schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def beside(rows: DataFrame, made, shape: str, keep: tuple[str, ...]) -> DataFrame:
    """What made(batch) yields for each row, in order, with the row's columns to keep beside it: they are handed
    on as they came, so that a file's bytes and its report never have to be joined."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = rows.sparkSession.createDataFrame([], shape).schema
    arrow = to_arrow_schema(own)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, kept = 0, [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for part in together(made(batch), arrow):
                yield pa.RecordBatch.from_arrays([*part.columns, *(c.slice(at, part.num_rows) for c in kept)], names=[*arrow.names, *keep])
                at += part.num_rows

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, StructType([*own.fields, *(rows.schema[c] for c in keep)]))


def inspect(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One nested report a file, from (file_id, content), and the columns to keep."""
    def reports(batch) -> Iterator[dict]:
        ids, contents = batch.column(0).to_pylist(), batch.column(1)
        for k, file_id in enumerate(ids):  # one file's bytes at a time
            data = contents[k].as_py() or b""
            yield {"file_id": file_id, "kept_bytes": len(data) if keep else 0} | inspect_bytes(data)

    return beside(df.select(F.col("file_id").cast("string").alias("file_id"), "content", *(c for c in keep if c != "content")), reports, REPORT, keep)


def raw_findings(reports: DataFrame) -> DataFrame:
    return reports.select("file_id", F.posexplode("findings").alias("seq", "f")).select("file_id", (F.col("seq") + 1).alias("seq"), "f.*")


def coverage(reports: DataFrame) -> DataFrame:
    return reports.select("file_id", F.posexplode("coverage").alias("seq", "c")).select("file_id", "seq", "c.area", "c.state", "c.note")


def findings(reports: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Findings with their catalogue entries; with fingerprints, mismatches come first (seq 0)."""
    raw = raw_findings(reports)
    if prints is not None:
        raw = raw.unionByName(files.mismatches(prints).withColumn("seq", F.lit(0)).withColumn("status", F.lit("suspicious")), allowMissingColumns=True)
    return model.resolve(raw)


def findings_of(made: DataFrame) -> DataFrame:
    """findings() of files (file_id, name, declared_type, content) with their mismatches, from one pass over them: a file's
    fingerprint is made where it goes to its walker."""
    prints = files.fingerprint(made, keep=("content",))
    mismatch = F.when(F.expr(files.MISMATCH), F.array(files.mismatch_text())).otherwise(F.array().cast("array<string>"))
    reports = inspect(prints.select("file_id", "content", mismatch.alias("mismatch")), ("mismatch",))
    told = {"code": F.lit("file.type-mismatch"), "source": F.lit("File name and type"), "status": F.lit("suspicious")}
    one = lambda v: F.struct(*(told.get(n, v if n == "value" else F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in FINDING.split(", "))))
    raw = reports.select("file_id", (1 - F.size("mismatch")).alias("from"), F.posexplode(F.concat(F.transform("mismatch", one), "findings")).alias("seq", "f"))
    return model.resolve(raw.select("file_id", (F.col("seq") + F.col("from")).alias("seq"), "f.*"))


MANIFEST = "array<struct<action:string,what:string,grp:string,offset:long,bytes:long>>"


def copy_of(data: bytes, report: dict, groups: list[str]) -> tuple[bytes | None, list[dict] | None, str | None]:
    """A copy of an inspected file without the groups, its manifest, and why there is none."""
    fmt, refusal = report["format"], report["copy_refusal"]
    unknown = set(groups) - set(removal.group_ids(fmt)) if fmt else set()
    if report["error"] or refusal or unknown:
        return None, None, refusal or report["error"] or "a group that the format doesn't offer"
    return *{"jpeg": jpeg, "png": png}[fmt].rewrite(data, set(groups), report["orientation"]), None


def byte_verdicts(before: bytes, a: dict, after: bytes, b: dict) -> dict[str, str]:
    """pass or fail by check, of an original and a copy with their reports."""
    kind = {"jpeg": jpeg, "png": png}[a["format"]]
    same = a["format"] == b["format"]
    verdicts = {
        "format": same and not b["structurally_unsound"], "picture-data": same and kind.core(before) == kind.core(after), "display-data": same and kind.display(before) == kind.display(after),
        "dimensions": (a["width"], a["height"]) == (b["width"], b["height"]), "orientation": a["orientation"] == b["orientation"] or (a["orientation"], b["orientation"]) == (1, None),
    }
    return {k: "pass" if v else "fail" for k, v in verdicts.items()}


def copy_inspected(reports: DataFrame, default_only: bool) -> DataFrame:
    """Copies of inspected files (reports that keep `content`) without the groups that they offer (default_only: those that
    are on by default), each made and inspected where its original lies. Files that offer none are left out.

    file_id, output, manifest, refusal, source_sha256; report and copy: what was found of both files; found and copy.findings: their
    raw findings; before and after: these with catalogue entries; groups; checks: the ten checks (none where there is no copy)."""
    facts = ("format", "width", "height", "orientation", "structurally_unsound", "copy_refusal", "error")
    rows = reports.select("file_id", "content", F.struct(*facts).alias("report"), "findings", F.sha2("content", 256).alias("source_sha256"))
    rows = rows.withColumn("groups", removal.offered_groups(model.resolved(F.col("findings"), ("grp",)), F.col("report.format"), F.col("report.copy_refusal"), default_only)).where(F.size("groups") > 0)
    rows = rows.withColumn("found", F.transform("findings", lambda f: F.struct(*(f[n].alias(n) for n in model.TOLD)))).drop("findings")

    def made(batch) -> Iterator[dict]:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("content", "report", "groups", "source_sha256")]
        for k in range(batch.num_rows):
            data, report, groups, sha = (c[k].as_py() for c in columns)
            out, manifest, refusal = copy_of(data, report, groups)
            copy, verdicts = inspect_bytes(out or b""), []
            if out is not None:
                untouched = "pass" if hashlib.sha256(data).hexdigest() == sha else "fail"
                verdicts = [{"id": i, "status": v} for i, v in (byte_verdicts(data, report, out, copy) | {"original-untouched": untouched, "decode": "skipped"}).items()]  # there is no picture decoder
            yield {"output": out, "manifest": manifest, "refusal": refusal, "verdicts": verdicts, "copy": copy, "kept_bytes": len(data)}

    shape = f"output binary, manifest {MANIFEST}, refusal string, verdicts array<struct<id:string,status:string>>, copy struct<{REPORT.removeprefix('file_id string, ')}>"
    both = beside(rows, made, shape, ("file_id", "content", "report", "found", "groups", "source_sha256"))
    both = both.select("*", model.resolved(F.col("found")).alias("before"), model.resolved(F.col("copy.findings")).alias("after"))
    # facts of the structure may change where something was removed; they are not new findings
    told = F.filter("after", lambda f: (f["code"] != "jpeg.jfif-thumbnail") | f["value"].isNotNull())
    verdicts = F.transform("verdicts", lambda v: F.struct(v["id"].alias("id"), v["status"].alias("status"), F.lit(None).cast("long").alias("n")))
    checks = F.when(F.col("output").isNotNull(), F.concat(removal.checks_of(F.col("before"), told, F.col("groups")), verdicts))
    return both.select("file_id", "content", "output", "manifest", "refusal", "source_sha256", "report", "copy", "found", "before", "after", "groups", checks.alias("checks"))


def make_copies(df: DataFrame, selected: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """file_id, output, manifest (rows), refusal, source_sha256: copies of (file_id, content) without the chosen
    groups (file_id, grp). Files without a choice are left out. With fingerprints, a file whose content
    isn't the one that was inspected is refused."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = df.sparkSession.createDataFrame([], "file_id string, format string, output binary, manifest " + MANIFEST + ", refusal string, source_sha256 string").schema
    arrow = to_arrow_schema(schema)
    chosen = selected.groupBy(F.col("file_id").cast("string").alias("__id")).agg(F.collect_set("grp").alias("groups"))  # eleven groups at most

    def made(batches) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                file_id, data, groups, sha, told = (batch.column(i)[k].as_py() for i in range(5))
                if told is not None and told != sha:
                    yield {"file_id": file_id, "refusal": "the file has changed since it was inspected", "source_sha256": sha}
                    continue
                report = inspect_bytes(data or b"")
                out, manifest, refusal = copy_of(data, report, groups)
                yield {"file_id": file_id, "format": report["format"], "output": out, "manifest": manifest, "refusal": refusal, "source_sha256": sha}

    def run(batches) -> Iterator:
        return together(made(batches), arrow)

    rows = df.join(chosen, df["file_id"].cast("string") == F.col("__id")).select(F.col("__id").alias("file_id"), "content", "groups", F.sha2("content", 256).alias("sha"))
    if prints is None:
        rows = rows.withColumn("told", F.lit(None).cast("string"))
    else:
        rows = rows.join(prints.select(F.col("file_id").cast("string").alias("file_id"), F.col("sha256").alias("told")), "file_id", "left")
    return rows.mapInArrow(run, schema)


def manifest_rows(copies: DataFrame) -> DataFrame:
    return copies.select("file_id", F.posexplode("manifest").alias("seq", "m")).select("file_id", "seq", "m.*")


def byte_checks(originals: DataFrame, copies: DataFrame) -> DataFrame:
    """file_id, id, status of picture-data, display-data, format, dimensions, orientation, original-untouched and decode."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        for batch in batches:
            out: dict[str, list] = {"file_id": [], "id": [], "status": []}
            for k in range(batch.num_rows):
                file_id, before, after = (batch.column(i)[k].as_py() for i in range(3))
                verdicts = byte_verdicts(before, inspect_bytes(before), after, inspect_bytes(after))
                out["file_id"] += [file_id] * len(verdicts)
                out["id"] += list(verdicts)
                out["status"] += list(verdicts.values())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string()) for c, v in out.items()})

    both = originals.select(F.col("file_id").cast("string").alias("file_id"), "content").join(copies.where("output IS NOT NULL").select("file_id", "output", "source_sha256"), "file_id")
    found = both.select("file_id", "content", "output").mapInArrow(run, "file_id string, id string, status string")
    untouched = both.select("file_id", F.lit("original-untouched").alias("id"), F.when(F.sha2("content", 256) == F.col("source_sha256"), "pass").otherwise("fail").alias("status"))
    decode = both.select("file_id", F.lit("decode").alias("id"), F.lit("skipped").alias("status"))  # there is no picture decoder
    return found.unionByName(untouched).unionByName(decode)


def verify(originals: DataFrame, copies: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ten checks of each copy (file_id, id, status, n), and what differs. Findings are compared
    whole: the cap is for lists only."""
    made = copies.where("output IS NOT NULL")
    before = findings(inspect(originals.join(made.select("file_id"), "file_id", "left_semi")))
    after = findings(inspect(made.select("file_id", F.col("output").alias("content"))))
    # facts of the structure may change where something was removed; they are not new findings
    diffs = removal.differences(before, after.where("code != 'jpeg.jfif-thumbnail' OR value IS NOT NULL"), selected)
    checks = removal.finding_checks(made.select("file_id"), diffs).unionByName(byte_checks(originals, copies), allowMissingColumns=True)
    return checks, diffs


def compared_reports(copies: DataFrame) -> DataFrame:
    """Sizes in bytes and pixels, orientation and numbers of findings (without facts of the structure) of an
    original and its copy, side by side, from rows of copy_inspected()."""
    def side(p: str, content: str, report: str, found: str) -> list:
        n = F.size(F.filter(model.resolved(F.col(found), ("category",)), lambda f: f["category"] != "structural")).cast("long")
        return [F.octet_length(content).cast("long").alias(f"{p}_size"), *(F.col(f"{report}.{c}").alias(f"{p}_{c}") for c in ("width", "height", "orientation")), n.alias(f"{p}_findings")]
    return copies.select("file_id", *side("original", "content", "report", "found"), *side("copy", "output", "copy", "copy.findings"))


def inspected_prints(reports: DataFrame) -> DataFrame:
    """Fingerprints of inspected files (reports that keep name, declared_type and content), with the reports' own columns. A
    ZIP is a DOCX where its directory, as the walker has read it, says so."""
    return files.fingerprint(reports, F.coalesce(F.col("format") == "docx", F.lit(False)), ("format", "width", "height", "orientation", "structurally_unsound", "copy_refusal", "error"))
