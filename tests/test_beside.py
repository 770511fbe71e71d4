"""Files are copied, compared and fingerprinted where their reports are made: nothing is shuffled or joined."""

import re

import pytest
from pyspark.sql import functions as F

from inkglass.functions import text
from inkglass.operators import pdf
from inkglass.plans import findings as model
from inkglass.plans import inspect as plan
from inkglass.plans import property_files, removal, samples
from inkglass.sources import files
from tests import gen

SF = "/root/testdata/sf0.001"


def shuffles(spark, df):
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return [w for w in ("Exchange", "Join") if w in text]


def test_property_copies_stay(spark):
    assert not shuffles(spark, property_files.property_copies(spark, SF))


def test_property_comparison_stays(spark):
    assert not shuffles(spark, property_files.property_comparison(spark, SF))


def test_property_reports_stay(spark):
    assert not shuffles(spark, property_files.property_reports(spark, SF))


def test_copies_of_made_files_stay(spark):
    assert not shuffles(spark, samples.copies_of_made_files(spark, SF))


@pytest.fixture(scope="module")
def table(spark):
    turned = [(f"{n}.png", property_files.png_file("a text", n)) for n in range(8)] + [(f"{n}.jpg", property_files.jpeg_file("a text", n)) for n in range(8)]
    rows = [*gen.samples().items(), *turned]
    return spark.createDataFrame([(n, n, None, b) for n, b in rows], "file_id string, name string, declared_type string, content binary")


def test_resolved_as_joined(spark, table):
    reports = plan.inspect(table)
    names = ("code", "category", "label", "value", "grp", "transformation")
    joined = plan.findings(reports).select("file_id", *names)
    beside = reports.select("file_id", F.explode(model.resolved(F.col("findings"))).alias("f")).select("file_id", *(f"f.{n}" for n in names))
    assert sorted(map(str, joined.collect())) == sorted(map(str, beside.collect()))
    bad = spark.sql("SELECT array(named_struct('code', 'no.such', 'value', 'v', 'category', CAST(NULL AS string), 'label', CAST(NULL AS string), 'grp', CAST(NULL AS string), 'transformation', CAST(NULL AS string))) AS f")
    with pytest.raises(Exception, match="unknown finding code"):
        bad.select(model.resolved(F.col("f"))).collect()


@pytest.mark.parametrize("default_only", [True, False])
def test_copies_beside_as_joined(spark, table, default_only):
    reports = plan.inspect(table)
    chosen = removal.offered(plan.findings(reports), reports.select("file_id", "format", "copy_refusal"))
    chosen = (chosen.where("default_on") if default_only else chosen).select("file_id", "grp")
    copies = plan.make_copies(table, chosen).cache()
    beside = plan.copy_inspected(plan.inspect(table, ("content",)), default_only).cache()
    told = lambda df: sorted((r.file_id, r.output, str(r.manifest), r.refusal, r.source_sha256) for r in df.collect())
    assert told(copies) == told(beside) and copies.count() > 15
    checks = lambda df: sorted((r.file_id, r.id, r.status, -1 if r.n is None else r.n) for r in df.collect())
    found = beside.select("file_id", F.explode("checks").alias("c")).select("file_id", "c.*")
    assert checks(plan.verify(table, copies, chosen)[0]) == checks(found)


def test_checks_count_findings(spark):
    """A copy from which nothing was removed, which lacks something kept and has something new, twice each."""
    f = lambda code, value, grp, what: {"code": code, "label": code, "value": value, "grp": grp, "transformation": what}
    before = [f("a", "x", "g", "removable"), f("a", "x", "g", "removable"), f("b", None, None, "preserved"), f("b", None, None, "preserved"), f("c", "1", "h", "removable")]
    after = [f("a", "x", "g", "removable"), f("n", "", None, "preserved"), f("n", "", None, "preserved"), f("n", None, None, "preserved")]
    shape = "array<struct<code:string,label:string,value:string,grp:string,transformation:string>>"
    df = spark.createDataFrame([(before, after, ["g"])], f"before {shape}, after {shape}, groups array<string>")
    assert [tuple(c) for c in df.select(removal.checks_of(F.col("before"), F.col("after"), F.col("groups")).alias("c")).first().c] == [("selected-removed", "fail", 2), ("nothing-new", "fail", 3), ("kept-as-planned", "fail", 2)]


def test_pdf_strings():
    for data, value in ((rb"(ab(c\)d)e\101\n)rest", b"ab(c)d)eA\n"), (b"()", b""), (b"(open", b"open"), (rb"(a\q(()))", b"aq(())")):
        found, end = pdf.literal(data, 0)
        assert bytes(found) == value and (data[:end] == data or data[end:] == b"rest")
    found, end = pdf.literal(b"(" + b"x" * (3 << 20) + b")", 0)
    assert len(found) == 1 << 20 and end == 1 + (1 << 20)


def test_many_small_files(spark, tmp_path):
    """Files lie in folders of bounded size, and a task reads more than 32 of them."""
    import os

    from inkglass.sources import files, ranges

    n = 2 * ranges.FOLDER_FILES + 1
    rows = spark.range(n).coalesce(1).select(F.concat("id", F.lit(".txt")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    ranges.write_copies(rows, f"{tmp_path}/many")
    assert sorted(len(os.listdir(f"{tmp_path}/many/{d}")) for d in os.listdir(f"{tmp_path}/many")) == [1, ranges.FOLDER_FILES, ranges.FOLDER_FILES]
    found = files.read_files(spark, f"{tmp_path}/many")
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < n // 32
    told = found.selectExpr("name", "CAST(content AS string) AS c").collect()
    assert len(told) == n and all(r.name == f"{r.c}.txt" for r in told)


def test_whole_files(spark, tmp_path):
    """Files are listed and opened in tasks: no list of them is kept in the driver. Odd names come out as they are."""
    from inkglass.plans import relations
    from inkglass.sources.whole import whole_files

    given = {"a b+%20#.txt": b"1", "deep/x/y/\u00fc.jpg": b"22", "deep/z.": b"x" * 5000, "deep/empty": b"", "_hidden/a": b"3", "deep/.b": b"4"}
    for name, data in given.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    for root in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        rows = whole_files(spark, root)
        assert {r.path: (r.length, bytes(r.content)) for r in rows.collect()} == {f"{root.rstrip('/')}/{n}": (len(b), b) for n, b in given.items() if b and "_" not in n and "/." not in n}
        to_ms = lambda at: at.replace(microsecond=at.microsecond // 1000 * 1000)
        assert {to_ms(r.modificationTime) for r in rows.collect()} == {r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where("length > 0").collect()}
    assert whole_files(spark, f"{tmp_path}/in", 2).count() == 2 and whole_files(spark, f"{tmp_path}/missing").count() == 0
    # a file that has grown shows its change
    rows = whole_files(spark, f"{tmp_path}/in")
    (tmp_path / "in" / "a b+%20#.txt").write_bytes(b"1 and more")
    assert rows.where("length = 1").first().content == b"1 "
    for query in (relations.folder_fingerprints, relations.written_copies):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "binaryFile" not in plan and "MapInArrow" in plan


def test_job_control_asks_for_state_once():
    import pandas as pd

    from inkglass.streaming.jobs import JobControl

    class Handle:
        calls, state = [], None

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.state

        def update(self, state):
            self.calls.append("update")
            self.state = state

        def registerTimer(self, at):
            self.calls.append("timer")

    control, handle = JobControl(1), Handle()
    control.init(handle)
    parts = [pd.DataFrame({"at_ms": [5, 3], "message_id": [2, 1], "kind": ["progress", "start"], "generation": [1.0, None]}), pd.DataFrame({"at_ms": [3], "message_id": [0], "kind": ["error"], "generation": [None]})]
    (out,) = control.handleInputRows(("k",), iter(parts), None)
    assert out["outcome"].tolist() == ["stale", "started", "progress"] and out["generation"].tolist() == [0, 1, 1] and handle.state == (1, True, 1, 1003)
    assert handle.calls == ["get", "timer", "update"]


def test_batches_count_values_and_kept_bytes(spark):
    """Rows with long values, or with bytes kept beside them, close a batch."""
    import pyarrow as pa

    schema = pa.schema([("file_id", pa.string()), ("findings", pa.list_(pa.struct([("value", pa.string())])))])
    long = [{"file_id": str(k), "findings": [{"value": "v" * (1 << 20)}]} for k in range(8)]
    assert max(b.num_rows for b in plan.together(iter(long), schema)) <= 2
    assert max(b.num_rows for b in plan.together(({"file_id": "x", "kept_bytes": 1 << 20} for _ in range(8)), schema)) <= 2
    plan.inspect(samples.made_files(spark, SF))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_property_files_need_no_pattern(spark, tmp_path):
    texts = {0: None, 1: "", 3: "  a? \né漢\U0001f600.b:,-~ ", 4: "".join(map(chr, range(1, 0x300))), 5: "\U0010ffff漢", 7: "x" * 70_000 + "é"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {i: re.sub(property_files.PLAIN, " ", t or "").strip(" ") for i, t in texts.items()}
    made = property_files.property_files(spark, str(tmp_path))
    assert "regexp_replace" not in optimized(made)
    assert {r.file_id: bytes(r.content) for r in made.collect()} == {str(i): property_files.MAKERS[i % 4](t, i) for i, t in plain.items()}


def test_comparison_makes_no_display_texts(spark):
    found = optimized(property_files.property_comparison(spark, SF))
    assert "MapInArrow" in found and "regexp_replace" not in found


def test_display_text_of_long_short_and_odd_values(spark):
    most = text.DISPLAY_CHARS
    values = [None, "", "a" * most, "é" * most, "é" * (most + 1), "".join(map(chr, range(1, 0x300))), "".join(map(chr, range(0x2000, 0x2100))), "\ufeff\t\n\r"]
    rows = spark.createDataFrame([*enumerate(values)], "i int, v string").select("i", text.display_text(F.col("v")).alias("d")).orderBy("i").collect()
    odd = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b-\u200f\u2028-\u202e\u2066-\u2069\u061c\ufeff]")
    assert [r.d for r in rows] == [v and odd.sub("�", v[:most]) + (f"… ({len(v) - most} characters longer)" if len(v) > most else "") for v in values]


def test_findings_of_made_files_in_one_pass(spark, table):
    rows = table.withColumn("declared_type", F.when(F.length("name") % 2 == 0, "image/PNG"))
    joined = plan.findings(plan.inspect(rows), files.fingerprint(rows))
    beside = plan.findings_of(rows)
    assert beside.schema.simpleString() == joined.schema.simpleString()
    assert sorted(map(str, beside.collect())) == sorted(map(str, joined.collect()))
    assert beside.where("seq = 0").count() > 2
    assert optimized(samples.inspect_made_files(spark, SF)).count("MapInArrow") == 1 and optimized(samples.inspect_made_files(spark, SF)).count("Relation") == 4


def test_checks_of_copies_are_made_once(spark):
    lines = optimized(samples.copies_of_made_files(spark, SF)).split("\n")
    assert not [x for x in lines if "Filter" in x and "regexp_replace" in x]
