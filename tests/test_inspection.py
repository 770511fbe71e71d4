"""Walkers, findings, copies, verification and the stream, on generated files."""

import random
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from inkglass.functions.catalog import BY_CODE
from inkglass.operators import docx, jpeg, packets, pdf, png
from inkglass.operators.bytesio import inflate
from inkglass.plans import inspect as plan
from inkglass.plans import findings as model
from inkglass.plans import removal, samples
from inkglass.sources import files
from inkglass.streaming.progress import Progress
from inkglass.streaming.stream import inspect_stream

from . import gen

SAMPLES = gen.samples()


def codes(data: bytes) -> dict:
    out: dict = {}
    for f in plan.inspect_bytes(data)["findings"]:
        out.setdefault(f["code"], []).append(f["value"])
    return out


def test_jpeg_findings():
    found = codes(SAMPLES["full.jpg"])
    assert found["exif.gps-position"] == ["0.250000° N, 0.750000° E"] and found["exif.gps-altitude"] == ["12.5 m above sea level"]
    assert found["exif.make"] == ["Maker"] and found["exif.datetime"] == ["2020-05-06 07:08:09"] and found["exif.orientation"] == ["6"] and found["exif.xp-field"] == ["Bob"]
    assert found["exif.serial"] == ["SN-1"] and found["exif.user-comment"] == ["a note"] and found["exif.makernote"] == ["30 bytes"] and "exif.thumbnail" in found
    assert found["xmp.creator"] == ["Ann Example; Bo Sample"] and found["xmp.tool"] == ["Paint & Co"] and found["xmp.location"] == ["Nowhere"] and found["xmp.document-id"] == ["uuid:1"]
    assert found["iptc.byline"] == ["Ann Example"] and found["iptc.location"] == ["Città"] and "photoshop.thumbnail" in found
    assert found["icc.profile"] == ["A profile, RGB display, ICC 2.4, profile dated 2019-3-04"] or found["icc.profile"][0].startswith("A profile, RGB display, ICC 2.4")
    assert found["jpeg.comment"] == ["a comment"] and "ZIP archive" in found["jpeg.trailing-data"][0] and {"jpeg.mpf", "jpeg.adobe", "jpeg.app-unknown", "jpeg.jfif-thumbnail"} <= set(found)
    assert set(codes(SAMPLES["clean.jpg"])) == {"jpeg.jfif", "image.dimensions"}
    assert "jpeg.duplicate" in codes(SAMPLES["two.jpg"]) and codes(SAMPLES["two.jpg"])["exif.make"] == ["A"]


@pytest.mark.parametrize("name, code", [("cut.jpg", "jpeg.truncated"), ("large.jpg", "image.extreme-dimensions"), ("bad.png", "png.crc-invalid"), ("order.png", "png.order"), ("cut.png", "png.truncated")])
def test_faults(name, code):
    report = plan.inspect_bytes(SAMPLES[name])
    assert code in {f["code"] for f in report["findings"]}
    assert (report["copy_refusal"] is not None) == (name in ("cut.jpg", "large.jpg", "cut.png"))


def test_png_findings():
    found = codes(SAMPLES["full.png"])
    assert found["png.text-author"] == ["Author: Ann Example"] and sorted(found["png.text"]) == ["Comment: packed", "Title: Ä"] and found["png.time"] == ["2021-02-03 04:05:06 UTC"]
    assert found["png.phys"] == ["72 x 72 dots per inch"] and found["exif.gps-position"] and found["xmp.creator"] and "png.known-private" in found and found["png.unknown-chunk"] == ["abCd, 7 bytes"]
    assert all(f["grp"] == "png-exif" for f in plan.inspect_bytes(SAMPLES["full.png"])["findings"] if f["code"] == "exif.gps-position")
    assert set(codes(SAMPLES["clean.png"])) == {"image.dimensions"}


def test_pdf_object_streams():
    found = codes(gen.packed_pdf())
    assert found["pdf.title"] == ["Packed"] and found["pdf.author"] == ["Ann"] and found["pdf.pages"] == ["1 pages"] and found["pdf.javascript"] == ["when opened"]
    assert "pdf.malformed" not in found and "pdf.limit" not in found and found["pdf.hidden-text"] == [None]
    # what stands later in the file wins, in plain form or in a stream
    assert codes(gen.packed_pdf(b"4 0 obj\n<< /Title (Plain) >>\nendobj\n"))["pdf.title"] == ["Plain"]
    later = gen.object_stream(11, {4: b"<< /Title (Newer) >>"})
    found = codes(gen.packed_pdf(b"4 0 obj\n<< /Title (Plain) >>\nendobj\n" + later))
    assert found["pdf.title"] == ["Newer"] and "pdf.author" not in found
    # predictors, damage, encryption
    found = codes(gen.packed_pdf(parms=b"/DecodeParms << /Predictor 12 >>"))
    assert "pdf.title" not in found and found["pdf.limit"] == ["1 of 1 object streams were not opened"] and "could not be opened" in found["pdf.malformed"][0]
    assert codes(gen.packed_pdf(gen.object_stream(11, {4: b"<< >>"}, packed=lambda x: b"no")))["pdf.limit"] == ["1 of 2 object streams were not opened"]
    found = codes(gen.packed_pdf(trailer=b"/Encrypt 12 0 R "))
    assert "pdf.encrypted" in found and "pdf.title" not in found and "pdf.limit" not in found
    # a stream of 64 MiB of zeros is read up to its limit
    assert "pdf.title" not in codes(gen.packed_pdf(info=bytes(64 << 20) + b"<< /Title (far) >>"))
    rng = random.Random(5)
    for _ in range(200):
        data = bytearray(gen.packed_pdf(later))
        for _ in range(rng.randrange(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        codes(bytes(data))


def test_pdf_and_docx_findings():
    found = codes(SAMPLES["plain.pdf"])
    assert found["pdf.title"] == ["A (small) title"] and found["pdf.author"] == ["Ann"] and found["pdf.created"] == ["2020-01-02 03:04:05 UTC+01:00"] and found["pdf.custom"] == ["Custom: mine"] and found["pdf.version"] == ["1.7"]
    assert "second id differs" in found["pdf.document-id"][0] and found["pdf.pages"] == ["1 pages"] and "pdf.javascript" not in found
    found = codes(SAMPLES["active.pdf"])
    assert "pdf.javascript" in found and "http://example.com/a" in found["pdf.actions"][0] and found["pdf.annotations"] == ["Link (1), Text (1)"] and found["pdf.annotation-author"] == ["Ann"]
    assert "pdf.encrypted" in codes(SAMPLES["locked.pdf"]) and "pdf.title" not in codes(SAMPLES["locked.pdf"])
    found = codes(SAMPLES["doc.docx"])
    assert found["docx.author"] == ["Ann Example"] and found["docx.tracked-authors"] == ["Ann & Co, Bo"] and found["docx.comments"] == ["1 comments"] and "secret" not in str(found)
    assert found["docx.hidden-text"] == ["1 runs"] and found["docx.custom"] == ["Case, Room"] and {"docx.macros", "docx.media", "docx.external", "docx.rsid", "docx.company"} <= set(found)
    assert "docx.zip-suspicious" in codes(SAMPLES["odd.docx"])
    names = {e["name"]: e for e in docx.directory(SAMPLES["doc.docx"])["entries"]}
    with zipfile.ZipFile(__import__("io").BytesIO(SAMPLES["doc.docx"])) as z:
        assert set(names) == set(z.namelist()) and all(docx.read_entry(SAMPLES["doc.docx"], names[n], 1 << 20)[0] == z.read(n) for n in names)


def test_bounded_parts():
    packed = zlib.compress(b"x" * 1000)
    assert inflate(packed, 1000) == (b"x" * 1000, False, False) and inflate(packed, 999) == (b"x" * 999, True, False) and inflate(packed[:-8], 5000)[2]
    assert docx.strip_noise("a<!-- x --><?p?><![CDATA[<b>&]]><!D>c<!-- open") == "a&lt;b&gt;&amp;c"
    assert docx.element_text("<a:t/><a:t> </a:t><a:t>x &lt; <i>y</i></a:t>", "t") == "x < y" and docx.element_text("<ta>no</ta>", "t") is None
    assert packets.decode_entities("&lt;&#65;&#x42;&#0;&no;&amp;lt;") == "<AB�&no;&lt;"
    assert packets.xmp_properties("<dc:title" * 50_000) == {} and packets.xmp_properties("<a b='" * 50_000) == {}
    listed = packets.xmp_properties('<d x:a="1 &lt; 2" x:b=\'no\'><dc:t>\n<rdf:Seq><rdf:li>one</rdf:li><rdf:li y="z"><b>two</b></rdf:li></rdf:Seq></dc:t><dc:t> three </dc:t><dc:u/></d>')
    assert listed["dc:t"] == ["one", "two", "three"] and listed["x:a"] == ["1 < 2"] and "x:b" not in listed and "dc:u" not in listed
    assert pdf.raw_scan(b"%PDF-1.4 /J#61vaScript /JS/JS %%EOF")["tokens"] == {"JavaScript": 1, "JS": 2}


def test_mutations_never_break():
    rng = random.Random(20)
    for data in SAMPLES.values():
        for _ in range(25):
            bad = bytearray(data)
            for _ in range(rng.randrange(1, 6)):
                if bad:
                    bad[rng.randrange(len(bad))] = rng.randrange(256)
            bad = bytes(bad[: rng.randrange(len(bad) + 1)] if rng.random() < 0.3 else bad)
            report = plan.inspect_bytes(bad)
            assert not (report["error"] or "").startswith("internal"), report["error"]
            for f in report["findings"]:
                assert f["code"] in BY_CODE and (f["offset"] is None or 0 <= f["offset"] <= len(bad))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(n, n, None, b) for n, b in SAMPLES.items()], "file_id string, name string, declared_type string, content binary")


def test_fingerprints_and_findings(spark, table):
    zips = [n for n, b in SAMPLES.items() if plan.format_of(b) == "docx"]
    prints = files.fingerprint(table, F.col("file_id").isin(zips))
    by = {r.file_id: r for r in prints.collect()}
    assert {n: r.detected_format for n, r in by.items()} == {n: plan.format_of(b) for n, b in SAMPLES.items()}
    assert by["wrong.png"].extension_check == "mismatch" and by["doc.docx"].extension_check == "match" and by["empty.jpg"].refusal == "empty-file" and by["notes.txt"].refusal == "unsupported-format"
    reports = plan.inspect(table)
    found = plan.findings(reports, prints).collect()
    assert all(r.removable == (r.transformation == "removable") and r.code in BY_CODE for r in found)
    assert [r.value for r in found if r.code == "file.type-mismatch" and r.file_id == "wrong.png"] == ["The content is a JPEG picture, but the name ends in .png."]
    assert plan.coverage(reports).where("state = 'not-inspected'").count() > 10


def direct_cap(rows, most, more):
    """The list made row by row."""
    out, told = [], False
    for seq, essential in rows:
        if len(out) >= most + more * essential:
            if not told:
                told = True
                out.append((seq, "limit"))
        else:
            out.append((seq, "x"))
    return out


def test_cap_rule(spark):
    rng = random.Random(3)
    rows, expect = [], {}
    for k in range(150):
        mine = [(i, rng.random() < 0.4) for i in range(rng.randrange(0, 20))]
        rows += [(f"f{k}", i, "jpeg.limit" if e else "jpeg.comment", "v", "s") for i, e in mine]
        expect[f"f{k}"] = direct_cap(mine, 5, 3)
    df = model.resolve(spark.createDataFrame(rows, "file_id string, seq long, code string, value string, source string"))
    got: dict = {k: [] for k in expect}
    for r in model.capped(df, 5, 3).orderBy("file_id", "seq").collect():
        got[r.file_id].append((r.seq, "limit" if r.code == "limit.findings" else "x"))
    assert got == expect
    with pytest.raises(Exception, match="unknown finding code"):
        model.resolve(spark.createDataFrame([("f", 1, "no.such", "v", "s")], "file_id string, seq long, code string, value string, source string")).collect()


def test_copies_and_checks(spark, table):
    every = [("full.jpg", g) for g in removal.group_ids("jpeg")] + [("full.png", g) for g in removal.group_ids("png")] + [("turned1.jpg", "exif"), ("turned1.jpg", "xmp"), ("cut.jpg", "exif"), ("plain.pdf", "exif")]
    chosen = spark.createDataFrame(every, "file_id string, grp string")
    copies = plan.make_copies(table, chosen).cache()
    made = {r.file_id: r for r in copies.collect()}
    assert made["cut.jpg"].output is None and made["plain.pdf"].output is None and made["full.jpg"].output is not None
    left = set(codes(made["full.jpg"].output))
    assert left == {"jpeg.jfif", "jpeg.adobe", "icc.profile", "image.dimensions", "exif.orientation"}
    assert set(codes(made["full.png"].output)) == {"png.phys", "icc.profile", "image.dimensions", "exif.orientation"}
    sums = {r.file_id: r for r in removal.byte_accounting(plan.manifest_rows(copies)).collect()}
    for n in ("full.jpg", "full.png", "turned1.jpg"):
        s = sums[n]
        assert len(SAMPLES[n]) - s.removed - s.rewritten_from + s.rewritten_to == len(made[n].output)
    checks, _ = plan.verify(table, copies, chosen)
    status = {(r.file_id, r.id): r.status for r in checks.collect()}
    assert len(status) == 30 and {k[1] for k in status} == set(removal.CHECKS)
    assert {v for k, v in status.items() if k[1] == "decode"} == {"skipped"}
    assert not {k: v for k, v in status.items() if v == "fail"}
    # a copy whose picture was changed, and one from which nothing was removed
    out = made["full.jpg"].output
    bad = out.replace(b"\x12\x34", b"\x12\x35")
    worse = copies.where("file_id = 'full.jpg'").withColumn("output", F.lit(bad))
    status = {r.id: r.status for r in plan.verify(table, worse, chosen)[0].collect()}
    assert status["picture-data"] == "fail" and status["selected-removed"] == "pass"
    same = copies.where("file_id = 'full.jpg'").withColumn("output", F.lit(SAMPLES["full.jpg"]))
    status = {r.id: r.status for r in plan.verify(table, same, chosen)[0].collect()}
    assert status["selected-removed"] == "fail"


def test_read_and_stream(spark, tmp_path):
    for n, b in SAMPLES.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / n).write_bytes(b)
    rows = files.read_files(spark, f"{tmp_path}/in")
    assert rows.count() == len(SAMPLES) - 1 and files.refused(spark, f"{tmp_path}/in").count() == 0
    assert "PushedFilters: [IsNotNull(length), GreaterThanOrEqual(length,1)" in spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    spark.streams.addListener(progress := Progress())
    query = inspect_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(100)
    for _ in range(100):
        if progress.now.get(str(query.runId), ("",))[0] == "done":
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.now[str(query.runId)] == ("done", len(SAMPLES) - 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(SAMPLES) - 1


def test_stress_files(spark):
    rows = model.capped(plan.findings(plan.inspect(samples.many_comments(spark, 3))))
    per = {r.file_id: r for r in rows.groupBy("file_id").agg(F.count_if(F.col("code") == "jpeg.comment").alias("comments"), F.count_if(F.col("code") == "limit.findings").alias("notices"), F.count("*").alias("n")).collect()}
    assert set(per) == {"0", "1", "2"} and all(600 <= r.n <= 701 and 590 < r.comments <= 600 and r.notices == 1 for r in per.values())
    assert model.capped(plan.findings(plan.inspect(samples.many_comments(spark, 1, 20)))).where("code = 'limit.findings'").isEmpty()
    found = codes(samples.many_pages(spark, 1).first().content)
    assert found["pdf.pages"] == ["5000 pages"] and found["pdf.annotations"] == ["Text (200)"] and len(found["pdf.limit"]) == 1
