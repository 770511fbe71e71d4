"""Files made of documents, inspected, copied and checked."""

from inkglass.plans import inspect as plan
from inkglass.plans import samples

SF = "/root/testdata/sf0.001"


def test_made_files(spark):
    reports = {int(r.file_id): r for r in plan.inspect(samples.made_files(spark, SF)).collect()}
    assert {k % 4: r.format for k, r in reports.items()} == {0: "jpeg", 1: "png", 2: "pdf", 3: None}
    assert not [r for r in reports.values() if r.format in ("jpeg", "png") and r.structurally_unsound]
    codes = lambda k: {f.code for r in reports.values() if int(r.file_id) % 4 == k for f in r.findings}
    assert {"jpeg.comment", "exif.artist", "exif.orientation", "jpeg.trailing-data"} <= codes(0) and {"png.text-author", "png.text"} <= codes(1) and {"pdf.title", "pdf.javascript"} <= codes(2)
    assert samples.inspect_made_files(spark, SF).where("code = 'file.type-mismatch'").count() == 100


def test_made_files_hold_whole_texts(spark):
    import re

    from pyspark.sql import functions as F

    text = " ".join(f"word{k} \u00e9\u4e2d (x)" for k in range(12_000))
    made = spark.createDataFrame([(text,), ("",)], "text string").select("text", samples.jpeg_of(F.col("text")).alias("jpeg"), samples.png_of(F.col("text")).alias("png"), samples.pdf_of(F.col("text")).alias("pdf"))
    for r in made.collect():
        data, at, comment = bytes(r.jpeg), 2, b""
        while data[at + 1] != 0xDA:
            end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            comment += data[at + 4 : end] if data[at + 1] == 0xFE else b""
            at = end
        assert comment.decode() == r.text
        assert r.text.encode() in bytes(r.png) and re.sub("[^ -~]", "x", r.text).encode() in bytes(r.png)
        assert b"/Title (" + re.sub(r"[()\\]", " ", r.text).encode() + b")" in bytes(r.pdf)


def test_copies(spark):
    rows = samples.copies_of_made_files(spark, SF).collect()
    assert len(rows) == 10 * 100 and {r.status for r in rows} == {"pass", "skipped"} and {r.id for r in rows if r.status == "skipped"} == {"decode"}


def test_entry_without_llm():
    """The rest imports and lists its queries when the llm parts are gone."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as to:
        shutil.copytree(f"{root}/inkglass", f"{to}/inkglass", ignore=shutil.ignore_patterns("llm"))
        shutil.copy(f"{root}/__spark_entry__.py", to)
        code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession

q = e.queries()
assert q and not [k for k in q if k.startswith("op") or k == "pipeline"] and set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() == 200 and q["property_reports"](spark, "/root/testdata/sf0.001").count() == 200
"""
        subprocess.run([sys.executable, "-c", code], cwd=to, check=True, timeout=200)
        # a folder that has nothing but caches left
        os.makedirs(f"{to}/inkglass/llm/__pycache__")
        subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert not [k for k in e.queries() if k.startswith('op')]"], cwd=to, check=True, timeout=100)
