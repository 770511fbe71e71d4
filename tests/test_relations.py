"""Places, ranges, parts, ranged files, copies and jobs against plain Python."""

import os
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkglass.functions import limits, text
from inkglass.operators import byte_ranges, packets, parts, places
from inkglass.operators.pdf_tokens import WATCHED
from inkglass.plans import removal
from inkglass.sources import ranges
from inkglass.streaming import jobs
from inkglass.streaming.progress import BatchProgress


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def tags_of(html):
    """(name, start, stop, close) by a scan from place to place."""
    tag = re.compile(r"""(?s)<((?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*)(?=[\s/>])(?:[^<>"']|"[^"]*"|'[^']*')*>""", re.A)
    out, at = [], 0
    while (at := html.find("<", at)) >= 0:
        m = tag.match(html, at)
        if not m:
            at += 1
            continue
        close = html.find("</" + m[1], m.end())
        if len(m[0]) <= limits.TAG_CHARS:
            out.append((m[1], at, m.end(), close if close >= 0 else None))
        at = m.end()
    return out


def test_tags_have_places(spark):
    rng = random.Random(3)
    bits = ["<a>", "</a>", "<ab x='>'>", "</ab>", "</abc", "<w:t>", "</w:t>", "<br/>", "x", " ", "<", ">", "é😀", "<a\n", "</", '<b y="<">', "</b>", "<1>", "'", '"']
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", None, "<a " + "x" * limits.TAG_CHARS + "></a>", "<p>" * 2000 + "</p>", "</" + "n" * 5000, "<n></nn></n>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, html string").withColumns({"k": F.lit("x"), "at": F.lit(1)})
    expect = [(i, *t) for i, h in enumerate(texts) for t in tags_of(h or "")]
    assert rows_of(places.tags(frame, "id", F.col("html"))) == sorted(expect, key=str)
    assert places.tags(frame.limit(0), "id", F.col("html")).count() == 0


def tokens_of(data):
    """(at, decoded name) by a walk over the bytes."""
    stop, out, p = b"\x00\t\n\x0c\r ()<>[]{}/%", [], data.find(b"/")
    while p >= 0:
        name, q = [], p + 1
        while q < len(data) and len(name) < 48 and data[q] not in stop:
            escaped = re.match(rb"#([0-9A-Fa-f]{2})", data[q : q + 3])
            name.append(int(escaped[1], 16) if escaped else data[q])
            q += 3 if escaped else 1
        out.append((p, bytes(name).decode("latin-1")))
        p = data.find(b"/", max(q, p + 1))
    return out


def test_name_tokens_have_places(spark):
    rng = random.Random(4)
    bits = [b"/", b"#41", b"#4", b"#", b"a", b"\xff", b" ", b"JS", b"(", b"3D", b"#zz", b"\n", b"x" * 20, "ü".encode()]
    made = [b"".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(300)] + [b"", None, b"/" + b"#4D" * 47 + b"#4a#53 ", b"/" * 100]
    frame = spark.createDataFrame(list(enumerate(made)), "id long, content binary")
    found = places.tokens(frame, "id", F.col("content"))
    assert rows_of(found.select("id", "at", "token")) == sorted([(i, *t) for i, d in enumerate(made) for t in tokens_of(d or b"")], key=str)
    ids = [b"/ID [<0A\n0b> <CC>]", b"/ID[(x)(y)] /ID [<aa><bb>] /ID", b"/ID [<aa>]", b"/#49D[<11><22>]", b"/ID [<1><22>]", b"/ID [" + b" " * 300 + b"<aa><bb>]", b"/IDs [<aa><bb>]", b"/ID /x [<aa><bb>]"]
    found = places.trailer_ids(places.tokens(spark.createDataFrame(list(enumerate(ids)), "id long, content binary"), "id", F.col("content")), "id")
    assert rows_of(found) == [(0, "0a0b", "cc", False), (1, "aa", "bb", True), (3, "11", "22", False)]
    assert len(set(WATCHED)) == 25 and {"3D", "OCProperties"} <= set(WATCHED)


def test_all_places_of_patterns(spark):
    rng = random.Random(5)
    patterns = {"a": b"a", "aa": b"aa", "aba": b"aba", "dot": b".", "n": b"\n", "high": b"\xff\x00", "again": b"aa"}
    made = [bytes(rng.choice(b"ab.\n\xff\x00") for _ in range(rng.randrange(40))) for _ in range(300)] + [b"", None, b"a" * 2000]
    frame = spark.createDataFrame(list(enumerate(made)), "id long, content binary")
    expect = [(i, n, k) for i, d in enumerate(made) for n, p in patterns.items() for k in range(len(d or b"")) if d.startswith(p, k)]
    assert rows_of(places.occurrences(frame, "id", F.col("content"), patterns)) == sorted(expect, key=str)
    with pytest.raises(ValueError, match="at least one byte"):
        places.occurrences(frame, "id", F.col("content"), {"none": b""})


def random_ranges(rng, n, size):
    return [(rng.randrange(-5, size + 5), rng.choice([0, 1, 2, 7, 64, 65, size])) for _ in range(rng.randrange(n))]


def test_tiling_and_ranges_by_place(spark):
    rng = random.Random(6)
    listed, sizes, found = [], [], []
    for f in range(60):
        size = rng.choice([0, 1, 50, 200])
        sizes.append((str(f), size))
        listed += [(str(f), *r) for r in random_ranges(rng, 8, max(size, 1))]
        found += [(str(f), k, *r) for k, r in enumerate(random_ranges(rng, 8, max(size, 1)))]
    listed += [("0", None, 5), ("none", 0, 5)]
    found += [("0", 99, None, 5), ("1", 99, 3, None)]
    r = spark.createDataFrame(listed, "file_id string, offset long, length long")
    z = spark.createDataFrame(sizes, "file_id string, size long")
    expect = []
    for f, size in sizes:
        reached = None
        own = sorted(((o, o + n) for g, o, n in listed if g == f and n and o is not None), key=lambda x: (x[0], -x[1]))
        for start, stop in [*own, None][: len(own)]:
            if min(start, size) > max(reached or 0, 0):
                expect.append((f, "hole", max(reached or 0, 0), min(start, size)))
            if reached is not None and start < reached:
                expect.append((f, "overlap", start, min(stop, reached)))
            expect += [(f, "outside", start, min(stop, 0))] * (start < 0) + [(f, "outside", max(start, size), stop)] * (stop > size)
            reached = stop if reached is None else max(reached, stop)
        if max(reached or 0, 0) < size:
            expect.append((f, "hole", max(reached or 0, 0), size))
    assert rows_of(byte_ranges.tiling(r, z)) == sorted(expect, key=str)

    cover = {f: {b for g, o, n in listed if g == f and o is not None for b in range(o, o + n)} for f, _ in sizes}
    expect = []
    for f, k, o, n in found:
        if o is None or n is None:
            expect.append((f, k, 0, "kept"))
            continue
        covered = len(cover[f] & set(range(o, o + n)))
        gone = o in cover[f] if n == 0 else covered == n
        expect.append((f, k, covered, "gone" if gone else "cut" if covered else "kept"))
    placed = byte_ranges.by_place(spark.createDataFrame(found, "file_id string, seq long, offset long, length long"), r)
    assert rows_of(placed) == sorted(expect, key=str)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    levels = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 64, 65, 1 << 40)], "n long").select("n", byte_ranges.level(F.col("n"))).collect()
    assert all((1 << k) >= n > ((1 << k) >> 1 if k else -1) for n, k in levels)


def test_parts_in_order(spark):
    given = {
        "whole": [(2, b"b"), (1, b"a"), (3, b"")], "gap": [(1, b"a"), (3, b"c")], "twice": [(1, b"z"), (1, b"y"), (3, b"w")], "zero": [(0, b"a"), (1, b"b")], "large": [(1, b"x" * 90), (2, b"y" * 20)],
        "null part": [(1, None), (2, b"q")], "no number": [(1, b"a"), (None, b"b")], "none": [(None, b"b"), (None, b"a")], None: [(1, b"k"), (2, b"l")],
    }
    rows = [(k, n, d) for k, v in given.items() for n, d in v]
    found = parts.joined(spark.createDataFrame(rows, "key string, number int, data binary"), "key", "number", "data", budget=100)
    assert {r.key: (r.n_parts, r.complete, bytes(r.content)) for r in found.collect()} == {
        "whole": (3, True, b"ab"), "gap": (2, False, b"a"), "twice": (3, False, b"y"), "zero": (2, False, b"a"), "large": (2, False, b"x" * 90),
        "null part": (2, True, b"q"), "no number": (2, False, b"a"), "none": (2, False, b"a"), None: (2, True, b"kl"),
    }


def test_crc_of_any_cut(spark):
    rng, rows, expect = random.Random(7), [], {}
    for key in range(40):
        data = rng.randbytes(rng.choice([0, 1, 10, 5000]))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(6)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        rows += [(key, k, p or (None if k % 2 else b"")) for k, p in enumerate(pieces)]
        expect[key] = (len(data), zlib.crc32(data))
    found = parts.crc_of_parts(spark.createDataFrame(rows, "key long, k long, data binary"), "key", "k", "data")
    assert {r.key: (r.n_bytes, r.crc32) for r in found.collect()} == expect
    # far more zero bytes than a part could hold
    zeros = zlib.crc32(bytes(1 << 20)) ^ zlib.crc32(b"")
    first = spark.range(1).select(parts.advanced(F.lit(zlib.crc32(b"abc")), F.lit(1 << 20))).first()[0]
    assert first ^ zeros == zlib.crc32(b"abc" + bytes(1 << 20))


def copies_in(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


def test_copies_are_whole_or_none(spark, tmp_path):
    given = [("a.jpg", b"1"), ("a.jpg", b"2"), ("A.jpg", b"3"), ("a-2.jpg", b"4"), ("../../up", b"5"), ("con.txt", b""), ("_hidden", b"6"), ("", b"7"), ("n" * 300 + ".png", b"8"), ("tab\t?", b"9")]
    frame = spark.createDataFrame(given, "name string, content binary")
    ranges.write_copies(frame.coalesce(1), f"{tmp_path}/one")
    found = copies_in(f"{tmp_path}/one")
    assert sorted(found.values()) == sorted(c for _, c in given)
    names = {os.path.basename(p) for p in found}
    assert len(found) == len({n.lower() for n in names}) == len(given) and max(map(len, names)) <= ranges.NAME_CHARS and "up" in names and "file_con.txt" in names and "file_hidden" in names
    assert not any(d.startswith("_") for d in os.listdir(f"{tmp_path}/one"))
    # more rows of the same names are added beside them, unless the folder is to be overwritten
    ranges.write_copies(frame.repartition(3), f"{tmp_path}/one")
    assert len(copies_in(f"{tmp_path}/one")) == 2 * len(given)
    ranges.write_copies(frame.limit(2), f"{tmp_path}/one", mode="overwrite")
    assert sorted(copies_in(f"{tmp_path}/one").values()) == [b"1", b"2"]
    with pytest.raises(Exception, match="no name or no content"):
        ranges.write_copies(frame.unionByName(spark.createDataFrame([("z", None)], "name string, content binary")), f"{tmp_path}/two")
    assert copies_in(f"{tmp_path}/two") == {}
    ranges.write_copies(frame.limit(0), f"{tmp_path}/three")
    assert copies_in(f"{tmp_path}/three") == {}


def zipped(names):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("pad", os.urandom(90_000))
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_only_ends_of_files_are_read(spark, tmp_path, capsys):
    made = {
        "a.jpg": b"\xff\xd8\xff" + bytes(70_000), "b.docx": zipped(["[Content_Types].xml", "word/document.xml"]), "c.zip": zipped(["word/document.xml2", "x[Content_Types].xml"]), "d.PDF": b"\n" * 1000 + b"%PDF-1.4", "e": b"", "sub/f.gif": b"GIF89a",
        "_temporary/g.jpg": b"\xff\xd8\xff", "late.pdf": b" " * 1030 + b"%PDF-1.4",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = ranges.read_ranges(spark, f"file://{tmp_path}", files_each=2)
    told = {r.name: (r.detected_format, r.detected_type, r.refusal, r.bytes_read) for r in ranges.detected(found).collect()}
    both = limits.SNIFF_BYTES + ranges.TAIL_BYTES
    assert told == {
        "a.jpg": ("jpeg", "image/jpeg", None, 1032), "b.docx": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None, both), "c.zip": (None, "application/zip", "unsupported-format", both), "d.PDF": ("pdf", "application/pdf", None, 1008),
        "e": (None, "unknown", "empty-file", 0), "f.gif": (None, "image/gif", "unsupported-format", 6), "late.pdf": (None, "unknown", "unsupported-format", 1032),
    }
    few = found.where("size > 10 AND extension IN ('jpg', 'pdf') AND name LIKE 'd%'")
    assert [r.name for r in few.collect()] == ["d.PDF"]
    few.explain("formatted")
    assert "GreaterThan(size,10)" in capsys.readouterr().out
    # filters choose files before any is opened
    reader = ranges.RangeReader(f"file://{tmp_path}", 100)
    from pyspark.sql.datasource import GreaterThan, In, IsNotNull

    assert list(reader.pushFilters([GreaterThan(("size",), 10), In(("extension",), ("pdf",)), IsNotNull(("size",))])) == [IsNotNull(("size",))]
    assert [os.path.basename(p) for b in reader.partitions() for p, _, _ in b.listed] == ["d.PDF", "late.pdf"]
    # a file that changes after it was listed
    listed = ranges.RangeReader(f"file://{tmp_path}", 100).partitions()[0]
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "d.PDF").unlink()
    refused = {r[1]: (r[5], r[8]) for r in ranges.RangeReader(f"file://{tmp_path}", 100).read(listed) if r[8] == "changed-while-read"}
    assert refused == {"a.jpg": (None, "changed-while-read"), "d.PDF": (None, "changed-while-read")}
    assert ranges.read_ranges(spark, f"file://{tmp_path}/nothing").count() == 0


def controlled(messages, seconds, watermark):
    """Outcomes of (key, at, id, kind, generation) messages, by key one after another; timers go off up to the watermark."""
    out = []
    for key in {m[0] for m in messages}:
        generation, active, begun, due = 0, False, 0, 0
        for _, at, i, kind, named in sorted((m for m in messages if m[0] == key), key=lambda m: (m[1], m[2])):
            if active and at >= due:
                out.append((key, due, generation, "timeout", begun))
                active = False
            if kind == "start":
                out += [(key, at, generation, "superseded", begun)] * active
                generation, active, begun, due = generation + 1, True, i, at + seconds * 1000
                out.append((key, at, generation, "started", i))
            elif active and named in (None, generation) and kind in ("progress", "result", "error", "cancel"):
                out.append((key, at, generation, "cancelled" if kind == "cancel" else kind, i))
                active = kind == "progress"
            else:
                out.append((key, at, generation if named is None else named, "stale", i))
        if active and due <= watermark:
            out.append((key, due, generation, "timeout", begun))
    return out


@pytest.mark.parametrize("files_each", [None, 1])
def test_job_control(spark, tmp_path, files_each):
    rng, begin = random.Random(8), datetime(2024, 1, 1)
    messages = []
    for i in range(600):  # in the order of time, so that batches of single files are too
        kind = rng.choice(["start", "start", "progress", "result", "error", "cancel", "what"])
        messages.append((rng.choice(["a", "b", "c", "hot", "hot", "hot"]), i * 2500, i, kind, rng.choice([None, None, i // 20, 1])))
    for part in range(3):
        rows = [(k, begin + timedelta(milliseconds=t), i, kind, g) for k, t, i, kind, g in messages[part * 200 : part * 200 + 200]]
        rows += [(None, begin, 1, "start", None)] if part == 1 else []
        frame = spark.createDataFrame(rows, "key string, at timestamp, message_id long, kind string, generation long")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in os.listdir(tmp_path / "in"):  # the source takes files by their time
            if name.startswith("part") and not (tmp_path / "in" / name).stat().st_mtime < 1e9:
                os.utime(tmp_path / "in" / name, (1e6 + part, 1e6 + part))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    jobs.run_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", frame.schema, seconds=30, files_each=files_each)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    found = spark.read.parquet(f"{tmp_path}/out").select("key", F.unix_millis("at") - int(begin.timestamp() * 1000), "generation", "outcome", "message_id")
    expect = controlled(messages, 30, messages[-1][1])
    assert rows_of(found) == sorted(expect, key=str)
    assert {"timeout", "superseded", "stale", "result", "error", "cancelled", "progress", "started"} == {r[3] for r in expect}


def test_progress_of_a_batch(spark):
    progress = BatchProgress()
    rows = progress.stage("first", spark.range(100), files=F.count(F.lit(1)), bytes=F.sum("id"))
    rows = progress.stage("second", rows.where("id % 3 = 0"), files=F.count(F.lit(1)))
    rows = progress.stage("third", rows.where("id < 0"), files=F.count(F.lit(1)), bytes=F.sum("id"))
    with pytest.raises(ValueError, match="already"):
        progress.stage("first", rows)
    assert rows.count() == 0
    assert progress.figures() == [("first", "files", 100), ("first", "bytes", 4950), ("second", "files", 34), ("third", "files", 0), ("third", "bytes", None)]


def test_choices_that_cannot_be_made(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file_id string")
    offers = spark.createDataFrame([("a", "exif"), ("b", "xmp")], "file_id string, grp string")
    chosen = spark.createDataFrame([("a", "exif"), ("b", "exif"), ("b", "exif"), ("b", "xmp"), ("d", None)], "file_id string, grp string")
    found = removal.selection_errors(files, chosen, offers)
    assert Counter(map(tuple, found.collect())) == Counter([("c", "nothing-chosen", None), ("d", "nothing-chosen", None), ("b", "not-offered", "exif")])
    assert removal.selection_errors(files.limit(0), chosen.limit(0), offers).count() == 0


def test_elements_beyond_the_first(spark):
    made = ["<t> </t><t/><x:t>a&amp;b</x:t>", "<t></t>" * 19 + "<t>late</t>", "<t></t>" * 20 + "<t>too late</t>", "<u>x</u>", "", None]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "i int, xml string")
    assert [r[1] for r in sorted(frame.select("i", text.element_text(F.col("xml"), "t")).collect())] == ["a&b", "late", None, None, None, None]


def test_every_property_has_a_finding():
    specs = {name: code for name, code, _, _ in packets.XMP_SPECS}
    assert len(specs) == 21 and specs["exif:GPSLatitude"] == specs["exif:GPSLongitude"] == specs["photoshop:State"] == "xmp.location"
    assert len(packets.DATASETS) == 15 and packets.DATASETS[92] == "iptc.location" and 85 not in packets.DATASETS
