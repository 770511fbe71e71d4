"""A source that reads only the parts of files which tell their kind, and a sink that writes whole files.

Source `inkglass-ranges`: a row a file with its first 1,032 bytes and, for ZIP packages that may be
a DOCX, its last 64 KiB, where the list of entries is. Nothing else is read. Comparisons of `size`
and tests of `extension` and `name` are taken over from filters, so files that they leave out are
not opened. Each partition is a bounded number of files.

Sink `inkglass-copies`: rows (name, content) become files. A task writes below `_temporary` under
a folder of its own attempt, in folders of 2,000 files; the commit moves these to their places, one message a task, so
a lost or repeated task leaves whole files or none, and an aborted job nothing. Names are made safe
for any file system. A name that a task has written already gets a number.

Paths are URIs of any file system that Arrow knows.

Cases: an empty folder gives no rows. An empty file has an empty head. A file that was taken away
or has another size when it is read than when it was listed gets `refusal` `changed-while-read` and
no bytes; ZIP packages above the limit of a DOCX get `zip-too-large`, and no tail. Null names or
contents end the job before anything is in place.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

from inkglass.functions import limits
from inkglass.sources import files

TAIL_BYTES = 64 << 10
ZIP_SIGNS = (b"PK\x03\x04", b"PK\x05\x06")
#: Files of a partition, and of a folder that is written: more than 32 folders are listed by a job, not by the driver.
FILES_EACH, FOLDER_FILES = 500, 2000
NAME_CHARS = 120


def opened(uri: str):
    """(Arrow file system, path in it) of a URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def extension_of(name: str) -> str:
    """What follows the last full stop of a name, in lower case, at most 16 characters; none of a hidden file's."""
    stem, stop, last = name.rpartition(".")
    return last.lower()[:16] if stop and stem else ""


@dataclass
class Batch(InputPartition):
    """Files (path, size, modification time in microseconds) that a task reads."""

    listed: list[tuple[str, int, int]]


class Ranges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkglass-ranges"

    def schema(self) -> str:
        return "path string, name string, extension string, size long, modified timestamp, head binary, tail binary, bytes_read long, refusal string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("filesEach", FILES_EACH)))


#: What a filter takes over: its test of a file's value.
TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x),
}


class RangeReader(DataSourceReader):
    def __init__(self, path: str, files_each: int):
        self.path, self.files_each, self.taken = path, files_each, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in TESTS and column in ("size", "extension", "name"):
                self.taken.append((column, type(f), f.value))
            else:
                yield f

    def wanted(self, name: str, size: int) -> bool:
        values = {"size": size, "name": name, "extension": extension_of(name)}
        return all(TESTS[kind](values[column], value) for column, kind, value in self.taken)

    def partitions(self) -> list[Batch]:
        from pyarrow import fs

        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in os.path.relpath(p, path).split("/")[:-1])
        listed = sorted((f.path, f.size, f.mtime_ns // 1000 if f.mtime_ns else 0) for f in found if f.type == fs.FileType.File and not hidden(f.path) and self.wanted(f.base_name, f.size))
        return [Batch(listed[i : i + self.files_each]) for i in range(0, len(listed), self.files_each)] or [Batch([])]

    def read(self, partition: Batch):
        from datetime import UTC, datetime

        system, _ = opened(self.path)
        for path, size, modified in partition.listed:
            name = os.path.basename(path)
            head, tail, n_read, refusal = read_ends(system, path, size)
            yield (path, name, extension_of(name), size, datetime.fromtimestamp(modified / 1e6, UTC).replace(tzinfo=None), head, tail, n_read, refusal)


def read_ends(system, path: str, size: int):
    """(head, tail, bytes read, refusal) of a file; positioned reads of a random-access file fetch no more than they are asked."""
    try:
        with system.open_input_file(path) as f:
            if f.size() != size:
                return None, None, 0, "changed-while-read"
            head = f.read_at(min(size, limits.SNIFF_BYTES), 0)
            if not head.startswith(ZIP_SIGNS):
                return head, None, len(head), "file-too-large" if size > limits.FILE_BYTES else "empty-file" if not size else None
            if size > limits.FORMAT_BYTES["docx"]:
                return head, None, len(head), "zip-too-large"
            # bytes that the head has already are not read again
            rest = max(size - TAIL_BYTES, len(head))
            more = f.read_at(size - rest, rest) if size > rest else b""
            return head, head[max(0, size - TAIL_BYTES) :] + more, len(head) + len(more), None
    except (FileNotFoundError, OSError):
        return None, None, 0, "changed-while-read"


def read_ranges(spark: SparkSession, path: str, files_each: int = FILES_EACH) -> DataFrame:
    """path, name, extension, size, modified, head, tail, bytes_read, refusal of the files below a path. The session's
    filters are handed to Python sources from now on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ranges)
    return spark.read.format("inkglass-ranges").option("filesEach", files_each).load(path)


def in_directory(tail, name: str):
    """If the ZIP directory in a tail lists an entry: its name, of its length, 46 bytes after an entry's sign."""
    sign = "504B0102" + "[0-9A-F]{48}" + len(name).to_bytes(2, "little").hex().upper() + "[0-9A-F]{32}" + name.encode().hex().upper()
    return F.hex(tail).rlike(f"^(..)*?{sign}")


def detected(ranges: DataFrame) -> DataFrame:
    """path, name, size, detected_format, detected_type, detected_label, extension_check, refusal from files' ends alone."""
    docx = F.coalesce(in_directory(F.col("tail"), "[Content_Types].xml") & in_directory(F.col("tail"), "word/document.xml"), F.lit(False))
    found = ranges.withColumn("d", files.detect(F.coalesce("head", F.lit(b""))))
    zipped = F.col("d.mime") == "application/zip"
    word = F.struct(F.lit("docx").alias("format"), F.lit(files.DOCX_MIME).alias("mime"), F.lit("DOCX package").alias("label"), F.lit(False).alias("recognised_unsupported"))
    found = found.withColumn("d", F.when(zipped & docx, word).otherwise(F.col("d")))
    kind = F.col("d.format")
    refusal = F.coalesce("refusal", F.when(F.col("size") > files.size_limit(kind), "format-too-large").when(kind.isNull(), "unsupported-format"))
    return found.select("path", "name", "size", kind.alias("detected_format"), F.col("d.mime").alias("detected_type"), F.col("d.label").alias("detected_label"), files.extension_check(kind, F.col("extension")).alias("extension_check"), refusal.alias("refusal"), "bytes_read")


def safe_name(name: str) -> str:
    """A file name without folders, control or reserved characters, which is neither that of a device nor hidden from Spark's sources."""
    plain = re.sub(r'[\x00-\x1f\x7f<>:"/\\|?*]+', "_", re.split(r"[/\\]", name)[-1]).strip(". ")
    stem, stop, last = plain.rpartition(".")
    if len(plain) > NAME_CHARS:
        plain = plain[: NAME_CHARS - 17] + (stop + last[:16] if stop and stem else "")
    if not plain or re.fullmatch(r"(?i)(con|prn|aux|nul|com\d|lpt\d)(\..*)?", plain):
        return "file_" + plain
    return "file" + plain if plain[0] == "_" else plain


@dataclass
class Written(WriterCommitMessage):
    """What a task has left below `_temporary`, and where it goes."""

    own: str
    place: str
    n_files: int
    n_bytes: int

    def moves(self) -> list[tuple[str, str]]:
        return [(f"{self.own}/{k}", f"{self.place}-{k}") for k in range(-(-self.n_files // FOLDER_FILES))]


class Copies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkglass-copies"

    def writer(self, schema, overwrite: bool) -> CopyWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("rows to write must have the columns name and content")
        return CopyWriter(self.options["path"], uuid.uuid4().hex, overwrite)


class CopyWriter(DataSourceWriter):
    def __init__(self, path: str, job: str, overwrite: bool):
        self.path, self.job, self.overwrite = path, job, overwrite

    @property
    def temporary(self) -> str:
        return f"{opened(self.path)[1]}/_temporary/{self.job}"

    def write(self, rows) -> Written | None:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = opened(self.path)
        own = f"{self.temporary}/{task.partitionId()}-{task.taskAttemptId()}"
        taken: dict[str, int] = {}
        n_files = n_bytes = 0
        for row in rows:
            if row.name is None or row.content is None:
                raise ValueError("a file to write has no name or no content")
            place = f"{own}/{n_files // FOLDER_FILES}"
            if not n_files % FOLDER_FILES:
                system.create_dir(place, recursive=True)
            name = safe_name(row.name)
            k = taken[name.lower()] = taken.get(name.lower(), 0) + 1
            while k > 1:  # the numbered name may be one of the given ones
                stem, stop, last = name.rpartition(".")
                numbered = f"{stem}-{k}.{last}" if stop and stem else f"{name}-{k}"
                if numbered.lower() not in taken:
                    taken[name.lower()], name = k, numbered
                    taken[name.lower()] = 1
                    break
                k += 1
            with system.open_output_stream(f"{place}/{name}") as f:
                f.write(row.content)
            n_files, n_bytes = n_files + 1, n_bytes + len(row.content)
        return Written(own, f"{path}/part-{task.partitionId():05d}-{self.job[:8]}", n_files, n_bytes)

    def commit(self, messages) -> None:
        system, path = opened(self.path)
        if self.overwrite:
            self.clear_others(system, path)
        system.create_dir(path, recursive=True)
        for m in messages:
            for own, place in m.moves() if m is not None else ():
                system.move(own, place)
        self.forget(system)

    def clear_others(self, system, path: str) -> None:
        from pyarrow import fs

        for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name != "_temporary":
                (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)

    def abort(self, messages) -> None:
        self.forget(opened(self.path)[0])

    def forget(self, system) -> None:
        """Deletes what this job has below `_temporary`, and that folder if no other job uses it."""
        from pyarrow import fs

        if system.get_file_info(self.temporary).type == fs.FileType.Directory:
            system.delete_dir(self.temporary)
        above = os.path.dirname(self.temporary)
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


def write_copies(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes a file for each row (name, content) below a path."""
    rows.sparkSession.dataSource.register(Copies)
    rows.select("name", "content").write.format("inkglass-copies").mode(mode).save(path)
