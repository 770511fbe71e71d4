"""PDF: raw scan of tokens, and a small bounded reader of objects, in plain form or in object
streams compressed by Flate or not at all. Encrypted files and damaged ones, and object streams of
other filters or with predictors, are not opened; coverage says so."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

from inkglass.functions import limits
from inkglass.operators.bytesio import Findings, latin1
from inkglass.operators.packets import parse_xmp
from inkglass.operators.pdf_tokens import WATCHED

NAME = re.compile(rb"/([^\x00\t\n\f\r ()<>\[\]{}/%]{1,48})")
OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})[ \r\n\t]+([0-9]{1,5})[ \r\n\t]+obj\b")
TOKEN = re.compile(rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[0-9]+[ \r\n\t]+[0-9]+[ \r\n\t]+R\b|[+-]?[0-9.]+|[A-Za-z]+|.", re.S)
#: Info entries.
INFO = {"Title": "pdf.title", "Author": "pdf.author", "Subject": "pdf.subject", "Keywords": "pdf.keywords", "Creator": "pdf.creator", "Producer": "pdf.producer", "CreationDate": "pdf.created", "ModDate": "pdf.modified"}
KNOWN_INFO = {*INFO, "Trapped"}
#: Bytes of one object stream and of all of a file, opened.
PACKED_BYTES, PACKED_TOTAL = 4 * limits.MIB, 32 * limits.MIB
SCRIPT = {"JavaScript", "JS"}
ACTIONS = {"OpenAction", "AA", "Launch", "SubmitForm", "ImportData", "GoToR", "GoToE"}


class Ref(int):
    """A reference to an object by its number."""


class Text(bytes):
    """A string's bytes."""

    def shown(self) -> str:
        if self[:2] == b"\xfe\xff":
            return self[2:].decode("utf-16-be", "replace")
        return self[3:].decode("utf-8", "replace") if self[:3] == b"\xef\xbb\xbf" else latin1(self)


def unescape(raw: bytes) -> bytes:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)


def raw_scan(data: bytes) -> dict:
    """version, eof_count, eof_at_end, tokens (watched names), ids."""
    head = re.search(rb"%PDF-([0-9]\.[0-9])", data[: limits.SNIFF_BYTES])
    names = Counter(latin1(unescape(n)) for n in NAME.findall(data))
    ids = re.findall(rb"/ID\s*\[\s*<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>", data)
    return {"version": head and latin1(head[1]), "eof_count": data.count(b"%%EOF"), "eof_at_end": b"%%EOF" in data[-1024:], "tokens": {t: names[t] for t in WATCHED if names[t]}, "ids": [re.sub(r"\s", "", latin1(x)).lower() for x in ids[-1]] if ids else None}


PLAIN_RUN = re.compile(rb"[^()\\]*")


def literal(data: bytes, at: int) -> tuple[Text, int]:
    """A string in parentheses that begins at `at`."""
    out, depth, i = bytearray(), 1, at + 1
    plain = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
    while i < len(data) and len(out) < limits.TAG_BYTES:
        c = data[i]
        if c == 92 and i + 1 < len(data):
            m = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
            if m:
                out.append(int(m[0], 8) & 255)
                i = m.end()
            else:
                if data[i + 1] not in (10, 13):
                    out.append(plain.get(data[i + 1], data[i + 1]))
                i += 2
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            return Text(out), i + 1
        # with what follows up to the next character that means something
        end = min(PLAIN_RUN.match(data, i + 1).end(), i + limits.TAG_BYTES - len(out))
        out += data[i:end]
        i = end
    return Text(out), i


def parse(data: bytes, at: int, most: int = 20_000):
    """The value that begins at `at` (dict, list, str for names, Text, Ref, number or word) and where it ends."""
    stack: list[list] = []
    steps = 0
    while at < len(data) and steps < most:
        steps += 1
        m = TOKEN.match(data, at)
        t, at = m[0], m.end()
        if t.isspace() or t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([t])
            continue
        if t in (b">>", b"]"):
            if not stack:
                return None, at
            kind, *items = stack.pop()
            value = dict(zip(items[::2], items[1::2], strict=False)) if kind == b"<<" and all(isinstance(k, str) for k in items[::2]) else {} if kind == b"<<" else items
        elif t[:1] == b"/":
            value = latin1(unescape(t[1:]))
        elif t == b"(":
            value, at = literal(data, at - 1)
        elif t[:1] == b"<" and len(t) > 1:
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = Text(bytes.fromhex(latin1(digits + b"0" * (len(digits) % 2))))
        elif t.endswith(b"R") and b" " in t.replace(b"\n", b" ").replace(b"\r", b" "):
            value = Ref(t.split()[0])
        else:
            try:
                value = float(t) if b"." in t else int(t)
            except ValueError:
                value = t
        if not stack:
            return value, at
        stack[-1].append(value)
    return None, at


class Document:
    """Objects by number (the last one wins), read when they are asked for. An object in a stream
    stands where its stream does."""

    def __init__(self, data: bytes):
        self.data = data
        self.read: dict[int, object] = {}
        self.trailer: dict = {}
        self.closed_streams = self.opened_streams = 0
        found = [(m.start(), m.end(), int(m[1])) for m in OBJECT.finditer(data)]
        self.places = {number: end for _, end, number in found}
        self.packed: dict[int, tuple[bytes, int]] = {}
        ends = [m.end() for m in re.finditer(rb"\btrailer\b", data)]
        holders = self.holders([end for _, end, _ in found])
        for at in sorted([*ends, *(at for at, kind in holders if kind == "XRef")]):
            value, _ = parse(data, at)
            if isinstance(value, dict):
                self.trailer |= value
        if "Encrypt" not in self.trailer:
            self.unpack([at for at, kind in holders if kind == "ObjStm"])

    def holders(self, starts: list[int]) -> list[tuple[int, str]]:
        """Where objects of the types ObjStm and XRef begin, in file order."""
        near = sorted({bisect_right(starts, m.start()) - 1 for m in re.finditer(rb"/(?:ObjStm|XRef)\b", self.data)})
        heads = ((starts[i], parse(self.data, starts[i])[0]) for i in near if i >= 0)
        return [(at, head["Type"]) for at, head in heads if isinstance(head, dict) and head.get("Type") in ("ObjStm", "XRef")]

    def unpack(self, streams: list[int]) -> None:
        """Notes where the objects in streams are; values are parsed when asked for."""
        left, stood = PACKED_TOTAL, dict(self.places)
        for at in streams:
            body, head = self.body(at, min(left, PACKED_BYTES))
            first, n = (self.get(head.get(k)) for k in ("First", "N"))
            if body is None or not isinstance(first, int) or not isinstance(n, int):
                self.closed_streams += 1
                continue
            left -= len(body)
            self.opened_streams += 1
            numbers = [int(x) for x in re.findall(rb"[0-9]{1,10}", body[: max(first, 0)])[: 2 * max(n, 0)]]
            for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
                if stood.get(number, -1) <= at:
                    stood[number] = at
                    self.packed[number] = (body, first + offset)
                    self.read.pop(number, None)

    def get(self, value, depth: int = 0):
        while isinstance(value, Ref) and depth < 8:
            if value not in self.read:
                source, at = self.packed.get(int(value)) or (self.data, self.places.get(int(value)))
                self.read[value] = parse(source, at)[0] if at is not None else None
            value, depth = self.read[value], depth + 1
        return value

    def dictionary(self, value) -> dict:
        value = self.get(value)
        return value if isinstance(value, dict) else {}

    def items(self, value) -> list:
        value = self.get(value)
        return value if isinstance(value, list) else []

    def stream(self, ref) -> bytes | None:
        at = self.places.get(int(ref)) if isinstance(ref, Ref) else None
        return None if at is None else self.body(at, limits.XMP_BYTES)[0]

    def body(self, at: int, most: int) -> tuple[bytes | None, dict]:
        """What the stream that begins at `at` holds, up to so many bytes, and its dictionary."""
        head, end = parse(self.data, at)
        if not isinstance(head, dict):
            return None, {}
        m = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if not m or most <= 0:
            return None, head
        stop = self.data.find(b"endstream", m.end())
        raw = self.data[m.end() : stop if stop >= 0 else len(self.data)]
        kind, how = self.get(head.get("Filter")), self.get(head.get("DecodeParms"))
        predicted = any(self.dictionary(x).get("Predictor", 1) != 1 for x in (how if isinstance(how, list) else [how]))
        if kind in ("FlateDecode", ["FlateDecode"]) and not predicted:
            try:
                return zlib.decompressobj().decompress(raw, most), head
            except zlib.error:
                return None, head
        return (raw[:most] if kind in (None, []) else None), head

    def pages(self) -> list[dict]:
        root = self.dictionary(self.trailer.get("Root"))
        queue, seen, out = [root.get("Pages")], set(), []
        while queue and len(out) < limits.PDF_PAGES and len(seen) < 10_000:
            ref = queue.pop(0)
            if isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref if isinstance(ref, Ref) else len(seen))
            node = self.dictionary(ref)
            if "Kids" in node:
                queue = [*self.items(node["Kids"]), *queue]
            elif node:
                out.append(node)
        return out


def shown(values: list[str], most: int) -> str:
    return ", ".join(values[:most]) + (f" and {len(values) - most} more" if len(values) > most else "")


def pdf_date(raw: str) -> str:
    m = re.match(r"D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Zz+-])?(\d{2})?'?(\d{2})?", raw, re.A)
    if not m:
        return raw
    y, mo, d, h, mi, s, sign, zh, zm = m.groups()
    zone = " UTC" if sign in ("Z", "z") else f" UTC{sign}{zh or '00'}:{zm or '00'}" if sign else ""
    return f"{y}-{mo or '01'}-{d or '01'} {h or '00'}:{mi or '00'}:{s or '00'}{zone}"


def inspect(data: bytes, sink: Findings) -> dict:
    raw, doc = raw_scan(data), Document(data)
    tokens = raw["tokens"]
    said: set[str] = set()

    def add(code: str, where: str, value=None, **more) -> None:
        said.add(code)
        sink.add(code, "PDF objects", value, path=where, **more)

    root = doc.dictionary(doc.trailer.get("Root"))
    locked = "Encrypt" in doc.trailer
    readable = bool(root) and not locked
    if locked:
        add("pdf.encrypted", "trailer", "the file is encrypted and was not opened", status="unsupported")
    elif not root:
        add("pdf.malformed", "trailer", "no catalogue was found" + (" (object streams could not be opened)" if "ObjStm" in tokens else ""), status="unavailable" if "ObjStm" in tokens else "suspicious")
    n_pages, annotations, authors, urls, layers = 0, Counter(), [], [], []
    if readable:
        info = doc.dictionary(doc.trailer.get("Info"))
        for key, code in INFO.items():
            v = doc.get(info.get(key))
            if isinstance(v, Text) and v.shown().strip():
                add(code, f"Info {key}", pdf_date(v.shown()) if key.endswith("Date") else v.shown().strip())
        for key in [k for k in info if k not in KNOWN_INFO][:10]:
            v = doc.get(info[key])
            if isinstance(v, Text):
                add("pdf.custom", f"Info {key}", f"{key}: {v.shown()}")
        if isinstance(root.get("Metadata"), Ref):
            body = doc.stream(root["Metadata"])
            if body is not None:
                before = len(sink.rows)
                parse_xmp(body, sink, "PDF XMP", None, "-")
                for row in sink.rows[before:]:
                    if row["code"] == "xmp.packet":
                        row["code"] = "pdf.xmp"
                    row["transformation"] = "unsupported"
        names = doc.dictionary(root.get("Names"))
        files = [doc.get(x).shown() for x in doc.items(doc.dictionary(names.get("EmbeddedFiles")).get("Names"))[::2] if isinstance(doc.get(x), Text)]
        if files:
            add("pdf.attachments", "Names", f"{len(files)}: {shown(files, 10)}")
        scripts = [doc.get(x).shown() for x in doc.items(doc.dictionary(names.get("JavaScript")).get("Names"))[::2] if isinstance(doc.get(x), Text)]
        opener = doc.dictionary(root.get("OpenAction"))
        triggers = scripts + (["when opened"] if opener.get("S") == "JavaScript" else [])
        actions = ["when opened"] if opener and opener.get("S") not in ("JavaScript", "GoTo", None) else []
        actions += ["additional actions"] if root.get("AA") is not None else []
        pages = doc.pages()
        for page in pages:
            triggers += ["page action"] if page.get("AA") is not None else []
            for ref in doc.items(page.get("Annots"))[:5000]:
                a = doc.dictionary(ref)
                annotations[str(doc.get(a.get("Subtype")))] += 1
                who = doc.get(a.get("T"))
                if isinstance(who, Text) and a.get("Subtype") != "Widget":
                    authors.append(who.shown())
                act = doc.dictionary(a.get("A"))
                uri = doc.get(act.get("URI"))
                if isinstance(uri, Text):
                    urls.append(latin1(uri))
                elif act.get("S") == "JavaScript":
                    triggers.append("annotation")
                elif act.get("S") in ("Launch", "SubmitForm", "ImportData", "GoToR"):
                    actions.append(act["S"])
        total = doc.get(doc.dictionary(root.get("Pages")).get("Count"))
        n_pages = total if isinstance(total, int) else len(pages)
        add("pdf.pages", "Pages", f"{n_pages} pages")
        if n_pages > limits.PDF_PAGES:
            add("pdf.limit", "Pages", f"only {limits.PDF_PAGES} pages were read", status="unsupported")
        if triggers:
            add("pdf.javascript", "actions", shown(list(dict.fromkeys(triggers)), 6))
        urls = list(dict.fromkeys(urls))[:20]
        if urls:
            actions.append(f"links: {shown(urls, 5)}")
        if actions:
            add("pdf.actions", "actions", "; ".join(dict.fromkeys(actions)))
        if annotations:
            add("pdf.annotations", "Annots", ", ".join(f"{k} ({n})" for k, n in sorted(annotations.items())))
        if authors:
            add("pdf.annotation-author", "Annots", shown(list(dict.fromkeys(authors)), 20))
        form = doc.dictionary(root.get("AcroForm"))
        fields = doc.items(form.get("Fields"))
        if fields:
            add("pdf.forms", "AcroForm", f"{len(fields)} fields" + (", XFA" if "XFA" in form else ""))
        if any(doc.dictionary(f).get("FT") == "Sig" for f in fields[:1000]):
            add("pdf.signature", "AcroForm", "a signature field")
        groups = doc.dictionary(root.get("OCProperties"))
        layers, off = doc.items(groups.get("OCGs")), doc.items(doc.dictionary(groups.get("D")).get("OFF"))
        if layers:
            add("pdf.layers", "OCProperties", f"{len(layers)} layers, {len(off)} hidden")
    if doc.closed_streams:
        add("pdf.limit", "object streams", f"{doc.closed_streams} of {doc.closed_streams + doc.opened_streams} object streams were not opened", status="unsupported")
    sink.add("pdf.hidden-text", "What is inspected", status="unsupported")
    if raw["ids"]:
        add("pdf.document-id", "trailer ID", raw["ids"][0] + (", second id differs" if raw["ids"][0] != raw["ids"][1] else ""))
    hints = {"pdf.javascript": SCRIPT, "pdf.actions": ACTIONS, "pdf.attachments": {"EmbeddedFile", "EmbeddedFiles"}, "pdf.forms": {"AcroForm", "XFA"}, "pdf.signature": {"ByteRange", "Sig"}, "pdf.encrypted": {"Encrypt"}}
    for code, names in hints.items():
        hit = [f"{t} ({tokens[t]})" for t in WATCHED if t in names and t in tokens]
        if hit and code not in said:
            sink.add(code, "PDF raw tokens", ", ".join(hit), status="inferred", confidence="low")
    if tokens:
        sink.add("pdf.raw-token", "PDF raw tokens", ", ".join(f"{t} ({n})" for t, n in tokens.items()))
    revisions = max(0, raw["eof_count"] - (2 if "Linearized" in tokens else 1))
    if revisions:
        sink.add("pdf.incremental", "PDF end marks", f"{revisions} earlier versions")
    if not raw["eof_at_end"]:
        sink.add("pdf.truncated", "PDF end marks", "the last part has no end mark", status="suspicious")
    if raw["version"]:
        sink.add("pdf.version", "PDF header", raw["version"])
    for area, state in (("Information dictionary", "inspected" if readable else "not-inspected"), ("XMP", "partial" if readable else "not-inspected"), ("Attachments", "partial"), ("Actions", "partial"), ("Annotations and forms", "partial" if readable else "not-inspected"), ("Object streams", "not-inspected" if "ObjStm" in tokens and not doc.opened_streams else "partial" if doc.closed_streams else "inspected"), ("Page content", "not-inspected"), ("Hidden text", "not-inspected")):
        sink.cover(area, state)
    if locked:
        sink.cover("Encrypted content", "not-inspected")
    return {"width": None, "height": None, "orientation": None, "structurally_unsound": not root, "copy_refusal": "copies of this format are not made"}
