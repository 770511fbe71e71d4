"""ZIP directories, tokenised XML, and DOCX findings."""

from __future__ import annotations

import re

from inkglass.functions import limits
from inkglass.operators.bytesio import Findings, Reader, inflate, utf8
from inkglass.operators.packets import decode_entities

#: Part, element, code, label.
PROPERTIES = (
    ("docProps/core.xml", "creator", "docx.author", "Author"), ("docProps/core.xml", "lastModifiedBy", "docx.last-modified-by", "Last changed by"), ("docProps/core.xml", "created", "docx.created", "Created"), ("docProps/core.xml", "modified", "docx.modified", "Changed"),
    ("docProps/core.xml", "title", "docx.property", "Title"), ("docProps/core.xml", "subject", "docx.property", "Subject"), ("docProps/core.xml", "description", "docx.property", "Comments"), ("docProps/core.xml", "keywords", "docx.property", "Keywords"), ("docProps/core.xml", "category", "docx.property", "Category"),
    ("docProps/core.xml", "revision", "docx.revision", "Revision"), ("docProps/core.xml", "lastPrinted", "docx.property", "Last printed"), ("docProps/app.xml", "Application", "docx.application", "Program"), ("docProps/app.xml", "Company", "docx.company", "Company"), ("docProps/app.xml", "Manager", "docx.company", "Manager"),
    ("docProps/app.xml", "Template", "docx.template", "Template"), ("docProps/app.xml", "TotalTime", "docx.editing-time", "Editing time"),
)
NAMED_PARTS = (
    (r"^word/media/", "docx.media", "media files"), (r"^word/embeddings/", "docx.embedded-objects", "embedded objects"), (r"^docProps/thumbnail\.", "docx.thumbnail", "thumbnails"),
    (r"^customXml/item\d+\.xml$", "docx.custom-xml", "custom XML parts"), (r"(?i)vbaProject\.bin$", "docx.macros", "macro projects"), (r"^_xmlsignatures/.*\.xml$", "docx.signature", "signature parts"),
)
ODD = re.compile(r"(^/)|(^[A-Za-z]:)|(\\)|((^|/)\.\.(/|$))")


def directory(data: bytes) -> dict:
    """entries and flags of the central directory, sought from the end."""
    out = {"entries": [], "zip64": False, "limit": False, "malformed": None}
    at = data.rfind(b"PK\5\6", max(0, len(data) - 65_557))
    if at < 0 or at + 22 > len(data):
        return out | {"malformed": "the directory's end is missing"}
    r = Reader(data, little=True)
    count, size, start = r.u16(at + 10), r.u32(at + 12), r.u32(at + 16)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (size, start):
        return out | {"zip64": True}
    if start + size > at:
        return out | {"malformed": "the directory is not in the file"}
    for _ in range(count):
        if not r.has(start, 46) or data[start : start + 4] != b"PK\1\2":
            return out | {"malformed": "a directory entry is damaged"}
        if len(out["entries"]) >= limits.ZIP_ENTRIES:
            return out | {"limit": True}
        n, m, k = r.u16(start + 28), r.u16(start + 30), r.u16(start + 32)
        out["entries"].append({"name": utf8(data[start + 46 : start + 46 + n]), "flags": r.u16(start + 8), "method": r.u16(start + 10), "crc": r.u32(start + 16), "compressed": r.u32(start + 20), "uncompressed": r.u32(start + 24), "local": r.u32(start + 42)})
        start += 46 + n + m + k
    return out


def looks_like_docx(entries: list[dict]) -> bool:
    return {"[Content_Types].xml", "word/document.xml"} <= {e["name"] for e in entries}


def read_entry(data: bytes, e: dict, most: int) -> tuple[bytes | None, bool, str | None]:
    """(bytes, cut at most, why not)."""
    r, at = Reader(data, little=True), e["local"]
    if e["flags"] & 1:
        return None, False, "encrypted"
    if not r.has(at, 30) or data[at : at + 4] != b"PK\3\4":
        return None, False, "its own header is damaged"
    n, m = r.u16(at + 26), r.u16(at + 28)
    if utf8(data[at + 30 : at + 30 + n]) != e["name"]:
        return None, False, "names differ"
    start = at + 30 + n + m
    if not r.has(start, e["compressed"]):
        return None, False, "its bytes are not in the file"
    raw = data[start : start + e["compressed"]]
    if e["method"] == 0:
        return raw[:most], len(raw) > most, None
    if e["method"] == 8:
        out, cut, error = inflate(raw, most, raw=True)
        return out, cut, "damaged" if error and not out else None
    return None, False, "another method"


def strip_noise(xml: str) -> str:
    """Without comments, instructions and declarations; CDATA as escaped text; an open one takes the rest."""
    out, at = [], 0
    for opener, closer, skip in iter(lambda: next_noise(xml, at), None):
        out.append(xml[at:opener])
        end = xml.find(closer, opener + skip)
        if closer == "]]>":
            body = xml[opener + skip : end if end >= 0 else len(xml)]
            out.append(body.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        at = len(xml) if end < 0 else end + len(closer)
    return "".join([*out, xml[at:]])


NOISE = re.compile(r"<!--|<!\[CDATA\[|<\?|<!")
CLOSERS = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>", "<!": ">"}


def next_noise(xml: str, at: int) -> tuple[int, str, int] | None:
    m = NOISE.search(xml, at)
    return m and (m.start(), CLOSERS[m[0]], len(m[0]))


TAG = r"<((?:[\w.-]+:)?{})(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def start_tags(xml: str, local: str, most: int) -> tuple[list[dict], bool]:
    """Start tags of a local name: name, attrs by local name (first wins), closed, end. Second: if cut at most."""
    out: list[dict] = []
    for m in re.finditer(TAG.format(re.escape(local)), xml):
        if len(out) >= most:
            return out, True
        if m.end() - m.start() > 4000:
            continue
        attrs: dict[str, str] = {}
        for k, a in enumerate(ATTRIBUTE.finditer(m[2])):
            if k >= 200:
                break
            attrs.setdefault(a[1].rpartition(":")[2], decode_entities(a[2] if a[2] is not None else a[3]))
        out.append({"name": m[1], "attrs": attrs, "closed": m[2].endswith("/"), "end": m.end()})
    return out, False


def element_text(xml: str, local: str, most: int = 4000) -> str | None:
    for t in start_tags(xml, local, 20)[0]:
        if t["closed"]:
            continue
        m = re.compile(rf"</{re.escape(t['name'])}(?=[\s>])").search(xml, t["end"])
        if m:
            text = decode_entities(re.sub(r"<[^>]*>", "", xml[t["end"] : min(m.start(), t["end"] + 4 * most)])).strip()
            if text:
                return text[:most]
    return None


def shown(values: list[str], most: int) -> str:
    return ", ".join(values[:most]) + (f" and {len(values) - most} more" if len(values) > most else "")


def inspect(data: bytes, sink: Findings) -> dict:
    """Findings of a DOCX package. Texts of comments and changes are counted, never shown."""
    found = directory(data)
    entries = found["entries"]
    first: dict[str, dict] = {}
    for e in entries:
        first.setdefault(e["name"], e)
    budget, cut_parts, unread = limits.ZIP_INFLATE, [], []

    def part(name: str, most: int = limits.ZIP_PART) -> str | None:
        nonlocal budget
        if name not in first or budget <= 0:
            return None
        body, cut, why = read_entry(data, first[name], min(most, budget))
        if body is None:
            unread.append(f"{name}: {why}")
            return None
        budget -= len(body)
        if cut:
            cut_parts.append(name)
        return strip_noise(utf8(body))

    def add(code: str, where: str, value, **more) -> None:
        sink.add(code, "DOCX package", value, path=where, **more)

    duplicates, odd = len(entries) - len(first), [e["name"] for e in entries if ODD.search(e["name"])]
    ratio = max((e["uncompressed"] // e["compressed"] for e in entries if e["compressed"]), default=0)
    locked, total = sum(e["flags"] & 1 for e in entries), sum(e["uncompressed"] for e in entries)
    if found["malformed"] or found["zip64"]:
        add("docx.malformed", "directory", found["malformed"] or "ZIP64 is not followed", status="suspicious")
    if found["limit"]:
        add("docx.limit", "directory", f"more than {limits.ZIP_ENTRIES} entries", status="unsupported")
    add("docx.zip-entries", "directory", f"{len(entries)} entries, {total} bytes declared")
    if duplicates or odd or ratio > limits.ZIP_RATIO or total > limits.ZIP_DECLARED:
        add("docx.zip-suspicious", "directory", f"{duplicates} repeated names, {len(odd)} odd names, largest ratio {ratio}", status="suspicious")
    if locked:
        add("docx.encrypted", "directory", f"{locked} entries", status="unsupported")
    parts: dict[str, str | None] = {}
    for name, element, code, label in PROPERTIES:
        if name not in parts:
            parts[name] = part(name)
        if parts[name] and (value := element_text(parts[name], element)):
            add(code, f"{name} {element}", value, label=label)
    if custom := part("docProps/custom.xml"):
        tags, _ = start_tags(custom, "property", 500)
        names = [t["attrs"].get("name", "") for t in tags if t["attrs"].get("name")]
        if names:
            add("docx.custom", "docProps/custom.xml", shown(names, 20))
    types = part("[Content_Types].xml", 256 * 1024) or ""
    body = part("word/document.xml", 2 * limits.MIB) or ""
    comments = part("word/comments.xml") or ""
    least = lambda cut: "at least " if cut else ""
    for text, local, code, people, what, where in ((comments, "comment", "docx.comments", "docx.comment-authors", "comments", "word/comments.xml"), (body, None, "docx.tracked-changes", "docx.tracked-authors", "tracked changes", "word/document.xml")):
        tags, cut = [], False
        for name in (local,) if local else ("ins", "del", "moveFrom", "moveTo"):
            more, over = start_tags(text, name, 200_000)
            tags, cut = tags + more, cut or over
        if tags:
            add(code, where, f"{least(cut or where in cut_parts)}{len(tags)} {what}")
            authors = list(dict.fromkeys(t["attrs"]["author"][:300] for t in tags if t["attrs"].get("author")))
            if authors:
                add(people, where, shown(authors, 20))
    hidden = [t for t in start_tags(body, "vanish", 200_000)[0] if t["attrs"].get("val", "true") not in ("0", "false", "off")]
    if hidden:
        add("docx.hidden-text", "word/document.xml", f"{least('word/document.xml' in cut_parts)}{len(hidden)} runs")
    marks = {v for text, name in ((part("word/settings.xml") or "", "rsid"), (body, "p"), (body, "r")) for t in start_tags(text, name, 200_000)[0] for k, v in t["attrs"].items() if k.startswith("rsid") or (name == "rsid" and k == "val")}
    if marks:
        add("docx.rsid", "word/settings.xml", f"{len(marks)} editing session ids")
    links, others = [], 0
    for name in ("word/_rels/document.xml.rels", "word/_rels/settings.xml.rels", "_rels/.rels"):
        for t in start_tags(part(name) or "", "Relationship", 2000)[0]:
            if t["attrs"].get("TargetMode") == "External":
                links.append(t["attrs"].get("Target", ""))
                others += not t["attrs"].get("Type", "").endswith("/hyperlink")
    if links:
        add("docx.external", "relationships", f"{len(links)} external, {others} of them no hyperlinks: {shown(links, 6)}")
    for pattern, code, what in NAMED_PARTS:
        hits = [e for e in first.values() if re.search(pattern, e["name"])]
        if hits:
            add(code, hits[0]["name"], f"{len(hits)} {what}, {sum(e['uncompressed'] for e in hits)} bytes")
    if re.search("(?i)macroEnabled", types) and not any(re.search(r"(?i)vbaProject\.bin$", n) for n in first):
        add("docx.macros", "[Content_Types].xml", "declared as holding macros", status="inferred")
    if cut_parts or unread or budget <= 0:
        add("docx.limit", "parts", f"{len(cut_parts)} parts were read in part, {len(unread)} could not be read", status="unsupported")
    for area, state in (("Package structure", "partial" if found["limit"] or found["malformed"] else "inspected"), ("Properties", "inspected"), ("Comments and changes", "partial" if cut_parts else "inspected"), ("External links", "inspected"), ("Macros", "not-inspected"), ("Embedded content", "not-inspected"), ("Text and pictures", "not-inspected")):
        sink.cover(area, state)
    return {"width": None, "height": None, "orientation": None, "structurally_unsound": bool(found["malformed"] or found["zip64"]), "copy_refusal": "copies of this format are not made"}
