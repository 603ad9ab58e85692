"""Documents from files: text-like formats, word-processor packages and positioned page text."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.sessions import sha256_of

TEXT_LIKE = ("txt", "text", "md", "csv", "log", "html", "htm")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PART = re.compile(r"word/(?:document|header\d*|footer\d*)\.xml$")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with its whole text, unparsed: path, ord by path, source_hash and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*TEXT_LIKE))
    return kept.select("path", sha256_of(F.col("content")).alias("source_hash"), F.decode("content", "UTF-8").alias("text"))


# ---------------------------------------------------------------- word-processor packages


def paragraphs(root: ET.Element) -> Iterable[ET.Element]:
    return root.iter(f"{W}p")


def runs(paragraph: ET.Element, deleted: bool = False) -> list[ET.Element]:
    """The text elements of a paragraph in order, without tracked deletions."""
    out = []

    def walk(node):
        for child in node:
            if child.tag == f"{W}del" and not deleted:
                continue
            if child.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr"):
                out.append(child)
            elif child.tag != f"{W}p":
                walk(child)

    walk(paragraph)
    return out


def run_text(e: ET.Element) -> str:
    return (e.text or "") if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n"


def block_lines(node: ET.Element) -> Iterable[str]:
    """Lines of a body: paragraphs, and rows of tables; a row of two cells is a label and its value."""
    for child in node:
        if child.tag == f"{W}p":
            yield "".join(map(run_text, runs(child)))
        elif child.tag == f"{W}tbl":
            for row in child.iter(f"{W}tr"):
                cells = [" ".join("".join(map(run_text, runs(p))) for p in paragraphs(cell)).strip() for cell in row.findall(f"{W}tc")]
                if len(cells) == 2 and cells[0]:
                    yield f"{cells[0].rstrip(':')}: {cells[1]}"
                else:
                    yield " | ".join(c for c in cells if c)
        elif child.tag != f"{W}sectPr":
            yield from block_lines(child)


def parts(package: bytes) -> dict[str, ET.Element]:
    """The document's XML parts, body first, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        names = sorted((n for n in z.namelist() if PART.fullmatch(n)), key=lambda n: (n != "word/document.xml", n))
        return {n: ET.fromstring(z.read(n)) for n in names}


def docx_text(package: bytes) -> str:
    out = []
    for name, root in parts(package).items():
        body = root.find(f"{W}body") if name == "word/document.xml" else root
        lines = list(block_lines(body if body is not None else root))
        if name == "word/document.xml" or any(x.strip() for x in lines):
            out += lines
    return "\n".join(out)


def splice(paragraph: ET.Element, start: int, end: int, new: str) -> None:
    """Puts new in place of a paragraph's characters from start to end: the first text element takes it, breaks and tabs in between go."""
    place, first, owner = 0, True, {child: node for node in paragraph.iter() for child in node}
    for e in runs(paragraph):
        size, begin = len(run_text(e)), place
        place += size
        a, b = max(start, begin), min(end, place)
        if a >= b:
            continue
        if e.tag != f"{W}t":
            owner[e].remove(e)
            continue
        body = e.text or ""
        e.text = body[: a - begin] + (new if first else "") + body[b - begin :]
        e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        first = False


def paragraph_text(paragraph: ET.Element) -> str:
    return "".join(map(run_text, runs(paragraph)))


def replace_in_paragraph(paragraph: ET.Element, pairs: list[tuple[str, str]]) -> bool:
    """Replaces texts that may run over several runs, longest first and whatever the case; the first run takes the new text."""
    changed = False
    for old, new in pairs:
        at, wanted = 0, re.compile(re.escape(old), re.IGNORECASE)
        while old and (found := wanted.search(paragraph_text(paragraph), at)):
            splice(paragraph, found.start(), found.end(), new)
            changed = True
            at = found.start() + len(new)  # never into what was just written
    return changed


def replace_over_paragraphs(root: ET.Element, pairs: list[tuple[str, str]]) -> bool:
    """Replaces texts of several lines that run over paragraphs: the first ends with their first line, the last begins
    with their last, those between hold a line each. The first paragraph takes the new text; emptied ones stay."""
    changed, held = False, list(paragraphs(root))
    for old, new in pairs:
        lines = [re.escape(x) for x in old.split("\n") if x]
        if len(lines) < 2:
            continue
        shapes = [re.compile(f"{lines[0]}$", re.IGNORECASE), *(re.compile(f"^{x}$", re.IGNORECASE) for x in lines[1:-1]), re.compile(f"^{lines[-1]}", re.IGNORECASE)]
        for at in range(len(held) - len(lines) + 1):
            here = held[at : at + len(lines)]
            found = []
            for shape, p in zip(shapes, here):
                if not (hit := shape.search(paragraph_text(p))):
                    break
                found.append(hit)
            if len(found) == len(lines):
                for k, (p, hit) in enumerate(zip(here, found)):
                    splice(p, hit.start(), hit.end(), "" if k else new)
                changed = True
    return changed


def rewrite_docx(package: bytes, mapping: dict[str, str]) -> bytes:
    """The package with every key replaced by its value in all parts, headers and footers included."""
    pairs = sorted(mapping.items(), key=lambda x: (-len(x[0]), x[0]))
    new = {}
    for name, root in parts(package).items():
        within = any([replace_in_paragraph(p, pairs) for p in paragraphs(root)])
        if replace_over_paragraphs(root, pairs) or within:
            new[name] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            to.writestr(item, new.get(item.filename, z.read(item.filename)))
    return out.getvalue()


def resolve_changes(package: bytes, accept: bool) -> bytes:
    """Tracked changes accepted or rejected."""
    gone, plain = (f"{W}del", f"{W}ins") if accept else (f"{W}ins", f"{W}del")

    def settle(node):
        kept = []
        for child in list(node):
            settle(child)
            if child.tag == gone:
                continue
            kept += list(child) if child.tag == plain else [child]
        node[:] = kept
        if node.tag == f"{W}delText":
            node.tag = f"{W}t"

    new = {}
    for name, root in parts(package).items():
        settle(root)
        new[name] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            to.writestr(item, new.get(item.filename, z.read(item.filename)))
    return out.getvalue()


def alone(paragraph: ET.Element, start: int, end: int) -> list[tuple[ET.Element, ET.Element]]:
    """Parts a paragraph's runs so that the characters from start to end fill runs of their own: (holder, run) of these."""
    place, out = 0, []
    for e in runs(paragraph):
        size, begin = len(run_text(e)), place
        place += size
        a, b = max(start, begin) - begin, min(end, place) - begin
        if a >= b:
            continue
        owner = {child: node for node in paragraph.iter() for child in node}
        run = owner[e]
        holder, body, here = owner[run], list(run), list(run).index(e)
        style = run.find(f"{W}rPr")
        parted = []
        for before, piece in ((True, body[:here]), (False, [e]), (None, body[here + 1 :])):
            texts = [e.text[:a], e.text[a:b], e.text[b:]] if before is False and e.tag == f"{W}t" else [None]
            for k, text in enumerate(texts):
                piece_body = [x for x in piece if x is not style]
                if not piece_body or text == "":
                    continue
                made = ET.Element(f"{W}r", run.attrib)
                if style is not None:
                    made.append(copy.deepcopy(style))
                if text is None:
                    made.extend(piece_body)
                else:
                    t = ET.SubElement(made, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                    t.text = text
                parted.append(made)
                if before is False and (text is None or k == 1):
                    out.append((holder, made))
        at = list(holder).index(run)
        holder.remove(run)
        for k, made in enumerate(parted):
            holder.insert(at + k, made)
    return out


def track_changes(package: bytes, changes: list[tuple[str, str]], author: str = "veilspark", date: str = "2000-01-01T00:00:00Z") -> bytes:
    """The package with changes (old, new) as revision marks in all parts: old text as deleted, new as inserted behind it.

    Longer texts go first; a text is looked for as it stands, within a paragraph. resolve_changes() settles the marks.
    The result depends on the arguments alone, so the date is one of them."""
    new_parts = {}
    for name, root in parts(package).items():
        marks = [int(x.get(f"{W}id")) for x in root.iter() if (x.get(f"{W}id") or "").isdigit()]
        number, changed = max(marks, default=0), False
        for paragraph in paragraphs(root):
            for old, new in sorted(changes, key=lambda x: (-len(x[0]), x[0])):
                at = 0
                while old and (at := paragraph_text(paragraph).find(old, at)) >= 0:
                    covered = alone(paragraph, at, at + len(old))
                    for holder, run in covered:
                        number += 1
                        gone = ET.Element(f"{W}del", {f"{W}id": str(number), f"{W}author": author, f"{W}date": date})
                        holder[list(holder).index(run)] = gone
                        gone.append(run)
                        for t in run.findall(f"{W}t"):
                            t.tag = f"{W}delText"
                    holder, run = covered[-1]
                    last = next(x for x in holder if run in list(x))
                    if holder.tag == f"{W}ins":  # an earlier insertion is parted here, as none may stand in another
                        outer, rest = next(n for n in paragraph.iter() if holder in list(n)), list(holder)[list(holder).index(last) + 1 :]
                        if rest:
                            number += 1
                            behind = ET.Element(f"{W}ins", holder.attrib | {f"{W}id": str(number)})
                            for x in rest:
                                holder.remove(x)
                                behind.append(x)
                            outer.insert(list(outer).index(holder) + 1, behind)
                        holder, last = outer, holder
                    if new:
                        number += 1
                        put = ET.Element(f"{W}ins", {f"{W}id": str(number), f"{W}author": author, f"{W}date": date})
                        made = ET.SubElement(put, f"{W}r")
                        if (style := run.find(f"{W}rPr")) is not None:
                            made.append(copy.deepcopy(style))
                        ET.SubElement(made, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = new
                        holder.insert(list(holder).index(last) + 1, put)
                    at += len(new)
                    changed = True
        if changed:
            new_parts[name] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            to.writestr(item, new_parts.get(item.filename, z.read(item.filename)))
    return out.getvalue()


def write_docx(text: str) -> bytes:
    """A plain package: a paragraph a line; lines of capitals or with # are headings."""
    root = ET.Element(f"{W}document")
    body = ET.SubElement(root, f"{W}body")
    for line in text.split("\n"):
        p = ET.SubElement(body, f"{W}p")
        level = len(line) - len(line.lstrip("#")) if line.startswith("#") else 1 if line.isupper() and len(line) < 80 else 0
        if level:
            ET.SubElement(ET.SubElement(p, f"{W}pPr"), f"{W}pStyle").set(f"{W}val", f"Heading{min(level, 4)}")
        t = ET.SubElement(ET.SubElement(p, f"{W}r"), f"{W}t")
        t.text = line.lstrip("#").strip() if line.startswith("#") else line
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    types = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", rels)
        z.writestr("word/document.xml", ET.tostring(root, encoding="UTF-8", xml_declaration=True))
    return out.getvalue()


def docx_html(package: bytes) -> str:
    """Paragraphs with bold, italic and underlined runs, and headings of four levels."""
    from html import escape

    out = []
    for p in paragraphs(parts(package)["word/document.xml"]):
        style = p.find(f"{W}pPr/{W}pStyle")
        level = re.search(r"[1-4]$", style.get(f"{W}val", "") if style is not None else "")
        body = []
        for run in p.iter(f"{W}r"):
            text = escape("".join(run_text(e) for e in run if e.tag in (f"{W}t", f"{W}tab", f"{W}br")))
            for mark in ("b", "i", "u"):
                if text and run.find(f"{W}rPr/{W}{mark}") is not None:
                    text = f"<{mark}>{text}</{mark}>"
            body.append(text)
        name = f"h{level[0]}" if level else "p"
        out.append(f"<{name}>{''.join(body)}</{name}>")
    return "".join(out)


CUSTOM = "docProps/custom.xml"
CUSTOM_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/custom-properties}"
VT = "{http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes}"


def custom_properties(package: bytes) -> dict[str, str]:
    """Properties that travel with a package, as the session it belongs to."""
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        if CUSTOM not in z.namelist():
            return {}
        return {p.get("name"): "".join(p.itertext()) for p in ET.fromstring(z.read(CUSTOM)).iter(f"{CUSTOM_NS}property")}


def with_properties(package: bytes, values: dict[str, str]) -> bytes:
    """The package with these properties added to or in place of its own."""
    root = ET.Element(f"{CUSTOM_NS}Properties")
    for k, (name, value) in enumerate((custom_properties(package) | values).items(), 2):
        entry = ET.SubElement(root, f"{CUSTOM_NS}property", {"fmtid": "{D5CDD505-2E9C-101B-9397-08002B2CF9AE}", "pid": str(k), "name": name})
        ET.SubElement(entry, f"{VT}lpwstr").text = value
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            data = z.read(item.filename)
            if item.filename == "[Content_Types].xml" and CUSTOM.encode() not in data:
                data = data.replace(b"</Types>", b'<Override PartName="/docProps/custom.xml" ContentType="application/vnd.openxmlformats-officedocument.custom-properties+xml"/></Types>')
            if item.filename == "_rels/.rels" and CUSTOM.encode() not in data:
                data = data.replace(b"</Relationships>", b'<Relationship Id="rIdCustom" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/custom-properties" Target="docProps/custom.xml"/></Relationships>')
            if item.filename != CUSTOM:
                to.writestr(item, data)
        to.writestr(CUSTOM, ET.tostring(root, encoding="UTF-8", xml_declaration=True))
    return out.getvalue()


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """One row a package: path, source_hash, content and text; text is null where the package can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        def text_of(data):
            try:
                return docx_text(data)
            except (zipfile.BadZipFile, ET.ParseError):
                return None

        for batch in batches:
            texts = pa.array([text_of(x.as_py()) for x in batch.column("content")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    base = files.select("path", sha256_of(F.col("content")).alias("source_hash"), "content")
    return base.mapInArrow(run, "path string, source_hash string, content binary, text string")


def map_docx(packages: DataFrame, mapping: str = "mapping", content: str = "content") -> DataFrame:
    """packages with rewritten: the content after replacing each key of the mapping column by its value."""

    def run(batches):
        for batch in batches:
            made = [rewrite_docx(x.as_py(), dict(m.as_py() or ())) for x, m in zip(batch.column(content), batch.column(mapping))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "rewritten"])

    from pyspark.sql import types as T

    return packages.mapInArrow(run, T.StructType([*packages.schema.fields, T.StructField("rewritten", T.BinaryType())]))


# ---------------------------------------------------------------- positioned page text


def page_text(pieces: DataFrame, tolerance: float = 2.0, gap: float = 30.0, label: int = 40) -> DataFrame:
    """Texts from pieces(doc_id, page, x, y, width, str): lines by height from the top, pieces by place; a wide gap
    behind a short first piece makes a label. Pages are parted by an empty line."""
    from pyspark.sql import Window

    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x")
    lined = pieces.withColumn("new", (F.abs(F.col("y") - F.lag("y").over(down)) > tolerance).cast("int")).withColumn("line", F.sum(F.coalesce("new", F.lit(0))).over(down))
    items = F.array_sort(F.collect_list(F.struct("x", "width", "str")))
    lines = lined.groupBy("doc_id", "page", "line").agg(items.alias("i"))
    first = F.get("i", F.lit(0))
    second = F.get("i", F.lit(1))
    wide = (F.size("i") > 1) & (second["x"] - first["x"] - first["width"] > gap) & (F.length(first["str"]) < label)
    joined = F.array_join(F.transform("i", lambda t: t["str"]), " ")
    value = F.array_join(F.transform(F.slice("i", 2, F.size("i")), lambda t: t["str"]), " ")
    body = F.when(wide, F.concat(F.regexp_replace(first["str"], r":?\s*$", ""), F.lit(": "), value)).otherwise(joined)
    pages = lines.select("doc_id", "page", "line", body.alias("body")).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda t: t["body"]), "\n").alias("body"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda t: t["body"]), "\n\n").alias("text"))
