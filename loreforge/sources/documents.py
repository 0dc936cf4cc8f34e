"""Documents of several formats to text with section markers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_ENTRY = 64 << 20
#: Pages of a table that are parsed before their texts are handed on.
PAGES = 64
# Elements of HTML by their role in the text.
DROPPED = {"script", "style", "head", "nav", "noscript", "svg", "template"}
HEADINGS = {"h1", "h2", "h3"}
BLOCKS = set("p div li tr section article blockquote pre h1 h2 h3 h4 h5 h6 dt dd table ul ol figure figcaption header footer main aside".split())


def marker(label: str) -> str:
    """The line that opens a section; a long label is cut."""
    label = " ".join(label.split())
    return "⟦" + (label if len(label) <= 80 else label[:80] + "…") + "⟧"


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.drop = self.pre = 0
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.drop += 1
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        self.pre += tag == "pre"
        if tag in HEADINGS:
            self.heading = []

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.drop = max(0, self.drop - 1)
        self.pre = max(0, self.pre - (tag == "pre"))
        if tag in HEADINGS and self.heading is not None:
            title = re.sub(r"\s+", " ", "".join(self.heading)).strip()
            self.heading = None
            if title:
                self.out.append(f"\n\n{marker(title)}\n\n{title}")
        if tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.drop:
            return
        text = data if self.pre else re.sub(r"\s+", " ", data)
        (self.out if self.heading is None else self.heading).append(text)


def html_text(page: str | None) -> str:
    """Readable text of a page: headings open sections, blocks are paragraphs."""
    parser = _Html()
    parser.feed(page or "")
    parser.close()
    lines = "\n".join(x.strip(" ") if "\t" not in x else x.strip() for x in "".join(parser.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def markdown_text(text: str) -> str:
    """Headings of levels 1 to 3 outside code fences open sections named by
    their path."""
    path, out, fenced = ["", "", ""], [], False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith(("```", "~~~"))
        m = None if fenced else re.match(r"(#{1,3})\s+(.*?)\s*#*\s*$", line)
        if m:
            n = len(m[1])
            path[n - 1 :] = [m[2], *[""] * (3 - n)]
            out += ["", marker(" › ".join(x for x in path if x)), ""]
        out.append(line)
    return "\n".join(out)


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MOST_ENTRY:
        raise ValueError(f"{name} is too large")
    return z.read(name)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


#: A part of a document: its label (a slide, a chapter; None: the whole) and text.
Part = tuple[str | None, str]


def docx_parts(data: bytes) -> Iterator[Part]:
    """One part; headings open sections."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for p in ElementTree.fromstring(_entry(z, "word/document.xml")).iter():
            if _local(p) != "p":
                continue
            text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in p.iter())
            style = next((v for x in p.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            if text.strip():
                out += [marker(text)] * style.startswith(("Heading", "Title")) + [text]
    yield None, "\n\n".join(out)


def pptx_parts(data: bytes) -> Iterator[Part]:
    """A part for each slide with text, in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for no, name in slides:
            paras = ["".join(x.text or "" for x in p.iter() if _local(x) == "t") for p in ElementTree.fromstring(_entry(z, name)).iter() if _local(p) == "p"]
            if text := "\n".join(x for x in paras if x.strip()):
                yield f"slide {no}", text


def epub_parts(data: bytes) -> Iterator[Part]:
    """A part for each chapter with text, in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next((e.attrib["full-path"] for e in ElementTree.fromstring(_entry(z, "META-INF/container.xml")).iter() if _local(e) == "rootfile"), None)
        if root is None:
            raise ValueError("no root file")
        opf = list(ElementTree.fromstring(_entry(z, root)).iter())
        items = {e.attrib["id"]: e.attrib["href"] for e in opf if _local(e) == "item"}
        for no, ref in enumerate((e.attrib["idref"] for e in opf if _local(e) == "itemref"), 1):
            name = str(PurePosixPath(root).parent / items.get(ref, ""))
            if name in z.namelist() and (text := html_text(_entry(z, name).decode("utf-8", "replace"))):
                yield f"chapter {no}", text


def joined(parts: Iterator[Part]) -> str:
    """Parts as one text; a labelled part without a section of its own opens one."""
    out = []
    for label, text in parts:
        if label is not None and not text.startswith("⟦"):
            out.append(marker(label))
        out.append(text)
    return "\n\n".join(out)


def plain_text(data: bytes) -> str:
    if b"\0" in data[:8192]:
        raise ValueError("not a text")
    return data.decode("utf-8-sig")


PARTS = {"docx": docx_parts, "pptx": pptx_parts, "epub": epub_parts}
READERS = {ext: (lambda b, of=of: joined(of(b))) for ext, of in PARTS.items()}
READERS |= dict.fromkeys(("html", "htm", "xhtml"), lambda b: html_text(b.decode("utf-8", "replace")))
READERS |= dict.fromkeys(("md", "markdown", "mdx"), lambda b: markdown_text(plain_text(b)))
# Formats that are refused, not read as plain text.
REFUSED = set("7z avi bin bmp dmg doc exe gif gz heic ico jpeg jpg key m4a mkv mov mp3 mp4 numbers odt ogg pages pdf png ppt rar rtf svg tar tiff wav webm webp xls xlsx zip".split())


def read_document(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file by its extension."""
    ext = PurePosixPath(name).suffix[1:].lower()
    if ext in REFUSED and ext not in READERS:
        return None, f"unsupported: {ext}"
    try:
        text = READERS.get(ext, plain_text)(data).replace("\r\n", "\n").strip()
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return None, f"{type(e).__name__}: {e}"[:300]
    return (text, None) if text else (None, "empty")


def read_parts(name: str, data: bytes) -> tuple[list[Part], str | None]:
    """(parts, error) of one file: pages of the formats that have them, else one."""
    ext = PurePosixPath(name).suffix[1:].lower()
    if ext not in PARTS:
        text, error = read_document(name, data)
        return ([(None, text)] if text else []), error
    try:
        parts = [(label, t) for label, text in PARTS[ext](data) if (t := text.replace("\r\n", "\n").strip())]
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [], f"{type(e).__name__}: {e}"[:300]
    return parts, None if parts else "empty"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [read_document(p, bytes(b)) for p, b in zip(pdf["path"], pdf["content"], strict=True)]
        yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in got], "error": [e for _, e in got]})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text and error of every file under a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(_read, "path string, text string, error string")


def pages_of(files: DataFrame) -> DataFrame:
    """path, page (from 1), label, text and error of files (path, content) that a
    table holds; a file that cannot be read is a row with page 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                parts, error = read_parts(path or "", bytes(data or b""))
                rows += [(path, 0, None, None, error)] * (error is not None) + [(path, n, label, text, None) for n, (label, text) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "label", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, label string, text string, error string")


def parse_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The id and html_text of each page."""
    kind = dict(pages.select(id_col).dtypes)[id_col]
    return pages.select(id_col, html_col).mapInArrow(_html_texts, f"{id_col} {kind}, text string")


def _html_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and a page as rows of the id and the text, a few at a time:
    no more pages than these are Python objects, however large a batch is."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PAGES):
            ids, pages = (c.slice(lo, PAGES) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([ids, pa.array([html_text(x.as_py()) for x in pages], pa.string())], [batch.schema.names[0], "text"])
