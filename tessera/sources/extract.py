"""Plain text from file contents, within finite budgets."""

from __future__ import annotations

import html.parser
import io
import os
import re
import signal
import struct
import subprocess
import tempfile
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_TEXT, MIB

# Limits of archives, XML and PDF conversion.
MAX_MEMBER, MAX_SELECTED, MAX_DIRECTORY, MAX_MEMBERS = 16 * MIB, 64 * MIB, 8 * MIB, 10_000
MAX_ELEMENTS, MAX_DEPTH, PDF_SECONDS = 200_000, 256, 60
# Element names before which a space goes.
BLOCKS = {"p", "h", "br", "cr", "tab", "si", "line-break", "list-item", "table-row", "table-cell", "tr", "td"}


class TooBig(Exception):
    """A limit of one document was exceeded."""


class Broken(Exception):
    """One document can't be parsed."""


class Missing(RuntimeError):
    """A program or codec that extraction needs isn't there."""


class Joined:
    """Parts joined by a space, within the text budget."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        if text:
            self.size += len(text.encode("utf-8", "surrogatepass")) + bool(self.parts)
            if self.size > MAX_TEXT:
                raise TooBig("the text exceeds its budget")
            self.parts.append(text)

    def text(self) -> str:
        return " ".join(self.parts)


class Archive:
    """Selected members of a ZIP package; the directory is checked before anything is opened."""

    def __init__(self, data: bytes):
        probe_deflate()
        self._check_directory(data)
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, NotImplementedError, UnicodeDecodeError) as e:
            raise Broken(str(e)) from None
        # Of members with one name, the last counts.
        self.infos = {i.filename: i for i in self.zip.infolist()}
        self.left = MAX_SELECTED

    @staticmethod
    def _check_directory(data: bytes) -> None:
        """The members are counted in the directory itself, within its bounds, before anything is allocated for them."""
        tail = max(0, len(data) - 22 - 0xFFFF)
        ends = (m.start() for m in re.finditer(rb"(?=PK\x05\x06)", data[tail:]))
        fits = [tail + e for e in ends if len(data) >= tail + e + 22 == len(data) - int.from_bytes(data[tail + e + 20 : tail + e + 22], "little")]
        if not fits:
            raise Broken("no end record")
        end = fits[-1]
        disks, said, size, offset = data[end + 4 : end + 8], *struct.unpack("<xxHII", data[end + 8 : end + 20])
        if any(disks) or data[end + 8 : end + 10] != data[end + 10 : end + 12]:
            raise Broken("a package in several parts")
        if said == 0xFFFF or said > MAX_MEMBERS or 0xFFFFFFFF in (size, offset) or size > MAX_DIRECTORY:
            raise TooBig("too large a directory")
        # Bytes before the package move all of it.
        begin = end - size
        if begin < offset:
            raise Broken("the directory is not where it should be")
        directory, at, members = data[begin:end], 0, 0
        while directory[at : at + 4] == b"PK\x01\x02" and at + 46 <= size:
            at += 46 + sum(struct.unpack("<3H", directory[at + 28 : at + 34]))
            members += 1
        if members > MAX_MEMBERS:
            raise TooBig("too many members")
        if directory[at : at + 4] == b"PK\x05\x05" and at + 6 <= size:
            # A signature may end the directory.
            at += 6 + int.from_bytes(directory[at + 4 : at + 6], "little")
        if at != size or members != said:
            raise Broken("a broken directory")

    def read(self, name: str) -> bytes:
        info = self.infos.get(name)
        if info is None:
            raise Broken(f"no member {name}")
        if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise Broken("an encrypted member or an unusual codec")
        if info.file_size > min(MAX_MEMBER, self.left):
            raise TooBig(name)
        try:
            with self.zip.open(info) as f:
                data = f.read(MAX_MEMBER + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, RuntimeError, NotImplementedError, OSError) as e:
            raise Broken(str(e)) from None
        if len(data) > min(MAX_MEMBER, self.left):
            raise TooBig(name)
        self.left -= len(data)
        return data


def probe_deflate() -> None:
    """A fault of the codec is no fault of a document."""
    try:
        if zlib.decompressobj(-15).decompress(_PROBE) == b"probe":
            return
    except zlib.error:
        pass
    raise Missing("the DEFLATE codec doesn't work")


_PROBE = bytes.fromhex("2b28ca4f4a0500")


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


class _Tree(ElementTree.TreeBuilder):
    """Builds a tree within the limits of size and depth."""

    def __init__(self):
        super().__init__()
        self.depth = self.seen = 0

    def start(self, tag, attrs):
        self.depth, self.seen = self.depth + 1, self.seen + 1
        if self.depth > MAX_DEPTH or self.seen > MAX_ELEMENTS:
            raise TooBig("too many or too deep elements")
        return super().start(tag, attrs)

    def end(self, tag):
        self.depth -= 1
        return super().end(tag)


class _Flat(_Tree):
    """Keeps text alone, in document order, with a space before every block element."""

    def __init__(self):
        super().__init__()
        self.text: list[str] = []

    def start(self, tag, attrs):
        if local(tag) in BLOCKS:
            self.text.append(" ")
        return super().start(tag, {})

    def data(self, data):
        self.text.append(data)

    def close(self):
        super().close()
        return "".join(self.text)


def xml(data: bytes, target: _Tree | None = None):
    """What the target makes of a document without document type or entities: the root element by default."""
    for code in ("ascii", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        if any(w.encode(code) in data for w in ("<!DOCTYPE", "<!ENTITY")):
            raise Broken("a document type is not allowed")
    parser = ElementTree.XMLParser(target=target or _Tree())
    try:
        parser.feed(data)
        return parser.close()
    except (ElementTree.ParseError, LookupError, ValueError) as e:
        raise Broken(str(e)) from None


def word(data: bytes) -> str:
    return xml(Archive(data).read("word/document.xml"), _Flat())


def odt(data: bytes) -> str:
    return xml(Archive(data).read("content.xml"), _Flat())


def _all_text(e) -> str:
    return "".join(e.itertext())


def _worksheets(package: Archive, book) -> list[str]:
    """Members of the workbook's sheets by their relationships, or else by their names."""
    targets = {}
    if (name := "xl/_rels/workbook.xml.rels") in package.infos:
        for r in xml(package.read(name)).iter():
            target = (r.get("Target") or "").replace("\\", "/")
            if r.get("Id") and target:
                parts = [p for p in (target.lstrip("/") if target.startswith("/") else f"xl/{target}").split("/") if p not in ("", ".")]
                # A target outside the package is as good as none.
                if ".." not in parts:
                    targets[r.get("Id")] = "/".join(parts)
    ids = [s.get(_RELATION) or s.get("r:id") for s in book.iter() if local(s.tag) == "sheet"]
    known = [targets[i] for i in ids if targets.get(i) in package.infos]
    return known or sorted(n for n in package.infos if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n))


# Fixed value: the attribute that names a sheet's relationship.
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _shared_strings(package: Archive) -> list[str]:
    name, out = "xl/sharedStrings.xml", Joined()
    if name not in package.infos:
        return []
    table = xml(package.read(name))
    if local(table.tag) != "sst":
        raise Broken("shared strings have another root")
    items = [e for e in table if local(e.tag) == "si"]
    if len(items) != sum(local(e.tag) == "si" for e in table.iter()):
        raise Broken("nested shared strings")
    strings = [" ".join(_all_text(e).split()) for e in items]
    # Joiners count towards the budget, also beside empty strings.
    if sum(len(s.encode("utf-8", "surrogatepass")) + 1 for s in strings) - 1 > MAX_TEXT:
        raise TooBig("shared strings exceed the text budget")
    return strings


def excel(data: bytes) -> str:
    """Sheet names, then each sheet's cells: shared or inline string, formula, value."""
    package, out = Archive(data), Joined()
    book = xml(package.read("xl/workbook.xml"))
    shared, paths = _shared_strings(package), _worksheets(package, book)
    for s in book.iter():
        if local(s.tag) == "sheet":
            out.add(s.get("name"))
    for path in paths:
        for cell in xml(package.read(path)).iter():
            if local(cell.tag) == "c":
                part = {local(e.tag): _all_text(e) for e in cell}
                value = part.get("v")
                if cell.get("t") == "s" and value is not None:
                    at = int(value) if re.fullmatch("[0-9]{1,6}", value) else len(shared)
                    out.add(shared[at] if at < len(shared) else None)
                else:
                    out.add(part.get("is"))
                out.add(part.get("f"))
                if cell.get("t") != "s":
                    out.add(value)
    return out.text()


# Byte-order marks in the order in which they are tried.
_MARKS = [(b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


def decoded(data: bytes) -> str:
    for mark, code in _MARKS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(code)
            except UnicodeDecodeError as e:
                raise Broken(str(e)) from None
    for code in ("utf-8", "cp1252"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


class _Page(html.parser.HTMLParser):
    """Collects text outside elements whose content isn't markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.visible: list[str] = []

    def handle_data(self, data):
        if self.cdata_elem not in ("script", "style"):
            self.visible.append(data)


def html_page(data: bytes) -> str:
    page = _Page()
    page.feed(decoded(data))
    return " ".join(page.visible)


def pdf(data: bytes, memory_mb: int = 512) -> str:
    def limits():
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (PDF_SECONDS + 5, PDF_SECONDS + 5))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
        # One byte over the budget is enough to know.
        resource.setrlimit(resource.RLIMIT_FSIZE, (MAX_TEXT + 1, MAX_TEXT + 1))

    with tempfile.TemporaryDirectory() as d:
        path, out = os.path.join(d, "in.pdf"), os.path.join(d, "out.txt")
        with open(path, "wb") as f:
            f.write(data)
        try:
            with open(out, "wb") as to:
                done = subprocess.run(["pdftotext", "-q", "-enc", "UTF-8", path, "-"], stdout=to, stderr=subprocess.DEVNULL, timeout=PDF_SECONDS, preexec_fn=limits, check=False)
        except FileNotFoundError:
            raise Missing("pdftotext is not installed") from None
        except subprocess.TimeoutExpired:
            raise Broken("pdftotext took too long") from None
        if os.path.getsize(out) > MAX_TEXT or done.returncode == -signal.SIGXFSZ:
            raise TooBig("the text exceeds its budget")
        if done.returncode:
            raise Broken("pdftotext failed")
        with open(out, "rb") as f:
            return f.read().decode("utf-8", "replace")


READERS = {"ooxml-word": word, "ooxml-excel": excel, "odt": odt, "odf-text": odt, "text": decoded, "html": html_page, "pdftotext": pdf}


def probe_pdf() -> None:
    """Whether ``pdftotext`` is there and gives the text of a small page."""
    page = b"BT /F1 12 Tf 9 9 Td (probe) Tj ET"
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 99 99]/Resources<</Font<</F1 5 0 R>>>>/Contents 4 0 R>>", b"<</Length %d>>stream\n%s\nendstream" % (len(page), page), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    out, places = b"%PDF-1.4\n", []
    for k, part in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj%s endobj\n" % (k, part)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"xref\n0 6\n0000000000 65535 f \n%strailer<</Size 6/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (table, len(out))
    try:
        if "probe" in pdf(out):
            return
    except (TooBig, Broken) as e:
        raise Missing(f"pdftotext doesn't work: {e}") from None
    raise Missing("pdftotext gives no text")


def probe(labels: set[str]) -> None:
    """Raise ``Missing`` if what these extractors need doesn't work here; results of earlier builds are reused only then."""
    if "pdftotext" in labels:
        probe_pdf()
    if labels & {"ooxml-word", "ooxml-excel", "odt"}:
        probe_deflate()


def extract(label: str, data: bytes, pdf_memory_mb: int = 512) -> tuple[str, str]:
    """(state, text with blanks collapsed).  Only a document's own faults become states."""
    try:
        text = " ".join((pdf(data, pdf_memory_mb) if label == "pdftotext" else READERS[label](data)).split())
    except TooBig:
        return "too_big", ""
    except Broken:
        return "error", ""
    if len(text.encode("utf-8", "surrogatepass")) > MAX_TEXT:
        return "too_big", ""
    return ("empty_pdf" if label == "pdftotext" and not text else "extracted"), text.encode("utf-8", "replace").decode()


def extracted(label: Column, data: Column, pdf_memory_mb: int = 512) -> Column:
    """A struct (state, text) for rows that have content to be read."""

    @F.pandas_udf("state string, text string")
    def run(labels: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [extract(a, bytes(b), pdf_memory_mb) if a is not None and b is not None else (None, None) for a, b in zip(labels, contents, strict=True)]
        return pd.DataFrame(rows, columns=["state", "text"])

    return run(label, data)
