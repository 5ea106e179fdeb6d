"""Spreadsheets: reading and replacing one sheet as text, other sheets untouched."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names to their parts."""
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = rels[s.get(f"{_REL}id")]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return list(_sheets(z))


def stream_sheet(path: str, sheet: str | None = None) -> Iterator[list[str]]:
    """Rows of cells as text, one at a time; rows that are left out come as empty ones.

    The sheet's XML is read as a stream, and each row is let go of once it is
    out; the workbook's shared texts are held.
    """
    with zipfile.ZipFile(path) as z:
        sheets = _sheets(z)
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        part = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in ET.iterparse(f):
                    if node.tag == f"{_MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        n = 0
        with z.open(part) as f:
            above = None
            for event, node in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    above = node if node.tag == f"{_MAIN}sheetData" else above
                elif node.tag == f"{_MAIN}row":
                    at = int(node.get("r", n + 1)) - 1
                    for _ in range(at - n):
                        yield []
                    yield _cells(node, shared)
                    n = at + 1
                    if above is not None:
                        above.clear()


def _cells(row: ET.Element, shared: list[str]) -> list[str]:
    out: list[str] = []
    for i, c in enumerate(row.iter(f"{_MAIN}c")):
        col = _column(c.get("r")) if c.get("r") else i
        out += [""] * (col + 1 - len(out))
        kind, v = c.get("t"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            value = _text(c)
        elif v is None or v.text is None:
            value = ""
        elif kind == "s":
            value = shared[int(v.text)]
        elif kind == "b":
            value = "TRUE" if v.text == "1" else "FALSE"
        else:
            value = v.text if kind in ("str", "e") else _number(v.text)
        out[col] = value
    return out


def read_sheet(path: str, sheet: str | None = None) -> list[list[str]]:
    """All cells as text; empty ones are empty texts."""
    rows = list(stream_sheet(path, sheet))
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _sheet_xml(rows: list[list[str]]) -> str:
    body = []
    for r, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{_letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(row) if v != "")
        body.append(f'<row r="{r}">{cells}</row>')
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(body)}</sheetData></worksheet>'


def write_sheet(path: str, rows: list[list[str]], sheet: str | None = None) -> None:
    """Replaces a sheet of a workbook, or makes a workbook with one sheet."""
    if not Path(path).exists():
        _new(path, rows, sheet or "Sheet1")
        return
    with zipfile.ZipFile(path) as z:
        sheets = _sheets(z)
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        part = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        parts = {n: z.read(n) for n in z.namelist()}
    parts[part] = _sheet_xml(rows).encode()
    aside = Path(path).with_name(Path(path).name + ".part")
    with zipfile.ZipFile(aside, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    aside.replace(path)


def _new(path: str, rows: list[list[str]], sheet: str) -> None:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet_xml(rows))
