"""Workbooks: sheets of an xlsx file as lists of rows, and back, with the standard library.

Workbooks are request files of a few sheets and rows; they are read and written on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def read_sheets(data: bytes) -> dict[str, list[list]]:
    """The rows of each sheet, in order; numbers as float, texts as str, blanks as None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list] = []
            for row in root.iter(f"{{{_NS['m']}}}row"):
                at = int(row.get("r") or len(rows) + 1) - 1
                while len(rows) <= at:
                    rows.append([])
                for k, c in enumerate(row.findall("m:c", _NS)):
                    col = _column(c.get("r")) if c.get("r") else k
                    kind, v = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is None or v.text is None:
                        value = None
                    else:
                        value = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else bool(int(v.text)) if kind == "b" else float(v.text)
                    rows[at] += [None] * (col + 1 - len(rows[at]))
                    rows[at][col] = value
            out[sheet.get("name")] = rows
        return out


def write_sheets(sheets: dict[str, list[list]]) -> bytes:
    """An xlsx file with the given rows; texts inline, so that no table of strings is needed."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{ref}"><v>{v}</v></c>'
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, rows in zip(n, sheets.values(), strict=True):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{_letters(c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return buffer.getvalue()
