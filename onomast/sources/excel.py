"""Excel workbooks (.xlsx) without further packages: a workbook is a zip archive of XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, k = divmod(number - 1, 26)
        out = chr(65 + k) + out
    return out


def _text(node) -> str:
    """The text of a string item, phonetic hints left out."""
    found = "".join(t.text or "" for part in node if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t"))
    return _CODED.sub(lambda m: chr(int(m[1], 16)), found)


def _number(v: str):
    x = float(v)
    return int(x) if x.is_integer() and abs(x) < 2**53 else x


def _sheets(z: zipfile.ZipFile, sheet: str | int) -> tuple[list[str], dict[str, str]]:
    """The names of a sheet, by name or place, and of those that continue it; and the relation of each sheet."""
    names = {s.get("name"): s.get(_REL) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
    if isinstance(sheet, int) and not 0 <= sheet < len(names) or isinstance(sheet, str) and sheet not in names:
        raise ValueError(f"the workbook has no sheet {sheet!r}, but {', '.join(names)}")
    found = [list(names)[sheet] if isinstance(sheet, int) else sheet]
    while (more := continued(found[0], len(found) + 1)) in names:
        found.append(more)
    return found, names


def continued(name: str, k: int) -> str:
    """The name of the k-th sheet of a table that one sheet can't hold, within the 31 letters that names may have."""
    end = f" (continued {k})"
    return f"{name[: 31 - len(end)]}{end}" if k > 1 else name


def sheets(data: bytes, sheet: str | int = 0) -> int:
    """The number of sheets that a table fills, with those that continue its first one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return len(_sheets(z, sheet)[0])


def rows(data: bytes, sheet: str | int = 0, part: int = 0) -> Iterator[tuple[int, list]]:
    """(row number from 1, values) of the rows of a sheet, by name or place, or of the ``part``-th that continues it, which
    may be none: text, numbers, truth values, None for empty cells and errors."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found, names = _sheets(z, sheet)
        if part >= len(found):
            return
        want = names[found[part]]
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == want)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        at = 0
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                at = int(node.get("r", at + 1))
                values: list = []
                for cell in node.iter(f"{_MAIN}c"):
                    place = column_number(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (place + 1 - len(values))
                    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        values[place] = "".join(_text(n) for n in cell.iter(f"{_MAIN}is"))
                    elif v is None or v.text is None or kind == "e":
                        continue
                    elif kind == "s":
                        values[place] = shared[int(v.text)]
                    elif kind == "b":
                        values[place] = v.text.strip() == "1"
                    else:
                        values[place] = _number(v.text) if kind == "n" else _CODED.sub(lambda m: chr(int(m[1], 16)), v.text)
                yield at, values
                node.clear()


def _cell(place: str, v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{place}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) < 2**53:
        return f'<c r="{place}"><v>{v!r}</v></c>'
    text = escape(_FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v)).replace("\r", "_x000D_"))
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write(out, columns: list[str], values: Iterable[Iterable], sheet: str = "Results") -> int:
    """Writes a table with a header to an open file, row by row; the number of rows without the header.

    Rows that a sheet can't hold go on in further sheets, each with the header; ``rows`` finds them by their names.
    """
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel = _MAIN[1:-1], _REL[1 : _REL.index("}")]
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    letters = [column_letters(k) for k in range(len(columns))]
    values, n, k = iter(values), 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        row = next(values, None)
        while k == 0 or row is not None:
            k += 1
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                at, text = 1, [_row(1, letters, columns)]
                while row is not None and at < MOST_ROWS:
                    at, n = at + 1, n + 1
                    text.append(_row(at, letters, row))
                    if len(text) == 1024:
                        f.write("".join(text).encode("utf-8", "replace"))
                        text = []
                    row = next(values, None)
                f.write("".join([*text, "</sheetData></worksheet>"]).encode("utf-8", "replace"))
        each = range(1, k + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in each)
        tabs = "".join(f'<sheet name="{escape(continued(sheet, i), {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i in each)
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
    return n


def _row(number: int, letters: list[str], values: Iterable) -> str:
    return f'<row r="{number}">{"".join([_cell(f"{c}{number}", v) for c, v in zip(letters, values)])}</row>'
