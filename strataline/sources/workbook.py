"""Reading spreadsheet workbooks (Office Open XML) with the standard library.

A workbook is read on the driver: the format is one zip archive per table and cannot be split.
"""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from strataline.errors import EngineError, IngestIOError, SchemaMismatch

_REF = re.compile(r"([A-Z]+)(\d+)")
# Number formats of the standard that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str):
    return [x for x in node if _local(x.tag) == name]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for ch in _REF.match(ref)[1]:
        n = n * 26 + ord(ch) - 64
    return n - 1


class Workbook:
    """Sheets of a workbook by name, each a list of rows of cells (None, bool, int, float, str)."""

    def __init__(self, path: str):
        if Path(path).suffix.lower() in (".xls", ".xlsb", ".ods"):
            raise EngineError(f"'{path}': only Office Open XML workbooks (.xlsx, .xlsm) are supported")
        try:
            self.zip = zipfile.ZipFile(path.removeprefix("file://"))
        except FileNotFoundError as e:
            raise IngestIOError(f"'{path}' not found") from e
        except (OSError, zipfile.BadZipFile) as e:
            raise EngineError(f"'{path}' is not a workbook") from e
        self.shared = [_text(x) for x in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._date_styles()
        links = {x.get("Id"): x.get("Target") for x in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets: dict[str, str] = {}
        for group in _children(self._xml("xl/workbook.xml"), "sheets"):
            for s in group:
                link = next(v for k, v in s.attrib.items() if _local(k) == "id")
                target = links[link]
                self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = self._xml("xl/styles.xml")
        own = {int(x.get("numFmtId")): x.get("formatCode", "") for group in _children(root, "numFmts") for x in group}
        dated = DATE_FORMATS | {k for k, v in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", v.lower()))}
        return {i for group in _children(root, "cellXfs") for i, x in enumerate(group) if int(x.get("numFmtId", 0)) in dated}

    def _cell(self, c):
        kind, v = c.get("t", "n"), next((x.text for x in c if _local(x.tag) == "v"), None)
        if kind == "inlineStr":
            return _text(c)
        if v is None:
            return None
        if kind == "s":
            return self.shared[int(v)]
        if kind in ("str", "e"):
            return v
        if kind == "b":
            return v == "1"
        # Whole numbers stay as they are written; doubles do not hold all of them.
        x = int(v) if re.fullmatch(r"-?\d{1,18}", v) else float(v)
        if int(c.get("s", 0)) in self.dates:
            return (datetime(1899, 12, 30) + timedelta(days=x)).isoformat(sep=" ")
        return x

    def rows(self, sheet: str) -> list[list]:
        if sheet not in self.sheets:
            raise SchemaMismatch(f"no sheet '{sheet}'; have {list(self.sheets)}")
        out = []
        for data in _children(self._xml(self.sheets[sheet]), "sheetData"):
            for row in data:
                cells: list = []
                for i, c in enumerate(row):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._cell(c)
                out.append(cells)
        return out

    def table(self, sheet: str) -> tuple[list[str], list[list]]:
        """(header, data rows): the header is the first row with a non-empty cell."""
        rows = self.rows(sheet)
        for i, r in enumerate(rows):
            if any(c not in (None, "") for c in r):
                header = ["" if c is None else str(c).strip() for c in r]
                return header, [(x + [None] * len(header))[: len(header)] for x in rows[i + 1 :]]
        return [], []


def select_sheets(book: Workbook, selection: "str | list[str] | None") -> list[str]:
    """``None`` or 'first': the first sheet; 'all': all; a list: these, in order; another text: the sheet of that name."""
    names = list(book.sheets)
    if selection is None or selection == "first":
        return names[:1]
    if selection == "all":
        return names
    wanted = list(selection) if isinstance(selection, list | tuple) else [selection]
    for w in wanted:
        if w not in names:
            raise SchemaMismatch(f"no sheet '{w}'; have {names}")
    return wanted


def infer_type(values) -> str:
    """Type of a column from its cells: bool, int64, float64, or utf8 for mixtures, texts and empty columns."""
    seen: set[str] = set()
    for v in values:
        if v is None or v == "":
            continue
        if isinstance(v, bool):
            seen.add("bool")
        elif isinstance(v, int | float):
            seen.add("int64" if isinstance(v, int) or v.is_integer() else "float64")
        else:
            seen.add("utf8")
    if seen == {"int64", "float64"}:
        return "float64"
    return seen.pop() if len(seen) == 1 else "utf8"
