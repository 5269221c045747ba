"""Small workbooks, written by hand as zip files of XML."""

import zipfile
from xml.sax.saxutils import escape

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def address(column, row):
    name = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row}"


def cell(value, column, row, shared):
    where = address(column, row)
    if isinstance(value, tuple):  # (style, number)
        return f'<c r="{where}" s="{value[0]}"><v>{value[1]}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{where}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{where}"><v>{value}</v></c>'
    if value.startswith("="):
        return f'<c r="{where}" t="str"><f>x</f><v>{escape(value[1:])}</v></c>'
    if value.startswith("#"):
        return f'<c r="{where}" t="e"><v>{value}</v></c>'
    if len(value) % 2:
        return f'<c r="{where}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{where}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'


def write(path, sheets, date1904=False):
    """sheets: name -> {row number: values}; None leaves a cell out. Style 1 is a date, 2 a date with time, 3 a plain number."""
    shared = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(v, c, n, shared) for c, v in enumerate(values) if v is not None) + "</row>" for n, values in rows.items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN}><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.0[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>hint</t></rPh></si>" for s in shared) + "</sst>")
