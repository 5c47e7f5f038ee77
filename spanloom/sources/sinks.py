"""Report sinks: table folders, CSV, JSON, HTML and a workbook by the standard library."""

from __future__ import annotations

import json
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

LIMIT = 1000


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{folder}/{name}")


def read_tables(spark, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def _column(k: int) -> str:
    out = ""
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or v in (float("inf"), float("-inf")):
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c r="{ref}"><v>{v!r}</v></c>'


def write_workbook(tables: dict[str, DataFrame], path: str, limit: int = LIMIT) -> None:
    """An .xlsx file with one sheet per table, the first ``limit`` rows each (a sheet is for reading)."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, df) in enumerate(tables.items(), 1):
            label = re.sub(r"[\[\]:*?/\\]", "_", name)[:31]
            while label in names:
                label = label[:28] + f"~{k}"
            names.append(label)
            rows = [df.columns, *(list(r) for r in df.limit(limit).collect())]
            body = "".join(f'<row r="{i}">' + "".join(_cell(f"{_column(j)}{i}", v) for j, v in enumerate(r, 1)) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        ids = range(1, len(names) + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(ids, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{types}.worksheet+xml"/>' for k in ids) + "</Types>")


def read_workbook(spark, path: str) -> dict[str, DataFrame]:
    """Sheets of a workbook that write_workbook made, as text columns."""
    import xml.etree.ElementTree as ET

    out = {}
    with zipfile.ZipFile(path) as z:
        strip = lambda t: t.rpartition("}")[2]
        names = [e.get("name") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if strip(e.tag) == "sheet"]
        for k, name in enumerate(names, 1):
            rows = []
            for row in (e for e in ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter() if strip(e.tag) == "row"):
                cells = {}
                for c in row:
                    at = 0
                    for ch in re.match("[A-Z]+", c.get("r"))[0]:
                        at = at * 26 + ord(ch) - 64
                    cells[at] = "".join(x.text or "" for x in c.iter() if strip(x.tag) in ("v", "t"))
                rows.append(cells)
            head = [rows[0][i] for i in sorted(rows[0])] if rows else []
            data = [[r.get(i) for i in range(1, len(head) + 1)] for r in rows[1:]]
            out[name] = spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in head)) if head else None
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    """One CSV file of section, metric, score, grade, detail; scores are a few rows."""
    import csv

    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["section", "metric", "score", "grade", "detail"])
        out.writerows(list(r) for r in scores.select("section", "metric", "score", "grade", "detail").collect())


PAGE = """<!doctype html><meta charset="utf-8"><title>Module tree</title>
<style>body{font:14px sans-serif}details{margin-left:1em}.bar{display:inline-block;height:.6em;background:#69c}</style>
<div id="tree"></div><script>const data=__DATA__;
function node(n){const d=document.createElement(n.children.length?"details":"div"),s=document.createElement(n.children.length?"summary":"span");
s.textContent=n.name+" - "+n.total_us+" us ("+n.pct_of_parent+"%)";const b=document.createElement("span");b.className="bar";b.style.width=(n.bar*100)+"px";s.append(b);d.append(s);n.children.forEach(c=>d.append(node(c)));return d}
data.forEach(n=>document.getElementById("tree").append(node(n)));</script>"""


def write_html(nested: list[dict], path: str) -> None:
    data = json.dumps(nested).replace("</", "<\\/")
    with open(path, "w") as f:
        f.write(PAGE.replace("__DATA__", data))
