"""DOCX files as unit rows, from the standard library's zip and XML readers."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARAGRAPHS = "file string, part string, pos long, path string, source_text string, style_name string, error string"


def paragraph_text(p: ET.Element) -> str:
    """Runs of a paragraph and of its links; tabs and breaks as in a plain-text view. Text boxes are not its own."""
    out = []

    def walk(e):
        for child in e:
            if child.tag == f"{W}t":
                out.append(child.text or "")
            elif child.tag == f"{W}tab":
                out.append("\t")
            elif child.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
            elif child.tag in (f"{W}r", f"{W}hyperlink"):
                walk(child)

    walk(p)
    return "".join(out)


def _style_names(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    root = ET.fromstring(z.read("word/styles.xml"))
    names = {}
    for s in root.iter(f"{W}style"):
        name = s.find(f"{W}name")
        if name is not None:
            names[s.get(f"{W}styleId")] = name.get(f"{W}val")
    return names


def _style(p: ET.Element, names: dict[str, str]) -> str | None:
    s = p.find(f"{W}pPr/{W}pStyle")
    found = names.get(s.get(f"{W}val"), s.get(f"{W}val")) if s is not None else names.get("Normal", "Normal")
    return found[:1].upper() + found[1:] if found else found


def _relations(z: zipfile.ZipFile) -> dict[str, str]:
    name = "word/_rels/document.xml.rels"
    if name not in z.namelist():
        return {}
    return {r.get("Id"): "word/" + r.get("Target").lstrip("/").removeprefix("word/") for r in ET.fromstring(z.read(name))}


def grid(table: ET.Element) -> list[list[ET.Element]]:
    """Cells by grid place; a merged cell stands in each place it covers."""
    rows: list[list[ET.Element]] = []
    for tr in table.findall(f"{W}tr"):
        row = []
        for tc in tr.findall(f"{W}tc"):
            span = tc.find(f"{W}tcPr/{W}gridSpan")
            down = tc.find(f"{W}tcPr/{W}vMerge")
            cell = tc
            if down is not None and down.get(f"{W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                cell = rows[-1][len(row)]
            row += [cell] * int(span.get(f"{W}val") if span is not None else 1)
        rows.append(row)
    return rows


def cell_text(tc: ET.Element) -> str:
    return "\n".join(paragraph_text(p) for p in tc.findall(f"{W}p"))


def parse(content: bytes) -> list[tuple[str, str, str, str | None]]:
    """(part, path, text, style) of every paragraph and cell, blank ones included, in reading order."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names, links = _style_names(z), _relations(z)
    body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out = []

    def edges(kind):
        for s, section in enumerate(body.iter(f"{W}sectPr")):
            for ref in section.findall(f"{W}{kind}Reference"):
                target = links.get(ref.get(f"{R}id"))
                if ref.get(f"{W}type", "default") == "default" and target in z.namelist():
                    for p, e in enumerate(ET.fromstring(z.read(target)).findall(f"{W}p")):
                        out.append((kind, f"{kind}[s{s}]/p[{p}]", paragraph_text(e), _style(e, names)))

    edges("header")
    for p, e in enumerate(body.findall(f"{W}p")):
        out.append(("body", f"body/p[{p}]", paragraph_text(e), _style(e, names)))
    for t, table in enumerate(body.findall(f"{W}tbl")):
        for r, row in enumerate(grid(table)):
            for c, tc in enumerate(row):
                out.append(("table", f"table[{t}]/cell[{r},{c}]", cell_text(tc), None))
    edges("footer")
    for b, box in enumerate(boxes(body)):
        for p, e in enumerate(box.findall(f"{W}p")):
            out.append(("textbox", f"textbox[{b}]/p[{p}]", "".join(t.text or "" for t in e.iter(f"{W}t")).strip(), None))
    for kind in ("footnote", "endnote"):
        name = f"word/{kind}s.xml"
        if name in z.namelist():
            for note in ET.fromstring(z.read(name)).findall(f"{W}{kind}"):
                if note.get(f"{W}id") not in ("-1", "0"):
                    for p, e in enumerate(note.findall(f"{W}p")):
                        out.append((kind, f"{kind}[{note.get(f'{W}id')}]/p[{p}]", "".join(t.text or "" for t in e.iter(f"{W}t")).strip(), None))
    return out


def boxes(body: ET.Element) -> list[ET.Element]:
    """Text boxes; where a drawing has an old and a new form, the first one."""
    found: list[ET.Element] = []

    def walk(e):
        for child in e:
            if child.tag.endswith("}AlternateContent"):
                if len(child):
                    walk(child[0])
            elif child.tag == f"{W}txbxContent":
                found.append(child)
            else:
                walk(child)

    walk(body)
    return found


def has_images(content: bytes) -> bool:
    return any(n.startswith("word/media/") for n in zipfile.ZipFile(io.BytesIO(content)).namelist())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """PARAGRAPHS of all .docx files under path, blank ones included; an unreadable file is one row with an error.

    Files come through Spark's binaryFile reader, so any store that Spark reads will do.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parse_files(files)


def parse_files(files: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(file, part, i, at, text, style, None) for i, (part, at, text, style) in enumerate(parse(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, ValueError) as e:  # an unreadable file is a row
                    rows = [(file, None, 0, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARAGRAPHS.split(", ")])

    return files.mapInPandas(run, PARAGRAPHS)


def unreadable(paragraphs: DataFrame) -> DataFrame:
    """Issue rows for files that could not be opened."""
    none = F.lit(None).cast("string")
    return paragraphs.where("error IS NOT NULL").select("file", none.alias("unit_id"), F.lit("error").alias("severity"), F.lit("cjk_residue").alias("category"), F.concat(F.lit("Cannot open output file for Chinese residue check: "), "error").alias("detail"), none.alias("source_snippet"), none.alias("target_snippet"))
