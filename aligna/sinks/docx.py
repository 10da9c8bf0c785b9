"""Writing translations back into copies of their DOCX files."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from aligna.sources.docx import R, W, boxes, grid

SPACE = "{http://www.w3.org/XML/1998/namespace}space"
FORM = re.compile(r"(?P<kind>header|footer)\[s(?P<a>\d+)\]/p\[(?P<b>\d+)\]|(?P<body>body)/p\[(?P<p>\d+)\]|(?P<table>table)\[(?P<t>\d+)\]/cell\[(?P<r>\d+),(?P<c>\d+)\]|(?P<box>textbox)\[(?P<x>\d+)\]/p\[(?P<y>\d+)\]|(?P<note>footnote|endnote)\[(?P<id>-?\d+)\]/p\[(?P<q>\d+)\]")
RESULT = "file string, content binary, written long, skipped long"


def set_text(p: ET.Element, text: str) -> None:
    """The first run keeps its format and holds the text; other runs go; without runs one is made."""
    holders = [e for e in p.iter() if any(c.tag == f"{W}r" for c in e)]
    runs = [(h, r) for h in holders for r in list(h) if r.tag == f"{W}r" and any(c.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr") for c in r)]
    if not runs:
        runs = [(p, ET.SubElement(p, f"{W}r"))]
    first = runs[0][1]
    for h, r in runs[1:]:
        h.remove(r)
    for c in [c for c in first if c.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr")]:
        first.remove(c)
    t = ET.SubElement(first, f"{W}t")
    t.text = text
    t.set(SPACE, "preserve")


def set_cell(tc: ET.Element, text: str) -> None:
    """All paragraphs are blanked; the first holds the text."""
    ps = tc.findall(f"{W}p") or [ET.SubElement(tc, f"{W}p")]
    for p in ps[1:]:
        set_text(p, "")
    set_text(ps[0], text)


def write(content: bytes, texts: list[tuple[str, str]]) -> tuple[bytes, int, int]:
    """A copy of the file with the texts at their paths; how many were written, and how many found no place."""
    z = zipfile.ZipFile(io.BytesIO(content))
    trees: dict[str, ET.Element] = {}

    def tree(name):
        if name not in trees:
            raw = z.read(name)
            for _, (prefix, uri) in ET.iterparse(io.BytesIO(raw), events=["start-ns"]):
                if not re.fullmatch(r"ns\d+", prefix):
                    ET.register_namespace(prefix, uri)
            trees[name] = ET.fromstring(raw)
        return trees[name]

    body = tree("word/document.xml").find(f"{W}body")
    rels = "word/_rels/document.xml.rels"
    links = {r.get("Id"): "word/" + r.get("Target").lstrip("/").removeprefix("word/") for r in ET.fromstring(z.read(rels))} if rels in z.namelist() else {}

    def place(path):
        m = FORM.fullmatch(path)
        if not m:
            return None
        if m["kind"]:
            section = list(body.iter(f"{W}sectPr"))[int(m["a"])]
            ref = next(r for r in section.findall(f"{W}{m['kind']}Reference") if r.get(f"{W}type", "default") == "default")
            return tree(links[ref.get(f"{R}id")]).findall(f"{W}p")[int(m["b"])]
        if m["body"]:
            return body.findall(f"{W}p")[int(m["p"])]
        if m["table"]:
            return grid(body.findall(f"{W}tbl")[int(m["t"])])[int(m["r"])][int(m["c"])]
        if m["box"]:
            return boxes(body)[int(m["x"])].findall(f"{W}p")[int(m["y"])]
        note = next(n for n in tree(f"word/{m['note']}s.xml") if n.get(f"{W}id") == m["id"])
        return note.findall(f"{W}p")[int(m["q"])]

    written = skipped = 0
    for path, text in texts:
        try:
            e = place(path)
        except (IndexError, StopIteration, KeyError):  # out of range: counted, not written
            e = None
        if e is None:
            skipped += 1
            continue
        (set_cell if e.tag == f"{W}tc" else set_text)(e, text)
        written += 1
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in z.infolist():
            data = ET.tostring(trees[item.filename], encoding="UTF-8", xml_declaration=True) if item.filename in trees else z.read(item.filename)
            new.writestr(item, data)
    return out.getvalue(), written, skipped


def render(files: DataFrame, units: DataFrame) -> DataFrame:
    """RESULT for each file (path, content): its units (file, path, translated_text, error) that are translated, written back."""
    def run(f: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for file, content in zip(f["path"], f["content"], strict=True):
            ok = u[u["translated_text"].notna() & (u["translated_text"] != "") & (u["error"].isna() | (u["error"] == ""))]
            rows.append((file, *write(bytes(content), list(zip(ok["path"], ok["translated_text"], strict=True)))))
        return pd.DataFrame(rows, columns=["file", "content", "written", "skipped"])

    left = files.select("path", "content").groupBy("path")
    right = units.select("file", "path", "translated_text", "error").groupBy("file")
    return left.cogroup(right).applyInPandas(run, RESULT)


def save(rendered: DataFrame, folder: str) -> None:
    """Each file by its name under a folder that all executors share; written whole, then put in place."""
    def put(rows):
        for r in rows:
            to = Path(folder) / Path(r.file).name
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_suffix(".part")
            part.write_bytes(bytes(r.content))
            part.replace(to)

    rendered.foreachPartition(put)
