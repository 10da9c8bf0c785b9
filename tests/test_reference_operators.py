"""Scoring, rules, memory, files and reports against hand-made values and plain Python."""

import collections
import difflib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from aligna import cli, config, constants
from aligna.functions import text as X
from aligna.operators import glossary, inbox, memory, qa, score, translate, units
from aligna.plans import pairs, quality, task
from aligna.sinks import docx as sink
from aligna.sinks import reports
from aligna.sources import docx, files, lines
from aligna.streaming import inbox as stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def p(text):
    return f'<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def make(paragraphs, cells=(), extra="", notes=(), header=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        table = "".join(f"<w:tbl>{''.join('<w:tr>' + ''.join(f'<w:tc>{c}</w:tc>' for c in row) + '</w:tr>' for row in t)}</w:tbl>" for t in cells)
        sect = '<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr>' if header else ""
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(map(p, paragraphs))}{extra}{table}{sect}</w:body></w:document>")
        if header:
            z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="header1.xml"/></Relationships>')
            z.writestr("word/header1.xml", f"<w:hdr {NS}>{p(header)}</w:hdr>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {NS}>{''.join(f'<w:footnote w:id=\"{i}\">{p(t)}</w:footnote>' for i, t in notes)}</w:footnotes>")
    return out.getvalue()


def one(spark, kinds, *row):
    return spark.createDataFrame([row], kinds)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_text_functions(spark):
    c = lambda s: F.lit(s)
    assert value(spark, X.strip(c("　 a b\t\n"))) == "a b"
    assert value(spark, X.normalize(c(" A　\n b "))) == "a b"
    source = "系统在2026年支持100%可用性"
    assert value(spark, X.numbers_score(c(source))) == ["202", "6", "100"]
    assert value(spark, X.numbers_qa(c(source))) == ["202", "6", "100", "100%", "2026年"]
    assert value(spark, X.mask_name(c("tdra03.en.x.docx"))) == "▓▓▓▓▓▓.en.x.docx" and value(spark, X.mask_name(c("a_b.docx"))) == "▓_▓.docx"
    assert reports.masked("tdra03.en.x.docx") == "▓▓▓▓▓▓.en.x.docx" and reports.masked("a_b.docx") == "▓_▓.docx"
    assert value(spark, X.ellipsize(c("abcdef"), 5)) == "ab..." and value(spark, X.ellipsize(c("abcdef"), 3)) == "abc"
    assert value(spark, X.score_bar(F.lit(50.0))) == "█" * 12 + "░" * 12 == reports.bar(50.0)
    assert value(spark, X.size_number(c("1.5 MB"))) == 1 and value(spark, X.size_number(c("-"))) is None
    assert tuple(value(spark, X.address(c("table[2]/cell[3,4]")))) == ("table", 2, 3, 4) and value(spark, X.address(c("x"))) is None
    assert tuple(value(spark, X.address(c("footnote[-2]/p[1]")))) == ("footnote", -2, 1, None)
    assert value(spark, X.stem(c("/a/b.en.docx"))) == "b.en"


@pytest.mark.parametrize("ratio,want", [(0.44, 35), (0.45, 50), (0.525, 60), (0.60, 70), (0.75, 85), (0.90, 100), (1.30, 100), (1.55, 85), (1.80, 70), (2.15, 60), (2.50, 50), (2.51, 35)])
def test_scope_bands(spark, ratio, want):
    assert value(spark, X.scope_score(F.repeat(F.lit("x"), 1000), F.repeat(F.lit("y"), round(1000 * ratio)))) == pytest.approx(want, abs=1e-9)


def counts(spark, **changed):
    row = dict.fromkeys(score.COUNTS, 0) | {"total_units": 100, "aligned_units": 100, "nonempty_units": 100} | changed
    row |= {"scope_mean": 100.0, "paragraph_match": True, "table_match": True, "cell_match": True}
    return score.metrics(spark.createDataFrame([row], ", ".join(f"{k} {'long' if k in score.COUNTS else 'double' if k == 'scope_mean' else 'boolean'}" for k in row))).collect()[0]


@pytest.mark.parametrize("changed,most", [({"cjk_units": 19}, None), ({"cjk_units": 20}, 55), ({"cjk_units": 40}, 35), ({"cjk_units": 70}, 20), ({"number_checks": 1000, "number_pass": 399}, 45), ({"number_checks": 1000, "number_pass": 400}, 60), ({"number_checks": 1000, "number_pass": 599}, 60), ({"number_checks": 1000, "number_pass": 600}, None), ({"forbidden_hits": 2}, None), ({"forbidden_hits": 3}, 50)])
def test_gates(spark, changed, most):
    m = counts(spark, **changed)
    assert 0 <= m.overall <= 100 and (m.overall <= most if most else m.overall > 60)
    assert all(0 <= m[c] <= 100 for c in ("accuracy", "scope_adherence", "professionalism", "completeness", "structure_fidelity"))


def test_weights_sum_to_one():
    assert sum(constants.ACCURACY.values()) == pytest.approx(1) and sum(constants.OVERALL.values()) == pytest.approx(1)


def write(path, content):
    path.write_bytes(content)
    return str(path)


def test_quality_of_docx_pairs(spark, tmp_path):
    cell = [[[p("参数 100%")]]]
    source = write(tmp_path / "demo.docx", make(["系统在2026年支持100%可用性"], cell))
    write(tmp_path / "demo.en.a.docx", make(["The system supports 100% availability in 2026."], cell))
    write(tmp_path / "demo.en.b.docx", make(["The system supports 100% availability in 2026."], cell))
    text, rows = quality.report(spark, source, [], str(tmp_path))
    assert [r["name"] for r in rows] == ["demo.en.a.docx", "demo.en.b.docx"] and "Model Ranking" in text
    assert rows[0]["overall"] == pytest.approx(93.63) and rows[0]["accuracy"] == pytest.approx(95.45) and rows[0]["findings"] == []
    assert (rows[0]["total_units"], rows[0]["aligned_units"], rows[0]["nonempty_units"]) == (2, 2, 2)
    assert quality.report(spark, source, [], str(tmp_path), exclude=["demo.en.a.docx"])[1][0]["name"] == "demo.en.b.docx"
    assert "<svg" in reports.svg(source, rows) and "0.42" in reports.ansi(source, rows)
    with pytest.raises(FileNotFoundError):
        quality.evaluate(spark, "nowhere.docx", ["x"])
    with pytest.raises(ValueError):
        quality.evaluate(spark, source, [])
    assert cli.main(["quality-report", source, "--folder", str(tmp_path), "--report", str(tmp_path / "r.md")]) == 0


def test_docx_round_trip(spark, tmp_path):
    box = f"<w:p><w:r><mc:AlternateContent><mc:Choice><w:txbxContent>{p('box')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('box')}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    merged = '<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + p("wide") + "</w:tc>"
    content = make(["one", "", "two"], [[[p("c1") + p("中文")]]], box, [(-1, "sep"), (0, "sep"), (2, "note")], "head")
    content2 = make(["x"]).replace(b"", b"")
    write(tmp_path / "a.docx", content)
    write(tmp_path / "b.DOCX", content2)
    write(tmp_path / "c.docx", b"not a zip")
    rows = docx.read_docx(spark, str(tmp_path))
    got = {r.path: r.source_text for r in rows.where("file like '%a.docx'").collect()}
    assert got == {"header[s0]/p[0]": "head", "body/p[0]": "one", "body/p[1]": "", "body/p[2]": "two", "body/p[3]": "", "table[0]/cell[0,0]": "c1\n中文", "textbox[0]/p[0]": "box", "footnote[2]/p[0]": "note"}
    assert docx.unreadable(rows).count() == 1
    u = task.extract(rows).where("doc_id like '%a.docx'").orderBy("seq").collect()
    assert [r.source_text for r in u] == ["head", "one", "two", "c1\n中文", "box", "note"] and u[0].unit_id == "u0001"
    assert u[0].context_before is None and u[1].context_before == "head" and u[5].context_after is None
    texts = [(k, "T " + v.replace("中文", "x")) for k, v in got.items() if v] + [("body/p[99]", "no"), ("odd", "no")]
    new, written, skipped = sink.write(content, texts)
    assert (written, skipped) == (6, 2)
    again = {at: t for _, at, t, _ in docx.parse(new)}
    assert {k: v.rstrip("\n") for k, v in again.items() if v} == {k: v for k, v in texts if k in got}
    assert not any("中" in t for t in again.values()) and b"<w:b" in zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml")
    root = docx.ET.fromstring(f"<w:tbl {NS}><w:tr>{merged}</w:tr></w:tbl>")
    assert [docx.cell_text(c) for c in docx.grid(root)[0]] == ["wide", "wide"]
    assert not docx.has_images(content)


def unit_frame(spark, *pairs_):
    rows = [("d", f"u{i}", "body", f"body/p[{i}]", s, t, e) for i, (s, t, e) in enumerate(pairs_)]
    return spark.createDataFrame(rows, "doc_id string, unit_id string, part string, path string, source_text string, translated_text string, error string")


def found(df):
    return [(r.unit_id, r.severity, r.category) for r in df.orderBy("unit_id").collect()]


def test_rules(spark):
    k = ["doc_id"]
    assert [r.detail for r in qa.numbers(unit_frame(spark, ("系统在2026年支持100%可用性", "supports 100% in 2026.", None), ("7", "8", "failed"), ("7", "", None), ("7", None, None)), k).collect()] == ["Number may be missing or changed: '2026年'"]
    text = lambda n, cjk: "中" * cjk + "a" * (n - cjk)
    u = unit_frame(spark, ("x", text(20, 1), None), ("x", text(21, 1), None), ("x", text(10, 3), None), ("x", text(10, 4), None))
    assert found(qa.residue(u, k)) == [("u1", "warning", "cjk_residue")] and found(qa.untranslated(u, k)) == [("u3", "error", "missing")]
    u = unit_frame(spark, ("s" * 50, "t" * 5, None), ("s" * 51, "t" * 5, None))
    assert found(qa.short(u, k)) == [("u1", "warning", "missing")] and qa.short(u, k).collect()[0].source_snippet is None
    g = spark.createDataFrame([(0, "Alpha", "first", False, True), (1, "Alpha", "second", False, True), (2, "beta", "b", False, False)], "ord long, source_term string, target_term string, case_sensitive boolean, active boolean")
    u = unit_frame(spark, ("the ALPHA beta", "First", None), ("alpha", "SECOND one", None))
    assert found(qa.terms(u, g, k)) == [("u0", "warning", "term")]
    out = spark.createDataFrame([("d", "body", "body/p[0]", "中中中a"), ("d", "body", "body/p[1]", "中中中中"), ("d", "body", "body/p[2]", "中中"), ("d", "table", "table[1]/cell[2,3]", "x中y"), ("d", "header", "header[s0]/p[0]", "中中中中")], "doc_id string, part string, path string, source_text string")
    assert found(qa.output_residue(out, k)) == [("out_p[0]", "warning", "cjk_residue"), ("out_p[1]", "error", "cjk_residue"), ("out_t[1]/r[2]/c[3]", "warning", "cjk_residue")]
    s = one(spark, "doc_id string, paragraphs long, tables long, table_cells long, total_units long", "d", 1, 1, 1, 0)
    t = one(spark, "doc_id string, paragraphs long, tables long, table_cells long", "d", 0, 1, 0)
    assert qa.structure(s, t, k).count() == 3
    assert qa.structure(s.withColumn("total_units", F.lit(2)), t.withColumn("paragraphs", F.lit(None).cast("long")), k).count() == 1


def test_glossary_match(spark):
    g = spark.createDataFrame([(0, "net", "N", False, True), (1, "network", "NW", False, True), (2, "Net", "CS", True, True), (3, "off", "o", False, False), (4, "net", "N2", False, True)], "ord long, source_term string, target_term string, case_sensitive boolean, active boolean")
    u = spark.createDataFrame([(1, "The NETWORK"), (2, "a Net off"), (3, None), (4, "")], "k int, source_text string")
    assert sorted(tuple(r) for r in glossary.match(u, g, ["k"]).collect()) == [(1, "net", "N2"), (1, "network", "NW"), (2, "Net", "CS"), (2, "net", "N2")]
    assert {r.source_term: r.target_term for r in glossary.last_wins(g).collect()}["net"] == "N2"


def memory_frame(spark, rows):
    return spark.createDataFrame([(i, s, t, None, False, 0) for i, (s, t) in enumerate(rows)], "ord long, source_text string, target_text string, source_doc string, confirmed boolean, hit_count long")


def test_memory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.source_text for r in lines.units(docs).select("source_text").distinct().orderBy("source_text").limit(160).collect()]
    m = memory_frame(spark, [(t, f"T{i}") for i, t in enumerate(texts[::2])] + [("aaaaaaaaaaaaaaaaaaaa", "first"), ("  aaaaaaaaaaaaaaaaaaaa ", "again")])
    asked = [(i, t) for i, t in enumerate([*texts[1::2], *[t[:-4] for t in texts[::8]], "aaaaaaaaaaaaaaaaaaab", "", "  ", "zz"])]
    got = {r.k: (r.tm_ord, r.similarity) for r in memory.fuzzy(spark.createDataFrame(asked, "k int, source_text string"), m, "k", block=20).collect()}
    entries = [(r.ord, r.source_text.strip()) for r in m.orderBy("ord").collect()]
    want = {}
    for k, t in asked:
        top = (0.0, None)
        for o, e in entries:
            r = difflib.SequenceMatcher(None, t.strip(), e).ratio() if t.strip() and e else 0.0
            top = (r, o) if r > top[0] else top
        if top[0] >= 0.85:
            want[k] = (top[1], top[0])
    assert got == want and len(want) > 10
    u = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "seq long, source_text string")
    m = memory_frame(spark, [("a", "old"), ("a", "new")])
    assert sorted((r.seq, r.tm_target, r.tm_hit) for r in memory.exact(u, m).collect()) == [(1, "new", True), (2, None, False), (3, "new", True)]
    assert [r.source_text for r in memory.insert_new(m, u.selectExpr("source_text", "'t' as target_text", "seq as ord")).collect()] == ["b"]
    assert {r.ord: r.hits for r in memory.hit_counts(u, m).collect()} == {0: 0, 1: 2}
    g = memory.growing(u.withColumn("doc", F.lit(1)).unionByName(one(spark, "seq long, source_text string, doc int", 4, "b", 1)), m, "doc", lambda t: "new " + t)
    assert [(r.seq, r.translated_text, r.tm_match_type) for r in g.orderBy("seq").collect()] == [(1, "new", "exact"), (2, "new b", None), (3, "new", "exact"), (4, "new b", "exact")]


def test_translation(spark):
    class Flaky:
        def __init__(self):
            self.seen = {}

        def translate(self, text, terms=(), before=None, after=None):
            self.seen[text] = self.seen.get(text, 0) + 1
            if text == "bad" or self.seen[text] < 3:
                raise RuntimeError("busy")
            return text.upper()

        def name(self):
            return "flaky"

    u = spark.createDataFrame([("good",), ("bad",)], "source_text string").coalesce(1)
    got = {r.source_text: (r.translated_text, r.error) for r in translate.call(u, Flaky(), sleep=lambda s: None).collect()}
    assert got == {"good": ("GOOD", None), "bad": (None, "busy")}
    assert translate.make("mock").translate("x") == "[EN] x"
    with pytest.raises(ValueError):
        translate.make("other")
    chat = translate.Chat(lambda messages, **o: f" {messages[-1]['content'].count('x')} ")
    assert chat.translate("xx", [("a", "b")], "before", None) == "2"
    with pytest.raises(ValueError):
        translate.Chat(lambda m, **o: "").translate("x")


def test_inbox_and_files(spark, tmp_path):
    listing = files.listing(spark, "ID\tName\tSize\n1\tlegacy.doc\t1.5 MB\n2\tok.docx\t-\n3\tstatus.json\t2\n4\tDone.DOCX")
    assert listing.count() == 3
    none = files.status_json(spark, str(tmp_path / "absent.json"))
    assert inbox.next_file(listing, none).collect()[0]["name"] == "ok.docx"
    (tmp_path / "status.json").write_text('{"ok.docx": {"status": "success", "errors": 2}, "Done.DOCX": {"status": "failed"}}')
    status = files.status_json(spark, str(tmp_path / "status.json"))
    assert [r["name"] for r in inbox.pending(listing, status).collect()] == ["Done.DOCX"]
    assert {r.filename: r.status for r in inbox.upsert(status, one(spark, "filename string, status string", "Done.DOCX", "success")).collect()} == {"ok.docx": "success", "Done.DOCX": "success"}
    assert files.tsv_rows("id\t7\nname\tx") == [{"id": "7", "name": "x"}] and files.tsv_rows("") == []
    (tmp_path / "g.yaml").write_text("terms:\n- {source: a, target: b, case_sensitive: true}\n- {source: c, target: d, note: n}\n")
    assert [(r.ord, r.source_term, r.case_sensitive, r.notes) for r in files.glossary_yaml(spark, str(tmp_path / "g.yaml")).collect()] == [(0, "a", True, None), (1, "c", False, "n")]
    assert files.glossary_yaml(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a_tm.json").write_text('[{"source_text": "a", "target_text": "1"}, {"source_text": "b", "target_text": "2"}]')
    (tmp_path / "m" / "b_tm.json").write_text('[{"source_text": "a", "target_text": "3", "hit_count": 4}]')
    (tmp_path / "m" / "c_tm.json").write_text("broken")
    assert [(r.ord, r.source_text, r.target_text, r.hit_count) for r in files.memory_json(spark, str(tmp_path / "m")).orderBy("ord").collect()] == [(0, "a", "1", 0), (1, "b", "2", 0), (2, "a", "3", 4)]
    c = one(spark, "errors int, cjk_residue int, elapsed_seconds double", 0, 0, 75.0)
    assert tuple(c.select(inbox.conclusion().alias("a"), inbox.elapsed().alias("b")).collect()[0]) == ("passed", "1m15s")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("data_dir: /x\ntranslator: chat\napi_key: file\nother: 1\n")
    c = config.load(str(tmp_path / "c.yaml"), env={"ALIGNA_TRANSLATOR": "mock", "ALIGNA_TM_THRESHOLD": "bad", "ALIGNA_API_KEY": "env"})
    assert (c.tm_dir, c.translator, c.api_key, c.tm_similarity_threshold) == ("/x/tm", "mock", "file", 0.85)
    assert config.load(env={}, translator="t").translator == "t"


def test_task_resumes_and_stream_reads_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.docx", make(["hello 5", "world", "hello 5"]))
    m = memory_frame(spark, [("world", "monde")])
    first = task.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), m, translate.Mock())
    assert first["counts"]["Total Units"] == first["counts"]["Translated"] == 3 and first["counts"]["Memory matches"] == 1
    again = task.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), m, translate.Mock())
    assert again["counts"] == first["counts"] and "## Summary" in again["report"]
    assert [t for _, _, t, _ in docx.parse((tmp_path / "out" / "docs" / "a.docx").read_bytes())] == ["[EN] hello 5", "monde", "[EN] hello 5"]
    for k in range(2):
        stream.start(spark, str(tmp_path / "in"), str(tmp_path / "units"), str(tmp_path / "check")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "units")).count() == 3 + k
        write(tmp_path / "in" / "b.docx", make(["new"]))


def test_identity_and_order(spark):
    docs = spark.createDataFrame([(1, "a 1\nb\n\nc 22 33"), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    m = {(r.doc_id, r.candidate): r for r in pairs.metrics(docs).collect()}
    assert m[(1, "identity")].overall == 100 and m[(1, "identity")].number_integrity == 100
    assert not m[(1, "gaps")].paragraph_match or m[(1, "gaps")].aligned_units == m[(1, "gaps")].total_units
    assert all(0 <= r.overall <= 100 for r in m.values())
    assert {k[0] for k in m} == {1, 2}
    n = units.number(lines.units(docs)).collect()
    assert sorted((r.doc_id, r.seq, r.path) for r in n) == [(1, 1, "body/p[0]"), (1, 2, "body/p[1]"), (1, 3, "body/p[3]"), (2, 1, "body/p[0]")]
