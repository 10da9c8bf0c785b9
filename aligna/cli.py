"""Command line: translate, quality-report, inbox."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from aligna import config, schemas
from aligna.operators import inbox, translate
from aligna.plans import quality, task
from aligna.session import get_session
from aligna.sinks import reports
from aligna.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aligna")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("translate")
    t.add_argument("path")
    t.add_argument("--out", required=True)
    t.add_argument("--config")
    t.add_argument("--translator")
    t.add_argument("--glossary")
    t.add_argument("--memory")
    t.add_argument("--no-qa", action="store_true")
    q = sub.add_parser("quality-report")
    q.add_argument("source")
    q.add_argument("--targets", nargs="*", default=[])
    q.add_argument("--folder", default=".")
    q.add_argument("--glossary")
    q.add_argument("--exclude", nargs="*", default=[])
    q.add_argument("--report")
    q.add_argument("--svg")
    i = sub.add_parser("inbox")
    i.add_argument("listing")
    i.add_argument("--status")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 when done, 1 when there is nothing to show or units have failed."""
    a = parser().parse_args(argv)
    spark = get_session()
    terms = files.glossary_yaml(spark, a.glossary) if getattr(a, "glossary", None) else None
    if a.command == "translate":
        c = config.load(a.config, translator=a.translator)
        memory = files.memory_json(spark, a.memory) if a.memory else spark.createDataFrame([], schemas.MEMORY)
        result = task.run(spark, a.path, a.out, memory, translate.make(c.translator), terms, c.qa_enabled and not a.no_qa)
        Path(a.out, "report.md").write_text(result["report"], encoding="utf-8")
        print(json.dumps(result["counts"], ensure_ascii=False))
        return int(result["counts"]["Translated"] < result["counts"]["Total Units"])
    if a.command == "quality-report":
        text, rows = quality.report(spark, a.source, a.targets, a.folder, terms, a.exclude)
        if not rows:
            return 1
        if a.report:
            Path(a.report).write_text(f"```\n{text}```\n", encoding="utf-8")
        if a.svg:
            Path(a.svg).write_text(reports.svg(a.source, rows), encoding="utf-8")
        print(text + f"\nBest candidate: {rows[0]['name']} ({rows[0]['overall']:.2f})")
        return 0
    listing = files.listing(spark, Path(a.listing).read_text(encoding="utf-8"))
    status = files.status_json(spark, a.status) if a.status else spark.createDataFrame([], schemas.STATUS)
    found = inbox.next_file(listing, status).collect()
    print(found[0]["name"] if found else "nothing to do")
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(main())
