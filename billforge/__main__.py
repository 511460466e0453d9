"""``python -m billforge ROOT ACTION [KEY ...]``: reads and changes a ledger.

Readers: ledger, lookups, status, report, pending, unsynced, export, csv, verify, search; issues (FIRST LAST, the numbers of a run's events), and
over a Parquet table given by ``--rows``: missing-xml, layout, merge-xml, pages; over ``--master``, a workbook: master. Changes: mark-done,
mark-pending, seed, add-codes (CODE or CODE:NUMBER), mark-downloaded, reset, dedupe, append-master, migrate (ROOT of another ledger), compact.
``--out`` writes a workbook instead of showing rows."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from .api import Engine
from .operators import lookups, work
from .schema import DONE, PENDING
from .sources.workbook import read_workbooks, table_of, write_workbook

SHOWN = 5000
READERS = ("ledger", "lookups", "status", "report", "pending", "unsynced", "export", "csv", "verify", "search", "issues", "missing-xml", "layout", "merge-xml", "pages", "master", "append-master")
CHANGES = ("mark-done", "mark-pending", "seed", "add-codes", "mark-downloaded", "reset", "dedupe", "migrate", "compact")
#: Headings of a master workbook's columns.
MASTER = {"seq": ["seq", "stt", "no"], "code": ["code", "lookup_code"], "number": ["number", "invoice_no"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="billforge", description=__doc__)
    p.add_argument("root")
    p.add_argument("action", choices=[*READERS, *CHANGES])
    p.add_argument("keys", nargs="*", help="message ids, or codes of lookups")
    g = p.add_argument_group("rows")
    g.add_argument("--limit", type=int, default=SHOWN, help="0 for all")
    g.add_argument("--status", help="of messages")
    g.add_argument("--duplicates", action="store_true", help="lookups with duplicates")
    g.add_argument("--out", help="a workbook to write")
    g = p.add_argument_group("source")
    g.add_argument("--source", default="inbox", choices=["inbox", "all", "label"])
    g.add_argument("--query", default="", help="more search terms")
    g.add_argument("--since", help="first day")
    g.add_argument("--until", help="last day")
    g = p.add_argument_group("tables")
    g.add_argument("--rows", help="a Parquet table")
    g.add_argument("--master", help="a workbook of codes and numbers")
    g = p.add_argument_group("checks")
    g.add_argument("--folder", help="of files, for verify, layout and merge-xml")
    g.add_argument("--fix", action="store_true", help="mark messages that lack a file as PENDING")
    g.add_argument("--reason", default="SEED")
    g.add_argument("--at", default=datetime.now().isoformat(timespec="seconds"), help="the time of a change")
    return p


def master(e: Engine, a: argparse.Namespace):
    """The rows of a master workbook, or nothing."""
    return None if a.master is None else table_of(read_workbooks(e.spark, a.master), MASTER, ["code"])


def change(e: Engine, a: argparse.Namespace) -> int:
    return {
        "mark-done": lambda: e.mark(a.keys, DONE, a.at), "mark-pending": lambda: e.mark(a.keys, PENDING, a.at), "seed": lambda: e.seed(a.keys, a.reason, a.at), "add-codes": lambda: e.add_codes([(c, n) for c, _, n in (k.partition(":") for k in a.keys)], a.at),
        "mark-downloaded": lambda: e.mark_downloaded(a.keys or None, a.at), "reset": lambda: e.reset_not_found(a.keys, a.at), "dedupe": lambda: e.dedupe(a.at, master(e, a)).first()["new"], "migrate": lambda: e.migrate(Engine(e.spark, a.keys[0]), a.at), "compact": e.compact,
    }[a.action]()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.action == "search":
        print(work.search_query(a.source, a.query, a.since, a.until) or "")
        return
    e = Engine(SparkSession.builder.appName("billforge").getOrCreate(), a.root)
    if a.action in CHANGES:
        print(change(e, a), "changed")
        return
    if a.action == "verify":
        rows = e.verify(a.folder)
        lookups.verify_summary(rows).show()
        rows = rows.where("size(missing) > 0")
        if a.fix:
            print(e.mark([r.message_id for r in rows.collect()], PENDING, a.at), "marked")
    else:
        rows = {
            "ledger": lambda: e.ledger(a.limit, a.status), "lookups": lambda: e.lookup_invoices(a.duplicates), "status": e.status, "report": e.report, "pending": e.pending, "unsynced": e.unsynced,
            "export": e.lookup_export, "csv": e.csv_rows,
            "issues": lambda: e.issues(int(a.keys[0]), int(a.keys[1]), []), "missing-xml": lambda: e.missing_xml(e.spark.read.parquet(a.rows)), "layout": lambda: e.layout_split(a.folder, e.spark.read.parquet(a.rows)),
            "merge-xml": lambda: e.merge_xml(e.spark.read.parquet(a.rows), a.folder), "pages": lambda: e.pages(e.spark.read.parquet(a.rows)), "master": lambda: e.master_additions(master(e, a)), "append-master": lambda: e.append_master(master(e, a), a.at),
        }[a.action]()
    if a.out:
        print(write_workbook(rows, a.out, a.action), "rows")
    else:
        rows.show(a.limit or SHOWN, truncate=False)


if __name__ == "__main__":
    main()
