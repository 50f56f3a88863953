"""An interactive shell: ``python -m sparkloom.shell FOLDER [-c SQL]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from sparkloom.plans import statements as S
from sparkloom.plans.database import Database

HELP = """.help               this text
.tables             all tables
.schema TABLE       a table's columns
.indexes TABLE      a table's indexes
.stats              counters
.explain SQL        a statement's plan
.quit, .exit, .q    leave
Statements end with ; and may take several lines."""


def command(db: Database, line: str) -> str | None:
    """What a dot command prints; None to leave."""
    name, _, rest = line.strip().partition(" ")
    rest = rest.strip().rstrip(";")
    if name in (".quit", ".exit", ".q"):
        return None
    if name == ".help":
        return HELP
    if name == ".tables":
        return "\n".join(db.tables()) or "no tables"
    if name == ".schema":
        return "\n".join(f"{c} {t}" for c, t in db.schema(rest))
    if name == ".indexes":
        return "\n".join(f"{n} ({', '.join(x['columns'])}){' unique' if x['unique'] else ''}" for n, x in db.indexes(rest).items()) or "no indexes"
    if name == ".stats":
        return "\n".join(f"{k}: {v}" for k, v in db.get_stats().items())
    if name == ".explain":
        return db.explain(rest)
    return f"unknown command {name}; .help lists them"


def run(db: Database, lines: Iterable[str], show=print) -> None:
    """Reads lines until they end or a command leaves. Errors are shown, and the next statement runs."""
    held = ""
    for line in lines:
        try:
            if not held.strip() and line.lstrip().startswith("."):
                text = command(db, line)
                if text is None:
                    return
                show(text)
                continue
            held += line if line.endswith("\n") else line + "\n"
            parts = S.tokens(held)
            if parts and parts[-1].text == ";":
                script, held = held, ""
                for result in db.execute_many(script):
                    show(result.to_table_string())
        except Exception as error:  # noqa: BLE001  whatever it is, the shell goes on
            held = ""
            show(f"Error: {error}")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="SQL on versioned Parquet tables")
    parser.add_argument("database", nargs="?", default="sparkloom_data")
    parser.add_argument("-c", "--command")
    parser.add_argument("--pool-size", type=int, help="accepted for compatibility; Spark manages memory")
    given = parser.parse_args(args)
    with Database(given.database) as db:
        if given.command:
            try:
                print(db.execute(given.command).to_table_string())
            except Exception as error:  # noqa: BLE001
                print(f"Error: {error}", file=sys.stderr)
                return 1
            return 0
        run(db, sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
