"""A page about a run: small tables only, collected up to a bound."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

MOST_ROWS = 500


def _table(name: str, df: DataFrame) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(f'{v:.6g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows[:MOST_ROWS])
    more = f"<p>The first {MOST_ROWS} rows.</p>" if len(rows) > MOST_ROWS else ""
    return f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}"


def report(title: str, tables: dict[str, DataFrame], path: str | None = None) -> str:
    """The page's HTML; written on the driver if a path is given."""
    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(_table(k, v) for k, v in tables.items())
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(page)
    return page
