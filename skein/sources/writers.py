"""Writers: JSON lines, CSV tables, JSON and Markdown reports, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame

#: Reports are for people: tables of more rows are refused, so a driver never holds a corpus by mistake.
MOST_REPORT_ROWS = 10_000


def jsonl(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """One object a line, in as many files as there are partitions."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def csv(df: DataFrame, path: str) -> None:
    """With a header; outer blanks are kept. Readers take an empty text for a null."""
    keep = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("overwrite").options(**keep).csv(path)


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    return [r.asDict(recursive=True) for r in rows]


def json_report(parts: dict[str, DataFrame | dict], path: str) -> dict:
    """Small tables and values as one JSON file; returns what was written."""
    out = {k: (_rows(v) if isinstance(v, DataFrame) else v) for k, v in parts.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return out


def markdown(df: DataFrame, title: str) -> str:
    rows = _rows(df)
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + " --- |" * len(df.columns)
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"## {title}", "", head, rule, *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows), ""])


def manifest(entries: Iterable[dict], path: str) -> None:
    """A manifest of crawl files; without any entry it is an error."""
    entries = list(entries)
    if not entries:
        raise ValueError("no crawl files for a manifest")
    Path(path).write_text(json.dumps({"datasets": entries}, ensure_ascii=False, indent=2), encoding="utf-8")
