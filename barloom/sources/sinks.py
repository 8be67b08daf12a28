"""Results for people: CSV with provenance, HTML, spreadsheets; bulk tables go through store.replace_partitions."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Most rows of an export for people.
MOST_ROWS = 10_000


def _rows(df: DataFrame):
    pdf = df.limit(MOST_ROWS + 1).toPandas()
    if len(pdf) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows: write the table instead")
    return pdf


def to_csv(df: DataFrame, path: str, provenance: dict | None = None) -> None:
    """UTF-8 with a byte order mark and ISO dates; provenance beside it as <path>.meta.json."""
    pdf = _rows(df)
    pdf.to_csv(path, index=False, encoding="utf-8-sig", date_format="%Y-%m-%d")
    meta = {"rows": len(pdf), "columns": list(pdf.columns)} | (provenance or {})
    Path(f"{path}.meta.json").write_text(json.dumps(meta, indent=1, default=str), encoding="utf-8")


SORTER = (
    "document.querySelectorAll('th').forEach((h,i)=>h.onclick=()=>{const b=h.closest('table').tBodies[0];"
    "const d=h.dataset.d=h.dataset.d==='1'?'-1':'1';[...b.rows].sort((x,y)=>{const p=x.cells[i].textContent,q=y.cells[i].textContent;"
    "return d*((+p===+p&&+q===+q&&p!==''&&q!=='')?p-q:p.localeCompare(q))}).forEach(r=>b.append(r))})"
)


def to_html(df: DataFrame, path: str, title: str) -> None:
    """One file without references; a click on a heading sorts."""
    pdf = _rows(df)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in pdf.columns)
    body = "".join(
        "<tr>" + "".join(f"<td>{'' if v is None or v != v else html.escape(str(v))}</td>" for v in row) + "</tr>"
        for row in pdf.astype(object).itertuples(index=False)
    )
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table><script>{SORTER}</script></body></html>"
    Path(path).write_text(page, encoding="utf-8")


def to_xlsx(df: DataFrame, path: str, sheet: str = "results") -> None:
    """Needs openpyxl, which isn't part of the environment."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("spreadsheets need openpyxl") from e
    _rows(df).to_excel(path, sheet_name=sheet, index=False)


def export_all(results: dict[str, DataFrame], folder: str, provenance: dict | None = None) -> dict[str, str]:
    """CSV and HTML of each result that has rows, into an emptied folder; one failure doesn't stop the others."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    for old in at.iterdir():
        if old.is_file():
            old.unlink()
    said = {}
    for name, df in results.items():
        try:
            if df.isEmpty():
                said[name] = "empty"
                continue
            file = "".join(c if c.isalnum() else "_" for c in name.lower())
            to_csv(df, str(at / f"{file}.csv"), provenance)
            to_html(df, str(at / f"{file}.html"), name)
            said[name] = "written"
        except Exception as e:  # noqa: BLE001
            said[name] = f"failed: {e}"
    return said
