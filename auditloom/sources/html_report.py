"""An HTML page of findings. It takes summaries, which are a row for each alert level and risk type, never the findings themselves."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}"


def _table(title: str, df: DataFrame, most: int) -> str:
    rows = df.limit(most).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def render(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    """most: rows of a section that a page shows."""
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{_STYLE}</style><h1>{escape(title)}</h1>" + "".join(_table(k, v, most) for k, v in sections.items())
