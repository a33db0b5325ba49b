"""Markdown views of small aggregated frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report shows of a frame; the frame itself is the product.
MOST = 500


def cell(value: object) -> str:
    text = "" if value is None else f"{value:.6f}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, most: int = MOST) -> str:
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def bullets(df: DataFrame, most: int = MOST) -> str:
    """`- key: value` of two-column frames."""
    return "\n".join(f"- {cell(k)}: {cell(v)}" for k, v in df.limit(most).collect())


def document(title: str, sections: dict[str, DataFrame | str]) -> str:
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else bullets(body) if len(body.columns) == 2 else table(body)]
    return "\n\n".join(parts) + "\n"
