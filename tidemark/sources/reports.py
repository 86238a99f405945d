"""Reports of small results: Markdown tables by section and an HTML page of figures. Rows are fetched up to a stated limit."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def _cell(v) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def signed_percent(v: float | None) -> str:
    return "–" if v is None else f"{100 * v:+.1f} %"


def markdown(df: DataFrame, title: str, section: str | None = None, limit: int = 200) -> str:
    """A table, or one per value of `section`; an empty result says so."""
    rows = df.limit(limit).collect()
    cols = [c for c in df.columns if c != section]
    out = [f"# {title}", ""]
    if not rows:
        return "\n".join([*out, "No rows.", ""])
    for s in dict.fromkeys(r[section] if section else None for r in rows):
        out += [f"## {s}", ""] if section else []
        out += ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
        out += ["| " + " | ".join(_cell(r[c]).replace("|", "\\|") for c in cols) + " |" for r in rows if not section or r[section] == s] + [""]
    return "\n".join(out)


def html(figures: dict[str, object], tables: dict[str, DataFrame], title: str, limit: int = 12) -> str:
    parts = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1><dl>"]
    parts += [f"<dt>{escape(k)}</dt><dd>{escape(_cell(v))}</dd>" for k, v in figures.items()] + ["</dl>"]
    for name, df in tables.items():
        rows = df.limit(limit).collect()
        parts.append(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{escape(_cell(v))}</td>" for v in r) + "</tr>" for r in rows] + ["</table>"]
    return "".join(parts)
