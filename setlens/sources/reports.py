"""Result tables as CSV (fractions), Markdown and LaTeX (percent); all are rendered before any file changes."""

from __future__ import annotations

import csv
import io

from setlens.sources.files import write_text

# Characters that LaTeX reads as commands.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape(text: str) -> str:
    return text.translate(str.maketrans(LATEX))


def percent(value: float | None, digits: int, absent: str) -> str:
    return absent if value is None else f"{100 * value:.{digits}f}"


def render(rows: list[dict], name: str, columns: list[str], kind: str, digits: int = 2) -> str:
    """rows as dicts of fractions, one column with names; kind: csv, markdown or latex."""
    if kind == "csv":
        body = [[str(r[name]), *("" if r.get(c) is None else repr(float(r[c])) for c in columns)] for r in rows]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([[name, *columns], *body])
        return out.getvalue()
    if kind == "markdown":
        body = [[str(r[name]), *(percent(r.get(c), digits, "—") for c in columns)] for r in rows]
        head = [[name, *columns], ["---", *["---:"] * len(columns)]]
        return "\n".join("| " + " | ".join(x) + " |" for x in [*head, *body]) + "\n"
    if kind == "latex":
        body = [[escape(str(r[name])), *(percent(r.get(c), digits, "--") for c in columns)] for r in rows]
        head = [escape(x) for x in (name, *columns)]
        lines = [" & ".join(x) + r" \\" for x in [head, *body]]
        return "\\begin{tabular}{l" + "r" * len(columns) + "}\n" + "\n".join(lines) + "\n\\end{tabular}\n"
    raise ValueError(f"unknown kind: {kind}")


def write_reports(rows: list[dict], name: str, columns: list[str], stem: str) -> None:
    texts = {ext: render(rows, name, columns, kind) for ext, kind in (("csv", "csv"), ("md", "markdown"), ("tex", "latex"))}
    for ext, text in texts.items():
        write_text(f"{stem}.{ext}", text)
