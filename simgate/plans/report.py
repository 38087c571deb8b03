"""Text and HTML of calibration and evaluation runs, from small collected frames."""

from __future__ import annotations

import html
import math
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgate.operators import metrics
from simgate.operators.metrics import NEGATIVE, POSITIVE

#: Pictures of candidates in a list, and of references.
FIGURES, REFERENCES = 20, 2_000
#: What places a picture and isn't shown in a table.
HIDDEN = ("kind", "picture")


def shown(value: object) -> str:
    """Three decimals; a dash for what is undefined."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def percent(value: float | None) -> str:
    return "-" if value is None or math.isnan(value) else f"{100 * value:.1f}%"


def rows_of(df: DataFrame) -> list[dict]:
    """Rows of a report table: one for each group, cutoff or listed error."""
    return [r.asDict() for r in df.collect()]


def text_table(title: str, rows: list[dict], note: str = "") -> str:
    if not rows:
        return f"{title}\n  (none)\n"
    names = list(rows[0])
    cells = [names, *([shown(r[n]) for n in names] for r in rows)]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    lines = ["  " + "  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in cells]
    return "\n".join([title, *lines, *([f"  {note}"] if note else [])]) + "\n"


def html_table(title: str, rows: list[dict], note: str = "") -> str:
    if not rows:
        return f"<h2>{html.escape(title)}</h2><p>none</p>"
    head = "".join(f"<th>{html.escape(n)}</th>" for n in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" + (f"<p>{html.escape(note)}</p>" if note else "")


def located(rows: DataFrame, nested: bool = False) -> DataFrame:
    """Rows with ``picture``, where the picture of a name lies below its folder: in the folder of its group, where pictures are nested."""
    path = F.concat_ws("/", F.nullif(F.col("group").cast("string"), F.lit("")), F.col("name").cast("string")) if nested else F.col("name").cast("string")
    return rows.withColumn("picture", path)


def source_of(folder: str, picture: str, page: str | None = None) -> str:
    """The address of a picture in a report: as given, or relative to the report's own folder where both are paths, so that they can move together."""
    if page is not None and "://" not in folder and "://" not in page:
        folder = os.path.relpath(folder, os.path.dirname(page) or ".").replace(os.sep, "/")
    return f"{folder.rstrip('/')}/{picture}"


def figure(name: str, picture: str, folder: str, page: str | None = None) -> str:
    """A picture with its name as caption and in place of it; the name alone, however deep the picture lies."""
    label = html.escape(name, quote=True)
    return f'<figure><img src="{html.escape(source_of(folder, picture, page), quote=True)}" alt="{label}"><figcaption>{label}</figcaption></figure>'


@dataclass
class Folders:
    """Where pictures lie: those of candidates of each kind, those of references, and the report itself."""

    negatives: str
    positives: str
    page: str | None = None


def pairs(rows: list[dict], folders: Folders) -> str:
    """Listed candidates, each beside its best match: FIGURES of them at most, and how many more there are."""
    out = []
    for r in rows[:FIGURES]:
        kind = "" if r.get("group") is None else f" ({r['group']})"
        line = f"{shown(r['score'])} {r['name']}{kind}, nearest {r['best_match']}"
        own = folders.positives if r.get("kind") == POSITIVE else folders.negatives
        both = figure(str(r["name"]), str(r.get("picture") or r["name"]), own, folders.page) + figure(str(r["best_match"]), str(r["best_match"]), folders.positives, folders.page)
        out.append(f"<li><p>{html.escape(line)}</p>{both}</li>")
    return "<ol>" + "".join(out) + "</ol>" + (f"<p>+{len(rows) - FIGURES} more not shown</p>" if len(rows) > FIGURES else "")


def references(names: DataFrame, folders: Folders) -> str:
    """The reference set (name, ord) in pictures, in its order; REFERENCES of them at most, and how many more there are."""
    n = names.count()
    first = [str(r["name"]) for r in names.orderBy("ord").limit(REFERENCES).collect()]
    more = f"<p>+{n - REFERENCES} more not shown</p>" if n > REFERENCES else ""
    return f"<h2>Reference set</h2><p>{n} references</p>" + "".join(figure(name, name, folders.positives, folders.page) for name in first) + more


def calibration_sections(run: dict, hard: list[str], nested: bool = False) -> list[tuple[str, list[dict], str]]:
    """(title, rows, note) of each section, in order."""
    scored = run["scored"]
    out = [
        ("Distribution", rows_of(metrics.summarize(scored, "kind").orderBy(F.desc("kind"))), ""),
        ("Overlap", rows_of(metrics.overlap(scored)), ""),
        ("Hard and easy groups", rows_of(metrics.hard_easy_stats(scored, hard).orderBy(F.desc("is_hard"))), ""),
        ("Groups", rows_of(metrics.group_stats(scored).orderBy(F.desc("max"), "group")), ""),
        ("Sweep", rows_of(run["sweep"].orderBy("cutoff")), ""),
        ("Sweep by group", rows_of(run["group_sweep"].orderBy(F.desc("max_score"), "group", "cutoff")), ""),
    ]
    if "choice" in run:
        out.append(("Choice", [run["choice"]], ""))
    listed = lambda kind: rows_of(located(metrics.risks(scored, kind), nested).select("name", "score", "best_match", "group", "kind", "picture"))
    return [*out, ("Closest negatives", listed(NEGATIVE), ""), ("Farthest positives", listed(POSITIVE), "")]


def evaluation_sections(run: dict, nested: bool = False) -> list[tuple[str, list[dict], str]]:
    cells = lambda df: rows_of(located(df, nested).select("name", "score", "best_match", "group", "kind", "picture"))
    out = [("Confusion", rows_of(run["confusion"]), ""), ("Rates", rows_of(run["rates"]), "")]
    if "single_group" in run:
        out.append(("Single group", rows_of(run["single_group"]), ""))
    out.append(("Groups", rows_of(run["groups"]), ""))
    if "drift" in run:
        out.append(("Drift", rows_of(run["drift"].orderBy("metric")), ""))
    return [*out, ("False positives", cells(run["false_positives"]), ""), ("False negatives", cells(run["false_negatives"]), "")]


def as_text(header: str, sections: list[tuple[str, list[dict], str]]) -> str:
    plain = [(title, [{k: v for k, v in r.items() if k not in HIDDEN} for r in rows], note) for title, rows, note in sections]
    return "\n".join([header, "=" * len(header), "", *(text_table(*s) for s in plain)])


def as_html(header: str, sections: list[tuple[str, list[dict], str]], folders: Folders | None = None, names: DataFrame | None = None) -> str:
    """``folders`` adds pictures to listed candidates, and, with the reference set's ``names``, those of the references."""
    parts = []
    for title, rows, note in sections:
        parts.append(html_table(title, [{k: v for k, v in r.items() if k not in HIDDEN} for r in rows], note))
        if folders is not None and rows and "best_match" in rows[0]:
            parts.append(pairs(rows, folders))
    if folders is not None and names is not None:
        parts.append(references(names, folders))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(header)}</title><h1>{html.escape(header)}</h1>" + "".join(parts)
