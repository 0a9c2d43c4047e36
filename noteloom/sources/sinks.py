"""Sinks: Parquet, JSON lines, single-file CSV and Markdown reports, lexicons, run summaries, snapshots, bar charts.

What is gathered on the driver is a report of a bounded number of rows; more than that is refused, not cut off.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators import relational as R
from noteloom.sources.readers import exists, hadoop_path

REPORT_ROWS = 10_000


def write_notes(df: DataFrame, path: str, *order: Column) -> None:
    """Parquet with one row for each note_id, the first by the order."""
    R.keep_first(df, ["note_id"], *order).write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then rename it: a reader sees the whole file or the one before."""
    p, fs = hadoop_path(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not rename {path}.tmp")


def report_rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds {REPORT_ROWS} rows at most: write this table with Spark")
    return rows


def _cell(v) -> str:
    return "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


def markdown(columns: list[str], rows: list) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([_cell(v) for v in r]) for r in rows]]) + "\n"


def write_report(df: DataFrame, stem: str) -> None:
    """stem.csv and stem.md of a small table, in the table's order."""
    rows, q = report_rows(df), lambda s: '"' + s.replace('"', '""') + '"' if any(x in s for x in ',"\r\n') else s
    csv = "\n".join(",".join(q(_cell(v)) for v in r) for r in [df.columns, *rows]) + "\n"
    put_text(df.sparkSession, f"{stem}.csv", csv)
    put_text(df.sparkSession, f"{stem}.md", markdown(df.columns, rows))


def write_lexicon(df: DataFrame, path: str) -> None:
    """The distinct terms in order, as CSV with the one column `term`."""
    df.select("term").where("term <> ''").distinct().orderBy("term").write.mode("overwrite").option("header", True).csv(path)


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    put_text(spark, path, json.dumps(summary | {"timestamp_utc": datetime.now(UTC).isoformat()}, indent=2, sort_keys=True, default=str) + "\n")


def snapshot(spark: SparkSession, candidates: list[str], target: str, label: str) -> str:
    """Copy the first candidate that exists, as Parquet or CSV, with the column method_label; returns which it was."""
    from noteloom.sources.readers import read_any

    found = next((c for c in candidates if exists(spark, c)), None)
    if found is None:
        raise FileNotFoundError(", ".join(candidates))
    read_any(spark, found).withColumn("method_label", F.lit(label)).write.mode("overwrite").parquet(target)
    return found


def bar_svg(title: str, bars: list[tuple[str, float]], width: int = 640) -> str:
    """Horizontal bars, labels at the left and values behind."""
    most = max((v for _, v in bars), default=0) or 1
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 26 * len(bars)}" font-family="sans-serif" font-size="12">', f'<text x="8" y="20" font-size="15">{escape(title)}</text>']
    for i, (name, v) in enumerate(bars):
        y, w = 34 + 26 * i, max(0.0, v / most) * (width - 280)
        out.append(f'<text x="8" y="{y + 14}">{escape(name)}</text><rect x="190" y="{y}" width="{w:.1f}" height="18" fill="#4472a8"/><text x="{196 + w:.1f}" y="{y + 14}">{_cell(v)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def write_bars(df: DataFrame, label: str, value: str, title: str, path: str) -> None:
    rows = report_rows(df.select(F.col(label).cast("string"), F.col(value).cast("double")))
    put_text(df.sparkSession, path, bar_svg(title, [(r[0] or "", r[1] or 0.0) for r in rows]))


def line_svg(title: str, lines: dict[str, list[tuple[float, float]]], width: int = 640, height: int = 360) -> str:
    """One line for each series, x and y from the smallest to the largest value, names at the right."""
    points = [p for line in lines.values() for p in line]
    (x0, x1), (y0, y1) = ((min((p[i] for p in points), default=0.0), max((p[i] for p in points), default=1.0)) for i in (0, 1))
    px = lambda x: 50 + (x - x0) / ((x1 - x0) or 1) * (width - 220)
    py = lambda y: height - 40 - (y - y0) / ((y1 - y0) or 1) * (height - 90)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="8" y="20" font-size="15">{escape(title)}</text>']
    out += [f'<text x="{px(x):.1f}" y="{height - 18}">{_cell(x)}</text>' for x in sorted({x0, x1})] + [f'<text x="4" y="{py(y):.1f}">{_cell(y)}</text>' for y in sorted({y0, y1})]
    for i, (name, line) in enumerate(lines.items()):
        color = f"hsl({210 + 75 * i} 45% 45%)"
        path = " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in sorted(line))
        out.append(f'<polyline points="{path}" fill="none" stroke="{color}" stroke-width="2"/><text x="{width - 160}" y="{44 + 18 * i}" fill="{color}">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def write_lines(df: DataFrame, series: str, x: str, y: str, title: str, path: str) -> None:
    lines: dict[str, list[tuple[float, float]]] = {}
    for name, a, b in report_rows(df.select(F.col(series).cast("string"), F.col(x).cast("double"), F.col(y).cast("double")).where(F.col(x).isNotNull() & F.col(y).isNotNull())):
        lines.setdefault(name or "", []).append((a, b))
    put_text(df.sparkSession, path, line_svg(title, lines))
