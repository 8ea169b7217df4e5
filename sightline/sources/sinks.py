"""Writes: appends, replacements by partition, exports, reports and notices."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import severity_rank
from ..params import Notify


def replace_groups(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that rows has, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str, order: list[str], limit: int) -> bool:
    """Writes the first `limit` rows with a header, empty strings for nulls; returns whether rows were left out. The
    export is a bounded file by contract, hence one part."""
    page = rows.orderBy(*order).limit(limit + 1)
    more = page.count() > limit
    page.limit(limit).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
    return more


def export_lines(lines: DataFrame, path: str) -> None:
    """Writes the lines of `report.export_page` in order, with a header, nulls as empty text; a bounded file by contract."""
    page = lines.repartition(1).sortWithinPartitions("line").drop("line")
    page.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def notices(alerts: DataFrame, params: Notify = Notify()) -> DataFrame:
    """Alerts severe enough to be told, with subject and body; cool them down before or after."""
    least = {"low": 0, "medium": 1, "high": 2, "critical": 3}.get(params.min_severity, 2)
    fit = alerts.where(severity_rank(F.col("severity")) >= least)
    subject = F.format_string("[%s] %s seen at %s", F.upper("severity"), "plate", "camera_id")
    return fit.withColumn("subject", subject).withColumn("body", F.format_string("Plate %s, score %.3f, category %s.", "plate", "score", "category"))


def html_report(spark: SparkSession, sections: dict[str, DataFrame], limit: int = 1000, limits: dict[str, int] | None = None) -> str:
    """Sections as HTML tables, each cut to its number of `limits`, else to `limit` rows, and saying so. Values are
    escaped."""
    parts, most = [], limit
    for title, rows in sections.items():
        limit = (limits or {}).get(title, most)
        page = rows.limit(limit + 1).collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in page[:limit])
        note = f"<p>Only the first {limit} rows are shown.</p>" if len(page) > limit else ""
        parts.append(f"<section><h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>{note}</section>")
    return "<!doctype html><html><body>" + "".join(parts) + "</body></html>"
