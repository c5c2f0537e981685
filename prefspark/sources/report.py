"""Evaluation report sink: long metrics as JSON lines, and one Markdown page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_MARKDOWN_ROWS = 1000


def markdown(metrics: DataFrame, bins: DataFrame) -> DataFrame:
    """The report as lines of Markdown; a report is a few dozen rows, and more is refused."""
    rows = metrics.limit(MAX_MARKDOWN_ROWS + 1).collect()
    if len(rows) > MAX_MARKDOWN_ROWS:
        raise ValueError("not a report: too many metric rows")
    lines = ["# Model evaluation", "", "| block | metric | value |", "| --- | --- | ---: |"]
    lines += [f"| {r.block} | {r.metric} | {'' if r.value is None else r.value} |" for r in sorted(rows, key=lambda r: (r.block, r.metric))]
    lines += ["", "## Calibration", "", "| range | n | mean probability | observed rate |", "| --- | ---: | ---: | ---: |"]
    ranges = bins.limit(MAX_MARKDOWN_ROWS + 1).collect()
    if len(ranges) > MAX_MARKDOWN_ROWS:
        raise ValueError("not a report: too many calibration ranges")
    for r in sorted(ranges, key=lambda r: r.bin):
        mean, rate = ("" if v is None else v for v in (r.avg_probability, r.observed_rate))
        lines.append(f"| {r.low}-{r.high} | {r.n} | {mean} | {rate} |")
    return metrics.sparkSession.createDataFrame([("\n".join(lines),)], "value string")


def write_report(metrics: DataFrame, bins: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    markdown(metrics, bins).select(F.col("value")).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
