"""Sinks: guarded CSV, reports, packs of artifacts, and metrics as text."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import csv_guard


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    cells = [csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a row."""
    df.write.mode(mode).json(path)


def pack(artifacts: dict[str, str]) -> bytes:
    """A ZIP of artifacts and a manifest of their digests; the same artifacts make the same bytes."""
    out = io.BytesIO()
    manifest = {"artifacts": {n: hashlib.sha256(t.encode()).hexdigest() for n, t in sorted(artifacts.items())}}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in [*sorted(artifacts.items()), ("manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body.encode())
    return out.getvalue()


def handoff_artifacts(items: DataFrame, limit: int = 10_000) -> dict[str, str]:
    """Lists of a product's requirement items by kind, in Markdown; one product's items, so few enough for the driver:
    more than ``limit`` are refused."""
    rows = items.orderBy("kind", "item_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} items in one pack")
    out: dict[str, str] = {}
    for r in rows:
        out[f"{r.kind}.md"] = out.get(f"{r.kind}.md", f"# {r.kind}\n\n") + f"- **{r.item_id}** {r.text}\n"
    return out


def exposition(samples: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """A line of text for each series of a histogram: cumulative buckets, sum and count. samples: name, labels, value."""
    grouped = samples.groupBy("name", "labels").agg(*(F.count_if(F.col("value") <= e).alias(f"b{i}") for i, e in enumerate(edges)), F.count("*").alias("n"), F.sum("value").alias("s"))
    label = lambda le: F.concat(F.when(F.col("labels") == "", "").otherwise(F.concat("labels", F.lit(","))), F.lit(f'le="{le}"'))
    braces = lambda x: F.concat(F.lit("{"), x, F.lit("} "))
    lines = [F.concat("name", F.lit("_bucket"), braces(label(e)), F.col(f"b{i}").cast("string")) for i, e in enumerate(edges)]
    lines += [F.concat("name", F.lit("_bucket"), braces(label("+Inf")), F.col("n").cast("string")), F.concat("name", F.lit("_sum"), braces(F.col("labels")), F.col("s").cast("string")), F.concat("name", F.lit("_count"), braces(F.col("labels")), F.col("n").cast("string"))]
    return grouped.select("name", "labels", F.posexplode(F.array(*lines)).alias("position", "line"))
