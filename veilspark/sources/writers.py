"""Writers: JSON lines for scale, single documents for exchange, and one file for each note.

Single-document writers bring their rows to the driver and are meant for summaries and exports of
small collections; everything else is written by tasks.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bare(entities: str = "entities"):
    return F.transform(entities, lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end")))


def write_detections(df: DataFrame, path: str, key: str = "id") -> None:
    """JSON lines {key, entities}, by all tasks."""
    df.select(F.col("id").alias(key), _bare().alias("entities")).write.mode("overwrite").json(path)


def export_json_array(df: DataFrame, path: str) -> None:
    """One local file with one JSON array, in the order of the first column (an export: rows pass the driver one by one)."""
    rows = df.orderBy(df.columns[0]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(rows):
            f.write(("," if k else "") + "\n  " + row.j)
        f.write("\n]\n")


def export_detections(df: DataFrame, path: str, key: str = "id") -> None:
    export_json_array(df.select(F.col("id").alias(key), _bare().alias("entities")), path)


def write_sanitized(df: DataFrame, path: str, form: str = "parquet") -> None:
    """All sanitized documents, a folder for each method."""
    df.write.mode("overwrite").partitionBy("method").format(form).save(path)


def write_text_files(df: DataFrame, folder: str, name: str = "filename", text: str = "text", prefix: str = "") -> None:
    """One UTF-8 file for each row, named by a column.

    A file appears under its name only when whole, and a task that runs again writes the same
    names.  folder must be on a store that all executors reach; a relative one is below the driver's
    working folder.
    """
    local = folder.startswith("file:") or "://" not in folder
    place = re.sub(r"^file:/+", "/", folder) if folder.startswith("file:") else os.path.abspath(folder)

    def write(rows):
        import uuid

        from pyarrow import fs

        store, base = (fs.LocalFileSystem(), place) if local else fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            temp = f"{base}/.{uuid.uuid4().hex}"
            with store.open_output_stream(temp, compression=None) as f:
                f.write((row[1] or "").encode("utf-8"))
            store.move(temp, f"{base}/{prefix}{row[0]}")

    df.select(name, text).foreachPartition(write)


def export_summary(df: DataFrame, path: str, key: str | None = None) -> None:
    """A small table as one JSON document: an object by key, or the first row's fields."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    body = {r.pop(key): r for r in rows} if key else (rows[0] if rows else {})
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2, default=str)


def write_id_list(df: DataFrame, path: str, column: str) -> None:
    """Distinct values, sorted, one for each line; a global sort keeps the part files in order."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def export_evaluation(strict: DataFrame, relaxed: DataFrame, improvement: DataFrame, path: str) -> None:
    """One JSON document: the metrics of both modes, and the comparison with each baseline by its name (see deidentify.against_baselines)."""
    one = lambda df: df.first().asDict()
    compared = {r.pop("name"): r for r in (row.asDict() for row in improvement.drop("mode").collect())}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"strict": one(strict), "relaxed": one(relaxed), "baseline_comparison": compared}, f, indent=2)


def report(df: DataFrame, title: str, rows: int = 100) -> str:
    """A small table as text: the title, a rule, aligned columns; the first rows of it (a preview)."""
    found = [[str(x) for x in df.columns], *[["" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r] for r in df.limit(rows).collect()]]
    widths = [max(len(r[k]) for r in found) for k in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in found]
    return "\n".join([title, "=" * max(len(title), *map(len, lines)), *lines])
