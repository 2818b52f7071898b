"""Publishing report runs as a whole (K1).

A run writes its datasets under ``<output>/run-<id>/<report>``, where nobody looks
yet. When all of them are complete, one small manifest ``<output>/manifests/<n>.json``
is written; readers follow the manifest with the greatest number. So a reader sees
all of a run or nothing of it, and a run that fails leaves the one before in place.

A manifest is created exclusively: of two runs that end at once, one gets the next
number. One that cannot be read to its end does not count.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import remove_folder


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_run(output_dir: str) -> str:
    """The folder of a run that is about to be written."""
    return f"{output_dir.rstrip('/')}/run-{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, output_dir: str) -> list[int]:
    fs, folder = _at(spark, f"{output_dir.rstrip('/')}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest_path(output_dir: str, number: int) -> str:
    return f"{output_dir.rstrip('/')}/manifests/{number:012d}.json"


def publish(spark: SparkSession, output_dir: str, datasets: dict[str, str], **about) -> int:
    """Make a complete run the one that readers see; its manifest's number."""
    body = bytearray(json.dumps({**about, "datasets": datasets}, indent=1).encode())
    while True:
        number = (_numbers(spark, output_dir) or [0])[-1] + 1
        fs, target = _at(spark, _manifest_path(output_dir, number))
        try:
            out = fs.create(target, False)
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            continue  # another run took the number
        out.write(body)
        out.close()
        return number


def manifest(spark: SparkSession, output_dir: str, number: int) -> dict | None:
    """The manifest with this number; None if it is not complete."""
    fs, target = _at(spark, _manifest_path(output_dir, number))
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except json.JSONDecodeError:
        return None
    finally:
        stream.close()


def latest_run(spark: SparkSession, output_dir: str) -> dict | None:
    """The manifest of the last published run; None before the first."""
    found = (manifest(spark, output_dir, n) for n in reversed(_numbers(spark, output_dir)))
    return next((m for m in found if m), None)


def read_report(spark: SparkSession, output_dir: str, report: str) -> DataFrame:
    """A report of the last published run."""
    run = latest_run(spark, output_dir)
    if run is None or report not in run["datasets"]:
        raise LookupError(f"no published run under {output_dir} has the report {report!r}")
    return spark.read.format(run.get("format", "parquet")).load(run["datasets"][report])


def prune_runs(spark: SparkSession, output_dir: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` published runs, manifests first."""
    for number in _numbers(spark, output_dir)[: -max(1, keep)]:
        gone = manifest(spark, output_dir, number)
        remove_folder(spark, _manifest_path(output_dir, number))
        for path in (gone or {"datasets": {}})["datasets"].values():
            remove_folder(spark, path.rsplit("/", 1)[0])
