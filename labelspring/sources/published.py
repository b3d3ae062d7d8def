"""Tables that are replaced as a whole.

A version is written aside. Then an empty file with its name appears among the
manifests, in one step, and from then on readers take it. Versions are numbered
on from the newest; of two writers at a time each leaves a whole version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from labelspring.sources.scratch import drop_table

#: Versions that stay, for readers that began before the newest was published.
KEPT = 2


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, the newest last."""
    target, files = _folder(spark, f"{path}/manifests")
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return sorted(name for name in names if not name.startswith((".", "_")))


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest version, or None where there is none."""
    names = versions(spark, path)
    return f"{path}/versions/{names[-1]}" if names else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write a new version by ``write(folder)`` and publish it; returns its folder.

    If ``write`` fails nothing is published. Versions before the last ``KEPT`` are deleted.
    """
    names = versions(spark, path)
    number = int(names[-1].partition("-")[0]) + 1 if names else 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    folder = f"{path}/versions/{name}"
    try:
        write(folder)
    except BaseException:
        drop_table(spark, folder)
        raise
    manifest, files = _folder(spark, f"{path}/manifests/{name}")
    files.create(manifest, False).close()
    for old in versions(spark, path)[:-KEPT]:
        drop_table(spark, f"{path}/manifests/{old}")
        drop_table(spark, f"{path}/versions/{old}")
    return folder
