"""WARC archives: write them, read them back, and merge their capture runs into one index.

NULL payloads are empty. A row without a URL or time is written with an empty
URL and the zero time. Rows that repeat the id of a response are responses
themselves; a row without an id is never referred to. Other columns are not
looked at. An empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.llm.shared import spread_join
from labelspring.sources.scratch import drop_table, new_path, write_table

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Records in a file, so that a file can be read by one task.
FILE_RECORDS = 2000
VERSION = "WARC/1.1"
END = "\r\n\r\n"

CAPTURE = (
    "run string, url string, captured string, page_id long, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, position long, length long"
)


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the path: ``com,example)/path?query``."""
    parts = [F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)(:[0-9]+)?([^#]*)", i) for i in (1, 3)]
    host = F.array_join(F.reverse(F.split(F.lower(parts[0]), "\\.")), ",")
    path = F.when(parts[1].startswith("/"), parts[1]).otherwise(F.concat(F.lit("/"), parts[1]))
    return F.when(parts[0] == "", F.lower(url)).otherwise(F.concat(host, F.lit(")"), path))


def with_record_types(pages: DataFrame) -> DataFrame:
    """Mark the captures that only need to point to an equal payload.

    The digests are grouped with partial maxima, and only digests that occur
    more than once come back to the captures, hot ones dealt out. ``pages`` is
    a written table with ``page_id, payload_bytes, payload_digest``.
    """
    equal = ["payload_digest", "payload_bytes"]
    large = pages.where(F.col("payload_bytes") >= REVISIT_BYTES)
    repeated = (
        large.groupBy(*equal)
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and response is not null")
        .drop("n")
    )
    found = spread_join(pages, repeated, equal, "page_id", "left")
    other = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return found.select(
        *pages.columns,
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("response")).alias("refers_to"),
    )


def _record(row: DataFrame) -> Column:
    """A record without its end mark, which the writer adds."""
    revisit = F.col("record_type") == "revisit"
    lines = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.coalesce("captured", F.lit("1970-01-01T00:00:00Z"))),
        F.concat(F.lit("WARC-Target-URI: "), F.translate(F.coalesce("url", F.lit("")), "\r\n", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    return F.concat(lines, F.lit(END), F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit(""))))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``page_id, url, captured, html`` to gzip files below ``path``.

    Only the digests are shuffled to find equal payloads. Spark's text writer
    writes the files, so they go to any store Spark writes to, and a lost task
    leaves no half archive.
    """
    spark = pages.sparkSession
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "captured",
        "html",
        F.octet_length(raw).cast("long").alias("payload_bytes"),
        F.sha1(raw).alias("payload_digest"),
    )
    at_digests = new_path(spark, "digests")
    typed = with_record_types(
        write_table(rows.select("page_id", "payload_bytes", "payload_digest"), at_digests)
    )
    at_types = new_path(spark, "types")
    revisits = write_table(
        typed.where("record_type = 'revisit'")
        .select("page_id", "payload_bytes", "payload_digest", "refers_to")
        .distinct(),
        at_types,
    )
    keys = ["page_id", "payload_bytes", "payload_digest"]
    same = [rows[k].eqNullSafe(revisits[k]) for k in keys]
    joined = rows.join(revisits, same[0] & same[1] & same[2], "left").select(
        *[rows[c] for c in rows.columns], revisits["refers_to"]
    )
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    records = joined.withColumn("record_type", kind).select(_record(joined).alias("value"))
    (
        records.write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )
    drop_table(spark, at_types)
    drop_table(spark, at_digests)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Header fields, position, length and payload of each record of a file."""
    at = 0
    while at < len(content):
        head = content.index(END.encode(), at)
        lines = content[at:head].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = head + len(END)
        end = start + int(fields["Content-Length"])
        if content[end : end + len(END)] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, at, end + len(END) - at, content[start:end]
        at = end + len(END)


def _page(field: str | None) -> int | None:
    number = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives; each file is parsed from its bytes.

    The digest of a response is taken from its payload. A revisit has no payload,
    its size is NULL here and comes from its response in :func:`resolved`.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run = batch.column(0)[k].as_py()
                rows = []
                content = gzip.decompress(batch.column(1)[k].as_py())
                for fields, at, length, payload in parse_records(content):
                    own = fields["WARC-Type"] == "response"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if own and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{run}: the payload at byte {at} has another digest")
                    rows.append(
                        (
                            run,
                            fields["WARC-Target-URI"],
                            fields["WARC-Date"],
                            _page(fields["WARC-Record-ID"]),
                            fields["WARC-Type"],
                            _page(fields.get("WARC-Refers-To")),
                            len(payload) if own else None,
                            digest,
                            at,
                            length,
                        )
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(names, r, strict=True)) for r in rows], schema=schema
                    )

    names = [f.split()[0] for f in CAPTURE.split(", ")]
    text, number = pa.string(), pa.int64()
    kinds = [text, text, text, number, text, number, number, text, number, number]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return files.mapInArrow(parse, CAPTURE)


def resolved(captures: DataFrame) -> DataFrame:
    """Give each revisit the payload size of the response it refers to.

    ``captures`` is a written table. One response may have any share of the
    revisits, which are then dealt out.
    """
    sizes = (
        captures.where("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    found = spread_join(captures, sizes, ["refers_to", "payload_digest"], "page_id", "left")
    return found.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).select(*captures.columns)


class LoserTree:
    """Merge of k sorted iterators: each row costs log k comparisons.

    The inner nodes keep the loser of their match, the root's winner is put out,
    and only the path from the winner's leaf is played again.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._play(1) if runs else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            best = self.winner
            self.heads[best] = next(self.runs[best], None)
            node = (best + len(self.runs)) // 2
            while node >= 1:
                if not self._less(best, self.losers[node]):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def merged_index(captures: DataFrame) -> DataFrame:
    """All captures in order of URL key and time, from runs that are sorted by file.

    The runs are written sorted. Ranges of (key, time, id), cut so that a frequent
    URL is shared out, then get their part of every run and merge the parts; no
    task holds more than a range. ``part`` and ``place`` say where a capture
    stands in the whole order.
    """
    spark = captures.sparkSession
    order = ["url_key", "captured", "page_id"]
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    runs = write_table(keyed.sortWithinPartitions("run", *order), new_path(spark, "runs"))
    ranged = runs.repartitionByRange(*order, "run", "position")
    names = keyed.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        columns = [table[n].to_pylist() for n in [*order, "run", "position"]]
        by_run: dict[str, list[tuple]] = {}
        for number, (key, time, page, run, position) in enumerate(zip(*columns, strict=True)):
            rank = (key, time, page is not None, page or 0, position, number)
            by_run.setdefault(run, []).append(rank)
        parts = [by_run[run] for run in sorted(by_run)]
        for rows in parts:
            rows.sort()  # blocks of one run may arrive in any order; each is sorted already
        merged = LoserTree([iter(rows) for rows in parts])
        table = table.take(pa.array([row[-1] for row in merged], pa.int64()))
        n = table.num_rows
        part = pa.array([TaskContext.get().partitionId()] * n, pa.int32())
        table = table.append_column("part", part).append_column("place", pa.array(range(n), pa.int64()))
        yield from table.combine_chunks().to_batches()

    return ranged.select(*names).mapInArrow(merge, f"{CAPTURE}, url_key string, part int, place long")


def archive_index(pages: DataFrame) -> DataFrame:
    """Write the pages to archives, read these back, and merge the runs into one index.

    ``pages`` has ``page_id, url, captured, html``. The archives stay in the
    shared folder, below the folder named in ``run``.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path)
    captures = write_table(read_captures(spark, path), new_path(spark, "captures"))
    return merged_index(write_table(resolved(captures), new_path(spark, "resolved")))
