"""WARC archives and their index.

Writing: one record per page. Of pages with equal payloads (of at least
`least_bytes`) the one with the smallest id is a `response`, the others are
`revisit` records that name it. A record is one row of Spark's text writer
whose line separator is the end of a WARC record, so archives are plain
WARC/1.1 files (gzip files by default) with the writer's commit protocol
behind them, on any store that Spark writes to. Offsets count decompressed
bytes.

Reading: archives are listed by Spark, dealt to tasks, and streamed record by
record (through pyarrow's file systems); memory is bounded by a record.

Index: captures are sorted runs of (URL key, timestamp, id) in each task.
Range bounds, taken from approximate quantiles of a hash-ordered sample, cut
every run into pieces; a merge task takes the pieces of one range and merges
them with a loser tree, so ranges follow each other in global order and a URL
that holds a third of all captures is split by timestamp and id. Runs are
never sorted again.

Defined cases: null html is an empty payload; a null url has an empty URL
key; a null id is written as an id of its own that no record refers to and
ranks last; pages that repeat the smallest id are all responses; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom.llm.common import kept_table, parts

RECORD_END = "\r\n\r\n"
RUN_ROWS = 20_000
RANGE_ROWS = 50_000
SAMPLE_ROWS = 20_000
FIRST_CAPTURE = "2024-01-01 00:00:00"


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed and joined by commas, then the path; scheme, user, `www`, default port and fragment dropped, lower case."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?@]*@)?(?:www\d*\.)?([^/?]*)", 1), r":(?:80|443)$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    name, port = F.regexp_extract(host, r"^([^:]*)", 1), F.regexp_extract(host, r"(:.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def record_id(page_id: Column) -> Column:
    """urn:uuid whose last 64 bits are the page id."""
    h = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    return F.concat(F.lit("urn:uuid:00000000-0000-0000-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12))


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64:
        return None
    return value - (1 << 64) if value >> 63 else value


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, date: Column | None = None, compression: str = "gzip") -> None:
    """Write WARC files below `path`, whole files compressed ("none" for plain ones); `date` defaults to one second per id from `FIRST_CAPTURE` on, within a century."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("payload"),
                        (F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE)) + F.pmod(F.coalesce(F.col(page_id).cast("bigint"), F.lit(0)), F.lit(3_155_760_000)))
                         if date is None else date).alias("date"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    firsts = rows.where(F.col("bytes") >= least_bytes).groupBy("sha256", "bytes").agg(F.min("id").alias("first"))
    joined = rows.join(firsts, ["sha256", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    own = F.when(F.col("id").isNull(), F.concat(F.lit("urn:uuid:ffffffff-"), F.substring(F.hex("sha256"), 1, 4), F.lit("-4000-8000-"), F.substring(F.hex("sha256"), 5, 12))).otherwise(record_id(F.col("id")))
    # base32 of SHA-1: 160 bits are 32 digits of 5 bits
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1("payload"), k, 5), 16, 2), 20, "0") for k in range(1, 41, 5)])
    digest = F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(F.col("bits"), 5 * k + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)])
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace("url", r"[\r\n]+", "%0A")
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("first")), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END))
    (joined.withColumn("bits", bits).withColumn("digest", digest).select(F.concat(head, block).alias("value"))
     .write.option("lineSep", RECORD_END).option("compression", compression).text(path))


def _records(file) -> Iterator[tuple[int, dict[str, str], int, str]]:
    """(offset, header fields, payload bytes, SHA-1 in base32) of each record of an open archive."""
    def line() -> bytes:
        nonlocal at, held
        while (end := held.find(b"\r\n")) < 0:
            more = file.read(1 << 16)
            if not more:
                return b""
            held += more
        out, held = held[:end], held[end + 2:]
        at += end + 2
        return out

    at, held = 0, b""
    while True:
        begin, first = at, line()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {begin}")
        fields = {}
        while text := line():
            name, _, value = text.decode().partition(":")
            fields[name.lower()] = value.strip()
        left, size, digest = int(fields["content-length"]), int(fields["content-length"]), sha1()
        while left:
            if not held:
                held = file.read(1 << 16)
                if not held:
                    raise ValueError(f"archive ends within the record at byte {begin}")
            piece, held = held[:left], held[left:]
            digest.update(piece)
            left, at = left - len(piece), at + len(piece)
        yield begin, fields, size, base64.b32encode(digest.digest()).decode()
        line(), line()


RECORDS = "page_id bigint, url string, date string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, file string, offset bigint"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`; the payload of a revisit is not there (its bytes are null, its digest is the header's)."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, at = pa.fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                rows: list[tuple] = []
                with store.open_input_stream(at) as file:
                    for offset, f, size, digest in _records(file):
                        kind, told = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest != told:
                            raise ValueError(f"digest of the record at byte {offset} of {name} doesn't match")
                        rows.append((page_of(f["warc-record-id"]), f["warc-target-uri"], f["warc-date"], kind, page_of(f.get("warc-refers-to")),
                                     size if kind == "response" else None, told, name, offset))
                        if len(rows) == 5000:
                            yield _batch(rows, RECORDS)
                            rows = []
                yield _batch(rows, RECORDS)

    return files.repartition(max(parts(files), 1)).mapInArrow(run, RECORDS)


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


class LoserTree:
    """Merges sorted iterators: the root's path holds, at each node, the loser of the match played there."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = max(len(self.runs), 1)
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # first match here: wait for the other side
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


INDEX = "url_key string, date string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint"


def merged_index(records: DataFrame) -> DataFrame:
    """Captures in global order of (url_key, date, page_id): the columns of `INDEX` with range_no and range_row, which number that order."""
    keyed = kept_table(records.withColumn("url_key", url_key(F.col("url"))).select(*[c.split()[0] for c in INDEX.split(", ")]), "captures")
    names = [c.split()[0] for c in INDEX.split(", ")]
    count = keyed.count()
    ranges = max(1, -(-count // RANGE_ROWS), min(parts(records), count // 100))
    sample = sorted((r["url_key"], r["date"], r["page_id"] is None, r["page_id"] or 0) for r in
                    keyed.select("url_key", "date", "page_id").orderBy(F.xxhash64("page_id", "url_key")).limit(min(SAMPLE_ROWS, 50 * ranges)).collect())
    bounds = keyed.sparkSession.sparkContext.broadcast(sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else [])
    schema = "range_no int, run string, seq int, " + INDEX

    def sort_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, held = bounds.value, []

        def emit(rows):
            rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
            name = uuid.uuid4().hex
            return _batch([(bisect_left(limits, (r[0], r[1], r[2] is None, r[2] or 0)), name, i, *r) for i, r in enumerate(rows)], schema)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in names))
            while len(held) >= RUN_ROWS:
                yield emit(held[:RUN_ROWS])
                held = held[RUN_ROWS:]
        if held:
            yield emit(held)

    runs = kept_table(keyed.mapInArrow(sort_runs, schema), "capture-runs")

    def merge(table: pa.Table) -> pa.Table:
        pieces: dict[str, list[tuple]] = {}
        columns = [table.column(c).to_pylist() for c in ("run", "seq", *names)]
        for run, seq, *row in zip(*columns):
            pieces.setdefault(run, []).append((seq, row))
        first = table.column("range_no")[0].as_py()
        # a piece arrives in any order of its rows; their numbers within the run restore it without comparing keys
        lists = [[r for _, r in sorted(p, key=lambda x: x[0])] for p in pieces.values()]
        tree = LoserTree([((r[0], r[1], r[2] is None, r[2] or 0, i, k, r) for k, r in enumerate(p)) for i, p in enumerate(lists)])
        return pa.Table.from_batches([_batch([(first, k, *t[6]) for k, t in enumerate(tree)], "range_no int, range_row int, " + INDEX)])

    return runs.groupBy("range_no").applyInArrow(merge, "range_no int, range_row int, " + INDEX)


def capture_history(index: DataFrame) -> DataFrame:
    """The index with revisits' payload bytes filled in from the response they refer to."""
    known = index.where("record_type = 'response'").select(F.col("page_id").alias("target"), F.col("payload_bytes").alias("target_bytes")).dropDuplicates(["target"])
    return (index.join(known, index["refers_to"] == known["target"], "left")
            .withColumn("payload_bytes", F.coalesce("payload_bytes", "target_bytes")).drop("target", "target_bytes"))
