"""WARC archives with a two-level capture index.

``write`` puts one record for each page into archives, a gzip member each, so
that a record can be read alone.  Of records with equal payloads (SHA-1 and a
second hash) of ``min_bytes`` or more, the one with the largest ``page_id`` is
the response, the others are revisits that refer to it and carry no payload.

The index has two levels.  Captures are sorted by reversed-host URL key, then
page id, range-partitioned; a partition writes one file of gzip blocks of
``block_lines`` lines each, and a sparse directory with the first key of each
block and its byte range.  The manifest has one row for each index file.  A
key is looked up by binary search among the first keys of the files (one each,
so bounded by the number of partitions), then in a file's directory, then in
one block; the record is a range read of its archive.

``locate`` looks up many captures at once: keys are dealt to the index file
that holds them and read in order, so each block is opened once.  ``fetch``
deals what was located by archive and place, and nearby records are read in
one range.

Files are written by tasks through ``pyarrow.fs``, so the folder must be one
that it can open (local or mounted, S3, GCS, HDFS).  A name holds a random
part, and only names in the manifest, which Spark commits, count: a repeated
or lost task leaves files that nothing refers to.

Defined results: null html is an empty payload; null urls have the key ``-``;
a null ``page_id`` counts below all others, and its record has no number;
records tied for the largest id of a payload are all responses; each row is a
capture of its own, also if repeated; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored


@dataclass(frozen=True)
class Params:
    min_bytes: int = 0                    # smaller payloads are always responses
    level: int = 4                        # of compression
    archive_bytes: int = 256 << 20        # an archive ends with the record that reaches it
    block_lines: int = 3000
    gap: int = 1 << 16                    # records no further apart are read in one range
    read_bytes: int = 8 << 20             # length of such a range
    task_bytes: int = 16 << 20            # a large archive is read by several tasks
    date: str = "1970-01-01T00:00:00Z"    # pages carry no time


# -- records ----------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, p: Params = Params()) -> bytes:
    """A record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {p.date}", f"WARC-Target-URI: {escaped(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(head).encode() + block + b"\r\n\r\n", p.level)


def member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> dict:
    """Fields of a compressed record; ``payload`` is null for a revisit."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(field["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    revisit = field["WARC-Type"] == "revisit"
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    if not revisit and (len(payload) != size or digest(payload) != field["WARC-Payload-Digest"][5:]):
        raise ValueError(f"payload of {field['WARC-Record-ID']} is damaged")
    return {"page_id": number(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "record_type": field["WARC-Type"], "payload_bytes": size,
            "payload_digest": field["WARC-Payload-Digest"][5:], "refers_to": number(field["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit else payload}


def escaped(text: str) -> str:
    """Control characters by percent signs, so that a line stays a line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text) if any(c < " " or c == "\x7f" for c in text) else text


def surt(url: str | None) -> str:
    """``com,example,www)/path`` of a URL: the host's labels reversed, in small letters, then all that follows it."""
    if url is None:
        return "-"
    rest = url.split("://", 1)[-1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, _, port = rest[:end].partition(":")
    return escaped(",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + rest[end:])


# -- files --------------------------------------------------------------------------

def opened(path: str):
    from pyarrow import fs
    where, root = fs.FileSystem.from_uri(path)
    return where, root


class Files:
    """Range reads; the file read last stays open."""

    def __init__(self, path: str):
        self.where, self.root = opened(path)
        self.name = self.file = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.where.open_input_file(f"{self.root}/{name}")
        self.file.seek(offset)
        return self.file.read(length)


ENTRY = "key string, page_id long, file string, offset long, length long"


def roles(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """``page_id, url, html, first``: ``first`` is the largest id among equal payloads, where there are several."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keys = {"_a": F.sha1("html"), "_b": F.xxhash64("html")}
    many = (rows.where(F.octet_length("html") >= p.min_bytes).select("page_id", *[v.alias(k) for k, v in keys.items()])
                .groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1").drop("n"))
    many = stored(many, "warc-repeated")           # its size is known to the join
    return rows.withColumns(keys).join(many, ["_a", "_b"], "left").select("page_id", "url", "html", "first")


def write(pages: DataFrame, path: str, p: Params = Params()) -> DataFrame:
    """Archives below ``path``; returns ``key, page_id, file, offset, length`` of each record."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        where, root = opened(path)
        where.create_dir(root, recursive=True)
        out, seq, offset = None, 0, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None:
                        file, offset = f"{name}-{seq:04d}.warc.gz", 0
                        out = where.open_output_stream(f"{root}/{file}", compression=None)
                    data = record(page_id, url, html.encode(), first, first is not None and page_id != first, p)
                    out.write(data)
                    rows.append((surt(url), page_id, file, offset, len(data)))
                    offset += len(data)
                    if offset >= p.archive_bytes:
                        out.close()
                        out, seq = None, seq + 1
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in ENTRY.split(", ")])
        finally:
            if out is not None:
                out.close()

    return stored(roles(pages, p).mapInArrow(run, ENTRY), "warc-entries")


# -- index --------------------------------------------------------------------------

MANIFEST = "first string, first_id long, file string, directory string, lines long, bytes long"


def place(key: str | bytes, page_id: int | None) -> tuple[bytes, bool, int]:
    """Order of captures: bytes of the key, then the id, null first."""
    return key.encode() if isinstance(key, str) else key, page_id is not None, page_id or 0


def index(entries: DataFrame, path: str, p: Params = Params()) -> DataFrame:
    """Sorted blocks and their directories below ``path``; returns the manifest."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        where, root = opened(path)
        where.create_dir(root, recursive=True)
        lines, directory, offset, total, size, head, out = [], [], 0, 0, 0, None, None

        def block() -> int:
            data = member("".join(f"{k}\t{'' if i is None else i}\t{f}\t{o}\t{n}\n" for k, i, f, o, n in lines).encode(), 6)
            out.write(data)
            directory.append(f"{lines[0][0]}\t{'' if lines[0][1] is None else lines[0][1]}\t{offset}\t{len(data)}\n")
            return len(data)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    head, out = row, where.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
                lines.append(row)
                total, size = total + 1, size + row[4]
                if len(lines) == p.block_lines:
                    offset += block()
                    lines.clear()
        if out is None:
            return
        if lines:
            block()
        out.close()
        with where.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
            f.write("".join(directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([head[0]]), pa.array([head[1]], pa.int64()), pa.array([f"{name}.cdx.gz"]), pa.array([f"{name}.directory"]),
                                          pa.array([total]), pa.array([size])], [c.split()[0] for c in MANIFEST.split(", ")])

    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("offset")]
    return stored(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "warc-manifest")


class Directory:
    """The blocks of one index file."""

    def __init__(self, files: Files, file: str, directory: str):
        with files.where.open_input_stream(f"{files.root}/{directory}", compression=None) as f:
            rows = [line.split(b"\t") for line in f.read().split(b"\n")[:-1]]
        self.files, self.file, self.at, self.lines = files, file, None, []
        self.first = [place(k, int(i) if i else None) for k, i, _, _ in rows]
        self.ranges = [(int(o), int(n)) for _, _, o, n in rows]

    def find(self, key: str, page_id: int | None | str) -> list[tuple[int | None, str, int, int]]:
        """``page_id, file, offset, length`` of the captures of a key, of one id or (``"any"``) of all."""
        every = page_id == "any"
        low = place(key, None if every else page_id)
        high = (low[0], True, 2 ** 63) if every else low
        out = []
        for k in range(max(0, bisect_left(self.first, low) - 1), bisect_right(self.first, high)):
            if k != self.at:
                data = gzip.decompress(self.files.read(self.file, *self.ranges[k]))
                self.at, self.lines = k, [line.split("\t") for line in data.decode().split("\n")[:-1]]
                self.places = [place(x[0], int(x[1]) if x[1] else None) for x in self.lines]
            for x in self.lines[bisect_left(self.places, low):bisect_right(self.places, high)]:
                out.append((int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])))
        return out


# -- reads --------------------------------------------------------------------------

@dataclass(frozen=True)
class Archive:
    path: str                 # archives and index files
    manifest: DataFrame


def archive(pages: DataFrame, path: str | None = None, p: Params = Params()) -> Archive:
    """Write the archives of ``page_id, url, html`` and their index."""
    path = path or scratch(pages.sparkSession, "warc")
    return Archive(path, index(write(pages, path, p), path, p))


def _parts(a: Archive) -> list:
    """One row for each index file, in key order: as many as the index had partitions."""
    return sorted(a.manifest.collect(), key=lambda r: place(r["first"], r["first_id"]))


def locate(a: Archive, wanted: DataFrame) -> DataFrame:
    """``file, offset, length`` of each capture of a ``page_id, url``, once however often it is asked for."""
    parts, path = _parts(a), a.path
    firsts, files = [place(r["first"], r["first_id"]) for r in parts], [(r["file"], r["directory"]) for r in parts]

    def deal(batches):
        import pyarrow as pa
        for b in batches:
            rows = []
            for page_id, url in zip(*(c.to_pylist() for c in b.columns)):
                key = surt(url)
                at = place(key, page_id)
                rows += [(k, key, page_id) for k in range(max(0, bisect_left(firsts, at) - 1), bisect_right(firsts, at))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], ["part", "key", "page_id"])

    def look(batches):
        import pyarrow as pa
        reader, part, last = Files(path), None, None
        for b in batches:
            rows = []
            for k, key, page_id in zip(*(c.to_pylist() for c in b.columns)):
                if (k, key, page_id) == last:
                    continue
                last = k, key, page_id
                if k != part:
                    part, directory = k, Directory(reader, *files[k])
                rows += [r[1:] for r in directory.find(key, page_id)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    keys = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(deal, "part int, key string, page_id long")
    keys = keys.repartition("part").sortWithinPartitions("part", "key", F.col("page_id").asc_nulls_first())
    return keys.mapInArrow(look, "file string, offset long, length long")


MOST_TASKS = 100_000
FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def fetch(a: Archive, places: DataFrame, columns: str = FIELDS, p: Params = Params()) -> DataFrame:
    """The records at ``file, offset, length``; ``columns`` are some of FIELDS."""
    path = a.path

    def run(batches):
        import pyarrow as pa
        reader = Files(path)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            k = 0
            while k < len(rows):
                file, start, length = rows[k]
                end, z = start + length, k + 1
                while z < len(rows) and rows[z][0] == file and rows[z][1] - end <= p.gap and rows[z][1] + rows[z][2] - start <= p.read_bytes:
                    end, z = rows[z][1] + rows[z][2], z + 1
                data = memoryview(reader.read(file, start, end - start))
                found = [parse(bytes(data[o - start:o - start + n])) for _, o, n in rows[k:z]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kinds[t]) for c, t in map(str.split, columns.split(", "))],
                                                 [c.split()[0] for c in columns.split(", ")])
                k = z

    # Rows are slim but the records are not: so many tasks as there are archives to read, not as these rows would need.
    tasks = max(1, sum(r["bytes"] for r in _parts(a)) // p.task_bytes)
    places = places.withColumn("deal", F.floor(F.col("offset") / p.task_bytes))
    places = places.repartition(min(tasks, MOST_TASKS), "file", "deal").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return places.mapInArrow(run, columns)


def lookup(spark: SparkSession, a: Archive, url: str) -> list[dict]:
    """All captures of one URL, by binary search and range reads alone."""
    parts, files, key = _parts(a), Files(a.path), surt(url)
    firsts = [place(r["first"], r["first_id"]) for r in parts]
    out = []
    for k in range(max(0, bisect_left(firsts, place(key, None)) - 1), bisect_right(firsts, (key.encode(), True, 2 ** 63))):
        found = Directory(files, parts[k]["file"], parts[k]["directory"]).find(key, "any")
        out += [parse(files.read(file, offset, length)) for _, file, offset, length in found]
    return out


def captures(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Write, index, look up every page and read its record back: the contract's rows."""
    a = archive(pages, p=p)
    columns = ", ".join(FIELDS.split(", ")[i] for i in (0, 3, 4, 2, 5))
    return fetch(a, locate(a, pages), columns, p)
