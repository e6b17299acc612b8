"""WARC archives with a two-level capture index.

Writing. Every page becomes one gzip member: a response record, or a revisit record where a page with an equal, large
enough payload and a larger id exists. Each task writes one file under a temporary name and renames it when whole, so
a retried task leaves whole files only; the index names the files of the tasks that succeeded.

Index. A capture's key is its URL with the host's labels reversed (`com,example,www)/path`), then its id. Captures are
range-partitioned and sorted by key; every `BLOCK` of them is one compressed block of lines. A directory keeps one row
for each block: its first key and its place. The directory is sparse (one row for BLOCK captures) and itself a file of
Arrow batches, of which a reader maps (or, on a store that can't be mapped, fetches) those that a bisection visits.

Reading. A lookup bisects the directory for (key, id), reads one block by range and bisects its lines for the record's
place. Looking up a whole table sorts the wanted keys, so each block is read once; the places found are dealt out by
archive file and stretch and read there in order, adjacent records together.

Defined results: a null html is an empty payload, a very long one is one record; a null URL has the key `-`; repeated
rows each give a record; several captures of one URL are told apart by id; an empty table gives no archives and an
empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
import os
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, fresh_path, map_arrow, materialise, open_fs, small_batches

#: Captures in a compressed block of the index.
BLOCK = 300
#: A task starts another archive file beyond this size.
FILE_BYTES = 1 << 30
#: Adjacent records read together at most.
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"  # the pages have no capture time


def surt(url: str | None) -> str:
    """Sort key of a URL: labels of the host reversed, then path and query; the fragment doesn't count."""
    if not url:
        return "-"
    scheme, found, rest = url.partition("://")
    if not found:
        return quote(url, safe="/?#[]@!$&'()*+,;=:%~")
    rest = rest.partition("#")[0]
    cut = min((i for c in "/?" if (i := rest.find(c)) >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().partition(":")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return quote(f"{name}){rest[cut:] or '/'}", safe="/?#[]@!$&'()*+,;=:%~")


def record(kind: str, page_id, url: str | None, payload: bytes, digest: bytes, refers_to) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP head, with the payload's length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="/?#[]@!$&'()*+,;=:%~") if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Fields, HTTP fields and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def page_number(urn: str):
    return urn.removeprefix("<urn:page:").removesuffix(">")


class Store:
    """Reads ranges of files in the shared folder, with a few files kept open."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, inner = open_fs(path)
            self.open[path] = fs.open_input_file(inner)
        return self.open[path].read_at(length, offset)


def with_revisits(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, html, refers_to): refers_to is the largest id with an equal payload, if larger than the row's own.

    Digests are grouped without the payloads. Ids travel, payloads move once, by id, which no group of copies skews.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digests = own.filter(F.octet_length("html") >= least_bytes).select("id", F.sha1("html").alias("digest"))
    largest = digests.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = digests.join(largest, "digest").filter("id < refers_to").groupBy("id", "digest").agg(F.max("refers_to").alias("refers_to"))
    again = again.select(F.col("id").alias("again_id"), "digest", "refers_to")
    same = (F.col("id") == F.col("again_id")) & (F.sha1("html") == F.col("digest"))
    return own.join(again, same, "left").select("id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as archives under folder; the captures (key, id, file, offset, length), materialised."""
    marked = with_revisits(pages, least_bytes, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"key string, id {kind}, file string, offset long, length long"
    wanted = arrow_schema(schema)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        name, out, rows, offset = "", None, [], 0

        def finish():
            out.close()
            fs.move(f"{inner}/.{name}", f"{inner}/{name}")
            return pa.RecordBatch.from_pylist(rows, schema=wanted)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, rows, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
                    out = fs.open_output_stream(f"{inner}/.{name}", compression=None)
                payload = html.encode("utf-8", "replace")
                data = member(record("response" if refers_to is None else "revisit", page_id, url, payload, hashlib.sha1(payload).digest(), refers_to))
                out.write(data)
                rows.append({"key": surt(url), "id": page_id, "file": f"{folder}/{name}", "offset": offset, "length": len(data)})
                offset += len(data)
                if offset >= FILE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return materialise(marked.mapInArrow(run, schema), "captures")


DIRECTORY = "first_key string, first_id {kind}, file string, offset long, length long, captures long"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures into compressed blocks; the directory (one row a block), materialised and written as a file."""
    kind = captures.schema["id"].dataType.simpleString()
    schema = DIRECTORY.format(kind=kind)
    wanted = arrow_schema(schema)
    spark = captures.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = captures.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.cdx"
        rows, lines, out, offset = [], [], None, 0

        def flush() -> None:
            nonlocal offset, lines
            data = member("".join(x for _, _, x in lines).encode(), 6)
            out.write(data)
            rows.append({"first_key": lines[0][0], "first_id": lines[0][1], "file": f"{folder}/{name}", "offset": offset, "length": len(data), "captures": len(lines)})
            offset += len(data)
            lines = []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{inner}/.{name}", compression=None)
                place = {"id": r["id"], "file": r["file"], "offset": r["offset"], "length": r["length"]}
                lines.append((r["key"], r["id"], f"{r['key']} {json.dumps(place)}\n"))
                if len(lines) >= BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            fs.move(f"{inner}/.{name}", f"{inner}/{name}")
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    return materialise(sorted_.mapInArrow(run, schema), "directory")


#: Rows of the directory in a batch of its file.
DIRECTORY_ROWS = 10_000


def save_directory(directory: DataFrame, folder: str) -> str:
    """The directory, sorted, as one Arrow file; a stream of its rows passes the driver, DIRECTORY_ROWS at a time."""
    path = f"{folder}/directory.arrow"
    fs, inner = open_fs(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    schema = arrow_schema(directory.schema)
    with fs.open_output_stream(f"{inner}.part", compression=None) as sink, pa.ipc.new_file(sink, schema) as out:
        rows = []
        for r in directory.orderBy("first_key", "first_id", "file", "offset").toLocalIterator():
            rows.append(r.asDict())
            if len(rows) == DIRECTORY_ROWS:
                out.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
                rows = []
        if rows:
            out.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
    fs.move(f"{inner}.part", inner)
    return path


def order(key: str, page_id) -> tuple:
    """How captures are sorted: by key, then by id, those without one first."""
    return (key.encode(), page_id is not None, page_id if page_id is not None else 0)


class Directory:
    """The saved directory: rows by number, in batches that are mapped or fetched when a bisection visits them."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self.file = pa.ipc.open_file(pa.memory_map(inner) if fs.type_name == "local" else fs.open_input_file(inner))
        self.batch = functools.lru_cache(maxsize=64)(self.file.get_batch)
        batches = self.file.num_record_batches
        self.rows = (batches - 1) * DIRECTORY_ROWS + self.batch(batches - 1).num_rows if batches else 0

    def row(self, k: int) -> dict:
        batch, at = self.batch(k // DIRECTORY_ROWS), k % DIRECTORY_ROWS
        return {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}

    def first(self, k: int) -> tuple:
        batch, at = self.batch(k // DIRECTORY_ROWS), k % DIRECTORY_ROWS
        return order(batch.column(0)[at].as_py(), batch.column(1)[at].as_py())

    def last_before(self, wanted: tuple) -> int:
        """The last block that begins before wanted, or else the first: where captures of that order begin."""
        return max(0, bisect_left(range(self.rows), wanted, key=self.first) - 1)


def block_lines(store: Store, file: str, offset: int, length: int) -> list[tuple[str, dict]]:
    text = zlib.decompress(store.read(file, offset, length), 31).decode()
    return [(k, json.loads(v)) for k, v in (x.split(" ", 1) for x in text.splitlines())]


def read_places(store: Store, places: list[dict]) -> Iterator[dict]:
    """The records at the given places; runs of adjacent places are read together."""
    places = sorted(places, key=lambda p: (p["file"], p["offset"]))
    at = 0
    while at < len(places):
        first, end = places[at], at + 1
        stop = first["offset"] + first["length"]
        while end < len(places) and places[end]["file"] == first["file"] and places[end]["offset"] == stop and stop - first["offset"] < READ_BYTES:
            stop += places[end]["length"]
            end += 1
        data = memoryview(store.read(first["file"], first["offset"], stop - first["offset"]))
        for place in places[at:end]:
            begin = place["offset"] - first["offset"]
            yield {"place": place} | parse(zlib.decompress(data[begin : begin + place["length"]], 31))
        at = end


def summary(found: dict) -> dict:
    """What a record says of its page: for a revisit, length and digest come from its fields."""
    fields, payload = found["fields"], found["payload"]
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
    return {
        "payload_bytes": int(found["http"]["Content-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_number(fields["WARC-Refers-To"]) if revisit else None,
    }


class Index:
    """Bisected lookups: the directory, then one block after another from where the wanted captures begin."""

    def __init__(self, directory_file: str):
        self.directory = Directory(directory_file)
        self.store = Store()
        self.block = functools.lru_cache(maxsize=2)(self._block)

    def _block(self, k: int) -> tuple[list[tuple], list[dict]]:
        b = self.directory.row(k)
        lines = block_lines(self.store, b["file"], b["offset"], b["length"])
        return [order(key, place["id"]) for key, place in lines], [place for _, place in lines]

    def places(self, low: tuple, high: tuple) -> Iterator[dict]:
        """The places of the captures from low to high, both included."""
        k = self.directory.last_before(low)
        while k < self.directory.rows and self.directory.first(k) <= high:
            orders, places = self.block(k)
            yield from places[bisect_left(orders, low) : bisect_right(orders, high)]
            k += 1

    def lookup(self, url: str | None) -> list[dict]:
        """All captures of a URL, by id, with their payloads."""
        key = surt(url).encode()
        found = list(self.places((key, False, 0), (key + b"\0", False, 0)))
        ids = [p["id"] for p in found]
        return sorted(read_places(self.store, found), key=lambda f: ids.index(f["place"]["id"]))


#: Bytes of an archive file that are read in one place.
STRETCH = 64 << 20


def find_places(pages: DataFrame, directory_file: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, file, offset, length) of the captures of every page (id, url), by bisected lookups in the order of keys."""
    kind = pages.schema[id_col].dataType.simpleString()
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = map_arrow(pages.select(id_col, url_col), lambda b: {"key": list(map(surt, b.column(1).to_pylist())), "id": b.column(0)}, f"key string, id {kind}")
    ordered = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    schema = f"id {kind}, file string, offset long, length long"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Index(directory_file), None
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = order(key, page_id)
                if own != last:  # repeated rows: their captures are found together
                    rows += index.places(own, own)
                last = own
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    return ordered.mapInArrow(run, schema)


def read_captures(places: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of the records at the places, read by range."""
    kind = places.schema["id"].dataType.simpleString()
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"{id_col} {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"
    wanted = arrow_schema(schema)
    number = wanted.field("refers_to").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store()
        for batch in batches:
            rows = [{id_col: f["place"]["id"]} | summary(f) for f in read_places(store, batch.to_pylist())]
            for r in rows:
                r["refers_to"] = None if r["refers_to"] is None else r["refers_to"] if pa.types.is_string(number) else int(r["refers_to"])
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    by_place = places.repartition(parts, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return by_place.mapInArrow(run, schema)


def read_all(pages: DataFrame, directory_file: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """What the archives say of every page: each is looked up in the index by its key and read from its place."""
    return read_captures(find_places(pages, directory_file, id_col, url_col), id_col)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, str]:
    """Write archives, index and directory of all pages; (folder, directory file)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archive", least_bytes, id_col, url_col, html_col)
    return folder, save_directory(write_index(captures, f"{folder}/index"), folder)
