"""WARC archives in seekable Zstandard bundles, and their reader.

A bundle is a file of independent Zstandard frames, each of which holds some whole records, and a
footer in a skippable frame: the seek table, with the sizes of every frame. The index maps a record's
identifier to its bundle, frame and offset within the frame, so one record is read by one ranged read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import maybe_broadcast, shared_dir, written

#: Uncompressed bytes after which a frame and a bundle are closed; a record is never cut.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Frames of a run, which is read at one go, and runs of a task.
RUN_FRAMES, RUNS_PER_TASK = 16, 4
#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 1000
#: Fixed values of the seekable Zstandard format: skippable frame, and the footer's last four bytes.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed, so that the same rows give the same bytes.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _id(page: int | None, row: int) -> str:
    """An identifier of the row, so that rows that repeat a page have records of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{row}')}>"


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def record(row: int, page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, leader: int | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (of the row `leader`) has no payload, but the length and digest of the one it refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if leader is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page, row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if leader is not None:
        head += [f"WARC-Refers-To: {_id(refers_to, leader)}", f"WARC-Profile: {PROFILE}"]
        head += [f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    body = payload if leader is None and payload else b""
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


class BundleWriter:
    """Writes one bundle; frames() has the compressed and plain size of each frame written."""

    def __init__(self, out):
        self.out, self.sizes, self.held, self.plain, self.at, self.start = out, [], [], 0, 0, 0
        self.total = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in its plain bytes) of a record."""
        place = (len(self.sizes), self.plain)
        self.held.append(data)
        self.plain += len(data)
        self.total += len(data)
        return place

    def flush(self) -> tuple[int, int]:
        """Close the frame: (start, size) in the file."""
        packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(self.held))
        self.out.write(packed)
        self.sizes.append((len(packed), self.plain))
        start, self.start = self.start, self.start + len(packed)
        self.held, self.plain = [], 0
        return start, len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of every frame, from a bundle's footer."""
    end = file.size()
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    file.seek(end - 9 - 8 * count)
    rows, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        rows.append((at, packed, plain))
        at += packed
    return rows


def parse(data: bytes) -> Iterator[dict]:
    """The records of a frame, with their offsets."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        body = stop + 4
        length = int(head["Content-Length"])
        end = body + length + 4
        if data[body + length : end] != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")
        number = lambda name: int(head[name]) if name in head else None
        yield {
            "offset": at,
            "length": end - at,
            "record_id": head["WARC-Record-ID"],
            "page_id": number("X-Page-ID"),
            "url": head.get("WARC-Target-URI"),
            "record_type": head["WARC-Type"],
            "payload_bytes": int(head["X-Payload-Length"]),
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": number("X-Refers-To-Page-ID"),
            "payload": data[body : body + length],
        }
        at = end


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        bundle, name, waiting, index = None, "", [], []

        def end_frame() -> None:
            start, size = bundle.flush()
            index.extend((_id(page, row), page, name, frame, start, size, offset, length) for row, page, frame, offset, length in waiting)
            waiting.clear()

        def rows() -> pa.RecordBatch:
            schema = pa.schema(
                [("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64())]
                + [(c, pa.int64()) for c in ("frame_bytes", "offset", "length")]
            )
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)], schema=schema
            )
            index.clear()
            return out

        for batch in batches:
            for row, page, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    # A name of its own for every attempt: only the index of the one that succeeds is kept
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                data = record(row, page, *rest)
                frame, offset = bundle.add(data)
                waiting.append((row, page, frame, offset, len(data)))
                if bundle.plain >= FRAME_BYTES:
                    end_frame()
                if bundle.total >= BUNDLE_BYTES:
                    if waiting:
                        end_frame()
                    bundle.close()
                    bundle = None
                    yield rows()
        if bundle is not None:
            if waiting:
                end_frame()
            bundle.close()
            yield rows()

    return run


def _reader(folder: str):
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    table = seek_table(file)
                    for start, packed, plain in (table[frame] for frame in sorted(frames)):
                        file.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                        got = list(parse(data))
                        for r in got:
                            if r["record_type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != r["payload_digest"]:
                                raise ValueError(f"payload of page {r['page_id']} is damaged")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[c] for r in got], t) for c, t in zip(names, kinds, strict=True)], names=names
                        )

    return run


def prepared(pages: DataFrame) -> DataFrame:
    """row, page_id, url, payload (null for a revisit), its bytes and SHA-1, leader and refers_to.

    Of the rows with an equal payload the leader is the one with the largest page_id (null is the
    smallest, and of equal ones the first row leads); for the others, leader and refers_to name it.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    rows = written(rows, "pages")  # row numbers are fixed from here on
    same = ["payload_digest", "payload_bytes"]
    groups = rows.where(f"payload_bytes >= {LEAST_REVISIT}").groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    # Only payloads that repeat go into the joins, which are broadcast if they are few
    groups = written(groups.where("copies > 1").drop("copies"), "payloads")
    heads = rows.select("row", "page_id", *same).join(maybe_broadcast(groups, 200_000), same).where("page_id <=> refers_to")
    groups = written(heads.groupBy(*same, "refers_to").agg(F.min("row").alias("leader")), "leaders")
    joined = rows.join(maybe_broadcast(groups, 200_000), same, "left")
    again = F.col("leader") != F.col("row")
    # The payload of a revisit is not written, so it doesn't go to the writer
    kept = F.when(F.coalesce(again, F.lit(False)), F.lit(None)).otherwise(F.col("payload"))
    leader, refers = F.when(again, F.col("leader")), F.when(again, F.col("refers_to"))
    return joined.select("row", "page_id", "url", kept.alias("payload"), *same[::-1], leader.alias("leader"), refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as bundles into folder (a URI that all executors reach) and return the index rows.

    Columns but page_id, url and html are ignored. A null html is an empty payload; a null url gives no target, a null page_id no number. Rows that
    repeat a page_id become records of their own, and an empty table gives none. A task that is run again writes
    bundles of new names; those of the attempt that failed are in no index.
    """
    return written(prepared(pages).mapInArrow(_writer(folder), INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names.

    A row for the reader is a run of a bundle's frames, found by its seek table and read by ranged
    reads; runs are dealt over as many tasks as their number asks for, whatever the size of the rows.
    """
    frames = index.select("bundle", "frame").distinct()
    runs = frames.groupBy("bundle", F.expr(f"frame div {RUN_FRAMES}")).agg(F.collect_list("frame").alias("frames")).select("bundle", "frames")
    runs = written(runs, "runs")
    tasks = max(1, runs.count() // RUNS_PER_TASK)
    return runs.repartition(tasks).mapInArrow(_reader(folder), RECORD)


def read_record(index_row, folder: str) -> dict:
    """One record by its index row: one ranged read and one frame."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{index_row['bundle']}") as file:
        file.seek(index_row["frame_start"])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(index_row["frame_bytes"]))
    at = index_row["offset"]
    return next(parse(data[at : at + index_row["length"]]))


def find_record(index: DataFrame, record_id: str, folder: str) -> dict | None:
    """The record with this identifier, or None; identifiers are unique, so one index row comes to the driver."""
    found = index.where(F.col("record_id") == record_id).take(1)
    return read_record(found[0], folder) if found else None


def archived(pages: DataFrame) -> DataFrame:
    """Write, read back, and return what the archives say of every page."""
    base = shared_dir(pages.sparkSession)
    folder = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"
    back = read_archives(write_archives(pages, folder), folder)
    return back.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
