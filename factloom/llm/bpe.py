"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import U64, mix64

#: Pre-tokens whose ids a worker holds, twice over at most; none longer than LONGEST_HELD characters.
HELD, LONGEST_HELD = 120_000, 64
#: Bytes of text that are encoded at once.
PIECE = 1 << 20


MASK = (1 << 64) - 1


@dataclass
class PerfectHash:
    """A minimal perfect hash over byte strings: n keys fill n slots; other strings hit some slot too."""

    shift: np.ndarray
    n: int

    def __post_init__(self):
        self.steps = (self.shift.astype(U64) * U64(0x9E3779B97F4A7C15)).tolist()

    @staticmethod
    def _slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (mix64(h + shift.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """Displace bucket by bucket, largest first, until each falls on free slots."""
        n = len(hashes)
        buckets = max(1, n // 4)
        bucket = ((hashes >> U64(32)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(starts)
        shift, used = np.zeros(buckets, np.int64), np.zeros(n, bool)
        tries = np.arange(4096, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            keys = hashes[order[starts[b] : starts[b + 1]]]
            first = 0
            while True:
                ahead = tries[: 64 if not first else None] + first
                at = cls._slots(keys[None, :], ahead[:, None], n)
                ok = ~used[at].any(axis=1)
                if len(keys) > 1:
                    ok &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if ok.any():
                    i = int(ok.argmax())
                    shift[b] = ahead[i]
                    used[at[i]] = True
                    break
                first = int(ahead[-1]) + 1
        return cls(shift, n)

    def slot(self, h: int) -> int:
        """slots() of a single hash."""
        x = h + self.steps[(h >> 32) % len(self.steps)] & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        return (x ^ x >> 31) % self.n

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        bucket = ((hashes >> U64(32)) % U64(len(self.shift))).astype(np.int64)
        return self._slots(hashes, self.shift[bucket], self.n)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), U64, len(keys))


class Held(dict):
    """Codes of pre-tokens seen of late: two generations of bounded size, the older one dropped in turn."""

    def __init__(self, code):
        super().__init__()
        self.code, self.older = code, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= HELD:
            self.older = dict(self)
            self.clear()
        found = self.older.get(part)
        if found is None:
            found = self.code(part)
        if len(part) <= LONGEST_HELD:
            self[part] = found
        return found


class Tokenizer:
    """Ranks of byte strings and the pattern that splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        h = _hashes(keys)
        self.table = PerfectHash.build(h)
        self.slot_key: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.table.slots(h), strict=True):
            self.slot_key[slot] = key
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for key, rank in ranks.items():
            self.bytes_of[rank] = key
        self._prepare()

    def _prepare(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.held = Held(self.coded)
        plain = self.pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        plain = plain.replace("A-Za-z+", "[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
        space = r"[\t-\r ]"
        self.split_ascii = re.compile(plain.replace(r"[^\s", r"[^\t-\r ").replace(r"\S", r"[^\t-\r ]").replace(r"\s", space)).findall

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ranks", "pattern", "table", "slot_key", "bytes_of")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Tokenizer:
        """Read a rank file: base64 of the bytes, a blank, the rank; one to a line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(k): int(r) for k, r in (line.split() for line in lines if line.strip())}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token itself: merge the lowest-ranked neighbours, leftmost first.

        The parts are linked by their ends and starts; a heap holds rank, start and end of each
        mergeable pair, packed into one integer, and entries of parts merged since are passed over.
        """
        rank, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        n = len(piece)
        wide = n.bit_length()
        high, mask = 2 * wide, (1 << wide) - 1
        end = list(range(1, n + 1))  # where the part that starts here ends and the next one starts; 0: merged
        back = list(range(-1, n))
        heap = [r << high | i << wide | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, stop = top >> wide & mask, top & mask
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                back[stop] = i
                after = end[stop]
                if (r := rank(piece[i:after])) is not None:
                    push(heap, r << high | i << wide | after)
            before = back[i]
            if before >= 0 and (r := rank(piece[before:stop])) is not None:
                push(heap, r << high | before << wide | stop)
        ids, i = [], 0
        while i < n:
            ids.append(rank(piece[i : end[i]]))
            i = end[i]
        return ids

    def coded(self, part: str) -> bytes:
        """The ids of one pre-token: by the perfect hash if it is a token, else by merging."""
        piece = part.encode("utf-8", "surrogatepass")
        if self.slot_key[self.table.slot(xxhash.xxh3_64_intdigest(piece))] == piece:
            return self.ranks[piece].to_bytes(4, "little")
        return array("i", self.merged(piece)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers one after another."""
        parts = (self.split_ascii if text.isascii() else self.split)(text)
        return b"".join(map(self.held.__getitem__, parts))

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        shift = np.cumsum(n) - n
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.start[ids] - shift, n)].tobytes()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in pieces of about PIECE bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first] - size[first]
        stop = max(first + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for piece in (p for batch in batches for p in _pieces(batch)):  # ids of a whole batch would take several times its room
            coded = [tokenizer.encode(t.as_py() or "") for t in piece.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(coded), np.int32))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["row", "ids"]
            )

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            ids = batch.column(1)
            flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            offsets = offsets - offsets[0]
            back = [tokenizer.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(back, pa.binary())], names=["row", "ids", "decoded"]
            )

    return run


def encode(docs: DataFrame, tokenizer: Tokenizer, row: Column | None = None) -> DataFrame:
    """row (all columns of docs, or those given) and ids of every row's whole text; null is empty.

    Each match of the pattern is encoded by itself, without special tokens. Repeated rows are
    encoded alike; an empty table gives no rows. The tokenizer is of fixed size and is broadcast.
    """
    row = F.struct(*docs.columns) if row is None else row
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    return rows.mapInArrow(_encode(shared), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """row, ids and decoded (the bytes that the ids stand for) of what encode() returns."""
    kind = coded.schema["row"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(tokenizer)
    return coded.mapInArrow(_decode(shared), f"row {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    coded = encode(docs.select("doc_id", "text"), tokenizer, F.struct("doc_id"))
    return decode(coded, tokenizer).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
