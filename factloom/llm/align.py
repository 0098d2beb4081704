"""Two tokenisations of the same texts, aligned by byte ranges: anchors, windows, memoised alignments.

Both tokenisers encode the whole text. Where tokens of both end at one byte and both next tokens are
marked by a space, the text is cut: what lies between two such anchors is a window, given by its ids
alone, and windows come back often. A window's groups and links are remembered by its tuples of ids. Counts of linked ids are then summed over the corpus and joined back to the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm.common import U64, maybe_broadcast, mix64, written

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Window alignments of a generation, of which a worker remembers two, and bytes of A ids of a window that is remembered.
REMEMBERED, LONGEST_REMEMBERED = 150_000, 400
#: Characters of text that are worked on together.
TOGETHER = 2_000_000
#: Pairs of ids whose counts are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 2_000_000
LONGEST_REMEMBERED = 200
SPACE = "▁"


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """The tokens' bytes and lengths of a vocabulary, which of them begin with a space, and their ids as text before each mark."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.named = {mark: np.array([f"{i}{mark}" for i in range(len(tokens))], object) for mark in ",|;"}

    def gives(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == raw


class ByteSide(Side):
    """A byte-level vocabulary file. Its entries' ranks go to a faster encoder of the same merges; texts that it can't do go to the file's own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as held:
            said = json.load(held)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        special = {t["id"] for t in said["added_tokens"]}
        code = byte_level()
        vocabulary = {i: bytes(code[c] for c in t) for t, i in said["model"]["vocab"].items() if i not in special}
        super().__init__([vocabulary.get(i, b"") for i in range(max([*vocabulary, *special]) + 1)])
        ranks = {t: i for i, t in vocabulary.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The ids of a space and the text."""
        try:
            return self.fast.encode_ordinary(" " + text)
        except BaseException as failed:  # the encoder's regex engine may give up on very long runs of white space
            if isinstance(failed, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self.whole.encode(" " + text, add_special_tokens=False).ids


class PieceSide(Side):
    """A piece vocabulary with byte fallback, which puts a space before each text."""

    def __init__(self, path: str):
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        super().__init__([bytes([int(p[1:-1], 16)]) if self.whole.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(named)])

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class Aligner:
    """Aligns windows of token ids and remembers them by their ids."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.width = a, b, len(b.tokens)
        self.kind = np.int32 if len(a.tokens) * self.width < 1 << 31 else np.int64
        self.held: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}
        self.older = self.held

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> list[tuple[str, bytes]]:
        """For each of the windows that stand one after another: its groups as text, its links as pair codes a * width + b."""
        end_a, end_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        # Every stretch between two ends of either side lies in one token of each: a link
        ends = np.union1d(end_a, end_b)
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = (ids_a[of_a].astype(self.kind) * self.width + ids_b[of_b]).astype(self.kind)
        met = (end_a[of_a] == ends) & (end_b[of_b] == ends)
        last_a, last_b = of_a[met], of_b[met]
        text_a, text_b = self.a.named[","][ids_a], self.b.named[","][ids_b]
        text_a[last_a], text_b[last_b] = self.a.named["|"][ids_a[last_a]], self.b.named[";"][ids_b[last_b]]
        # A group's A tokens come before its B tokens
        texts = np.empty(len(ids_a) + len(ids_b), object)
        group_a, group_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        start = np.cumsum(group_a + group_b) - group_a - group_b
        texts[spread(start, group_a)] = text_a
        texts[spread(start + group_a, group_b)] = text_b
        texts = texts.tolist()
        stop_a = np.cumsum(size_a)
        stops = (stop_a + np.cumsum(size_b)).tolist()
        link_stops = ((np.searchsorted(ends, end_a[stop_a - 1]) + 1) * pairs.itemsize).tolist()
        raw, said, i, p = pairs.tobytes(), [], 0, 0
        for j, q in zip(stops, link_stops, strict=True):
            said.append(("".join(texts[i:j])[:-1], raw[p:q]))
            i, p = j, q
        return said

    def windows(self, flat_a: np.ndarray, flat_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[list, np.ndarray]:
        """The different windows' alignments, and which of them stands at each place; cut_*: where windows begin, and the end.

        Windows are told apart by a hash of their ids, which are then compared; alignments are looked up by the ids
        themselves, and those not yet known are worked out together.
        """
        total, places = np.zeros(len(cut_a) - 1, U64), []
        for flat, cut in ((flat_a, cut_a), (flat_b, cut_b)):
            place = np.arange(len(flat)) - np.repeat(cut[:-1], np.diff(cut))
            places.append(place)
            total = mix64(total) + np.add.reduceat(mix64(flat.astype(U64) + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)), cut[:-1])
        _, first, which = np.unique(total, return_index=True, return_inverse=True)
        # Windows of one hash must have the same ids; any that differ stand for themselves
        alike = np.ones(len(total), bool)
        model = first[which]
        for flat, cut, place in ((flat_a, cut_a, places[0]), (flat_b, cut_b, places[1])):
            size = np.diff(cut)
            alike &= size[model] == size
            other = np.minimum(np.repeat(cut[:-1][model], size) + place, len(flat) - 1)
            alike &= np.logical_and.reduceat(flat[other] == flat, cut[:-1])
        odd = np.flatnonzero(~alike)
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])

        if len(self.held) >= REMEMBERED:
            self.older, self.held = self.held, {}
        raw_a, raw_b = flat_a.tobytes(), flat_b.tobytes()
        bounds = ((4 * cut[first + k]).tolist() for cut in (cut_a, cut_b) for k in (0, 1))
        keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(*bounds, strict=True)]
        held, older = self.held, self.older
        found = [held.get(k) or older.get(k) for k in keys]
        new = np.array([k for k, f in enumerate(found) if f is None], np.int64)
        if len(new):
            sizes = [np.diff(cut)[first[new]] for cut in (cut_a, cut_b)]
            ids = [flat[spread(cut[first[new]], size)] for flat, cut, size in zip((flat_a, flat_b), (cut_a, cut_b), sizes, strict=True)]
            for k, alignment in zip(new.tolist(), self.align(*ids, *sizes), strict=True):
                found[k] = alignment
        for key, alignment in zip(keys, found, strict=True):
            if len(key[0]) <= LONGEST_REMEMBERED:
                held[key] = alignment
        return found, which

    def aligned(self, texts: list[str]) -> tuple[list, ...]:
        """For each text: n_a, n_b, n_groups, groups as text, different pair codes, and how often each is linked."""
        n = len(texts)
        n_a, n_b, n_groups, said = [0] * n, [0] * n, [0] * n, [""] * n
        codes, times = [np.empty(0, self.kind)] * n, [np.empty(0, np.int64)] * n
        good, every_a, every_b = [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            raw, ids_a, ids_b = b" " + text.encode("utf-8", "surrogatepass"), self.a.encode(text), self.b.encode(text)
            if self.a.gives(ids_a, raw) and self.b.gives(ids_b, raw):
                good.append(k)
                every_a.append(np.array(ids_a, np.int32))
                every_b.append(np.array(ids_b, np.int32))
        if not good:
            return n_a, n_b, n_groups, said, codes, times
        size_a, size_b = np.array([len(x) for x in every_a]), np.array([len(x) for x in every_b])
        flat_a, flat_b = np.concatenate(every_a), np.concatenate(every_b)
        end_a, end_b = np.cumsum(self.a.lengths[flat_a]), np.cumsum(self.b.lengths[flat_b])
        meets = np.searchsorted(end_b, end_a)
        shared = np.flatnonzero(end_b[meets] == end_a)
        shared_b = meets[shared]
        last = np.cumsum(size_a) - 1
        anchor = np.append(self.a.spaced[flat_a], True)[shared + 1] & np.append(self.b.spaced[flat_b], True)[shared_b + 1]
        anchor[np.searchsorted(shared, last)] = True
        cut_a = np.concatenate([[0], shared[anchor] + 1])
        cut_b = np.concatenate([[0], shared_b[anchor] + 1])
        found, which = self.windows(flat_a, flat_b, cut_a, cut_b)

        # Windows and groups of each text; then the links of its different windows, times how often they stand in it
        bounds = np.concatenate([[0], np.searchsorted(cut_a[1:], last + 1) + 1])
        groups = np.diff(np.searchsorted(shared, last) + 1, prepend=0)
        text_of = np.repeat(np.arange(len(good)), np.diff(bounds))
        met, often = np.unique(text_of * len(found) + which, return_counts=True)
        held = np.frombuffer(b"".join([f[1] for f in found]), self.kind)
        links = np.array([len(f[1]) for f in found]) // held.itemsize
        start = np.cumsum(links) - links
        owner, window = met // len(found), met % len(found)
        size = links[window]
        pair = held[spread(start[window], size)].astype(np.int64)
        text_of, weight = np.repeat(owner, size), np.repeat(often, size)
        order = np.lexsort((pair, text_of)) if self.kind is np.int64 else np.argsort(text_of << 31 | pair)
        pair, text_of, weight = pair[order], text_of[order], weight[order]
        fresh = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text_of[1:] != text_of[:-1])]))
        summed, code = np.add.reduceat(weight, fresh), pair[fresh].astype(self.kind)
        ends = np.searchsorted(text_of[fresh], np.arange(len(good) + 1)).tolist()
        pieces, which = [f[0] for f in found], which.tolist()
        for at, k in enumerate(good):
            n_a[k], n_b[k], n_groups[k] = int(size_a[at]), int(size_b[at]), int(groups[at])
            said[k] = ";".join([pieces[w] for w in which[bounds[at] : bounds[at + 1]]])
            codes[k], times[k] = code[ends[at] : ends[at + 1]], summed[ends[at] : ends[at + 1]]
        return n_a, n_b, n_groups, said, codes, times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(ByteSide(path_a), PieceSide(path_b))


def _runs(texts: list[str]) -> Iterator[slice]:
    """Texts that are worked on together: about TOGETHER characters, one text at least."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > TOGETHER:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _aligned(path_a: str, path_b: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for part in _runs(texts):
                n_a, n_b, n_groups, said, codes, times = work.aligned(texts[part])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in codes])]), pa.int32())
                columns = {
                    "row": pa.array(range(row, row + len(n_a)), pa.int64()),
                    "doc_id": ids[part],
                    "n_a": pa.array(n_a, pa.int64()),
                    "n_b": pa.array(n_b, pa.int64()),
                    "n_groups": pa.array(n_groups, pa.int64()),
                    "groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said], pa.string()),
                    "pairs": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(codes))),
                    "times": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times))),
                }
                if keep_groups:
                    columns["groups"] = pa.array(said, pa.string())
                row += len(n_a)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def alignments(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times and, if wanted, groups of every row of docs.

    docs: doc_id (long) and text; other columns are ignored. path_a: a byte-level vocabulary file, which gets a space and
    the text; path_b: a piece model, which puts the space itself. Special tokens' strings are plain text. A group is
    written a1,a2|b1 and groups are joined by ;. pairs are the different linked ids as a * (ids of b) + b, times says how
    often each is linked. A text that is null, empty, or that the tokens of either side don't give back byte for byte has
    no tokens: zeros, an empty digest, no pairs. row is unique; rows that repeat a doc_id, or lack one, are aligned each.
    """
    most = aligner(path_a, path_b)
    kind = "int" if most.kind is np.int32 else "long"
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<{kind}>, times array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_aligned(path_a, path_b, keep_groups), schema + (", groups string" if keep_groups else ""))


def links(found: DataFrame) -> DataFrame:
    """row, pair, times: the linked ids of every row of alignments()."""
    return found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times").toDF("row", "pair", "times")


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """pair, count, best: how many links of the corpus hold a pair, and whether no pair of its B id has more."""
    counts = written(linked.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    top = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("top"))
    held = counts.withColumn("b", F.col("pair") % width).join(maybe_broadcast(top, 200_000), "b")
    return held.select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (see alignments).

    n_links: pairs of an A and a B token whose byte ranges overlap; count_sum: the corpus-wide counts of their pairs of
    ids, summed; n_best: links whose count is the highest of their B id, ties included. An empty table gives no rows.
    Texts are tokenised once; the pairs of each row are written, counted with partial sums, and joined with the counts,
    which are broadcast if there are no more than BROADCAST_PAIRS of them.
    """
    path_a, path_b = path_a or public_tokenizers.path(BYTE_BPE), path_b or public_tokenizers.path(PIECES)
    found = written(alignments(docs, path_a, path_b, keep_groups=False), "alignments")
    linked = links(found)
    counts = written(pair_counts(linked, aligner(path_a, path_b).width), "counts")
    counts = maybe_broadcast(counts, BROADCAST_PAIRS)
    sums = linked.join(counts, "pair").groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    rows = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
