"""Repair of conversations: one sorted stream for each conversation, a dynamic programme over role initials.

Rows are dealt by conversation and sorted by turn, the last first. A stream of Arrow batches carries the
cost of the cheapest repair of all rows read so far for each state of the role pattern, and leaves two
bytes a row that say how the repair begins there. At a conversation's first row they are followed
forward. A long conversation's bytes are given out in pieces; a second stream, in the order of turns,
follows them and hashes the repaired rows as they pass, so no conversation is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import maybe_broadcast, small_enough, written

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and characters of a conversation that are held; rows whose choices make one spilled piece.
HELD_ROWS, HELD_CHARS, PIECE_ROWS = 20_000, 4_000_000, 50_000
#: What is no white space (20, 09 to 0D), at a place in a regular expression.
SOLID = r"[^\x20\x09-\x0D]"
#: After nothing, after s, after u, after a: what each initial leads to (None: not allowed), what may be put there.
STEPS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
FAR = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows after damage by the checksum of `conv_id:turn`; dropped rows stay, marked.

    Nulls count as one space, but for the turn itself, which stays null, and conv_id.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("damage")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind)
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    # a dropped row carries nothing but its conversation
    gone = F.col("damage") == 0
    rows = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"),
        gone.alias("dropped"), F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def faults(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds fault (blank, duplicate, truncated or null) to rows dealt by conversation, and sorts each from its last row to its first.

    Order: turn, nulls first, then role, then text; of equal rows the repeats come after the first. A duplicate has an
    earlier row of its role and text, whatever that row's own fault.
    """
    dealt = rows.repartition(*([partitions] if partitions else []), "conv_id")
    # The same dealing serves both orders: each only sorts, and spills if it must
    same = Window.partitionBy("conv_id", "dropped", F.xxhash64("role", "text"), "role", "text").orderBy(F.asc_nulls_first("turn"))
    seen = dealt.withColumn("seen", F.row_number().over(same) > 1)
    last = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(SOLID), "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    )
    found = seen.select("conv_id", "turn", "role", "text", "dropped", "seen", F.when(~F.col("dropped"), fault).alias("fault"))
    return found.sortWithinPartitions(F.asc("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("seen")).drop("seen")


class Programme:
    """The cheapest repair of the rows from here to the last, for each state, and the choices that lead there.

    A choice is a nibble: 0 end, 1 delete, 2 insert, 3 keep, 4 rerole, in the order of the letters, so ties take the
    least. Two bytes hold the four states' choices.
    """

    LETTERS = (ord("?"), ord("D"), ord("I"), ord("K"), ord("R"))

    def __init__(self):
        self.cost = self._inserted([0 if s in ENDS else FAR for s in range(4)], [0, 0, 0, 0])
        self.at_end = self.choice

    def _inserted(self, cost: list[int], choice: list[int]) -> list[int]:
        """Lets each state also begin with insertions; two reach every state that any number does."""
        for _ in range(2):
            for s in range(4):
                via = cost[STEPS[s][PUT[s]]] + INSERT
                if via < cost[s] or (via == cost[s] and choice[s] > 2):
                    cost[s], choice[s] = via, 2
        self.choice = choice[0] | choice[1] << 4 | choice[2] << 8 | choice[3] << 12
        return cost

    def push(self, initial: str, fault: str | None) -> int:
        """Puts a row before those pushed so far."""
        after, cost, choice = self.cost, [], []
        extra = TRUNCATED if fault == "truncated" else 0
        stays = fault is None or fault == "truncated"
        for s in range(4):
            best, how = after[s] + DELETE, 1
            if stays:
                to = STEPS[s].get(initial)
                if to is not None and after[to] + extra < best:
                    best, how = after[to] + extra, 3
                if (c := after[STEPS[s][PUT[s]]] + extra + REROLE) < best:
                    best, how = c, 4
            cost.append(best)
            choice.append(how)
        self.cost = self._inserted(cost, choice)
        return self.choice


class Walk:
    """Follows choices forward and hashes the repaired rows."""

    def __init__(self):
        self.state, self.audit, self.digest, self.any = 0, bytearray(), hashlib.sha256(), False

    def _row(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if not self.any else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _edit(self, choice: int) -> int:
        how = choice >> (4 * self.state) & 15
        if how:
            self.audit.append(Programme.LETTERS[how])
        return how

    def step(self, choice: int, role: str, text: str) -> None:
        while (how := self._edit(choice)) == 2:
            self._put()
        if how == 3:
            self._row(role, text)
            self.state = STEPS[self.state][role[:1]]
        elif how == 4:
            put = PUT[self.state]
            self._row(ROLE[put], text)
            self.state = STEPS[self.state][put]

    def _put(self) -> None:
        put = PUT[self.state]
        self._row(ROLE[put], "")
        self.state = STEPS[self.state][put]

    def end(self, choice: int) -> tuple[str, str]:
        while self._edit(choice) == 2:
            self._put()
        return self.audit.decode(), self.digest.hexdigest()


class Conversation:
    """What is known of a conversation while its rows come in, the last first."""

    def __init__(self, conv_id: int | None, held_rows: int, piece_rows: int):
        self.conv_id, self.held_rows, self.piece_rows, self.n = conv_id, held_rows, piece_rows, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.programme, self.choices = Programme(), bytearray()
        self.rows: list[tuple[str, str]] | None = []
        self.chars = self.illegal = self.turns = self.pieces = 0
        self.next = self.high = self.low = None

    def push(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        self.n += 1
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.next is not None and initial + self.next not in ("su", "ua", "au"):
            self.illegal += 1
        self.next = initial
        if turn is not None and turn != self.low:
            self.high = turn if self.high is None else self.high
            self.low, self.turns = turn, self.turns + 1
        self.choices += self.programme.push(initial, fault).to_bytes(2, "little")
        if self.rows is not None:
            self.rows.append((role, text))
            self.chars += len(text)
            if self.n > self.held_rows or self.chars > HELD_CHARS:
                self.rows = None

    def spilled(self) -> dict | None:
        """Choices of the rows read last, once there are piece_rows of them."""
        if self.rows is None and len(self.choices) >= 2 * self.piece_rows:
            return self._piece()
        return None

    def _piece(self) -> dict:
        piece = {"conv_id": self.conv_id, "to_row": self.n, "choices": bytes(self.choices)}
        self.choices = bytearray()
        return piece

    def finished(self) -> Iterator[dict]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        out = {"conv_id": self.conv_id, "n": self.n, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.programme.cost[0]}
        if self.rows is not None:
            walk = Walk()
            for at in range(self.n - 1, -1, -1):
                walk.step(int.from_bytes(self.choices[2 * at : 2 * at + 2], "little"), *self.rows[at])
            out["audit"], out["repaired_sha256"] = walk.end(Programme().at_end)
        elif self.choices:
            yield self._piece()
        yield out


FOUND = pa.schema(
    [("conv_id", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("to_row", pa.int64()), ("choices", pa.binary())]
)
FOUND_SQL = "conv_id long, n long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, to_row long, choices binary"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _backward(held_rows: int, piece_rows: int):
    """Finished conversations, and pieces of choices of long ones; a conversation goes on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.extend(now.finished())
                    now = Conversation(conv_id, held_rows, piece_rows)
                if not dropped:
                    now.push(turn, role, text, fault)
                    if (piece := now.spilled()) is not None:
                        out.append(piece)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=FOUND)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(now.finished()), schema=FOUND)

    return run


WALKED = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the choices of long conversations: a piece of them comes before the rows it is for."""
    walk, conv_id, piece, at, started = Walk(), None, b"", 0, False
    end = Programme().at_end

    def done() -> pa.RecordBatch:
        audit, digest = walk.end(end)
        return pa.RecordBatch.from_pylist([{"conv_id": conv_id, "audit": audit, "repaired_sha256": digest}], schema=WALKED)

    for batch in batches:
        for conv, role, text, choices in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "choices")), strict=True):
            if started and conv != conv_id:
                yield done()
                walk = Walk()
            conv_id, started = conv, True
            if choices is not None:
                piece, at = choices, len(choices)
            else:
                at -= 2
                walk.step(int.from_bytes(piece[at : at + 2], "little"), role, text)
    if started:
        yield done()


def _walked(found: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, audit and digest of the conversations whose choices were given out in pieces."""
    pieces = found.where("choices is not null")
    long = written(pieces.select(F.col("conv_id").alias("of")).distinct(), "long")
    kept = rows.where("not dropped").join(maybe_broadcast(long, 100_000), F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("turn"), F.desc("role"), F.desc("text")))
    kept = kept.select("conv_id", "role", "text", number.cast("long").alias("to_row"), F.lit(None).cast("binary").alias("choices"), F.lit(1).alias("kind"))
    parts = pieces.select("conv_id", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "to_row", "choices", F.lit(0).alias("kind"))
    both = kept.union(parts).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("to_row"), "kind")
    return both.mapInArrow(_forward, "conv_id long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, held_rows: int = HELD_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of damaged rows.

    rows: conv_id, turn, role, text and dropped (see damaged); other columns are ignored. Rows are taken by turn, nulls
    first, ties by role and text. Each row's first fault counts: blank, duplicate, truncated. The audit holds the initials
    of the cheapest edits that give role initials (s?(ua)+)?, of several the least in ASCII order; the digest is that of
    the repaired rows, `role:text` joined by line breaks. A conversation all of whose rows are dropped has zeros and
    empty ones; rows without conv_id are one conversation; an empty table gives no rows.

    A conversation is one stream in one task, for its digest can't be put together from parts; memory doesn't grow with it
    but for the audit, which is a cell of the result. Conversations of up to held_rows rows are finished in one stream.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "dropped")
    found = written(faults(rows).mapInArrow(_backward(held_rows, piece_rows), FOUND_SQL), "repairs")
    done = found.where("n is not null")
    if not small_enough(found.where("choices is not null"), 0):
        walked = _walked(found, rows).toDF("of", "long_audit", "long_digest")
        done = done.join(walked, F.col("conv_id").eqNullSafe(F.col("of")), "left")
        done = done.withColumns({"audit": F.coalesce("audit", "long_audit"), "repaired_sha256": F.coalesce("repaired_sha256", "long_digest")})
    return done.select("conv_id", *COUNTS, "audit", "repaired_sha256")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations))
