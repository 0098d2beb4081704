"""Toxicity: a noisy-channel decoder restores disguised words, then the restored text is scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import least_hash

#: Letters of the character model; all others are word boundaries (code 0).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
A = len(LETTERS) + 1
#: Signs and the letters that they stand for in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS, WILD = " .-_~/\\,:'", "*#%"
#: Log probabilities of the channel.
SIGN, SIGN_GONE, KEEP_GAP, DROP_GAP, DROP_REPEAT, ANY = -1.0, -3.0, -0.2, -0.5, -0.7, -4.0
#: Texts held for each state. With so many, the decoder's first BEST texts are exact.
BEST = 6
#: So many wild signs in a row stand for letters; what follows them is a ruled line and only one gap.
HIDDEN = 4
NOTHING = [("", 0.0)]
#: At most so many labelled rows of each label are learnt from, those with the least hash.
ROWS_PER_LABEL = 10_000
#: Features (words and their beginnings) need so many documents of the sample: rarer ones only tell of chance.
LEAST_DOCUMENTS = 5
STEMS = range(3, 8)
HELD = 200_000
#: From more texts than this a wild sign is stepped over in arrays, and the AHEAD characters after it tell which of them
#: can't be among the best any more. Neither number changes a result.
MANY, AHEAD = 1000, 64
#: Texts under decoding are lists of pieces of this length, so that a step costs the same in a run of any length.
PIECE = 64
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”«»„…¿¡"


# --- the character model: trigram counts of all texts


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = np.zeros(0x180, np.int64)
    for c, i in CODE.items():
        code[ord(c)] = i
    total = np.zeros(A**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text:
                points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
                x = np.concatenate([[0, 0], code[np.where(points < 0x180, points, 0)], [0]])
                total += np.bincount(x[:-2] * (A * A) + x[1:-1] * A + x[2:], minlength=A**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two others, from every text of docs. A fixed number of trigrams."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_trigrams, "gram long, n long")
    rows = counts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most A**3 rows
    n = np.zeros(A**3)
    n[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy()
    n = n.reshape(A, A, A)
    two = (n.sum(0) + 0.1) / (n.sum((0, 1))[None, :].sum() / A + n.sum((0, 2))[:, None] + 0.1 * A)
    smooth = n + 5 * (two / two.sum(1, keepdims=True))[None, :, :]
    return np.log(smooth / smooth.sum(2, keepdims=True))


# --- the decoder


def _options(text: str, before: str = "") -> Iterator[list[tuple[str, float]]]:
    """The lattice: what each character may stand for after `before`, with the channel's log probability."""
    wild = len(before) - len(before.rstrip(WILD))
    before = before[-1:]
    for c in text:
        wild = wild + 1 if c in WILD else 0
        ways: list[tuple[str, float]]
        if c in CODE:
            ways = [(c, 0.0)]
        elif c in LEET:
            ways = [(x, SIGN) for x in LEET[c]] + [(" ", SIGN_GONE)]
        elif wild > HIDDEN + 1:
            ways = NOTHING
        elif c in SEPARATORS or wild > HIDDEN:
            ways = [("", DROP_GAP), (" ", KEEP_GAP)]
        elif wild:
            ways = [(x, ANY) for x in LETTERS] + [(" ", KEEP_GAP), ("", DROP_GAP)]
        else:
            ways = [(" ", 0.0)]
        if c == before and (c in CODE or c in LEET):
            ways.append(("", DROP_REPEAT))
        before = c
        yield ways


#: A text under decoding: log probability, the number of its pieces so far, and what follows them.
Held = tuple[float, int, str]


def _best(held: list[Held]) -> list[Held]:
    """The BEST different texts, each with its likeliest path."""
    paths = {(n, s): p for p, n, s in sorted(held)}
    return sorted(((p, n, s) for (n, s), p in paths.items()), reverse=True)[:BEST]


def _ahead(text: str, start: int, cube: np.ndarray) -> tuple[list[np.ndarray], float]:
    """The greatest log probabilities of what follows, by the two letters before it, at `start` and the AHEAD places after.

    Also how far two of them may be out: twice AHEAD characters are looked at, and what comes later
    tells two states apart by two letters at most.
    """
    stop = start + 2 * AHEAD
    to_end = stop >= len(text)
    u = cube[:, :, 0] if to_end else np.zeros((A, A))
    found = [u]
    for ways in reversed(list(_options(text[start:stop], text[max(0, start - HIDDEN) : start]))):
        u = np.max([cube[:, :, CODE.get(x, 0)] + cost + u[:, CODE.get(x, 0)] if x else u + cost for x, cost in ways], axis=0)
        found.append(u)
    return found[::-1][: AHEAD + 1], 0.0 if to_end else 2 * float(cube.max() - cube.min())


def _hidden(states: dict, cube: np.ndarray, ahead: np.ndarray, slack: float) -> dict:
    """The step over a wild sign from many states: for each pair of letters after it, the BEST of all ways there.

    A text goes if even its best continuation is worse than that of BEST texts of one state.
    """
    p = np.full((A, A, BEST), -np.inf)
    for (a, b), held in states.items():
        p[a, b, : len(held)] = [h[0] for h in held]
    cost = np.r_[KEEP_GAP, np.full(A - 1, ANY)]
    ways = (p.transpose(1, 0, 2)[:, None, :, :] + (cube + cost).transpose(1, 2, 0)[:, :, :, None]).reshape(A, A, A * BEST)
    top = np.argpartition(ways, -BEST, axis=2)[:, :, -BEST:]
    score = np.take_along_axis(ways, top, axis=2)
    least = (score.min(axis=2) + ahead).max() - slack - 1e-6
    after: dict[tuple[int, int], list[Held]] = {}
    for b, o, k in np.argwhere((score > -np.inf) & (score + ahead[:, :, None] >= least)).tolist():
        _, n, s = states[int(top[b, o, k]) // BEST, b][int(top[b, o, k]) % BEST]
        after.setdefault((b, o), []).append((float(score[b, o, k]), n, s + (LETTERS[o - 1] if o else " ")))
    for key, held in states.items():
        kept = [(p + DROP_GAP, n, s) for p, n, s in held if p + DROP_GAP + ahead[key] >= least]
        if kept:
            after.setdefault(key, []).extend(kept)
    return after


def decode(text: str, model: list, cube: np.ndarray) -> list[str]:
    """The BEST likeliest plain texts behind `text`, best first: exact list Viterbi over pairs of letters.

    model and cube hold the same log probabilities. A state holds its BEST texts, since signs such
    as 1 stand for letters that a trigram model alone can't always tell apart; the scorer then knows
    which of them is a word. Whatever follows, no other text of a state can be among the BEST.
    """
    states: dict[tuple[int, int], list[Held]] = {(0, 0): [(0.0, 0, "")]}
    pieces: list[tuple[int, str]] = [(0, "")]
    number: dict[tuple[int, str], int] = {}
    seen, ahead, slack = 0, [], 0.0
    for i, ways in enumerate(_options(text)):
        if ways is NOTHING:
            continue
        if len(ways) > A and sum(map(len, states.values())) > MANY:
            if i + 1 - seen >= len(ahead):
                seen = i + 1
                ahead, slack = _ahead(text, seen, cube)
            after = _hidden(states, cube, ahead[i + 1 - seen], slack)
        else:
            after = {}
            for (a, b), held in states.items():
                row = model[a][b]
                for letter, cost in ways:
                    if letter:
                        o = CODE.get(letter, 0)
                        cost += row[o]
                        after.setdefault((b, o), []).extend([(p + cost, n, s + letter) for p, n, s in held])
                    else:
                        after.setdefault((a, b), []).extend([(p + cost, n, s) for p, n, s in held])
        if i + 1 >= PIECE:  # every text is cut at the same lengths, so equal texts have equal numbers
            for key, held in after.items():
                for j, (p, n, s) in enumerate(held):
                    if len(s) == PIECE:
                        at = number.setdefault((n, s), len(pieces))
                        if at == len(pieces):
                            pieces.append((n, s))
                        held[j] = (p, at, "")
        for key, held in after.items():
            if len(held) > BEST:
                after[key] = _best(held)
        states = after
    out = []
    for _, n, s in _best([(p + model[a][b][0], n, s) for (a, b), held in states.items() for p, n, s in held]):
        parts = [s]
        while n:
            n, s = pieces[n]
            parts.append(s)
        out.append("".join(reversed(parts)))
    return out


#: Signs and gaps share no character, so that a ruled line is read once.
SPACED = re.compile(r"(?<!\S)(?:[^\s.\-_][ .\-_]{1,2}){2,}[^\s.\-_](?!\S)")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SIGNS = re.compile(r"[$@!|(€£¡]")
PIECES = re.compile(r"[^\W\d_]+")


class Restorer:
    """Words of texts, with disguised ones restored. A word whose lattice has one path stands for itself."""

    def __init__(self, model: np.ndarray):
        self.model, self.cube, self.held = model.tolist(), model, {}

    def restore(self, token: str) -> list[str]:
        found = self.held.get(token)
        if found is None:
            if len(self.held) >= HELD:
                self.held.clear()
            found = self._restore(token)
            if len(token) <= 64:
                self.held[token] = found
        return found

    def _restore(self, token: str) -> list[str]:
        letters = sum(c in CODE for c in token)
        if not letters and not any(c in "@$!" for c in token):
            return []
        pieces = PIECES.findall(token)
        plain = re.sub(r"[-./\\,:;'_~]+", " ", token).split()
        if all(p.isalpha() and len(p) > 1 for p in plain) and not REPEATED.search(token):
            return pieces
        # pieces too, so that a plain word beside signs still counts
        return list(dict.fromkeys(self._decoded(token) + [p for p in pieces if len(p) > 2]))

    def _decoded(self, token: str) -> list[str]:
        """Words of the likeliest plain texts of a run."""
        return list(dict.fromkeys(w for s in decode(token, self.model, self.cube) for w in s.split()))

    def words(self, text: str) -> list[str]:
        text = text.lower()
        out = []
        doubtful = REPEATED.search(text) is not None
        for token in text.split():
            word = token.strip(EDGES)
            if word.isalpha() and not (doubtful and REPEATED.search(word)):
                out.append(word)
                if len(token) > len(word) and SIGNS.search(token.rstrip(".,;:!?")):
                    out += self.restore(token)
            elif word:
                out += self.restore(token.strip(".,;:?\"'()[]{}") or token)
        for run in SPACED.findall(text):
            out += self.restore(run)
        return out


# --- scoring


def features(word: str) -> list[str]:
    """A word and its beginnings, which tell families of words with different endings."""
    return [word, *(word[:n] + "~" for n in STEMS if n < len(word))]


@dataclass
class Model:
    """Log odds of features, and a logistic regression on a document's strongest ones."""

    letters: np.ndarray
    odds: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.0

    def summary(self, words: list[str], held: dict[str, float]) -> np.ndarray:
        """The greatest log odds, the mean of the three greatest, and how many words are strong."""
        best: list[float] = []
        strong = 0
        odds = self.odds.get
        for w in set(words):
            z = held.get(w)
            if z is None:
                if len(held) >= HELD:
                    held.clear()
                z = held[w] = max(odds(f, 0.0) for f in features(w))
            if z > 1.0:
                best.append(z)
                strong += 1
        best = sorted(best, reverse=True)[:3] + [0.0] * 3
        return np.array([1.0, best[0] / 5, sum(best[:3]) / 15, math.log1p(strong)])


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            names, labels = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in set(restorer.words(text or "")) for f in features(w)}
                names += found
                labels += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(labels, pa.int32())], names=["f", "toxic"])

    return run


def _summaries(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer, held = Restorer(model.letters), {}
        for batch in batches:
            rows = [model.summary(restorer.words(t), held).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + ridge * len(y) * 0.1 * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); rows without a label only shape the characters.

    The character model counts all texts. Labels come from a sample with a bound for each label; half
    of it gives the log odds of features, the other half the regression. Without both labels every
    text scores the share of toxic rows.
    """
    spark = docs.sparkSession
    letters = character_model(docs)
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = least_hash(labels, "toxic", "doc_id", ROWS_PER_LABEL)
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # chosen has at most ROWS_PER_LABEL rows for each of two labels
    sample = sample.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("text", "toxic", half)

    counted = sample.where("half = 0").select("text", "toxic").mapInArrow(_count(spark.sparkContext.broadcast(letters)), "f string, toxic int")
    counted = counted.groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    sizes = {r["toxic"]: r["n"] for r in sample.where("half = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(letters, {}, prior=share)
    odds = F.log((F.col("k") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("n") - F.col("k") + 0.5) / (sizes[0] + 1.0))
    kept = counted.where(f"n >= {LEAST_DOCUMENTS}").withColumn("z", odds).where("z > 1")
    table = kept.select("f", "z").toPandas()  # of the bounded sample
    model = Model(letters, dict(zip(table["f"], table["z"], strict=True)))

    shared = spark.sparkContext.broadcast(model)
    rows = sample.where("half = 1").select("text", "toxic").mapInArrow(_summaries(shared), "x array<double>, toxic int").toPandas()
    x, y = np.array(rows["x"].tolist()), rows["toxic"].to_numpy(np.float64)
    if len(y):
        model.weights = regression(x, y)
        model.prior = -1.0
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer, held = Restorer(model.letters), {}
        for batch in batches:
            scores = []
            for text in batch.column(1):
                text = text.as_py()
                if model.prior >= 0:
                    scores.append(model.prior)
                    continue
                z = float(model.summary(restorer.words(text or ""), held) @ model.weights)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model, row: Column | None = None) -> DataFrame:
    """row (all columns of docs, or those given) and score of every whole text; a null text is empty."""
    row = F.struct(*docs.columns) if row is None else row
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"row {kind}, score double")


def toxicity_of(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of rows whose crc32 of doc_id modulo 4 is 2 are never read.

    Rows that repeat a doc_id are scored each by their own text; a null text counts as empty; a null
    doc_id is not held out and not learnt from; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    remainder = "pmod(crc32(cast(cast({} as string) as binary)), 4)"
    model = fit(docs, labels.where(remainder.format("doc_id") + " <> 2"))
    scored = score(docs, model, F.struct("doc_id"))
    return scored.select(
        "row.doc_id",
        F.expr(f"coalesce({remainder.format('row.doc_id')} = 2, false)").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
