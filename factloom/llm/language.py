"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import least_hash

#: The model is fitted on at most so many labelled rows of a language, those with the least hash.
ROWS_PER_LANGUAGE = 2000
LONGEST = 4
#: Words whose rows a worker holds before it starts afresh.
HELD = 100_000
#: Words of evidence at which the score stops sharpening.
FULL_EVIDENCE = 25
UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hashes(parts: list[str]) -> np.ndarray:
    """As xxhash64() of Spark gives them."""
    return np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 42) for p in parts), np.uint64, len(parts)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, part, k: the words and n-grams of texts; a part begins with its length in characters, 0 for words."""
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, words in seen.items():
            parts = Counter({f"0{w}": k for w, k in words.items()})
            for word, k in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        parts[f"{n}{g}"] += k
            columns = [pa.array([lang] * len(parts), pa.string()), pa.array(parts.keys(), pa.string()), pa.array(parts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "part", "k"])


@dataclass
class Model:
    """Log frequencies by language of all words (level 0) and n-grams of the sample, a row for each.

    Rows are found by the sorted hashes of their parts, so that the whole vocabulary is two arrays
    and takes some 30 bytes an entry in every worker.
    """

    languages: list[str]
    keys: np.ndarray
    table: np.ndarray

    def rows(self, parts: list[str]) -> np.ndarray:
        """The row of each part, or -1."""
        if not len(self.keys) or not parts:
            return np.full(len(parts), -1)
        wanted = hashes(parts)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def backed_off(self, words: list[str]) -> np.ndarray:
        """For each unseen word the mean over its longest n-grams that the model knows; else nothing."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            found = [[f"{n}{g}" for g in grams(words[i], n)] for i in left]
            owner = np.repeat(left, [len(f) for f in found])
            rows = self.rows([g for f in found for g in f])
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            number = np.bincount(owner, minlength=len(words))
            for at in range(out.shape[1]):
                out[:, at] += np.bincount(owner, self.table[rows, at], minlength=len(words)) / np.maximum(number, 1)
            left = left[number[left] == 0]
            if not len(left):
                break
        return out


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on docs with text and lang; others are passed over.

    The rows learnt from are bounded by a parameter, whatever the input, and the vocabulary is all
    of theirs. Ties are settled by hash and doc_id. Rows that repeat a doc_id are learnt from each.
    """
    labelled = docs.where("text is not null and lang is not null and doc_id is not null")
    chosen = least_hash(labelled.select("doc_id", "lang"), "lang", "doc_id", rows_per_language).select("doc_id").distinct()
    # chosen is bounded by rows_per_language and the number of languages
    sample = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", F.col("text").cast("string"))
    counts = sample.mapInArrow(_count, "lang string, part string, k long").groupBy("lang", "part").agg(F.sum("k").alias("k"))
    rows = counts.select("lang", F.substring("part", 1, 1).cast("int").alias("n"), F.xxhash64("part").alias("key"), "k").toArrow()

    languages = sorted(rows["lang"].unique().to_pylist())
    width = len(languages)
    keys, first, at = np.unique(rows["key"].to_numpy(), return_index=True, return_inverse=True)
    level = rows["n"].to_numpy()[first]
    lang = pc.index_in(rows["lang"], pa.array(languages, pa.string())).to_numpy()
    table = np.zeros((len(keys), width), np.float32)
    for n in range(LONGEST + 1):
        mine = np.flatnonzero(level == n)
        k = np.zeros((len(keys), width))
        here = rows["n"].to_numpy() == n
        k[at[here], lang[here]] = rows["k"].to_numpy()[here]
        k = k[mine]
        table[mine] = np.log((k + 0.5) / (k.sum(axis=0) + 0.5 * max(1, len(mine))))
    return Model(languages, keys, table if width else np.zeros((0, 1), np.float32))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its second column, or the field of its only one, a struct."""
    return batch.column(1) if batch.num_columns > 1 else batch.column(0).field("text")


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        fixed = len(model.table)
        table = np.concatenate([model.table, np.zeros((HELD, model.table.shape[1]), np.float32)])
        held: dict[str, int] = {}  # rows of words met so far: the model's, or one behind them for an unseen word
        for batch in batches:
            langs, scores = [], []
            for text in _texts(batch):
                text = text.as_py()
                words = LETTERS.findall(text.lower()) if text else []
                if not words or not model.languages:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = np.zeros(table.shape[1])
                for at in range(0, len(words), HELD):  # in slices, so that new words never outgrow the table
                    piece = words[at : at + HELD]
                    fresh = [w for w in dict.fromkeys(piece) if w not in held]
                    if len(held) + len(fresh) > HELD:
                        held.clear()
                        fresh = list(dict.fromkeys(piece))
                    if fresh:
                        rows = model.rows([f"0{w}" for w in fresh])
                        unseen = np.flatnonzero(rows < 0)
                        rows[unseen] = fixed + len(held) + np.arange(len(unseen))
                        table[rows[unseen]] = model.backed_off([fresh[i] for i in unseen])
                        held.update(zip(fresh, rows.tolist(), strict=True))
                    total += table[list(map(held.__getitem__, piece))].sum(axis=0, dtype=np.float64)
                mean = total / len(words) * min(len(words), FULL_EVIDENCE)
                p = np.exp(mean - mean.max())
                langs.append(model.languages[int(p.argmax())])
                scores.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model, row: Column | None = None) -> DataFrame:
    """row (all columns of docs, or those given), lang_pred and score of every row.

    The whole text counts. A null text, or one without a letter, is `und` with score 0; so is every
    text if nothing could be learnt. The score is the winner's share of the likelihood, from words
    worth at most FULL_EVIDENCE; ties go to the first language by name.
    """
    if row is None:  # the text travels once, within the row
        rows = docs.withColumn("text", F.col("text").cast("string"))
        rows = rows.select(F.struct(*rows.columns).alias("row"))
    else:
        rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), f"row {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of doc_id (as text) modulo 5 is not 0; the others are held out."""
    return docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")


def language_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; lang, source and doc_id play no part in a prediction.

    Rows that repeat a doc_id are predicted each by their own text; a null doc_id is not held out and
    not learnt from; an empty table gives no rows; other columns are ignored.
    """
    found = identify(docs.select("doc_id", "text"), fit(training_rows(docs)), F.struct("doc_id"))
    held_out = F.expr("coalesce(pmod(crc32(cast(cast(row.doc_id as string) as binary)), 5) = 0, false)")
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")
