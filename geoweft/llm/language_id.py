"""Language ID by multilingual mixture inference.

Training counts byte 3-grams of letters (case folded, other characters as one gap) per language over all labelled
training rows. A document is a mixture: expectation-maximisation estimates the language proportions that make its
n-grams most likely. The language set starts with the best single language; the language with the steepest gain joins
as long as the likelihood rises by more than a penalty per language, a share of log(n) for overlapping n-grams.

Training passes tables of counts per task and language, in blocks, summed by block in two steps (FAN_IN tasks first), so
that no task gathers a table of every other one. The model's size depends on the number of languages alone: half a MB
for each on the driver and in every executor. More than MOST_LANGUAGES labels are an error.

Defined results: null text, or text without a letter (Unicode category L: numerals like those of clocks or fractions are
none), is `und` with score 0; with no labelled row every text is `und`; repeated rows are predicted alike; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm._common import id_and_bytes

BUCKETS = 1 << 16
BLOCK = 1 << 12
#: A language must raise the log-likelihood by this much times log(n-grams) to join the set.
PENALTY = 6.0
ROUNDS = 12
#: Tables of counts that a task holds before it passes them on; tasks whose tables are summed in the first step.
HELD, FAN_IN = 64, 512
MOST_LANGUAGES = 1024
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")
#: Bytes as they count: letters folded to lower case, bytes of other scripts kept, all else a gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(text: bytes) -> np.ndarray:
    """Buckets of the byte 3-grams of text, gaps counted once."""
    raw = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    gap = raw == 32
    raw = raw[np.r_[True, ~(gap[1:] & gap[:-1])]]
    if len(raw) < 3:
        return np.zeros(0, np.uint16)
    wide = raw.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


@dataclass(frozen=True)
class Model:
    """Log-free n-gram probabilities, one column per language; languages in sorted order."""

    languages: tuple[str, ...]
    probability: np.ndarray


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Model:
    """Counts over every row with a language (and `where`), as smoothed probabilities."""
    rows = docs if where is None else docs.filter(where)
    rows = id_and_bytes(rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, F.col(lang_col).cast("string").alias("lang"))

    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} holds more than {MOST_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() // FAN_IN
        tables: dict[str, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, table in tables.items():
                blocks = table.reshape(-1, BLOCK)
                used = np.flatnonzero(blocks.any(1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array([group] * len(used), pa.int32()), pa.array([blocks[b].tobytes() for b in used], pa.binary())], names=["lang", "block", "step", "counts"])
            tables.clear()

        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                table = tables.get(lang)
                if table is None:
                    if len(tables) >= HELD:
                        yield from passed_on()
                    table = tables[lang] = np.zeros(BUCKETS, np.int64)
                found = grams(text)
                if len(found) > 20_000:
                    table += np.bincount(found, minlength=BUCKETS)
                else:
                    keys, n = np.unique(found, return_counts=True)
                    table[keys] += n
        yield from passed_on()

    def total(table: pa.Table) -> pa.Table:
        counts = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            counts += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"lang": table.column("lang")[:1], "block": table.column("block")[:1], "step": table.column("step")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    kind = "lang string, block int, step int, counts binary"
    summed = rows.select("doc_id", "text", "lang").mapInArrow(count, kind).groupBy("lang", "block", "step").applyInArrow(total, kind)
    summed = summed.groupBy("lang", "block").applyInArrow(total, kind).collect()
    languages = tuple(sorted({r.lang for r in summed}))
    counts = np.zeros((BUCKETS, len(languages)))
    for r in summed:
        counts[r.block * BLOCK : (r.block + 1) * BLOCK, languages.index(r.lang)] = np.frombuffer(bytes(r.counts), np.int64)
    shared = counts.sum(1, keepdims=True) + 0.5
    prior = shared / shared.sum()
    smooth = 200.0
    return Model(languages, ((counts + smooth * prior) / (counts.sum(0, keepdims=True) + smooth)).astype(np.float64))


def _fit(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions from `share` on: proportions, log-likelihood."""
    weight = n / n.sum()
    for _ in range(ROUNDS):
        mixed = p @ share
        fresh = share * (p.T @ (weight / mixed))
        done = np.abs(fresh - share).max() < 1e-3
        share = fresh / fresh.sum()
        if done:
            break
    return share, float(n @ np.log(p @ share))


def mixture(found: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language indices, proportions) of one document's n-gram buckets, the largest proportion first."""
    keys, n = np.unique(found, return_counts=True)
    p = probability[keys]
    single = n @ np.log(p)
    chosen, share, best = [int(single.argmax())], np.ones(1), float(single.max())
    total = float(n.sum())
    while len(chosen) < p.shape[1]:
        mixed = p[:, chosen] @ share
        gain = (n / mixed) @ p / total
        gain[chosen] = 0
        join = int(gain.argmax())
        # the likelihood is concave in the proportions: without a positive slope there is nothing to win
        if gain[join] <= 1:
            break
        tried, level = _fit(p[:, [*chosen, join]], n, np.r_[share * 0.8, 0.2])
        if level - best <= PENALTY * np.log(total + 1):
            break
        chosen, share, best = [*chosen, join], tried, level
    order = np.argsort(-share, kind="stable")
    return np.array(chosen)[order], share[order]


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its proportion of the document), languages and proportions of the selected set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[tuple[str, float, list[str], list[float]]] = []
            for text in batch.column(1).to_pylist():
                text = text or b""
                found = grams(text) if model.languages and (_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace"))) else text[:0]
                if not len(found):
                    out.append(("und", 0.0, [], []))
                    continue
                chosen, share = mixture(found, model.probability)
                names = [model.languages[i] for i in chosen]
                out.append((names[0], min(1.0, float(share[0])), names, share.tolist()))
            pred, score, names, shares = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "languages", "proportions"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: a fifth, by the CRC-32 of the id as text."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0


def train_and_identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify() with a model of the rows that aren't held out, plus held_out."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, where=~held_out(id_col))
    return identify(docs, model, id_col=id_col, text_col=text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages", "proportions")
