"""Quality rules: four exact base statistics and a monotone boosted-tree model over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import trees
from .common import U, mix, short_batches, slices, text_bytes, word_hashes

#: Bound of the labelled sample, smallest hashes of doc_id first.
SAMPLE = 20_000
LEAST_WORDS = 50
REPEATED, OF = 50, 100
THRESHOLD = 0.5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LATER = (np.arange(256) & 0xC0) == 0x80
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "duplicate_lines", "repeated_words", "line_words", "upper", "digits", "stops", "distinct", "longest", "run", "bytes_entropy", "ended_lines")
#: More symbols, duplicate lines or repeated words never raise the score.
MONOTONE = {2: -1, 3: -1, 4: -1}


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(base statistics as integers, model features), a row for each text."""
    base, rows = np.zeros((len(texts), len(BASE)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, j in slices(texts):
        part = texts[i:j]
        hashes, at, starts, ends = word_hashes(part, lower=False)
        data = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
        later = np.concatenate([[0], np.cumsum(_LATER[data])])
        chars = (ends - starts) - (later[ends] - later[starts])
        begin = 0
        for k, text in enumerate(part):
            own = data[begin : begin + len(text)]
            begin += len(text) + 1
            words, size = hashes[at[k] : at[k + 1]], chars[at[k] : at[k + 1]]
            n = len(words)
            repeated = 0
            if n >= 3:
                windows = mix(words[:-2] * U(3) ^ mix(words[1:-1] + U(1)) * U(5) ^ mix(words[2:] + U(2)) * U(7))
                _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
                again = count[inverse] > 1
                covered = np.zeros(n, dtype=bool)
                for s in range(3):
                    covered[s : s + n - 2] |= again
                repeated = int(covered.sum())
            lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            twice = len(lines) - len(set(lines))
            symbols = int(SYMBOLS[own].sum())
            base[i + k] = n, size.sum(), symbols, twice, repeated
            if n:
                counts = np.bincount(own, minlength=256) / len(own)
                p = counts[counts > 0]
                rows[i + k] = (
                    np.log1p(n), size.mean(), symbols / n, twice / len(lines), repeated / n, np.log1p(n / len(lines)), _UPPER[own].mean(), _DIGIT[own].mean(),
                    _STOP[own].sum() / n, len(np.unique(words)) / n, np.log1p(size.max()), (words[1:] == words[:-1]).mean() if n > 1 else 0.0,
                    -(p * np.log(p)).sum(), np.mean([x.rstrip()[-1:] in b".!?" for x in lines]),
                )
    return base, rows


def train(docs: DataFrame, labels: DataFrame) -> trees.Forest:
    """The model of a bounded sample of labelled rows; without labels it keeps what passes the base rules."""
    known = short_batches(labels).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def measure(batches):
        for batch in batches:
            _, x = statistics(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "quality")
    rows = sample.mapInArrow(measure, "quality int, x array<double>").toPandas()  # SAMPLE documents at most
    if len(rows) == 0:
        return trees.fit(np.zeros((0, len(FEATURES))), np.ones(0))
    rows = rows.iloc[np.lexsort(np.stack(rows["x"]).T)]
    return trees.fit(np.stack(rows["x"]), rows["quality"].to_numpy(float), monotone=MONOTONE)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row.

    A null or empty text has no words and fails the base rules. Rows that repeat a doc_id are judged each; an empty
    table gives an empty result; without labels (or of one kind) the model keeps all that passes the base rules.
    """
    model = train(docs, labels)

    def apply(batches):
        for batch in batches:
            base, x = statistics(text_bytes(batch.column("text")))
            score = model.probability(x) if len(model.feature) else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(score)], names=["doc_id", *BASE, "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = out.mapInArrow(apply, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (OF * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= THRESHOLD)).alias("kept"), "score")
