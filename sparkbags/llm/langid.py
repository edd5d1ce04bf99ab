"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, ``3 * BUCKETS`` rows by one column for
each language, so its size depends on the number of languages alone; it is
broadcast.  A batch of texts is scored with numpy: the n-gram ids of all its texts
are one array, their rows of the matrix are gathered and summed by text.

Null texts and texts without a letter get ``und`` and score 0.  An empty training
set gives ``und`` everywhere.  Ties go to the alphabetically first language.  Rows
with equal or null keys are scored each for its own text, whatever texts stand beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, tidied

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: At most about so many documents are learned from (chosen by a hash of the id).
MAX_TRAIN_DOCS = 20_000
_SLICE = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the n-grams of all texts, shaped (orders, characters), and the
    number of characters of each text after every run of non-letters became one
    space.  Each text starts and ends with a space."""
    joined = "\0".join((t or "").lower().replace("\0", " ") for t in texts)
    code = np.frombuffer(f"\0{joined}\0".encode("utf-32-le"), dtype=np.uint32)
    letter = _is_letter()[code]
    end = code == 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter
    keep |= end
    code = np.where(letter, code, 32).astype(np.uint32)[keep]
    end = end[keep]
    marks = np.flatnonzero(end)  # one more than there are texts
    ids = np.empty((len(ORDERS), len(code)), np.int64)
    h = np.zeros(len(code), np.uint32)
    beyond = np.zeros(len(code), bool)  # the text has ended before the n-gram's last character
    for k, n in enumerate(ORDERS):
        last = np.full(len(code), 32, np.uint32)
        last[: len(code) - n + 1] = code[n - 1 :]
        if n > 2:
            beyond[: len(code) - n + 2] |= end[n - 2 :]
        last[beyond] = 32
        h = (h ^ last) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        ids[k] = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64) + k * BUCKETS
    return ids[:, :-1], np.diff(marks)  # text i: from its first mark up to the next one


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities, with priors in its last row."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = docs.where(F.col(lang).isNotNull()).count()
    if n > max_docs:
        share = max_docs / n
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(it):
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in it:
            for part in chunks(b, "t", _SLICE):
                ids, size = ngram_ids(part.column(0).to_pylist())
                at = np.concatenate(([0], np.cumsum(size)))
                for i, name in enumerate(part.column(1).to_pylist()):
                    got = total.setdefault(name, np.zeros(BUCKETS * len(ORDERS), np.int64))
                    docs_of[name] = docs_of.get(name, 0) + 1
                    for row in ids[:, at[i] : at[i + 1]]:
                        np.add.at(got, row, 1) if len(row) < 4000 else np.add(got, np.bincount(row, minlength=len(got)), out=got)
        for name, got in total.items():
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(got[some], docs_of[name]))], ["lang", "bucket", "n"])

    counts = known.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(tidied(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets rows at most
    langs = sorted(set(counts.column("lang").to_pylist()))
    of = {x: i for i, x in enumerate(langs)}
    table = np.zeros((BUCKETS * len(ORDERS) + 1, max(1, len(langs))))
    if langs:
        col = np.array([of[x] for x in counts.column("lang").to_pylist()])
        table[counts.column("bucket").to_numpy(), col] = counts.column("n").to_numpy()
    prior = np.log(table[-1] + 1) - np.log((table[-1] + 1).sum())
    out = np.empty(table.shape, np.float32)
    for k in range(len(ORDERS)):
        part = table[k * BUCKETS : (k + 1) * BUCKETS] + 0.1
        out[k * BUCKETS : (k + 1) * BUCKETS] = np.log(part / part.sum(0))
    out[-1] = prior
    return langs, out


def score(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    ids, size = ngram_ids(texts)
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    total = np.zeros((len(texts), model.shape[1]))
    for row in ids:
        total += np.add.reduceat(model[row], start, axis=0, dtype=np.float64)
    none = size <= 1  # the opening mark only: no letter
    if not langs:
        none[:] = True
    total += model[-1]
    # n-grams of one text depend on each other: temper so that scores don't saturate
    total /= np.maximum(1.0, np.sqrt(size))[:, None]
    best = total.argmax(1)
    p = np.exp(total - total.max(1, keepdims=True))
    p = 1.0 / p.sum(1)
    p[none] = 0.0
    return ["und" if no else langs[i] for i, no in zip(best.tolist(), none.tolist(), strict=True)], p


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            for part in chunks(b, "t", _SLICE):
                lang, p = score(part.column(1).to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(p)], ["k", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidied(run), f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)
