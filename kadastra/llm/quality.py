"""Quality classifier: averaged word and character n-gram vectors, softmax, trained by numpy SGD.

A document is the mean of the vectors of its features: every word (a run without white space), the
character n-grams of the word between ``<`` and ``>``, and its word bigrams, all hashed into one table.  A bigram
enters twice, by its words and by whether they are the same word, as what is repeated matters less than that it is.
Two softmax outputs read that mean.  As the output is linear in the mean, a trained model folds into one number a
bucket, and a word's share of the logit can be kept per word while scoring.

Training uses at most ``TRAIN_ROWS`` labelled rows (a documented bound, taken by a hash of the id, so that
the sample is the same in every run) and whole texts; their features are counted in the tasks, so the driver gets
at most ``TRAIN_ROWS`` packed lists of distinct buckets, however long the texts are.  Scoring covers every row.

Defined cases: null and empty texts get the score of the bias alone; null labels are not learned from;
rows labelled both ways count as given; without labelled rows every score is 0.5; repeated rows score
equally; columns besides doc_id and text never enter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, map_rows, text_of

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (2, 3)
EPOCHS = 5
RATE = 2.0
TRAIN_ROWS = 4000
SEED = 7
THRESHOLD = 0.3
#: Words that a task keeps the shares of (some 20 MB); a full store is emptied, which changes no result.
KEPT_WORDS = 1 << 17
#: Buckets of "two different words" and "the same word twice"; hashed features share them.
PAIR = 0, 1
_MUL = 0x9E3779B1


def features(word: str) -> tuple[int, list[int]]:
    """Hash of a word, and the buckets of the word and its character n-grams."""
    w = f"<{word}>".encode()
    n = len(w)
    crc, mask = zlib.crc32, BUCKETS - 1
    whole = crc(w, 1)
    out = [whole & mask]
    for k in NGRAMS:
        out += [crc(w[i : i + k]) & mask for i in range(n - k + 1)]
    return whole, out


def bigrams(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Buckets of the bigrams of word hashes, and how many of them say one word twice."""
    a, b = words[:-1], words[1:]
    mixed = (a * _MUL + b) & 0xFFFFFFFFFFFF
    return (mixed ^ mixed >> 23) & (BUCKETS - 1), int(np.count_nonzero(a == b))


def featurize(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs; ``known`` keeps words."""
    flat: list[int] = []
    hashes: list[int] = []
    for w in text.split():
        if (got := known.get(w)) is None:
            if len(known) >= KEPT_WORDS:
                known.clear()
            got = known[w] = features(w)
        hashes.append(got[0])
        flat += got[1]
    pairs, same = bigrams(np.array(hashes, np.int64))
    every = np.concatenate([np.array(flat, np.int64), pairs, np.full(len(pairs) - same, PAIR[0]), np.full(same, PAIR[1])])
    return np.unique(every.astype(np.int64), return_counts=True)


def pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of all features."""
    gaps, n = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), n / max(1, n.sum(dtype=np.int64))


def train(docs: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias) from packed features: logit of label 1 = bias + mean of the numbers of the features."""
    if len(set(labels)) < 2:
        p = 0.5 if not labels else 0.99 if labels[0] else 0.01
        return np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(SEED)
    emb = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    out = np.zeros((DIM, 2))
    bias = np.zeros(2)
    y = np.array(labels)
    weight = len(y) / (2 * np.bincount(y, minlength=2))  # both classes count alike
    steps, total = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            ids, share = unpack(docs[k])
            rate = RATE * (1 - steps / total) * min(weight[y[k]], 5.0)
            steps += 1
            rows = emb[ids]
            h = share @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1.0
            back = out @ p
            out -= 0.05 * rate * np.outer(h, p)
            bias -= 0.001 * rate * p
            emb[ids] = rows - rate * share[:, None] * back
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of ``labels`` (doc_id, quality) outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )
    got = (
        map_rows(
            text_of(documents, "doc_id").join(F.broadcast(known), "doc_id"),  # at most ``rows`` short rows
            _packer,
            "doc_id long, quality int, packed binary",
        )
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("packed"))
        .limit(rows)
        .select("packed", "quality")
        .collect()
    )
    return train([bytes(r.packed) for r in got], [r.quality for r in got])


def _packer() -> Callable[[dict], dict]:
    known: dict = {}
    return lambda cols: {
        "doc_id": cols["doc_id"],
        "quality": cols["quality"],
        "packed": [pack(*featurize(t, known)) for t in cols["text"]],
    }


def scorer(numbers: np.ndarray, bias: float) -> Callable[[str], float]:
    """A function from a text to its score."""
    known: dict[str, tuple[float, int, int]] = {}
    number = numbers.tolist().__getitem__  # quicker than the array for a word's few buckets

    def learn(w: str) -> tuple[float, int, int]:
        if len(known) >= KEPT_WORDS:
            known.clear()
        h, f = features(w)
        got = known[w] = (sum(map(number, f)), len(f), h)
        return got

    def one(text: str) -> float:
        total, n, hashes = 0.0, 0, []
        for w in text.split():
            got = known.get(w) or learn(w)
            total += got[0]
            n += got[1]
            hashes.append(got[2])
        if len(hashes) > 1:
            pairs, same = bigrams(np.array(hashes, np.int64))
            total += float(numbers[pairs].sum(dtype=np.float64))
            total += (len(pairs) - same) * float(numbers[PAIR[0]]) + same * float(numbers[PAIR[1]])
            n += 2 * len(pairs)
        z = bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return one


def score_documents(df: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (probability of label 1) of every row."""
    numbers, bias = model
    share = df.sparkSession.sparkContext.broadcast(numbers)  # BUCKETS floats, a fixed size

    def make():
        one = scorer(share.value, bias)
        return lambda cols: {"doc_id": cols["doc_id"], "score": [one(t) for t in cols["text"]]}

    return map_rows(text_of(df, "doc_id"), make, "doc_id long, score double")


def keep_good(df: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score reaches the threshold, with all their columns, in one pass."""
    numbers, bias = model
    share = df.sparkSession.sparkContext.broadcast(numbers)
    schema = df.schema

    def run(batches):
        import pyarrow as pa

        one = scorer(share.value, bias)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [one(t.as_py() or "") >= threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(frugal(run), schema)
