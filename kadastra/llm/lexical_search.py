"""Ranked lexical search by block-max pruning.

The index holds documents in ranges of ``BLOCK_DOCS`` as they lie in the files.  A block has its terms (64-bit hashes,
sorted), for each the largest impact in the block and the number of documents that hold it, and, packed apart, a forward
index: for each document its terms and their impacts.  An impact is the part of a score that a term's weight is
multiplied with: (10^9 * tf) div (1000 * tf + 8 * m), where m follows the document's length; so it is an integer, and
bounds and scores are exact.

A search takes the queries in chunks of a bounded number of terms, each over the whole index:

1. the number of documents of each query term is added up from the blocks, which gives the weights;
2. every task bounds each of its blocks for each query by the terms' largest impacts and names its best blocks; the best
   of all are scored, which gives each query a first threshold: the score that its last result has at least;
3. every task sorts its blocks by the query's bound and scores their forward index until the bound falls below the
   threshold, which rises with the results; no task returns more than ``top`` rows a query, and none below the threshold.

No term's documents are ever brought together, so a frequent word or a group of copies makes no task longer.

Defined cases: null and empty texts have no terms and no rank; rows are ranked one by one, so repeated rows take ranks
of their own; equal scores go by doc_id, null ids last; rows of ``queries`` that share an item_id (null too) are one
query with the terms of all; an item without results has no rows; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_TABLE, cut, frugal, pa_schema, shared

TOP = 10
#: Documents of a block; a block ends earlier at so many postings.
BLOCK_DOCS, BLOCK_POSTINGS = 64, 1 << 20
#: Query terms of a chunk, which is broadcast (8 bytes each and as much for the weights); a chunk has one query at least.
CHUNK_TERMS = 1 << 19
#: Blocks that a task sorts and holds unpacked at once, fewer if their forward indexes are long; and blocks a query whose
#: scores give the first threshold.
ROUND, ROUND_BYTES, SEEDS = 128, 1 << 24, 4
#: Hashes of words that a worker keeps.
KEPT_WORDS = 1 << 17
_NO_ID = (1 << 63) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = got
        return got


_KNOWN = _Hashes()


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of a text and how often each occurs."""
    words = text.encode().translate(WORD_TABLE).split()
    return np.unique(np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words)), return_counts=True)


def impacts(tf: np.ndarray, n: int, docs: int, total: int) -> np.ndarray:
    """Impacts of the terms of a document of ``n`` terms, of ``docs`` documents with ``total`` terms."""
    m = 10 + 90 * n * docs // total
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def corpus_size(documents: DataFrame) -> tuple[int, int]:
    """Documents that have terms, and their terms with repeats."""
    schema = pa_schema("docs long, total long")

    def run(batches):
        docs = total = 0
        for batch in batches:
            for text in batch.column(0):
                n = len((text.as_py() or "").encode().translate(WORD_TABLE).split())
                docs, total = docs + (n > 0), total + n
        yield pa.RecordBatch.from_pylist([{"docs": docs, "total": total}], schema=schema)

    got = documents.select("text").mapInArrow(frugal(run), "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


INDEX = "block long, ids array<long>, terms binary, most binary, df binary, forward binary"


def pack(docs: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, bytes]:
    """A block of documents, each as (sorted term hashes, impacts)."""
    all_terms = np.concatenate([d[0] for d in docs])
    all_impacts = np.concatenate([d[1] for d in docs])
    known, at, df = np.unique(all_terms, return_inverse=True, return_counts=True)
    most = np.zeros(len(known), np.int32)
    np.maximum.at(most, at, all_impacts.astype(np.int32))
    sizes = np.array([len(d[0]) for d in docs], "<i4")
    forward = sizes.tobytes() + at.astype("<i4").tobytes() + all_impacts.astype("<i4").tobytes()
    return {"terms": known.tobytes(), "most": most.astype("<i4").tobytes(), "df": df.astype("<i4").tobytes(), "forward": zlib.compress(forward, 1)}


def unpack(forward: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in the block's terms, and impact of each posting."""
    raw = zlib.decompress(forward)
    sizes = np.frombuffer(raw, "<i4", n)
    at, impact = np.frombuffer(raw, "<i4", offset=4 * n).reshape(2, -1)
    return np.repeat(np.arange(n), sizes), at, impact


@dataclass
class Index:
    docs: int
    total: int
    blocks: DataFrame


def build(documents: DataFrame, folder: str) -> Index:
    """Write the index of all rows of ``documents`` (doc_id, text) under ``folder``."""
    docs, total = corpus_size(documents)
    schema = pa_schema(INDEX)

    def run(batches):
        seq, first = 0, TaskContext.get().partitionId() << 33
        ids: list = []
        held: list = []
        size = 0

        def block():
            nonlocal ids, held, size, seq
            out = pa.RecordBatch.from_pylist([{"block": first + seq, "ids": ids} | pack(held)], schema=schema)
            ids, held, size, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                known, tf = terms(text.as_py() or "")
                if not len(known):
                    continue
                ids.append(i.as_py())
                held.append((known, impacts(tf, int(tf.sum()), docs, total)))
                size += len(known)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield block()
        if ids:
            yield block()

    documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), INDEX).write.parquet(folder)
    return Index(docs, total, documents.sparkSession.read.parquet(folder))


@dataclass
class Queries:
    """A chunk of queries: ``terms`` are sorted and distinct, query k has the places ``at[starts[k]:starts[k + 1]]``."""

    items: list
    terms: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    weights: np.ndarray | None = None
    least: np.ndarray | None = None  # score that a result must have at least

    @classmethod
    def of(cls, items: list[tuple[object, np.ndarray]]) -> Queries:
        every = np.concatenate([t for _, t in items])
        known, at = np.unique(every, return_inverse=True)
        return cls([i for i, _ in items], known, np.concatenate([[0], np.cumsum([len(t) for _, t in items])]), at)


def chunks(queries: DataFrame, most: int = CHUNK_TERMS) -> Iterator[Queries]:
    """The queries (item_id, text) in chunks of bounded size; the driver holds one at a time."""
    ddl = "item_id long, term long"
    schema = pa_schema(ddl)

    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known = terms(text.as_py() or "")[0]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(known), pa.int64()), pa.array(known.view(np.int64))], schema=schema)

    rows = queries.select(F.col("item_id").cast("long"), "text").mapInArrow(frugal(run), ddl).distinct()
    held, size, item, own = [], 0, None, []
    for r in rows.orderBy("item_id", "term").toLocalIterator():
        if own and r.item_id != item:
            held.append((item, np.array(own, np.int64).view(np.uint64)))
            size, own = size + len(own), []
            if size >= most:
                yield Queries.of(held)
                held, size = [], 0
        item = r.item_id
        own.append(r.term)
    if own:
        held.append((item, np.array(own, np.int64).view(np.uint64)))
    if held:
        yield Queries.of(held)


def weigh(index: Index, q: Queries) -> None:
    """Sets the weights from the number of documents of each query term."""
    share = index.blocks.sparkSession.sparkContext.broadcast(q.terms)
    ddl = "at int, df long"
    schema = pa_schema(ddl)

    def run(batches):
        wanted = share.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for t, df in zip(batch.column(0), batch.column(1), strict=True):
                place, there = _places(np.frombuffer(t.as_py(), np.uint64), wanted)
                total[there] += np.frombuffer(df.as_py(), "<i4")[place]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    df = np.zeros(len(q.terms), np.int64)
    for r in index.blocks.select("terms", "df").mapInArrow(frugal(run), ddl).groupBy("at").agg(F.sum("df").alias("df")).collect():
        df[r["at"]] = r.df  # as many rows as the chunk has terms
    share.destroy()
    q.weights = np.array([weight(index.docs, int(x)) for x in df], np.int64)


def _places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the wanted terms that are known: place among the known, place among the wanted."""
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    there = np.flatnonzero(known[at] == wanted)
    return at[there], there


def bounds(q: Queries, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Highest score that a document of the block can have for each query."""
    place, there = _places(known, q.terms)
    top = np.zeros(len(q.terms), np.int64)
    top[there] = q.weights[there] * most[place]
    return np.add.reduceat(top[q.at], q.starts[:-1])


class Block:
    """A block's postings of query terms, by term; unpacked when the first query asks."""

    def __init__(self, q: Queries, ids: list, known: np.ndarray, forward: bytes):
        place, there = _places(known, q.terms)
        column = np.full(len(known), -1)
        column[place] = np.arange(len(place))
        doc, at, impact = unpack(forward, len(ids))
        own = np.flatnonzero(column[at] >= 0)
        own = own[np.argsort(column[at[own]], kind="stable")]
        self.doc, self.impact = doc[own].astype(np.int32), impact[own]
        sizes = np.bincount(column[at[own]], minlength=len(place) + 1)  # the last column stands for all other terms
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.column = np.full(len(q.terms), len(place), np.int32)
        self.column[there] = np.arange(len(place))
        self.ids = ids

    def scores(self, q: Queries, k: int) -> np.ndarray:
        at = q.at[q.starts[k] : q.starts[k + 1]]
        c = self.column[at]
        sizes = self.ends[c] - self.starts[c]
        before = np.cumsum(sizes) - sizes
        p = np.repeat(self.starts[c] - before, sizes) + np.arange(sizes.sum())
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.doc[p], np.repeat(q.weights[at], sizes) * self.impact[p])
        return out


def search_blocks(q: Queries, blocks: list[tuple], results: list[list], least: np.ndarray, top: int) -> int:
    """Takes ``blocks`` (ids, terms, most, forward) into ``results``, a list of (-score, id) a query, and raises
    ``least``; returns how many times a block was scored for a query."""
    arrays = [(np.frombuffer(t, np.uint64), np.frombuffer(m, "<i4")) for _, t, m, _ in blocks]
    bound = np.stack([bounds(q, *a) for a in arrays])
    open_blocks: dict[int, Block] = {}
    done = 0
    for k in range(len(q.items)):
        for b in np.argsort(-bound[:, k], kind="stable").tolist():
            if bound[b, k] < least[k]:
                break
            if (block := open_blocks.get(b)) is None:
                block = open_blocks[b] = Block(q, blocks[b][0], arrays[b][0], blocks[b][3])
            score = block.scores(q, k)
            done += 1
            good = np.flatnonzero(score >= least[k])
            if len(good):
                own = results[k] + [(-int(score[i]), _NO_ID if block.ids[i] is None else block.ids[i], block.ids[i]) for i in good.tolist()]
                own.sort(key=lambda x: x[:2])
                results[k] = own[:top]
                if len(own) >= top:
                    least[k] = max(least[k], -own[top - 1][0])
    return done


RESULT = "k int, doc_id long, score long"


def _search(blocks: DataFrame, q: Queries, top: int) -> DataFrame:
    share = blocks.sparkSession.sparkContext.broadcast(q)
    schema = pa_schema(RESULT)

    def run(batches):
        q = share.value
        results: list[list] = [[] for _ in q.items]
        least, held, size = q.least.copy(), [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(tuple(x.as_py() for x in row))
                size += len(held[-1][3])
                if len(held) >= ROUND or size >= ROUND_BYTES:
                    search_blocks(q, held, results, least, top)
                    held, size = [], 0
        if held:
            search_blocks(q, held, results, least, top)
        rows = [(k, i, -s) for k, own in enumerate(results) for s, _, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema[j].type) for j in range(3)], schema=schema)

    return blocks.select("ids", "terms", "most", "forward").mapInArrow(frugal(run), RESULT)


def first_thresholds(index: Index, q: Queries, top: int) -> np.ndarray:
    """The score of the ``top``-th document of the blocks that promise most, at least 1."""
    share = index.blocks.sparkSession.sparkContext.broadcast(q)
    ddl = "k int, bound long, block long"
    schema = pa_schema(ddl)

    def run(batches):
        q, held, block = share.value, [], []
        best = [[] for _ in q.items]

        def take():
            bound = np.stack(held)
            for k, own in enumerate(best):
                order = np.argsort(-bound[:, k], kind="stable")[:SEEDS]
                own += [(-int(bound[b, k]), block[b]) for b in order.tolist() if bound[b, k]]
                own.sort()
                del own[SEEDS:]
            held.clear()
            block.clear()

        for batch in batches:
            for b, t, m in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.append(bounds(q, np.frombuffer(t.as_py(), np.uint64), np.frombuffer(m.as_py(), "<i4")))
                block.append(b.as_py())
                if len(held) >= ROUND:
                    take()
        if held:
            take()
        rows = [(k, -s, b) for k, own in enumerate(best) for s, b in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema[j].type) for j in range(3)], schema=schema)

    named = index.blocks.select("block", "terms", "most").mapInArrow(frugal(run), ddl)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("bound"), "block"))
    chosen = cut(named.withColumn("r", rank).filter(F.col("r") <= SEEDS).select("block").distinct())  # SEEDS a query at most
    share.destroy()
    q.least = np.ones(len(q.items), np.int64)
    got = _ranked(_search(index.blocks.join(F.broadcast(chosen), "block"), q, top), top)
    for r in got.filter(F.col("rank") == top).collect():  # one row a query
        q.least[r.k] = r.score
    return q.least


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each query (item_id, text)."""
    spark: SparkSession = queries.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not index.total:
        return out
    for q in chunks(queries):
        weigh(index, q)
        q.least = first_thresholds(index, q, top)
        names = spark.createDataFrame(list(enumerate(q.items)), "k int, item_id long")
        found = _ranked(_search(index.blocks, q, top), top)
        out = out.unionByName(cut(found.join(F.broadcast(names), "k").select("item_id", "rank", "doc_id", "score")))
    return out


def search_documents(documents: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """Index all documents in the shared folder, and search them."""
    return search(build(documents, f"{shared(documents.sparkSession)}/search-{uuid.uuid4().hex}"), queries, top)
