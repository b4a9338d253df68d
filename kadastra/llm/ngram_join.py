"""N-gram Jaccard self-join by prefix trees, returning each document's class.

A document's set holds the hashes of its distinct runs of five words.  Two documents link when
100 * |A and B| >= 80 * |A or B|.  The join is exact (up to 64-bit hashes) at every size:

1. Equal sets collapse to the smallest id; from here on a set has one representative.
2. A global order of shingles, rare before frequent, comes from a table of counts of fixed size
   (``SLOTS``); any fixed order gives exact results, this one keeps common passages out of prefixes.
3. Linked sets share a shingle among the first |A| - ceil(0.8 |A|) + 1 of each, so only those meet, and only where
   the places of the shared shingle leave enough of both sets behind it.
   First every set meets the smallest id of each of its buckets (a token in very many sets is dealt into parts, whose
   smallest ids then meet the smallest of all).  What those links join needs no more work; buckets that still hold several classes
   are then finished by pairs of chunks of ids, from which only pairs of different classes that sizes and places
   allow to link go on.  Sets are made from the texts where candidates meet; they are never stored.
4. Sets that meet are compared in tries: they are stored in the global order (frequent first, so that
   near copies share paths), a probe walks down with the overlap so far, and a subtree is left as soon as
   what remains of the probe or of the longest set below cannot reach the needed overlap, or as soon as
   all of it is in the probe's class already.
5. Links become classes by alternating stars, checkpointed in the shared folder each round.

Defined cases: null text is empty; a text without words has an empty set and is its own class; fewer than
five words make one shingle; null ids take no part and get a null class; rows that share an id are one node;
repeated rows get equal results; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_TABLE, cut, free_name, frugal, pa_schema, quoted, text_of

WORDS = 5
THRESHOLD = 80  # hundredths
#: Slots of the count table: a fixed size, of which one byte a slot is broadcast.
SLOTS = 1 << 22
_CHUNKS = 64
#: Sets that a token must count at least to be dealt into parts.
LEAST_PART = 1 << 12
#: Words whose hashes a worker keeps (some 15 MB).
KEPT_WORDS = 1 << 16
#: Tokens of a trie's edge that are compared before the bounds are looked at again.
STEP = 24
#: Members of a trie that one probe walks, and of a chunk of a bucket.
MEMBERS, CHUNK = 64, 512
#: Candidate rows (ids only) that may be broadcast to the sets; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Dropped ids that may be broadcast; beyond it the anti-join shuffles.
BROADCAST_IDS = 1_000_000

#: Bit of a prefix row's size that tells that its token has parts.
PARTED = 1 << 62

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of words, kept up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_KNOWN = _Words()


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.encode().translate(LOWER_TABLE).split()  # splits at blanks and 0x09 to 0x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, n)
    k = min(k, n)
    m = n - k + 1
    x = h[:m] + np.uint64(k)
    for i in range(1, k):
        x = x * _MUL + h[i : i + m]
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _slots(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(SLOTS - 1)).astype(np.int64)


def in_order(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """``s``, which is sorted, by the global order: rare slots first, then by hash."""
    return s[np.argsort(ranks[_slots(s)], kind="stable")]


def _pack_counts(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """(chunk, packed slots and counts) of the chunks that hold something."""
    return [(i, _pack(part)) for i, part in enumerate(counts.reshape(_CHUNKS, -1)) if part.any()]


def _pack(part: np.ndarray) -> bytes:
    at = np.flatnonzero(part)  # gaps between slots are small numbers, which pack well
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + part[at].astype("<i8").tobytes(), 1)


def _add_counts(into: np.ndarray, packed: bytes) -> None:
    raw = zlib.decompress(packed)
    n = len(raw) // 12
    into[np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))] += np.frombuffer(raw, "<i8", n, 4 * n)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[tuple[list, list]]:
    for at in range(0, batch.num_rows, rows):
        b = batch.slice(at, rows)
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


def _survey(docs: DataFrame) -> DataFrame:
    """A row a document (doc_id, n, sig) and, at the end of each task, its slot counts."""
    schema = pa_schema("doc_id long, n long, sig binary, chunk int, counts binary")

    def run(batches):
        counts = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for ids, texts in _slices(batch):
                n, sig, got = [], [], []
                for t in texts:
                    s = shingles(t)
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    got.append(s)
                np.add.at(counts, _slots(np.concatenate(got)), 1)
                none = pa.nulls(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                     none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        packed = _pack_counts(counts)
        none = pa.nulls(len(packed))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()),
             pa.array([c for c, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())],
            schema=schema)

    return docs.mapInArrow(frugal(run), "doc_id long, n long, sig binary, chunk int, counts binary")


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of quarter powers of two, one byte each; all the order needs."""
    return (4 * np.log2(1.0 + counts)).astype(np.uint8)


def _rank_table(df: DataFrame) -> np.ndarray:
    """Adds up (chunk, counts) rows task by task; the driver gets SLOTS bytes whatever the input."""
    schema = pa_schema("chunk int, ranks binary")
    size = SLOTS // _CHUNKS

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk not in total:
                    total[chunk] = np.zeros(size, np.int64)
                _add_counts(total[chunk], packed.as_py())
        for chunk, x in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([zlib.compress(_ranks(x).tobytes(), 1)], pa.binary())], schema=schema
            )

    out = np.zeros((_CHUNKS, size), np.uint8)
    for r in df.repartition(_CHUNKS, "chunk").mapInArrow(frugal(run), "chunk int, ranks binary").collect():  # SLOTS bytes at most
        out[r.chunk] = np.frombuffer(zlib.decompress(bytes(r.ranks)), np.uint8)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, ranks, most: int) -> DataFrame:
    """A row a prefix shingle: token, part, doc_id, and size, which holds set size, place and whether the token has parts.

    A token whose slot counts more than ``most`` sets is dealt into parts of about that many by document."""
    ddl = "token long, part int, doc_id long, size long"
    schema = pa_schema(ddl)
    parts_of = np.maximum(1, np.ceil(2 ** (np.arange(256) / 4) / most)).astype(np.int64)

    def run(batches):
        c = ranks.value
        for batch in batches:
            for ids, texts in _slices(batch):
                tokens, parts, docs, sizes = [], [], [], []
                for i, t in zip(ids, texts, strict=True):
                    s = shingles(t)
                    n = len(s)
                    if not n:
                        continue
                    pre = in_order(s, c)[: n - -(-THRESHOLD * n // 100) + 1]
                    k = parts_of[c[_slots(pre)]]
                    tokens.append(pre)
                    parts.append((i * 0x9E3779B1 >> 16 & 0x7FFFFFFF) % k)
                    docs.append(np.full(len(pre), i))
                    sizes.append((k > 1) * PARTED | n << 32 | np.arange(len(pre)))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x).astype(t)) for x, t in ((tokens, np.int64), (parts, np.int32), (docs, np.int64), (sizes, np.int64))],
                        schema=schema,
                    )

    return docs.mapInArrow(frugal(run), ddl)


def _with_sets(rows: DataFrame, keys: list[str], docs: DataFrame, ranks) -> DataFrame:
    """``rows`` (keys, role, node, class, pos) with the node's set as ``tokens``, frequent first.

    The rows go to the texts, if few by broadcast, and sets are made behind the join: no set is stored or shuffled
    but to the block it is compared in.  A node's rows lie together there, so its set is made once for all of them."""
    rows = cut(rows)
    few = rows.count() <= BROADCAST_ROWS
    names = [*keys, "role", "node", "class", "pos"]
    joined = docs.join(F.broadcast(rows) if few else rows, F.col("doc_id") == F.col("node")).select(*names, "text")
    ddl = ", ".join(f"{c} {t}" for c, t in joined.dtypes[:-1]) + ", tokens array<long>"
    schema = pa_schema(ddl)
    at_node, at_text = names.index("node"), len(names)

    def run(batches):
        c, last, tokens = ranks.value, None, None
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                sets = []
                for this in zip(batch.column(at_node).to_pylist(), batch.column(at_text).to_pylist(), strict=True):
                    if this != last:
                        last, tokens = this, in_order(shingles(this[1]), c)[::-1]
                    sets.append(tokens)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at_text], _lists(sets).cast(schema.field(at_text).type)], schema=schema)

    return joined.mapInArrow(frugal(run), ddl)


def _reach(n: np.ndarray, pos: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can link when their first common shingle is at places ``pos`` and ``other``."""
    return np.minimum(n - pos, m - other) * (100 + THRESHOLD) >= THRESHOLD * (n + m)


def _buckets(tokens: DataFrame) -> DataFrame:
    """Rows (token, doc_id, n: set size, pos: place of the token) whose bucket has a second member that they may link
    with, and the smallest id of the bucket in this task as pivot.

    The first shingle that two linked sets share is so early in both that the rest of either still holds the needed
    overlap; two members that this rules out are dropped here, and so are buckets without an early member.  A token
    with parts lies in several tasks: its rows are all kept, and its pivot of each task is given once more, marked as
    ``edge``.  Rows come sorted, so a task holds a batch and the first row of a bucket."""
    ddl = "token long, doc_id long, n long, pos long, pivot long, pivot_n long, pivot_pos long, edge boolean"
    schema = pa_schema(ddl)

    def run(batches):
        last: tuple[int, int, int] | None = None  # the first row of the bucket that is open
        told = False  # whether that first row has been passed on
        def out(cols: list, edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in cols), pa.array(np.full(len(cols[0]), edge))], schema=schema
            )

        for batch in batches:
            tok, doc, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(tok):
                continue
            if last is not None and not told:
                tok, doc, size = np.r_[last[0], tok], np.r_[last[1], doc], np.r_[last[2], size]
            elif last is not None and tok[0] != last[0]:
                told = False
            parted = size >= PARTED
            n, pos = (size & PARTED - 1) >> 32, size & 0xFFFFFFFF
            starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            sizes = np.diff(np.r_[starts, len(tok)])
            ends = starts + sizes - 1
            alive = sizes > 1
            alive &= np.logical_or.reduceat((n - pos) * (100 + THRESHOLD) >= 2 * THRESHOLD * n, starts)
            alive &= (sizes > 2) | _reach(n[starts], pos[starts], n[ends], pos[ends])
            alive |= parted[starts]
            if sizes[-1] > 1 and not (len(starts) == 1 and told):
                alive[-1] = True  # the bucket may go on in the next batch
            pivot = [np.repeat(x[starts], sizes) for x in (doc, n, pos)]
            keep = np.repeat(alive, sizes)
            ends = parted[starts]
            if told:  # the batch goes on with a bucket whose first row is out
                for x, v in zip(pivot, (last[1], (last[2] & PARTED - 1) >> 32, last[2] & 0xFFFFFFFF), strict=True):
                    x[: sizes[0]] = v
                keep[: sizes[0]] = True
                ends[0] = False
            if len(starts) > 1 or not told:
                k = starts[-1]
                last, told = (int(tok[k]), int(doc[k]), int(size[k])), bool(alive[-1])
            yield out([x[keep] for x in (tok, doc, n, pos, *pivot)], False)
            if ends.any():
                at = starts[ends]
                yield out([x[at] for x in (tok, doc, n, pos, doc, n, pos)], True)

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        tokens.repartition(parts, "token", "part").select("token", "doc_id", "size")
        .sortWithinPartitions("token", "doc_id").mapInArrow(frugal(run), ddl)
    )


class Trie:
    """Path-compressed trie over ordered sets.

    ``sets`` are (label, class, tokens in one global order, anything else).  A node has the tokens on its edge, its depth,
    the smallest and largest set below, and the class below if it is one only."""

    def __init__(self, sets: list[tuple]):
        self.sets = sorted(sets, key=lambda x: x[2].astype(">i8").tobytes())
        arrays = [x[2] for x in self.sets]
        common = [0] * (len(arrays) + 1)  # common[i]: length shared by i - 1 and i
        for i in range(1, len(arrays)):
            a, b = arrays[i - 1], arrays[i]
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[:m] != b[:m])
            common[i] = int(diff[0]) if len(diff) else m
        self.common = common
        self.root = self._node(0, len(arrays), 0) if arrays else None

    def _node(self, lo: int, hi: int, depth: int) -> list:
        """Node of sets lo to hi - 1, which share ``depth`` tokens already consumed."""
        stack_root: list = []
        work = [(lo, hi, depth, stack_root)]
        while work:
            lo, hi, depth, into = work.pop()
            shared = min(self.common[lo + 1 : hi], default=len(self.sets[lo][2]))
            label = self.sets[lo][2][depth:shared]
            sizes = [len(self.sets[i][2]) for i in range(lo, hi)]
            classes = {self.sets[i][1] for i in range(lo, hi)}
            ends, children = [], []
            at = lo
            while at < hi:
                if len(self.sets[at][2]) == shared:
                    ends.append(at)
                    at += 1
                    continue
                end = at + 1
                while end < hi and self.common[end] > shared:
                    end += 1
                work.append((at, end, shared, children))
                at = end
            into.append(
                (label, shared, min(sizes), max(sizes), classes.pop() if len(classes) == 1 else None, ends, children, lo, hi)
            )
        return stack_root[0]

    def probe(self, tokens: np.ndarray, skip=lambda c: False, may: np.ndarray | None = None) -> Iterator[int]:
        """Indices into ``sets`` of those that reach the threshold with ``tokens``; subtrees in which ``may`` (a flag
        a set) rules out all are left."""
        if self.root is None:
            return
        upto = [0, *np.cumsum(may).tolist()] if may is not None else None
        nq = len(tokens)
        place = {t: i for i, t in enumerate(tokens.tolist())}
        t, u = THRESHOLD, 100 + THRESHOLD
        work = [(self.root, 0, nq)]  # node, overlap above it, tokens of the probe that can still match
        while work:
            (label, depth, small, large, cls, ends, children, lo, hi), over, rest = work.pop()
            if upto is not None and upto[lo] == upto[hi]:
                continue
            if cls is not None and skip(cls):
                continue
            if 100 * large < t * nq or 100 * nq < t * small:
                continue
            done, alive = depth - len(label), True
            for k in range(0, len(label), STEP):
                step = label[k : k + STEP].tolist()
                done += len(step)
                for x in step:
                    at = place.get(x)
                    if at is not None:
                        over += 1
                        rest = nq - at - 1
                # 100 * I >= t * (nq + n - I)  <=>  u * I >= t * (nq + n)
                if u * (over + rest) < t * (nq + small) or u * (over + large - done) < t * (nq + large):
                    alive = False
                    break
            if not alive:
                continue
            for i in ends:
                if u * over >= t * (nq + depth) and (may is None or may[i]) and not skip(self.sets[i][1]):
                    yield i
            work.extend((c, over, rest) for c in children)


def _compare(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Links found within blocks: rows (keys, role, node, class, pos, tokens), where role 1 probes, 0 is stored,
    2 is both, and pos is the place of the first shingle that the block's sets share (0 where that is not known).
    Blocks are bounded, so a task holds one at a time."""
    k = len(keys)
    schema = pa_schema("a long, b long")
    parent: dict[int, int] = {}

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        parent.clear()

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        trie = Trie([(node, cls, tok, pos) for role, node, cls, pos, tok in rows if role != 1])
        sizes = np.array([len(x[2]) for x in trie.sets])
        places, classes = (np.array([x[i] for x in trie.sets]) for i in (3, 1))
        out = []
        for role, node, cls, pos, tok in rows:
            if role == 0:
                continue
            may = _reach(len(tok), pos, sizes, places) & (classes != cls)
            if not may.any():
                continue
            for i in trie.probe(tok, lambda c, cls=cls: find(c) == find(cls), may):
                other, oc = trie.sets[i][:2]
                if other != node:
                    out.append((min(node, other), max(node, other)))
                    parent[find(oc)] = find(cls)
        return out

    def run(batches):
        key, rows, found = None, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[: k + 4]]
            lists = batch.column(k + 4)
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                here = tuple(c[i] for c in cols[:k])
                if here != key:
                    found += solve(rows) if rows else []
                    key, rows = here, []
                rows.append((cols[k][i], cols[k + 1][i], cols[k + 2][i], cols[k + 3][i], flat[off[i] : off[i + 1]].copy()))
        found += solve(rows) if rows else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=schema
        )

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        blocks.repartition(n, *keys)
        .sortWithinPartitions(*keys, "role")
        .select(*keys, "role", "node", "class", "pos", "tokens")
        .mapInArrow(frugal(run), "a long, b long")
        .distinct()
    )


def _compare_pairs(pairs: DataFrame, docs: DataFrame, ranks) -> DataFrame:
    """Links among candidate pairs (probe, node, probe_class, class): each probe walks tries of its partners."""
    pairs = cut(pairs)
    count = pairs.groupBy("probe", "probe_class").agg(F.count("*").alias("m"))
    spread = F.ceil(F.col("m") / MEMBERS).cast("int")
    stored = pairs.join(count.drop("probe_class"), "probe").select(
        "probe", F.pmod(F.xxhash64("node"), spread).cast("int").alias("salt"), F.lit(0).alias("role"), "node", "class"
    )
    probes = count.withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1))).select(
        "probe", "salt", F.lit(1).alias("role"), F.col("probe").alias("node"), F.col("probe_class").alias("class")
    )
    rows = stored.unionByName(probes).withColumn("pos", F.lit(0))
    return _compare(_with_sets(rows, ["probe", "salt"], docs, ranks), ["probe", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable.  Alternating large and small stars; nodes without
    edges do not appear.  ``edges`` has columns a and b."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )  # a > b
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")
        )
        e = cut(small.select("x.a", F.col("x.m").alias("b")).filter("a > b").distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rivals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (probe, node, probe_class, class) of members of a block (keys, role, node, class, n, pos) that are of
    different classes and that sizes and places allow to link.  Blocks are bounded and hold ids only."""
    ddl = "probe long, node long, probe_class long, class long"
    schema = pa_schema(ddl)
    k = len(keys)

    def solve(x: np.ndarray) -> np.ndarray:
        role, node, cls, n, pos = x
        out = [np.zeros((4, 0), np.int64)]
        stored, probes = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        for at in range(0, len(probes), 128):
            p = probes[at : at + 128, None]
            may = (cls[p] != cls[stored]) & _reach(n[p], pos[p], n[stored], pos[stored])
            may &= (role[p] == 1) | (node[p] < node[stored])
            i, j = np.nonzero(may)
            i, j = p[i, 0], stored[j]
            out.append(np.stack([node[i], node[j], cls[i], cls[j]]))
        return np.concatenate(out, axis=1)

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(k)])
            xs = np.stack([batch.column(k + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            cuts = [0, *(np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                here = tuple(ks[:, lo].tolist())
                if here != key and held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in solve(np.concatenate(held, axis=1))], schema=schema)
                    held = []
                key = here
                held.append(xs[:, lo:hi])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in solve(np.concatenate(held, axis=1))], schema=schema)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.select(*keys, "role", "node", "class", "n", "pos").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(frugal(run), ddl)
    )


def join_classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = documents.sparkSession
    docs = text_of(documents, F.col("doc_id").cast("long").alias("doc_id"))
    survey = cut(_survey(docs))
    rows = survey.filter("chunk is null").select("doc_id", "n", "sig")
    ranks = spark.sparkContext.broadcast(_rank_table(survey.filter("chunk is not null").select("chunk", "counts")))
    reps = cut(rows.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")))
    known = docs.filter("doc_id is not null")
    # texts without a set of their own take no part; if few, by broadcast, so that no prefix is shuffled for it
    spare = rows.filter("doc_id is not null").select("doc_id").distinct().join(reps, F.col("doc_id") == F.col("rep"), "left_anti")
    spare = cut(spare)
    few = spare.count() <= BROADCAST_IDS
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_PART, total * (100 - THRESHOLD) // 100 // parts)  # prefix rows of a task
    tokens = _prefixes(known.join(F.broadcast(spare) if few else spare, "doc_id", "left_anti"), ranks, most)
    met = cut(_buckets(tokens))
    # the same test as _reach; it includes the one on sizes
    near = F.expr(f"least(n - pos, other_n - other_pos) * {100 + THRESHOLD} >= {THRESHOLD} * (n + other_n)")
    first = (
        met.filter("not edge").withColumnsRenamed({"pivot_n": "other_n", "pivot_pos": "other_pos"})
        .filter(near & F.expr("doc_id <> pivot"))
        .select(
            F.col("pivot").alias("probe"), F.col("doc_id").alias("node"),
            F.col("pivot").alias("probe_class"), F.col("doc_id").alias("class"),
        )
    )
    # a token with parts has a pivot in each; they meet the smallest of them
    ends = met.filter("edge").select("token", "pivot", "n", "pos")
    lowest = ends.groupBy("token").agg(F.min(F.struct("pivot", "n", "pos")).alias("low"), F.count("*").alias("parts"))
    across = (
        ends.join(lowest.filter("parts > 1").select("token", "low.pivot", F.col("low.n").alias("other_n"), F.col("low.pos").alias("other_pos")).withColumnRenamed("pivot", "probe"), "token")
        .filter(near & F.expr("pivot <> probe"))
        .select("probe", F.col("pivot").alias("node"), F.col("probe").alias("probe_class"), F.col("pivot").alias("class"))
    )
    first = first.unionByName(across).distinct()
    links = cut(_compare_pairs(first, known, ranks))
    classes = cut(components(links))

    labelled = (
        met.filter("not edge").select("token", "doc_id", "n", "pos")
        .join(classes, F.col("doc_id") == F.col("node"), "left")
        .select("token", "doc_id", "n", "pos", F.coalesce("root", "doc_id").alias("class"))
    )
    left = cut(_mixed(labelled))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    blocks = (
        left.withColumn("own", F.pmod(F.xxhash64("doc_id"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "token",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("role"),
            F.col("doc_id").alias("node"),
            "class",
            "n",
            "pos",
        )
    )
    pairs = _rivals(blocks, ["token", "i", "j"]).select(
        F.least("probe", "node").alias("probe"), F.greatest("probe", "node").alias("node"),
        F.when(F.col("probe") < F.col("node"), F.col("probe_class")).otherwise(F.col("class")).alias("probe_class"),
        F.when(F.col("probe") < F.col("node"), F.col("class")).otherwise(F.col("probe_class")).alias("class"),
    ).distinct()
    more = cut(_compare_pairs(pairs, known, ranks))
    if not more.isEmpty():
        classes = cut(components(links.unionByName(more)))
    ranks.destroy()
    root_of = reps.join(classes, F.col("rep") == F.col("node"), "left").select(
        F.col("sig").alias("its_sig"), F.coalesce("root", "rep").alias("root")
    )
    return rows.join(root_of, F.col("sig") == F.col("its_sig"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    )


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes, with the bucket's size m."""
    of = (
        labelled.groupBy("token")
        .agg(F.count("*").alias("m"), F.min("class").alias("x"), F.max("class").alias("y"))
        .filter("x <> y")
        .select("token", "m")
    )
    return labelled.join(of, "token")


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` without near duplicates: of each class the row with the smallest id stays.

    Rows without an id and rows without words stay.  Rows that share an id are told apart, so each goes only if a
    row that its own text links it to stays."""
    known = documents.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        classes = join_classes(documents)
        key, whole, name = F.col("doc_id"), documents, free_name(documents, "gone")
        gone = cut(classes.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)))
    else:
        row = free_name(documents, "row")
        whole = cut(documents.withColumn(row, F.monotonically_increasing_id()))
        key, name = F.col(row), free_name(whole, "gone")
        classes = cut(join_classes(whole.select(F.when(F.col("doc_id").isNotNull(), key).alias("doc_id"), "text")))
        ids = whole.select(key.alias("node"), F.col("doc_id").alias("id"))
        classed = classes.filter("doc_id is not null").join(ids, F.col("doc_id") == F.col("node"))
        first = classed.groupBy("component_id").agg(F.min(F.struct("id", "node"))["node"].alias("first"))
        gone = cut(classed.join(first, "component_id").filter("first <> node").select(F.col("node").alias(name)))
    few = gone.count() <= BROADCAST_IDS
    return whole.join(F.broadcast(gone) if few else gone, key == F.col(name), "left_anti").select(*map(quoted, documents.columns))
