"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a fixed mask over neighbouring words: the words under its ones are hashed, the others are
ignored, so a substituted word at an ignored place does no harm.  Seeds of all benchmark positions are
joined with seeds of all document positions; a hit fixes item and diagonal (document position less item
position), and each distinct diagonal is verified word by word: a document is contaminated when some
window of ``WINDOW`` words of the item (all of a shorter item) agrees in ``AGREE`` hundredths or more.  The masks find
every window with as many substitutions as that allows (tested exhaustively).  Shorter items have masks as wide as they
are, by their number of words (``short_masks``); those under five words allow no substitution.

A word is a lower-cased run of letters and digits.

Defined cases: null and empty texts have no words and match nothing; an empty benchmark matches nothing;
repeated rows are judged alike; ``verdicts`` tells documents by doc_id and has no row for null ids; ``clean`` judges
each row by its own text, with or without an id; further columns are kept by ``clean`` as they are.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, free_name

#: Ones are compared, zeros ignored.
MASKS = ("1111011", "111010011")
WINDOW = 13
AGREE = 80
#: Rows of benchmark seeds that may be broadcast; beyond it the join shuffles.
BROADCAST_SEEDS = 500_000
BROADCAST_IDS = 1_000_000


def hashes(text: Column) -> Column:
    """array<long>: a hash of each word."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def allowed(window: int, agree: int = AGREE) -> int:
    """Substitutions that a window may hold."""
    return window - -(-agree * window // 100)


def short_masks(n: int) -> tuple[str, ...]:
    """Masks over a whole item of ``n`` words, under ``WINDOW``: places are dealt into groups, and each mask ignores as
    many groups as substitutions are allowed, so whichever they hit, some mask sees none of them."""
    k = allowed(n)
    groups = 2 * k if k > 1 else k + 2
    return tuple(
        "".join("0" if i % groups in ignored else "1" for i in range(n)) for ignored in combinations(range(groups), k)
    ) if k else ("1" * n,)


def _seeds(df: DataFrame, keep: list[str], short: list[int] = (), item: bool = False) -> DataFrame:
    """A row for each position and mask: the kept columns, pos and seed.  ``short`` lists lengths under ``WINDOW`` that
    items have; those items, and the windows of documents of that length, have seeds by their own masks."""
    least = min(len(m) for m in MASKS)

    def seed(k: int, mask: str, n: int, at: Column) -> Column:
        return F.xxhash64(F.lit(n), F.lit(k), *(F.get("h", at + i) for i, c in enumerate(mask) if c == "1"))

    # an item under a window has seeds of its own masks only
    long = (
        df.filter(F.size("h") >= (WINDOW if item else least))
        .select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("pos"))
        .select(*keep, "pos", F.explode(F.array(*(seed(k, m, 0, F.col("pos")) for k, m in enumerate(MASKS)))).alias("seed"))
    )
    for n in short:
        edge = 0 if item else allowed(n)  # words that a document's start or end may cut off
        fits = F.size("h") == n if item else F.size("h") >= n - edge
        own = df.filter(fits).select(*keep, "h", F.explode(F.sequence(F.lit(-edge), F.size("h") - n + edge)).alias("pos"))
        seeds = F.array(*(seed(k, m, n, F.col("pos")) for k, m in enumerate(short_masks(n))))
        long = long.unionByName(own.select(*keep, "pos", F.explode(seeds).alias("seed")))
    return long


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, diagonal, matched (words that agree in the best window), window: verified overlaps."""
    items = cut(benchmark.select("item_id", hashes(F.col("text")).alias("h")).filter(F.size("h") > 0).distinct())
    lengths = items.select(F.size("h").alias("n")).filter(F.col("n") < WINDOW).distinct().collect()
    short = sorted(r.n for r in lengths)  # fewer numbers than a window is long
    seeds = cut(_seeds(items, ["item_id"], short, True).withColumnRenamed("pos", "item_pos"))
    small = seeds.count() <= BROADCAST_SEEDS
    docs = documents.filter("doc_id is not null").select("doc_id", hashes(F.col("text")).alias("h"))
    hits = cut(
        _seeds(docs, ["doc_id"], short)
        .join(F.broadcast(seeds) if small else seeds, "seed")
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
        .groupBy("doc_id", "item_id", "diagonal")
        .agg(F.count("*").alias("hits"))
    )
    ids = hits.select("doc_id").distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select(
        "doc_id", hashes(F.col("text")).alias("d")
    )
    aligned = hits.join(texts, "doc_id").join(F.broadcast(items) if small else items, "item_id")
    agree = F.expr(
        "transform(sequence(0, size(h) - 1), k -> cast(coalesce(get(d, k + cast(diagonal as int)) = h[k], false) as int))"
    )
    w = WINDOW
    best = F.expr(
        f"array_max(transform(sequence(0, greatest(size(agree) - {w}, 0)), "
        f"k -> aggregate(slice(agree, k + 1, {w}), 0, (s, x) -> s + x)))"
    )
    return (
        aligned.withColumn("agree", agree)
        .select(
            "doc_id", "item_id", "diagonal", best.alias("matched"), F.least(F.size("h"), F.lit(w)).alias("window")
        )
        .filter(F.expr(f"matched * 100 >= window * {AGREE}"))
    )


def verdicts(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, first_item and matched of every contaminated document."""
    return (
        overlaps(documents, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_items"),
            F.min("item_id").alias("first_item"),
            F.max("matched").cast("long").alias("matched"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, columns unchanged."""
    # 128 bits: rows of one key have one id and text
    key, name = F.struct(F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id")), free_name(documents, "gone")
    rows = documents.select(key.alias("doc_id"), "text")
    gone = cut(verdicts(rows, benchmark).select(F.col("doc_id").alias(name)))
    few = gone.count() <= BROADCAST_IDS
    return documents.join(F.broadcast(gone) if few else gone, key == F.col(name), "left_anti")


def finds_all(masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: int = AGREE) -> bool:
    """Whether every placing of the allowed substitutions leaves some mask whole inside the window."""
    spots = [
        {at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(window - len(m) + 1)
    ]
    return all(
        any(not s & set(bad) for s in spots)
        for k in range(allowed(window, agree) + 1)
        for bad in combinations(range(window), k)
    )
