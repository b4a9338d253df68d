"""The operators on tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from kadastra.llm import (
    chat_format,
    decontaminate,
    lexical_search,
    license_scan,
    ngram_join,
    pii,
    piece_codec,
    prefix_counts,
    quality,
    queries,
    resharding,
    tiff,
    warc,
    whitening,
)

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sig string, token long, shard int, pos int, h string, ids int, pivot long, block int, component_id long, n_entities int, class int, role int, m int"


def row(i, t):
    return (i, t, "en", "s", len(t or ""), *[7, "x", 7, 7, 7, "x", 7, 7, 7, 7, 7, 7, 7, 7])


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind, with columns named like the operators' own."""
    near = BASE + " nineteen " + " ".join(f"w{i}" for i in range(60))
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, BASE), row(4, BASE), row(5, BASE.upper()), row(6, near), row(7, near + " more"),
        row(8, "x " * 150_000), row(9, "y" * 200_000), row(None, BASE), row(10, "a b"), row(11, "a  B"), row(12, "mail a@b.example.com or +1 (266) 555-7228"),
        row(-3, "MIT License mit license"), row(13, "漢字 🤖 é\x00"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_license_scan(odd, none):
    got = Counter((r.doc_id, r.n_words, r.n_base) for r in license_scan.scan_documents(odd).collect())
    assert got[4, 18, 0] == 2 and got[1, 0, 0] == got[2, 0, 0] == 1 and got[-3, 4, 2] == 1
    assert license_scan.scan_documents(none).count() == 0


def check_shards(rows, n, docs):
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for k in by.values():
        assert sorted(r.slot for r in k) == list(range(len(k)))
    return [sum(r.size for r in by.get(i, [])) for i in range(n)]


def test_resharding(spark, docs, odd, none):
    placed = resharding.place(docs, F.pmod(F.xxhash64("source"), F.lit(8)), 8, n_blocks=16)
    rows = placed.collect()
    sizes = check_shards(rows, 8, docs)
    largest = max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 8 * largest
    want = {r.doc_id: r for r in docs.collect()}
    assert all(r.size == len(want[r.doc_id].text.encode()) + 1 and r.text_crc32 == zlib.crc32(want[r.doc_id].text.encode()) for r in rows)
    old = Counter()
    for r in rows:
        old[r.old_shard] += r.size
    cap = resharding.even_capacity(sum(old.values()), 8)
    least = sum(old.values()) - sum(min(old[i], cap[i]) for i in range(8))
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert abs(moved - least) <= 8 * largest
    check_shards(resharding.place(odd, F.lit(0), 3).collect(), 3, odd)
    assert resharding.place(none, F.lit(0), 3).count() == 0


def test_resharding_names_a_shard_that_is_not_there(spark):
    with pytest.raises(ValueError, match="old shard 3"):
        resharding.place(spark.range(4).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), F.lit(3), 2)


def test_resharding_moves_whole_rows(spark, tmp_path):
    """Null and repeated ids keep every row and all its columns; what is returned comes from the written shards."""
    rows = [(i % 7 if i % 3 else None, f"{'é' * (i % 5)} text {i // 2}" if i % 11 else None, f"s{i % 2}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `slot` int")
    got = resharding.reshard(df, F.when(F.col("source") == "s0", 0).otherwise(1), 3, str(tmp_path), n_blocks=8).collect()
    check_shards(got, 3, df)
    held = spark.read.parquet(f"{tmp_path}/shards").select("row.*", F.col("slot").alias("at"), "shard").collect()
    assert Counter(tuple(r)[:4] for r in held) == Counter(rows)
    facts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard, r["at"]) for r in held)
    assert facts == Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)
    # a shard that neither loses nor gains stays unwritten, and its rows are returned
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"))
    old = F.when(F.col("doc_id") < 40, 0).when(F.col("doc_id") < 65, 1).otherwise(2)
    assert len(resharding.reshard(d, old, 3, str(tmp_path / "b"), capacity=[350, 250, 400]).collect()) == 100
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "b/shards")).select("shard").distinct().collect()} == {0, 2}
    assert resharding.reshard(df.filter("false"), F.lit(0), 3, str(tmp_path / "c")).count() == 0


def test_chat(spark, sf):
    t = "</s>[INST] ok [/INST]"
    rows = [
        (1, 2, "assistant", "yes"), (1, 1, "user", t), (2, 1, "assistant", "bad"), (3, 1, None, None), (4, 1, "user", "␛1<s>␛0"), (4, 1, "user", "␛1<s>␛0"),
        (None, 1, "user", ""), (5, 1, "tool]x", "[ROLE:a] "), (6, None, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "[/SYS]"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(2))
    done = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in done.withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    for k, r in got.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == k))
        assert [(b.role, b.text) for b in r.back] == [x[1:] for x in own]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert not any(s.loss for s in r.segments if s not in r.segments[2::3])
        assert [s.loss for s in r.segments[2::3]] == [b.loss for b in r.back] == [b.role == "assistant" for b in r.back]
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: False, 6: True}
    assert (got[2].bad_turn, got[4].bad_turn, got[6].bad_turn) == (1, 2, None)
    assert chat_format.format_conversations(df.filter("false")).count() == 0
    q = "op4_chat_format"
    assert not differences(queries.queries()[q](spark, sf), queries.oracle_sql()[q], sf)


def test_native_plans(spark, sf, docs):
    for df in (
        queries.op4_chat_format(spark, sf),
        queries.op10_decontaminate(spark, sf),
        decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")),
        decontaminate._seeds(docs.select("doc_id", decontaminate.hashes(F.col("text")).alias("h")), ["doc_id"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_tiff_pages_of_a_table(spark):
    f = tiff.encode([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)], tiff.LZW)
    df = spark.createDataFrame([(1, f), (2, None), (3, b"junk"), (1, f)], "id long, media binary").withColumn("page", F.lit(9))
    got = tiff.decode_pages(df, "id", "media").collect()
    assert sorted((r.id, r.page if r.error is None else -1) for r in got) == [(1, 0), (1, 0), (1, 1), (1, 1), (2, -1), (3, -1)]


def test_tiff_query(spark, sf, docs):
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.op5_tiff(spark, sf).collect():
        b = want[r.doc_id]
        p = b + bytes(-len(b) % 64 or 64 * (not b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_quality(spark, sf, odd, none, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert quality.keep_good(odd, model).columns == odd.columns and quality.keep_good(none, model).count() == 0
    assert quality.fit(docs, labels.filter("false"))[1] == 0.0
    same = labels.select("doc_id", "quality", F.lit(1).alias("toxic"))
    assert quality.fit(docs, same.unionByName(same.filter("doc_id < 0")))[1] == model[1]


def test_quality_holds_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)


def classes_by_force(rows):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = {i: set(ngram_join.shingles(t or "").tolist()) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_odd_rows(odd, none):
    got = ngram_join.join_classes(odd).collect()
    assert len(got) == odd.count()
    want = classes_by_force([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == want[r.doc_id]
    assert ngram_join.join_classes(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is not None, i)) == [None, -3, 1, 2, 3, 4, 6, 8, 9, 10, 12, 13]


def test_rows_that_share_an_id_are_told_apart(spark):
    """Only rows that their own text links to a row that stays go."""
    far = " ".join(f"f{i}" for i in range(20))
    rows = [(1, BASE), (2, BASE), (2, far), (2, far), (3, far + " more"), (None, BASE), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("gone", F.lit(2))
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, BASE), (2, far), (None, BASE), (4, ""), (4, "")])


def test_join_splits_a_token_over_tasks(spark, monkeypatch):
    """One passage in every text: its tokens are dealt into parts, and the classes are whole."""
    import random

    monkeypatch.setattr(ngram_join, "LEAST_PART", 1)

    r = random.Random(3)
    base = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i % 9] + [f"u{i}" for _ in range(i % 3)] + [f"t{r.randrange(40)}"])) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join_classes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == classes_by_force(rows)


def test_join_against_brute_force(spark, monkeypatch):
    """Chains, a large mixed bucket and small batches, with limits so low that every path is taken."""
    import random

    r = random.Random(11)
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(12):  # chains of edits: ends differ more than neighbours
        t = [r.choice(vocabulary) for _ in range(80)]
        for _ in range(8):
            texts.append(" ".join(t))
            t = list(t)
            t[r.randrange(80)] = r.choice(vocabulary)
    for _ in range(40):  # mostly the same passage, most of them under the threshold
        texts.append(" ".join(shared + [r.choice(vocabulary) for _ in range(r.choice([2, 4, 6, 9]))]))
    texts += texts[:5] + [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(30)]
    r.shuffle(texts)
    rows = list(enumerate(texts, 100))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join_classes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == classes_by_force(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (5, 5)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(df).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 103: 100}


def test_masks_find_all_substitutions():
    assert decontaminate.finds_all()
    for n in range(1, decontaminate.WINDOW):
        masks = decontaminate.short_masks(n)
        assert all(len(m) == n for m in masks) and decontaminate.finds_all(masks, n)
    assert [decontaminate.allowed(n) for n in (4, 5, 9, 10, 12, 13)] == [0, 1, 1, 2, 2, 2]


def test_decontamination(spark, docs, odd, none, sf):
    import random

    r = random.Random(2)
    bench = [" ".join(f"b{r.randrange(500)}" for _ in range(n)) for n in (40, 13, 20, 3)] + [None, ""]
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").withColumn("h", F.lit(1))
    noise = lambda n: [f"n{r.randrange(900)}" for _ in range(n)]
    whole = bench[0].split()
    swapped = [w if i not in (4, 11, 19, 26, 33) else "zz" for i, w in enumerate(whole)]
    part = whole[10:24]
    d = [
        (1, noise(50) + whole + noise(9)), (2, noise(3) + swapped), (3, part), (4, whole[:9] + noise(40)), (5, noise(80)), (6, bench[1].upper().split("  ")),
        (7, bench[3].split() * 9), (8, [w if i % 3 else "q" for i, w in enumerate(whole)]),
    ]
    df = spark.createDataFrame([(i, ", ".join(t)) for i, t in d], "doc_id long, text string").withColumn("item_id", F.lit(5))
    got = {x.doc_id: x.first_item for x in decontaminate.verdicts(df, b).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 6: 1, 7: 3}
    assert sorted(x.doc_id for x in decontaminate.clean(df, b).collect()) == [4, 5, 8] and decontaminate.clean(df, b).columns == df.columns
    assert decontaminate.clean(df, b.filter("false")).count() == 8 and decontaminate.verdicts(none, b).count() == 0
    assert decontaminate.clean(odd, b).count() == odd.count()


def contaminated(texts, items):
    """Indices of texts that hold 80 hundredths of 13 words of an item in place, or of a shorter item, by trying all places."""
    import regex

    def words(t):
        return [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if x]

    items = [w for w in map(words, items) if w]
    out = set()
    for k, t in enumerate(texts):
        d = words(t)
        where = {}
        for i, x in enumerate(d):
            where.setdefault(x, []).append(i)
        for it in items:
            n = min(len(it), 13)
            diagonals = {}
            for j, x in enumerate(it):
                for i in where.get(x, ()):
                    diagonals.setdefault(i - j, set()).add(j)
            need = -(-80 * n // 100)
            if any(len(js) >= need and any(sum(j in js for j in range(a, a + n)) >= need for a in range(len(it) - n + 1)) for js in diagonals.values()):
                out.add(k)
                break
    return out


def test_decontamination_against_brute_force(spark, docs, sf):
    """The given tables, and made-up texts with substitutions, short items and rows without an id."""
    import random

    r = random.Random(8)
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = {rows[k][0] for k in contaminated([t for _, t in rows], items)}
    assert want and {x.doc_id for x in queries.op10_decontaminate(spark, sf).collect()} == want
    few = [f"w{i}" for i in range(40)]
    made = [" ".join(r.choice(few) for _ in range(n)) for n in (2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 30)]
    texts = []
    for _ in range(250):
        t = made[r.randrange(len(made))].split()
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = r.choice(few)
        cut = r.randrange(len(t))
        texts.append(" ".join([r.choice(few) for _ in range(r.randrange(9))] + t[cut * (r.random() < 0.3) :] + [r.choice(few) for _ in range(r.randrange(9))]))
    bad = contaminated(texts, made)
    assert 20 < len(bad) < 230
    df = spark.createDataFrame([(i if i % 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, gone int")
    b = spark.createDataFrame(list(enumerate(made)), "item_id long, text string")
    assert {x.doc_id for x in decontaminate.verdicts(df, b).collect()} == {i for i in bad if i % 3}
    kept = decontaminate.clean(df, b)
    assert kept.columns == df.columns and {x.gone for x in kept.collect()} == set(range(250)) - bad


def test_pii_tables(spark, odd, none):
    got = pii.replace_entities(odd).collect()
    assert len(got) == odd.count()
    r = next(x for x in got if x.doc_id == 12)
    assert r.n_entities == 2 and "a@b" not in r.text and "555-7228" not in r.text
    assert next(x for x in got if x.doc_id == 1).text is None and pii.replace_entities(none).count() == 0
    assert pii.replace_entities(odd, report=False).columns == odd.columns


def test_pii_collisions_are_resolved(spark, monkeypatch):
    """A weak surrogate that collides often ends distinct, and both ways of passing on moved entities agree."""
    rows = [(i, f"write to u{i}@x.example.com and u{(i * 7) % 30}@x.example.com") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii._entities(df)

    def assign(entities, key):
        return entities.select("kind", "canon", "attempt", F.concat(F.lit("s"), ((F.length("canon") + F.crc32("canon") % 11 + F.col("attempt") * 3)).cast("string")).alias("surrogate"))

    monkeypatch.setattr(pii, "_assign", assign)
    reg = pii.registry(found).collect()
    assert len(reg) == 30 and len({r.surrogate for r in reg}) == 30 and any(r.attempt for r in reg)
    a = {r.doc_id: r.text for r in pii.replace_entities(df).collect()}
    b = {r.doc_id: r.text for r in pii.replace_entities(df, broadcast_limit=0).collect()}
    assert a == b


def test_pii_without_a_free_surrogate(spark):
    """Entities that have no other string of their shape get a wider surrogate, and signs only are no secret."""
    texts = [f"write to {i}@example.com" for i in range(10)] + ["Password: ________", "token = ..........", "mail 用户@例子.公司 and 用户@例子.公司"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(df).collect()}
    mails = [got[i].removeprefix("write to ") for i in range(10)]
    assert len(set(mails)) == 10 and all(m.endswith("@example.com") and len(m) > len("0@example.com") for m in mails)
    assert [got[10], got[11]] == texts[10:12]
    _, a, _, b = got[12].split(" ")
    assert a == b and a.endswith(".公司") and "用户" not in a and "例子" not in a
    assert {k for t in got.values() for _, _, k in pii.find(t)} == {"email"}


def test_pii_long_entities_and_titles(spark):
    """Entities of 4 thousand to a million signs of every kind are replaced whole; a name has one surrogate under all titles."""
    import time

    kinds = {
        "secret": lambda n: "ab0c" * (n // 4), "email": lambda n: "x" * n + "@mail.org", "token": lambda n: 'token = "' + "aB3_" * (n // 4) + '"',
        "domain": lambda n: "me@" + "z" * n + ".org", "name": lambda n: "Mr A" + "b" * n,
    }
    for name, make in kinds.items():
        took = []
        for n in (4_000, 100_000, 1_000_000):
            text, began = make(n), time.process_time()
            new, spans = pii.replace(text, {})
            took.append(time.process_time() - began)
            assert len(spans) == 1 and new != text and (name == "name" or len(new) == len(text)), (name, n)
        assert took[2] < 20 + 40 * took[1], (name, took)
    a, b = "0a" * 3000, "0a" * 2999 + "0b"
    assert len({pii.shaped(x, b"k", "t") for x in (a, b, "1" + a[1:], a[:-2] + "1a")}) == 4
    rows = [(1, "Dr Anna Berg came."), (2, "Mrs Anna Berg left; Anna."), (3, "Dr Toni Berg"), (4, "Mr Toni Lund"), (5, "Mrs Toni Lund"), (6, "f" * 8000 + "0"), (7, "Госпожа Иванова и Господин Иванов")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (50_000, 0):
        got = {r.doc_id: r.text for r in pii.replace_entities(df, broadcast_limit=limit).collect()}
        anna = got[1].split()[1]
        assert got[2].split()[1] == anna == got[2].split()[-1].rstrip(".") and anna.endswith(pii.ENDINGS["latin", "f"])
        assert len({got[i].split()[1] for i in (3, 4, 5)}) == 1 and got[3].split()[1].endswith(pii.ENDINGS["latin", ""])
        assert len(got[6]) == 8001 and got[6] != rows[5][1]
        she, he = got[7].split()[1], got[7].split()[4]
        assert she == he + "а" and "Иванов" not in got[7]


def test_pii_collisions_across_kinds(spark, monkeypatch):
    """A surrogate that equals an entity of another kind is given up."""
    canon = "123-45-6789".replace("-", "")
    first = pii.surrogate_of(canon, "ssn", pii.KEY, 0)
    df = spark.createDataFrame([(1, "123-45-6789"), (2, f"token={first}")], "doc_id long, text string")
    reg = {(r.kind, r.canon): r.surrogate for r in pii.registry(pii._entities(df)).collect()}
    assert reg["ssn", canon] != first and reg["secret", first] != first and len(reg) == 2


def test_pii_null_ids_take_moved_surrogates(spark):
    """Moved entities of rows without an id go the same way whether they are broadcast or joined."""
    rows = [(i if i % 3 else None, f"write to {i}@example.com") for i in range(10)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted((r.doc_id or -1, r.text) for r in pii.replace_entities(df).collect())
    b = sorted((r.doc_id or -1, r.text) for r in pii.replace_entities(df, broadcast_limit=0).collect())
    assert a == b and len({t for _, t in a}) == 10 and not {t for _, t in a} & {t for _, t in rows}


def test_codec_tables(spark, odd, none, docs):
    got = piece_codec.encode_documents(odd).collect()
    assert len(got) == odd.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert piece_codec.encode_documents(none).count() == 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL_PATH)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == sp.encode(text[r.doc_id]) and r.round_trip for r in piece_codec.encode_documents(docs).collect())


def test_warc_tables(spark, sf):
    df = spark.createDataFrame([(1, None, None), (2, "http://x", ""), (2, "http://x", ""), (3, "u", "<p>a")], "page_id long, url string, html string").withColumn("record", F.lit("x"))
    got = warc.derivatives(warc.responses_of(df)).collect()
    assert Counter((r.page_id, r.record_type) for r in got) == {(1, "metadata"): 1, (1, "conversion"): 1, (2, "metadata"): 2, (2, "conversion"): 2, (3, "metadata"): 1, (3, "conversion"): 1}
    bad = spark.createDataFrame([(1, b"x"), (2, None)], "page_id long, record binary")
    assert [r.record_type for r in warc.derivatives(bad).collect()] == ["error", "error"]
    assert warc.derivatives(warc.responses_of(df.filter("false"))).count() == 0
    q = queries.op8_warc_derivatives(spark, sf)
    assert q.count() == 2 * spark.read.parquet(f"{sf}/pages.parquet").count() == q.select("record_id").distinct().count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    one = quality.scorer(*model)
    good = [(r.doc_id, r.text) for r in docs.collect() if one(r.text) >= quality.THRESHOLD]
    first = {i for i, (_, c) in classes_by_force(good).items() if i == c}
    bad = {r.doc_id for r in queries.op10_decontaminate(spark, sf).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == first - bad and all(r.round_trip for r in got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_stages_on_odd_rows(spark, sf, odd, none):
    """Null ids, empty and very long texts, repeated rows and clashing columns go through all stages; an empty table too."""
    import corpus_pipeline

    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encoding":
            assert out.columns == odd.columns and out.schema == odd.schema, name
        rows = out.collect()
        assert 0 < len(rows) <= docs.count(), name
        assert stage(spark, none, sf).count() == 0, name
        if name != "encoding":
            docs = spark.createDataFrame(rows, odd.schema).repartition(3)
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)


# --- ranked search
def ranked(texts, items, top=10):
    """Ranks by the formula, document by document."""
    import math
    import re

    def terms(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))

    docs = [(i, terms(t)) for i, t in texts]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def test_search_against_brute_force(spark, odd, none, tmp_path, monkeypatch):
    import random

    r = random.Random(4)
    word = lambda: f"W{int(r.paretovariate(0.7)) % 300}"
    texts = [(i, " ".join(word() for _ in range(r.randrange(40)))) for i in range(700)]
    texts += [(1000 + i, "w1 w2 w3 copy copy") for i in range(40)] + [(None, "w1 w2 w3 copy copy"), (5, texts[5][1]), (9000, None), (9001, "é漢字,Straße w7")]
    items = [(k, " ".join(word() for _ in range(r.randrange(1, 12)))) for k in range(30)] + [(50, "copy"), (51, "none at all"), (52, None), (53, "ÉTÉ straße"), (None, "w7")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("term", F.lit(1)).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit(1))
    monkeypatch.setattr(lexical_search, "ROUND", 3)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 16)
    want = ranked(texts, items)
    for most in (lexical_search.CHUNK_TERMS, 20):
        monkeypatch.setattr(lexical_search.chunks, "__defaults__", (most,))
        got = lexical_search.search_documents(docs, bench)
        assert sorted((tuple(x) for x in got.collect()), key=str) == want
        assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert lexical_search.search_documents(none, bench).count() == 0 and lexical_search.search_documents(docs, bench.filter("false")).count() == 0
    items = [(1, "one two x"), (2, "漢字")]
    got = lexical_search.search_documents(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == ranked([(x.doc_id, x.text) for x in odd.collect()], items)


def test_search_leaves_blocks(spark):
    """Blocks whose bound is below the threshold are not scored."""
    r = np.random.default_rng(3)
    docs = []
    for b in range(60):
        words = [f"b{b}w{int(x)}" for x in r.integers(0, 30, 400)]
        docs.append([(lambda t: (t[0], lexical_search.impacts(t[1], int(t[1].sum()), 600, 24_000)))(lexical_search.terms(" ".join(words[i : i + 40]))) for i in range(0, 400, 40)])
    blocks = []
    for b, d in enumerate(docs):
        p = lexical_search.pack(d)
        blocks.append((list(range(10 * b, 10 * b + 10)), p["terms"], p["most"], p["forward"]))
    q = lexical_search.Queries.of([(k, lexical_search.terms(f"b{k}w1 b{k}w2 b{k + 1}w3")[0]) for k in range(20)])
    q.weights = np.full(len(q.terms), 5000)
    results, least = [[] for _ in q.items], np.ones(20, np.int64)
    scored = lexical_search.search_blocks(q, blocks, results, least, 10)
    assert all(results) and scored <= 3 * 20 < 60 * 20


def test_search_sql(spark, sf):
    assert not differences(queries.op11_lexical_search(spark, sf), queries.oracle_sql()["op11_lexical_search"], sf)


# --- whitening
def test_whitening_against_plain_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in rows]
    d = len(rows[0][1])
    odd = [(-1, None), (-2, []), (-3, [None] + [0.1] * (d - 1)), (-4, [float("nan")] * d), (-5, [float("inf")] + [0.0] * (d - 1)), (-6, [0.5] * 3), (None, rows[0][1]), rows[1]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).repartition(3)
    got = whitening.whiten(df).collect()
    good = [*rows, (None, rows[0][1]), rows[1]]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = y @ u[:, :8] / np.sqrt(e[:8])
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    at = {i: k for k, (i, _) in enumerate(good)}
    sign = {}
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        want = z[k, c]
        sign.setdefault(c, 1.0 if abs(r.whitened - want) < abs(r.whitened + want) else -1.0)
        assert r.whitened == pytest.approx(sign[c] * want, abs=1e-8) and r.explained == pytest.approx(e[c] / np.trace(v))
        assert r.deviation == int(((n * x[k] - total) ** 2).sum()) == int(r.deviation_digits)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0
    got = make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect()  # nothing varies
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    got = make([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)]).collect()  # one direction only
    assert [r.whitened is None for r in got if r.vec_id == 1] == [False, True, True] and got[0].identity_error < 1e-9
    got = make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]).collect()  # beyond 64 bits
    x = [[2**52 + 100_000, 100_000], [-(2**52) + 100_000, 101_024], [100_000, 102_048]]
    total = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation_digits) for r in got} == {i + 1: sum((3 * a - s) ** 2 for a, s in zip(r, total)) for i, r in enumerate(x)}
    assert all(r.deviation is None for r in got if r.vec_id < 3)


# --- token counts
def test_token_counts(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    for df in (docs, odd):
        want = Counter((r.doc_id, len((r.text or "").encode()), size(r.text), size(r.text) > 2048) for r in df.collect())
        rows = prefix_counts.count_documents(df, path).collect()
        assert Counter(tuple(r)[:4] for r in rows) == want
        assert all((r.kept_tokens == r.n_tokens) if not r.over_limit else r.kept_tokens <= 2048 for r in rows)
    assert prefix_counts.count_documents(none, path).count() == 0
