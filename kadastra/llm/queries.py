"""The thin queries of this subpackage: each reads its whole table and goes through its operator."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    lexical_search,
    license_scan,
    ngram_join,
    pii,
    piece_codec,
    prefix_counts,
    quality,
    resharding,
    tiff,
    warc,
    whitening,
)
from ._common import map_rows, shared, table, text_of


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old layout: shard by source, so one hot source makes one shard far too large.  Whole rows move; size, CRC and
    slot are read from the shards written to the shared folder."""
    folder = f"{shared(spark)}/resharding-{uuid.uuid4().hex}"
    placed = resharding.reshard(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("source"), F.lit(8)), 8, folder)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


_PLAIN = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        f"select -7L conv_id, 0L turn, 'user' role, '{_PLAIN}' text union all select -7L, 1L, 'assistant', '{_PLAIN}'"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat_format.format_conversations(rows.unionByName(own))
    read = done.select(
        "conv_id", "formatted", "valid", "segments", chat_format.read_back(F.col("formatted")).alias("turns")
    )
    lost = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])), ""
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_OP5 = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a TIFF of grey pages; what is read back page by page gives the digests and features."""

    def one(doc_id: int, text: str) -> tuple:
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        media = tiff.store(payload, zlib.crc32(payload))
        digest, n, tail, count, pages, kinds = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, set()
        for page in tiff.pages(media):
            got = page["samples"]
            digest.update(got)
            n += len(got)
            tail = got[-64:]
            count += np.bincount(np.frombuffer(got, np.uint8), minlength=256)
            pages += 1
            kinds.add((page["compression"], page["predictor"], page["tiled"]))
        share = count[count > 0] / n
        mean = float(count @ np.arange(256)) / n
        bits = float(-(share * np.log2(share)).sum())
        kind = ",".join(f"{c}/{p}/{'tile' if t else 'strip'}" for c, p, t in sorted(kinds))
        feature = f"pages={pages};stored={kind};mean={mean:.4f};entropy={bits:.4f}"
        return (
            doc_id, len(raw), n, digest.hexdigest(), zlib.crc32(tail), len(media),
            hashlib.sha256(media).hexdigest(), feature,
        )

    names = [x.split()[0] for x in _OP5.split(", ")]

    def make():
        def run(cols):
            rows = [one(i, t) for i, t in zip(cols["doc_id"], cols["text"], strict=True)]
            return {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return run

    return map_rows(text_of(table(spark, sf_dir, "documents"), "doc_id"), make, _OP5)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a contaminated document."""
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_pii_surrogates, op2_license_scan, op3_resharding, op4_chat_format, op5_tiff, op6_piece_codec,
            op7_quality, op8_warc_derivatives, op9_ngram_join, op10_decontaminate, op11_lexical_search,
            op12_whitening, op13_token_counts,
        )
    }


def _sql_escape(c: str) -> str:
    t = chat_format.DEFAULT
    c = f"replace({c}, '{t.escape}', '{t.escape}0')"
    for x in t.controls:
        c = f"replace({c}, '{x}', '{x[0]}{t.escape}1{x[1:]}')"
    return c


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_sql_terms = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    t = chat_format.DEFAULT
    marks = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    role_length = f"length(replace({_sql_escape('role')}, ']', '{t.escape}2'))"
    moves = ", ".join(f"('{a}', '{r}')" for a, r in sorted(_role_pairs(t)))
    return {
        "op4_chat_format": f"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '{_PLAIN}' union all select -7, 1, 'assistant', '{_PLAIN}'),
p as (select *, coalesce(lag(role) over w, '') before, lead(role) over w after from c
  window w as (partition by conv_id order by turn, role, text)),
m as (select * from (values {moves}) v(a, b))
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  cast({len(t.bos)} + sum(length({_sql_escape("text")}) + case role {marks} else {sum(map(len, t.other))} + {role_length} end)
    as bigint) formatted_chars,
  bool_and((before, role) in (select (a, b) from m)) and bool_or(after is null and role = 'assistant') valid
from p group by conv_id""",
        "op11_lexical_search": rf"""
with d as (select row_number() over () r, doc_id, unnest({_sql_terms}) term from documents),
f as (select r, doc_id, term, count(*) tf from d group by all),
l as (select r, count(*) n from d group by r),
s as (select count(*) docs, sum(n)::bigint total from l),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint w from f, s group by term),
q as (select distinct item_id, unnest({_sql_terms}) term from benchmark),
g as (select q.item_id, f.r, f.doc_id,
    sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * l.n * s.docs) // s.total))))::bigint score
  from q join f using (term) join w using (term) join l using (r), s group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int rank, doc_id, score
from g where score > 0 qualify rank <= 10""",
    }


def _role_pairs(t: chat_format.Template) -> set[tuple[str, str]]:
    """Pairs of roles that may follow each other; '' stands before the first turn."""
    by_state = {to: r for (_, r), to in t.moves.items()} | {t.start: ""}
    return {(by_state[s], r) for s, r in t.moves}
