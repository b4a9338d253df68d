"""The Python kernels against brute force, exact round trips and known values."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kadastra.llm import license_scan, ngram_join, pii, piece_codec, prefix_counts, quality, resharding, tiff, warc

R = random.Random(5)


# --- licence scan
@pytest.mark.parametrize(
    ("expr", "form", "ok"),
    [
        ("MIT", "mit", True), ("MIT OR GPL-2.0-only", "(mit OR gpl-2.0-only)", True), ("MIT AND GPL-2.0-only", "(mit AND gpl-2.0-only)", False),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT AND ISC", "(gpl-2.0-only WITH classpath-exception-2.0 OR (mit AND isc))", True),
        ("(MIT OR WTFPL) AND JSON", "((mit OR wtfpl) AND json)", False), ("MIT OR", "mit", True), ("(MIT", None, None), ("MIT)", "mit", True),
        ("OR MIT", None, None), ("(MIT OR ISC) WITH LLVM-exception", None, None), ("Apache-2.0+", "apache-2.0+", True),
        ("MIT and more prose follows", "mit", True), ("MIT or later", "mit", True), ("MIT WITH more", "mit", True), ("(MIT or Apache-2.0) and more", "(mit OR apache-2.0)", True),
        ("LicenseRef-own.1 OR DocumentRef-a:LicenseRef-b", "(licenseref-own.1 OR documentref-a:licenseref-b)", False), ("prose", None, None), ("MIT ISC", "mit", True),
    ],
)
def test_expressions(expr, form, ok):
    post = license_scan.to_postfix(license_scan.tokens(expr))
    got = license_scan.evaluate(post) if post else None
    assert (got[1], got[0]) == (form, ok) if form else got is None


def test_scan_against_brute_force():
    auto = license_scan.automaton()
    words = ["mit", "license", "apache", "general", "public", "the", "MIT", "License", "é"]
    for _ in range(300):
        text = "".join(R.choice(words) + R.choice([" ", "-", "\n", ", ", "_"]) for _ in range(R.randint(0, 30)))
        w = license_scan._WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        at = [i for p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        got = license_scan.scan(text, auto)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
    got = license_scan.scan("x\n# SPDX-License-Identifier: (MIT or Apache-2.0) and more prose\nmit license", auto)
    assert "spdx:mit" in got["labels"] and got["base_labels"] == "mit" and 0 <= got["score"] <= 1
    assert license_scan.scan("spdx license identifier: and and", auto)["labels"] == "spdx-invalid"
    got = license_scan.scan("SPDX-License-Identifier: MIT and more prose follows", auto)
    assert (got["labels"], got["expressions"], got["allowed"]) == ("spdx:mit", ["mit"], True)
    got = license_scan.scan("é SPDX_License \t Identifier GPL-2.0-only WITH Classpath-exception-2.0\nx spdx-license-identifier:ISC or later\nSPDX-License-Identifier: ??", auto)
    assert got["expressions"] == ["gpl-2.0-only WITH classpath-exception-2.0", "isc"] and got["labels"] == "spdx-invalid,spdx:gpl-2.0-only,spdx:isc" and got["allowed"] is False
    import time

    began = time.process_time()
    license_scan.scan("SPDX-License-Identifier: (" * 40_000, auto)
    license_scan.scan("SPDX-License-Identifier: " + "(" * 300_000, auto)
    assert time.process_time() - began < 5


# --- resharding
def test_flow_moves_the_least():
    for _ in range(200):
        n, m = R.randint(1, 5), R.randint(1, 5)
        supply = [R.randint(0, 40) for _ in range(n)]
        capacity = resharding.even_capacity(sum(supply), m)
        f = resharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        assert [sum(x) for x in f] == supply and all(sum(f[i][j] for i in range(n)) <= capacity[j] for j in range(m))
        assert sum(f[i][i] for i in range(min(n, m))) == sum(min(supply[i], capacity[i]) for i in range(min(n, m)))


def test_flow_with_costs():
    assert resharding.min_cost_flow([2, 2], [2, 2], [[1, 3], [1, 9]]) == [[0, 2], [2, 0]]


# --- TIFF
@given(st.binary(max_size=3000), st.integers(0, 63))
@settings(max_examples=80, deadline=None)
def test_tiff_round_trip(data, pick):
    payload = data + bytes(-len(data) % 64 or 64 * (not data))
    assert b"".join(p["samples"] for p in tiff.pages(tiff.store(payload, pick))) == payload


def test_tiff_codecs():
    for data in (b"", b"a" * 5000, R.randbytes(20000), bytes(range(256)) * 300, b"ab" * 9000):
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    # the example of the format's text: 0 1 2 ... does not repeat; known PackBits string
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_tiff_pages_orders_and_damage():
    a = np.arange(100 * 70, dtype=np.uint8).reshape(100, 70)
    for comp in (tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE):
        for pred in (1, 2):
            for kw in ({"tile": 32}, {"rows": 7}):
                f = tiff.encode([a, a[:3]], comp, pred, **kw)
                got = list(tiff.pages(f))
                assert [p["samples"] for p in got] == [a.tobytes(), a[:3].tobytes()] and [p["page"] for p in got] == [0, 1]
    big = b"MM\0*" + (8).to_bytes(4, "big") + (5).to_bytes(2, "big")
    for tag, kind, v in ((256, 4, 2), (257, 4, 1), (258, 3, 8), (273, 4, 4), (279, 4, 2)):
        big += tag.to_bytes(2, "big") + kind.to_bytes(2, "big") + (1).to_bytes(4, "big") + (v.to_bytes(4, "big") if kind == 4 else v.to_bytes(2, "big") + b"\0\0")
    assert next(tiff.pages(big + bytes(4)))["samples"] == b"\0\0"
    for bad in (b"", None, b"II*\0", f[:40], b"xx" + f[2:]):
        assert tiff.page_rows(bad)[0]["error"]


def raw_tiff(w, h, bits, chunks, order="<", comp=1, pred=1, spp=1, planes=1, rows=None, tile=None, **more):
    """A file of one page with the given stored chunks."""
    import struct

    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + sum(map(len, chunks)))
    offsets, at = [], 8
    for c in chunks:
        offsets.append(at)
        at += len(c)
    tags = {256: [w], 257: [h], 258: [bits] * spp, 259: [comp], 277: [spp], 284: [planes], 317: [pred]}
    tags |= {322: [tile[0]], 323: [tile[1]], 324: offsets, 325: [len(c) for c in chunks]} if tile else {278: [rows or h], 273: offsets, 279: [len(c) for c in chunks]}
    tags |= {int(k[1:]): v for k, v in more.items()}
    tags = {k: v for k, v in tags.items() if v}
    at += 2 + 12 * len(tags) + 4
    body, tail = struct.pack(order + "H", len(tags)), b""
    for tag, v in sorted(tags.items()):
        data = struct.pack(f"{order}{len(v)}I", *v)
        body += struct.pack(order + "HHI", tag, 4, len(v))
        if len(data) <= 4:
            body += data
        else:
            body += struct.pack(order + "I", at + len(tail))
            tail += data
    return head + b"".join(chunks) + body + bytes(4) + tail


def test_tiff_depths_planes_and_predictors():
    rng = np.random.default_rng(3)
    for bits in (1, 2, 4):
        for w in (1, 7, 16, 21):
            a = rng.integers(0, 1 << bits, (5, w), dtype=np.uint8)
            per = [[sum(int(v) << (8 - bits * (i % (8 // bits) + 1)) for i, v in enumerate(row) if i // (8 // bits) == k) for k in range(-(-w * bits // 8))] for row in a]
            stored = bytes(x for row in per for x in row)
            for comp, data in ((1, stored), (tiff.PACKBITS, tiff.packbits_encode(stored))):
                assert next(tiff.pages(raw_tiff(w, 5, bits, [data], comp=comp)))["samples"] == a.tobytes()
    for order in "<>":
        for bits in (16, 32):
            a = rng.integers(0, 1 << bits, (4, 6, 3), dtype=f"u{bits // 8}").astype(f"{order}u{bits // 8}")
            assert next(tiff.pages(raw_tiff(6, 4, bits, [a.tobytes()], order, spp=3)))["samples"] == a.tobytes()
            d = a.copy()
            d[:, 1:] -= a[:, :-1]
            assert next(tiff.pages(raw_tiff(6, 4, bits, [d.tobytes()], order, spp=3, pred=2)))["samples"] == a.tobytes()
            # separate planes in strips of three rows
            strips = [np.ascontiguousarray(a[y : y + 3, :, p]).tobytes() for p in range(3) for y in (0, 3)]
            assert next(tiff.pages(raw_tiff(6, 4, bits, strips, order, spp=3, planes=2, rows=3)))["samples"] == a.tobytes()
        f = rng.normal(size=(3, 5)).astype(f"{order}f4")
        rows = []
        for row in f.astype(">f4"):
            by = np.frombuffer(row.tobytes(), np.uint8).reshape(5, 4).T.reshape(-1)
            rows.append(np.diff(by, prepend=np.uint8(0)).astype(np.uint8).tobytes())
        assert next(tiff.pages(raw_tiff(5, 3, 32, [b"".join(rows)], order, pred=3)))["samples"] == f.tobytes()


def test_tiff_damaged_pages_leave_the_good_ones():
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    f = bytearray(tiff.encode([a, a, a], tiff.DEFLATE))
    offsets = [d[273][0] for d in tiff.directories(bytes(f))]
    f[offsets[1] : offsets[1] + 4] = b"junk"
    got = tiff.page_rows(bytes(f))
    assert [(r["page"], r["samples"] == a.tobytes(), r["error"] is None) for r in got] == [(0, True, True), (1, False, False), (2, True, True)]
    for bad in (
        raw_tiff(8, 8, 8, [a.tobytes()], tile=(0, 8)), raw_tiff(8, 8, 8, [a.tobytes()], tile=(8, 0)), raw_tiff(8, 8, 8, [a.tobytes()], t279=[]),
        raw_tiff(1 << 20, 1 << 20, 8, [b"x"]), raw_tiff(8, 8, 8, [a.tobytes()], tile=(1 << 31, 1 << 30)), raw_tiff(8, 8, 8, [a.tobytes()], pred=9), raw_tiff(8, 8, 7, [a.tobytes()]),
    ):
        assert len(got := tiff.page_rows(bad)) == 1 and got[0]["error"]
    for _ in range(400):  # whatever bytes are broken, a file gives rows
        g = bytearray(f)
        for _ in range(R.randint(1, 9)):
            g[R.randrange(len(g))] = R.randrange(256)
        assert tiff.page_rows(bytes(g))


# --- quality
def test_classifier_learns_and_is_stable():
    words = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]
    texts, labels = [], []
    for i in range(300):
        w = [R.choice(words) for _ in range(R.randint(5, 60))]
        labels.append(i % 2)
        texts.append(" ".join(w if i % 2 else [x + R.choice(["!!", "$$"]) for x in w]))
    known: dict = {}
    packed = [quality.pack(*quality.featurize(t, known)) for t in texts]
    m = quality.train(packed[:200], labels[:200])
    one = quality.scorer(*m)
    assert sum((one(t) >= 0.5) == y for t, y in zip(texts[200:], labels[200:], strict=True)) >= 97
    again = quality.train(packed[:200], labels[:200])
    assert (m[0] == again[0]).all() and m[1] == again[1]
    assert one("") == one("  ") and 0 <= one("") <= 1 and one("zz " * 50000) == pytest.approx(one("zz " * 50001), abs=1e-3)
    assert quality.train([], [])[1] == 0.0 and quality.train([packed[0]], [1])[1] > 0


def test_scores_against_a_plain_forward_pass():
    """The folded, kept and vectorised score is the softmax of the mean of all features, counted one by one."""
    import zlib

    rng = np.random.default_rng(1)
    numbers, bias = rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3
    one, mask = quality.scorer(numbers, bias), quality.BUCKETS - 1
    for _ in range(60):
        words = [R.choice(["a", "bb", "Ü", "漢字", "the", "the"]) for _ in range(R.randint(0, 40))]
        got = []
        for w in words:
            b = f"<{w}>".encode()
            got += [zlib.crc32(b, 1) & mask, *(zlib.crc32(b[i : i + k]) & mask for k in (2, 3) for i in range(len(b) - k + 1))]
        for v, w in zip(words, words[1:]):
            x = (zlib.crc32(f"<{v}>".encode(), 1) * 0x9E3779B1 + zlib.crc32(f"<{w}>".encode(), 1)) % (1 << 48)
            got += [(x ^ x >> 23) & mask, int(v == w)]
        z = bias + (float(np.mean(numbers[got].astype(float))) if got else 0.0)
        text = " ".join(words)
        assert one(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        ids, share = quality.unpack(quality.pack(*quality.featurize(text, {})))
        assert bias + float(share @ numbers[ids].astype(float)) == pytest.approx(z, abs=1e-9)


# --- n-gram join
def naive(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                links.add((j, i))
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return links


def test_trie_against_brute_force():
    for _ in range(150):
        base = [R.sample(range(60), R.randint(1, 25)) for _ in range(4)]
        sets = []
        for _ in range(R.randint(1, 14)):
            s = set(R.choice(base))
            for _ in range(R.randint(0, 3)):
                s ^= {R.randrange(60)}
            sets.append(s or {1})
        arrays = [np.array(sorted(s), np.int64) for s in sets]
        trie = ngram_join.Trie([(i, i, a) for i, a in enumerate(arrays)])
        got = set()
        for i, a in enumerate(arrays):
            got |= {(min(i, trie.sets[k][0]), max(i, trie.sets[k][0])) for k in trie.probe(a) if trie.sets[k][0] != i}
        assert got == naive(sets)


def test_shingles():
    assert len(ngram_join.shingles("")) == 0 and len(ngram_join.shingles(" \n\t")) == 0
    assert len(ngram_join.shingles("a b c")) == 1 and len(ngram_join.shingles("a b c d e f")) == 2
    assert (ngram_join.shingles("A B C d e") == ngram_join.shingles("a\tb\x0bc D\nE")).all()
    assert len(ngram_join.shingles("a a a a a a a a")) == 1
    assert ngram_join.shingles("a b")[0] != ngram_join.shingles("a b a b a")[0]


# --- PII
TEXT = (
    "Mr. John Smith (Mrs Anna Smith) a.b@mail7.example.com +1 (168) 555-5254 4111 1111 1111 1111 10.1.2.3 8.8.8.8 "
    'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" DE89370400440532013000 Smith. john@corp.co.uk 123-45-6789'
)


def test_surrogates_keep_kind_and_hide():
    new, spans = pii.replace(TEXT, {})
    for a, b, kind in spans:
        assert TEXT[a:b] not in new or kind == "name-given-m"
    again = pii.find(new)
    assert [k for _, _, k in again] == [k for _, _, k in spans]
    get = {k: [new[a:b] for a, b, x in again if x == k] for _, _, k in again}
    assert pii.luhn(get["number"][0].replace(" ", "")) and get["number"][0].count(" ") == 3
    assert get["ip"][0].startswith("10.") and not get["ip"][1].startswith("10.")
    assert len(set(get["name-family-"])) == 1 and get["name-given-f"][0][-1] == "a"
    assert get["email"][0].endswith(".example.com") and get["phone"][0].startswith("+1 (")
    assert pii.replace(TEXT, {}) == (new, spans) and pii.replace(TEXT, {}, b"other")[0] != new
    assert pii.replace("", {}) == ("", []) and pii.replace("plain", {})[0] == "plain"


def test_emails_equal_the_pattern_and_are_linear():
    """The scanner gives what the plain pattern gives, and long runs without blanks take no longer."""
    import re
    import time

    plain = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
    for _ in range(3000):
        t = "".join(R.choice("ab@@..+- é") for _ in range(R.randint(0, 25)))
        assert list(pii._emails(t)) == [m.span() for m in plain.finditer(t)], t
    for t in ("a" * 1_000_000 + " b@c", "a@" * 300_000, "a." * 500_000 + "@b.c", "@" * 1_000_000, "a@b." * 250_000, "1-" * 400_000, "token=" * 150_000, "1.2." * 200_000, "A1" * 300_000, "+1 " * 300_000):
        began = time.process_time()
        pii.find(t)
        assert time.process_time() - began < 5, t[:9]


def test_surrogates_of_a_corpus_by_brute_force():
    """Every mention of one entity gets one surrogate, different entities different ones, none is an entity itself."""
    texts = [f"Mr. {a} {b} and Mrs {c} {b}: {x}@mail.example.com, 10.0.{k}.7, 555-12-{k:04d}. {b}" for k, (a, b, c, x) in enumerate(zip(["Jan", "Tom", "Jan"], ["Berg", "Holt", "Berg"], ["Eva", "Eva", "Mia"], ["q", "r", "q"]))]
    by, back = {}, {}
    for t in texts:
        new, spans = pii.replace(t, {})
        shift = 0
        again = pii.find(new)
        assert len(again) == len(spans)
        for (a, b, k), (x, y, _) in zip(spans, again):
            key = (k, pii.canonical(t[a:b], k))
            assert by.setdefault(key, new[x:y].lower()) == new[x:y].lower() != t[a:b].lower()
            assert back.setdefault((k.split("-")[0], new[x:y].lower()), key) == key
            assert t[shift:a].strip() == "" or t[shift:a] in new
            shift = b
    assert len(by) > 10


def test_surrogates_match_script():
    new, _ = pii.replace("Госпожа Иванова и Frau MÜLLER", {})
    assert "Иванова" not in new and all("а" <= c <= "я" for c in new.split()[1].lower()) and new.split()[-1].isupper()


@given(st.integers(2, 3000), st.binary(min_size=1, max_size=8))
@settings(max_examples=30, deadline=None)
def test_permutation(size, key):
    assert sorted(pii.permute(i, size, key, "t") for i in range(size)) == list(range(size))


def test_shapes_are_permuted():
    assert len({pii.shaped(f"a{i:02d}-Zб", b"k", "t") for i in range(100)}) == 100
    got = pii.shaped("Ab9-é б", b"k", "t")
    assert got[0].isupper() and got[1].islower() and got[2].isdigit() and got[3] == "-" and got[5] == " "


# --- SentencePiece
@pytest.fixture(scope="module")
def model():
    with open(piece_codec.MODEL_PATH, "rb") as f:
        return piece_codec.Model(f.read())


def test_codec_equals_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL_PATH)
    signs = "ab the▁ing \n\tÄö漢🤖ééchlich0'"
    texts = ["", " ", "  a  ", "a" * 700, " " * 90 + "x", "internationalisierung" * 60, "Hello  world\n"]
    texts += ["".join(R.choice(signs) for _ in range(R.randint(0, 90))) for _ in range(400)]
    encoder = piece_codec.Encoder(model)
    for t in texts:
        ids = encoder.encode(t)
        assert ids.tolist() == sp.encode(t), t
        assert model.decode(ids.tolist()) == t.replace("▁", " ")
    assert [x.tolist() for x in piece_codec.Encoder(model).encode_all(texts)] == [sp.encode(t) for t in texts]


def test_stream_is_bounded_and_right(model):
    s = model.normalize("abcdefg" * 400)
    stream = piece_codec.Stream(model)
    out = [model.pieces[k] if k >= 0 else sign for k, sign in stream.run(s)]
    assert "".join(out) == s and out == model.merge(s) and 0 < stream.widest <= 6 * model.longest


def test_stream_commits_before_the_end(model):
    """Ids come out while most of the signs are still to come."""
    s = model.normalize("abcdefg" * 400)
    seen = []

    class Signs(str):
        def __getitem__(self, at):
            seen.append(at.stop if isinstance(at, slice) else at + 1)
            return str.__getitem__(self, at)

    run = piece_codec.Stream(model).run(Signs(s))
    next(run)
    assert max(seen) <= 6 * model.longest < len(s)


def test_a_word_is_one_stretch_whatever_stands_behind(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL_PATH)
    words, stops = [a + b for a in ("in", "Über", "chö", "при") for b in ("ter", "bel", "н", "oso")], list(".,!?)]*&#:\n0漢🤖")
    texts = [" ".join(w + stop for w in words) for stop in stops]
    encoder = piece_codec.Encoder(model)
    assert [x.tolist() for x in encoder.encode_all(texts)] == [sp.encode(t) for t in texts]
    assert len(encoder.known) <= 2 * len(words) + len(stops)  # words in two scripts are two stretches


def test_small_stores_and_groups_change_nothing(model, monkeypatch):
    own = random.Random(6)
    texts = ["".join(own.choice("ab the. ,0漢é\n") for _ in range(own.randint(0, 60))) for _ in range(80)] + ["ab " * 50, "x" * 200]
    want = [x.tolist() for x in piece_codec.Encoder(model).encode_all(texts)]
    for kept, signs, pairs in ((1, 1 << 20, 5), (7, 40, 1), (1 << 19, 0, 1 << 18)):
        monkeypatch.setattr(piece_codec, "KEPT_STRETCHES", kept)
        monkeypatch.setattr(piece_codec, "PARTED_SIGNS", signs)
        monkeypatch.setattr(piece_codec, "KEPT_PAIRS", pairs)
        encoder = piece_codec.Encoder(model)
        assert [x.tolist() for x in encoder.encode_all(texts)] == want and len(encoder.known) <= kept
        assert [encoder.encode(t).tolist() for t in texts] == want


def test_automaton_gives_the_pieces_that_end_at_a_place(model):
    own = random.Random(7)
    for _ in range(40):
        s, state = "".join(own.choice("▁abthegins.漢") for _ in range(30)), model.root
        for i, c in enumerate(s, 1):
            while state and c not in state[0]:
                state = state[1]
            state = state[0][c] if state else model.root
            got, k = [], state[2]
            while k >= 0:
                got.append(model.pieces[k])
                k = model.shorter[k]
            assert got == [s[j:i] for j in range(i) if s[j:i] in model.ids]


def test_places_are_parted_where_no_piece_spans():
    """Pieces with blanks inside, and more groups of signs than the pattern has classes."""
    own = random.Random(8)

    def msg(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    for pieces in (["a▁", "a▁b", "ab", "cc", "a", "b", "c", "▁"], [x + x for x in "abcdefghij"] + ["▁a", "▁▁", "-]", "^["] + list("▁abcdefghij")):
        data = msg(1, msg(1, b"<unk>") + b"\x18\x02") + b"".join(msg(1, msg(1, p.encode())) for p in pieces)
        m = piece_codec.Model(data + msg(2, b"\x18\x02"))
        for _ in range(200):
            s = m.normalize("".join(own.choice("abcdefghij  -]^[x\n") for _ in range(own.randint(0, 30))))
            parts = m.parting.findall(s)
            assert "".join(parts) == s
            assert not any(x in a[-2:] + b[:2] and x not in a and x not in b for a, b in zip(parts, parts[1:], strict=False) for x in pieces)
            assert m.encode(s).tolist() == [m.ids.get(p, m.unknown) for p in m.merge(m.normalize(s))]


def test_unigram_viterbi_against_brute_force():
    import struct

    def msg(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -3.0, "ba": -2.2, "aba": -4.9}
    data = msg(1, msg(1, b"<unk>") + b"\x18\x02")
    for p, score in pieces.items():
        data += msg(1, msg(1, p.encode()) + b"\x15" + struct.pack("<f", score))
    m = piece_codec.Model(data + msg(2, b"\x18\x01"))

    def best(s):
        if not s:
            return 0.0
        return max((pieces[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces), default=float("-inf"))

    for _ in range(60):
        t = "".join(R.choice("ab ") for _ in range(R.randint(1, 14)))
        s = m.normalize(t)
        if s:
            assert sum(m.scores[i] for i in m.encode(t)) == pytest.approx(best(s), abs=1e-4)


# --- WARC
def test_warc_links_and_digests():
    html = "<html lang='DE'><title>T &amp; x</title><script>no</script><p>a<b>b</b><!-- c --><p>d &lt;<a href='/u?a=1&amp;b'>l</a>"
    rec = warc.respond("http://e.example/a b", html, 1)
    headers, block = warc.parse(rec)
    headers = dict(headers)
    (k1, h1, meta), (k2, pairs, text) = warc.derive(rec)
    h1, h2 = dict(h1), dict(pairs)
    assert (k1, k2) == ("metadata", "conversion") and h1["WARC-Refers-To"] == h2["WARC-Refers-To"] == headers["WARC-Record-ID"]
    assert text.decode() == "T & x\nab\nd <l" and h2["WARC-Block-Digest"] == warc.digest(text)
    assert h2["WARC-Source-Payload-Digest"] == headers["WARC-Payload-Digest"] == warc.digest(html.encode())
    assert headers["WARC-Block-Digest"] == warc.digest(block) and headers["WARC-Target-URI"] == "http://e.example/a%20b"
    import json

    about = json.loads(meta)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert about["Title"] == "T & x" and about["Language"] == "de" and about["Links"] == [{"path": "A@/href", "url": "/u?a=1&b"}]
    back, data = warc.parse(warc.build(k2, pairs, text))
    assert data == text and dict(back)["WARC-Type"] == "conversion" and back[1:-1] == pairs
    for bad in (b"", b"WARC/1.1\r\n\r\n", rec[:200], b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -1\r\n\r\nx", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_identifiers_outside_the_list():
    """Behind the tag any identifier counts; it has a label of its own and is not allowed."""
    auto = license_scan.automaton()
    for name in ("curl", "BSD-3-Clause-LBNL", "Some.License-9"):
        got = license_scan.scan(f"x\nSPDX-License-Identifier: {name}\ny", auto)
        assert (got["labels"], got["expressions"], got["allowed"]) == (f"spdx:{name.lower()}", [name.lower()], False)
    got = license_scan.scan("SPDX-License-Identifier: (curl OR MIT) and more", auto)
    assert got["expressions"] == ["(curl OR mit)"] and got["allowed"] is True
    got = license_scan.scan("SPDX-License-Identifier: MIT OR BSD-3-Clause-LBNL WITH My-exception-1.0 and so on", auto)
    assert got["expressions"] == ["(mit OR bsd-3-clause-lbnl WITH my-exception-1.0)"]
    assert license_scan.scan("the spdx license identifier tells more", auto)["labels"] == "spdx-invalid"  # prose, no colon


def response(body, *heads):
    message = b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in heads) + b"\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(message) + message


def test_warc_bodies_by_type():
    import gzip
    import json
    import zlib

    def text(body, *heads):
        got = warc.derive(response(body, *heads))
        about = json.loads(got[0][2])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert [k for k, _, _ in got] == (["metadata"] if "Conversion-Problem" in about else ["metadata", "conversion"])
        return about.get("Conversion-Problem"), got[1][2].decode() if len(got) > 1 else None

    assert text(b"\x89PNG\r\n<b>", "Content-Type: image/png") == ("no text in image/png", None)
    assert text(b"if a <b and c> d\n", "Content-Type: text/plain") == (None, "if a <b and c> d\n")
    assert text(b"<p>x", "Content-Type: text/html", "Content-Encoding: br") == ("encoding br is not known", None)
    two = gzip.compress(b"<p>one") + gzip.compress(b" two")
    assert text(two, "Content-Type: text/html", "Content-Encoding: gzip") == (None, "one two")
    assert text(two + b"rest", "Content-Encoding: x-gzip") == (None, "one two")
    assert text(zlib.compress(b"<p>z"), "Content-Encoding: deflate") == text(zlib.compress(b"<p>z")[2:-4], "Content-Encoding: deflate") == (None, "z")
    assert text(b"no gzip", "Content-Encoding: gzip") == ("the body is no gzip", None)
    bomb = gzip.compress(bytes(warc.LARGEST + 1), 9)
    assert text(bomb, "Content-Encoding: gzip") == (f"the body unpacks to over {warc.LARGEST} bytes", None)
    assert text("<meta charset=latin-1><p>é".encode("latin-1"), "Content-Type: text/html") == (None, "é")
    assert text('<meta http-equiv=x content="text/html; charset=windows-1251"><p>да'.encode("cp1251")) == (None, "да")
    assert text("<p>é".encode("latin-1"), "Content-Type: text/html; charset=nonsense") == (None, "\ufffd")
    assert text("\ufeff<p>é".encode("utf-16-le"), "Content-Type: text/html; charset=utf-8") == (None, "é")


def test_warc_headers_and_bodies():
    """Repeated headers stay, names have no case, chunked and packed bodies are text again."""
    import gzip
    import json
    import zlib

    page = "<p>caf\u00e9</p><p>x".encode("latin-1")
    gz = gzip.compress(page)
    chunked = b"".join(b"%x;e=1\r\n%s\r\n" % (len(p), p) for p in (gz[:5], gz[5:])) + b"0\r\n\r\n"
    deflated = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = deflated.compress(page) + deflated.flush()
    for body, extra in (
        (page, ""), (gz, "content-encoding: gzip\r\n"), (chunked, "Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n"),
        (zlib.compress(page), "Content-Encoding: deflate\r\n"), (raw, "Content-Encoding: deflate\r\n"),
    ):
        message = ("HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nContent-Type: text/html; charset=iso-8859-1\r\n" + extra + "\r\n").encode() + body
        record = b"WARC/1.0\r\nwarc-type: Response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Concurrent-To: <urn:1>\r\nWARC-Concurrent-To: <urn:2>\r\ncontent-length: %d\r\n\r\n" % len(message) + message
        (_, h, meta), (_, _, text) = warc.derive(record)
        assert text.decode() == "café\nx" and ("WARC-Refers-To", "<urn:x>") in h
        about = json.loads(meta)["Envelope"]
        assert [v for k, v in about["WARC-Header-Metadata"] if k == "WARC-Concurrent-To"] == ["<urn:1>", "<urn:2>"]
        http = about["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert [v for k, v in http["Headers"] if k.lower() == "set-cookie"] == ["a=1", "b=2"] and http["Entity-Digest"] == warc.digest(body)


def test_pages_against_the_standard_parser():
    """Text outside tags and hidden elements is what the standard library's parser gives for well-formed pages."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            if tag in warc._BREAKING:
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            if tag in warc._BREAKING:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    parts = ["<p>", "</p>", "<b class='a>b'>", "</b>", "one ", " two\n", "&amp; ", "<script>if (a<b) x</script>", "<br>", "<a href=\"x'y\">", "</a>", "a < b ", "<div id=q>", "</div>"]
    for _ in range(300):
        page = "".join(R.choice(parts) for _ in range(R.randint(0, 20)))
        p = Plain()
        p.feed(page)
        p.close()
        assert warc.plain_text(page) == "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.out).split("\n")) if x), page


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<a ", "<a href=", "<a b='", "<a b=\"x", "<", "<p", "</script", "<title>", "&", "< !", "<html lang"])
def test_hostile_pages_take_no_longer(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    t = time.process_time()
    warc.read_page(page)
    assert time.process_time() - t < 5


def test_surrogates_past_their_own_shape():
    cases = [("email", "7@example.com"), ("email", "用户@例子.公司"), ("phone", "+1234"), ("phone", "(123) 456-7890"), ("ssn", "123-45-6789"), ("ssn", "١٢٣-٤٥-٦٧٨٩"),
             ("number", "4111 1111 1111 1111"), ("iban", "DE89370400440532013000"), ("ip", "127.0.0.1"), ("secret", "a......."), ("name-family-", "Smith"), ("name-given-f", "Анна")]
    for kind, entity in cases:
        canon = pii.canonical(entity, kind)
        wide = [pii.surrogate_of(canon, kind, b"k", pii.OWN_SHAPE + i) for i in range(50)]
        assert len({*wide, canon}) == 51 and all(pii.canonical(pii.show(w, entity, kind), kind) == w for w in wide)
    assert pii.luhn(pii.surrogate_of("4111111111111111", "number", b"k", pii.OWN_SHAPE))
    names = {pii.surrogate_of(f"n{i}", "name-family-", b"k", pii.OWN_SHAPE + 3) for i in range(20_000)}
    assert len(names) == 20_000
    assert pii.surrogate_of(pii.canonical("١٢٣-٤٥-٦٧٨٩", "ssn"), "ssn", b"k", 0) != pii.canonical("١٢٣-٤٥-٦٧٨٩", "ssn")


def test_bpe_model_with_pieces_of_unknown_signs():
    """A BPE model that is not closed: merging reaches over signs that are no pieces themselves."""
    import struct

    def msg(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    pieces = {"▁": -1.0, "a": -1.1, "c": -1.2, "ab": -2.0, "bc": -1.5, "aba": -3.0, "bb": -2.5, "▁a": -2.2}
    data = msg(1, msg(1, b"<unk>") + b"\x18\x02")
    for p, score in pieces.items():
        data += msg(1, msg(1, p.encode()) + b"\x15" + struct.pack("<f", score))
    m = piece_codec.Model(data + msg(2, b"\x18\x02"))
    assert m.model_type == piece_codec.BPE and "b" not in m.ids
    texts = ["".join(R.choice("abcx ") for _ in range(R.randint(0, 40))) for _ in range(300)]
    for t in texts:
        assert m.encode(t).tolist() == [m.ids.get(p, m.unknown) for p in m.merge(m.normalize(t))], t


# --- prefix counts
@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return prefix_counts.Counter(prefix_counts.Vocabulary(f.read()))


@pytest.fixture(scope="module")
def size():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda t: len(library.encode(t, add_special_tokens=False).ids)


def normalised(counter, text):
    out, at = "", 0
    for m in counter.special.finditer(text):
        out, at = out + counter.normalize(text[at : m.start()]) + m[0], m.end()
    return out + counter.normalize(text[at:])


def test_every_prefix_costs_what_the_library_says(counter, size):
    words = ["don't", "'re", "we'll've", "İstanbul", "ΣΊΣΥΦΟΣ", "naïve", "e\u0301te", "漢字", "🤖", "<|endoftext|>", "<|startoftext|>", "12", "...", "!'s", "''ve", "\n\n", "x" * 70, "<|", "ﬁ", "Ǆ", "internationalization"]
    for _ in range(60):
        text = "".join(R.choice(words) + R.choice(["", " ", "  "]) for _ in range(R.randint(0, 12)))
        p, signs = counter.prefixes(text), normalised(counter, text)
        counts = p.counts()
        assert len(signs) == p.length and p.total == counts[-1] == size(text)
        assert counts.tolist() == [size(signs[:i]) for i in range(len(signs) + 1)]
        assert all(p.count(i) == counts[min(i, p.length)] for i in (0, p.length // 2, p.length, p.length + 5))
        for budget in (0, 1, 2, 5, 9, 17):
            i, n = p.longest(budget)
            best = max(j for j in range(len(signs) + 1) if counts[j] <= budget)
            assert (i, n) == (best, counts[best]), (text, budget)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_counts_of_any_text(counter, size, text):
    assert counter.prefixes(text).total == size(text)


def test_pairs_fit_as_merging_says(counter):
    v = counter.vocabulary
    ids = list(v.tokens)
    for _ in range(3000):
        a, b = R.choice(ids[:3000]), R.choice(ids)
        s, t = v.tokens[a], v.tokens[b]
        if not s.endswith(prefix_counts.END) and counter.vocabulary.fits(-1, a) and v.fits(-1, b):
            assert v.fits(a, b) == (v.merge(v.split(s) + v.split(t)) == [s, t])


def test_long_words_take_time_in_proportion(counter, size):
    import time

    for unit in ("y", "ab1", "?!", "漢"):
        took = []
        for n in (20_000, 200_000):
            began = time.process_time()
            counter.prefixes(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 1 + 30 * took[0], (unit, took)
        assert counter.prefixes(unit * 500).total == size(unit * 500)


def test_seams_of_pieces(model):
    """Undoing merges at the seam tells what merging the pair tells."""
    pieces = list(model.ids)
    for _ in range(3000):
        a, b = R.choice(pieces[:4000]), R.choice(pieces)
        assert model.may_follow(a, b) == (model.merge(a + b) == [a, b]), (a, b)
