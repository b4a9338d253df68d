"""Token counts of every prefix by dynamic programming over a byte-level BPE vocabulary with word ends.

Merging gives a run of tokens if and only if every two neighbours alone merge to themselves, so among all ways to end
a prefix of a word with a token there is exactly one whose neighbour fits.  ``Counter.word`` walks a word once: for each
place it keeps the last token of the word so far, open (more may follow) and, at each sign, closed (the word ends there),
and the count is one more than at the token's start.  That is the exact number of tokens of each prefix of the word.

``Prefixes`` holds a text as its words' places, the running count at each word and the words' own tables (words recur,
so a task keeps them), which together are the count at every prefix: ``count(i)`` answers what a prefix costs, ``longest(b)``
where to cut for a budget, without encoding anything again.  Counts are not monotone inside a word, and both allow for it.

A prefix is one of the normalised text: composed (NFC), each sign lower-cased, runs of white space as they are.  Special
strings count as one token, their own prefixes as ordinary text.

Defined cases: null and empty texts have no tokens; repeated rows count alike; a single word of any length takes time in
proportion to it; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, pa_schema, text_of
from .piece_codec import read_model

LIMIT = 2048
#: Words' totals, words' tables and pairs of tokens that a worker keeps (some 50, 10 and 20 MB); a full store is emptied,
#: which changes no count.
KEPT_WORDS, KEPT_TABLES, KEPT_PAIRS = 1 << 19, 1 << 15, 1 << 18
#: Longer words are counted but not kept.
KEPT_SIGNS = 64
END = "</w>"
#: Fixed values of the vocabulary's file: how it parts words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs that the library lower-cases otherwise than Python does (one by its place, two by its newer tables).
LOWER = {"\u03a3": "\u03c3", "\ua7cb": "\u0264", "\ua7dc": "\u019b"}
#: Ranges of signs newer than the library's tables, which takes them for neither letters nor numbers.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D,
    0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1,
    0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475,
    0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123,
    0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0,
    0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
#: Contractions of which a part would be read otherwise, as an apostrophe and a word.
_LONG = ("'re", "'ve", "'ll")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it shows, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special strings of a ``tokenizers`` file of this kind."""

    def __init__(self, data: bytes):
        told = json.loads(data)
        model = told["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or odd or WORD not in json.dumps(told["pre_tokenizer"]).replace("\\\\", "\\"):
            raise ValueError("only byte-level BPE with word ends is read")
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.ids_of_pair = {(self.ids[a], self.ids[b]): r for (a, b), r in self.ranks.items()}
        #: Token -> rank of the merge that makes it, and its two parts; signs have none.
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), r in self.ranks.items():
            self.made.setdefault(self.ids[a + b], (r, self.ids[a], self.ids[b]))
        #: Trie of the tokens' bytes from the last back: byte -> [id of the open token or -1, id of the closed one or -1, below].
        self.root: dict[int, list] = {}
        byte_of = {c: b for b, c in enumerate(byte_signs())}
        for token, i in self.ids.items():
            at, node = self.root, None
            for c in reversed(token.removesuffix(END)):
                node = at.setdefault(byte_of[c], [-1, -1, {}])
                at = node[2]
            if node:
                node[token.endswith(END)] = i
        self.special = [t["content"] for t in told["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("special strings are matched as they stand")

    def merge(self, parts: list[str]) -> list[str]:
        """The merge algorithm itself, on short runs: lowest rank first, leftmost among equals."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def split(self, token: str) -> list[str]:
        if token.endswith(END) and token != END:
            bare = token[: -len(END)]
            return [*bare[:-1], bare[-1] + END]
        return list(token)

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a`` (-1: stand first) in what merging gives.

        Merges at the seam are undone from the last back; a merge across the seam that would have come before the one
        just undone (of equal rank: farther left) rules the pair out."""
        if a < 0:
            return self.merge(self.split(self.tokens[b])) == [self.tokens[b]]
        least = len(self.ranks)
        atom = (-1, -1, -1)
        while True:
            across = self.ids_of_pair.get((a, b))
            if across is not None and across < least:
                return False
            (left, _, inner), (right, outer, _) = self.made.get(a, atom), self.made.get(b, atom)
            if left < 0 and right < 0:
                return True
            if left > right:
                least, a = left, inner
            else:
                least, b = right + 1, outer


class _Whole(dict):
    """Tokens of whole words, beside their tables."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        got = self.counter._walk(word)[-1]
        if len(word) <= KEPT_SIGNS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = got
        return got


class Counter:
    """Prefix tables of words, kept up to a number."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs, self.size = vocabulary, {}, len(vocabulary.ids) + 1
        self.tables: dict[str, np.ndarray] = {}
        self.whole = _Whole(self)
        #: Of the last word walked: bytes, and by place the last open token, the tokens up to it and those of the closed prefix.
        self.raw, self.last, self.count, self.closed = b"", [-1], [0], [0]
        newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.newer = regex.compile(f"[{newer}]")
        self.plain = regex.compile(WORD)
        letters, numbers, rest = r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"
        self.careful = regex.compile(
            WORD.replace(rest, rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])+").replace(letters, rf"(?:(?![{newer}])\p{{L}})+").replace(f"|{numbers}|", rf"|(?![{newer}])\p{{N}}|")
        )
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def _fits(self, a: int, b: int) -> bool:
        key = (a + 1) * self.size + b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.vocabulary.fits(a, b)
        return got

    def word(self, word: str) -> np.ndarray:
        """Tokens of each prefix of a word, from one sign to all."""
        table = np.array(self._walk(word), np.int32)
        if word in _LONG:
            table[1] = table[0] + self._walk(word[1])[0]
        return table

    def _walk(self, word: str) -> list[int]:
        """Tokens of each prefix of what is one word; what the last call found for a common beginning is taken up."""
        raw = word.encode()
        n, old, same = len(raw), self.raw, 0
        most = min(n, len(old))
        while same < most and raw[same] == old[same]:
            same += 1
        last, count, closed = self.last, self.count, self.closed
        del last[same + 1 :], count[same + 1 :], closed[same + 1 :]
        pairs, size, fits, root = self.pairs, self.size, self._fits, self.vocabulary.root
        for i in range(same + 1, n + 1):
            at, own, own_count, whole = root, -1, 0, 0
            j = i
            while j and (own < 0 or not whole):
                j -= 1
                node = at.get(raw[j])
                if node is None:
                    break
                k, end, at = node
                base = (last[j] + 1) * size
                if k >= 0 and own < 0:
                    got = pairs.get(base + k)
                    if got is None:
                        got = fits(last[j], k)
                    if got:
                        own, own_count = k, count[j] + 1
                if end >= 0 and not whole:
                    got = pairs.get(base + end)
                    if got is None:
                        got = fits(last[j], end)
                    if got:
                        whole = count[j] + 1
            if own < 0:
                raise ValueError("a byte that the vocabulary does not hold")
            last.append(own)
            count.append(own_count)
            closed.append(whole)
        self.raw = raw
        out = [closed[i] for i in range(1, n) if raw[i] & 0xC0 != 0x80]
        out.append(closed[n])
        if n > 4 * KEPT_SIGNS:
            self.raw, self.last, self.count, self.closed = b"", [-1], [0], [0]
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Takes the unknown words of texts in sorted order, so that they share the work of their beginnings."""
        new = set().union(*texts)
        for w in sorted(w for w in new if w not in self.whole and len(w) <= KEPT_SIGNS):
            self.whole[w]

    def table(self, word: str) -> np.ndarray:
        got = self.tables.get(word)
        if got is None:
            got = self.word(word)
            if len(word) <= KEPT_SIGNS:
                if len(self.tables) >= KEPT_TABLES:
                    self.tables.clear()
                self.tables[word] = got
        return got

    def normalize(self, text: str) -> str:
        """Composed, each sign lower-cased by itself."""
        text = unicodedata.normalize("NFC", text)
        for a, b in LOWER.items():
            text = text.replace(a, b)
        return text.lower()

    def words(self, signs: str) -> list[str]:
        """The words of a normalised text, as the vocabulary's file parts them."""
        return (self.careful if not signs.isascii() and self.newer.search(signs) else self.plain).findall(signs)

    def between(self, text: str) -> list[tuple[str, int]]:
        """The text's parts, and the length of the special string behind each (0 behind the last)."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out.append((text[at : m.start()], len(m[0])))
            at = m.end()
        return [*out, (text[at:], 0)]

    def read(self, text: str) -> list[tuple[str, list[str], int]]:
        """Signs, words and length of the special string behind, of each part."""
        parts = [(self.normalize(part), mark) for part, mark in self.between(text)]
        return [(signs, self.words(signs), mark) for signs, mark in parts]

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, self.read(text))

    def prefixes_of(self, texts: list[str]) -> list[Prefixes]:
        read = [self.read(t) for t in texts]
        self.learn([words for parts in read for _, words, _ in parts])
        return [Prefixes(self, parts) for parts in read]


class Prefixes:
    """Exact token counts of all prefixes of a text."""

    def __init__(self, counter: Counter, read: list[tuple[str, list[str], int]]):
        self.counter = counter
        #: Parts between special strings: (start, signs, words, tokens, length of the special string behind).
        self.parts: list[tuple[int, str, list[str], int, int]] = []
        self.base: list[int] = []  # tokens before each part
        start = total = 0
        for signs, words, mark in read:
            n = sum(map(counter.whole.__getitem__, words))
            self.parts.append((start, signs, words, n, mark))
            self.base.append(total)
            total += n + (mark > 0)
            start += len(signs) + mark
        self.total, self.length = total, start
        self._counts: np.ndarray | None = None

    def _inside(self, k: int) -> tuple[str, list[str]]:
        """Part ``k`` with all but the last sign of its special string read as ordinary text."""
        _, signs, _, _, mark = self.parts[k]
        special = next(s for s in self.counter.vocabulary.special if len(s) == mark) if mark else ""
        signs += special[: mark - 1] if mark else ""
        return signs, self.counter.words(signs)

    def count(self, i: int) -> int:
        """Tokens of the first ``i`` signs."""
        if i >= self.length:
            return self.total
        return int(self.counts()[i])

    def counts(self) -> np.ndarray:
        """Tokens of the prefixes of 0, 1, ... all signs, written out once."""
        if self._counts is None:
            self._counts = self._every()
        return self._counts

    def _every(self) -> np.ndarray:
        out = np.zeros(self.length + 1, np.int64)
        for k, (start, signs, words, _, mark) in enumerate(self.parts):
            if mark:
                signs, words = self._inside(k)
            part = np.zeros(len(signs) + 1, np.int64)
            at = total = 0
            for w in words:
                here = signs.index(w, at)
                part[at + 1 : here + 1] = total
                table = self.counter.table(w)
                at = here + len(w)
                part[here + 1 : at + 1] = total + table
                total += int(table[-1])
            part[at + 1 :] = total
            out[start + 1 : start + len(part)] = self.base[k] + part[1:]
            if mark:
                out[start + len(part)] = self.base[k] + self.parts[k][3] + 1
        return out

    def longest(self, budget: int) -> tuple[int, int]:
        """Signs and tokens of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return self.length, self.total
        if budget < 0:
            raise ValueError("a budget is not negative")
        if len(self.parts) > 1:  # beginnings of special strings are ordinary text
            counts = self.counts()
            i = int(np.flatnonzero(counts <= budget)[-1])
            return i, int(counts[i])
        _, signs, words, _, _ = self.parts[0]
        upto = list(accumulate(map(self.counter.whole.__getitem__, words), initial=0))
        k = bisect_right(upto, budget - 1) - 1 if budget else 0  # the last word that a token is left for
        at = 0
        for w in words[:k]:
            at = signs.index(w, at) + len(w)
        here = signs.index(words[k], at)
        fit = np.flatnonzero(self.counter.table(words[k]) <= budget - upto[k])
        if not len(fit):
            return here, upto[k]
        p = int(fit[-1])
        if p + 1 == len(words[k]) and k + 1 < len(words):  # white space behind costs nothing
            return signs.index(words[k + 1], here + p + 1), upto[k + 1]
        return here + p + 1, upto[k] + int(self.counter.table(words[k])[p])


@lru_cache(maxsize=1)
def _counter(data: bytes) -> Counter:
    """One a worker process; its stores are bounded."""
    return Counter(Vocabulary(data))


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_signs long, kept_tokens long"


def count_documents(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of each text, whether they are over ``limit``, and the longest prefix within it (signs of the normalised
    text, and tokens)."""
    share = documents.sparkSession.sparkContext.broadcast(read_model(documents.sparkSession, path))
    schema = pa_schema(SCHEMA)

    def run(batches):
        counter = _counter(share.value)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                texts = b.column(1).to_pylist()
                tables = counter.prefixes_of(texts)
                rows = [(len(t.encode()), p.total, p.total > limit, *p.longest(limit)) for t, p in zip(texts, tables, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(5))], schema=schema
                )

    return text_of(documents, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(frugal(run), SCHEMA)
