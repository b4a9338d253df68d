"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search keeps, for each boundary of a window no longer than the longest piece, the best path that ends
there.  Whenever all surviving paths run through one boundary, the ids before it are committed and dropped.
Unigram models keep the path of the highest score.  In BPE models the merges leave exactly one path at each
boundary: a piece may follow another if and only if merging the two alone gives the two back; so the ids are
those of the merge algorithm.  The pieces that end at a boundary come from one automaton over the vocabulary, a step a
sign, from the longest down.

Places that no piece of the vocabulary spans (before a word's leading blank, between a letter and a stop) are boundaries
that all paths share, so texts are parted there and the stream starts anew; what it gives for a stretch between two of
them is kept for the task in a bounded store, as words recur.  Every stretch goes through ``Stream``, and nothing else
finds pieces.
Missing characters fall back to byte pieces.

The vocabulary file's path is a parameter; the bytes are read through Spark, so any store will do.

Defined cases: null and empty texts have no ids; any text decodes to itself, but for the sign U+2581, which
stands for a blank in such models and comes back as one; repeated rows give equal ids; an empty table gives
no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, pa_schema, text_of

#: The public vocabulary used where no path is given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Values fixed by the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLANK = "▁"
#: Stretches and pairs of pieces that a task keeps (some 100 and 20 MB); a full store is emptied, which changes no id.
KEPT_STRETCHES, KEPT_PAIRS = 1 << 19, 1 << 18
#: Stretches of more signs are not kept.
KEPT_SIGNS = 64
#: Texts are parted together up to so many signs, or one by one where longer.
PARTED_SIGNS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            size = varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.dummy_prefix, self.trim = UNIGRAM, True, True
        charsmap = b""
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(got.get(2, 0.0))
                self.kinds.append(got.get(3, NORMAL))
            elif number == 2:
                self.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                charsmap, self.dummy_prefix, self.trim = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if charsmap or self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a character map are read")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = [next((i for i, p in enumerate(self.pieces) if p == f"<0x{b:02X}>"), 0) for b in range(256)]
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.longest = max(map(len, self.ids))
        self._automaton()
        self._made: dict[str, tuple[float, str, str] | None] = {}
        self.parting = self._parting()
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        #: Pairs of pieces and whether one may follow the other, as far as asked; at most ``KEPT_PAIRS``.
        self.pairs: dict = {}
        self._raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(BLANK, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def _automaton(self) -> None:
        """States are the beginnings of pieces: [state by next sign, state of the longest other beginning that ends alike,
        longest piece that ends alike or -1].  ``shorter`` has for a piece the next shorter one that ends alike or -1."""
        self.root: list = [{}, None, -1]
        self.shorter, self.length = [-1] * len(self.pieces), list(map(len, self.pieces))
        for p, i in self.ids.items():
            at = self.root
            for c in p:
                at = at[0].setdefault(c, [{}, self.root, -1])
            at[2] = i
        level = list(self.root[0].values())
        while level:
            below = []
            for state in level:
                for c, to in state[0].items():
                    alike = state[1]
                    while alike and c not in alike[0]:
                        alike = alike[1]
                    to[1] = alike[0][c] if alike else self.root
                    if to[2] < 0:
                        to[2] = to[1][2]
                    else:
                        self.shorter[to[2]] = to[1][2]
                    below.append(to)
            level = below

    def _parting(self) -> re.Pattern:
        """Finds stretches between places that no piece spans: signs are of one group if some piece has them side by side,
        so no piece spans two groups.  Blanks lead the stretch behind them where no piece has one behind another sign."""
        leads = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        group: dict[str, set[str]] = {}
        for a, b in {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}:
            if leads and a == BLANK:
                continue
            x, y = sorted((group.setdefault(a, {a}), group.setdefault(b, {b})), key=len)
            if x is not y:
                y |= x
                group.update(dict.fromkeys(x, y))
        groups = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
        groups[7:] = [set().union(*groups[7:])] if groups[7:] else []  # some together, which parts less
        runs = "".join(f"[{''.join(map(re.escape, sorted(g)))}]+|" for g in groups)
        return re.compile(f"{BLANK}*+(?:{runs}[^{BLANK}])|{BLANK}+" if leads else f"{runs}.", re.DOTALL)

    def normalize(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    def merge(self, s: str) -> list[str]:
        """The merge algorithm itself, on short strings: best score first, leftmost among equals."""
        parts, ids, scores = list(s), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def made(self, piece: str) -> tuple[float, str, str] | None:
        """Score and parts of the last merge that makes a piece; parts are empty for one sign; None where merges make none."""
        if piece not in self._made:
            got: tuple[float, str, str] | None = (float("inf"), "", "")
            if len(piece) > 1:
                parts, got = list(piece), None
                while len(parts) > 1:
                    steps = [(-self.scores[k], i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None]
                    if not steps:
                        break
                    i = min(steps)[1]
                    got = (self.scores[self.ids[parts[i] + parts[i + 1]]], parts[i], parts[i + 1])
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                got = got if len(parts) == 1 else None
            self._made[piece] = got
        return self._made[piece]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging the two alone keeps them; with an empty ``a``, whether merges can build ``b``.

        Merges at the seam are undone from the last back: a merge across it that would have come before the one just
        undone (of equal score: farther left) rules the pair out."""
        right = self.made(b)
        if not a or right is None:
            return right is not None
        left = self.made(a)
        if left is None:
            return False
        floor, tied = -float("inf"), False
        while True:
            k = self.ids.get(a + b)
            if k is not None and (self.scores[k] > floor or tied and self.scores[k] == floor):
                return False
            if not left[1] and not right[1]:
                return True
            if left[1] and (not right[1] or left[0] < right[0]):  # the left one's merge came later
                floor, tied, a = left[0], False, left[2]
                left = self.made(a)
            else:
                floor, tied, b = right[0], True, right[1]
                right = self.made(b)

    def fallback(self, piece: str) -> list[int]:
        return [self.bytes[b] for b in piece.encode()] if self.bytes[0] else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        return Encoder(self).encode(text)

    def decode(self, ids) -> str:
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Stream:
    """Takes signs, keeps the best path to each boundary of its window, yields committed pieces as (id, sign).

    id is -1 for a sign that is no piece, else sign is empty.  A boundary has the start of its last piece (-1: not
    reached), that piece (-1: none, at the start; -2 less the sign's number: a sign that is none), the path's score and the
    automaton's state; boundaries before the window are forgotten.  The window of the last run is taken up again as far as
    its signs are the same, so runs in sorted order share the work of common beginnings."""

    def __init__(self, model: Model):
        self.model, self.pairs = model, model.pairs
        self.widest = 0  # most boundaries held at once
        self.last = ""  # signs of the last run, if its window goes back to the beginning
        self.window = [(0, -1, 0.0, model.root)]

    def _fits(self, before: int, k: int) -> bool:
        """Whether piece ``k`` may come after a boundary's last piece."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        m = self.model
        a = m.pieces[before] if before >= 0 else chr(-2 - before) if before < -1 else ""
        got = self.pairs[before * len(m.pieces) + k] = m.may_follow(a, m.pieces[k])
        return got

    def run(self, signs: str) -> Iterator[tuple[int, str]]:
        for path in self.paths(signs):
            yield from ((k, "") if k >= 0 else (-1, chr(-2 - k)) for k in path)

    def paths(self, signs: str) -> Iterator[list[int]]:
        """The committed pieces, some at a time, as boundaries have them."""
        m = self.model
        ids, longest, bpe, scores, size = m.ids, m.longest, m.model_type == BPE, m.scores, len(m.pieces)
        known, shorter, length, root = self.pairs.get, m.shorter, m.length, m.root
        base = same = 0  # the window's boundary j lies behind sign base + j
        for a, b in zip(signs, self.last, strict=False):
            if a != b:
                break
            same += 1
        window = self.window[: same + 1]
        state = window[-1][3]
        for i in range(same, len(signs)):
            c = signs[i]
            while state and c not in state[0]:
                state = state[1]
            state = state[0][c] if state else root
            at, k, best, n, found = -1, -1, 0.0, i + 1 - base, state[2]
            while found >= 0:
                w = n - length[found]
                if w >= 0 and (left := window[w])[0] >= 0:
                    if bpe:
                        fits = known(left[1] * size + found)
                        if fits or fits is None and self._fits(left[1], found):
                            at, k = w, found
                            break
                    elif at < 0 or left[2] + scores[found] > best:  # of equal ones the longest
                        at, k, best = w, found, left[2] + scores[found]
                found = shorter[found]
            if (at < 0 or not bpe) and c not in ids:
                left = window[n - 1]
                if left[0] >= 0 and (at < 0 or left[2] + m.lowest > best):
                    at, k, best = n - 1, -2 - ord(c), left[2] + m.lowest
            window.append((at, k, best, state))
            if n >= 2 * longest and n % longest == 0:
                self.widest = max(self.widest, n)
                # paths that can go on end at one of the last boundaries: follow them back until they are one
                alive = {j for j in range(n - longest + 1, n + 1) if window[j][0] >= 0}
                while len(alive) > 1:
                    j = max(alive)
                    alive.remove(j)
                    alive.add(window[j][0])
                if alive and (j := alive.pop()) > 0:
                    yield self._path(window, j)
                    base += j
                    _, k, best, to = window[j]
                    window = [(0, k, 0.0, to)] + [(x - j if x >= j else -1, k, y - best, to) for x, k, y, to in window[j + 1 :]]
        if base or len(signs) > KEPT_SIGNS:
            self.last, self.window = "", [(0, -1, 0.0, root)]
        else:
            self.last, self.window = signs, window
        yield self._path(window, len(window) - 1)

    @staticmethod
    def _path(window: list[tuple], j: int) -> list[int]:
        out = []
        while j > 0:
            j, k, _, _ = window[j]
            out.append(k)
        out.reverse()
        return out


class Encoder:
    """Ids of texts, by one ``Stream`` a stretch, with the task's bounded store."""

    def __init__(self, model: Model):
        self.model, self.known, self.stream = model, {}, Stream(model)

    def _run(self, s: str) -> bytes:
        """Ids, as 32-bit numbers, of signs between two places that no piece spans."""
        got = self.known.get(s)
        if got is None:
            out = array("i")
            for path in self.stream.paths(s):
                if min(path, default=0) < 0:
                    path = [i for k in path for i in ((k,) if k >= 0 else self.model.fallback(chr(-2 - k)))]
                out.extend(path)
            got = out.tobytes()
            if len(s) <= KEPT_SIGNS:
                if len(self.known) >= KEPT_STRETCHES:
                    self.known.clear()
                self.known[s] = got
        return got

    def _parts(self, text: str) -> list[str]:
        return self.model.parting.findall(self.model.normalize(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._run, self._parts(text))), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; unknown stretches are taken in sorted order first."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            rows, new, signs = [], set(), 0
            while not rows or at < len(texts) and signs + len(texts[at]) <= PARTED_SIGNS:
                parts = self._parts(texts[at])
                got = list(map(self.known.get, parts))
                unknown = [i for i, ids in enumerate(got) if ids is None]
                new.update(map(parts.__getitem__, unknown))
                rows.append((parts, got, unknown))
                signs, at = signs + len(texts[at]), at + 1
            fresh = {s: self._run(s) for s in sorted(new)}
            for parts, got, unknown in rows:
                for i in unknown:
                    got[i] = fresh[parts[i]]
                out.append(np.frombuffer(b"".join(got), np.int32))
        return out


@lru_cache(maxsize=1)
def _model(data: bytes) -> Model:
    """One model a worker process, with its bounded table of pairs; the stretches kept go with the task's ``Encoder``."""
    return Model(data)


def read_model(spark: SparkSession, path: str) -> bytes:
    url = path if "://" in path else f"file://{path}"
    try:
        return bytes(spark.read.format("binaryFile").load(url).select("content").first()[0])
    except Exception:
        if "://" in path:
            raise
        with open(path, "rb") as f:  # a file of the driver alone
            return f.read()


SCHEMA = "doc_id long, n_tokens long, ids array<int>, n_chars long, round_trip boolean"


def encode_documents(documents: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_tokens, ids, n_chars and whether decoding the ids gives the text back."""
    share = documents.sparkSession.sparkContext.broadcast(read_model(documents.sparkSession, path))
    schema = pa_schema(SCHEMA)

    def run(batches):
        model = _model(share.value)
        encoder = Encoder(model)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                texts = b.column(1).to_pylist()
                ids = encoder.encode_all(texts)
                back = [model.decode(i.tolist()) == t.replace(BLANK, " ") for i, t in zip(ids, texts, strict=True)]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(i) for i in ids], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(schema.field(2).type),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(back, pa.bool_())], schema=schema)

    return text_of(documents, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(frugal(run), SCHEMA)
