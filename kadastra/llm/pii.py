"""PII surrogates: keyed, type-consistent replacements with collision checks over the whole corpus.

``find`` marks e-mail addresses, phone numbers, cards and long numbers, social security numbers, IPv4
addresses, IBANs, secrets after words like ``token =``, and names after a title (with later bare mentions
of the same name in the document).  A surrogate depends on a key, the kind and the canonical entity only, so
an entity has one surrogate everywhere (coreference):

* structured entities go through a keyed permutation of all strings of the same shape: letters stay letters
  of their alphabet and case, digits digits, separators stay, Luhn-valid numbers stay valid, addresses stay
  public or private; two entities of a shape can't meet.  Long ones are permuted in blocks of ``BLOCK`` signs, each
  keyed by all before it, so that the time is in proportion to the length;
* name words become pronounceable words of the same script, case and gender.  A given name is one entity whatever title
  stands before it: its gender is that of any title with one in the corpus, and none if titles disagree.  Cyrillic family
  names keep the form they are in (a feminine one takes the surrogate of the masculine, in feminine form).

``registry`` collects the distinct entities of the corpus, and moves on to the next surrogate of an entity
whose surrogate belongs to another entity too or is itself an entity of the corpus, of whatever kind, until none is left.  After
``OWN_SHAPE`` surrogates of its own shape (at once if nothing in it can change) an entity takes wider ones, which
grow by a character or syllable with each further step, so a shape that is used up ends nothing.  The few
entities moved on are broadcast up to a checked number, else joined per document.

Defined cases: entities of any length are replaced whole; null text stays null and holds nothing; null ids are allowed; repeated rows change alike; an
empty table gives no rows; further columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, free_name, frugal, pa_schema

KEY = b"kadastra-surrogates"
#: Entities with a surrogate other than their first that may be broadcast.
BROADCAST_ENTITIES = 50_000
#: Surrogates of its own shape that an entity tries; later ones are wider.
OWN_SHAPE = 8
#: Signs that are permuted together.
BLOCK = 64
#: Longest entity whose surrogate a worker keeps.
KEPT_SIGNS = 256

#: Titles before a name and the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Sir": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Madame": "f",
    "Mademoiselle": "f", "Lady": "f", "Dr": "", "Prof": "", "Doctor": "", "Господин": "m", "Госпожа": "f",
}
#: Alphabets whose letters only take letters of the same alphabet.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "áàâäãåçéèêëíìîïñóòôöõúùûüß",
    "ÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_HEX = ({c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")},
        {c: ("0123456789ABCDEF", i) for i, c in enumerate("0123456789ABCDEF")})
#: Syllables for names, by script; endings by gender.
SYLLABLES = {
    "latin": ("ba be bi bo da de do fa fe ga go ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne no "
              "pa pe po ra re ri ro sa se so ta te ti to va ve vi wa we").split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до за зо ка ке ко ла ле ли ло ма ме ми на не но ра ре ри ро са се та те".split(),
    "greek": "βα βε γα γο δα δε ζα ζε θα θε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε τα τε".split(),
}
ENDINGS = {
    ("latin", "m"): ("nus", "ro", "ard", "mon"), ("latin", "f"): ("na", "lia", "ra", "sia"), ("latin", ""): ("ler", "dan", "mis", "ven"),
    ("cyrillic", "m"): ("мир", "лад", "ов"), ("cyrillic", "f"): ("на", "ла", "ова"), ("cyrillic", ""): ("ко", "ин"),
    ("greek", "m"): ("ος", "ης"), ("greek", "f"): ("να", "ρα"), ("greek", ""): ("ου", "ις"),
}

_LOCAL = re.compile(r"[\w.+%-]")
_DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
_SECRET = re.compile(
    r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-/+.]{8,})"
)
_HEXRUN = re.compile(r"(?<![0-9A-Za-z])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{2,4}(?:[.-]\d{2,4})?|\d{1,4}(?:[ .-]?\d{2,4}){1,4})|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
)
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_NUMBER = re.compile(r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)")
_NAME = re.compile(r"\b(" + "|".join(TITLES) + r")\b(\.?[  ]+)([^\W\d_][\w'’-]*(?:[  ][^\W\d_][\w'’-]*){0,2})")
_DIGIT = re.compile(r"\d")
_ASSIGN = re.compile(r"[=:]")


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the spans blotted out, so that no later match reaches into them."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in sorted(spans):
        out += [text[at:a], chr(1) * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses: from each ``@`` to the left over the local part, to the right over the domain.  No
    place is looked at for two signs, so a long run without blanks costs no more than others."""
    least = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > least and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        least = m.end() if m else at + 1
        if m:
            yield start, least
        at = text.find("@", least)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlaps; earlier kinds win."""
    found: list[tuple[int, int, str]] = []
    found += [(a, b, "email") for a, b in _emails(text)]
    if _ASSIGN.search(text):
        # a run of signs only ('Password: ________') hides nothing
        found += [(*m.span(1), "secret") for m in _SECRET.finditer(_without(text, found)) if any(c in _PLACE for c in m[1])]
    if _DIGIT.search(text):
        for pattern, kind in (
            (_HEXRUN, "secret"), (_IBAN, "iban"), (_IP, "ip"), (_PHONE, "phone"), (_SSN, "ssn"), (_NUMBER, "number")
        ):
            found += [
                (*m.span(), kind)
                for m in pattern.finditer(_without(text, found))
                if kind != "ip" or all(int(x) < 256 for x in m[0].split("."))
            ]
    names: dict[str, str] = {}  # name -> its kind, for given names with the genders of the titles before it
    left = None
    upto = 0
    while m := _NAME.search(text, upto):
        left = left or _without(text, found)
        upto, at, words = m.end(2), m.start(3), []
        for w in re.split("([ \xa0])", m[3]):
            if w.strip():
                if not w[0].isupper() or left[at] == chr(1) or w in TITLES:
                    break
                words.append(w)
                upto = at + len(w)
            at += len(w)
        for i, w in enumerate(words):
            # a family name has one surrogate whoever bears it
            kind = names.setdefault(w, "name-given-" if i < len(words) - 1 else "name-family-")
            if i < len(words) - 1 and kind.startswith("name-given-"):
                names[w] = "name-given-" + "".join(sorted({*kind[11:], *TITLES[m[1]]}))
    if names:
        one = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b")
        found += [(*m.span(), names[m[0]]) for m in one.finditer(left) if len(m[0]) > 1]
    return sorted(found)


def canonical(entity: str, kind: str) -> str:
    """What counts as the same entity: separators and letter case don't matter where they carry nothing."""
    if kind == "email":
        return entity.lower()
    if kind in ("phone", "number", "ssn", "iban"):
        return re.sub(r"[ .()-]", "", entity).upper()
    return entity.casefold() if kind.startswith("name") else entity


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permute(x: int, size: int, key: bytes, tweak: str, ok=lambda y: True) -> int:
    """A keyed permutation of the numbers below ``size`` for which ``ok`` holds (x among them)."""
    half = max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            left, right = right, left ^ (_number(key, tweak, r, right) & mask if half <= 128 else _wide(key, tweak, r, right) & mask)
        x = left << half | right
        if x < size and ok(x):
            return x


def _wide(key: bytes, tweak: str, r: int, x: int) -> int:
    out = 0
    for i in range(-(-x.bit_length() // 128) + 1):
        out = out << 128 | _number(key, tweak, r, i, x)
    return out


def shaped(s: str, key: bytes, tweak: str, places: dict = _PLACE) -> str:
    """Keyed permutation of the strings with the shape of ``s``.

    Two strings that first differ in some block get different ones there, as the blocks before it, by which it is keyed,
    are the same."""
    if len(s) <= BLOCK:
        return _shaped(s, key, tweak, places)
    before, out = hashlib.blake2b(key=key, digest_size=16), []
    for at in range(0, len(s), BLOCK):
        part = s[at : at + BLOCK]
        out.append(_shaped(part, key, f"{tweak}/{at}/{before.hexdigest()}", places))
        before.update(part.encode("utf-8", "surrogatepass"))
    return "".join(out)


def _shaped(s: str, key: bytes, tweak: str, places: dict) -> str:
    x, size = 0, 1
    for c in s:
        if c in places:
            alphabet, i = places[c]
            x, size = x * len(alphabet) + i, size * len(alphabet)
    if size < 2:
        return s
    y = permute(x, size, key, f"{tweak}/{size}")
    out = []
    for c in reversed(s):
        if c in places:
            alphabet = places[c][0]
            y, i = divmod(y, len(alphabet))
            c = alphabet[i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _fill(entity: str, letters: str) -> str:
    """``letters`` put into the places of the letters and digits of ``entity``, the rest behind them."""
    it = iter(letters)
    return "".join([next(it) if c.isalnum() else c for c in entity] + list(it))


def _address_class(x: int) -> int:
    a, b = x >> 24, x >> 16 & 255
    return 1 if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168 else 2 if a == 127 else 3 if a >= 224 else 0


def _drawn(n: int, alphabet: str, key: bytes, *parts: object) -> str:
    """``n`` keyed characters of ``alphabet``."""
    return "".join(alphabet[_number(key, *parts, i) % len(alphabet)] for i in range(n))


def _domain(canon: str) -> tuple[str, str, str]:
    """Local part, the part of the domain that changes, and the part that stays."""
    local, _, domain = canon.rpartition("@")
    head, dot, last = domain.rpartition(".")
    m = re.fullmatch(r"(.*?)((?:^|\.)example\.(?:com|net|org))", domain)
    return (local, m[1], m[2]) if m else (local, head, dot + last)


def _wider(canon: str, kind: str, key: bytes, step: int) -> str:
    """A keyed surrogate outside the entity's own shape, of the same kind; longer with each step from 0."""
    digits, small = ALPHABETS[0], ALPHABETS[1]
    draw = lambda n, alphabet, part="": _drawn(n, alphabet, key, "wider", kind, step, part, canon)
    if kind == "email":
        _, head, last = _domain(canon)
        return f"{draw(12 + step, small)}@{draw(8, small, 'domain') if head else ''}{last}"
    if kind == "ip":  # addresses have one length only: one of the IPv6 block for documents
        return "2001:db8:" + ":".join(draw(4, "0123456789abcdef", i) for i in range(6))
    if kind == "number":
        want = luhn(canon)
        body = draw(len(canon) + 1 + step, digits)
        return next(body + c for c in digits if luhn(body + c) == want)
    if kind == "iban":
        return canon[:2] + draw(2, digits, "check") + draw(len(canon) - 2 + step, digits + ALPHABETS[2])
    if kind == "secret":
        return draw(max(len(canon), 16) + 1 + step, digits + small)
    lead = canon[:2] if canon.startswith("+") else ""
    return lead + draw(len(canon) - len(lead) + 4 + step, digits)


#: Endings of masculine Cyrillic family names that take an "а" in the feminine.
_FAMILY = ("ов", "ев", "ёв", "ин", "ын")


def surrogate_of(canon: str, kind: str, key: bytes, attempt: int) -> str:
    """Surrogate of a canonical entity, in canonical form."""
    return (_kept if len(canon) <= KEPT_SIGNS else _surrogate_of)(canon, kind, key, attempt)


def _surrogate_of(canon: str, kind: str, key: bytes, attempt: int) -> str:
    tweak = f"{kind}/{attempt}"
    if not kind.startswith("name"):
        if attempt >= OWN_SHAPE:
            return _wider(canon, kind, key, attempt - OWN_SHAPE)
        fixed = len(_domain(canon)[2]) if kind == "email" else 0
        if not any(c in _PLACE for c in canon[: len(canon) - fixed]) and kind not in ("ip", "number"):
            return _wider(canon, kind, key, attempt)
    if kind == "email":
        local, head, last = _domain(canon)
        both = shaped(f"{local}@{head}", key, f"{tweak}/{last}")
        return both + last
    if kind == "ip":
        x = 0
        for part in canon.split("."):
            x = x << 8 | int(part)
        y = permute(x, 1 << 32, key, tweak, lambda v, c=_address_class(x): _address_class(v) == c)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone" and canon.startswith("+"):
        return canon[:2] + shaped(canon[2:], key, f"{tweak}/{canon[:2]}")
    if kind == "number":
        n, want = len(canon), luhn(canon)
        y = permute(int(canon), 10**n, key, f"{tweak}/{n}", lambda v: luhn(str(v).zfill(n)) == want)
        return str(y).zfill(n)
    if kind == "iban":
        return canon[:2] + shaped(canon[2:], key, f"{tweak}/{canon[:2]}")
    if kind == "secret":
        for places in _HEX:
            if all(c in places for c in canon):
                return shaped(canon, key, tweak, places)
    if kind.startswith("name"):
        _, part, gender = kind.split("-")
        script = "cyrillic" if re.search("[а-яё]", canon) else "greek" if re.search("[α-ω]", canon) else "latin"
        if part == "family" and canon.endswith(tuple(e + "а" for e in _FAMILY)):
            return surrogate_of(canon[:-1], kind, key, attempt) + "а"
        x = _number(key, part, attempt, canon)
        syllables, out = SYLLABLES[script], ""
        for _ in range(3 + max(0, attempt - OWN_SHAPE + 1)):
            x, i = divmod(x, len(syllables))
            out += syllables[i]
        ends = ENDINGS[script, gender if part == "given" and gender in ("m", "f") else ""]
        if part == "family" and canon.endswith(_FAMILY):
            ends = _FAMILY
        return out + ends[x % len(ends)]
    return shaped(canon, key, tweak)


_kept = lru_cache(maxsize=1 << 14)(_surrogate_of)


def show(surrogate: str, entity: str, kind: str) -> str:
    """A canonical surrogate in the format of the mention."""
    if kind in ("phone", "number", "ssn", "iban"):
        return _fill(entity, surrogate.removeprefix("+"))
    if kind == "email" and entity != entity.lower():
        return surrogate.upper() if entity == entity.upper() else surrogate
    if kind.startswith("name"):
        return surrogate.upper() if entity.isupper() and len(entity) > 1 else surrogate.title()
    return surrogate


def base_kind(kind: str) -> str:
    """The kind without the genders that titles tell."""
    return "name-given-" if kind.startswith("name-given-") else kind


def replace(text: str, settled: dict[tuple[str, str], tuple[str, int]], key: bytes = KEY) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans that were replaced (in the old text).  ``settled`` has kind and attempt of
    entities for which they are not those that the text itself gives."""
    spans, out, at = find(text), [], 0
    for a, b, kind in spans:
        canon = canonical(text[a:b], kind)
        own, attempt = settled.get((base_kind(kind), canon), (kind, 0))
        out += [text[at:a], show(surrogate_of(canon, own, key, attempt), text[a:b], kind)]
        at = b
    return "".join([*out, text[at:]]) if spans else text, spans


def _row_key() -> Column:
    """Key of a row, with a null id too; rows that share one only look up each other's moved entities besides."""
    return F.xxhash64("doc_id", "text")


def _entities(docs: DataFrame) -> DataFrame:
    """row_key, kind, canon of each document's distinct entities."""
    schema = pa_schema("row_key long, kind string, canon string")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or ""
                rows += [(i, k, c) for k, c in sorted({(k, canonical(t[a:b], k)) for a, b, k in find(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema[j].type) for j in range(3)], schema=schema)

    return docs.select(_row_key(), "text").mapInArrow(frugal(run), "row_key long, kind string, canon string")


def _assign(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate to (kind, canon, attempt)."""
    schema = pa_schema("kind string, canon string, attempt int, surrogate string")

    def run(batches):
        for b in batches:
            k, c, n = (b.column(i).to_pylist() for i in range(3))
            s = [surrogate_of(y, x, key, z) for x, y, z in zip(k, c, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), pa.array(n, pa.int32()), pa.array(s, pa.string())], schema=schema)

    return entities.select("kind", "canon", "attempt").mapInArrow(frugal(run), "kind string, canon string, attempt int, surrogate string")


def _shown(c: str) -> Column:
    """What two texts of any kind are compared by."""
    return F.regexp_replace(F.lower(c), r"^\+", "")


def registry(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """base, kind, canon, attempt, surrogate, mixed: one row an entity, surrogates distinct and no entity of the corpus.

    kind has the gender settled for a given name; ``mixed`` tells that some document by itself would take another."""
    base = F.when(F.col("kind").startswith("name-given-"), "name-given-").otherwise(F.col("kind"))
    sexes = F.when(F.col("kind").startswith("name-given-"), F.substring("kind", 12, 2))
    m, f = (F.max(F.coalesce(F.contains(sexes, F.lit(x)), F.lit(False))) for x in "mf")
    known = cut(
        found.groupBy(base.alias("base"), "canon")
        .agg(m.alias("m"), f.alias("f"), (F.min("kind") != F.max("kind")).alias("mixed"))
        .withColumn("kind", F.when(F.col("base") != "name-given-", F.col("base")).otherwise(F.concat("base", F.when(F.expr("f and not m"), "f").when(F.expr("m and not f"), "m").otherwise(""))))
        .select("base", "kind", "canon", "mixed")
    )
    all_of = cut(_assign(known.withColumn("attempt", F.lit(0)), key).withColumn("shown", _shown("surrogate")))
    real = known.select(_shown("canon").alias("shown"))
    new = all_of
    while True:
        # only what is new can be an entity of the corpus or meet another surrogate; of those that meet, the settled one stays
        met = all_of if new is all_of else all_of.join(new.select("shown").distinct(), "shown", "left_semi")
        who = F.struct("attempt", "canon", "kind")
        twice = met.groupBy("shown").agg(F.count("*").alias("n"), F.min(who).alias("first")).filter("n > 1")
        bad = cut(
            met.join(twice, "shown").filter(who != F.col("first")).select("kind", "canon", "attempt")
            .unionByName(new.join(real, "shown", "left_semi").select("kind", "canon", "attempt"))
            .distinct()
        )
        if bad.isEmpty():
            return known.join(all_of.drop("shown"), ["kind", "canon"])
        new = cut(_assign(bad.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key).withColumn("shown", _shown("surrogate")))
        all_of = cut(all_of.join(bad, ["kind", "canon"], "left_anti").unionByName(new))


def replace_entities(
    documents: DataFrame, key: bytes = KEY, broadcast_limit: int = BROADCAST_ENTITIES, report: bool = True
) -> DataFrame:
    """``documents`` with surrogates in ``text``; with ``report`` n_entities (int) and kinds (string) at the end, in
    place of columns of these names."""
    if report:
        documents = documents.drop("n_entities", "kinds")
    found = _entities(documents)
    moved = cut(registry(found, key).filter("attempt > 0 or mixed").select("base", "canon", "kind", "attempt"))
    n = moved.count()
    spark, names = documents.sparkSession, documents.columns
    own_key, own_moved = free_name(documents, "row_key"), free_name(documents, "moved")
    if n <= broadcast_limit:
        fixed = {(r.base, r.canon): (r.kind, r.attempt) for r in moved.collect()}
        docs = documents.withColumn(own_moved, F.lit(None).cast("array<struct<base:string,canon:string,kind:string,attempt:int>>"))
    else:
        fixed = {}
        of_doc = (
            found.withColumn("base", F.when(F.col("kind").startswith("name-given-"), "name-given-").otherwise(F.col("kind")))
            .drop("kind").join(moved, ["base", "canon"])
            .groupBy(F.col("row_key").alias(own_key))
            .agg(F.collect_set(F.struct("base", "canon", "kind", "attempt")).alias(own_moved))
        )
        docs = documents.join(of_doc, _row_key() == F.col(own_key), "left").drop(own_key)
    share = spark.sparkContext.broadcast(fixed)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StringType, StructType

    kept = StructType([*documents.schema.fields])
    if report:
        kept = kept.add("n_entities", IntegerType()).add("kinds", StringType())
    schema = to_arrow_schema(kept)
    at_text, at_moved = names.index("text"), len(names)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                texts, counts, kinds = [], [], []
                for t, own in zip(b.column(at_text), b.column(at_moved), strict=True):
                    t, own = t.as_py(), own.as_py()
                    settled = share.value if not own else {(x["base"], x["canon"]): (x["kind"], x["attempt"]) for x in own}
                    new, spans = replace(t, settled, key) if t is not None else (None, [])
                    texts.append(new)
                    counts.append(len(spans))
                    kinds.append(",".join(sorted({k.split("-")[0] for _, _, k in spans})))
                cols = [b.column(i).cast(schema[i].type) for i in range(len(names))]
                cols[at_text] = pa.array(texts, schema[at_text].type)
                if report:
                    cols += [pa.array(counts, pa.int32()), pa.array(kinds, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(frugal(run), kept)
