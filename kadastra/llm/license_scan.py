"""Licence scan: Aho-Corasick over notice phrases and identifier tags, shunting-yard for expressions.

``scan(text)`` works on one text, ``scan_documents(df)`` on a table.  The text is cut into words
(lower-cased A-Z; a word is a run of letters, digits and bytes from 0x80), the words are joined by
single blanks, and one automaton finds every phrase at once, overlaps included.  An identifier tag is
a phrase too; the text behind the place that the automaton gives is parsed as a licence expression up to the end of the
line: ``or`` binds weakest, then ``and``, then ``with``; brackets group.  Behind the tag and its colon any well-formed
identifier is the first operand.  Further ones, where prose may follow, are identifiers of a list (``LICENSES``,
``EXCEPTIONS`` behind ``with``), of the forms ``LicenseRef-x`` and ``DocumentRef-x:LicenseRef-y``, or words that hold a hyphen
and a digit (``x-exception`` behind ``with``); the first word that is none ends the expression, and operators left before it go.
An identifier outside the list is a label of its own and is not allowed.

Defined cases: null text is an empty text; a text without words has ``n_words`` 0, null positions,
empty labels and score 0; a malformed expression gives the label ``spdx-invalid``; repeated rows are
scanned each for itself; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from ._common import WORD_TABLE, map_rows, text_of

#: Phrases of the base contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, in words as the scanner sees them.
NOTICE = {
    "bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "licensed under the": "licensed-under",
    "permission is hereby granted free of charge": "mit-grant",
    "redistribution and use in source and binary forms": "bsd-grant",
    "without warranty of any kind": "no-warranty",
}
#: The tag in front of an expression.
TAG = "spdx license identifier"
#: Licences (lower case) under which a text may be kept; the evaluation asks for these.
ALLOWED = frozenset(
    "mit apache-2.0 bsd-2-clause bsd-3-clause isc zlib unlicense cc0-1.0 cc-by-4.0 0bsd bsl-1.0 python-2.0".split()
)
#: Licence identifiers in wide use, lower case.
LICENSES = ALLOWED | frozenset(
    "0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apsl-2.0 artistic-1.0 "
    "artistic-2.0 blueoak-1.0.0 bsd-3-clause-clear bsd-4-clause cal-1.0 cc-by-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 "
    "cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 "
    "gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 "
    "gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 jasper-2.0 json lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng-2.0 lppl-1.3c mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl "
    "mulanpsl-2.0 ncsa ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-3.0 "
    "unicode-dfs-2016 upl-1.0 vim w3c wtfpl x11 zpl-2.1".split()
)
#: Exceptions that may stand behind ``with``, lower case.
EXCEPTIONS = frozenset(
    "autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 "
    "font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-3.0-linking-exception libtool-exception "
    "linux-syscall-note llvm-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 swift-exception "
    "universal-foss-exception-1.0 wxwindows-exception-3.1".split()
)
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:\-]*))")
_COLON = re.compile(r"[ \t]*:?")
#: A word of the lower-cased text, and of the text as it is.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, expressions array<string>, allowed boolean"
)


def is_operand(word: str, behind_with: bool) -> bool:
    low = word.lower()
    if behind_with:
        return low in EXCEPTIONS or "-exception" in low
    return low.removesuffix("+") in LICENSES or bool(_OWN.fullmatch(low)) or "-" in low and any(c.isdigit() for c in low)


def tokens(line: str, at: int = 0, end: int | None = None, tagged: bool = False) -> list[str]:
    """Tokens of an expression at the start of ``line``; stops where no expression goes on, so prose behind it is not
    taken in.  ``tagged``: the first operand may be any identifier."""
    out: list[str] = []
    while m := _TOKEN.match(line, at, len(line) if end is None else end):
        t = m[1] or m[2].rstrip(".:-")
        low = t.lower()
        last = out[-1].lower() if out else ""
        if low not in _PRECEDENCE and t not in "()":
            if last and last not in _PRECEDENCE and last != "(":
                break
            if not (is_operand(t, last == "with") or tagged and all(x == "(" for x in out)):
                break
        elif t == ")" and out.count("(") <= out.count(")"):
            break
        out.append(t)
        at = m.end()
    while len(out) > 1 and out[-1].lower() in _PRECEDENCE:
        out.pop()
    return out


def to_postfix(toks: list[str]) -> list[str] | None:
    """Shunting yard.  None when the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    want_operand = True
    for t in toks:
        low = t.lower()
        if t == "(":
            if not want_operand:
                return None
            stack.append(t)
        elif t == ")":
            if want_operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _PRECEDENCE:
            if want_operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            want_operand = True
        else:
            if not want_operand:
                return None
            out.append(low)
            want_operand = False
    if want_operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[bool, str, list[str]] | None:
    """(is it allowed, normal form, licence names); None when ``with`` joins what it may not join."""
    stack: list[tuple[bool, str, list[str], bool]] = []
    for t in postfix:
        if t not in _PRECEDENCE:
            stack.append((t.removesuffix("+") in allowed, t, [t], True))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            if not (a[3] and b[3]):
                return None
            stack.append((a[0], f"{a[1]} WITH {b[1]}", a[2], False))
        else:
            ok = a[0] or b[0] if t == "or" else a[0] and b[0]
            stack.append((ok, f"({a[1]} {t.upper()} {b[1]})", a[2] + b[2], False))
    ok, form, names, _ = stack.pop()
    return ok, form, names


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *NOTICE.items(), (TAG, None)]:
        auto.add_word(f" {phrase} ", (len(phrase.split()), label, phrase in BASE))
    auto.make_automaton()
    return auto


def scan(text: str, auto: ahocorasick.Automaton) -> dict:
    words = text.encode().translate(WORD_TABLE).split()
    line = f" {b' '.join(words).decode()} "
    starts, base, labels, exprs, tags = [], set(), set(), [], []
    at = seen = 0
    for end, (k, label, is_base) in auto.iter(line):
        seen += line.count(" ", at, end)
        at = end
        if is_base:
            starts.append(seen - k)
            base.add(label)
        if label is None:
            tags.append(seen - 1)  # the tag's last word
        else:
            labels.add(label)
    allowed = None
    if tags:
        wanted = iter(tags)
        tag = next(wanted)
        for i, m in enumerate(_RAW_WORD.finditer(text)):
            if i < tag:
                continue
            line_end = text.find("\n", m.end())
            colon = _COLON.match(text, m.end())
            post = to_postfix(tokens(text, colon.end(), len(text) if line_end < 0 else line_end, colon[0].endswith(":")))
            got = evaluate(post) if post else None
            if got is None:
                labels.add("spdx-invalid")
            else:
                allowed = got[0] if allowed is None else allowed and got[0]
                exprs.append(got[1])
                labels.update(f"spdx:{x}" for x in got[2])
            if (tag := next(wanted, None)) is None:
                break
    notices = len(labels)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 if exprs else 1.0 - 0.5**notices,
        "expressions": exprs,
        "allowed": allowed,
    }


def scan_documents(df: DataFrame) -> DataFrame:
    """One row a document: word count, base places, labels, expressions and their evaluation."""

    def make():
        auto = automaton()

        def run(cols):
            rows = [scan(t, auto) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {k: [r[k] for r in rows] for k in SCHEMA_KEYS}

        return run

    return map_rows(text_of(df, "doc_id"), make, SCHEMA)


SCHEMA_KEYS = "n_words n_base first_word last_word base_labels labels score expressions allowed".split()
