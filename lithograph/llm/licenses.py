"""Licence scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

A text is lower-cased (A-Z) and cut into runs of letters, digits and non-ASCII characters. One Aho-Corasick automaton
finds every notice phrase and identifier tag as consecutive words. Behind an identifier tag the raw text is parsed as an
expression of identifiers with OR, AND, WITH and parentheses; the parser stops where the expression ends. A tag counts where a colon or an
equals sign follows it and the expression starts with a licence (a name that has a rank here, a LicenseRef, a name with a version); other words
give no label.

score: how freely the document may be used, from 0 to 1. A licence scores by PERMISSION (unknown ones 0.3), OR takes the
better side, AND the worse, WITH adds 0.1 for the exception; the document takes the least of all it states, and 0 if it
states none.

A map over rows: nothing is shuffled, and a task holds a few hundred texts. Defined cases: a null or empty text has no
words and no labels (empty strings); repeated rows give repeated rows; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lithograph.llm.text import text_batches

# Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, with their labels.
NOTICES = {
    "the mit license": "mit",
    "mit licensed": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache 2 0 license": "apache-2",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
# How freely a text under the licence may be used.
PERMISSION = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsd-2-clause": 0.95, "bsd-3-clause": 0.95, "apache-2": 0.9, "cc-by": 0.9,
    "mpl-2": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.5, "gpl-3": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.3
RANK = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# a tag as its words, however they are joined; the expression may be quoted or stand on the next line
_TAG = re.compile(rb"(?:spdx[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+identifier|license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+expression)"
                  rb"[\"'`]?[ \t]*[:=]+[ \t]*(?:\r?\n[ \t#*/;-]*)?[\"'`<\[]*([^\r\n]*)", re.I)
_NAMED = re.compile(r"licenseref-.+|[a-z][a-z0-9.]*(?:-[a-z0-9.]+)*-v?\d[\d.]*(?:-[a-z-]+)?", re.I)  # a licence that has no rank here, but the form of an identifier
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


def label_of(identifier: str) -> str:
    """The label of an identifier: lower case, without "-only", "-or-later", "+" and a version's zero."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower().rstrip(".:-"))
    name = re.sub(r"^(cc-by(?:-nc)?(?:-sa|-nd)?|cc0)-\d\.\d$", r"\1", name)
    name = re.sub(r"^(lgpl|agpl)-\d(\.\d)?$", r"\1", name)
    return re.sub(r"\.0$", "", name)


def is_licence(identifier: str) -> bool:
    """Whether a word names a licence: one that has a rank here, a LicenseRef, or a name with a version."""
    return label_of(identifier) in PERMISSION or _NAMED.fullmatch(identifier) is not None


def to_postfix(text: str) -> list[str]:
    """The longest expression at the start of text, in postfix order (shunting-yard); [] if there is none."""
    out: list[str] = []
    ops: list[str] = []
    sound: list[str] = []
    operand_next, at = True, 0
    while m := _TOKEN.match(text, at):
        at, word = m.end(), m[1]
        low = word.lower()
        if low in RANK:
            if operand_next:
                break
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand_next = True
        elif word == "(":
            if not operand_next:
                break
            ops.append(word)
        elif word == ")":
            if operand_next or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if not operand_next:
                break
            out.append(word)
            operand_next = False
        if not operand_next and "(" not in ops:
            sound = out + ops[::-1]
    return sound


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels that an expression names, and how freely it lets a text be used."""
    stack: list[tuple[set[str], float]] = []
    for word in postfix:
        if word in RANK:
            (right, r), (left, l) = stack.pop(), stack.pop()
            stack.append((left, min(1.0, l + 0.1)) if word == "with" else (left | right, max(l, r) if word == "or" else min(l, r)))
        else:
            label = label_of(word)
            stack.append(({label}, PERMISSION.get(label, UNKNOWN)))
    return stack[-1] if stack else (set(), 1.0)


def automaton() -> ahocorasick.Automaton:
    """One automaton for phrases and tags, each between spaces."""
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {t: "" for t in TAGS})):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label))
    made = ahocorasick.Automaton()
    for phrase, what in found.items():
        made.add_word(phrase, (len(phrase), what))
    made.make_automaton()
    return made


def scan_text(text: bytes, finder: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    base, starts, labels, tagged = set(), [], set(), False
    blanks, seen = 0, 0  # blanks before `seen`
    for end, (length, what) in finder.iter(line.decode("latin-1")):
        for kind, label in what:
            if kind == "base":
                base.add(label)
                starts.append((end - length + 1, length))
            elif kind == "notice":
                labels.add(label)
            else:
                tagged = True
    starts.sort()
    for i, (at, _) in enumerate(starts):
        blanks, seen = blanks + line.count(b" ", seen, at), at
        starts[i] = blanks
    labels |= base
    scores = [PERMISSION.get(x, UNKNOWN) for x in labels]
    if tagged:
        for m in _TAG.finditer(text):
            postfix = to_postfix(m[1].decode("utf-8", "replace"))
            named, score = evaluate(postfix)
            if postfix and is_licence(postfix[0]):
                named = {label_of(x) for x in postfix if x not in RANK and is_licence(x)} & named
                labels |= named
                scores.append(score)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


def _scan(batches):
    finder = automaton()
    for part, texts in text_batches(batches):
        columns = list(zip(*(scan_text(t or b"", finder) for t in texts), strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return docs.select("doc_id", "text").mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
