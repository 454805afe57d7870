"""License scans: notice phrases and identifier tags by Aho-Corasick, licence
expressions by a shunting-yard parser.

Each text becomes its lower-cased words, one blank apart, and one automaton of
all phrases runs over it, so a text is read once whatever the number of
phrases. A tag phrase that a colon follows introduces an expression such as
``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``; it is
parsed in the text itself, with ``with`` before ``and`` before ``or``, and
evaluated to labels, certainty and strictness.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.llm.arrow import text_slices

# Fixed values. (words, label, certainty that the text carries this licence)
BASE = (
    ("mit license", "mit", 0.8),
    ("apache license", "apache", 0.8),
    ("general public license", "gpl", 0.8),
)
NOTICES = (
    ("affero general public license", "agpl", 0.8),
    ("all rights reserved", "proprietary", 0.4),
    ("boost software license", "boost", 0.8),
    ("bsd license", "bsd", 0.8),
    ("cc by", "cc-by", 0.6),
    ("cc by nc", "cc-by-nc", 0.8),
    ("cc by nc nd", "cc-by-nc-nd", 0.8),
    ("cc by nc sa", "cc-by-nc-sa", 0.8),
    ("cc by nd", "cc-by-nd", 0.8),
    ("cc by sa", "cc-by-sa", 0.8),
    ("cc0 1 0", "cc0", 0.8),
    ("creative commons attribution", "cc-by", 0.8),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.8),
    ("creative commons attribution sharealike", "cc-by-sa", 0.8),
    ("dedicated to the public domain", "public-domain", 0.6),
    ("eclipse public license", "epl", 0.8),
    ("european union public licence", "eupl", 0.8),
    ("isc license", "isc", 0.8),
    ("lesser general public license", "lgpl", 0.8),
    ("licensed under", None, 0.3),
    ("mozilla public license", "mpl", 0.8),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.9),
    ("zlib license", "zlib", 0.8),
)
TAGS = ("license expression", "spdx license identifier")
# identifier stems: an identifier is a stem, or a stem and a dash; the longest stem counts. Strictness: 0 free, 1 attribution, 2 files, 3 works, 4 network
STEMS = {
    "0bsd": ("bsd", 0), "agpl": ("agpl", 4), "apache": ("apache", 1), "artistic": ("artistic", 1), "bsd": ("bsd", 1), "bsl": ("boost", 1),
    "cc-by": ("cc-by", 1), "cc-by-nc": ("cc-by-nc", 3), "cc-by-nc-nd": ("cc-by-nc-nd", 4), "cc-by-nc-sa": ("cc-by-nc-sa", 4),
    "cc-by-nd": ("cc-by-nd", 3), "cc-by-sa": ("cc-by-sa", 3), "cc0": ("cc0", 0), "epl": ("epl", 2), "eupl": ("eupl", 3), "gpl": ("gpl", 3),
    "isc": ("isc", 1), "lgpl": ("lgpl", 2), "mit": ("mit", 1), "mit-0": ("mit", 0), "mpl": ("mpl", 2), "unlicense": ("unlicense", 0),
    "wtfpl": ("wtfpl", 0), "zlib": ("zlib", 1),
}
UNKNOWN = ("unknown", 4)
KNOWN, STRANGE, EXCEPTION = 1.0, 0.5, 0.9  # certainty of known and unknown identifiers; factor of an exception of unknown name
MALFORMED = 0.3  # certainty of a tag without a well-formed expression
OPERATORS = {"or": 1, "and": 2, "with": 3}
TOKEN = r"[ \t]*([()]|[A-Za-z0-9.+:\-]*[A-Za-z0-9+])"

WORD = np.zeros(256, np.uint8)  # byte of a word, lower-cased; blank for all others
WORD[:] = 32
WORD[48:58] = np.arange(48, 58)
WORD[97:123] = np.arange(97, 123)
WORD[65:91] = np.arange(97, 123)
WORD[128:] = np.arange(128, 256)


def parse(text: str, at: int = 0):
    """(postfix tokens, end) of the licence expression at a place of a text, up
    to the first token that cannot go on with it; None instead of the tokens if
    what stands there is no whole expression. Operators in any case; a sentence
    stop after the last identifier is not part of it."""
    token, out, waiting, operand, end = re.compile(TOKEN), [], [], True, at
    while True:
        m = token.match(text, end)
        word = m.group(1) if m else None
        low = word.lower() if word else None
        if word is None or (operand and (low in OPERATORS or word == ")")) or (not operand and low not in OPERATORS and word != ")"):
            break
        if word == ")" and "(" not in waiting:
            break
        if word == "(":
            waiting.append(word)
        elif word == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif low in OPERATORS and not operand:
            while waiting and waiting[-1] != "(" and OPERATORS[waiting[-1]] >= OPERATORS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        else:
            out.append(word)
            operand = False
        end = m.end()
    if operand or "(" in waiting:
        return None, end
    return out + waiting[::-1], end


def identify(name: str) -> tuple[str, int, float]:
    """(label, strictness, certainty) of a licence identifier."""
    parts = name.lower().rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        found = STEMS.get("-".join(parts[:n]))
        if found:
            return (*found, KNOWN)
    return (*UNKNOWN, STRANGE)


def evaluate(postfix: list) -> tuple[frozenset, int, float]:
    """(labels, strictness, certainty) of an expression: ``and`` asks for both
    sides (stricter of two, least certain), ``or`` leaves the choice (freer of
    two, most certain), ``with`` eases the licence before it by one."""
    stack: list = []
    for k, token in enumerate(postfix):
        if token not in OPERATORS:
            label, strict, sure = identify(token)
            stack.append((frozenset([label]), strict, sure, token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            named = right[3] is not None and "exception" in right[3].lower()
            stack.append((left[0], max(0, left[1] - 1), left[2] * (1 if named else EXCEPTION), None))
        elif token == "and":
            stack.append((left[0] | right[0], max(left[1], right[1]), min(left[2], right[2]), None))
        else:
            stack.append((left[0] | right[0], min(left[1], right[1]), max(left[2], right[2]), None))
    return stack[0][:3]


class Scanner:
    """The automaton of all phrases and what it finds in one text."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        rows = [(w, label, sure, "base") for w, label, sure in BASE] + [(w, label, sure, "notice") for w, label, sure in NOTICES]
        for words, label, sure, kind in rows + [(w, None, 0.0, "tag") for w in TAGS]:
            self.automaton.add_word(f" {words} ", (len(words.split()), len(words) + 2, label, sure, kind))
        self.automaton.make_automaton()

    def scan(self, data: np.ndarray):
        """(number of words, findings) of the UTF-8 bytes of one text; a finding
        is (first word, words, kind, label, certainty, expression, strictness).
        A notice inside a longer one doesn't count; base phrases always do."""
        low = WORD[data]
        inside = low != 32
        start = np.flatnonzero(inside & np.r_[True, ~inside[:-1]]) if len(low) else np.zeros(0, np.int64)
        if not len(start):
            return 0, []
        end = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
        keep = inside.copy()
        keep[end[:-1]] = True  # one blank after each word
        line = " " + low[keep].tobytes().decode("latin-1") + " "
        place = np.r_[0, np.cumsum(end - start + 1)]  # of the blank before each word
        found = []
        for last, (n, width, label, sure, kind) in self.automaton.iter(line):
            found.append((int(np.searchsorted(place, last - width + 1)), n, kind, label, sure, None, None))
        out = []
        reach = -1
        for f in sorted(found, key=lambda f: (f[0], -f[1])):
            covered = f[0] + f[1] <= reach
            if f[2] == "tag":
                out += self.tag(data, f, int(end[f[0] + f[1] - 1]))
                continue
            if f[2] == "base" or not covered:
                out.append(f)
            reach = max(reach, f[0] + f[1])
        return len(start), out

    @staticmethod
    def tag(data: np.ndarray, f: tuple, at: int):
        """The expression after a tag; nothing if no colon follows the tag."""
        head = re.compile(rb"[ \t]*:").match(data[at:at + 64].tobytes())
        if head is None:
            return []
        lo = at + head.end()
        ends = np.flatnonzero(data[lo:] == 10)
        text = data[lo:lo + int(ends[0]) if len(ends) else len(data)].tobytes().decode("latin-1")
        postfix, _ = parse(text)
        if postfix is None:
            return [(f[0], f[1], "tag", None, MALFORMED, None, None)]
        labels, strict, sure = evaluate(postfix)
        return [(f[0], f[1], "tag", label, sure, " ".join(postfix), strict) for label in sorted(labels)]


FOUND = "doc_id long, kind string, label string, first_word long, n_words int, certainty double, expression string, strictness int"
SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "expressions string, strictness int")


def _rows(batches):
    """(id, number of words, findings) per row of a partition."""
    scanner = Scanner()
    for batch in batches:
        for part, data, off in text_slices(batch, "__text"):
            for k, ident in enumerate(part.column("doc_id").to_pylist()):
                yield ident, *scanner.scan(data[off[k]:off[k + 1]])


def _batches(rows, kinds: dict, size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))


def _spans(batches):
    kinds = {"doc_id": pa.int64(), "kind": pa.string(), "label": pa.string(), "first_word": pa.int64(), "n_words": pa.int32(),
             "certainty": pa.float64(), "expression": pa.string(), "strictness": pa.int32()}
    rows = ((ident, kind, label, first, n, sure, text, strict)
            for ident, _, found in _rows(batches) for first, n, kind, label, sure, text, strict in found)
    yield from _batches(rows, kinds)


def summary(ident, n: int, found: list) -> tuple:
    """The row of ``scan`` of one text's findings."""
    base = [f for f in found if f[2] == "base"]
    doubt = 1.0
    for sure in {(f[2], f[3], f[4], f[5]): f[4] for f in found}.values():
        doubt *= 1 - sure
    tags = [f for f in found if f[2] == "tag" and f[6] is not None]
    return (ident, n, len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None),
            ",".join(sorted({f[3] for f in base})), ",".join(sorted({f[3] for f in found if f[3]})), 1 - doubt,
            "; ".join(dict.fromkeys(f[5] for f in tags)), max((f[6] for f in tags), default=None))


def _scan(batches):
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
             "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.string(), "strictness": pa.int32()}
    yield from _batches((summary(*row) for row in _rows(batches)), kinds)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))


def spans(documents: DataFrame) -> DataFrame:
    """A row per finding: doc_id, kind (base, notice or tag), label (null for a
    notice of no certain licence and a malformed expression), first_word (words
    from 0), n_words, certainty, and for tags the expression in postfix order
    and its strictness (one row per label). Inputs as in ``scan``."""
    return _texts(documents).mapInArrow(_spans, FOUND)


def scan(documents: DataFrame) -> DataFrame:
    """A row per row of ``documents`` (doc_id, text): n_words; n_base,
    first_word and last_word of the base phrases (null without one);
    base_labels and labels, distinct, sorted and comma-joined (empty if none);
    score, the certainty that any of the different findings holds (0 without
    one); the expressions in postfix order, and the largest strictness.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII.
    Texts are scanned whole; null and empty texts have no words. Overlapping
    and repeated places all count for the base. Repeated rows, null ids and
    equal ids all come back, row by row; other columns are ignored; an empty
    table gives no rows."""
    return _texts(documents).mapInArrow(_scan, SCANNED)
