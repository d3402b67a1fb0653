"""Fuzzy search for short licence notices.

A notice of n characters may match with up to k edits.  Cut into k + 1 parts, at
least one part must occur unchanged (pigeonhole), so exact searches for the parts
find every candidate place; there the bounded-error matching of the ``regex``
library decides and gives the span and the number of edits.  Runs of separators
(line ends, comment signs, indents) count as one blank.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose words stand consecutively, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices for the fuzzy search, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary",
}
#: One edit for each so many characters of a notice.
CHARS_PER_EDIT = 10

_WORD = b"0-9a-z\x80-\xff"
#: Bytes of words in lower case, everything else as a blank; places stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if re.match(b"[" + _WORD + b"]", bytes([b])) else 32 for b in range(256))
_IS_WORD = np.array([b != 32 for b in _PLAIN], bool)


@functools.lru_cache
def _base_pattern(phrase: str) -> re.Pattern:
    return re.compile(b" +".join(map(re.escape, phrase.encode().split())) + b"(?![" + _WORD + b"])")


@functools.lru_cache
def _notice(text: str) -> tuple[int, list[tuple[int, bytes]], object]:
    """Allowed edits, the parts with their places, and the pattern with bounded errors."""
    import regex

    raw = text.encode()
    edits = len(raw) // CHARS_PER_EDIT
    cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
    return edits, [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])], regex.compile(b"(?e)(?:" + regex.escape(raw, special_only=True) + b"){e<=%d}" % edits)  # noqa: B905


def _fuzzy(plain: bytes, text: str) -> Iterator[tuple[int, int, int]]:
    """Spans and edits of a notice's matches that don't overlap."""
    edits, parts, pattern = _notice(text)
    size, spots = len(text), []
    for place, part in parts:
        at = plain.find(part)
        while at >= 0:
            spots.append((max(0, at - place - edits), at - place + size + edits))
            at = plain.find(part, at + 1)
    spots.sort()
    i = 0
    while i < len(spots):
        low, high = spots[i]
        while i < len(spots) and spots[i][0] <= high:
            high, i = max(high, spots[i][1]), i + 1
        for m in pattern.finditer(plain, low, min(high, len(plain))):
            yield m.start(), m.end(), sum(m.fuzzy_counts)


def _collapsed(plain: bytes) -> tuple[bytes, np.ndarray]:
    """The text with one blank for each run of blanks, and the place of each byte that is left."""
    found = np.frombuffer(plain, np.uint8)
    blank = found == 32
    stays = np.ones(len(found), bool)
    stays[1:] = ~(blank[1:] & blank[:-1])
    places = np.nonzero(stays)[0]
    return found[places].tobytes(), places


def scan(text: str | None) -> tuple:
    """Counts, base places and fuzzy matches (label, start and end in characters, edits) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = raw.translate(_PLAIN)
    begins = None
    mask = _IS_WORD[np.frombuffer(raw, np.uint8)]
    n_words = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0]))
    places, base_labels = [], set()
    for phrase, label in BASE.items():
        for m in _base_pattern(phrase).finditer(plain):
            at = m.start()
            if at and plain[at - 1] != 32:
                continue
            if begins is None:
                begins = np.cumsum(np.r_[mask[:1], mask[1:] & ~mask[:-1]])
            places.append(int(begins[at]) - 1)
            base_labels.add(label)
    matches, best = [], 1.0 if places else 0.0
    single, origin = _collapsed(plain)
    for notice, label in NOTICES.items():
        for low, high, edits in _fuzzy(single, notice):
            start, end = int(origin[low]), int(origin[high - 1]) + 1
            first = len(raw[:start].decode("utf-8", "replace"))
            matches.append((label, first, first + len(raw[start:end].decode("utf-8", "replace")), edits))
            best = max(best, 1 - edits / len(notice))
    labels = sorted(base_labels | {m[0] for m in matches})
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(labels), best, matches


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long, edits: int>>"


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``license``, a struct of :data:`RESULT`'s fields; all rows and columns stay (one named ``license`` is replaced).

    ``labels`` joins the base labels with those of fuzzy matches; ``score`` is 1 with a
    base place, else the best match's share of unchanged characters, else 0.  Null is
    an empty text: no words, no labels.
    """

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [scan(t) for t in texts]
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
        out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
        out["matches"] = [[{"label": a, "start": s, "end": e, "edits": k} for a, s, e, k in r[7]] for r in rows]
        return out

    return docs.withColumn("license", found(F.col(text_col).cast("string")))
