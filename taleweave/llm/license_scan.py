"""Licence notices: exact phrases by words, and fuzzy short notices.

Method: a notice of n characters that may differ by k edits is cut into k + 1 pieces; by the pigeonhole principle one
piece stands unchanged in any text within k edits. All pieces of all notices are found in one pass of an Aho-Corasick
automaton; the runs of whole words around each hit that could be the notice are confirmed by the regex library's bounded-error
matching (`{e<=k}`) of the whole run, which counts the edits (a search within a window misses some matches at word ends).

The scan is a map over rows: no shuffle, nothing shared but the notices, so a hot source is only more rows.

Defined cases: null or empty text has no words, no places and score 0. Repeated rows give repeated results. Of notices that
overlap, the one with fewest edits stays, then the first, then the shorter. Very long texts are read whole, in time linear in them. Other columns of the input, whatever their names, are not read. An empty table gives an empty one.
"""

from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taleweave.llm.arrow_text import joined, rows_to_batch, text_slices

# Phrases of the contract and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Short notices in words as the scan sees them, their labels, and the edits (characters) each may differ by.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("apache license version 2 0", "apache-2", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution 4 0 international", "cc-by", 3),
    ("gnu general public license version 2", "gpl-2", 2),
    ("gnu general public license version 3", "gpl-3", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2 0", "mpl-2", 3),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    ("dedicated to the public domain under cc0", "cc0", 3),
)

#: ASCII characters that stand between words: all but digits and letters. Bytes of other characters belong to words.
_SEPARATORS = bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122 or 65 <= i <= 90))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_IN_WORD = np.array([not (chr(i).encode("latin1") in [bytes([s]) for s in _SEPARATORS]) for i in range(256)])

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()),
])


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of nearly equal length, each with its offset."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _compiled(notices):
    import ahocorasick
    import regex

    seeds: dict[str, list] = {}
    for k, (notice, _, edits) in enumerate(notices):
        for offset, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    patterns = [regex.compile(rf"(?b)(?:{regex.escape(n, special_only=True)}){{e<={e}}}") for n, _, e in notices]
    return automaton, patterns


def word_counts(rows: list[bytes]) -> np.ndarray:
    """Words of each row, counted over the joined bytes."""
    data, starts = joined(rows, b" ")
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    total = np.concatenate(([0], np.cumsum(begins)))
    return total[starts[1:]] - total[starts[:-1]]


def spaces_of(folded: str) -> np.ndarray:
    """Where the spaces of the folded text are; it has one before each word, so their count before a place is a word's number."""
    return np.flatnonzero(np.frombuffer(folded.encode("utf-32-le"), dtype=np.uint32) == 32)


def places(folded: str, phrase: str) -> list[int]:
    """The characters at which the phrase's words stand consecutively, each with a space before and after."""
    needle, found = f" {phrase} ", []
    at = folded.find(needle)
    while at >= 0:
        found.append(at)
        at = folded.find(needle, at + 1)
    return found


def fuzzy_spans(folded: str, notices=NOTICES) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of each notice found, in characters of the folded text; the best of those that overlap."""
    automaton, patterns = _compiled(notices)
    runs: set[tuple[int, int, int]] = set()  # notice, start and end of whole words that may be it
    spaces: list[int] = []
    for end, (size, where) in automaton.iter(folded):
        spaces = spaces or spaces_of(folded).tolist()
        for k, offset in where:
            notice, _, edits = notices[k]
            # With at most `edits` edits, the notice begins and ends this far from where its piece says.
            first = end + 1 - size - offset
            last = first + len(notice)
            for i in range(bisect_left(spaces, first - edits - 1), bisect_right(spaces, first + edits - 1)):
                for j in range(max(i + 1, bisect_left(spaces, last - edits)), bisect_right(spaces, last + edits)):
                    if abs(spaces[j] - spaces[i] - 1 - len(notice)) <= edits:
                        runs.add((k, spaces[i] + 1, spaces[j]))
    found = []
    for k, a, b in runs:
        if m := patterns[k].fullmatch(folded, a, b):
            found.append((sum(m.fuzzy_counts), a, b, notices[k][1]))
    best: list[tuple[int, int, str, int]] = []  # apart from each other, in order
    for edits, a, b, label in sorted(found):
        i = bisect_left(best, (a,))
        if (i == 0 or best[i - 1][1] <= a) and (i == len(best) or best[i][0] >= b):
            best.insert(i, (a, b, label, edits))
    return best


def scan_text(raw: bytes, phrases=BASE_PHRASES, notices=NOTICES) -> dict:
    """What is found in one text (UTF-8)."""
    folded = " " + b" ".join(raw.translate(_FOLD).split(b" ")).decode("utf-8", "replace") + " "
    while "  " in folded:
        folded = folded.replace("  ", " ")
    base, at = [], []
    for phrase, label in phrases:
        if phrase in folded and (hits := places(folded, phrase)):
            at += hits
            base.append(label)
    spans = fuzzy_spans(folded, notices)
    if at or spans:  # word numbers, by running counts
        spaces = spaces_of(folded)
        at = np.searchsorted(spaces, at).tolist()
        words = np.searchsorted(spaces, [s[:2] for s in spans]).tolist()
    labels = {*base, *(s[2] for s in spans)}
    score = 1.0 if base else 0.0
    for a, b, _, edits in spans:
        score = max(score, 1 - edits / max(1, b - a))
    return {
        "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(set(base))), "labels": ",".join(sorted(labels)), "score": score,
        "spans": ",".join(f"{label}:{words[i][0]}:{words[i][1]}:{edits}" for i, (_, _, label, edits) in enumerate(spans)),
    }


def scan_licenses(docs: DataFrame, phrases=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """Words, base places and labels, and fuzzy notices of each document (doc_id, text).

    spans: label:first word:word after the last:edits, comma-joined. score: 1 for an exact phrase, else 1 - edits / length of the best notice.
    """

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows in text_slices(batch):
                found = [scan_text(r, phrases, notices) for r in rows]
                yield rows_to_batch(SCHEMA, {
                    "doc_id": ids.slice(first, len(rows)), "n_words": word_counts(rows),
                    **{k: [f[k] for f in found] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")},
                })

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    )
