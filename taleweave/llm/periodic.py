"""Periodic runs of words: a suffix automaton with link-cut access.

Method: words are appended one by one to a suffix automaton, whose suffix links are a tree. A link-cut tree over it holds, for each
state, where its words last ended: states of one colour lie on one preferred path. Appending a word accesses the path from
the new state to the root. Each segment of it says that suffixes of up to `length` words last ended `distance` words ago; where
distance <= length there is a square, and the most recent end makes that distance its smallest period. A square is extended to
the right, word by word, to its run (the segment's length already is the most it extends to the left). Then the path takes the
new colour. A text of n words costs O(n log n) splay steps.

Where no run of four periods can lie the automaton need not go: in a run of period q each sequence of m <= q words that ends after its first
q + m - 1 words stands there q words earlier too, so at least 3q - m + 1 neighbouring places have seen their sequence within the last q words. For q from
2^k to 2^(k+1) - 1 and m = min(2^k, 8) such stretches are found with array operations; the automaton reads each with a margin
that holds the whole run and its neighbours. The filter rests on hashes, whose collisions could only add stretches; the automaton compares words.

Scale: a map over rows without a shuffle, so a hot source or a large group of copies is only more rows. Memory is bounded by
slices of SLICE_BYTES, or the longest text. A row lost with its executor is computed again by itself.

Defined cases: null or empty text has no words and no runs. Repeated rows give repeated results. Very long texts are read
whole. Of runs of equal length the first counts as longest, then the one of smaller period. Other columns are not read, whatever
their names. A null id stays null (and is never edited). An empty table gives an empty one.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import joined, mixed, rows_to_batch, span_hashes, text_slices

#: A run has this many words at least, and this many periods.
WORDS, PERIODS = 6, 4
#: The longest sequence of words that the filter compares.
GRAM = 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string()),
])


def repeats(words):
    """Yield (i, distance, length): suffixes of up to length words that end with word i last ended distance words before, where distance <= length.

    States are numbers from 1, the root; 0 is none. Most states have one way on, held in two arrays; others have a dict.
    """
    length, link, word_of, way, ways = [0, 0], [0, 0], [-1, -1], [0, 0], {}
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def state(n, parent):
        for values, v in ((length, n), (link, parent), (word_of, -1), (way, 0), (left, 0), (right, 0), (up, parent), (colour, -1)):
            values.append(v)
        return len(length) - 1

    def turn(x):
        """x and its parent in a preferred path change places."""
        p = up[x]
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            up[c] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def splay(x):
        """x becomes the root of its preferred path's tree, where the path's colour is kept."""
        while True:
            p = up[x]
            if left[p] != x and right[p] != x or not p:
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                colour[x] = colour[g]
                turn(p if (left[p] == x) == (left[g] == p) else x)
            else:
                colour[x] = colour[p]
            turn(x)

    last = 1
    for i, word in enumerate(words):
        new = state(length[last] + 1, 1)
        p = last
        while p:
            if word_of[p] == word or p in ways and word in ways[p]:
                break
            if word_of[p] < 0:
                word_of[p], way[p] = word, new
            else:
                ways.setdefault(p, {})[word] = new
            p = link[p]
        if p:
            q = way[p] if word_of[p] == word else ways[p][word]
            if length[q] > length[p] + 1:  # the shorter suffixes of q end in more places than its longer ones: they part
                short = state(length[p] + 1, link[q])
                word_of[short], way[short] = word_of[q], way[q]
                if q in ways:
                    ways[short] = dict(ways[q])
                while p:
                    if word_of[p] == word:
                        if way[p] != q:
                            break
                        way[p] = short
                    elif ways.get(p, {}).get(word) == q:
                        ways[p][word] = short
                    else:
                        break
                    p = link[p]
                splay(q)
                above = left[q]
                left[short] = above
                if above:
                    up[above] = short
                left[q] = short
                # Where q was the upper end of its path, the tree's root q keeps the way to the path above.
                up[short] = q
                link[q] = short
                q = short
            link[new] = up[new] = q
        x, below = up[new], new
        while x:
            splay(x)
            rest = right[x]
            if rest:
                colour[rest] = colour[x]  # deeper states keep their last end
            right[x] = below
            if 0 < i - colour[x] <= length[x] and colour[x] >= 0:
                yield i, i - colour[x], length[x]
            below, x = x, up[x]
        colour[below] = i
        splay(new)
        last = new


def runs(words: list, at_least: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in words (hashable values, or their numbers), by start, then period."""
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found, until = [], {}
    for i, period, length in repeats(ids.tolist()):
        if until.get(period, -1) >= i:
            continue
        end, step = i + 1, 64
        while end < len(ids):
            same = ids[end : end + step] == ids[end - period : min(end + step, len(ids)) - period]
            if not same.all():
                end += int(np.argmin(same))
                break
            end, step = end + len(same), step * 2
        until[period] = end - 1
        start = i - period - length + 1
        if end - start >= max(at_least, periods * period):
            found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of word places, in order and apart, outside which no run of four periods has a word or neighbour.

    hashes: of all words of some texts; bounds: where each text's words begin, and one more.
    """
    n = len(hashes)
    if n == 0:
        return []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin = bounds[:-1][text]
    longest = int(np.diff(bounds).max())
    grams, m, found = hashes, 1, []
    far = np.int64(1) << 60
    k = 0
    while PERIODS << k <= longest:
        low, high = 1 << k, (2 << k) - 1
        if low == m and m <= GRAM:
            if m > 1:  # a sequence of m words from two of m / 2
                half = m // 2
                grams = np.concatenate((grams[:half], mixed(grams[half:] * np.uint64(0x9E3779B97F4A7C15) + grams[:-half])))
            keyed = mixed(grams + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            order = np.argsort(keyed, kind="stable")
            again = np.flatnonzero(keyed[order[1:]] == keyed[order[:-1]])
            back = np.full(n, far)
            back[order[again + 1]] = order[again + 1] - order[again]
            used, m = m, m * 2
        need = max(WORDS, PERIODS * low) - low - used + 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (back <= high).astype(np.int8), [0]))))
        a, b = edge[0::2], edge[1::2]
        # The first word of a text has no place before it, so no stretch goes over two texts.
        a, b = a[b - a >= need], b[b - a >= need]
        if len(a):
            found.append((np.maximum(a - high - used - 1, begin[a]), np.minimum(b + 1, bounds[text[a] + 1])))
        k += 1
    if not found:
        return []
    first, last = (np.concatenate(v) for v in zip(*found))
    order = np.argsort(first, kind="stable")
    merged: list[list[int]] = []
    for a, b in zip(first[order].tolist(), last[order].tolist()):
        if merged and a < merged[-1][1] and text[a] == text[merged[-1][0]]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def runs_of_texts(rows: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text (UTF-8) and its runs."""
    data, starts = joined(rows)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]  # the separator ends the last word
    bounds = np.searchsorted(first, starts)
    words = [r.split() for r in rows]  # by the same ASCII white space
    found: list[list] = [[] for _ in rows]
    for a, b in stretches(span_hashes(data, first, last), bounds):
        k = int(np.searchsorted(bounds, a, side="right")) - 1
        offset = a - int(bounds[k])
        found[k] += [(s + offset, n, q) for s, n, q in runs(words[k][offset : offset + b - a])]
    return [(w, sorted(set(f), key=lambda r: (r[0], r[2]))) for w, f in zip(words, found)]


def without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, edit=None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and collapsed (the text without the repeats, one space between words) of each row.

    edit, if given, is a function (doc_id, words) -> words, applied to each text's words (bytes) first.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, rows in text_slices(batch):
                own = ids[first : first + len(rows)]
                if edit is not None:
                    rows = [r if i is None else b" ".join(edit(i, r.split())) for i, r in zip(own, rows)]
                found = runs_of_texts(rows)
                yield rows_to_batch(SCHEMA, {
                    "doc_id": own, "n_words": [len(w) for w, _ in found], "runs": [[{"start": s, "length": n, "period": q} for s, n, q in f] for _, f in found],
                    "collapsed": [b" ".join(without_repeats(w, f)).decode() for w, f in found],
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def periodic_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The contract's edit: of every tenth text by crc32 of its id, the words from one place on repeat with a period."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns from find_runs: counts, the longest run, digests of all runs and of the collapsed text."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("__longest", longest).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.col("__longest.start").alias("start"), (-F.col("__longest.length")).alias("length"), F.col("__longest.period").alias("period"),
        F.expr("1000 * -__longest.length div __longest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
