"""Chroma fingerprints of recordings, and their alignment by offset histograms and bit errors.

Method: a recording's samples are cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes. Over
the integral image of these columns 16 rectangle filters compare sums of neighbouring areas; each result is quantised to two
bits, and the 32 bits of a place are one packed integer. Recordings that hold the same sound hold equal integers at a constant
offset: equal integers vote for an offset, and at the offset with most votes the share of differing bits decides.

Scale: fingerprints are a map. Only one integer in about SPARSE (chosen by its own value) is posted, with the one after it, so all
recordings are indexed with few postings. In the list of a posting, ordered by id, a recording is paired with the first one
and the BACK before it, which is linear in the list however common it is; what that joins is a block, and blocks only say where a pair is looked at: all pairs
of a block are compared in tasks that hold two parts of it, small blocks many to a task, with votes over all postings. What lies in different blocks is then paired exactly too: all recordings of different
blocks (components, below) that share enough of their postings for an offset to have its votes, and their votes are counted over all their
postings. A recording's commonest posting makes no pairs by itself, since two votes need two. Lists of up to LONG recordings are paired by a join, so
its rows grow with the postings. Longer ones (a passage that very many quote) are cut into parts, and the sounds of two parts are compared in a task, laid so
that the shared places meet; those that match there are voted on and confirmed in that task. Of its links come out, for each recording, their number, the best
alignment and the smallest id that they join it with: rows grow with a list's recordings, not with its links; those of a block's parts come out alike. Each link counts in one list, the first that votes for it. That
comparing is quadratic in a block, and in what a long list holds of different blocks, but it is dealt over tasks, and bounded in memory. Postings that stand alone in their list go at once. No pair is left out, within
a block or between two, so links are all there are. Places of votes are found from the postings alone; pairs that overlap enough there move their recordings to be confirmed; nothing is collected.

Defined cases: recordings shorter than a fingerprint's first place have no items, match nothing and are a class of their own.
Null samples are an empty recording. Equal recordings have equal fingerprints and are one class. Ties in votes go to the
smaller id, then the smaller offset. Rows that repeat an id count as one recording. Very long recordings are read whole, a block
of frames at a time. Null ids are in no class. Other columns are not read. An empty table gives an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import joined, mixed, row_slices, rows_to_batch, small_batches, span_hashes, text_slices
from taleweave.llm.lineage import broadcast_if_small, stored
from taleweave.llm.neardup import components

#: Samples of a frame and between frames.
FRAME, HOP = 64, 8
#: Frames that one packed integer looks at.
SPAN = 8
#: One of so many items is posted; LEAST of each recording are posted in any case.
SPARSE, LEAST = 24, 4
#: An offset needs so many votes, and so large a share of the posted items of the recording with fewer, to be looked at.
VOTES, VOTE_SHARE = 2, 0.1
#: Besides the first, so many recordings before it in a list are paired with a recording.
BACK = 2
#: Recordings of a longer list aren't paired by a join: its parts are compared with each other. Recordings of a part of a list cut into up to PARTS, and
#: bytes of sounds of a part of one cut into more.
LONG, PART, PARTS, PART_BYTES = 64, 512, 8, 4 << 20
#: Recordings and bytes of sounds of a part of a block, which is cut as long lists are; and of the whole blocks of a task.
BLOCK_PART, BLOCK_BYTES, TASK_BYTES = 1024, 8 << 20, 1 << 20
#: Two recordings of a long list that have more pairs of places in it aren't compared at each of them.
FEW_PLACES = 16
#: Recordings match if at most this share of bits differs where they overlap, over half of the shorter one.
BIT_ERRORS, OVERLAP = 0.25, 0.5

# Filters: kind, lowest pitch class, classes, frames. Kinds split an area in halves or thirds, across time or pitch.
FILTERS = tuple((k % 4, (5 * k + k // 4) % 12, 2 + 2 * ((k + k // 4) % 3), 2 + 2 * ((k * 3 + k // 4) % 4)) for k in range(16))
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)
_PITCH = np.zeros((FRAME // 2 + 1, 12), dtype=np.float32)
for _bin in range(2, FRAME // 2 + 1):  # bins an octave apart share a class
    _PITCH[_bin, int(_bin * 2.0 ** (4 - np.floor(np.log2(_bin / 12) + 4))) - 12] = 1
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


# Classes have unequal numbers of bins; noise gives each the same weight.
_EVEN = (1 / np.maximum((np.abs(np.fft.rfft(np.random.default_rng(7).standard_normal((4096, FRAME)) * _WINDOW, axis=1)) @ _PITCH).mean(axis=0), 1e-6)).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Integer pitch-class columns (frames x 12), each scaled to a sum of about 4095."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), dtype=np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for i in range(0, len(frames), 8192):  # blocks at fixed places: equal recordings are computed alike
        power = np.abs(np.fft.rfft(frames[i : i + 8192] * _WINDOW, axis=1)).astype(np.float32)
        classes = power @ _PITCH * _EVEN
        out.append((classes * (4095 / np.maximum(classes.sum(axis=1, keepdims=True), 1e-6))).astype(np.int64))
    return np.concatenate(out)


#: Recordings are worked on together until they have so many columns.
_TOGETHER = 8192


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The packed integers of a recording, one per hop."""
    return fingerprints_of([samples])[0]


def fingerprints_of(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """The packed integers of each recording. Filters run over many recordings in a row; what would look across an end is left out."""
    out, held, waiting = [], [], 0
    for k, samples in enumerate(recordings):
        held.append(chroma(samples))
        waiting += len(held[-1])
        if waiting >= _TOGETHER or k + 1 == len(recordings):
            packed = _filtered(np.concatenate(held))
            ends = np.cumsum([len(c) for c in held]).tolist()
            out += [packed[end - len(c) : max(end - len(c), end - SPAN + 1)].copy() for c, end in zip(held, ends)]
            held, waiting = [], 0
    return out


def _filtered(columns: np.ndarray) -> np.ndarray:
    """The packed integer of each place of pitch-class columns at which the filters fit."""
    n = len(columns) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    wrapped = np.concatenate((columns, columns[:, :6]), axis=1).T.astype(np.int32)  # pitch classes go round
    image = np.zeros((19, len(columns) + 1), dtype=np.int32)  # sums may wrap; areas, their differences, are small and exact
    np.cumsum(np.cumsum(wrapped, axis=1, dtype=np.int32), axis=0, dtype=np.int32, out=image[1:, 1:])

    def area(t, low, wide, high):
        return image[low + high, t + wide : t + wide + n] - image[low + high, t : t + n] - image[low, t + wide : t + wide + n] + image[low, t : t + n]

    packed = np.zeros(n, dtype=np.uint32)
    for kind, low, high, wide in FILTERS:
        if kind == 0:  # earlier against later
            a, b = area(0, low, wide // 2, high), area(wide // 2, low, wide - wide // 2, high)
        elif kind == 1:  # lower against higher
            a, b = area(0, low, wide, high // 2), area(0, low + high // 2, wide, high - high // 2)
        elif kind == 2:  # middle of the time against its sides
            a, b = area(wide // 4, low, wide // 2, high), area(0, low, wide, high)
            b = b - a
        else:  # crossed quarters
            a = area(0, low, wide // 2, high // 2) + area(wide // 2, low + high // 2, wide // 2, high // 2)
            b = area(wide // 2, low, wide // 2, high // 2) + area(0, low + high // 2, wide // 2, high // 2)
        # Two bits: above or below, by more or less than a quarter. Sums are integers, so the result is exact.
        level = (4 * a > 5 * b).view(np.uint8) + (a > b).view(np.uint8) + (5 * a > 4 * b).view(np.uint8)
        packed = (packed << np.uint32(2)) | _GRAY[level]
    return packed


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, items compared) of a and b with b's item i at a's item i + offset."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high <= low:
        return 1.0, 0
    return float(np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]).sum()) / (32 * (high - low)), high - low


def _hashes(items: np.ndarray) -> np.ndarray:
    return mixed(items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def postings(items: np.ndarray) -> np.ndarray:
    """The places whose items are posted: chosen by the items' values alone."""
    if not len(items):
        return np.zeros(0, dtype=np.int64)
    hashes = _hashes(items)
    return np.union1d(np.flatnonzero(hashes % np.uint64(SPARSE) == 0), np.argsort(hashes, kind="stable")[:LEAST])


# The sound of a text: one tone per word, of twelve pitch classes in two octaves, loud or soft.
_TONES = np.array([[(0.5 + p // 24) * np.sin(2 * np.pi * (12 + p % 12) * 2.0 ** -(p // 12 % 2) * s / FRAME + p) for s in range(HOP)] for p in range(48)], dtype=np.float32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def rendered(rows: list[bytes]) -> list[np.ndarray]:
    """Samples of each text read as tones, HOP samples a word."""
    data, starts = joined(rows)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[data])).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    tones = (span_hashes(data, first, last) % np.uint64(48)).astype(np.int64)
    bounds = np.searchsorted(first, starts)
    return [_TONES[tones[a:b]].ravel() for a, b in zip(bounds[:-1], bounds[1:])]


def samples_of(rows: list[bytes], source: str) -> list[np.ndarray]:
    """Samples of each row: of 16-bit little-endian PCM, or of a text."""
    return rendered(rows) if source == "text" else [np.frombuffer(r[: len(r) // 2 * 2], dtype="<i2").astype(np.float32) for r in rows]


_ITEMS = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int64()))])
_SOUNDS = pa.schema([("id", pa.int64()), ("sound", pa.binary())])
_POSTED = pa.schema([("id", pa.int64()), ("n_items", pa.int64()), ("fingerprint", pa.string()), ("posted", pa.list_(pa.struct([("item", pa.int32()), ("place", pa.int32()), ("next", pa.int32())])))])


def fingerprints(recordings: DataFrame, key: str, column: str, source: str = "pcm") -> DataFrame:
    """(id, items) of each recording: the operator's real output."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for first, rows in text_slices(batch, column):
                yield rows_to_batch(_ITEMS, {"id": ids.slice(first, len(rows)), "items": [items.astype(np.int64) for items in fingerprints_of(samples_of(rows, source))]})

    return small_batches(recordings).select(F.col(key).alias("id"), column).mapInArrow(run, "id long, items array<long>")


def posted(recordings: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """(id, n_items, fingerprint digest, posted items with places and the items after them) of each recording."""

    def run(batches):
        import xxhash

        for batch in batches:
            ids = batch.column("id")
            for first, rows in text_slices(batch, column):
                out = {f.name: [] for f in _POSTED}
                out["id"] = ids.slice(first, len(rows))
                for items in fingerprints_of(samples_of(rows, source)):
                    out["n_items"].append(len(items))
                    out["fingerprint"].append(xxhash.xxh3_128_hexdigest(items.tobytes()))
                    signed = items.view(np.int32)
                    places = postings(items)
                    out["posted"].append([{"item": int(signed[p]), "place": p, "next": int(signed[p + 1]) if p + 1 < len(signed) else None} for p in places.tolist()])
                yield rows_to_batch(_POSTED, out)

    return small_batches(recordings).select(F.col(key).alias("id"), column).mapInArrow(run, "id long, n_items long, fingerprint string, posted array<struct<item:int,place:int,next:int>>")


#: Pairs of places that are looked at one by one; lists of a repeated sound have more and are correlated.
_FEW = 1 << 20


def best_offset(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """(offset, votes) of the offset of y in x with most votes of equal posted pairs of items, the smallest of those; None without enough."""
    places = [postings(items) for items in (x, y)]
    return _most_votes([_keys(items, p) for items, p in zip((x, y), places)], places, len(x), len(y))


def _keys(items: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The items at places with the items after them, as one integer each: the lists they stand in."""
    return items[places].astype(np.int64) << 32 | np.append(items, items[-1:])[places + 1]


def _most_votes(keys: list[np.ndarray], places: list[np.ndarray], len_x: int, len_y: int) -> tuple[int, int] | None:
    """best_offset by the keys of the posted items of two recordings, and their places."""
    common, first_x, first_y = np.intersect1d(*keys, return_indices=True)
    if len(common) and all(np.isin(k, common).sum() == len(common) for k in keys):  # as nearly always, each shared sound stands once
        offsets, counts = np.unique(places[0][first_x] - places[1][first_y], return_counts=True)
        most, offset = int(counts.max()), int(offsets[counts.argmax()])
    else:
        votes = np.zeros(len_x + len_y + 1, dtype=np.int64)
        for one in common:
            a, b = places[0][keys[0] == one], places[1][keys[1] == one]
            if len(a) * len(b) <= _FEW:
                votes += np.bincount((a[:, None] - b).ravel() + len_y, minlength=len(votes))
            else:
                n = 1 << len(votes).bit_length()
                there = np.fft.rfft(np.bincount(a, minlength=n)) * np.fft.rfft(np.bincount(len_y - b, minlength=n))
                votes += np.rint(np.fft.irfft(there, n)[: len(votes)]).astype(np.int64)
        most, offset = int(votes.max()), int(votes.argmax()) - len_y
    return (offset, most) if most >= VOTES and most >= VOTE_SHARE * min(map(len, places)) else None


def _first_list(keys: list[np.ndarray], places: list[np.ndarray], listed: list[np.ndarray], offset: int) -> int | None:
    """The first of the lists that two recordings both take part in (listed) that votes for an offset; None without one."""
    for one in np.intersect1d(*listed).tolist():
        if np.isin(places[0][keys[0] == one] - offset, places[1][keys[1] == one]).any():
            return one
    return None


def placed(pairs: DataFrame, held: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(a, b, offset, votes) of those pairs (a, b) that have an offset with enough votes at which they overlap by half: all that could be confirmed.
    held: id, n_items, posted. Only postings are moved for it, no sounds. listed: of in_long_lists; pairs whose offset has votes of those lists are left to ends_of_long_lists."""
    sides = held.select("id", "n_items", F.transform("posted", lambda p: F.shiftleft(p["item"].cast("long"), 32).bitwiseOR(F.coalesce(p["next"], p["item"]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("keys"), F.col("posted.place").alias("places"))
    none = F.array().cast("array<long>")
    sides = sides.withColumn("listed", none) if listed is None else sides.join(broadcast_if_small(listed), "id", "left").withColumn("listed", F.coalesce("listed", none))
    both = pairs.select("a", "b").join(sides.withColumnsRenamed({c: f"{c}_b" for c in sides.columns}), F.col("b") == F.col("id_b")).join(sides.withColumnsRenamed({c: f"{c}_a" for c in sides.columns}), F.col("a") == F.col("id_a"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("offset", pa.int64()), ("votes", pa.int64())])

    def run(batches):
        for batch in batches:
            ends = {c: batch.column(c).offsets.to_numpy() for c in ("keys_a", "keys_b", "listed_a", "listed_b")}
            flat = {c: batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("keys_a", "keys_b", "places_a", "places_b", "listed_a", "listed_b")}
            out = []
            for k, (a, b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_items_a", "n_items_b")))):
                own, other = (slice(ends[c][k], ends[c][k + 1]) for c in ("keys_a", "keys_b"))
                keys, places = [flat["keys_a"][own], flat["keys_b"][other]], [flat["places_a"][own].astype(np.int64), flat["places_b"][other].astype(np.int64)]
                found = _most_votes(keys, places, x, y)
                if found is not None and min(x, y + found[0]) - max(0, found[0]) >= OVERLAP * min(x, y):
                    if _first_list(keys, places, [flat[c][ends[c][k] : ends[c][k + 1]] for c in ("listed_a", "listed_b")], found[0]) is None:
                        out.append((a, b, *found))
            if out:
                yield rows_to_batch(schema, dict(zip(schema.names, zip(*out))))

    # A repeated recording stands more than once in held; its pairs count once.
    return small_batches(both).select("a", "b", "n_items_a", "n_items_b", "keys_a", "keys_b", "places_a", "places_b", "listed_a", "listed_b").mapInArrow(run, "a long, b long, offset long, votes long").distinct()


def confirmed(pairs: DataFrame, recordings: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """pairs (a, b, offset, votes) with bit_error, of those that match over enough of the shorter recording."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    held = recordings.select(F.col(key).alias("id"), F.col(column).alias("sound")).join(broadcast_if_small(ids), "id", "left_semi")
    both = pairs.join(held.withColumnsRenamed({"id": "b", "sound": "sound_b"}), "b").join(held.withColumnsRenamed({"id": "a", "sound": "sound_a"}), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("offset", pa.int64()), ("votes", pa.int64()), ("bit_error", pa.float64())])

    def run(batches):
        known = {}
        for batch in batches:
            for _, part in row_slices(batch, ["sound_a", "sound_b"]):
                out = []
                columns = [part.column(c) for c in ("a", "b", "offset", "votes")]
                xs, ys = (part.column(c).cast(pa.binary()).to_pylist() for c in ("sound_a", "sound_b"))
                new = [sound for sound in dict.fromkeys(xs + ys) if sound not in known]
                known |= zip(new, fingerprints_of(samples_of(new, source)))
                for row, x, y in zip(zip(*(c.to_pylist() for c in columns)), xs, ys):
                    error, n = bit_errors(known[x], known[y], row[2])
                    if error <= BIT_ERRORS and n >= OVERLAP * min(len(known[x]), len(known[y])):
                        out.append((*row, error))
                known = {xs[-1]: known[xs[-1]]}  # rows come by a: the next ones may have the same
                if out:
                    yield rows_to_batch(schema, dict(zip(schema.names, zip(*out))))

    return small_batches(both).select("a", "b", "offset", "votes", "sound_a", "sound_b").mapInArrow(run, "a long, b long, offset long, votes long, bit_error double")


def peaks(votes: DataFrame) -> DataFrame:
    """(a, b, offset, votes) of pairs: the offset with most votes, of rows (a, b, offset, votes, held) with enough."""
    enough = votes.where((F.col("votes") >= VOTES) & (F.col("votes") >= VOTE_SHARE * F.col("held")))
    best = enough.groupBy("a", "b").agg(F.max(F.struct("votes", (-F.col("offset")).alias("back"))).alias("v"))
    return best.select("a", "b", (-F.col("v.back")).cast("long").alias("offset"), F.col("v.votes").alias("votes"))


def near_pairs(posts: DataFrame) -> DataFrame:
    """(a, b, offset, votes) of recordings that meet in a list, which is a posted item with the item after it: each with the list's first and the BACK before it.
    They are what blocks are made of, and no links: those come from ends_of_blocks and, between blocks, from the lists."""
    order = Window.partitionBy("item", "next").orderBy("id", "place")
    own = F.struct("id", "place", "held")
    partners = F.array(F.first(own).over(order), *(F.lag(own, k).over(order) for k in range(1, BACK + 1)))
    both = posts.withColumn("partners", partners).select("id", "place", "held", F.explode(F.array_distinct("partners")).alias("p")).where("p.id < id")
    votes = both.groupBy(F.col("p.id").alias("a"), F.col("id").alias("b"), (F.col("p.place") - F.col("place")).alias("offset"))
    return peaks(votes.agg(F.count("*").alias("votes"), F.first(F.least("held", "p.held")).alias("held")))


def shared(posts: DataFrame) -> DataFrame:
    """The postings that stand in a list with others: most stand alone, meet nothing, and go before anything is stored or dealt again."""
    order = Window.partitionBy("item", F.coalesce("next", "item")).orderBy("id")
    beside = posts.withColumn("before", F.lag("id").over(order)).withColumn("after", F.lead("id").over(order))
    return beside.where("before is not null or after is not null").drop("before", "after")


def _own():
    """A list's item and the one after it as one integer."""
    return F.shiftleft(F.col("item").cast("long"), 32).bitwiseOR(F.col("next").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def lists_apart(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of lists that hold recordings of different components (labels: id, component): item, next, id, held, n (places in the list), places, component,
    most (the list's largest component), members, aside, is_aside, and elsewhere: how many places the recording has in long lists.

    Two votes need two postings that both have. So each recording sets aside the one posting whose list is longest (in one order for all, and only if it
    stands there once): two that share another one too meet in that one, in which neither has set it aside.
    """
    places = F.sort_array(F.collect_list("place"))
    counts = posts.groupBy(F.coalesce("next", "item").alias("next"), "item", "id", "held").agg(F.count("*").alias("n"), places.alias("places"))
    known = stored(counts.join(broadcast_if_small(labels), "id", "left").withColumn("component", F.coalesce("component", "id")))
    sizes = known.groupBy("item", "next", "component").agg(F.count("*").alias("n"))
    mixed_lists = sizes.groupBy("item", "next").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("members"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    listed = known.join(mixed_lists, ["item", "next"])
    own = _own()
    elsewhere = F.sum(F.when(F.col("members") > LONG, F.col("n")).otherwise(0)).alias("elsewhere")
    last = listed.groupBy("id").agg(F.max(F.struct("members", own.alias("list"), "n")).alias("last"), elsewhere).select("id", F.when(F.col("last.n") == 1, F.col("last.list")).alias("aside"), "elsewhere")
    return stored(listed.join(last, "id").withColumn("is_aside", F.coalesce(F.col("aside") == own, F.lit(False))))


def meetings(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of lists of at most LONG recordings in which a recording meets another (y) of a different component (labels: id, component).
    In a list, those that set it aside aren't paired with each other; that the two share it is added by pairs_apart."""
    return _meetings(lists_apart(posts, labels))


def _meetings(lists: DataFrame) -> DataFrame:
    lists = lists.where(F.col("members") <= LONG).drop("places", "members")
    # A list's largest component isn't paired with itself: one side of each pair is of another one.
    same = (F.col("x.item") == F.col("y.item")) & (F.col("x.next") == F.col("y.next"))
    apart = F.col("x.component") != F.col("y.component")
    once = (F.col("y.component") == F.col("y.most")) | F.col("y.is_aside") | (F.col("x.id") < F.col("y.id"))
    met = lists.where("component != most and not is_aside").alias("x").join(lists.alias("y"), same & apart & once).select("x.*", F.struct("y.*").alias("y"))
    return met.union(lists.where("component != most and is_aside").alias("x").join(lists.where("component = most and not is_aside").alias("y"), same).select("x.*", F.struct("y.*").alias("y")))


def pairs_apart(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): all pairs of recordings of different components (labels: id, component) that meet in a list of at most LONG recordings and share so many postings
    that an offset may have enough votes. At one offset each place meets one at most, so a list gives no more votes than the smaller number of places, and all long
    lists no more than the smaller number of places in those."""
    return _pairs_apart(lists_apart(posts, labels))


def _pairs_apart(lists: DataFrame) -> DataFrame:
    both_aside = F.coalesce(F.col("aside") == F.col("y.aside"), F.lit(False)).cast("int")
    longer = F.max(F.least("elsewhere", "y.elsewhere"))
    found = (F.sum(F.least("n", "y.n")) + F.max(both_aside) + longer).alias("most"), F.min(F.least("held", "y.held")).alias("held")
    shared = _meetings(lists).groupBy(F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b")).agg(*found)
    return shared.where((F.col("most") >= VOTES) & (F.col("most") >= VOTE_SHARE * F.col("held"))).select("a", "b")


def in_long_lists(lists: DataFrame) -> DataFrame:
    """(id, listed): the lists of more than LONG recordings in which a recording takes part, which are those it has not set aside (lists: of lists_apart)."""
    return lists.where((F.col("members") > LONG) & ~F.col("is_aside")).groupBy("id").agg(F.collect_list(_own()).alias("listed"))


def pairs_of_long_lists(lists: DataFrame, recordings: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """(a, b): all pairs of recordings of different components that meet in a list (lists: of lists_apart) of more than LONG recordings and whose sounds,
    laid so that the shared places meet, match there. Each pair with enough votes at an offset and few bit errors there is among them. Their number is
    quadratic in a group that lies apart; ends_of_long_lists has what follows from them."""
    return _parts(lists, stored(in_long_lists(lists)), recordings, key, column, source).applyInArrow(_matching, "a long, b long").distinct()


def ends_of_long_lists(lists: DataFrame, listed: DataFrame, recordings: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """Rows (id, n_links, match_id, offset, votes, bit_error, root) of recordings: the number of their links in a part of a long list, the best of them, and the
    smallest id that links of the part join them with. The links are all those of pairs_of_long_lists that placed and confirmed would keep and whose offset
    has votes of long lists, each in one part alone. listed: of in_long_lists."""
    return _parts(lists, listed, recordings, key, column, source).applyInArrow(_ends, _ENDS_ROW)


def _parts(lists: DataFrame, listed: DataFrame, recordings: DataFrame, key: str, column: str, source: str):
    """Both sides of a long list are cut into parts, and each part of the one is compared with each of the other in a task. So what is moved grows with a list's
    recordings times its parts, not with its pairs, and a task holds two parts."""
    long = lists.where((F.col("members") > LONG) & ~F.col("is_aside")).select("item", "next", "id", "component", "most", "places")

    def sounds(batches):
        for batch in batches:
            for first, rows in text_slices(batch, column):
                yield rows_to_batch(_SOUNDS, {"id": batch.column("id").slice(first, len(rows)), "sound": [items.tobytes() for items in fingerprints_of(samples_of(rows, source))]})

    heard = recordings.select(F.col(key).alias("id"), column).join(broadcast_if_small(listed.select("id")), "id", "left_semi")
    heard = stored(small_batches(heard).select("id", column).mapInArrow(sounds, "id long, sound binary"))
    members = stored(long.join(heard.join(listed, "id"), "id").withColumn("left", F.col("component") != F.col("most")))
    parts = lambda mine: F.greatest(F.least(F.lit(PARTS), F.ceil(F.count_if(mine) / PART)), F.ceil(F.sum(F.when(mine, F.octet_length("sound"))) / PART_BYTES)).cast("int")
    cuts = members.groupBy("item", "next").agg(parts(F.col("left")).alias("n_left"), parts(F.lit(True)).alias("n_right")).where("n_left > 0")
    cut = stored(cuts).join(members, ["item", "next"])
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ["id", "component", "most", "places", "sound", "listed"]
    left = cut.where("left").select("item", "next", deal(F.col("n_left")).alias("i"), every(F.col("n_right")).alias("j"), F.lit(True).alias("left"), *own)
    right = cut.select("item", "next", every(F.col("n_left")).alias("i"), deal(F.col("n_right")).alias("j"), F.lit(False).alias("left"), *own)
    return left.union(right).groupBy("item", "next", "i", "j")


def ends_of_blocks(blocks: DataFrame, sizes: DataFrame, recordings: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """Rows as of ends_of_long_lists of the links of all pairs of recordings in one block (blocks: id, component; sizes: id, n_items). A block's parts meet in pairs, each pair of
    recordings in one task; whole blocks are dealt over as many tasks as their bytes need. A recording is moved once for each part of its block."""
    members = stored(blocks.join(sizes.groupBy("id").agg(F.max("n_items").alias("n_items")), "id"))
    size = F.sum(F.col("n_items") * 4)  # bytes of the sounds
    cuts = members.groupBy("component").agg(F.greatest(F.least(F.lit(PARTS), F.ceil(F.count("*") / BLOCK_PART)), F.ceil(size / BLOCK_BYTES)).cast("int").alias("n_parts"), size.alias("bytes"))
    tasks = cuts.where("n_parts = 1").agg(F.greatest(F.ceil(F.sum("bytes") / TASK_BYTES), F.lit(1)).alias("n_tasks"))
    cuts = cuts.crossJoin(F.broadcast(tasks)).select("component", "n_parts", F.when(F.col("n_parts") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.col("n_tasks"))).alias("block"))
    dealt = stored(members.join(cuts, "component").select("id", "component", "n_parts", "block", F.pmod(F.xxhash64("id"), "n_parts").cast("int").alias("part")))

    def sounds(batches):
        for batch in batches:
            for first, rows in text_slices(batch, column):
                held = batch.slice(first, len(rows)).select(_DEALT)
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array([items.tobytes() for items in fingerprints_of(samples_of(rows, source))], pa.binary())], [*_DEALT, "sound"])

    heard = recordings.select(F.col(key).alias("id"), column).join(broadcast_if_small(dealt), "id").select(*_DEALT, column)
    heard = small_batches(heard).mapInArrow(sounds, "id long, component long, n_parts int, block long, part int, sound binary")
    met = heard.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).select("id", "component", "block", "part", "n_parts", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "sound")
    return met.groupBy("n_parts", "block", "i", "j").applyInArrow(_block_ends, _ENDS_ROW)


_DEALT = ["id", "component", "n_parts", "block", "part"]


def _once(part: pa.Table, *keys: str) -> pa.Table:
    """A part with one row for each of the keys' values: rows that repeat an id are one recording."""
    part = part.combine_chunks().sort_by([(k, "ascending") for k in (*keys, "sound")])
    values = [part.column(k).to_numpy() for k in keys]
    return part.filter(pa.array(np.append(True, np.any([v[1:] != v[:-1] for v in values], axis=0)))).combine_chunks()


def _block_ends(part: pa.Table) -> pa.Table:
    """The rows of ends_of_blocks of two parts of a block, of one with itself, or of whole blocks."""
    part = _once(part, "id")
    ids, components, own = (part.column(c).to_numpy() for c in ("id", "component", "part"))
    i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
    sounds, right = _part_sounds(part), np.flatnonzero(own == j)

    def pairs():
        for x in np.flatnonzero(own == i):
            near = right[components[right] == components[x]]
            if len(near := near[ids[near] > ids[x]] if i == j else near):
                yield x, near

    return _gathered(ids, pairs(), lambda: _Voting(ids, sounds, right))


def _matching(part: pa.Table) -> pa.Table:
    """(a, b) of the recordings of a part's left side with those of its right side that match where their places in the list meet."""
    part = part.combine_chunks()
    ids, sounds = part.column("id").to_numpy(), _part_sounds(part)
    found = [np.stack((np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x]))) for x, y in _matches(part, sounds)]
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _part_sounds(part: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint32) for s in part.column("sound").to_pylist()]


def _laid(sounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sounds one after the other, with the place where each starts and its length."""
    lengths = np.array([len(s) for s in sounds])
    return np.concatenate(sounds), np.cumsum(lengths) - lengths, lengths


def _matches(part: pa.Table, sounds: list[np.ndarray]):
    """Each row of a part's left side, with those of its right side that match it where their places in the list meet."""
    ids, components, most, left = (part.column(c).to_numpy() for c in ("id", "component", "most", "left"))
    places = [np.array(p) for p in part.column("places").to_pylist()]
    right = np.flatnonzero(~left)
    if not len(right):
        return
    whole, starts, lengths = _laid([sounds[r] for r in right])
    several = np.array([len(places[r]) for r in right])
    at = np.repeat(np.arange(len(right)), several)  # the recording of each place of the right side
    there = np.concatenate([places[r] for r in right])
    for x in np.flatnonzero(left):
        # Two outside of the list's largest component meet both ways round: one of them counts.
        other = (components[right] != components[x]) & ((components[right] == most[x]) | (ids[right] > ids[x]))
        many = other & (several * len(places[x]) > FEW_PLACES)  # a repeated sound: left to the votes over all postings
        matching = [np.flatnonzero(many)]
        use = (other & ~many)[at]
        for place in places[x] if use.any() else ():
            matching.append(at[use][_alike(sounds[x], whole, starts[at[use]], lengths[at[use]], place - there[use])])
        if len(y := np.unique(np.concatenate(matching))):
            yield x, right[y]


_ENDS = pa.schema([("id", pa.int64()), ("n_links", pa.int64()), ("match_id", pa.int64()), ("offset", pa.int64()), ("votes", pa.int64()), ("bit_error", pa.float64()), ("root", pa.int64())])
_ENDS_ROW = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in _ENDS)


def _ends(part: pa.Table) -> pa.Table:
    """The rows of ends_of_long_lists of a part."""
    part = _once(part, "id", "left")
    ids, sounds = part.column("id").to_numpy(), _part_sounds(part)

    def voting():
        here = int(part.column("item")[0].as_py()) << 32 | part.column("next")[0].as_py() & 0xFFFFFFFF
        return _Voting(ids, sounds, np.flatnonzero(~part.column("left").to_numpy()), here, [np.array(x, dtype=np.int64) for x in part.column("listed").to_pylist()])

    return _gathered(ids, _matches(part, sounds), voting)


def _gathered(ids: np.ndarray, pairs, voting) -> pa.Table:
    """A row for each recording that has links, however many, of pairs (a row, the rows to look at with it); voting() makes what finds the links among them."""
    known, who = np.unique(ids, return_inverse=True)
    n_links, match, offset, votes, root = (np.zeros(len(known), dtype=np.int64) for _ in range(5))
    error = np.zeros(len(known))
    root[:] = np.arange(len(known))

    def better(of, links, others, offsets, most, errors):
        """Recordings get so many links more, and the best of them if it is better than what they have."""
        n_links[of] += links
        use = (most > votes[of]) | (most == votes[of]) & (others < match[of])
        at = of[use]
        match[at], offset[at], votes[at], error[at] = others[use], offsets[use], most[use], errors[use]

    found = None
    for x, near in pairs:
        found = found or voting()
        y, offsets, most, errors = found.links(x, near)
        if len(y):
            best = np.lexsort((ids[y], -most))[:1]
            better(who[[x]], len(y), ids[y[best]], -offsets[best], most[best], errors[best])
            better(who[y], 1, np.full(len(y), ids[x]), offsets, most, errors)
            met = root[np.append(who[y], who[x])]
            if (met != met[0]).any():
                root[np.isin(root, met)] = met.min()
    linked = np.flatnonzero(n_links)
    return pa.table([known[linked], n_links[linked], match[linked], offset[linked], votes[linked], error[linked], known[root[linked]]], schema=_ENDS)


def _runs(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, length) of the runs of neighbouring places that stand in the same list; places ascend."""
    first = np.flatnonzero(np.append(True, (np.diff(keys) != 0) | (np.diff(places) != 1))[: len(keys)])
    return keys[first], places[first], np.diff(np.append(first, len(keys)))


class _Voting:
    """The postings of some rows (a part's right side) by their lists, in runs: votes of one recording for offsets in many others are counted at once.
    here, listed: the list that is looked at, and the long lists in which each recording takes part; without them every link counts here."""

    def __init__(self, ids: np.ndarray, sounds: list[np.ndarray], rows: np.ndarray, here: int = 0, listed: list[np.ndarray] | None = None):
        self.ids, self.sounds, self.here, self.listed = ids, sounds, here, listed
        self.whole, starts, lengths = _laid([sounds[r] for r in rows])
        self.starts, self.lengths, self.posted = (np.zeros(len(sounds), dtype=np.int64) for _ in range(3))
        self.starts[rows], self.lengths[rows] = starts, lengths
        places = [postings(sounds[r]) for r in rows]
        runs = [_runs(_keys(sounds[r], p), p) for r, p in zip(rows, places)]
        self.posted[rows] = [len(p) for p in places]
        keys, firsts, long = (np.concatenate(x) for x in zip(*runs))
        order = np.argsort(keys, kind="stable")
        self.keys, self.firsts, self.long, self.rows = keys[order], firsts[order], long[order], np.repeat(rows, [len(k) for k, _, _ in runs])[order]
        self.takes_part = np.concatenate([np.isin(k, listed[r]) for r, (k, _, _) in zip(rows, runs)])[order] if listed else None

    def links(self, x: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, offsets, votes, bit errors) of those of the rows near that are linked with x, if this list is the first that votes for the offset; row's item i is at x's item i + offset."""
        places = postings(self.sounds[x])
        keys, firsts, long = _runs(_keys(self.sounds[x], places), places)
        low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        mine = (keys, firsts, long, low, high - low)
        y, offsets, most, first = self._one_by_one(x, near) if (high - low).sum() > _FEW else self._counted(x, near, *mine)
        use = (first == self.here) & (most >= VOTES) & (most >= VOTE_SHARE * np.minimum(len(places), self.posted[y]))
        y, offsets, most = y[use], offsets[use], most[use]
        errors, n = _differing(self.sounds[x], self.whole, self.starts[y], self.lengths[y], offsets)
        use = (n > 0) & (errors <= BIT_ERRORS * 32 * n)
        return y[use], offsets[use], most[use], errors[use] / (32 * n[use])

    def _counted(self, x, near, keys, firsts, long, low, n):
        mine = np.repeat(np.arange(len(keys)), n)  # each run of x with each of the same list
        at = np.arange(len(mine)) + np.repeat(low - np.cumsum(n) + n, n)
        asked = np.zeros(len(self.ids), dtype=bool)
        asked[near] = True
        mine, at = mine[asked[self.rows[at]]], at[asked[self.rows[at]]]
        rows, size, other = self.rows[at], long[mine], self.long[at]
        apart = firsts[mine] - self.firsts[at]
        # Votes of two runs by their offset rise, stay and fall, each by one a step: where that begins and ends says all, and the most votes are at such an offset.
        wide = len(self.sounds[x]) + int(self.lengths.max()) + 2
        code = rows * (2 * wide) + apart + wide
        turns, group = np.unique(np.concatenate((code - other, code, code + size - other, code + size)), return_inverse=True)
        slope = np.cumsum(np.bincount(group, np.repeat([1, -1, -1, 1], len(code)), minlength=len(turns)).astype(np.int64))
        votes = np.append(0, np.cumsum(slope[:-1] * np.diff(turns)))[: len(turns)]
        row, offset = turns // (2 * wide), turns % (2 * wide) - wide
        order = np.lexsort((np.where(self.ids[row] > self.ids[x], offset, -offset), -votes, row))  # of equal votes, the smallest offset of the larger id in the smaller
        best = order[np.append(True, np.diff(row[order]) != 0)[: len(order)]]
        if not self.listed:
            return row[best], offset[best], votes[best], np.zeros(len(best), dtype=np.int64)
        offset_of = np.zeros(len(self.ids), dtype=np.int64)
        offset_of[row[best]] = offset[best]
        there = (apart - other < offset_of[rows]) & (offset_of[rows] < apart + size) & np.isin(keys, self.listed[x])[mine] & self.takes_part[at]
        first = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(first, rows[there], keys[mine[there]])
        best = best[np.isin(row[best], rows[there])]
        return row[best], offset[best], votes[best], first[row[best]]

    def _one_by_one(self, x, near):
        """A sound that comes again and again has too many pairs of runs."""
        out, places = [], postings(self.sounds[x])
        keys = _keys(self.sounds[x], places)
        for y in near.tolist():
            own = postings(self.sounds[y])
            turn = slice(None, None, 1 if self.ids[x] < self.ids[y] else -1)
            sides = [[keys, _keys(self.sounds[y], own)][turn], [places, own][turn]]
            found = _most_votes(*sides, *[len(self.sounds[x]), len(self.sounds[y])][turn])
            if found is not None and (first := _first_list(*sides, [self.listed[x], self.listed[y]], found[0]) if self.listed else self.here) is not None:
                out.append((y, found[0] * turn.step, found[1], first))
        return np.array(out, dtype=np.int64).reshape(-1, 4).T


def _alike(x: np.ndarray, whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which sounds (each a slice of whole) match x over enough of the shorter one with their item i at x's item i + offset."""
    errors, n = _differing(x, whole, starts, lengths, offsets)
    return (n > 0) & (errors <= BIT_ERRORS * 32 * n)


def _differing(x: np.ndarray, whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, items compared) of x and sounds (each a slice of whole), with their item i at x's item i + offset; zeros for those that overlap by too little."""
    low = np.maximum(offsets, 0)
    n = np.minimum(len(x), lengths + offsets) - low
    n = np.where((n > 0) & (n >= OVERLAP * np.minimum(len(x), lengths)), n, 0)
    enough = np.flatnonzero(n)
    errors = np.zeros(len(starts), dtype=np.int64)
    blocks = np.cumsum(n[enough]) >> 20  # so many items are compared at once
    for block in np.split(enough, np.flatnonzero(np.diff(blocks)) + 1) if len(enough) else ():
        ends = np.cumsum(n[block])
        step = np.arange(ends[-1])
        first = np.repeat(ends - n[block], n[block])
        mine = x[step - first + np.repeat(low[block], n[block])]
        theirs = whole[step - first + np.repeat(starts[block] + low[block] - offsets[block], n[block])]
        errors[block] = np.add.reduceat(np.bitwise_count(mine ^ theirs).astype(np.int64), ends - n[block])
    return errors, n


def aligned(recordings: DataFrame, key: str, column: str, source: str = "pcm") -> DataFrame:
    """One row per recording: n_items, fingerprint, class_id (the smallest id it is linked with), n_links, and its best alignment:
    match_id, offset (items by which it lies later in the match), votes, bit_error."""
    held = stored(posted(recordings, key, column, source))
    classes = stored(held.where("n_items > 0 and id is not null").groupBy("fingerprint").agg(F.min("id").alias("rep"), F.max("id").alias("other")))
    reps = held.where("n_items > 0").join(classes.select(F.col("rep").alias("id"), F.col("fingerprint").alias("_f")), "id").where("fingerprint = _f")
    posts = stored(shared(reps.select("id", F.size("posted").alias("held"), F.explode("posted").alias("p")).select("id", "held", "p.*")))
    blocks = stored(components(near_pairs(posts).select("a", "b")))
    ends = stored(ends_of_blocks(blocks, reps.select("id", "n_items"), recordings, key, column, source))
    lists = lists_apart(posts, blocks)
    listed = stored(in_long_lists(lists))
    ends = ends.union(stored(ends_of_long_lists(lists, listed, recordings, key, column, source)))
    more = stored(placed(stored(_pairs_apart(lists)), reps, listed))
    links = stored(confirmed(more, recordings, key, column, source).distinct())
    labels = components(links.select("a", "b").union(ends.select("root", "id")))
    sides = links.select(F.col("b").alias("id"), "a", "offset", "votes", "bit_error").unionByName(links.select(F.col("a").alias("id"), F.col("b").alias("a"), (-F.col("offset")).alias("offset"), "votes", "bit_error"))
    sides = sides.withColumn("n_links", F.lit(1).cast("long")).unionByName(ends.drop("root").withColumnRenamed("match_id", "a"))
    match = sides.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max(F.struct("votes", (-F.col("a")).alias("_a"), "a", "offset", "bit_error")).alias("m"))
    known = stored(classes.withColumnRenamed("rep", "id").join(labels, "id", "left").join(match, "id", "left").select(
        "fingerprint", "other", F.col("id").alias("rep"), F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("m.a").alias("match_id"),
        F.col("m.offset").alias("offset"), F.col("m.votes").alias("votes"), F.col("m.bit_error").alias("bit_error"),
    ))
    # Copies take their class's row. A class that matches nothing is aligned with itself: copies with its first recording, that with its last.
    copy = (F.col("rep") != F.col("other")) & F.col("match_id").isNull()
    return held.drop("posted").join(known, "fingerprint", "left").select(
        F.col("id").alias(key), "n_items", "fingerprint", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(copy, F.when(F.col("id") == F.col("rep"), F.col("other")).otherwise(F.col("rep"))).otherwise(F.col("match_id")).alias("match_id"), F.when(copy, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
        F.when(copy, F.col("n_items")).otherwise(F.col("votes")).cast("long").alias("votes"), F.when(copy, 0.0).otherwise(F.col("bit_error")).alias("bit_error"),
    )
