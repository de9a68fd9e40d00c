"""Best-fit packing with Martello-Toth dominance reduction.

Only a histogram of piece lengths, at most capacity entries, reaches the driver, whatever the number of documents.
There the reduction takes the lengths from the longest down: if some set of a piece and at most two partners dominates
every other (an exact fill; the best partner where no two fit; the best one or two where no three fit), such sets are
fixed, as many as the counts allow. What is left is packed best-fit, longest first, with bins of equal fill handled
as one group. The result is a list of patterns with multiplicities. Each piece finds its place from its rank among the pieces of its
length; ranks are running sums over parts of the stored pieces, and are never computed in one task.
"""

from __future__ import annotations

import bisect
import re
import struct
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, give_back, stored

CAPACITY = 4096
END = 1
#: Words whose ids each Python worker remembers.
REMEMBERED = 500_000

Pattern = tuple[tuple[int, ...], int]


def best_pair(partners: Counter, order: list[int], room: int) -> tuple[int, int]:
    """The two pieces (a >= b) of partners with the largest sum that fits; (0, 0) if none do. order: their lengths, sorted."""
    i, j, best = 0, len(order) - 1, (0, 0)
    while i <= j:
        a, b = order[j], order[i]
        if a + b > room:
            j -= 1
            continue
        if a + b > sum(best) and (i < j or partners[a] > 1):
            best = (a, b)
        i += 1
    return best


def dominating(w: int, counts: Counter, order: list[int], capacity: int) -> tuple[int, ...] | None:
    """A set that holds a piece of length w and dominates every other such set, or None if none is known to.

    counts: the pieces of the instance, with this one; order: their lengths, sorted. The three cases are those of
    Martello and Toth: at most one partner fits (or one fits exactly), or at most two do.
    """
    room = capacity - w
    lengths = order[: bisect.bisect_right(order, room)]  # of partners that fit alone
    if counts[w] == 1 and w <= room:
        lengths.remove(w)
    if not lengths:
        return (w,)
    have = lambda x: counts[x] - (x == w)
    least = [x for x in lengths[:3] for _ in range(min(3, have(x)))][:3]
    single = lengths[-1]
    if single == room or len(least) < 2 or least[0] + least[1] > room:
        return (w, single)
    if len(least) > 2 and sum(least) <= room:
        return None
    a, b = best_pair(Counter({x: have(x) for x in lengths}), lengths, room)
    if single >= a + b:
        return (w, single)
    if single != a:
        return None
    heavier = [x for x in lengths[bisect.bisect_right(lengths, b) :][:2] for _ in range(min(2, have(x)))][:2]
    return (w, a, b) if len(heavier) < 2 or sum(heavier) > room else None


def reduce_dominated(counts: Counter, capacity: int) -> tuple[list[Pattern], Counter]:
    """Fix dominating sets: (patterns that are fixed, the pieces of the instance that is left).

    Lengths are taken from the longest down; a piece that no set is known to dominate for stays in the instance, as a
    partner for others. Each fixed set shrinks the instance, so passes go on until one fixes nothing.
    """
    fixed: list[Pattern] = []
    counts = Counter({w: n for w, n in counts.items() if n})
    order = sorted(counts)
    shrunk = True
    while shrunk:
        shrunk = False
        for w in sorted(counts, reverse=True):
            while counts[w] and (found := dominating(w, counts, order, capacity)):
                # What dominates once does so again while its pieces last: no set of what is left is new.
                uses = Counter(found)
                n = min(counts[x] // k for x, k in uses.items())
                fixed.append((found, n))
                shrunk = True
                for x, k in uses.items():
                    counts[x] -= n * k
                    if not counts[x]:
                        del order[bisect.bisect_left(order, x)]
        counts = Counter({w: n for w, n in counts.items() if n})
    return fixed, counts


def best_fit(pieces: list[Pattern], capacity: int) -> list[Pattern]:
    """Best fit, longest first. Bins with equal contents are one group; groups are kept by the room that is left."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(room: int, bin_: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([bin_, n])

    for (w,), n in sorted(pieces, reverse=True):
        while n:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                room, bin_, most = capacity, (), n
            else:
                room = rooms[i]
                bin_, most = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            each = room // w  # the bin that was filled last is the best fit again, while it has room
            full = min(most, n // each)
            if full:
                put(room - each * w, bin_ + (w,) * each, full)
                n, most = n - full * each, most - full
            if n and most:
                part = min(each, n)
                put(room - part * w, bin_ + (w,) * part, 1)
                n, most = n - part, most - 1
            if bin_ and most:
                put(room, bin_, most)
    return [(bin_, n) for room in rooms for bin_, n in groups[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """The patterns, and how many of the sequences were fixed by dominance: those come first.

    Best fit on the reduced instance is a heuristic, and may rarely need more bins than on the whole one, which is
    taken then.
    """
    single = lambda pieces: [((w,), n) for w, n in pieces.items() if n]
    fixed, rest = reduce_dominated(Counter(counts), capacity)
    reduced, whole = fixed + best_fit(single(rest), capacity), best_fit(single(counts), capacity)
    size = lambda patterns: sum(n for _, n in patterns)
    return (reduced, size(fixed)) if size(reduced) <= size(whole) else (whole, 0)


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: the first rank, first sequence, and place in it, of each run of pieces that fill one slot of a pattern."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for bin_, n in patterns:
        at = 0
        for w in bin_:
            out.setdefault(w, []).append((used[w], sequence, at))
            used[w] += n
            at += w
        sequence += n
    return {w: np.array(rows, np.int64) for w, rows in out.items()}


# The tokenizer's own way to part a word, for words of ASCII and the letters of Latin-1, lower-cased.
PLAIN_WORD = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: How byte-level models spell bytes: printable ones as themselves, the others as the characters from 256 on.
SPELT = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELL = {b: b for b in SPELT} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in SPELT)}


def encoder(path: str, remembered: int = REMEMBERED):
    """bytes of little-endian ids for a list of words; a word is what space, newline or tab parts.

    Words that were met before are looked up. A new word of plain characters is parted as the tokenizer parts it,
    and the tokenizer's model takes each new part; any other word is left to the tokenizer as a whole.
    """
    kept = sys.__dict__.setdefault("_linesift_words", {})  # one for each Python worker, across tasks
    if path not in kept:
        from tokenizers import Tokenizer

        kept[path] = (Tokenizer.from_file(path), {}, {})
    tokenizer, words_, parts = kept[path]
    model = tokenizer.model

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(p: str) -> bytes:
        out = parts[p] = packed([t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(SPELL))])
        return out

    def word(w: str) -> bytes:
        if "<|" in w or not PLAIN_WORD.fullmatch(w):
            return packed(tokenizer.encode(w, add_special_tokens=False).ids)
        found = PARTS.findall(w.lower())
        return b"".join([parts.get(p) or part(p) for p in found])

    def encode(words: list[str]) -> bytes:
        try:
            return b"".join(map(words_.__getitem__, words))
        except KeyError:
            for d in (words_, parts):
                if len(d) > remembered:
                    d.clear()
            for w in words:
                if w not in words_:
                    words_[w] = word(w)
            return b"".join(map(words_.__getitem__, words))

    return encode


def piece_rows(path: str, capacity: int, remembered: int):
    """The pieces of each document: its place among the part's pieces of that length is seq."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, remembered)
        part = TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        seen: Counter = Counter()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                # The tokenizer drops white space and joins nothing across it, so words can be looked up one by one.
                ids = (encode(text.replace("\n", " ").replace("\t", " ").split(" ")) if text else b"") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    out.append((doc, p, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "part", "seq"])
        give_back()

    return run


def place_rows(where: dict[int, np.ndarray], fixed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = (pdf["seq"] + pdf["before"]).to_numpy(np.int64)
            length = pdf["length"].to_numpy()
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            order = np.argsort(length, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(mine):
                    table = where[int(length[mine[0]])]
                    i = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
                    sequence[mine] = table[i, 1] + rank[mine] - table[i, 0]
                    offset[mine] = table[i, 2]
            yield pdf[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset, fixed=sequence < fixed)

    return run


by_value(__name__)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id, offset, and whether dominance fixed its sequence.

    A document is the ids of its text (null: none) and the end id. One longer than capacity is cut into pieces of
    capacity ids, the last maybe shorter. Rows with a null id, and repeated rows, are packed like any other. An
    empty table gives no pieces. tokenizer: the path of its file, the same on all machines. remembered: the words, and
    the parts of words, whose ids a Python worker keeps; fewer take less memory and more time.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stored(texts.mapInPandas(piece_rows(tokenizer, capacity, remembered), f"{schema}, part int, seq bigint"), "pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    patterns, fixed = plan(dict(map(tuple, counts.groupBy("length").agg(F.sum("n")).collect())), capacity)  # at most capacity rows
    where = slots(patterns)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = pieces.join(offsets, ["length", "part"]).mapInPandas(place_rows(where, fixed), f"{schema}, sequence_id bigint, offset bigint, fixed boolean")
    return placed.withColumnRenamed("id", id_col)
