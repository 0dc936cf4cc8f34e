"""Best-fit packing of documents into sequences by bin completion.

A document is its token ids and an end id. What does not fit a sequence is cut,
so a piece is at most a sequence long and how many pieces there are of each
length, at most `capacity` numbers however large the corpus, is all that the
search needs. Full pieces are sequences by themselves. For the others a
branch-and-bound takes the longest piece left, enumerates the fillings of the
rest of its sequence that no other filling dominates, and prunes by the waste
that a better packing could still afford; best-fit decreasing is the incumbent it
starts from. A pattern (the lengths in one sequence) is used for as many
sequences at once as the counts allow, so a plan has some thousand patterns at
any size, while the last few pieces are searched one sequence at a time.

Pieces find their places by their rank among the pieces of their length, which
is counted in two levels, within the task that wrote them and then over tasks.
Only lengths and row numbers are shuffled, never ids.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreforge.sources.scratch import spread

from .storage import written

CAPACITY = 2048
#: Steps of one search after its first packing or dead end, and fillings enumerated for one sequence. The problem is
#: NP-hard; within these the search is exhaustive for a few dozen pieces.
MOST_STEPS = 150_000
FILLINGS_A_NODE = 32
#: The same while patterns are used many times over, where few are ever taken back.
FILLINGS_A_PATTERN = 8
#: From this many pieces down a pattern is used for one sequence at a time.
ONE_BY_ONE = 400

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


@dataclass
class Plan:
    """patterns: (filling, sequences) in the order of use; bound: no packing has
    fewer sequences; proven: nor has any the search left out."""

    patterns: list[tuple[Filling, int]]
    bound: int
    proven: bool

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.patterns)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The bound L2 of Martello and Toth: for each k, pieces over capacity - k
    stand alone, those over half a sequence cannot meet, and the pieces of k and
    more that are left fill at best what those leave open."""
    if not counts:
        return 0
    n = np.zeros(capacity + 2, np.int64)
    for size, many in counts.items():
        n[size] = many
    size = np.arange(capacity + 2)
    below, weight = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    alone = below[-1] - below[capacity - k + 1]
    apart = below[capacity - k + 1] - below[half + 1]
    room = apart * capacity - (weight[capacity - k + 1] - weight[half + 1])
    small = weight[half + 1] - weight[k]
    return int((alone + apart + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, for all pieces of a length at once: each goes where
    it leaves least room."""
    open_: dict[int, list[tuple[Filling, int]]] = {}  # room -> (filling, sequences)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        rooms = [r for r in open_ if r >= size]
        heapq.heapify(rooms)
        while left and rooms:
            room = heapq.heappop(rooms)
            fits = room // size
            for filling, many in open_.pop(room):
                full, rest = min(many, left // fits), 0
                left -= full * fits
                if full < many and left:
                    rest, left = left, 0  # fewer than one sequence takes
                for copies, sequences in ((fits, full), (rest, 1 if rest else 0), (0, many - full - (1 if rest else 0))):
                    if sequences:
                        open_.setdefault(room - copies * size, []).append((filling + ((size, copies),) if copies else filling, sequences))
        fits = capacity // size
        for copies, sequences in ((fits, left // fits), (left % fits, 1)):
            if copies and sequences:
                open_.setdefault(capacity - copies * size, []).append((((size, copies),), sequences))
    return [x for group in open_.values() for x in group]


def _smear(bits: int, by: int) -> int:
    """Every set bit also 1 to `by` places higher."""
    done = 0
    out = bits
    while done < by:
        step = min(done + 1, by - done)
        out |= out << step
        done += step
    return out


def _dominated(filling: Filling, left: dict[int, int], held: int, room: int) -> bool:
    """Whether a piece that was left out could stand for several pieces of the
    filling, or for shorter ones, and still fit: what it frees is easier to
    place. held: a bit for each length in `left`."""
    one, more, used = 0, 0, 0  # bit s: some one piece, some several pieces, have the sum s
    for size, copies in filling:
        used += size * copies
        for _ in range(copies):
            more |= (more | one) << size
            one |= 1 << size
        if left[size] == copies:
            held &= ~(1 << size)
    held &= (1 << (room + 1)) - 1
    # a longer piece fits if it is longer by no more than what stands empty
    longer = _smear((one | more | 1) << 1, room - used - 1) if used < room else 0
    return bool(held & (longer | more))


def fillings(left: dict[int, int], room: int, waste: int, most: int = FILLINGS_A_NODE) -> tuple[list[Filling], bool, int]:
    """The undominated fillings of `room` that leave at most `waste` of it empty,
    the fullest first and longer pieces first; whether that is all of them, and the
    steps taken.
    left: how many pieces there are of each length."""
    if left.get(room, 0):
        return [((room, 1),)], True, 1  # one piece fits exactly and dominates the rest
    sizes = sorted((s for s, many in left.items() if many and s <= room), reverse=True)
    if not sizes:
        return [()] if room <= waste else [], True, 1
    tail = np.cumsum([s * left[s] for s in reversed(sizes)])[::-1].tolist()
    held = sum(1 << s for s in sizes)
    found: list[tuple[int, Filling]] = []
    steps = 0
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack and len(found) < most and steps < 64 * most:
        i, open_, filling = stack.pop()
        steps += 1
        if i < len(sizes) and sizes[i] > open_:
            i = bisect_left(sizes, -open_, i, key=neg)
        if i == len(sizes):
            if open_ <= waste and not _dominated(filling, left, held, room):
                found.append((open_, filling))
            continue
        if open_ - tail[i] > waste:
            continue  # not even all that is left fills it
        size = sizes[i]
        fits = min(left[size], open_ // size)
        # more copies of the longer pieces are looked at first
        stack.extend((i + 1, open_ - c * size, (*filling, (size, c)) if c else filling) for c in range(fits + 1))
    found.sort(key=lambda f: (f[0], [(-s, -c) for s, c in f[1]]))
    return [f for _, f in found], not stack, steps


def plan(counts: dict[int, int], capacity: int = CAPACITY, most_steps: int = MOST_STEPS) -> Plan:
    """Packs counts[length] pieces of each length."""
    counts = {s: int(n) for s, n in counts.items() if n}
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    n_best = sum(m for _, m in best)
    total = sum(s * n for s, n in counts.items())
    left, many, weight = dict(counts), sum(counts.values()), total
    path: list[tuple[Filling, int]] = []
    used, looked, proven, ends = 0, 0, True, 0

    def options() -> list[Filling]:
        """Of the sequence that the longest piece left opens."""
        nonlocal looked, proven, ends
        if used + max(-(-weight // capacity), lower_bound(left, capacity)) >= n_best:
            ends += 1
            return []
        longest = max(left)
        left[longest] -= 1
        waste = (n_best - 1 - used) * capacity - weight
        found, whole, steps = fillings({s: n for s, n in left.items() if n}, capacity - longest, waste, FILLINGS_A_NODE if many <= ONE_BY_ONE else FILLINGS_A_PATTERN)
        left[longest] += 1
        looked += steps if ends else 0
        proven &= whole
        ends += not found
        out = []
        for f in found:
            of = Counter(dict(f))
            of[longest] += 1
            out.append(tuple(sorted(of.items(), reverse=True)))
        return out

    if n_best > bound:
        stack = [iter(options())]
        while stack:
            if n_best == bound:
                break
            if looked > most_steps and ends:
                proven = False
                break
            filling = next(stack[-1], None)
            if filling is None:
                stack.pop()
                if path:
                    filling, times = path.pop()
                    used -= times
                    for s, c in filling:
                        left[s] = left.get(s, 0) + c * times
                        many, weight = many + c * times, weight + s * c * times
                continue
            times = min(left[s] // c for s, c in filling)
            if many > ONE_BY_ONE:
                proven = False  # fewer sequences of this pattern are not tried
            else:
                times = 1
            path.append((filling, times))
            used += times
            for s, c in filling:
                left[s] -= c * times
                many, weight = many - c * times, weight - s * c * times
                if not left[s]:
                    del left[s]
            if left:
                stack.append(iter(options()))
                continue
            ends += 1
            if used < n_best:
                best, n_best = list(path), used
            stack.append(iter(()))  # undone in the next turn
    return Plan(best, bound, proven or n_best == bound)


def _encoder(path: str):
    """Token ids of a text, as an array of uint32. `path` is a file of the
    tokenizers library; where it is the byte-level BPE whose ranks are also given
    as a tiktoken file, that library, several times faster, makes the same ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))

    def slow(text: str) -> np.ndarray:
        return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

    if path != "byte_bpe_50k.json":
        return slow
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {x.content: i for i, x in plain.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all")


#: The encoders that a Python worker has loaded.
_loaded: dict[str, object] = {}


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = _encoder(tokenizer)
        encode = _loaded[tokenizer]
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column(1)
            rows: list[tuple[int, int, int, bytes]] = []
            held = 0

            def out(rows=rows, batch=batch):
                row, piece, start, ids = zip(*rows, strict=True)
                size = [len(x) // 4 for x in ids]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )

            for row in range(len(batch)):
                ids = np.concatenate([encode(texts[row].as_py() or ""), end])
                first = len(ids) % capacity or capacity
                lo = [0, *range(first, len(ids), capacity)]
                for i, (a, b) in enumerate(zip(lo, [*lo[1:], len(ids)], strict=True)):
                    rows.append((row, i, a, ids[a:b].astype("<u4").tobytes()))
                held += len(ids)
                if held >= 1 << 18:
                    yield out()
                    rows.clear()
                    held = 0
            if rows:
                yield out()

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids (little-endian unsigned 32-bit numbers) and
    rid, a number of the piece, as a table in the shared folder. A null text is
    empty and has the end id alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(_cut(tokenizer, capacity, end_id), f"id {kind}, piece int, start long, length long, ids binary")
    return written(cut.withColumn("rid", F.monotonically_increasing_id()), "op12-pieces")


def _places(patterns: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """For the pieces of each length in the order of their ranks: from which rank
    on a pattern has them, how many it has a sequence, its first sequence and
    where in it they lie."""
    rows, taken, sequence = [], Counter(), 0
    for filling, times in patterns:
        offset = 0
        for size, copies in filling:
            rows.append((size, taken[size], copies, sequence, offset))
            taken[size] += copies * times
            offset += size * copies
        sequence += times
    size, rank, copies, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return {"key": (size << 44) + rank, "rank": rank, "copies": copies, "first": first, "offset": offset}


def _placed(at: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rid", "length", "rank"))
            i = np.searchsorted(at["key"], (length << 44) + rank, side="right") - 1
            nth = rank - at["rank"][i]
            sequence = at["first"][i] + nth // at["copies"][i]
            offset = at["offset"][i] + nth % at["copies"][i] * length
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(sequence), pa.array(offset)], ["rid", "sequence_id", "offset"])

    return run


def placements(cut: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """From the rid and length of pieces: rid, sequence_id and offset."""
    short = cut.filter(F.col("length") < capacity).select("rid", "length", F.shiftright("rid", 33).alias("task"))
    # at most capacity - 1 rows
    counts = {r.length: r.n for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = plan(counts, capacity)
    order = Window.partitionBy("length", "task").orderBy("rid")
    per_task = short.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = short.withColumn("nth", F.row_number().over(order) - 1).join(base, ["length", "task"])
    ranked = ranked.select("rid", "length", (F.col("base") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_placed(_places(packing.patterns)), "rid long, sequence_id long, offset long")
    full = cut.filter(F.col("length") == capacity).select("rid", (F.col("rid") + packing.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full), packing


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0) -> tuple[DataFrame, Plan]:
    """Returns (pieces, plan). Pieces: the id, piece, start, length, ids,
    sequence_id and offset; the pieces of a sequence lie in it one after another
    from 0. Only documents of over `capacity` ids are cut, into full pieces, of
    which the first may be shorter.

    A null or empty text is the end id alone. Repeated rows and ids, and null
    ids, are documents of their own. Numbers of sequences may have gaps. Other
    columns are ignored. An empty table gives an empty result.
    """
    cut = pieces(docs, id_col, text_col, tokenizer, capacity, end_id)
    placed, packing = placements(cut, capacity)
    out = cut.join(placed, "rid").select(F.col("id").alias(id_col), "piece", "start", "length", "ids", "sequence_id", "offset")
    return out, packing


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, from the pieces of `pack`."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # the digest is taken before the join, so that no ids are shuffled
    known = cut.select("rid", F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return known.join(placements(cut)[0], "rid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
