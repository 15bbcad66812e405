"""Best-fit packing (operator 10): Martello-Toth dominance reduction, then best fit for the remainder.

The instance that is packed is the histogram of piece lengths: at most ``capacity`` numbers, however many documents there
are. It is solved on the driver into runs ("the next k pieces of length l go to sequences a, a+1, ... at place p"), and the
cluster gives every piece its number among those of its length and looks its run up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, proven
from .common import written
from .tokens import content_key, kept_by_worker, slices, tokenizer_file

#: Pieces of one length that a numbering task gets at most, about.
NUMBERED = 500_000


class Runs:
    """Collects runs: ``n`` pieces of ``length``, ``each`` of them to every sequence from ``first`` on, from ``place`` on."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({k: v for k, v in counts.items() if v})
        self.used: Counter = Counter()
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.next = 0

    def take(self, length: int, n: int, first: int, each: int, place: int) -> None:
        self.rows.append((length, self.used[length], n, first, each, place))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n


def reduce_by_dominance(runs: Runs, capacity: int) -> int:
    """Fixes sets that dominate every other set with the same largest piece j, and returns how many it fixed.

    With r = capacity - j the room beside j, in an optimal packing j's neighbours S have a sum of r at most, so
    {j, k} dominates when the pieces of any such S fit where k is:
      (1) nothing fits beside j: {j};
      (2) a piece of length r exists: {j, r}, as any S fits in r;
      (3) two more pieces never fit beside j (the two smallest exceed r): {j, k}, k the largest that fits;
      (4) three more never fit, and the largest k is as large as the best pair that fits: {j, k}.
    Exchanging S and k keeps the number of sequences, so fixing loses nothing. The rules run on counts from the largest
    length down, until none fires.
    """
    fixed = 0
    changed = True
    while changed and runs.left:
        changed = False
        lengths = sorted(runs.left)
        for j in reversed(lengths):
            if not runs.left.get(j):
                continue
            room = capacity - j
            live = runs.left
            small = next((x for x in lengths if live.get(x)), j)
            n = live[j]
            if small > room or (len(live) == 1 and n == 1):
                first = runs.open(n)
                runs.take(j, n, first, 1, 0)
                fixed, changed = fixed + n, True
                continue
            k = 0
            if live.get(room):
                k = room
            elif j == max(live):  # the others need j to be the largest piece left
                least = [x for x in lengths if live.get(x)]
                flat = [x for x in least[:3] for _ in range(min(live[x], 3))][:3]
                if j in flat and live[j] <= 3:
                    flat.remove(j)
                at = bisect.bisect_right(least, room) - 1
                large = least[at] if at >= 0 else 0
                if large and not (large == j and live[j] < 2):
                    if len(flat) < 2 or flat[0] + flat[1] > room:
                        k = large
                    elif (len(flat) < 3 or sum(flat) > room) and large >= _best_pair(live, j, least, room):
                        k = large
            if k:
                m = n // 2 if k == j else min(n, live[k])
                if m:
                    # rules 3 and 4 are proven for what is left now: their premises stay true as pieces go
                    first = runs.open(m)
                    runs.take(j, m, first, 1, 0)
                    runs.take(k, m, first, 1, j)
                    fixed, changed = fixed + m, True
    return fixed


def _best_pair(live: Counter, j: int, least: list[int], room: int) -> int:
    """The largest sum of two pieces, other than one j, that fit in ``room``."""
    have = {x: live[x] - (x == j) for x in least}
    least = [x for x in least if have[x] > 0]
    best, hi = 0, len(least) - 1
    for lo, x in enumerate(least):
        while hi >= lo and x + least[hi] > room:
            hi -= 1
        if hi < lo:
            break
        for y in (least[hi], *([least[hi - 1]] if hi > lo else [])):
            if y != x or have[x] > 1:
                best = max(best, x + y)
                break
    return best


def best_fit(runs: Runs, capacity: int) -> None:
    """Best fit, largest length first, for many equal pieces at once. A group is a range of sequences with the same room;
    each piece goes to the fullest group that it fits."""
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                bisect.insort(order, free)
            room[free].append((first, n))

    for length in sorted(runs.left, reverse=True):
        n = runs.left[length]
        while n:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    first = runs.open(full)
                    runs.take(length, full * each, first, each, 0)
                    put(capacity - each * length, first, full)
                if rest:
                    first = runs.open(1)
                    runs.take(length, rest, first, rest, 0)
                    put(capacity - rest * length, first, 1)
                break
            free = order[at]
            first, many = room[free].pop()
            if not room[free]:
                del room[free], order[at]
            each = free // length
            full = min(many, n // each)
            if full:
                runs.take(length, full * each, first, each, capacity - free)
                put(free - full and free - each * length, first, full)
                n -= full * each
            if full < many:
                rest = min(n, each - 1) if n < each else 0
                if rest:
                    runs.take(length, rest, first + full, rest, capacity - free)
                    put(free - rest * length, first + full, 1)
                    n -= rest
                put(free, first + full + bool(rest), many - full - bool(rest))


def pack(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int, int]:
    """Runs for a histogram of lengths, the number of sequences, and how many of them dominance fixed."""
    runs = Runs(counts)
    fixed = reduce_by_dominance(runs, capacity)
    best_fit(runs, capacity)
    return np.array(runs.rows, np.int64).reshape(-1, 6), runs.next, fixed


def _encoder(content: str, whole: dict[str, int]) -> Encoder:
    return Encoder(content, lambda ids: np.asarray(ids, "<u4").tobytes(), b"".join, whole)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text, tokenised once where it is."""
    kind, content = tokenizer_file(tokenizer_path)
    if kind != "json":
        raise ValueError("packing takes a tokenizers .json file")
    shared = docs.sparkSession.sparkContext.broadcast((content, proven(content)))
    name = content_key(content)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = kept_by_worker("encoder", name, lambda: _encoder(*shared.value))
        for part in slices(batches):
            ids = part.column(0)
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                tokens = encode(text) + end
                n, at, k = len(tokens) // 4, 0, 0
                size = n % capacity or min(n, capacity)
                while at < n:
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(tokens[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    key = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInArrow(run, f"id {key}, piece int, start long, length long, ids_crc32 long"))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document, with its place.

    A document is its token ids and then ``end_id``; a null text is empty and so has the end alone. Only a document longer
    than ``capacity`` is cut, into pieces of ``capacity`` with the shorter one first. Pieces of a sequence lie from offset 0
    without a gap. Repeated rows are packed each for itself; ties of length are broken by id, piece,
    checksum and start. An empty
    table gives an empty one. Other columns of ``docs`` are left out.
    """
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # bounded: one row for each length up to capacity
    rows, _, _ = pack(counts, capacity)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    runs = cut.sparkSession.sparkContext.broadcast(rows[order])

    # The number of a piece among those of its length, from 0. Pieces alike in everything are one row with a count until they
    # are numbered. Hot lengths are dealt out: a piece is numbered within its length and salt, and starts after the salts before.
    salts = max(8, sum(counts.values()) // NUMBERED)
    same = ["id", "piece", "start", "length", "ids_crc32"]
    alike = cut.groupBy(*same).agg(F.count("*").alias("many"))
    dealt = alike.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = cut.groupBy("length", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int").alias("salt")).count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = F.sum("many").over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("many")
    first = F.col("before") + F.col("within")
    numbered = dealt.withColumn("within", within).join(before, ["length", "salt"]).select(*same, F.explode(F.sequence(first, first + F.col("many") - 1)).alias("number"))

    def place(batches):
        table = runs.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            r = table[np.searchsorted(key, length * (1 << 44) + number, "right") - 1]
            nth = number - r[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(r[:, 3] + nth // r[:, 4]), pa.array(r[:, 5] + nth % r[:, 4] * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    key = docs.schema[id_col].dataType.simpleString()
    out = numbered.mapInArrow(place, f"id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
