"""Benchmark decontamination (operator 4): a prefix-filtered set join with exact verification.

A document is contaminated where a window of consecutive words of a benchmark item occurs in it. A window is the set of its
shingles (three words; fewer if the item has fewer). As an occurrence holds all of them, one shingle of a window is a
sufficient prefix: the rarest, by the number of documents that have it over the whole corpus. Documents are joined on these
prefix tokens only; the token's place in the window gives where an occurrence must start, which bounds place and length;
and the words of the window are compared. Shingles are 64-bit hashes, and a false one only costs a comparison. Windows of
different items are one if 128 bits of their words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, written
from .hashing import Words, shingles
from .tokens import slices

WINDOW, SHINGLE = 10, 3

#: A word is a run of a-z, 0-9 and anything beyond ASCII, after A-Z are lower-cased; other bytes part words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes of benchmark texts up to which the window index is broadcast (at most so many windows by half); beyond, both sides
#: are shuffled.
BROADCAST_BYTES = 2_000_000
#: Keys (16 bytes) of contaminated rows that are broadcast.
BROADCAST_KEYS = 2_000_000
#: Bits of the tables that tell shingles which the benchmark cannot have: in the index, and on the way to a shuffle.
NEAR_BITS, FAR_BITS = 22, 26
#: Texts that are hashed at once.
AT_ONCE = 64

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def _hasher() -> Words:
    return Words(_TABLE)


def _widths(n: int) -> tuple[int, int]:
    """Words of a window, and of its shingles, of an item of ``n`` words."""
    size = min(WINDOW, n)
    return size, min(SHINGLE, size)


def _starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each run of ``k`` words that lies within a text, for runs over all texts' words in a row."""
    total = int(bounds[-1])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: max(0, total - k + 1)]
    at = np.arange(len(text))
    inside = at + k <= bounds[text + 1]
    return text[inside], at[inside]


def _marked(found: list[tuple[int, int, tuple]]) -> tuple[int, list[str], list[tuple[int, int]]]:
    """Words hit, items and merged spans of the occurrences (start, length, items)."""
    items, spans = set(), []
    for start, size, who in sorted(found, key=lambda x: x[:2]):
        items.update(who)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + size)
        else:
            spans.append([start, start + size])
    return sum(b - a for a, b in spans), sorted(items), [tuple(s) for s in spans]


def _record(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, hit, items, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "n_words", "n_hit", "items", "spans"])


class Shingles:
    """The sorted distinct shingle hashes of a benchmark, with a table of bits before them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.may = np.zeros(1 << NEAR_BITS, bool)
        self.may[self.keys >> np.uint64(64 - NEAR_BITS)] = True

    def __reduce__(self):
        return Shingles, (self.keys,)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``hashes``, place among the keys) of the hashes that are keys."""
        at = np.flatnonzero(self.may[hashes >> np.uint64(64 - NEAR_BITS)])
        key = np.searchsorted(self.keys, hashes[at])
        good = key < len(self.keys)
        at, key = at[good], key[good]
        good = self.keys[key] == hashes[at]
        return at[good], key[good]


@dataclass
class Windows:
    """Distinct windows, in arrays: where the words of one are, how many, and who has it (``items[owner[i] : owner[i + 1]]``)."""

    words: list[bytes]
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray
    items: np.ndarray
    names: list[str]
    #: Hash of each shingle of the benchmark's words in a row, of the width that its item has.
    shingle: np.ndarray
    width: np.ndarray


def windows_of(items: list[tuple[str, bytes]]) -> Windows:
    """Windows of items: ``WINDOW`` consecutive words, or all of fewer. Words are shared objects; the rest is numbers."""
    known: dict[bytes, bytes] = {}
    texts = [(name, [known.setdefault(w, w) for w in words_of(data)]) for name, data in items]
    texts = [(name, w) for name, w in texts if w]
    words = [w for _, ws in texts for w in ws]
    hashes, bounds = _hasher()([b" ".join(w) for _, w in texts])
    shingle, width = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int8)
    keys, start, size, item = [], [], [], []
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        n, k = _widths(hi - lo)
        shingle[lo : hi - k + 1], width[lo : hi - k + 1] = shingles(hashes[lo:hi], k), k
        keys.append(np.stack([shingles(hashes[lo:hi], n, 1), shingles(hashes[lo:hi], n, 2)], 1))
        start.append(np.arange(lo, hi - n + 1))
        size.append(np.full(hi - n + 1 - lo, n))
        item.append(np.full(hi - n + 1 - lo, i))
    empty = np.zeros(0, np.int64)
    if not texts:
        return Windows([], empty, empty, np.zeros(1, np.int64), empty, [], shingle, width)
    start, size, item = (np.concatenate(x) for x in (start, size, item))
    _, first, which = np.unique(np.concatenate(keys), axis=0, return_index=True, return_inverse=True)
    owned = np.unique(np.stack([which.ravel(), item], 1), axis=0)
    return Windows(words, start[first], size[first], np.searchsorted(owned[:, 0], np.arange(len(first) + 1)), owned[:, 1], [name for name, _ in texts], shingle, width)


def _by_broadcast(texts: DataFrame, items: list[tuple[str, bytes]], id_type: str) -> DataFrame:
    """Both passes where the texts are: no document is shuffled. ``items`` is bounded by ``BROADCAST_BYTES``."""
    spark = texts.sparkSession
    windows = windows_of(items)
    widths = sorted(set(windows.width[windows.width > 0].tolist()))
    every = Shingles(windows.shingle[windows.width > 0])
    shared = spark.sparkContext.broadcast(every)

    def count(batches):
        hasher, number = _hasher(), shared.value
        found = np.zeros(len(number.keys), np.int64)
        for part in slices(batches, AT_ONCE):
            words, bounds = hasher(part.column(1).to_pylist())
            for k in widths:
                text, at = _starts(bounds, k)
                place, key = number.find(shingles(words, k)[at])
                met = np.unique(text[place] * len(number.keys) + key)  # a document counts once
                found += np.bincount(met % len(number.keys), minlength=len(number.keys)) if len(met) else 0
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], ["shingle", "n"])

    # one row for each shingle of the benchmark at most
    rarity = np.zeros(len(every.keys), np.int64)
    if widths:
        got = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
        rarity[got.column("shingle").to_numpy()] = got.column("n").to_numpy()
    order = np.argsort(np.lexsort((every.keys, rarity)))  # rarest first, ties by hash
    prefix, before, window = _prefixes(windows, every, order)
    known = rarity[prefix] > 0  # else no document has the window
    prefix, before, window = prefix[known], before[known], window[known]
    by = np.argsort(prefix, kind="stable")
    index = spark.sparkContext.broadcast((Shingles(every.keys[prefix]), np.searchsorted(prefix[by], np.append(np.unique(prefix), len(every.keys))), before[by], window[by], windows))

    def join(batches):
        hasher = _hasher()
        table, begin, before, window, windows = index.value
        for part in slices(batches, AT_ONCE):
            data = part.column(1).to_pylist()
            words, bounds = hasher(data)
            found: dict[int, list] = {}
            for k in widths:
                text, at = _starts(bounds, k)
                place, key = table.find(shingles(words, k)[at])
                for t, p, x in zip(text[place].tolist(), (at[place] - bounds[text[place]]).tolist(), key.tolist(), strict=True):
                    for y in range(begin[x], begin[x + 1]):
                        found.setdefault(t, []).append((p - int(before[y]), int(window[y])))
            rows = []
            for t, n in enumerate(np.diff(bounds).tolist()):
                rows.append((n, *_marked(_verified(words_of(data[t]), found[t], windows) if t in found else [])))
            yield _record(part.column(0), rows)

    return texts.select("id", "text").mapInArrow(join, f"id {id_type}, {RESULT}")


def _prefixes(windows: Windows, every: Shingles, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the keys, place in the window, window) of each window's first shingle by ``order``."""
    rank = np.zeros(len(windows.shingle), np.int64)
    has = windows.width > 0
    rank[has] = order[np.searchsorted(every.keys, windows.shingle[has])]
    back = np.argsort(order)
    out = []
    for size in np.unique(windows.size).tolist():
        which = np.flatnonzero(windows.size == size)
        many = size - min(SHINGLE, size) + 1
        ranks = rank[windows.start[which][:, None] + np.arange(many)]
        before = ranks.argmin(1)
        out.append((back[ranks[np.arange(len(which)), before]], before, which))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _verified(words: list[bytes], candidates: list[tuple[int, int]], windows: Windows) -> list[tuple[int, int, tuple]]:
    out = []
    for start, w in set(candidates):
        at, size = int(windows.start[w]), int(windows.size[w])
        if 0 <= start and start + size <= len(words) and words[start : start + size] == windows.words[at : at + size]:
            out.append((start, size, tuple(windows.names[i] for i in windows.items[windows.owner[w] : windows.owner[w + 1]])))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _by_shuffle(texts: DataFrame, items: DataFrame, id_type: str) -> DataFrame:
    """The same join for a benchmark of any size: prefix tokens and document shingles meet by a shuffle on their hash. Of the
    documents' shingles only those pass that a table of ``2 ** FAR_BITS`` bits, of fixed size, does not rule out."""
    def explode_windows(batches) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for part in slices(batches, AT_ONCE):
            data = [words_of(t) for t in part.column(1).to_pylist()]
            hashes, bounds = hasher([b" ".join(w) for w in data])
            for item, words, lo, hi in zip(part.column(0).to_pylist(), data, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if not words:
                    continue
                n, k = _widths(hi - lo)
                m = hi - lo - n + 1
                w1, w2 = shingles(hashes[lo:hi], n, 1), shingles(hashes[lo:hi], n, 2)
                each = np.lib.stride_tricks.sliding_window_view(shingles(hashes[lo:hi], k), n - k + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * (n - k + 1)), _signed(each.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([item] * m), _signed(w1), _signed(w2), pa.array([n] * m, pa.int32()), pa.array([b" ".join(words[i : i + n]) for i in range(m)]), lists], ["item", "w1", "w2", "size", "window", "shingles"])

    window = ["w1", "w2"]
    owned = written(items.mapInArrow(explode_windows, "item string, w1 long, w2 long, size int, window binary, shingles array<long>"), "windows")
    distinct = owned.groupBy(*window).agg(F.first("size").alias("size"), F.first("window").alias("window"), F.first("shingles").alias("shingles"))
    parts = written(distinct.select(*window, "size", F.posexplode("shingles").alias("before", "shingle")), "shingles")
    bits = np.zeros(1 << FAR_BITS - 6, np.int64)
    word, bit = F.shiftrightunsigned("shingle", 64 - FAR_BITS + 6), F.shiftrightunsigned("shingle", 64 - FAR_BITS).bitwiseAND(63)
    # at most 2 ** (FAR_BITS - 6) rows, however large the benchmark is
    got = parts.select(word.alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")).alias("v")).groupBy("k").agg(F.bit_or("v").alias("v")).toArrow()
    bits[got.column("k").to_numpy()] = got.column("v").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bits.view(np.uint8))
    widths = sorted({min(SHINGLE, r[0]) for r in parts.groupBy("size").count().collect()})  # at most WINDOW rows

    def explode_texts(batches) -> Iterator[pa.RecordBatch]:
        hasher, may = _hasher(), shared.value
        for part in slices(batches, AT_ONCE):
            words, bounds = hasher(part.column(2).to_pylist())
            size = np.diff(bounds)
            for k in widths:
                text, at = _starts(bounds, k)
                hashes = shingles(words, k)[at]
                b = (hashes >> np.uint64(64 - FAR_BITS)).astype(np.int64)
                some = (may[b >> 3] >> (b & 7).astype(np.uint8) & 1).view(bool)
                text, at, hashes = text[some], at[some], hashes[some]
                take = pa.array(text, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array((at - bounds[text]).astype(np.int32)), _signed(hashes), pa.array(size[text].astype(np.int32))], ["k1", "k2", "place", "shingle", "n"])

    row = ["k1", "k2"]
    keyed = texts.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "id").alias("k2"), "id", "text")
    places = written(keyed.select(*row, "text").mapInArrow(explode_texts, "k1 long, k2 long, place int, shingle long, n int"), "places")
    rarity = places.select("shingle", *row).distinct().groupBy("shingle").count()
    prefix = (parts.join(rarity, "shingle").groupBy(*window, "size").agg(F.min_by(F.struct("shingle", "before"), F.struct("count", "shingle", "before")).alias("p"), F.count("*").alias("known"))
              .where(F.col("known") == F.col("size") - F.least(F.lit(SHINGLE), F.col("size")) + 1).select(*window, "size", "p.shingle", "p.before"))
    start = F.col("place") - F.col("before")
    near = places.join(prefix, "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n"))).select(*row, *window, start.alias("start"), "size").distinct()
    near = written(near.join(distinct.select(*window, "window"), window), "candidates")
    asked = keyed.join(near.groupBy(*row).agg(F.collect_list(F.struct("start", "size", *window, "window")).alias("c")), row, "left").select("id", *row, "text", "c")

    def verify(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, AT_ONCE):
            out = []
            for data, near in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                words = words_of(data)
                sure = [c for c in near or () if b" ".join(words[c["start"] : c["start"] + c["size"]]) == c["window"]]
                hit, _, spans = _marked([(c["start"], c["size"], ()) for c in sure])
                out.append((len(words), hit, [{"start": a, "end": b} for a, b in spans], [{"w1": c["w1"], "w2": c["w2"]} for c in sure]))
            n, hit, spans, sure = zip(*out, strict=True) if out else ((),) * 4
            pair = lambda a, b, kind: pa.list_(pa.struct([(a, kind), (b, kind)]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pair("start", "end", pa.int32())), pa.array(sure, pair("w1", "w2", pa.int64()))], ["id", *row, "n_words", "n_hit", "spans", "windows"])

    sure = written(asked.mapInArrow(verify, f"id {id_type}, k1 long, k2 long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, windows array<struct<w1:long,w2:long>>"), "verified")
    who = sure.select(*row, F.inline("windows")).distinct().join(owned.select(*window, "item"), window).groupBy(*row).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sure.join(who, row, "left").select("id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for each row of ``docs``: words inside occurring windows, the items with such a
    window (as text, sorted) and the merged spans of words, ends exclusive.

    Null texts have no words; an item without words has no window; a null item id counts as the empty text; repeated rows
    and repeated items change nothing; empty tables are allowed; other columns are left out. A benchmark of up to
    ``broadcast_bytes`` is indexed and broadcast, its size being counted first, and no document is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return _by_broadcast(texts, [tuple(r) for r in items.collect()], id_type).withColumnRenamed("id", id_col)
    with scratch():
        return keep(written(_by_shuffle(texts, items, id_type), "contamination")).withColumnRenamed("id", id_col)


def digests(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, without a benchmark window. Null and empty texts stay; rows alike in id and text
    stay or go together; an empty table gives an empty one; extra columns may have any names.

    The decision is joined by 128 bits of the row's id and text. Keys of contaminated rows are counted; up to
    ``BROADCAST_KEYS`` go to the documents, and only beyond are documents shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the row travels as one struct, so that its columns may have any names
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(text, F.lit(1), id_col).alias("b")).alias("key"), text.alias("text"))
    hit = written(contamination(keyed.select("key", "text"), benchmark, "key", "text").where("n_hit > 0").select("key").distinct(), "contaminated")
    if hit.count() <= BROADCAST_KEYS:
        hit = F.broadcast(hit)
    return keyed.select("row", "key").join(hit, "key", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), item_windows as (
  select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as t from (select item_id, w, least(10, len(w)) as n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from items where len(w) > 0)
), doc_windows as (
  select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as t from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, (select distinct n from item_windows) where len(w) >= n)
), found as (
  select doc_id, i, d.n, item_id from doc_windows d join item_windows using (t, n)
), hits as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from (select distinct doc_id, i, n from found)) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from found) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hits using (doc_id) left join named using (doc_id)
"""
