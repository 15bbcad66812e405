"""MinHash near-dedup (operator 8): bottom-k sketches from one hash function.

Every distinct shingle of a document has one 64-bit hash, and the k smallest are its sketch. Documents with equal shingle
sets are one class. Inverted lists of retained values generate candidate pairs of classes, the sketch of the union filters
them, and the full sets confirm them exactly.

What keeps lists short, without dropping a link. Let a and b have similarity t or more. Of the first K values of their
union, in hash order, a share of t or more is in both; all those lie in both sketches. So with probability 1 - 1e-9 at
least c(K, t) retained values are common, or for sets smaller than that, their whole overlap. Two sketches of size s that
share c values still share one when each leaves out its c - 1 most frequent values, frequency being the same order for
all. So values of passages that many documents hold cost nothing unless a document consists of little else.

Large groups. A list's members are compared with two leaders (its smallest and largest id), not with each other. After the
confirmed links are contracted to components, only lists that still hold several components go on. Their members carry a
parity sketch of the whole set: each shingle flips one of ``PARITY`` bits, so the bits in which two sketches differ are never
more than the shingles in which the sets do. That bound, which loses no link, leaves few pairs of different components, and
these are confirmed in turn. Members of a list's main component are not compared with each other.

Sets are of 64-bit hashes: shingles count as equal, and sets as equal, if their hashes are (of two different shingles, one
pair in 2 ** 64; of sets, by a 128-bit digest).
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, keep, scratch, written
from .hashing import Words, shingles
from .tokens import slices

#: Values of a sketch, and how many of its smallest are listed.
KEPT, LISTED = 64, 32
#: Chance of missing the sketch of a linked pair that each bound below allows.
MISS = 1e-9
#: Ids that are broadcast to pick out texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a block when a list's members are compared, and bits of a parity sketch.
BLOCK, PARITY = 256, 4096

@cache
def least_common(k: int, t: float) -> int:
    """The largest c for which fewer than c of k union values are common with probability at most ``MISS`` at similarity t."""
    below, c = 0.0, 0
    while c < k:
        below += comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > MISS:
            break
        c += 1
    return max(1, c)


class Shingler(Words):
    """Hashes of the distinct shingles of texts, 64 bits each. Sets count as equal, and shingles as common, if their hashes
    are."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        words, bounds = self(texts)
        return [np.unique(shingles(words[lo:hi], min(self.width, hi - lo))) if hi > lo else np.empty(0, np.uint64) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _digest(values: np.ndarray) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, sketch) for each row: size and 128-bit digest of its set, and its smallest hashes, shifted into
    signed order."""
    def run(batches):
        shingle = Shingler(width)
        for part in slices(batches, 64):
            got = shingle.sets(part.column(1).to_pylist())
            digest = [_digest(s) for s in got]
            low = [(s[:KEPT] ^ np.uint64(1 << 63)).view(np.int64) for s in got]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            values = pa.array(np.concatenate(low) if low else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in got], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "n", "d1", "d2", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, sketch array<long>")


def _possible(similar: int, na: Column, nb: Column) -> Column:
    """The smaller set is large enough: 100 * smaller >= similar * larger."""
    return 100 * F.least(na, nb) >= similar * F.greatest(na, nb)


def _promising(similar: int) -> Column:
    """The union's sketch has enough common values. Where both sets are whole in their sketches this is exact."""
    both = F.array_intersect("sa", "sb")
    union = F.array_sort(F.array_union("sa", "sb"))
    cut = F.when(F.greatest("na", "nb") <= KEPT, F.size(union)).otherwise(F.least(F.size(union), F.lit(KEPT)))
    low = F.size(F.filter(both, lambda v: v <= F.element_at(union, cut)))
    return F.when(F.greatest("na", "nb") <= KEPT, 100 * low >= similar * F.size(union)).otherwise(low >= least_common(KEPT, similar / 100))


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id is asked for. Up to ``BROADCAST_IDS`` ids, which are counted first, go to the texts;
    for more, and only then, whole texts are shuffled."""
    ids = written(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return written(texts.join(ids, "id", "left_semi"), "texts")


def _parities(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, bits) of the texts whose id is asked for: set size and parity sketch."""
    def run(batches):
        shingle = Shingler(width)
        for part in slices(batches, 64):
            got = shingle.sets(part.column(1).to_pylist())
            bits = [np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).tobytes() for x in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array(bits, pa.binary())], ["id", "n", "bits"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, f"id {kind}, n long, bits binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= similar * union."""
    def run(batches):
        shingle = Shingler(width)
        for part in slices(batches, 64):
            texts = list(dict.fromkeys([*part.column(2).to_pylist(), *part.column(3).to_pylist()]))
            sets = dict(zip(texts, shingle.sets(texts), strict=True))
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                p, q = sets[x], sets[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common > 0 and 100 * common >= similar * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = texts.schema["id"].dataType.simpleString()
    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _compared(members: DataFrame, similar: int) -> DataFrame:
    """(a, b): pairs of members of a list and different components that sizes and parity sketches leave. ``members`` has
    (value, id, n, component, bits).

    Of a pair, one at least lies outside the list's main component, the one with most members. So only those outside are held
    against the list: both sides are cut into blocks, and each pair of blocks is a group of two blocks at most. The rows
    dealt out are members times blocks outside the main component, which links with leaders leave few.
    """
    counted = members.groupBy("value", "component").count().groupBy("value").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"), F.sum("count").alias("all"), F.max("count").alias("inside"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    lists = written(counted.select("value", "main", blocks(F.col("all")).alias("right"), blocks(F.col("all") - F.col("inside")).alias("left")), "lists")
    sided = members.join(lists, "value")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["value", "x", "y", "outside", "left_side", "id", "n", "component", "bits"]
    sided = sided.withColumn("outside", F.col("component") != F.col("main"))
    left = sided.where("outside").withColumn("x", block("left")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("right") - 1))).withColumn("left_side", F.lit(True))
    right = sided.withColumn("y", block("right")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("left") - 1))).withColumn("left_side", F.lit(False))

    def pairs(key, table):
        ids, n, comp, outside, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "component", "outside", "left_side"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), PARITY // 64)
        right = np.flatnonzero(~side)
        a, b = [ids[:0]], [ids[:0]]
        for i in np.flatnonzero(side):
            # two outside the main component meet twice, and count where the smaller id is on the left
            may = (comp[right] != comp[i]) & (~outside[right] | (ids[i] < ids[right]))
            # with d different shingles, 100 * (n + m - d) >= similar * (n + m + d)
            k = right[may & (100 * np.minimum(n[i], n[right]) >= similar * np.maximum(n[i], n[right]))]
            if not len(k):
                continue
            apart = np.bitwise_count(bits[i] ^ bits[k]).sum(1, dtype=np.int64)
            k = ids[k[(100 + similar) * apart <= (100 - similar) * (n[i] + n[k])]]
            a.append(np.minimum(ids[i], k))
            b.append(np.maximum(ids[i], k))
        out = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.table({"a": out[0], "b": out[1]})

    kind = members.schema["id"].dataType.simpleString()
    return left.select(columns).union(right.select(columns)).groupBy("value", "x", "y").applyInArrow(pairs, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``: the smallest id that links reach, and whether it is
    the row's own. Documents are linked if 100 * |intersection| >= ``similar`` * |union| of their sets of ``width``-word
    shingles; fewer words are one shingle; a text without words, or a null one, is linked with nothing.

    Ids must be integers; others are an error. Rows that share an id are one node; a null id is linked with nothing and kept.
    Equal texts are one class and never compared with each other. An empty table gives an empty one; other columns are left
    out. The result is written; no other table is left behind.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; near-duplicates take integer ids")
    with scratch():
        out = _near_duplicates(docs, width, similar, id_col, text_col)
        return keep(written(out, "near-duplicates")).withColumnRenamed("id", id_col)


def _near_duplicates(docs: DataFrame, width: int, similar: int, id_col: str, text_col: str) -> DataFrame:
    all_rows = written(sketches(docs, width, id_col, text_col), "sketches")
    full = all_rows.where("n > 0 and id is not null")
    classes = written(full.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).drop("d1", "d2"), "classes")
    t = similar / 100

    lists = classes.select("id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    shared = lists.groupBy("value").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("size > 1")
    shared = written(shared, "shared")
    twos = shared.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    # A class leaves out its most frequent values, as many as its overlap with a linked one can spare.
    spare = F.least(F.lit(least_common(LISTED, t)), F.floor((similar * F.col("n") + 99) / 100)) - 1
    ranked = lists.join(shared.where("size > 2").select("value", "size"), "value").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("size", "value")), asc=False).alias("v"))
    longer = written(ranked.select("id", F.inline(F.slice("v", F.least(spare, F.size("v")).cast("int") + 1, F.lit(LISTED)))).select("id", "value"), "lists")
    leaders = longer.groupBy("value").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("size > 1")
    led = longer.join(leaders, "value").select("id", F.explode(F.array("low", "high")).alias("other")).where("id <> other")
    pairs = twos.where("a <> b").union(led.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).distinct()

    def sized(df: DataFrame) -> DataFrame:
        one = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return df.join(one, "a").join(two, "b").where(_possible(similar, F.col("na"), F.col("nb"))).where(_promising(similar)).select("a", "b")

    tried = written(sized(pairs), "pairs")
    # Rows to classes. The classes of an id that rows of different texts share are linked by it.
    rows = full.select("id", "d1", "d2")
    member = written(rows.join(rows.groupBy("d1", "d2").agg(F.min("id").alias("class")), ["d1", "d2"]).select("id", "class").distinct(), "members")
    several = member.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    same_id = member.join(several.select("id", "a"), "id").where("class <> a").select("a", F.col("class").alias("b"))
    listed = longer.join(leaders.where("size > 2").select("value"), "value", "left_semi").select("id")
    texts = _texts(docs, tried.select(F.col("a").alias("id")).union(tried.select(F.col("b").alias("id"))).union(listed), id_col, text_col)
    links = written(_confirmed(tried, texts, width, similar).union(same_id), "links")
    grouped = components(links)

    # Lists that still hold more than one component.
    named = longer.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("value", "id", F.coalesce("component", "id").alias("component"))
    open_lists = named.groupBy("value").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi and size > 2").select("value")
    still = written(named.join(open_lists, "value"), "open")
    members = still.join(_parities(texts, still.select("id").distinct(), width), "id").select("value", "id", "n", "component", "bits")
    more = written(_compared(members, similar).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.union(written(_confirmed(more, texts, width, similar), "links"))
        grouped = components(links)

    reached = member.join(grouped.withColumnRenamed("node", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    reached = reached.groupBy("id").agg(F.min("component").alias("component"))
    component = F.coalesce("component", "id")
    return all_rows.select("id", "n").join(reached, "id", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose id represents its group of near-duplicates. Null and empty texts and null
    ids stay; rows that share an id stay or go together; an empty table gives an empty one; extra columns may have any names.

    Ids that go are counted: up to ``BROADCAST_IDS`` are sent to the documents; for more, documents are shuffled by id."""
    with scratch():
        gone = near_duplicates(docs, width, similar, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone"))
        gone = keep(written(gone.distinct(), "dropped"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")


#: SQL for 3-word shingles and 85 percent: exact sets, all pairs that share a shingle, and components by reachability.
SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), cut as (
  select doc_id, w, least(3, len(w)) as k, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) as i from words where len(w) > 0
), shingles as materialized (
  select distinct doc_id, k, array_to_string(w[i:i+k-1], ' ') as s from cut
), sizes as materialized (
  select doc_id, count(*) as n from shingles group by doc_id
), classes as materialized (
  select doc_id, min(doc_id) over (partition by k, h) as class from (select doc_id, min(k) as k, md5(string_agg(s, chr(10) order by s)) as h from shingles group by doc_id)
), single as (
  select s.* from shingles s join classes c on s.doc_id = c.doc_id and c.class = c.doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from single a join single b on a.k = b.k and a.s = b.s and a.doc_id < b.doc_id group by all
), links as materialized (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), both_ways as materialized (
  select a, b from links union all select b, a from links
), reached(doc_id, root) as (
  select class, class from classes group by class
  union
  select l.b, r.root from reached r join both_ways l on l.a = r.doc_id
), roots as (
  select doc_id, min(root) as root from reached group by doc_id
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(root, d.doc_id)::bigint as component_id, coalesce(root, d.doc_id) = d.doc_id as kept
from documents d left join sizes using (doc_id) left join classes using (doc_id) left join roots r on r.doc_id = classes.class
"""
