"""Spelling variant grouping (operator 12): all pairs of words that differ by one edit, by merging light subtrees of a trie.

The words form a trie; its nodes are 128-bit hashes of prefixes, the end of a word is a child of its own. At each node the
largest child is heavy, the others are light. Two words that differ by one edit part at one node, and at least one of them
goes on in a light child there. So each light subtree is merged into what is beside it, with one character changed:

- skipped: the rest of a light word without its first character may be a word at the node;
- replaced: the rest behind the heavy child's character may be a word of the heavy subtree, and the rests of two light words
  may coincide with each other;
- the heavy child's character skipped: the light rest behind that character may be a word of the heavy subtree.

Where terminals coincide, the words are a pair, and each pair coincides once: at the last place where its words agree so far.
A word is light at no more than log2(words) nodes, so merging makes at most 4 * words * log2(words) rows, however long or
alike the words are. All of it is joins and aggregations: no task holds a subtree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, written
from .hashing import mixed

#: A word of a text: a longest run of these letters.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The child that is the end of a word.
END = -1
#: Edges that hold more than this part of all (word, place) rows are broadcast; there are fewer than its inverse.
BIG = 1 / 20_000
_SEEDS = np.array([[0x9E3779B97F4A7C15], [0xD1B54A32D192ED03]], np.uint64)


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, spoil: int | None = None) -> DataFrame:
    """(word, n): the words of all texts, A-Z lower-cased, of ``least_length`` code points and ``least_count`` occurrences.
    A null text has none; a null id counts as an empty one. With ``spoil``, an occurrence whose crc32 of ``<id>:<word>`` it
    divides loses the code point at that crc32 modulo its length first, so that misspelt words are in any corpus."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"({LETTERS})"), F.lit(1))
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(found).alias("word")).where(F.length("word") >= least_length)
    if spoil:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "word"))
        at = F.pmod(h, F.length("word")).cast("int")
        runs = runs.select(F.when(h % spoil == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _prefixes(words: list[str]) -> tuple[np.ndarray, ...]:
    """(word, place, character, two hashes of the prefix before it) of each place of each word and of its end."""
    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    h = np.repeat(_SEEDS, len(words), axis=1)  # columns in ``order``
    out: list[list[np.ndarray]] = []
    with np.errstate(over="ignore"):
        for i in range(int(size.max(initial=-1)) + 1):
            here = int(np.searchsorted(falling, -i, "right"))  # words of i characters or more
            more = int(np.searchsorted(falling, -i, "left"))  # of more than i
            c = np.full(here, END, np.int32)
            c[:more] = codes[begin[order[:more]] + i]
            out.append([order[:here], np.full(here, i, np.int32), c, h[0, :here].copy(), h[1, :here].copy()])
            h[:, :more] = mixed((h[:, :more] ^ _SEEDS) * np.uint64(0xD1342543DE82EF95) + c[:more].astype(np.uint64) + np.uint64(1))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            word, _, c, h1, h2 = _prefixes(b.column("word").to_pylist())
            end = c == END
            key = np.zeros((2, b.num_rows), np.uint64)
            key[:, word[end]] = h1[end], h2[end]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), *map(pa.array, key.view(np.int64))], ["word", "n", "t1", "t2"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            word, i, c, h1, h2 = _prefixes(b.column("word").to_pylist())
            whole = [b.column(t).to_numpy()[word] for t in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (h1.view(np.int64), h2.view(np.int64), c, i, *whole))], ["n1", "n2", "c", "i", "t1", "t2"])


_EDGE = ["n1", "n2", "c"]


def _light(words: DataFrame) -> DataFrame:
    """(t1, t2, i, n1, n2, c, heavy): each place where a word of ``words`` (word, n, t1, t2) goes on in a light child ``c`` (END
    if it ends) of a node, with the character of the node's heavy child."""
    rows = words.mapInArrow(_places, "n1 long, n2 long, c int, i int, t1 long, t2 long")
    edges = written(rows.groupBy(*_EDGE).agg(F.count("*").alias("size")), "edges")
    # of equal sizes the larger character is heavy; a node has one child for each character at most
    heaviest = edges.groupBy("n1", "n2").agg(F.max(F.struct("size", "c")).alias("h"), F.count("*").alias("children")).where("children > 1").select("n1", "n2", F.col("h.c").alias("heavy"))
    total = edges.agg(F.sum("size")).first()[0] or 0
    known = written(edges.join(heaviest, ["n1", "n2"], "left").select(*_EDGE, "size", F.when(F.col("c") != F.col("heavy"), F.col("heavy")).alias("heavy")), "light")
    # sizes sum to ``total``, so fewer than 1 / BIG edges are big; of the others none has more than a BIG part of the rows that are shuffled
    big = known.where(F.col("size") > total * BIG).select(*_EDGE, "heavy", F.lit(True).alias("big"))
    small = known.where((F.col("size") <= total * BIG) & F.col("heavy").isNotNull()).select(*_EDGE, "heavy")
    dealt = rows.join(F.broadcast(big), _EDGE, "left")
    out = ["t1", "t2", "i", *_EDGE, "heavy"]
    return dealt.where("big and heavy is not null").select(*out).union(dealt.where("big is null").drop("heavy", "big").join(small, _EDGE).select(*out))


def _least(n: Column | str, word: Column | str) -> Column:
    """Orders words by falling number, then by code points."""
    return F.struct((-F.col(n) if isinstance(n, str) else -n).alias("minus"), (F.col(word) if isinstance(word, str) else word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of each word of ``words`` (word, n, t1, t2) that has near words, how many there are and the most
    frequent one, as (minus its number, word)."""
    light = written(_light(words).join(words, ["t1", "t2"]).select("word", "n", "n1", "n2", "i", "c", "heavy"), "merged")
    i, length = F.col("i"), F.length("word")
    before, here, behind = F.substring("word", F.lit(1), i), F.substring("word", i + 1, length), F.substring("word", i + 2, length)
    heavy = F.chr("heavy")
    goes_on, known = F.col("c") != END, F.col("heavy") != END
    merged = F.array(
        # of a run of one character the last is skipped: there the two words part
        F.when(goes_on & (F.substring("word", i + 2, F.lit(1)) != F.substring("word", i + 1, F.lit(1))), F.concat(before, behind)),
        F.when(goes_on & known, F.concat(before, heavy, behind)),
        F.when(known, F.concat(before, heavy, here)),
    )
    wanted = light.select(F.explode(F.filter(merged, lambda x: x.isNotNull())).alias("target"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = wanted.join(words.select(F.col("word").alias("target"), F.col("n").alias("target_n")), "target")
    ends = F.array(F.struct(F.col("target").alias("word"), _least("other_n", "other").alias("best")), F.struct(F.col("other").alias("word"), _least("target_n", "target").alias("best")))
    crossing = pairs.select(F.inline(ends)).select("word", F.lit(1).cast("long").alias("near"), "best")
    # light words that are alike but for the character at the node: one for each character at most
    alike = light.where(goes_on).groupBy("n1", "n2", behind.alias("rest")).agg(F.sort_array(F.collect_list(_least("n", "word"))).alias("all")).where(F.size("all") > 1)
    beside = F.transform("all", lambda x: F.struct(x["word"].alias("word"), (F.size("all") - 1).cast("long").alias("near"), F.when(x["word"] == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0]).alias("best")))
    return crossing.union(alike.select(F.inline(beside))).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def spelling_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): its words with n at least 1.

    Two words are near if one inserted, deleted or replaced code point makes the one of the other. ``n_near`` counts a word's near
    words. ``form`` is the most frequent of them (ties: the smallest in code-point order) if it is ``ratio`` (2 or more) times as frequent as
    the word, else null; ``form_n`` is its number. ``root`` is the last of the forms that follow on each other from a word, or
    the word itself. Null and empty words take no part, rows of one word are added up, words of any length are whole; an empty table gives an
    empty one. Characters beyond code point 255 are not for this operator: they are an error. The result is written.
    """
    if ratio < 2:
        raise ValueError(f"ratio {ratio}: forms follow on each other without end unless it is 2 or more")
    with scratch():
        plain = words.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
        checked = plain.select(F.when(F.col("word").rlike("[^\u0000-ÿ]"), F.raise_error(F.concat(F.lit("beyond code point 255: "), "word"))).otherwise(F.col("word")).alias("word"), "n")
        words = written(checked.mapInArrow(_keyed, "word string, n long, t1 long, t2 long"), "words")
        form, form_n = F.col("best.word"), -F.col("best.minus")
        frequent = form_n >= ratio * F.col("n")
        known = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, form).alias("form"), F.when(frequent, form_n).alias("form_n"))
        known = written(known, "forms")
        # numbers grow by ``ratio`` at each step, which bounds the steps; each round doubles them
        steps = math.log(max(words.agg(F.max("n")).first()[0] or 1, ratio), ratio)
        up = known.where("form is not null").select("word", F.col("form").alias("root"))
        for _ in range(math.ceil(math.log2(steps + 1))):
            up = written(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        return keep(written(known.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling"))


#: crc32 byte by byte over UTF-8; near words by what is left when one code point is taken out.
SQL = """with recursive
bits as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t from range(256) r(i)),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as run from documents),
met as (select coalesce(doc_id::varchar, '') || ':' || run as s, run, count(*) as m from runs where length(run) >= 7 group by all),
bytes as (select run, m, list_prepend(4294967295::bigint, flatten(list_transform(string_split(s, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))) as b from met),
hashed as (select run, m, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as h from bytes, bits),
spoilt as (select case when h % 31 = 0 then run[1:(h % length(run))::bigint] || run[(h % length(run))::bigint + 2:] else run end as word, m from hashed),
words as materialized (select word, sum(m)::bigint as n from spoilt where length(word) >= 7 group by word having sum(m) >= 2),
cut as materialized (select distinct word, n, i, case when i = 0 then '' else word[1:i] end || word[i + 2:] as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
 union select c.word, w.word, w.n from cut c join words w on w.word = c.rest union select w.word, c.word, c.n from cut c join words w on w.word = c.rest),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as other_n from pairs group by word),
forms as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n from words w left join best using (word)),
climb as (select word, word as reached, 0 as k from forms union all select c.word, f.form, k + 1 from climb c join forms f on f.word = c.reached where f.form is not null)
select f.word, form, root, n, n_near, form_n from forms f join (select word, arg_max(reached, k) as root from climb group by word) using (word)"""
