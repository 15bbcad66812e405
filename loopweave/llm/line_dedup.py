"""Line dedup (operator 6): overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines of a document that are not blank form a window. A window that occurs more than once, in
whatever documents, keeps its first occurrence; the lines of later ones are removed, overlapping ones merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 3
_SPACES = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _full(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(F.get(lines, i), F.lit(_SPACES)) != "")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text, never null. Rows alike in both are one document."""
    one, two = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(one, two).alias("_k1"), F.xxhash64(two, F.lit(1), one).alias("_k2")]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _k1, _k2, pos, _h1, _h2): each window by 128 bits of its trimmed lines. A document of one or two full lines has
    them as its one window."""
    lines = docs.select(F.col(id_col).alias("id"), *_row_key(id_col, text_col), _lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    trimmed = lines.select("id", "_k1", "_k2", F.filter(F.transform("lines", lambda x: F.btrim(x, F.lit(_SPACES))), lambda x: x != "").alias("full"))
    hashed = trimmed.select("id", "_k1", "_k2", F.transform("full", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("h")).where(F.size("h") > 0)
    at = lambda i, k: F.get(F.col("h"), i + k)

    def window(i: Column) -> Column:
        return F.struct(i.alias("pos"), *(F.xxhash64(*(F.coalesce(at(i, k)[x], F.lit(0)) for k in range(WIDTH)), F.size("h") < WIDTH).alias(name) for x, name in (("a", "_h1"), ("b", "_h2"))))

    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - WIDTH, F.lit(0))), window)
    return hashed.select("id", "_k1", "_k2", F.inline(windows))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from the text, and (_n_lines, _n_removed): its full lines, and how many went.

    Lines are compared without the white space around them; blank lines are in no window and stay unless no full line
    stays, then the text is empty. First is the occurrence with the smallest id, then place; null ids come first. A line
    goes if a later occurrence of any repeated window covers it, so a run of one line repeated shrinks to its first. A null
    text stays null with 0 lines. Rows alike in id and text are one document and get the same text. All other columns are
    kept as they are.

    Windows are hashed where the texts are and written (about 48 bytes a line). They are aggregated to first occurrences,
    partially in each task first, and only repeated windows are joined back, on a 128-bit key whose hot values the adaptive
    join splits; a group that meets in a task is the windows of one document.
    """
    seen = written(occurrences(docs, id_col, text_col), "windows")
    place = F.struct("id", "_k1", "_k2", "pos")
    repeated = seen.groupBy("_h1", "_h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("_h1", "_h2", "first")
    later = seen.join(repeated, ["_h1", "_h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_covered"))

    # the row travels as one struct, so that its columns may have any names
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row_key(id_col, text_col)).join(covered, ["_k1", "_k2"], "left")
    text = F.col("row").getField(text_col)
    rebuilt = _let(_lines(F.coalesce(text, F.lit(""))), lambda lines: _let(_full(lines), lambda full: F.when(
        F.col("_covered").isNull(), F.struct(text.alias("text"), F.size(full).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    ).otherwise(_let(_gone(full), lambda gone: F.struct(_rest(lines, full, gone).alias("text"), F.size(full).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"))))))
    out = keyed.select("row", rebuilt.alias("result"))
    return out.select(*((F.col("result.text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns), F.col("result.n_lines").alias("_n_lines"), F.col("result.n_removed").alias("_n_removed"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimiser moves the expression: a lambda's argument is not
    put in place of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _gone(full: Column) -> Column:
    """Places of the lines that the covered windows hold, merged."""
    return F.array_distinct(F.flatten(F.transform("_covered", lambda p: F.slice(full, p + 1, F.lit(WIDTH)))))


def _rest(lines: Column, full: Column, gone: Column) -> Column:
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(F.size(gone) == F.size(full), F.lit("")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n"))


def digests(result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return result.select(id_col, F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


SQL = r"""
with lines as (
  select doc_id, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from (
    select doc_id, unnest(generate_series(1, len(l))) as i, unnest(l) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))
), full_lines as (
  select *, row_number() over (partition by doc_id order by i) as j, count(*) over (partition by doc_id) as m from lines where bare <> ''
), windows as (
  select doc_id, j, case when m < 3 then 'short' || chr(10) || bare || chr(10) || coalesce(b, '') else bare || chr(10) || b || chr(10) || c end as w
  from (select *, lead(bare) over (partition by doc_id order by i) as b, lead(bare, 2) over (partition by doc_id order by i) as c from full_lines) where (m < 3 and j = 1) or (m >= 3 and c is not null)
), later as (
  select doc_id, j from (select *, row_number() over (partition by w order by doc_id, j) as n from windows) where n > 1
), gone as (
  select distinct f.doc_id, f.i from full_lines f join later l on f.doc_id = l.doc_id and f.j between l.j and l.j + 2
), counts as (
  select d.doc_id, (select count(*) from full_lines f where f.doc_id = d.doc_id) as n_lines, (select count(*) from gone g where g.doc_id = d.doc_id) as n_removed from documents d
), left_over as (
  select l.doc_id, string_agg(line, chr(10) order by l.i) as t from lines l anti join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
), texts as (
  select c.doc_id, n_lines, n_removed, case when n_removed > 0 and n_lines = n_removed then '' else coalesce(t, '') end as t from counts c left join left_over using (doc_id)
)
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, length(t)::bigint as n_chars_left, sha256(t) as text_sha256 from texts
"""
