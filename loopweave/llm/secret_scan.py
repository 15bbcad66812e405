"""Secret scans (operator 5): an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, for each (blob, rule version)
that was ever scanned, the findings. A run scans only blobs for which the ledger has no entry of the current rule version,
each once however many paths hold it, appends them, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; a match counts if ``group`` of it has ``least`` characters.
    ``hint`` is a cheap pattern that every text with a counting match has."""
    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: Fixed values. The first three are the base rules; the others add well-known token formats. A run of 16 capitals after
#: AKIA or of 32 hexadecimal digits is found the same whether shorter runs are matched and dropped or not matched.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "(?i)passw|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, "eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27, "-----BEGIN "),
)
RULE_VERSION = 1
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: New addresses that are broadcast; 64 characters each.
BROADCAST_BLOBS = 200_000
MATCHES = "array<struct<rank:int,kind:string,n:int,before:int,whole:int,counts:boolean>>"
LEDGER = f"blob string, rule_version int, spans {SPAN}"


def _matches(rule: Rule, rank: int, text: Column) -> Column:
    """The rule's matches (rank, kind, n, before, whole, counts): texts between matches and matches alternate, so the lengths
    up to a match say where it is."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, 0).alias("whole"), F.regexp_extract_all(text, pattern, rule.group).alias("part"))
    # the text after the last match has no match beside it: it only ends the list
    one = F.transform(found, lambda m, n: F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), n.alias("n"), F.length(m["before"]).alias("before"), F.length(m["whole"]).alias("whole"), (F.length(m["part"]) >= rule.least).alias("counts")))
    return F.when(text.rlike(rule.hint), F.filter(one, lambda m: m["whole"].isNotNull()))


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of distinct (blob, content) rows: all rules' spans, by start, then in the order of the rules.

    Matches become rows, and a running sum of lengths over (blob, rule) places them, so the work is linear in a text's
    matches, however many. Rows that are partitioned by blob already, as ``unseen`` returns them, are not shuffled again; no
    text leaves the first step.
    """
    every = F.concat(*(F.coalesce(_matches(r, i, F.col("content")), F.array().cast(MATCHES)) for i, r in enumerate(rules)))
    rows = blobs.select("blob", F.explode_outer(every).alias("m")).select("blob", "m.*")
    end = F.sum(F.col("before") + F.col("whole")).over(Window.partitionBy("blob", "rank").orderBy("n")).cast("int")
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("whole")).alias("start"), "rank", "kind", "end"))
    return rows.withColumn("end", end).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: int) -> DataFrame:
    """One row (blob, content) for each content that the ledger has no entry of ``rule_version`` for. Copies of a blob are
    reduced to one in each map task before anything is shuffled. Only addresses meet the ledger; up to ``BROADCAST_BLOBS`` new
    ones, which are counted, then pick out the texts, so a scan of little that is new moves little."""
    once = lambda df: df.groupBy("blob").agg(F.first("content").alias("content"))
    if ledger is None:
        return once(versions)
    known = ledger.where(F.col("rule_version") == rule_version).select("blob")
    fresh = written(versions.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
    if fresh.count() <= BROADCAST_BLOBS:
        return once(versions.join(F.broadcast(fresh), "blob", "left_semi"))
    return once(versions).join(fresh, "blob", "left_semi")


def scan(paths: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): findings (id, blob, spans) for each row of ``paths``, and the rows to append to the ledger.

    ``paths`` may hold many versions of a path and many paths of a version: each row is one. A null text is the empty blob,
    a null id stays null, repeated rows stay, an empty table gives two empty ones, other columns are left out. ``spans``
    counts code points, its ends are exclusive; a text of many matches or of great length takes time in proportion. Additions
    are written to the shared folder before findings are joined, so what is scanned once is not scanned again if an executor
    is lost.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    versions = paths.select(F.col(id_col).alias("id"), F.sha2(content, 256).alias("blob"), content.alias("content"))
    fresh = scanned(unseen(versions.select("blob", "content"), ledger, rule_version), rules)
    additions = written(fresh.select("blob", F.lit(rule_version).alias("rule_version"), "spans"), "ledger")
    # most blobs have no finding: only those that have are joined
    entries = additions if ledger is None else additions.unionByName(ledger.where(F.col("rule_version") == rule_version))
    entries = entries.where(F.size("spans") > 0).select("blob", "spans")
    findings = versions.select("id", "blob").join(entries, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return findings, additions


def digests(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return findings.select(id_col, *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(said(of(*BASE)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _rule_sql(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, start, start + length(w[i]) as "end" from (
      select doc_id, i, w, g, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0))::bigint as start from (
        select doc_id, unnest(generate_series(1, len(w))) as i, w, g, b from (
          select doc_id, regexp_extract_all(t, '{pattern}') as w, regexp_extract_all(t, '{pattern}', {rule.group}) as g, string_split_regex(t, '{pattern}') as b from texts) where len(w) > 0)
    ) where length(g[i]) >= {rule.least}"""


SQL = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
said as (select *, kind || ':' || start || ':' || "end" as s from found)
select d.doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(s, ',' order by start, rank) filter (where rank < 3), '')) as base_sha256, coalesce(string_agg(s, ',' order by start, rank), '') as spans
from texts d left join said using (doc_id) group by d.doc_id
"""
