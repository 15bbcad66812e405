"""Registered queries and their DuckDB SQL. Structures come from the residue view over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbering as numbers
from ..functions.annotate import annotate, classify_ranges, region_of
from ..operators import cluster, embed, features, geometry, report, scale
from ..schemas import ALPHABET, AROMATIC, FEATURES, HYDROPHOBIC, LETTERS, NEGATIVE, POLAR, POSITIVE, REGION_RANGES, REGION_WEIGHTS, REGIONS
from ..sources import structures as files
from ..storage import fresh_path, written
from .views import SQL as VIEW
from .views import annotated_view, residue_view, table, with_base

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r9(c: Column | str) -> Column:
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.round(c, 9) + F.lit(0.0)


def per_structure(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return features.extract_features(annotated_view(spark, sf_dir)).select("structure_id", *(r9(n).alias(n) for n in names))


def structs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.structures(annotated_view(spark, sf_dir), "seq_no")


# --- residues -------------------------------------------------------------------------------------------------------------

_REGION_CASE = "case " + " ".join(f"when {{0}} between {lo} and {hi} then '{n}'" for n, (lo, hi) in REGION_RANGES.items()) + " else 'framework' end"


@query(f"with {VIEW} select structure_id, count(*) as n_atoms, sum(res_seq)::bigint as sum_res_seq, round(sum(round(x, 3)), 3) + 0.0::double as sum_x, round(sum(round(y, 3)), 3) + 0.0::double as sum_y, round(sum(round(z, 3)), 3) + 0.0::double as sum_z, round(avg(b_factor), 6) as mean_b, string_agg(region, ',' order by ordinal) as regions from annotated group by structure_id")
def pdb_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues written as PDB records and read back by the scan."""
    rows = residue_view(spark, sf_dir)
    line = F.format_string("ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", F.col("ordinal"), F.col("res_seq"), *(F.col(f"ca_{c}").cast("double") for c in "xyz"), F.col("b_factor"))
    text = rows.groupBy("structure_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda s: s["line"]), "\n").alias("t"))
    atoms, _ = files.parse_structures(text.select(F.concat("structure_id", F.lit(".pdb")).alias("path"), F.encode("t", "UTF-8").alias("content")))
    back = annotate(files.residues(atoms))
    order = F.sort_array(F.collect_list(F.struct("ordinal", "region")))
    return back.groupBy("structure_id").agg(F.count("*").alias("n_atoms"), F.sum("res_seq").alias("sum_res_seq"), *((F.round(F.sum(F.round(f"ca_{c}", 3)), 3) + F.lit(0.0)).alias(f"sum_{c}") for c in "xyz"),
                                            F.round(F.avg("b_factor"), 6).alias("mean_b"), F.array_join(F.transform(order, lambda s: s["region"]), ",").alias("regions"))


def _written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residue view with residue names that its letters stand for."""
    names = F.create_map(*(F.lit(x) for n, a in LETTERS.items() for x in (a, n)))
    return residue_view(spark, sf_dir).withColumn("res_name", F.element_at(names, F.col("one_letter")))


def _joined(rows: DataFrame, lines: Column) -> DataFrame:
    return rows.groupBy("structure_id", "seq_no").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", lines.alias("lines")))), lambda s: s["lines"])), "\n").alias("t"))


@query(f"with {VIEW} select structure_id, count(*) as n, sum(res_seq)::bigint as sum_res_seq, round(sum(round(x, 3)), 3) + 0.0::double as sum_x, round(sum(round(y, 3)), 3) + 0.0::double as sum_y, round(sum(round(z, 3)), 3) + 0.0::double as sum_z, string_agg(one_letter, '' order by ordinal) as sequence from annotated group by structure_id")
def cif_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues written as mmCIF, author numbers beside others, quoted atom names and a comment, and read back by the scan."""
    fields = ("group_PDB", "id", "label_atom_id", "label_comp_id", "label_seq_id", "auth_seq_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv")
    head = "data_x\n# residues\nloop_\n" + "\n".join(f"_atom_site.{f}" for f in fields) + "\n"
    line = F.format_string("ATOM %d 'CA' %s 9 %d A %.3f %.3f %.3f 1.0 %.2f", F.col("ordinal"), F.col("res_name"), F.col("res_seq"), *(F.col(f"ca_{c}").cast("double") for c in "xyz"), F.col("b_factor"))
    text = _joined(_written_rows(spark, sf_dir), F.array(line))
    atoms, _ = files.parse_structures(text.select(F.concat("structure_id", F.lit(".mmCIF")).alias("path"), F.encode(F.concat(F.lit(head), "t", F.lit("\n#\n")), "UTF-8").alias("content")))
    order = F.sort_array(F.collect_list(F.struct("ordinal", "one_letter")))
    return files.residues(atoms).groupBy("structure_id").agg(F.count("*").alias("n"), F.sum("res_seq").alias("sum_res_seq"), *((F.round(F.sum(F.round(f"ca_{c}", 3)), 3) + F.lit(0.0)).alias(f"sum_{c}") for c in "xyz"),
                                                             F.array_join(F.transform(order, lambda s: s["one_letter"]), "").alias("sequence"))


@query(f"""with {VIEW} select 's' || (vec_id // 10) || case when vec_id % 10 = 0 then '' else '#' || (vec_id % 10 + 1) end as structure_id, count(*) as n, round(sum(round(x, 3)), 3) + 0.0::double as sum_x,
round(avg((b_factor + (b_factor + 10)) / 2), 6) as mean_b, string_agg(one_letter, '' order by ordinal) as sequence from annotated group by vec_id""")
def structure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ten folders that share stems, with alternate locations, two atoms a residue, water, and a second model."""
    x = [F.col(f"ca_{c}").cast("double") for c in "xyz"]
    record = lambda kind, atom, alt, name, at, occupancy, b: F.format_string(f"{kind:<6}%5d {atom:^4}{alt}%3s A%4d    %8.3f%8.3f%8.3f{occupancy:6.2f}%6.2f", F.col("ordinal"), name, F.col("res_seq"), *at, b)
    lines = F.array(record("ATOM", "CA", "A", F.col("res_name"), [x[0] + 1, *x[1:]], 0.4, F.col("b_factor") + 50), record("ATOM", "CA", "B", F.col("res_name"), x, 0.6, F.col("b_factor")),
                    record("ATOM", "N", " ", F.col("res_name"), x, 1.0, F.col("b_factor") + 10), record("HETATM", "O", " ", F.lit("HOH"), x, 1.0, F.col("b_factor")))
    text = _joined(_written_rows(spark, sf_dir), lines)
    v = F.col("seq_no")
    path = F.concat(F.lit("d"), (v % 10).cast("string"), F.lit("/s"), F.floor(v / 10).cast("string"), F.when(v % 2 == 0, ".pdb").otherwise(".pDB"))
    second = "\nENDMDL\nMODEL        2\nATOM      1  CA  GLY A 999       1.000   1.000   1.000  1.00  1.00\nENDMDL"
    atoms, _ = files.parse_structures(text.select(path.alias("path"), F.encode(F.concat(F.lit("MODEL        1\n"), "t", F.lit(second)), "UTF-8").alias("content")))
    order = F.sort_array(F.collect_list(F.struct("ordinal", "one_letter")))
    return files.residues(atoms).groupBy("structure_id").agg(F.count("*").alias("n"), (F.round(F.sum(F.round("ca_x", 3)), 3) + F.lit(0.0)).alias("sum_x"), F.round(F.avg("b_factor"), 6).alias("mean_b"), F.array_join(F.transform(order, lambda s: s["one_letter"]), "").alias("sequence"))


@query("""select 'f' || vec_id as structure_id, case vec_id % 4 when 0 then 'Unsupported file extension: .xyz' when 1 then '1 atom records cannot be read' when 2 then 'ValueError: no atom_site loop' else 'no atom records' end as error
from embeddings where vec_id % 5 <> 0""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind that cannot be read, among good ones: each is one row, and the good ones are read."""
    v = F.col("vec_id")
    good = "ATOM      1  CA  GLY A   1       1.000   1.000   1.000  1.00  1.00"
    kind = F.when(v % 5 == 0, ".pdb").when(v % 4 == 0, ".xyz").when(v % 4 == 2, ".cif").otherwise(".pdb")
    text = F.when(v % 5 == 0, good).when(v % 4 == 1, good.replace("   1.000", "   x.000", 1)).when(v % 4 == 2, "data_only").otherwise("REMARK")
    _, errors = files.parse_structures(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f"), v.cast("string"), kind).alias("path"), F.encode(text, "UTF-8").alias("content")))
    return errors


@query(f"select region, count(*) as n, min(p_size) as least, max(p_size) as most from (select p_size, {_REGION_CASE.format('p_size')} as region from part) group by region")
def region_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_size", region_of(F.col("p_size")).alias("region")).groupBy("region").agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("select region, count(*) as n from (select case when l_quantity::bigint between 1 and 5 then 'low' when l_quantity::bigint between 20 and 30 then 'middle' else 'framework' end as region from lineitem) group by region")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("low", 1, 5), ("middle", 20, 30)], "label string, lo long, hi long")
    return classify_ranges(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", ranges).groupBy("region").agg(F.count("*").alias("n"))


@query(f"with {VIEW} select structure_id, string_agg(one_letter, '' order by ordinal) as sequence, " + ", ".join(f"coalesce(string_agg(one_letter, '' order by ordinal) filter (where region = '{r}'), '') as \"{r}\"" for r in REGIONS) + " from annotated group by structure_id")
def sequence_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated_view(spark, sf_dir)
    whole = F.expr("listagg(one_letter, '') within group (order by ordinal)").alias("sequence")
    parts = [F.expr(f"coalesce(listagg(one_letter, '') within group (order by ordinal) filter (where region = '{r}'), '')").alias(r) for r in REGIONS]
    return rows.groupBy("structure_id").agg(whole, *parts)


@query(f"with {VIEW} select structure_id, ordinal, 'A' as chain, res_seq, 'UNK' as res_name, one_letter, res_seq as imgt_pos, region, round_even(b_factor, 2) as b_factor, region like 'CDR%' as is_paratope_candidate from annotated")
def residue_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.residue_details(annotated_view(spark, sf_dir))


@query(f"with {VIEW} select structure_id, ordinal, res_seq as imgt_pos, region from annotated")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues of files that count from 900, of ten families by label whose letters change along the chain: numbered again by profiles
    learnt from the view's own numbers. The SQL is the numbers that the files had."""
    k = F.col("ordinal")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("structure_id"), F.col("label").alias("profile"))
    letter = F.substring(F.lit(ALPHABET), (1 + (6 * k * k + 3 * k + F.col("profile")) % 20).cast("int"), F.lit(1))
    rows = residue_view(spark, sf_dir).join(labels, "structure_id").withColumn("one_letter", letter)
    aligner = numbers.Aligner.of(numbers.profiles_of(rows, position="res_seq"))
    return annotate(rows.withColumn("res_seq", (900 + k).cast("int")), aligner).select("structure_id", "ordinal", F.col("imgt_pos").cast("int").alias("imgt_pos"), "region")


# --- features -------------------------------------------------------------------------------------------------------------

_LETTERS = "letters as (select structure_id, " + ", ".join(f"coalesce(string_agg(one_letter, '' order by ordinal) filter (where region = '{r}'), '') as \"{r}\"" for r in REGIONS) + " from annotated group by structure_id)"


def _share_sql(region: str, letters: str) -> str:
    return f"length(regexp_replace(\"{region}\", '[^{letters}]', '', 'g'))::double / greatest(length(\"{region}\"), 1)"


_FEATURE_SQL: dict[str, str] = {f"{r}_length": f"length(\"{r}\")::double" for r in REGIONS}
for _r in REGIONS:
    _FEATURE_SQL |= {f"{_r}_frac_{a}": _share_sql(_r, a) for a in ALPHABET}
for _r in REGIONS:
    _FEATURE_SQL |= {f"{_r}_net_charge": f"{_share_sql(_r, POSITIVE)} - {_share_sql(_r, NEGATIVE)}", f"{_r}_pos_frac": _share_sql(_r, POSITIVE), f"{_r}_neg_frac": _share_sql(_r, NEGATIVE)}
for _r in REGIONS:
    _FEATURE_SQL |= {f"{_r}_hydro": _share_sql(_r, HYDROPHOBIC), f"{_r}_polar": _share_sql(_r, POLAR), f"{_r}_aromatic": _share_sql(_r, AROMATIC)}
_FEATURE_SQL |= {"cdr_pw_dist_mean": "coalesce(pm, 0)", "cdr_pw_dist_std": "coalesce(ps, 0)", "cdr_centroid_mean": "coalesce(cm, 0)", "cdr_centroid_std": "coalesce(cs, 0)", "sasa_exposure_mean": "coalesce(em, 0)", "sasa_exposure_std": "coalesce(es, 0)",
                 "hotspot_score": " + ".join(f"length(\"{r}\") * {w}::double" for r, w in REGION_WEIGHTS.items())}

_GEOMETRY = """
loops as (select * from annotated where region like 'CDR%'),
pair as (select a.structure_id, avg(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) as pm, stddev_pop(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) as ps from loops a join loops b on a.structure_id = b.structure_id and a.ordinal < b.ordinal group by a.structure_id),
middle as (select structure_id, avg(x) as mx, avg(y) as my, avg(z) as mz, count(*) as n from loops group by structure_id),
away as (select structure_id, avg(d) as cm, stddev_pop(d) as cs from (select l.structure_id, sqrt((x-mx)**2 + (y-my)**2 + (z-mz)**2) as d from loops l join middle m using (structure_id) where n >= 2) group by structure_id),
near as (select a.structure_id, a.ordinal, 1.0::double / count(*) as e from loops a join annotated b on a.structure_id = b.structure_id and sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) < 8.0 group by a.structure_id, a.ordinal),
exposed as (select structure_id, avg(e) as em, stddev_pop(e) as es from near group by structure_id)
"""


def _features_sql(names: list[str]) -> str:
    return (f"with {VIEW}, {_LETTERS}, {_GEOMETRY} select structure_id, " + ", ".join(f"round({_FEATURE_SQL[n]}, 9) + 0.0::double as \"{n}\"" for n in names)
            + " from letters left join pair using (structure_id) left join away using (structure_id) left join exposed using (structure_id)")


_GROUPS = {
    "region_lengths": [n for n in FEATURES if n.endswith("_length")], "hotspot_score": ["hotspot_score"], "aa_composition": [n for n in FEATURES if "_frac_" in n],
    "charge_features": [n for n in FEATURES if n.endswith(("_charge", "_pos_frac", "_neg_frac"))], "hydro_polar_aromatic": [n for n in FEATURES if n.endswith(("_hydro", "_polar", "_aromatic"))],
    "ca_geometry": [n for n in FEATURES if n.startswith("cdr_")], "sasa_proxy": [n for n in FEATURES if n.startswith("sasa_")], "feature_vector": list(FEATURES),
}
for _name, _columns in _GROUPS.items():
    QUERIES[_name] = lambda spark, sf_dir, c=_columns: per_structure(spark, sf_dir, c)
    SQL[_name] = _features_sql(_columns)


# --- scaling and projection ---------------------------------------------------------------------------------------------------

DIMS = 64
#: Neighbours of a row in the layouts' graph.
GRAPH = 15


def wide(spark: SparkSession, sf_dir: str, n: int = DIMS) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", k).cast("double").alias(f"e{k}") for k in range(n)))


@query("with w as (select vec_id, " + ", ".join(f"embedding[{k + 1}]::double as e{k}" for k in range(DIMS)) + " from embeddings), s as (select " + ", ".join(f"avg(e{k}) as m{k}, stddev_pop(e{k}) as s{k}" for k in range(DIMS)) + " from w) select vec_id, "
       + ", ".join(f"round((e{k} - m{k}) / case when s{k} = 0 then 1 else s{k} end, 7) + 0.0::double as e{k}" for k in range(DIMS)) + " from w, s")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"e{k}" for k in range(DIMS)]
    return scale.standardize(wide(spark, sf_dir), names).select("vec_id", *((F.round(n, 7) + F.lit(0.0)).alias(n) for n in names))


@query("with long as (select vec_id, unnest(generate_series(0, len(embedding) - 1))::int as k, unnest(embedding)::double as v from embeddings) select a.k as i, b.k as j, round(covar_pop(a.v, b.v), 9) + 0.0::double as cov from long a join long b on a.vec_id = b.vec_id and a.k <= b.k group by a.k, b.k")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.covariance(wide(spark, sf_dir), [f"e{k}" for k in range(DIMS)]).select("i", "j", r9("cov").alias("cov"))


def standard_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"e{k}" for k in range(DIMS)]
    return scale.standardize(wide(spark, sf_dir), names).select(F.col("vec_id").alias("seq_no"), F.array(*names).alias("vector"))


def _axes_sql(steps: int = 24) -> str:
    """Principal axes by squaring the covariance matrix over and over: its powers tend to the projector on the first axis, whose
    largest column is the axis; taken off, the next one follows."""
    out = ["""long as materialized (select vec_id, unnest(generate_series(0, len(embedding) - 1))::int as k, unnest(embedding)::double as v from embeddings),
 stats as (select k, avg(v) as m, stddev_pop(v) as s from long group by k),
 std as materialized (select vec_id, k, (v - m) / case when s = 0 then 1 else s end as v from long join stats using (k)),
 cov0 as materialized (select a.k as i, b.k as j, avg(a.v * b.v) as v from std a join std b using (vec_id) group by a.k, b.k)"""]
    for axis in range(3):
        out.append(f"p{axis}_0 as materialized (select i, j, v / (select sum(v) from cov{axis} where i = j) as v from cov{axis})")
        for t in range(steps):
            out.append(f"q{axis}_{t} as materialized (select a.i, b.j, sum(a.v * b.v) as v from p{axis}_{t} a join p{axis}_{t} b on a.j = b.i group by a.i, b.j)")
            out.append(f"p{axis}_{t + 1} as materialized (select i, j, v / (select sum(v) from q{axis}_{t} where i = j) as v from q{axis}_{t})")
        last = f"p{axis}_{steps}"
        out.append(f"""column{axis} as materialized (select i, v from {last} where j = (select arg_max(i, v) from {last} where i = j)),
 axis{axis} as materialized (select i, v / sqrt((select sum(v * v) from column{axis})) * sign((select arg_max(v, abs(v)) from column{axis})) as v from column{axis}),
 value{axis} as materialized (select sum(x.v * c.v * y.v) as v from cov{axis} c join axis{axis} x on x.i = c.i join axis{axis} y on y.i = c.j),
 cov{axis + 1} as materialized (select c.i, c.j, c.v - (select v from value{axis}) * x.v * y.v as v from cov{axis} c join axis{axis} x on x.i = c.i join axis{axis} y on y.i = c.j)""")
    return ",\n ".join(out)


@query(f"with {_axes_sql()} select vec_id, " + ", ".join(f"round(sum(s.v * axis{k}.v), 6) + 0.0::double as dim{k + 1}" for k in range(3)) + " from std s " + " ".join(f"join axis{k} on axis{k}.i = s.k" for k in range(3)) + " group by vec_id")
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.reduce_dimensions(standard_vectors(spark, sf_dir), "pca").select(F.col("seq_no").alias("vec_id"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("dim1", "dim2", "dim3")))


@query(f"""with long as (select vec_id, unnest(generate_series(0, len(embedding) - 1))::int as k, unnest(embedding)::double as v from embeddings), stats as (select k, avg(v) as m, stddev_pop(v) as s from long group by k),
 std as (select vec_id, list((v - m) / case when s = 0 then 1 else s end order by k) as x from long join stats using (k) group by vec_id),
 far as (select a.vec_id, b.vec_id as near_id, list_distance(a.x, b.x) as d from std a join std b on a.vec_id <> b.vec_id)
 select vec_id, rank, near_id, round(d, 6) as distance from (select *, row_number() over (partition by vec_id order by d, near_id)::int as rank from far) where rank <= {GRAPH}""")
def nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours of every row that the layouts of many rows start from."""
    rows = cluster.numbered(standard_vectors(spark, sf_dir), "seq_no", "i").withColumn("i", F.col("i").cast("long"))
    rows = written(rows, "numbered")
    ids = rows.select("i", "seq_no")
    near = embed.nearest(rows.select("i", "vector"), rows.count(), GRAPH).select("i", F.posexplode("near").alias("rank", "e"))
    named = near.join(ids.select("i", F.col("seq_no").alias("vec_id")), "i").join(ids.select(F.col("i").alias("_j"), F.col("seq_no").alias("near_id")), F.col("e.j") == F.col("_j"))
    return named.select("vec_id", (F.col("rank") + 1).alias("rank"), "near_id", F.round("e.d", 6).alias("distance"))


@query()
def tsne_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.reduce_dimensions(standard_vectors(spark, sf_dir), "tsne", 2).select(F.col("seq_no").alias("vec_id"), "dim1", "dim2", "dim3")


@query()
def umap_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.reduce_dimensions(standard_vectors(spark, sf_dir), "umap", 3).select(F.col("seq_no").alias("vec_id"), "dim1", "dim2", "dim3")


# --- pairs and clusters -------------------------------------------------------------------------------------------------------

_RANKED = """ranked as (select *, row_number() over (partition by vec_id order by ordinal) as rn, count(*) over (partition by vec_id) as n from annotated where region like 'CDR%'),
 frames as (select vec_id, count(*) as nf from annotated where region = 'framework' group by vec_id)"""
_PAIRED = """paired as (select a.vec_id as vi, b.vec_id as vj, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz from ranked a join ranked b on a.vec_id < b.vec_id and a.rn = b.rn and a.rn <= least(a.n, b.n)
 join frames f on f.vec_id = a.vec_id join frames g on g.vec_id = b.vec_id where least(f.nf, g.nf) >= 3 {0})"""


@query(f"with {VIEW}, {_RANKED}, {_PAIRED.format('')} select vi::varchar as i, vj::varchar as j, round(sqrt(avg((ax-bx)**2 + (ay-by_)**2 + (az-bz)**2)), 8) as rmsd from paired group by vi, vj")
def pair_rmsd_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pair_rmsd_unaligned(structs_view(spark, sf_dir)).select("i", "j", F.round("rmsd", 8).alias("rmsd"))


@query(f"with {VIEW}, {_RANKED}, {_PAIRED.format('')}, centred as (select vi, vj, avg(ax) as ma, avg(ay) as mb, avg(az) as mc, avg(bx) as na, avg(by_) as nb, avg(bz) as nc from paired group by vi, vj)"
       " select vi::varchar as i, vj::varchar as j, round(sqrt(avg(((ax-ma)-(bx-na))**2 + ((ay-mb)-(by_-nb))**2 + ((az-mc)-(bz-nc))**2)), 8) as rmsd from paired join centred using (vi, vj) group by vi, vj")
def pair_rmsd_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pair_rmsd_unaligned(structs_view(spark, sf_dir), centred=True).select("i", "j", F.round("rmsd", 8).alias("rmsd"))


def _superposed_sql() -> str:
    """Common table expressions up to ``superposed`` (vi, vj, rmsd): the unit quaternion that turns the second framework onto the
    first is the eigenvector of the largest eigenvalue of a symmetric matrix (Horn 1987). The eigenvalue comes by Newton's steps
    on the characteristic polynomial, from above; the eigenvector is the largest column of the adjugate."""
    axes = "xyz"
    sums = lambda p: ", ".join(f"sum(b.{c} * a.{d}) as {p}{c}{d}" for c in axes for d in axes)
    n = [["sxx + syy + szz", "syz - szy", "szx - sxz", "sxy - syx"], ["syz - szy", "sxx - syy - szz", "sxy + syx", "szx + sxz"],
         ["szx - sxz", "sxy + syx", "syy - sxx - szz", "syz + szy"], ["sxy - syx", "szx + sxz", "syz + szy", "szz - sxx - syy"]]

    def minor(m: list[list[str]], i: int, j: int) -> str:
        (a, b, c), (d, e, f), (g, h, k) = ([m[r][x] for x in range(4) if x != j] for r in range(4) if r != i)
        return f"({a} * ({e} * {k} - {f} * {h}) - {b} * ({d} * {k} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    plain = [[f"n{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    less = [[f"({plain[i][j]} - l)" if i == j else plain[i][j] for j in range(4)] for i in range(4)]
    det = " + ".join(f"{'-' if j % 2 else ''}n0{j} * {minor(plain, 0, j)}" for j in range(4))
    columns = ", ".join("[" + ", ".join(f"{'-' if (i + j) % 2 else ''}{minor(less, i, j)}" for i in range(4)) + f"] as v{j}" for j in range(4))
    turn = {"xx": "q[1]*q[1] + q[2]*q[2] - q[3]*q[3] - q[4]*q[4]", "xy": "2 * (q[2]*q[3] - q[1]*q[4])", "xz": "2 * (q[2]*q[4] + q[1]*q[3])", "yx": "2 * (q[3]*q[2] + q[1]*q[4])", "yy": "q[1]*q[1] - q[2]*q[2] + q[3]*q[3] - q[4]*q[4]",
            "yz": "2 * (q[3]*q[4] - q[1]*q[2])", "zx": "2 * (q[4]*q[2] - q[1]*q[3])", "zy": "2 * (q[4]*q[3] + q[1]*q[2])", "zz": "q[1]*q[1] - q[2]*q[2] - q[3]*q[3] + q[4]*q[4]"}
    norm = lambda v: f"list_sum(list_transform({v}, lambda x: x * x))"
    # sums of products of the loops' points, seen from the frameworks' centroids: of one structure with itself, and of both
    own = " + ".join(f"p{k}{c}{c} - 2 * {k}{c} * l{k}{c} + nl * {k}{c} * {k}{c}" for k in "tm" for c in axes)
    cross = " + ".join(f"({turn[c + d]}) * (u{d}{c} - t{c} * lm{d} - m{d} * lt{c} + nl * t{c} * m{d})" for c in axes for d in axes)
    return f"""
place as (select vec_id, region = 'framework' as fw, row_number() over (partition by vec_id, region = 'framework' order by ordinal) as rn, x, y, z from annotated),
frame as (select a.vec_id as vi, b.vec_id as vj, count(*) as nf, {", ".join(f"avg(a.{c}) as t{c}, avg(b.{c}) as m{c}" for c in axes)}, {sums("r")}, sum(a.x*a.x + a.y*a.y + a.z*a.z + b.x*b.x + b.y*b.y + b.z*b.z) as g
  from place a join place b on a.vec_id < b.vec_id and a.rn = b.rn and a.fw and b.fw group by a.vec_id, b.vec_id having count(*) >= 3),
spread as (select *, {", ".join(f"r{c}{d} - nf * m{c} * t{d} as s{c}{d}" for c in axes for d in axes)}, g - nf * ({" + ".join(f"t{c}*t{c} + m{c}*m{c}" for c in axes)}) as e from frame),
horn as (select *, {", ".join(f"{n[i][j]} as n{i}{j}" for i in range(4) for j in range(i, 4))}, -2 * ({" + ".join(f"s{c}{d}*s{c}{d}" for c in axes for d in axes)}) as c2,
  -8 * (sxx * (syy * szz - syz * szy) - sxy * (syx * szz - syz * szx) + sxz * (syx * szy - syy * szx)) as c1 from spread),
poly as (select *, {det} as c0 from horn),
eigen as (select *, list_reduce(list_prepend(e / 2, list_transform(range(60), lambda k: 0.0::double)), lambda l, z: l - (((l * l + c2) * l + c1) * l + c0) / ((4 * l * l + 2 * c2) * l + c1)) as l from poly),
columns as (select *, {columns} from eigen),
longest as (select * exclude (v0, v1, v2, v3), list_sort([{", ".join(f"{{'n': {norm(f'v{j}')}, 'v': v{j}}}" for j in range(4))}])[4] as w from columns),
unit as (select *, list_transform(w.v, lambda x: x / sqrt(w.n)) as q from longest),
loops as (select a.vec_id as vi, b.vec_id as vj, count(*) as nl, {", ".join(f"sum(a.{c}) as lt{c}, sum(b.{c}) as lm{c}, sum(a.{c}*a.{c}) as pt{c}{c}, sum(b.{c}*b.{c}) as pm{c}{c}" for c in axes)}, {sums("u")}
  from place a join place b on a.vec_id < b.vec_id and a.rn = b.rn and not a.fw and not b.fw group by a.vec_id, b.vec_id),
superposed as (select vi, vj, sqrt(greatest(({own} - 2 * ({cross})) / nl, 0)) as rmsd from unit join loops using (vi, vj))
"""


_SUPERPOSED = _superposed_sql()


@query(f"with {VIEW}, {_SUPERPOSED} select vi::varchar as i, vj::varchar as j, round(rmsd, 6) as rmsd from superposed")
def pair_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pair_rmsd(structs_view(spark, sf_dir)).select("i", "j", F.round("rmsd", 6).alias("rmsd"))


@query(f"with {VIEW}, {_SUPERPOSED} select vi::varchar as i, vj::varchar as j, round(rmsd, 6) as rmsd from superposed where rmsd < 1.25")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.near_pairs(structs_view(spark, sf_dir), 1.25).select("i", "j", F.round("rmsd", 6).alias("rmsd"))


# computed from the distances: where every component of near pairs is a clique, complete linkage yields the components, and a
# structure's cluster is that of its first neighbour; a component that is none gives a null and so a mismatch
@query(f"""with {VIEW}, {_SUPERPOSED}, near as (select vi, vj from superposed where rmsd < 1.25 union all select vj, vi from superposed where rmsd < 1.25 union all select vec_id, vec_id from embeddings),
firsts as (select vi, min(vj) as f, count(*) as n from near group by vi), sizes as (select f, count(*) as m from firsts group by f),
named as (select vi, case when n = m then f end as f from firsts join sizes using (f))
select vi::varchar as structure_id, (dense_rank() over (order by f) - 1)::int as structural_cluster, f::varchar as representative from named""")
def structural_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.structural_clusters(written(structs_view(spark, sf_dir), "structures"), 1.25).select("structure_id", "structural_cluster", "representative")


@query("select vec_id, (vec_id // 10)::int as cluster from embeddings")
def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [(F.get("base", k).cast("double") + 0.05 * F.get("own", k).cast("double")).alias(f"e{k}") for k in range(DIMS)]
    names = [f"e{k}" for k in range(DIMS)]
    points = scale.standardize(with_base(spark, sf_dir).select("vec_id", *columns), names).select("vec_id", F.array(*names).alias("vector"))
    return cluster.density_clusters(points, 3, key="vec_id").select("vec_id", "cluster")


# --- reports ----------------------------------------------------------------------------------------------------------------------

_SCORED = f"{VIEW}, {_LETTERS}, scored as (select l.structure_id, l.structure_id::bigint as seq_no, a.label as cluster, {_FEATURE_SQL['hotspot_score']} as hotspot_score from letters l join embeddings a on a.vec_id = l.structure_id::bigint)"


@query(f"with {_SCORED} select cluster, count(*) as members, arg_min(structure_id, (1e6 - hotspot_score) * 1e6 + seq_no) as representative, round(avg(hotspot_score), 9) as mean_hotspot from scored group by cluster")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("structure_id"), F.col("vec_id").alias("seq_no"), F.col("label").alias("cluster"))
    scored = features.extract_features(annotated_view(spark, sf_dir)).select("structure_id", "hotspot_score").join(labels, "structure_id")
    # nine digits: sums in another order may fall on either side of a tie at three
    return report.cluster_summary(scored.withColumnRenamed("structure_id", "structure"), "seq_no", 9)


@query(f"with {VIEW}, {_SUPERPOSED} select vi::varchar as i, vj::varchar as j, round(rmsd, 6) as rmsd from superposed union all select vj::varchar, vi::varchar, round(rmsd, 6) from superposed union all select vec_id::varchar, vec_id::varchar, 0.0::double from embeddings")
def rmsd_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the heatmap of superposed distances over all structures, in long form."""
    return report.rmsd_cells(structs_view(spark, sf_dir)).select("i", "j", F.round("rmsd", 6).alias("rmsd"))


def _result(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.extract_features(annotated_view(spark, sf_dir))
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("structure_id"), F.col("label").alias("cluster"), F.get("embedding", 0).cast("double").alias("dim1"), F.get("embedding", 1).cast("double").alias("dim2"))
    out = report.result_table(found, ids, ids)
    return out.select("structure", *(F.round(c, 6).alias(c) for c in ("dim1", "dim2", "dim3")), "cluster", F.round("hotspot_score", 6).alias("hotspot_score"), *(F.col(f"`{r}`") for r in REGIONS))


_RESULT = (f"with {VIEW}, {_LETTERS} select l.structure_id as structure, round(embedding[1]::double, 6) as dim1, round(embedding[2]::double, 6) as dim2, 0.0::double as dim3, label as cluster, round({_FEATURE_SQL['hotspot_score']}, 6) as hotspot_score, "
           + ", ".join(f'"{r}"' for r in REGIONS) + " from letters l join embeddings a on a.vec_id = l.structure_id::bigint")
QUERIES["result_table"], SQL["result_table"] = _result, _RESULT


@query(f"select structure, dim1, dim2, dim3, cluster::varchar as cluster, hotspot_score, {', '.join(chr(34) + r + chr(34) for r in REGIONS)} from ({_RESULT})")
def scatter_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scatter_data(_result(spark, sf_dir))


@query(f"with {VIEW} select structure_id, ordinal, res_seq, one_letter, region from annotated where structure_id = '42'")
def detail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residues of one structure: a lookup by name is what the operator does."""
    return report.details_of(features.residue_details(annotated_view(spark, sf_dir)), "42").select("structure_id", "ordinal", "res_seq", "one_letter", "region")


@query(f"with {VIEW} select structure_id, ordinal, near from (select a.structure_id, a.ordinal, count(*) - 1 as near from annotated a join annotated b on a.structure_id = b.structure_id and sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) < 8.0 where a.region like 'CDR%' group by a.structure_id, a.ordinal)")
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha carbons within the radius of each loop alpha carbon, itself left out."""
    rows = features.grouped(annotated_view(spark, sf_dir))
    near = F.zip_with("cdr_ca", features.near_counts(), lambda p, n: F.struct(p["ordinal"].alias("ordinal"), (n - 1).cast("long").alias("near")))
    return rows.select("structure_id", F.inline(near))


@query(_RESULT)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _result(spark, sf_dir)
    path = fresh_path(spark, "csv")
    report.write_csv(result, path)
    return spark.read.schema(result.schema).option("header", True).option("emptyValue", "").csv(path).fillna("", list(REGIONS))


@query(f"with {_SCORED} select structure_id, cluster, rank, score from (select structure_id, cluster, row_number() over (partition by cluster order by hotspot_score desc, seq_no)::int as rank, round(hotspot_score, 9) as score from scored) where rank <= 3")
def top_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three highest scores of each cluster."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("structure_id"), F.col("vec_id").alias("seq_no"), F.col("label").alias("cluster"))
    scored = features.extract_features(annotated_view(spark, sf_dir)).select("structure_id", "hotspot_score").join(labels, "structure_id")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("hotspot_score"), "seq_no"))
    return scored.withColumn("rank", rank).where("rank <= 3").select("structure_id", "cluster", "rank", r9("hotspot_score").alias("score"))


FLAGSHIP = QUERIES["cluster_summary"]
#: Pieces of SQL that the jobs' queries are made of as well.
LETTERS_SQL, FEATURE_SQL, SHARE_SQL, SUPERPOSED_SQL = _LETTERS, _FEATURE_SQL, _share_sql, _SUPERPOSED
