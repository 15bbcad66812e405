"""The 88 features of a structure, in one aggregation by structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ALPHABET, AROMATIC, FEATURES, HYDROPHOBIC, NEGATIVE, POLAR, POSITIVE, REGION_WEIGHTS, REGIONS

#: Two alpha carbons nearer than this are neighbours.
RADIUS = 8.0
#: Alpha carbons of a structure that are compared with each of its loop's one by one.
FEW = 500


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is not put in place of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mean_std(values: Column) -> Column:
    """Struct of mean and population standard deviation of a not empty array."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return let(total(values) / F.size(values), lambda m: F.struct(m.alias("mean"), F.sqrt(total(F.transform(values, lambda v: (v - m) * (v - m))) / F.size(values)).alias("std")))


def distance(a: Column, b: Column) -> Column:
    dx, dy, dz = (a[c] - b[c] for c in ("x", "y", "z"))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def grouped(annotated: DataFrame) -> DataFrame:
    """One row for each structure: letters of each region, and alpha carbons in order. Everything else is computed in it."""
    point = F.struct("ordinal", F.col("ca_x").alias("x"), F.col("ca_y").alias("y"), F.col("ca_z").alias("z"), F.startswith("region", F.lit("CDR")).alias("cdr"))
    has = F.col("ca_x").isNotNull()
    letter = {r: F.sort_array(F.collect_list(F.when(F.col("region") == r, F.struct("ordinal", "one_letter")))) for r in REGIONS}
    rows = annotated.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.when(has, point))).alias("ca"), *(c.alias(f"_{r}") for r, c in letter.items()))
    texts = [F.array_join(F.transform(f"_{r}", lambda s: s["one_letter"]), "").alias(r) for r in REGIONS]
    return rows.select("structure_id", "ca", F.filter("ca", lambda p: p["cdr"]).alias("cdr_ca"), *texts, *(F.size(f"_{r}").alias(f"_n_{r}") for r in REGIONS))


def _share(text: Column, letters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{letters}]")) / F.greatest(F.length(text), F.lit(1))


def sequence_shares(letters: Column) -> dict[str, Column]:
    """A sequence's shares of charged, hydrophobic, polar and aromatic residues, as those of a region."""
    pos, neg = _share(letters, POSITIVE), _share(letters, NEGATIVE)
    return {"net_charge": pos - neg, "pos_frac": pos, "neg_frac": neg, "hydro": _share(letters, HYDROPHOBIC), "polar": _share(letters, POLAR), "aromatic": _share(letters, AROMATIC)}


def _geometry() -> Column:
    """Distances of pairs of loop alpha carbons and to their centroid; zeros below two."""
    ca = F.col("cdr_ca")
    pairs = F.flatten(F.transform(ca, lambda a, i: F.transform(F.slice(ca, i + 2, F.size(ca)), lambda b: distance(a, b))))
    mean = lambda c: F.aggregate(F.transform(ca, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size(ca)
    middle = F.struct(*(mean(c).alias(c) for c in ("x", "y", "z")))
    away = let(middle, lambda m: F.transform(ca, lambda p: distance(p, m)))
    none = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"))
    enough = F.size(ca) >= 2
    return F.struct(F.when(enough, _mean_std(pairs)).otherwise(none).alias("pair"), F.when(enough, _mean_std(away)).otherwise(none).alias("middle"))


def _counts_by_cells() -> Column:
    """As ``near_counts``, from a grid of cells over two coordinates that are no narrower than the radius: a point looks at nine cells. There are
    no more cells a side than the cube root of the points, so an empty space costs nothing."""
    ca = F.col("ca")
    ends = [(F.array_min(F.transform(ca, lambda p: p[c])), F.array_max(F.transform(ca, lambda p: p[c]))) for c in "xy"]  # noqa: B023
    # a little wider than the radius, so that rounding puts no neighbour two cells away
    frame = F.struct(*(c for k, (low, high) in enumerate(ends) for c in (low.alias(f"l{k}"), (F.greatest(F.lit(RADIUS), (high - low) / F.ceil(F.cbrt(F.size(ca)))) * (1 + 1e-9)).alias(f"w{k}"), high.alias(f"h{k}"))))

    def counts(f: Column) -> Column:
        cell = lambda v, k: F.floor((v - f[f"l{k}"]) / f[f"w{k}"]).cast("int")
        sides = [F.sequence(F.lit(0), cell(f[f"h{k}"], k)) for k in range(2)]
        grid = F.transform(sides[0], lambda i: let(F.filter(ca, lambda q: cell(q["x"], 0) == i), lambda slab: F.transform(sides[1], lambda j: F.filter(slab, lambda q: cell(q["y"], 1) == j))))

        def near(g: Column, p: Column) -> Column:
            found = (F.size(F.filter(F.get(F.get(g, cell(p["x"], 0) + di), cell(p["y"], 1) + dj), lambda q: distance(p, q) < RADIUS)) for di in (-1, 0, 1) for dj in (-1, 0, 1))
            return sum((F.coalesce(n, F.lit(0)) for n in found), F.lit(0))

        return let(grid, lambda g: F.transform("cdr_ca", lambda p: near(g, p)))

    return let(frame, counts)


def near_counts() -> Column:
    """How many alpha carbons are nearer than the radius to each loop alpha carbon, itself included. Structures of more than ``FEW`` are
    looked up in a grid; the counts are the same."""
    plain = F.transform("cdr_ca", lambda p: F.size(F.filter("ca", lambda q: distance(p, q) < RADIUS)))
    return F.when(F.size("ca") <= FEW, plain).otherwise(_counts_by_cells())


def _exposure() -> Column:
    """1 / ``near_counts`` of each loop alpha carbon; zeros without any."""
    return F.when(F.size("cdr_ca") > 0, _mean_std(F.transform(near_counts(), lambda n: F.lit(1.0) / n))).otherwise(F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std")))


def feature_columns() -> dict[str, Column]:
    out: dict[str, Column] = {f"{r}_length": F.col(f"_n_{r}").cast("double") for r in REGIONS}
    for r in REGIONS:
        out |= {f"{r}_frac_{a}": _share(F.col(r), a) for a in ALPHABET}
    shares = {r: sequence_shares(F.col(r)) for r in REGIONS}
    out |= {f"{r}_{k}": shares[r][k] for r in REGIONS for k in ("net_charge", "pos_frac", "neg_frac")}
    out |= {f"{r}_{k}": shares[r][k] for r in REGIONS for k in ("hydro", "polar", "aromatic")}
    out |= {"cdr_pw_dist_mean": F.col("_geo.pair.mean"), "cdr_pw_dist_std": F.col("_geo.pair.std"), "cdr_centroid_mean": F.col("_geo.middle.mean"), "cdr_centroid_std": F.col("_geo.middle.std")}
    out |= {"sasa_exposure_mean": F.col("_exp.mean"), "sasa_exposure_std": F.col("_exp.std")}
    score = None
    for r, w in REGION_WEIGHTS.items():
        part = F.col(f"_n_{r}") * F.lit(w)
        score = part if score is None else score + part
    out["hotspot_score"] = score
    assert tuple(out) == FEATURES
    return out


def extract_features(annotated: DataFrame) -> DataFrame:
    """(structure_id, the 88 features, cdr_sequences) for each structure: one shuffle by structure, then expressions within
    its row. Columns that a query leaves out are not computed."""
    rows = grouped(annotated).withColumn("_geo", _geometry()).withColumn("_exp", _exposure())
    columns = [c.alias(n) for n, c in feature_columns().items()]
    return rows.select("structure_id", *columns, F.create_map(*(x for r in REGIONS for x in (F.lit(r), F.col(r)))).alias("cdr_sequences"))


def residue_details(annotated: DataFrame) -> DataFrame:
    """The residue table for display."""
    return annotated.select("structure_id", "ordinal", F.col("chain_id").alias("chain"), "res_seq", "res_name", "one_letter", "imgt_pos", "region", F.bround("b_factor", 2).alias("b_factor"), F.startswith("region", F.lit("CDR")).alias("is_paratope_candidate"))
