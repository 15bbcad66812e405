"""The scan: records, models, alternate locations, mmCIF, and files that cannot be read."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.functions.annotate import annotate, classify_ranges, region_of
from loopweave.operators import features
from loopweave.operators.features import extract_features, residue_details
from loopweave.sources.structures import cif_atoms, cif_tokens, from_bytes, parse_structures, read_structures, residues, sequences


def atom(serial, name, res, chain, seq, x, y, z, b=10.0, occ=1.0, alt=" ", icode=" ", record="ATOM"):
    return f"{record:<6}{serial:>5} {name:^4}{alt}{res:>3} {chain}{seq:>4}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}           {name[0]}"


SMALL = "\n".join([
    atom(1, "N", "GLY", "A", 1, 1, 2, 3, 30), atom(2, "CA", "GLY", "A", 1, 2, 3, 4, 30), atom(3, "C", "GLY", "A", 1, 3, 4, 5, 30),
    atom(4, "N", "ALA", "A", 2, 5, 6, 7, 20), atom(5, "CA", "ALA", "A", 2, 6, 7, 8, 30), atom(6, "CA", "ARG", "A", 3, 10, 11, 12, 20), "END",
])

CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 CA . GLY X 7 ? 2.0 3.0 4.0 1.0 30.0 1 A 1
ATOM 2 "O5'" . GLY X 7 ? 2.5 3.0 4.0 1.0 10.0 1 A 1
ATOM 3 CA . TRP X 8 ? 6.0 7.0 8.0 1.0 25.0 2 A 1
HETATM 4 O . HOH Y 9 ? 0 0 0 1.0 1.0 3 A 1
ATOM 5 CA . GLY X 7 ? 9.0 9.0 9.0 1.0 1.0 1 A 2
#
"""


def scan(spark, **files):
    return parse_structures(from_bytes(spark, [(n.replace("__", "."), t.encode()) for n, t in files.items()]))


def rows(df):
    return [r.asDict() for r in df.orderBy("structure_id", "ordinal").collect()]


def test_small_file(spark):
    atoms, errors = scan(spark, small__pdb=SMALL)
    got = rows(residues(atoms))
    assert [(r["res_seq"], r["res_name"], r["one_letter"], r["b_factor"]) for r in got] == [(1, "GLY", "G", 30.0), (2, "ALA", "A", 25.0), (3, "ARG", "R", 20.0)]
    assert (got[0]["ca_x"], got[0]["ca_y"], got[0]["ca_z"]) == (2.0, 3.0, 4.0)
    assert errors.count() == 0
    assert [r.sequence for r in sequences(residues(atoms)).collect()] == ["GAR"]
    assert {r["region"] for r in rows(annotate(residues(atoms)))} == {"framework"}


def test_models_hetero_alternates_insertions(spark):
    text = "\n".join([
        "MODEL        1", atom(1, "CA", "GLY", "B", 5, 1, 0, 0), atom(2, "CA", "SER", "A", 5, 2, 0, 0, occ=0.4, alt="A"), atom(3, "CA", "SER", "A", 5, 3, 0, 0, occ=0.6, alt="B"), atom(4, "CA", "THR", "A", 5, 4, 0, 0, icode="A"),
        atom(5, "CB", "XYZ", "A", 6, 4, 0, 0), atom(6, "O", "HOH", "A", 7, 0, 0, 0, record="HETATM"), "ENDMDL", "MODEL        2", atom(7, "CA", "GLY", "B", 9, 1, 0, 0), "ENDMDL",
    ])
    got = rows(residues(scan(spark, m__PDB=text)[0]))
    assert [(r["chain_id"], r["res_seq"], r["icode"], r["one_letter"], r["ca_x"]) for r in got] == [("B", 5, "", "G", 1.0), ("A", 5, "", "S", 3.0), ("A", 5, "A", "T", 4.0), ("A", 6, "", "X", None)]


def test_mmcif(spark):
    atoms, errors = scan(spark, c__cif=CIF, d__mmcif=CIF)
    got = rows(residues(atoms))
    assert [(r["structure_id"], r["chain_id"], r["res_seq"], r["one_letter"], r["b_factor"]) for r in got] == [(s, "A", n, a, b) for s in "cd" for n, a, b in ((1, "G", 20.0), (2, "W", 25.0))]
    assert errors.count() == 0
    assert list(cif_tokens("a 'b c' # no\n;x\ny\n;\n\"d'e\"")) == [("a", False), ("b c", True), ("x\ny", True), ("d'e", True)]
    with pytest.raises(ValueError):
        cif_atoms("data_only")


def test_bad_files_leave_the_others(spark):
    broken = SMALL.replace("   6.000", "   x.000", 1)
    atoms, errors = scan(spark, a__pdb=SMALL, b__pdb=broken, c__xyz="1", d__cif="loop_\n_atom_site.id\n1", e__pdb="")
    assert {r.structure_id for r in atoms.select("structure_id").distinct().collect()} == {"a"}
    found = {r.structure_id: r.error for r in errors.collect()}
    assert set(found) == {"b", "c", "d", "e"} and found["c"] == "Unsupported file extension: .xyz"


def test_files_of_one_stem_are_structures_of_their_own(spark, tmp_path):
    other = SMALL.replace("GLY", "TRP")
    for name, text in (("d1/x.pdb", SMALL), ("d2/x.pdb", other), ("x.cif", CIF), ("x#2.pdb", SMALL), ("y#2.pdb", SMALL), ("b.mmCIF", CIF), ("c.pDB", SMALL), ("d2/c.Cif", "broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found, errors = read_structures(spark, str(tmp_path))
    letters = {r.structure_id: r.sequence for r in sequences(found).collect()}
    # paths in order: d1/x.pdb, d2/x.pdb, x#2.pdb, x.cif; c.pDB before d2/c.Cif
    assert letters == {"x": "GAR", "x#2": "WAR", "x#3": "GAR", "x#4": "GW", "y#2": "GAR", "b": "GW", "c": "GAR"}
    assert {r.structure_id for r in errors.collect()} == {"c#2"}
    again = from_bytes(spark, [("a.pdb", SMALL.encode()), ("a.pdb", other.encode())])
    assert {r.structure_id: r.sequence for r in sequences(residues(parse_structures(again)[0])).collect()} == {"a": "WAR", "a#2": "GAR"}


def test_folder(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(SMALL)
    (tmp_path / "two.CIF").write_text(CIF)
    (tmp_path / "no.txt").write_text("x")
    found, errors = read_structures(spark, str(tmp_path))
    assert {r.structure_id for r in found.collect()} == {"one", "two"} and errors.count() == 0


@pytest.mark.parametrize("position,region", [(26, "framework"), (27, "CDR-H1"), (38, "CDR-H1"), (39, "framework"), (55, "framework"), (56, "CDR-H2"), (65, "CDR-H2"), (66, "framework"), (104, "framework"), (105, "CDR-H3"), (117, "CDR-H3"), (118, "framework"), (1, "framework")])
def test_region_bounds(spark, position, region):
    from pyspark.sql import functions as F

    assert spark.range(1).select(region_of(F.lit(position))).first()[0] == region


def test_ranges_from_a_table(spark):
    values = spark.createDataFrame([(1,), (5,), (9,), (None,)], "v int")
    ranges = spark.createDataFrame([("a", 1, 5), ("b", 5, 6)], "label string, lo int, hi int")
    assert sorted((r.v is None, r.v, r.region) for r in classify_ranges(values, "v", ranges).collect()) == [(False, 1, "a"), (False, 5, "a"), (False, 9, "framework"), (True, None, "framework")]


def test_long_ranges_and_fractions(spark):
    values = spark.createDataFrame([(5.0,), (5.9,), (6.0,), (9e8,), (-3.0,), (2e9,)], "v double")
    ranges = spark.createDataFrame([("a", 1, 5), ("b", 6, 10**9), ("c", -10, 10**9), ("empty", 9, 5)], "label string, lo long, hi long")
    got = {r.v: r.region for r in classify_ranges(values, "v", ranges).collect()}
    assert got == {5.0: "c", 5.9: "c", 6.0: "c", 9e8: "c", -3.0: "c", 2e9: "framework"}
    got = {r.v: r.region for r in classify_ranges(values, "v", ranges.where("label <> 'c'")).collect()}
    assert got == {5.0: "a", 5.9: "framework", 6.0: "b", 9e8: "b", -3.0: "framework", 2e9: "framework"}


def test_renumbering_falls_back(spark):
    atoms, _ = scan(spark, a__pdb=SMALL)
    moved = rows(annotate(residues(atoms), lambda s: [27, None]))
    assert [(r["imgt_pos"], r["region"]) for r in moved] == [(27, "CDR-H1"), (2, "framework"), (3, "framework")]

    def fails(s):
        raise RuntimeError("no tool")

    assert [r["imgt_pos"] for r in rows(annotate(residues(atoms), fails))] == [1, 2, 3]


def annotated(spark, data):
    return spark.createDataFrame([("s", k, "A", 0, "", "GLY", a, *(xyz or (None,) * 3), 1.005, 0, region) for k, (a, region, xyz) in enumerate(data)],
                                 "structure_id string, ordinal int, chain_id string, res_seq int, icode string, res_name string, one_letter string, ca_x double, ca_y double, ca_z double, b_factor double, imgt_pos int, region string")


def test_features(spark):
    row = extract_features(annotated(spark, [("A", "framework", (0.0, 0.0, 0.0)), ("R", "CDR-H1", (1.0, 1.0, 1.0)), ("D", "CDR-H2", (5.0, 5.0, 5.0)), ("W", "CDR-H3", (10.0, 10.0, 10.0))])).first()
    assert len(row) == 90 and row["hotspot_score"] == pytest.approx(1.0)
    assert row["CDR-H1_net_charge"] == 1 and row["CDR-H2_net_charge"] == -1 and row["CDR-H3_aromatic"] == 1 and row["CDR-H1_frac_R"] == 1
    a = 3**0.5
    assert row["cdr_pw_dist_mean"] == pytest.approx((4 + 9 + 5) * a / 3)
    assert row["cdr_sequences"] == {"CDR-H1": "R", "CDR-H2": "D", "CDR-H3": "W"}


def test_features_without_carbons_and_unknown(spark):
    row = extract_features(annotated(spark, [("G", "CDR-H1", None), ("S", "CDR-H1", None), ("X", "CDR-H2", None), ("A", "CDR-H2", None)])).first()
    assert row["cdr_sequences"]["CDR-H1"] == "GS" and row["sasa_exposure_mean"] == 0 == row["cdr_centroid_std"]
    assert row["CDR-H2_frac_A"] == 0.5 and sum(row[f"CDR-H2_frac_{a}"] for a in "CDEFGHIKLMNPQRSTVWY") == 0


def test_radius_is_strict(spark):
    row = extract_features(annotated(spark, [("G", "CDR-H1", (0.0, 0.0, 0.0)), ("S", "CDR-H1", (8.0, 0.0, 0.0))])).first()
    assert row["sasa_exposure_mean"] == 1.0 and row["sasa_exposure_std"] == 0.0


def test_details(spark):
    row = residue_details(annotated(spark, [("G", "CDR-H1", None)])).first()
    assert row.is_paratope_candidate and row.chain == "A" and row.b_factor == pytest.approx(1.0, abs=0.011)


@pytest.mark.parametrize("few", [0, 10_000])
def test_neighbours_by_cells_are_all_neighbours(spark, monkeypatch, few):
    """Points on a grid of the radius, so that many distances are the radius itself, which is not near; far points, equal points, one point."""
    monkeypatch.setattr(features, "FEW", few)
    rng = np.random.default_rng(1)
    made = {"grid": 4.0 * rng.integers(-4, 5, (150, 3)), "cloud": rng.normal(0, 12, (200, 3)), "far": np.concatenate([rng.normal(0, 3, (30, 3)), rng.normal(0, 3, (30, 3)) + [9_000, -5_000, 1]]), "one": np.zeros((1, 3)), "same": np.ones((20, 3)), "line": np.arange(80)[:, None] * [0.0, 0.0, 1.0]}
    rows = [(n, k, "CDR-H1" if k % 3 == 0 else "framework", "A", *map(float, p)) for n, x in made.items() for k, p in enumerate(x)]
    df = spark.createDataFrame(rows, "structure_id string, ordinal int, region string, one_letter string, ca_x double, ca_y double, ca_z double")
    got = {r.structure_id: r.n for r in features.grouped(df).select("structure_id", features.near_counts().alias("n")).collect()}
    for name, x in made.items():
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        assert got[name] == (d[::3] < 8.0).sum(1).tolist(), name


def test_neighbours_of_a_large_assembly(spark):
    """50,000 residues in one structure: twice as many take about twice as long, not four times."""
    took = {}
    for n in (500, 25_000, 50_000):
        side = (n / 0.004) ** (1 / 3)  # residues of a protein are so dense
        at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003 * side  # noqa: B023, E731
        df = spark.range(n).select(F.lit("s").alias("structure_id"), F.col("id").cast("int").alias("ordinal"), F.when(F.col("id") % 4 == 0, "CDR-H1").otherwise("framework").alias("region"), F.lit("A").alias("one_letter"), at(1).alias("ca_x"), at(2).alias("ca_y"), at(3).alias("ca_z"))
        began = time.time()
        (counts,) = features.grouped(df).select(features.near_counts().alias("n")).first()
        took[n] = time.time() - began
        assert len(counts) == -(-n // 4) and 2 < sum(counts) / len(counts) < 12
    assert took[50_000] < 3.5 * took[25_000] and took[50_000] < 90, took
