"""Schemas of the tables that the operators hand on."""

REGIONS = ("CDR-H1", "CDR-H2", "CDR-H3")
FRAMEWORK = "framework"
#: Inclusive position ranges of the regions, and what a residue of a region adds to the hotspot score.
REGION_RANGES = {"CDR-H1": (27, 38), "CDR-H2": (56, 65), "CDR-H3": (105, 117)}
REGION_WEIGHTS = {"CDR-H1": 0.20, "CDR-H2": 0.25, "CDR-H3": 0.55}
#: The alphabet and the classes of residue letters; classes overlap, and G is in none.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
POSITIVE, NEGATIVE = "RKH", "DE"
HYDROPHOBIC, POLAR, AROMATIC = "AILMFWVP", "STNQYC", "FWY"
#: Residue names and their letters.
LETTERS = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}
UNKNOWN = "X"

ATOMS = ("structure_id string, model int, chain_id string, res_seq int, icode string, res_name string, het boolean, atom_name string, altloc string, "
         "occupancy double, x double, y double, z double, b_factor double, serial int, line_no int")
RESIDUES = ("structure_id string, ordinal int, chain_id string, res_seq int, icode string, res_name string, one_letter string, "
            "ca_x double, ca_y double, ca_z double, b_factor double")
ERRORS = "structure_id string, error string"
PAIRS = "i string, j string, rmsd double"

FEATURES = tuple(
    [f"{r}_length" for r in REGIONS] + [f"{r}_frac_{a}" for r in REGIONS for a in ALPHABET]
    + [f"{r}_{k}" for r in REGIONS for k in ("net_charge", "pos_frac", "neg_frac")] + [f"{r}_{k}" for r in REGIONS for k in ("hydro", "polar", "aromatic")]
    + ["cdr_pw_dist_mean", "cdr_pw_dist_std", "cdr_centroid_mean", "cdr_centroid_std", "sasa_exposure_mean", "sasa_exposure_std", "hotspot_score"]
)
