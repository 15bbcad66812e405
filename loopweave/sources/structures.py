"""Structure files to atoms and residues.

A PDB file is parsed by column positions with built-in expressions. An mmCIF file needs a tokenizer, which runs over Arrow
batches. A file that cannot be parsed gives a row of errors, and the others go on.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ATOMS, LETTERS, UNKNOWN

#: Extensions count in either case.
GLOB = "*.{[pP][dD][bB],[cC][iI][fF],[mM][mM][cC][iI][fF]}"


def read_files(spark: SparkSession, path: str, every_file: bool = False) -> DataFrame:
    """(path, content) of the structure files below ``path``; with ``every_file`` those of other types too, which then are errors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader if every_file else reader.option("pathGlobFilter", GLOB)).load(path).select("path", "content")


def from_bytes(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """(path, content) of files in memory; names are kept. Files of one name are put into folders of their own, as a path
    stands for one file."""
    met: Counter = Counter()
    rows = []
    for name, content in files:
        rows.append((f"{met[name]}/{name}" if met[name] else name, bytearray(content)))
        met[name] += 1
    return spark.createDataFrame(rows, "path string, content binary")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _numbered(files: DataFrame) -> DataFrame:
    """(path, numbered): names for files whose stem others have too: x, x#2, x#3 in the order of paths. Stems that end as such
    a name does are numbered along with them, so no two files ever share one. Only paths are shuffled."""
    base = F.regexp_replace(_stem(F.col("path")), r"(#[0-9]+)+$", "")
    alike = Window.partitionBy("base")
    number = F.row_number().over(alike.orderBy("path"))
    placed = files.select("path", base.alias("base")).select("path", "base", number.alias("n"), F.count("*").over(alike).alias("many")).where("many > 1")
    return placed.select("path", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), "n")).alias("numbered"))


def _kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.when(ext == "pdb", "pdb").when(ext.isin("cif", "mmcif"), "cif")


def _pdb_atoms(files: DataFrame) -> DataFrame:
    lines = files.where("kind = 'pdb'").select("structure_id", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("record", F.rtrim(F.substring("line", 1, 6))).where(F.col("record").isin("ATOM", "HETATM", "MODEL"))
    # MODEL records open models; what stands before the first belongs to the first.
    order = Window.partitionBy("structure_id").orderBy("line_no")
    model = F.greatest(F.count_if(F.col("record") == "MODEL").over(order) - 1, F.lit(0)).cast("int")

    def text(start: int, size: int) -> Column:
        return F.trim(F.substring("line", start, size))

    def number(start: int, size: int, kind: str) -> Column:
        return text(start, size).try_cast(kind)

    # coordinates are single precision, as structure libraries keep them
    xyz = [number(s, 8, "float").cast("double").alias(n) for s, n in ((31, "x"), (39, "y"), (47, "z"))]
    return lines.withColumn("model", model).where("record <> 'MODEL'").select(
        "structure_id", "model", F.substring("line", 22, 1).alias("chain_id"), number(23, 4, "int").alias("res_seq"), text(27, 1).alias("icode"), text(18, 3).alias("res_name"),
        (F.col("record") == "HETATM").alias("het"), text(13, 4).alias("atom_name"), text(17, 1).alias("altloc"), F.coalesce(number(55, 6, "double"), F.lit(0.0)).alias("occupancy"), *xyz,
        F.coalesce(number(61, 6, "double"), F.lit(0.0)).alias("b_factor"), number(7, 5, "int").alias("serial"), F.col("line_no").cast("int"))


_TOKEN = re.compile(r"""'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|"((?:[^"\n]|"(?=\S))*)"(?=\s|$)|(\#[^\n]*)|(\S+)""")


def cif_tokens(text: str):
    """(value, quoted) of each token: quoted strings, text blocks between lines that start with a semicolon, bare words."""
    lines, at = text.splitlines(), 0
    while at < len(lines):
        line = lines[at]
        if line.startswith(";"):
            block = [line[1:]]
            at += 1
            while at < len(lines) and not lines[at].startswith(";"):
                block.append(lines[at])
                at += 1
            if at == len(lines):
                raise ValueError("text block without end")
            yield "\n".join(block), True
            rest = lines[at][1:]
        else:
            rest = line
        for m in _TOKEN.finditer(rest):
            if m[3] is None:
                yield (m[4], False) if m[4] is not None else (m[1] if m[1] is not None else m[2], True)
        at += 1


def cif_atoms(text: str) -> list[dict]:
    """Rows of the atom_site loop. Author chains and residue numbers are used where given."""
    tokens, names, rows = list(cif_tokens(text)), [], []
    at = 0
    while at < len(tokens):
        value, quoted = tokens[at]
        at += 1
        if quoted or value.lower() != "loop_":
            continue
        names = []
        while at < len(tokens) and not tokens[at][1] and tokens[at][0].startswith("_"):
            names.append(tokens[at][0].lower())
            at += 1
        if not names or not names[0].startswith("_atom_site."):
            continue
        cells = []
        while at < len(tokens) and (tokens[at][1] or not re.match(r"_|loop_|data_|save_", tokens[at][0], re.I)):
            cells.append(tokens[at])
            at += 1
        if len(cells) % len(names):
            raise ValueError("atom_site loop with a short row")
        rows += [dict(zip([n.removeprefix("_atom_site.") for n in names], cells[i : i + len(names)], strict=True)) for i in range(0, len(cells), len(names))]
    if not rows:
        raise ValueError("no atom_site loop")
    out, models = [], {}
    for k, r in enumerate(rows):
        def get(*names, default=""):
            for n in names:
                if n in r and (r[n][1] or r[n][0] not in (".", "?")):  # noqa: B023
                    return r[n][0]  # noqa: B023
            return default

        model = get("pdbx_pdb_model_num", default="1")
        out.append({"model": models.setdefault(model, len(models)), "chain_id": get("auth_asym_id", "label_asym_id"), "res_seq": int(get("auth_seq_id", "label_seq_id")), "icode": get("pdbx_pdb_ins_code"),
                    "res_name": get("auth_comp_id", "label_comp_id"), "het": get("group_pdb", default="ATOM") == "HETATM", "atom_name": get("auth_atom_id", "label_atom_id"), "altloc": get("label_alt_id"),
                    "occupancy": float(get("occupancy", default="1")), "x": float(get("cartn_x")), "y": float(get("cartn_y")), "z": float(get("cartn_z")), "b_factor": float(get("b_iso_or_equiv", default="0")),
                    "serial": int(get("id", default=str(k + 1))), "line_no": k})
    return out


def _cif_atoms(files: DataFrame) -> DataFrame:
    """(structure_id, error, atoms as an array)."""
    fields = [f for f in re.split(r",\s*", ATOMS) if not f.startswith("structure_id")]
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    record = pa.struct([(f.split()[0], kinds[f.split()[1]]) for f in fields])

    def run(batches):
        for batch in batches:
            errors, atoms = [], []
            for content in batch.column(1).to_pylist():
                try:
                    atoms.append(cif_atoms(content.decode()))
                    errors.append(None)
                except (ValueError, KeyError) as e:
                    atoms.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(atoms, pa.list_(record))], ["structure_id", "error", "atoms"])

    struct = ", ".join(f"{n}: {k}" for n, k in (f.split() for f in fields))
    return files.where("kind = 'cif'").select("structure_id", "content").mapInArrow(run, f"structure_id string, error string, atoms array<struct<{struct}>>")


def parse_structures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, errors) of (path, content) files. Every file is a structure of its own, named by its stem, or, where several
    files share a stem, by the stem and a number (see ``_numbered``). A file of another type, without an atom, or with an atom
    whose place or number cannot be read is one row of errors and gives no atom."""
    # the path is the structure's name until files have been parsed
    keyed = files.select(F.col("path").alias("structure_id"), _kind(F.col("path")).alias("kind"), "content")
    cif = _cif_atoms(keyed)
    pdb = _pdb_atoms(keyed)
    unread = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.col("res_seq").isNull()
    state = pdb.groupBy("structure_id").agg(F.count("*").alias("n"), F.count_if(unread).alias("bad"))
    pdb_errors = (keyed.where("kind = 'pdb'").select("structure_id").join(state, "structure_id", "left").where("n is null or bad > 0")
                  .select("structure_id", F.when(F.col("n").isNull(), "no atom records").otherwise(F.concat(F.col("bad").cast("string"), F.lit(" atom records cannot be read"))).alias("error")))
    other = keyed.where("kind is null").select("structure_id", F.concat(F.lit("Unsupported file extension: "), F.regexp_extract("structure_id", r"(\.[^./]*)?$", 0)).alias("error"))
    errors = pdb_errors.union(cif.where("error is not null").select("structure_id", "error")).union(other)
    good = pdb.join(pdb_errors.select("structure_id"), "structure_id", "left_anti")
    atoms = good.unionByName(cif.where("error is null").select("structure_id", F.inline("atoms")))
    numbered = _numbered(files)

    def named(df: DataFrame) -> DataFrame:
        name = F.coalesce("numbered", _stem(F.col("structure_id")))
        return df.join(numbered, F.col("structure_id") == F.col("path"), "left").select(*(name.alias(c) if c == "structure_id" else c for c in df.columns))

    return named(atoms), named(errors)


def residues(atoms: DataFrame) -> DataFrame:
    """Residue rows of the first model, without hetero atoms, in file order. Of alternate locations the one with the highest
    occupancy counts, the first in the file on ties. A residue's B-factor is the mean of its atoms', 0 without any."""
    key = ["structure_id", "chain_id", "res_seq", "icode"]
    best = Window.partitionBy(*key, "atom_name").orderBy(F.desc("occupancy"), "line_no")
    one = atoms.where("model = 0 and not het").withColumn("n", F.row_number().over(best)).where("n = 1")
    ca = F.max(F.when(F.col("atom_name") == "CA", F.struct("x", "y", "z")))
    grouped = one.groupBy(*key).agg(F.min_by("res_name", "line_no").alias("res_name"), ca.alias("ca"), F.coalesce(F.avg("b_factor"), F.lit(0.0)).alias("b_factor"), F.min("line_no").alias("first"))
    # chains come in the order of their first atom, residues within them
    chain = Window.partitionBy("structure_id", "chain_id")
    placed = grouped.withColumn("chain_first", F.min("first").over(chain))
    ordinal = (F.row_number().over(Window.partitionBy("structure_id").orderBy("chain_first", "first")) - 1).cast("int")
    return placed.select("structure_id", ordinal.alias("ordinal"), "chain_id", "res_seq", "icode", F.trim("res_name").alias("res_name"), one_letter(F.trim("res_name")).alias("one_letter"),
                         F.col("ca.x").alias("ca_x"), F.col("ca.y").alias("ca_y"), F.col("ca.z").alias("ca_z"), "b_factor")


def one_letter(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(name)), F.lit(UNKNOWN))


def sequences(res: DataFrame) -> DataFrame:
    """(structure_id, sequence): letters of all chains in order."""
    return res.groupBy("structure_id").agg(F.expr("listagg(one_letter, '') within group (order by ordinal)").alias("sequence"))


def read_structures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(residues, errors) of all structure files below ``path``."""
    atoms, errors = parse_structures(read_files(spark, path))
    return residues(atoms), errors


