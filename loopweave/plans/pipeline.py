"""The whole analysis: structures to features, projection, clusters and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotate import annotate
from ..operators.cluster import density_clusters, structural_clusters
from ..operators.embed import reduce_dimensions
from ..operators.features import extract_features, residue_details
from ..operators.geometry import structures
from ..operators.report import cluster_summary, result_table
from ..operators.scale import standardize
from ..schemas import FEATURES
from ..sources.structures import read_structures
from ..storage import written


#: What an analysis may be asked for.
MODES, METHODS, COMPONENTS = ("features", "structural"), ("umap", "tsne", "pca"), (2, 3)
CLUSTER_SIZES, THRESHOLDS = (2, 20), (0.5, 5.0)


@dataclass(frozen=True)
class Parameters:
    """Anything that is not offered is an error when the object is made."""

    mode: str = "features"
    method: str = "umap"
    n_components: int = 3
    min_cluster_size: int = 3
    rmsd_threshold: float = 1.25
    seed: int = 42

    def __post_init__(self):
        for name, offered in (("mode", MODES), ("method", METHODS), ("n_components", COMPONENTS)):
            if getattr(self, name) not in offered:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not one of {offered}")
        for name, (low, high) in (("min_cluster_size", CLUSTER_SIZES), ("rmsd_threshold", THRESHOLDS)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not between {low} and {high}")


@dataclass
class Analysis:
    result: DataFrame | None
    summary: DataFrame | None
    details: DataFrame
    features: DataFrame
    structures: DataFrame
    errors: DataFrame | None = None


def feature_vectors(features: DataFrame) -> DataFrame:
    """(structure_id, vector): the standardised features."""
    return standardize(features.select("structure_id", *(f"`{c}`" for c in FEATURES)), list(FEATURES)).select("structure_id", F.array(*(F.col(f"`{c}`") for c in FEATURES)).alias("vector"))


def analyse(residues: DataFrame, parameters: Parameters = Parameters(), renumber=None) -> Analysis:  # noqa: B008
    """Fewer than two structures give details and features only. The projection is computed from features in both modes."""
    annotated = annotate(residues, renumber)
    features = written(extract_features(annotated), "features")
    structs = structures(annotated)
    if features.limit(2).count() < 2:
        return Analysis(None, None, residue_details(annotated), features, structs)
    vectors = written(feature_vectors(features), "vectors")
    embedding = reduce_dimensions(vectors, parameters.method, parameters.n_components, parameters.seed, key="structure_id")
    representatives = None
    if parameters.mode == "structural":
        structs = written(structs, "structures")
        representatives = structural_clusters(structs, parameters.rmsd_threshold)
        labels = representatives.select("structure_id", F.col("structural_cluster").alias("cluster"))
    else:
        labels = density_clusters(vectors, parameters.min_cluster_size, key="structure_id")
    result = written(result_table(features, embedding, labels, representatives), "result")
    return Analysis(result, cluster_summary(result), residue_details(annotated), features, structs)


def run(spark: SparkSession, path: str, parameters: Parameters = Parameters(), renumber=None) -> Analysis:  # noqa: B008
    """``analyse`` for all structure files below ``path``, with the files that could not be read."""
    residues, errors = read_structures(spark, path)
    out = analyse(written(residues, "residues"), parameters, renumber)
    out.errors = errors
    return out
