"""From callers' calls to final calls, and the scores of those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators import annotate, cluster, qc, tiers
from ..sources.steps import written

EPS = cluster.EPS


#: How calls are clustered: connected components, or greedily in input order.
ALGORITHMS = {"dbscan": cluster.clustered, "bucket": lambda calls, eps, strands, min_samples: cluster.grid_clustered(calls, eps)}


def found(calls: DataFrame, eps: int = EPS, strands: bool = True, min_samples: int = 1, algorithm: str = "dbscan") -> DataFrame:
    """Clusters, written."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return written(cluster.clusters(ALGORITHMS[algorithm](calls, eps, strands, min_samples)), "clusters")


def called(calls: DataFrame, eps: int = EPS, strands: bool = True, min_samples: int = 1, algorithm: str = "dbscan") -> DataFrame:
    """Clusters with provisional tiers."""
    whole = found(calls, eps, strands, min_samples, algorithm)
    return cluster.with_members(tiers.with_ids(tiers.tiered(whole.drop("member_record_ids"))), whole)


def together(*of_sources: DataFrame) -> DataFrame:
    """Calls of several sources in one table, with the columns that clusters need. Sources number their calls in ranges
    of their own (files from 0 on, reads from ``reads.READS_SEQ`` on)."""
    names = [c for c in of_sources[0].columns if all(c in d.columns for d in of_sources)]
    return reduce(DataFrame.unionByName, [d.select(*names) for d in of_sources])


def final(calls: DataFrame, loci: DataFrame, partners: DataFrame, artefacts: DataFrame, eps: int = EPS, algorithm: str = "dbscan", by_sample: bool = False) -> DataFrame:
    """Annotated calls are written once, as the rewrite passes read them twice; members' lists stay with the clusters."""
    whole = found(calls, eps, algorithm=algorithm)
    out = written(annotate.annotated(tiers.with_ids(tiers.tiered(whole.drop("member_record_ids"))), loci, partners), "annotated")
    return cluster.with_members(qc.checked(out, artefacts, qc.RECEPTOR_LOCI, by_sample), whole)
