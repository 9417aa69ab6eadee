"""Leave-out views of a metadatabase: consistent filtered DataFrames, nothing written unless asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalens.functions.hashing import MODULUS, seeded_hash
from metalens.session import materialize


@dataclass(frozen=True)
class MetaView:
    """Evaluations, lookups and characterizations restricted to kept datasets.

    ``keep`` is a one-column DataFrame of kept dataset ids (the ids **kept**).
    Pipelines are those with at least one kept evaluation. Dropping the view
    object restores the full metadatabase; none of its files are copied or
    rewritten, so concurrent users never see each other's views.
    """

    evaluations: DataFrame
    datasets: DataFrame
    pipelines: DataFrame
    dataset_chars: DataFrame | None = None
    pipeline_chars: DataFrame | None = None


def partial_view(evals: DataFrame, datasets: DataFrame, pipelines: DataFrame, keep: DataFrame,
                 dataset_chars: DataFrame | None = None, pipeline_chars: DataFrame | None = None, stored: bool = False) -> MetaView:
    """The view of the datasets in ``keep``.

    ``stored`` writes the kept ids and evaluations once to the checkpoint folder,
    for users that read them several times: otherwise every reader joins the
    evaluations with ``keep`` again, in the stage of its own joins.
    """
    keep = keep.select(F.col(keep.columns[0]).alias("dataset_id"))
    keep = materialize(keep) if stored else keep
    ev = evals.join(keep, "dataset_id", "left_semi")
    ev = materialize(ev) if stored else ev
    ds = datasets.join(keep, "dataset_id", "left_semi")
    pipes = pipelines.join(ev.select("pipeline_id"), "pipeline_id", "left_semi")
    dc = dataset_chars.join(keep, "dataset_id", "left_semi") if dataset_chars is not None else None
    pc = pipeline_chars.join(pipes.select("pipeline_id"), "pipeline_id", "left_semi") if pipeline_chars is not None else None
    return MetaView(ev, ds, pipes, dc, pc)


def all_but(ids: DataFrame, drop: DataFrame, col: str = "dataset_id") -> DataFrame:
    """Ids not in ``drop`` (left anti join)."""
    return ids.join(drop.select(col), col, "left_anti")


def holdout_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``is_train``: a deterministic split on a seeded hash of ``key``.

    The same rows are chosen on every recomputation and by any SQL engine;
    another seed draws other rows.
    """
    return df.withColumn("is_train", seeded_hash(key, seed) / F.lit(float(MODULUS)) < F.lit(train_fraction))
