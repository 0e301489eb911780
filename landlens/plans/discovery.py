"""Stratified sample to research summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from landlens.operators import discovery as dc
from landlens.session import cut_lineage


def discovery_summary(
    samples: DataFrame, catalog: DataFrame, moisture: DataFrame, environment: DataFrame, places: DataFrame
) -> dict[str, DataFrame]:
    """Frame, strata, histograms, correlations and queues of one sample wave.

    The joined samples feed every part, so they are written out once instead of being joined again for each.
    """
    lensed = cut_lineage(dc.lens_join(samples, catalog, moisture, environment, places))
    queued = dc.research_queues(lensed)
    return {
        "frame": dc.frame_counts(lensed),
        "strata": dc.stratum_summary(lensed),
        "histograms": dc.class_histograms(lensed),
        "correlations": dc.pearson(lensed, [("lens_score", "catalog_detail"), ("lens_score", "share_300m")]),
        "queues": dc.queue_items(queued),
    }


def discovery_page(
    samples: DataFrame,
    catalog: DataFrame,
    moisture: DataFrame,
    environment: DataFrame,
    places: DataFrame,
    offset: int = 0,
    limit: int = dc.DEFAULT_PAGE,
) -> DataFrame:
    """One page of samples with lenses and reasons; the page is cut before anything is joined."""
    rows = dc.page(samples, "sample_id", offset, limit)
    return dc.queue_reasons(dc.lens_join(rows, catalog, moisture, environment, places))
