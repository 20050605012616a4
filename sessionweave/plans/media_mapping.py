"""Media mapping from three tables: manifest, raw index and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.media import mapping_errors, media_diagnostics, media_manifest, pair_media
from ..operators.validate import ContractError
from ..schemas import Settings


def map_media(manifest: DataFrame, raw: DataFrame, exceptions: DataFrame | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(media manifest, diagnostics), after the manifest's invariants have been checked in one aggregate."""
    pairs = pair_media(manifest, raw, exceptions)
    mapped = media_manifest(manifest, raw, pairs, settings.warning_seconds)
    broken = {k: v for k, v in mapping_errors(mapped).first().asDict().items() if v}
    if broken:
        raise ContractError(f"broken mapping: {broken}")
    return mapped.orderBy("segment_id", "start", "end", "label_idx"), media_diagnostics(manifest, raw, pairs, settings.warning_seconds).orderBy("segment_id", "reason", "label_idx", "local_video_id")
