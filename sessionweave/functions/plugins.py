"""Places for external models: what they take and give, and how their failures are kept in the row.

A model is a factory, called once in each Python worker, whose result maps a pandas Series to a list of outputs. No model is
bundled; sessionweave's own columns work on whatever a plug-in gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[pd.Series], Sequence]

#: Output type by kind of plug-in.
KINDS = {
    "token_count": "int",
    "embedding": "array<float>",
    "logits": "array<double>",
    "dependency_parse": "array<struct<i:int,head:int,is_space:boolean,is_punct:boolean>>",
    "audio": "array<float>",
    "speech_intervals": "array<struct<start:bigint,end:bigint>>",
    "mfcc_frames": "array<array<double>>",
    "pitch_frames": "array<double>",
    "voice_quality": "struct<jitter_local:double,shimmer_local:double,hnr_mean:double>",
    "spectrum_frames": "array<struct<rms:double,centroid:double>>",
    "landmarks": "array<struct<frame_index:int,points:array<struct<x:double,y:double>>>>",
    "rotation": "array<array<double>>",
    "transcript": "struct<text:string,source:string>",
    "action_units": "struct<status:string,error:string,csv_path:string>",
}


def apply_model(df: DataFrame, column: str, out: str, kind: str, factory: Callable[[], Model]) -> DataFrame:
    """df with `out` of the kind's type, and `out`_status: available, or error with `out`_error.

    The factory runs once in each worker. A batch that fails is tried again row by row, so that one bad row costs only itself.
    """
    inner = T._parse_datatype_string(KINDS[kind])
    schema = T.StructType([*df.schema.fields, T.StructField(out, inner), T.StructField(f"{out}_status", T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def one(model: Model, value: object) -> tuple:
        try:
            return list(model(pd.Series([value])))[0], "available", None
        except Exception as error:  # noqa: BLE001  any failure is reported in its row
            return None, "error", str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or factory()
            try:
                rows = [(v, "available", None) for v in model(pdf[column])]
            except Exception:  # noqa: BLE001
                rows = [one(model, v) for v in pdf[column]]
            yield pdf.assign(**{out: [r[0] for r in rows], f"{out}_status": [r[1] for r in rows], f"{out}_error": [r[2] for r in rows]})

    return df.mapInPandas(run, schema)


def zero_if_missing(column: str) -> F.Column:
    """For voice measures: 0.0 in place of NULL, NaN and infinities."""
    from .missing import finite_or_null

    return F.coalesce(finite_or_null(F.col(column)), F.lit(0.0))
