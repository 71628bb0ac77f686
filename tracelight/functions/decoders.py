"""Python codecs as decoders of framed payloads."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def row_decoder(decode: Callable[[bytes], str | None]) -> Callable[[Column], Column]:
    """A codec ``bytes -> JSON text`` as an entry of ``decode_records(decoders=…)``.

    It runs in Arrow batches. A payload on which it raises becomes null, which sends that row, and no other, to the
    lenient JSON path.
    """

    def one(payload):
        if payload is None:
            return None
        try:
            return decode(bytes(payload))
        except Exception:  # noqa: BLE001 - any failure of a foreign codec means: not decoded
            return None

    def run(payloads: pd.Series) -> pd.Series:
        return pd.Series([one(p) for p in payloads], dtype="object")

    return F.pandas_udf(run, "string")
