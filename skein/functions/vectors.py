"""Vectors as short texts: float16 in base64 behind a mark. Both work on batches, for pandas UDFs."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd

#: Fixed value: what a packed vector begins with.
MARK = "f16:"


def packed(vectors: pd.Series) -> pd.Series:
    """Null stays null."""
    return pd.Series([None if v is None else MARK + base64.b64encode(np.asarray(v, np.float32).astype("<f2").tobytes()).decode() for v in vectors])


def unpacked(texts: pd.Series) -> pd.Series:
    """Vectors that `packed` or a JSON list wrote; null for what is neither."""
    def one(x: str | None) -> list[float] | None:
        if x is None:
            return None
        if x.startswith(MARK):
            return np.frombuffer(base64.b64decode(x[len(MARK) :]), "<f2").astype(np.float32).tolist()
        try:
            got = json.loads(x)
        except ValueError:
            return None
        return [float(y) for y in got] if isinstance(got, list) and got else None

    return pd.Series([one(x) for x in texts])
