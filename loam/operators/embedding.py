"""Embeddings of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def embed(text: Column, dim: int = 384, model=None) -> Column:
    """Unit vectors of ``dim`` floats: ``model(list of texts)`` if one is given, else Gaussian directions seeded by a hash of the text.

    The hash is the same in every process, so equal texts have equal vectors everywhere. A null text has a null vector.
    """

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> np.ndarray:
            v = np.random.default_rng(xxhash.xxh64_intdigest(t.encode())).normal(size=dim)
            return (v / np.linalg.norm(v)).astype("f4")

        if model is not None:
            known = texts.dropna()
            found = dict(zip(known.index, model(known.tolist())))
            return pd.Series([found.get(k) for k in texts.index], dtype=object)
        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(text)
