"""Text embedding: the deterministic test embedder and the hook for a user's model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.schema import EMBEDDING_DIMENSION

log = logging.getLogger(__name__)


def embed_dummy(text: Column, dimension: int = EMBEDDING_DIMENSION) -> Column:
    """Element i is sin((bytes + i) * 0.01): single-precision product, double-precision sine, single-precision
    result. '' gives zeros. A dimension below 1 becomes 768."""
    if dimension <= 0:
        log.warning("invalid dimension %d, using %d", dimension, EMBEDDING_DIMENSION)
        dimension = EMBEDDING_DIMENSION
    step = F.lit(0.01).cast("float")
    size = F.octet_length(text)
    wave = F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.sin(((size + i).cast("float") * step).cast("double")).cast("float"),
    )
    return F.when(size == 0, F.array_repeat(F.lit(0.0).cast("float"), dimension)).otherwise(wave)


def embed_with(load_model: Callable[[], Callable[[pd.Series], list]], dimension: int) -> Callable[[Column], Column]:
    """Column function around a user's model.

    ``load_model`` runs once per Python worker task and returns a function from a batch of texts to one vector
    per text. A vector of another size than ``dimension`` fails the job; an empty text gives zeros.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            out = pd.Series([np.zeros(dimension, np.float32)] * len(texts), dtype=object)
            filled = texts.fillna("") != ""
            if filled.any():
                vectors = [np.asarray(v, np.float32) for v in model(texts[filled])]
                if any(v.shape != (dimension,) for v in vectors):
                    raise ValueError(f"the model must return vectors of size {dimension}")
                out[filled.to_numpy()] = pd.Series(vectors, dtype=object).to_numpy()
            yield out

    return embed


EMBEDDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "dummy": lambda dimension: lambda text: embed_dummy(text, dimension),
}


def register_embedder(name: str, load_model: Callable[[], Callable[[pd.Series], list]]) -> None:
    EMBEDDERS[name.lower()] = lambda dimension: embed_with(load_model, dimension)


def text_embedder(name: str = "dummy", dimension: int = EMBEDDING_DIMENSION) -> Callable[[Column], Column]:
    """Embedder by type name, any case; an unknown name is an error."""
    if name.lower() not in EMBEDDERS:
        raise ValueError(f"unsupported embedder type: {name}")
    return EMBEDDERS[name.lower()](dimension)
