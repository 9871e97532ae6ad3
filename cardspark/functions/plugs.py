"""Plug points for outside models (P1, P2): a callable over a batch of texts, called in tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], list[list[float] | None]]:
    """A stand-in for tests: signed word hashes, unit length; texts without words have no vector."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out

    return embed


def _mapped(df: DataFrame, key: str, text: str, fn: Callable, kind: str, name: str, prefix: str = "") -> DataFrame:
    key_kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], name: fn([prefix + (t or "") for t in part[text]])})

    return df.select(key, text).mapInPandas(run, f"{key} {key_kind}, {name} {kind}")


def embed_passages(df: DataFrame, key: str, text: str, fn: Callable, prefix: str = "passage: ") -> DataFrame:
    """(key, embedding); null where fn gives none, so that search goes by words alone."""
    return _mapped(df, key, text, fn, "array<double>", "embedding", prefix)


def ask(df: DataFrame, key: str, prompt: str, fn: Callable) -> DataFrame:
    """(key, raw) of replies, for parse_cards."""
    return _mapped(df, key, prompt, fn, "string", "raw")
