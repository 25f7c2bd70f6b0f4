"""Interchangeable vectorisers with one output contract: (text_key, dim, value) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions.hashing import hash_number

Vectoriser = Callable[[DataFrame, str, int], DataFrame]
VECTORISERS: dict[str, Vectoriser] = {}


def vectoriser(name: str):
    def register(fn: Vectoriser) -> Vectoriser:
        VECTORISERS[name] = fn
        return fn

    return register


@vectoriser("hashed_tokens")
def hashed_token_vectors(strings: DataFrame, column: str, dims: int, seed: int = 42) -> DataFrame:
    """Signed token hashing, computed once per distinct string."""
    distinct = strings.select(F.col(column).alias("_s")).distinct()
    tokens = T.exploded(distinct, T.tokens("_s"), "_t", T.fingerprint("_s").alias("text_key"))
    n = hash_number("_t", seed=seed)
    hashed = tokens.select("text_key", (F.shiftright(n, 1) % dims).alias("dim"), F.when(n % 2 == 0, 1.0).otherwise(-1.0).alias("_v"))
    return hashed.groupBy("text_key", "dim").agg(F.sum("_v").alias("value"))


@vectoriser("token_counts")
def token_count_vectors(strings: DataFrame, column: str, dims: int, seed: int = 42) -> DataFrame:
    """Unsigned token counts over hashed dimensions."""
    distinct = strings.select(F.col(column).alias("_s")).distinct()
    tokens = T.exploded(distinct, T.tokens("_s"), "_t", T.fingerprint("_s").alias("text_key"))
    hashed = tokens.select("text_key", (hash_number("_t", seed=seed) % dims).alias("dim"))
    return hashed.groupBy("text_key", "dim").agg(F.count("*").cast("double").alias("value"))


def vectorise(strings: DataFrame, column: str, dims: int, kind: str = "hashed_tokens") -> DataFrame:
    return VECTORISERS[kind](strings, column, dims)
