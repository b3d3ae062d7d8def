"""Text to vector. Every encoder maps ``df`` to ``df`` plus a unit-length ``emb``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from labelspring.functions.columns import text_as_string
from labelspring.functions.keyed import DEFAULT_SEED
from labelspring.sources.scratch import drop_table, new_path, write_table

#: A text on more rows than this is copied, and its rows are dealt out to the copies.
HOT_ROWS = 2000

#: Texts that are split together.
CHUNK = 1024
#: So many distinct tokens a task keeps the slots of; a rarer one is hashed at each occurrence.
KNOWN_TOKENS = 200_000


def _unit(df: DataFrame, vector: str, name: str, dtype: str = "float32") -> DataFrame:
    unit = Normalizer(p=2.0, inputCol=vector, outputCol="_unit").transform(df)
    return unit.withColumn(name, vector_to_array("_unit", dtype)).drop(vector, "_unit")


def attach_vectors(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """Precomputed vectors ``row_id, emb`` joined to the rows that have one."""
    return df.join(vectors.select("row_id", "emb"), "row_id")


def hashed_encode(
    df: DataFrame,
    width: int = 64,
    name: str = "emb",
    seed: int = DEFAULT_SEED,
    dtype: str = "float32",
) -> DataFrame:
    """Bag of lower-cased tokens, hashed to ``width`` slots, unit length.

    One pass over the text and no shuffle. A token's slot is its :func:`keyed_hash`, which
    a task works out once for each of the first ``KNOWN_TOKENS`` tokens that it meets, and
    looks up once in ``CHUNK`` texts.
    """
    counts = _slot_counts(width, seed)
    text = F.lower(text_as_string(F.col("TEXT"))).cast("binary")
    return _unit(df.withColumn("_counts", array_to_vector(counts(text))), "_counts", name, dtype)


class _Slots(dict):
    """Slots by token, worked out where they are not known."""

    def __init__(self, before: bytes, after: bytes, width: int):
        self.before, self.after, self.width = before, after, width

    def __missing__(self, token: bytes) -> int:
        digest = hashlib.md5(self.before + token + self.after, usedforsecurity=False).digest()
        slot = int.from_bytes(digest[:4], "big") % self.width
        if len(self) < KNOWN_TOKENS:
            self[token] = slot
        return slot


def _chunk_counts(texts: pa.Array, known: _Slots) -> np.ndarray:
    """How many of each UTF-8 text's tokens fall into each slot, text by text.

    The texts are split at blanks ``\\s+``, with an empty token where one begins or ends
    with a blank. Each distinct token is looked up once.
    """
    split = pc.ascii_split_whitespace(texts.view(pa.string()))
    tokens = split.flatten().dictionary_encode()
    distinct = tokens.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    slots = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    at = row * known.width + slots[tokens.indices.to_numpy()]
    return np.bincount(at, minlength=len(texts) * known.width).astype(np.float64)


def _slot_counts(width: int, seed: int) -> Callable:
    """How many of a UTF-8 text's tokens fall into each of ``width`` slots."""
    @F.arrow_udf("array<double>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Slots(f"{seed}:".encode(), b":token", width)
        for texts in batches:
            parts = [_chunk_counts(texts[i : i + CHUNK], known) for i in range(0, len(texts), CHUNK)]
            flat = np.concatenate(parts) if parts else np.zeros(0)
            offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
            yield pa.ListArray.from_arrays(offsets, flat)

    return count


def model_encode(
    df: DataFrame,
    make_predict_fn: Callable,
    name: str = "emb",
    batch_size: int = 32,
    dtype: str = "float32",
) -> DataFrame:
    """A user's model, loaded once per Python worker and fed batches of texts.

    ``make_predict_fn`` returns a function from an array of ``batch_size`` texts
    to a ``(batch, width)`` array.
    """
    encode = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    raw = df.withColumn("_raw", array_to_vector(encode(text_as_string(F.col("TEXT")))))
    return _unit(raw, "_raw", name, dtype)


def text_digest(text: Column) -> Column:
    """32 bytes that stand for a text as the encoders read it."""
    return F.unhex(F.sha2(F.encode(text_as_string(text), "UTF-8"), 256))


def encode_once(
    df: DataFrame, encode: Callable[[DataFrame], DataFrame], name: str = "emb"
) -> DataFrame:
    """``df`` with ``name``, each distinct text encoded once.

    ``encode`` maps rows with ``TEXT`` to the same rows plus ``name``, and may look at
    the text alone. The distinct texts are encoded and written by digest; only digests
    and vectors are shuffled back to the rows. A text on very many rows is copied, and
    its rows are dealt out by a hash of ``row_id``. A text that is missing or empty
    counts as the one that the encoders read in its place; an empty table stays
    empty. For an encoder that is dear next to a shuffle, such as a model: the hashed
    one is cheaper than the join.

    The vectors stay in the shared folder, since the result reads them.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_digest", text_digest(F.col("TEXT")))
    texts = keyed.groupBy("_digest").agg(
        F.any_value("TEXT").alias("TEXT"), F.count(F.lit(1)).alias("_rows")
    )
    path = new_path(spark, "texts")
    distinct = write_table(texts, path)
    try:
        copies = F.ceil(F.col("_rows") / F.lit(HOT_ROWS)).cast("int").alias("_copies")
        encoded = encode(distinct).select("_digest", copies, name)
        vectors = write_table(encoded, new_path(spark, "vectors"))
    finally:
        drop_table(spark, path)
    hot = vectors.filter("_copies > 1").select("_digest", "_copies")
    copied = vectors.select(
        "_digest", name, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy")
    )
    # Fewer than one text in HOT_ROWS rows is hot: the planner broadcasts them if they are few.
    dealt = (
        keyed.join(hot, "_digest", "left")
        .withColumn("_copy", F.pmod(F.xxhash64("row_id"), F.coalesce("_copies", F.lit(1))).cast("int"))
        .drop("_copies")
    )
    found = dealt.join(copied, ["_digest", "_copy"])
    return found.select(*[F.col(c) for c in df.columns], name)
