"""Token counts through a digest cache.

A text's digest and the tokenizer's version digest look up stored counts; only distinct texts that miss are encoded,
and their counts are appended to the cache. The content is normalised by taking null as the empty text and no further:
this tokenizer keeps white space and letter forms, so any other rewriting would change counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import keyed
from .storage import BROADCAST_ROWS, by_groups, new_path, settle, ship

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def version_digest(name: str) -> bytes:
    """What the cache is valid for: library, its version and the vocabulary file's bytes."""
    if name.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + Path(tokenizer_path(name)).read_bytes()).digest()


@lru_cache(maxsize=4)
def counter(name: str):
    """A function from a list of texts to their token counts, without added tokens."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path(name))
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encode(name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            texts = batch.column("text")
            counts = [n for lo in range(0, len(texts), 256) for n in count(texts.slice(lo, 256).to_pylist())]
            yield pa.record_batch([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; an absent cache is an empty one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", cache_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens above limit) for every row of docs.

    Null texts count as empty: 0 bytes, 0 tokens. Equal texts are encoded once, also across rows with one id; repeated
    rows and null ids stay. cache_path names a cache that outlives the call; without it the cache lasts for this result.
    A cache holds each digest once unless two calls append at a time; such repeats are equal and harmless. Only digests
    are compared; texts move if neither the rows to encode nor the others are few enough to be named everywhere.
    """
    spark = docs.sparkSession
    ship(spark)
    cache_path = cache_path or new_path(spark, "token-cache")
    version = version_digest(tokenizer)
    body = F.coalesce(F.col("text"), F.lit(""))
    found = keyed(docs)
    slim = settle(docs.select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")), "token-slim")
    groups = settle(found.names.groupBy("digest").agg(F.min("key").alias("key")).join(slim.groupBy("digest").agg(F.count("*").alias("n")), "digest"), "token-groups")
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == F.lit(version))
    missing = settle(groups.join(known.select("digest").distinct().hint("shuffle_hash"), "digest", "left_anti").select("key", "digest"), "token-misses")
    misses, documents = missing.count(), found.names.count()
    if misses <= BROADCAST_ROWS // 2:
        texts = found.once.join(F.broadcast(missing), "key")
    elif documents - misses <= BROADCAST_ROWS:  # almost all are to be encoded: those that are not are named
        others = settle(found.names.join(missing.hint("shuffle_hash"), "key", "left_anti").select("key"), "token-others")
        texts = found.once.join(F.broadcast(others), "key", "left_anti").withColumn("digest", F.unhex(F.sha2("text", 256)))
    else:
        texts = found.once.join(missing.hint("shuffle_hash"), "key")
    counted = texts.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = groups.select("digest", "n").join(counts, "digest")
    return by_groups(slim, counts, ["digest"], "n", groups.count(), slim.count()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
