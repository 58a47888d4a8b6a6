"""Encoding of a whole corpus with a public byte-level BPE tokenizer, and decoding.

Global distinct-word shuffle: every text is split into pre-tokens by the tokenizer's own pattern in
the JVM, the pre-tokens are exploded with their positions, each distinct one is encoded once for the
whole corpus, its ids are joined back and the texts are reassembled by position.

The split texts are partitioned by their key first, and both exploding and the join of the ids keep
that partitioning, so reassembly moves nothing again. The table of encoded words is broadcast only
when it was counted to be within `broadcast_words`; beyond that the words are shuffled, with the
hot ones (spaces, articles) salted.

Defined results: null and empty texts give an empty list; special tokens in a text are ordinary text;
nothing is trimmed or normalised; repeated rows come out as often as they occur; other columns are
dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.session import cut

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SALTS = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pre_tokens(c: str = "text"):
    return F.regexp_extract_all(F.col(c), F.lit("(?U)" + PATTERN), F.lit(0))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words(word) distinct -> (word, ids)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
        one = enc._core_bpe.encode_single_piece
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": [one(w.encode("utf-8")) for w in b["word"]]})

    return words.mapInPandas(run, "word string, ids array<int>")


def encode(docs: DataFrame, path: str | None = None, broadcast_words: int = 500_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids)"""
    path = path or vocabulary_path()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    texts = d.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    split = texts.select("doc_id", "h", "copies", pre_tokens().alias("words"))
    distinct = d.select("text").select(F.explode(pre_tokens()).alias("word")).distinct()
    table = cut(encode_words(distinct, path), "words")
    tokens = split.select("doc_id", "h", "copies", F.posexplode_outer("words").alias("pos", "word"))
    if table.count() <= broadcast_words:
        joined = tokens.join(F.broadcast(table), "word", "left")
    else:
        salted = table.select("word", "ids", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = tokens.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"], "left")
    got = joined.groupBy("doc_id", "h", "copies").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "ids")))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    got = got.select("doc_id", "copies", ids.alias("ids"))
    return got.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text), by joining the table of token bytes (bounded by the vocabulary's size)."""
    path = path or vocabulary_path()
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for b, i in load_ranks(path).items()], "id int, bytes binary")
    e = encoded.select("doc_id", F.xxhash64("ids").alias("h"), F.posexplode_outer("ids").alias("pos", "id"))
    parts = e.join(F.broadcast(table), "id", "left").groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("x"))))).alias("parts"))
    return parts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), "")), "UTF-8").alias("text"))
