"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised on its own; two neighbours are stitched at the first
pre-token boundary that both see in their overlap, because from a common boundary on the pattern matches the same way. The
pieces between stitches are then encoded, each in a task of its own, and their ids joined in order. Where neighbours never
agree in the overlap (a run of letters longer than it), that chunk and those after it are joined to the piece before, so the
result is always that of the whole text. Short texts are one chunk and need no stitching.

Defined cases: a null text counts as empty and has no ids; repeated rows each keep their own result; input columns named like
a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 15    # characters a chunk owns
OVERLAP = 1 << 10  # characters it shares with its right neighbour
MARGIN = 3         # matches ending this close to the cut may look different with more text


class Vocabulary:
    """Path of a rank file and the pre-token pattern; the encoder is built once per task."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def encoder(self):
        import tiktoken

        with open(self.path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _encode_batches(vocabulary: Vocabulary, text: str, verify: bool):
    def coded(coder, whole: str) -> bytes:
        ids = coder.encode_ordinary(whole)
        if verify and coder.decode_bytes(ids) != whole.encode():
            raise ValueError("a text does not come back from its ids")
        return np.asarray(ids, "<u4").tobytes()

    def run(batches):
        coder = vocabulary.encoder()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            ids = [coded(coder, x.as_py() or "") for x in batch.column(at)]
            keep = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(ids, pa.binary())], [n for n, _ in keep] + ["ids_le"])

    return run


def _boundaries(text: str, pattern) -> list[int]:
    """Ends of the pre-tokens of a cut text that more text on the right cannot change."""
    return [m.end() for m in pattern.finditer(text) if m.end() + MARGIN <= len(text)]


def _cut(chunk: int, overlap: int):
    def run(frames):
        for frame in frames:
            for row_key, text in zip(frame["__row"], frame["__text"]):
                n = max(1, -(-len(text) // chunk))
                yield pd.DataFrame({"__row": row_key, "part": np.arange(n), "body": [text[i * chunk : (i + 1) * chunk + overlap] for i in range(n)]})

    return run


def _pretokenised(pattern_text: str, chunk: int, overlap: int):
    def run(frames):
        import regex

        pattern = regex.compile(pattern_text)
        for frame in frames:
            head, tail = [], []
            for body in frame["body"]:
                ends = _boundaries(body, pattern)
                head.append([0, *[e for e in ends if e <= overlap]])
                tail.append([e - chunk for e in ends if e >= chunk])
            yield frame.assign(head=head, tail=tail)

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, verify: bool = False) -> DataFrame:
    """All columns of docs but for the text, with ids_le (ids as little-endian unsigned 32-bit integers) and n_tokens.

    verify: every piece is decoded again where it was encoded, and a difference is an error.
    """
    taken = {"ids_le", "n_tokens", "__row"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in taken and c != text], F.coalesce(text, F.lit("")).alias("__text"))
    rest = [c for c in docs.columns if c != "__text"]
    long = F.length("__text") > chunk
    ids = T.StructField("ids_le", T.BinaryType())
    whole = docs.where(~long).mapInArrow(_encode_batches(vocabulary, "__text", verify), T.StructType([*docs.select(rest).schema.fields, ids]))

    # a row's key covers all its columns, so equal rows share pieces that are equal too
    keyed = docs.where(long).withColumn("__row", F.sha2(F.concat_ws("\u0001", F.to_json(F.struct(*rest)), "__text"), 256))
    texts = keyed.select("__row", "__text").dropDuplicates(["__row"])
    cut = texts.mapInPandas(_cut(chunk, overlap), "__row string, part long, body string")
    seen = cut.repartition("__row", "part").mapInPandas(_pretokenised(vocabulary.pattern, chunk, overlap), "__row string, part long, body string, head array<long>, tail array<long>")
    order = Window.partitionBy("__row").orderBy("part")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    agreed = seen.withColumn("common", F.when(F.col("part") == 0, F.lit(0)).otherwise(common))
    # a chunk without a common boundary belongs to the piece before it, and what it sees further on proves nothing
    proven = F.min(F.col("common").isNotNull()).over(order)
    stitched = agreed.withColumn("start", F.when(proven, F.col("common")))
    piece = F.sum(F.col("start").isNotNull().cast("int")).over(order)
    stop = F.lead("start").over(order)
    own = F.when(F.lead("part").over(order).isNull(), F.col("body")).when(stop.isNull(), F.substring("body", 1, chunk)).otherwise(F.substring(F.col("body"), F.lit(1), (stop + chunk).cast("int")))
    pieces = (
        stitched.withColumn("piece", piece).withColumn("own", own)
        .withColumn("own", F.expr("substring(own, cast(coalesce(start, 0) + 1 as int))"))
        .groupBy("__row", "piece").agg(F.array_sort(F.collect_list(F.struct("part", "own"))).alias("bodies"))
        .select("__row", "piece", F.array_join("bodies.own", "").alias("own")).repartition("__row", "piece")
    )
    coded = pieces.mapInArrow(_encode_batches(vocabulary, "own", verify), "__row string, piece long, ids_le binary")
    joined = coded.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids_le"))).alias("p")).select(
        "__row", F.expr("aggregate(p.ids_le, cast('' as binary), (a, x) -> concat(a, x))").alias("ids_le"))
    split = keyed.select(*rest, "__row").join(joined, "__row").select(*rest, "ids_le")
    return whole.unionByName(split).withColumn("n_tokens", (F.octet_length("ids_le") / 4).cast("long"))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids_le", into: str = "decoded") -> DataFrame:
    """All columns, with the bytes that the ids stand for."""
    at_name = ids

    def run(batches):
        coder = vocabulary.encoder()
        for batch in batches:
            at = batch.schema.get_field_index(at_name)
            raw = [coder.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(at)]
            keep = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != into]
            yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(raw, pa.binary())], [n for n, _ in keep] + [into])

    fields = [f for f in rows.schema.fields if f.name != into]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(into, T.BinaryType())]))
