"""Quality rules as a ledger: every rule is evaluated once per document and leaves one bit and its measurements.

A policy is a set of rules, stored as a mask; applying another version, or asking what a rule alone costs, needs the stored
bits only, never the texts.

Defined cases: a null or empty text has no words and fails `few_words`; repeated rows are judged one by one; columns of the
input named like a result column are replaced; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carsift.llm.words import Reader, sums

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits"]
SYMBOLS = b"#[*$%&|<>]".translate(None, b"[]")

# rule -> the condition under which a document fails it, over the measurements; the bit is the rule's place in this list
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "n_letters >= 50 and 100 * n_upper > 70 * n_letters"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("digits", "100 * n_digits > 50 * word_chars"),
]
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": tuple(name for name, _ in RULES),
    "lenient": (*BASE, "symbols", "shouting"),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in rules)


def _measured(text: str, keep_text: bool):
    def run(batches):
        yield from _measured_batches(batches, text, keep_text)

    return run


def _measured_batches(batches, text: str, keep_text: bool):
    reader = Reader()
    byte = np.arange(256)
    symbol, upper, digit = np.isin(byte, list(SYMBOLS)), (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57)
    letter = upper | ((byte >= 97) & (byte <= 122)) | (byte >= 0xC3)
    leads = reader.is_word & ((byte & 0xC0) != 0x80)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        keep = [i for i, n in enumerate(batch.schema.names) if keep_text or i != at]
        names = [batch.schema.names[i] for i in keep] + MEASURES
        for s in reader.slices(batch.column(at)):
            rows = s.hi - s.lo
            out = {"n_words": s.count}
            for name, table in (("word_chars", leads), ("n_symbols", symbol), ("n_upper", upper), ("n_letters", letter), ("n_digits", digit)):
                out[name] = sums(table[s.data], s.offsets)
            out["n_repeat_words"] = _repeated(s)
            lines = [[x for x in (t.as_py() or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")] for t in batch.column(at).slice(s.lo, rows)]
            out["n_lines"] = np.array([len(x) for x in lines], np.int64)
            out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(s.lo, rows) for i in keep] + [pa.array(out[m], pa.int64()) for m in MEASURES], names)


def _repeated(s) -> np.ndarray:
    """Words of each row that stand in a three-word window found twice or more in it."""
    h, first = s.windows(3)
    h = h ^ (s.row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(s.hash), bool)
    for k in range(3):
        covered[first[twice] + k] = True
    return np.bincount(s.row[covered], minlength=s.hi - s.lo).astype(np.int64)


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of docs (the text only if asked for), the measurements, and fail_bits (bit i set: rule i of RULES failed)."""
    taken = {*MEASURES, "fail_bits"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in taken])
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, *[T.StructField(m, T.LongType(), False) for m in MEASURES]])
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    return docs.mapInArrow(_measured(text, keep_text), schema).withColumn("fail_bits", reduce(Column.bitwiseOR, bits))


def failed(policy: tuple[str, ...]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def kept(policy: str = "v1") -> Column:
    return ~failed(POLICIES[policy])


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, those that fail nothing else, and the kept count without it.

    The bits are first counted by pattern (at most 2**rules rows), so the ledger is read once for all rules.
    """
    whole = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if (1 << i) & whole])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r")).groupBy(F.col("r.rule").alias("rule"))
        .agg(total(hit).alias("failed"), total(alone).alias("failed_alone"), total(alone | (F.col("bits") == 0)).alias("kept_without"))
    )
