"""Language identification, word first: a word seen in training counts by its log frequency per language; an unseen word backs
off to its longest character n-grams that training has seen, and on to shorter ones.

The model is fitted on a bounded sample of the labelled rows (`max_docs`, chosen by a hash of doc_id) and keeps the most
frequent words and n-grams of each language (`max_words`, `max_grams`); these bounds make it small enough to ship to tasks.
Scoring reads every word of every whole text.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if nothing was learned; equal
scores go to the language that sorts first; repeated rows are scored one by one; other input columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}+")
NONLETTERS = r"[^\p{L}]+"
LONGEST = 4
CACHED = 1 << 20


def train_rows(docs: DataFrame, max_docs: int) -> DataFrame:
    """Labelled rows with text, thinned by a hash of doc_id to about max_docs rows; all of them when there are fewer."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.count()
    share = min(1.0, max_docs / max(1, n))
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < int(share * (1 << 30)))


class Model:
    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.langs, self.words, self.grams = langs, words, grams

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency over the word's n-grams of the greatest length at which any is known."""
        padded = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.langs))

    def vector(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        return self.unseen(word) if known is None else known


def _centred(counts: dict[str, dict[str, int]], langs: list[str], smooth: float) -> dict[str, np.ndarray]:
    """Log relative frequency per language, less the mean over languages."""
    totals = Counter()
    for by in counts.values():
        totals.update(by)
    out = {}
    for key, by in counts.items():
        v = np.array([math.log((by.get(x, 0) + smooth) / (totals[x] + smooth * len(counts))) for x in langs])
        out[key] = v - v.mean()
    return out


def fit(train: DataFrame, max_docs: int = 20_000, max_words: int = 20_000, max_grams: int = 20_000) -> Model:
    rows = train_rows(train, max_docs)
    words = rows.select("lang", F.explode(F.split(F.lower("text"), NONLETTERS)).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = words.where("n >= 2").withColumn("k", F.row_number().over(best)).where(F.col("k") <= max_words)
    padded = F.concat(F.lit("^"), "w", F.lit("$"))
    cut = F.explode(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i, n=n: padded.substr(i, F.lit(n))) for n in range(1, LONGEST + 1)])))
    grams = words.select("lang", "n", cut.alias("w")).groupBy("lang", "w").agg(F.sum("n").alias("n"))
    top_grams = grams.withColumn("k", F.row_number().over(best)).where(F.col("k") <= max_grams)

    def gathered(frame: DataFrame) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for r in frame.select("lang", "w", "n").toLocalIterator():
            out.setdefault(r["w"], {})[r["lang"]] = r["n"]
        return out

    by_word, by_gram = gathered(top), gathered(top_grams)
    langs = sorted({x for by in by_gram.values() for x in by})
    return Model(langs, _centred(by_word, langs, 0.5), _centred(by_gram, langs, 0.5))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the prediction under one vote per word, tempered by the number of words)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, scores = [], []
            for text in (x.as_py() for x in batch.column(1)):
                counts = Counter(WORD.findall(text.lower())) if text else {}
                if not counts or not model.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                if len(cache) > CACHED:
                    cache.clear()
                for w in counts:
                    if w not in cache:
                        cache[w] = model.vector(w)
                n = np.fromiter(counts.values(), float, len(counts))
                total = n @ np.array([cache[w] for w in counts]) / max(1.0, math.sqrt(n.sum()))
                p = np.exp(total - total.max())
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
