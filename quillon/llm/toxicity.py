"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import cut, drop_cut, small_batches, text_or_empty

#: A sentence ends after these or at a line's end; a text without either is one sentence.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
WORDS = re.compile(r"[^\W\d_]+")
#: Word and prefix features that are kept at most, and the least share of labelled documents that have one.
FEATURES, LEAST_DOCS = 4096, 5
#: Labelled documents that the sentence model is fitted on at most: a documented bound, drawn by hash of the id.
TRAIN_DOCS = 40_000
#: Numbers of features that these may have in all.
TRAIN_FEATURES = 10_000_000
PREFIX = (4, 5)
EPOCHS, RATE, L2 = 400, 0.15, 1e-4


def features(sentence: str) -> set[str]:
    """Words in lower case, and prefixes of longer words (marked), so that unseen endings count."""
    found = set()
    for w in WORDS.findall(sentence.lower()):
        found.add(w)
        for k in PREFIX:
            if len(w) > k:
                found.add(w[:k] + "*")
    return found


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


#: Words whose weighted features are remembered at most.
REMEMBERED = 200_000


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def weighted(self, words: set[str]) -> set[str]:
        """Those features of words in lower case that have a weight."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words.difference(known):
            known[w] = tuple(f for f in features(w) if f in self.weights)
        return {f for w in words for f in known[w]}

    def probability(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))

    def sentence(self, s: str) -> float:
        """Probability that the sentence alone makes a document toxic."""
        return self.probability(self.weighted(set(WORDS.findall(s.lower()))))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences, and (start, end, score) of those that offend by themselves."""
        if not text:
            return self.sentence(""), []
        if not self.weighted(set(WORDS.findall(text.lower()))):  # no sentence has a feature: all score alike
            p = self.probability(set())
            cuts = [(m.start(), m.end()) for m in SENTENCE_END.finditer(text)]
            spans = [(a, b) for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)], strict=True) if b > a]
            return float(-math.expm1(len(spans) * math.log1p(-min(p, 1 - 1e-12)))), [(a, b, p) for a, b in spans] if p >= 0.5 else []
        miss, bad, at = 0.0, [], 0
        for m in [*SENTENCE_END.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                p = self.sentence(text[at:end])
                miss += math.log1p(-min(p, 1 - 1e-12))
                if p >= 0.5:
                    bad.append((at, end, p))
            at = m.end() if m else end
        return float(-math.expm1(miss)), bad


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text) if s]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic): the distinct features of each labelled document."""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            got = features(text.as_py() or "")
            out[0].extend(got)
            out[1].extend([toxic] * len(got))
            if len(out[0]) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["feature", "toxic"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["feature", "toxic"])


def _bags(index: dict[str, int]) -> Callable:
    """Per document: label, number of sentences, and the kept features of each sentence that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, hits = [], []
            for text in batch.column("text"):
                n, rows = 0, []
                for s in sentences(text.as_py() or ""):
                    got = sorted(index[f] for f in features(s) if f in index)
                    n += 1
                    if got:
                        rows.append(got)
                plain.append(n - len(rows))
                hits.append(rows)
            columns = [batch.column("label_id"), batch.column("toxic"), pa.array(plain, pa.int32()), pa.array(hits, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["label_id", "toxic", "plain", "hits"])

    return run


class Bags:
    """Documents as bags of sentences, in flat arrays: of each sentence with features its document, of each feature its sentence."""

    def __init__(self, toxic: np.ndarray, plain: np.ndarray, hits: list[list[list[int]]]) -> None:
        self.y, self.plain = toxic.astype(float), plain
        self.doc = np.array([d for d, rows in enumerate(hits) for _ in rows], dtype=np.int64)
        flat = [(s, f) for s, row in enumerate(r for rows in hits for r in rows) for f in row]
        self.sentence, self.feature = (np.array([x[k] for x in flat], dtype=np.int64) for k in (0, 1))

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the mean negative log-likelihood, with L2 on the weights; the last of w is the bias."""
        n = len(self.y)
        z = w[-1] + np.bincount(self.sentence, w[self.feature], len(self.doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-w[-1]))
        log_miss = np.bincount(self.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + self.plain * np.log1p(-p0)
        toxic = np.clip(-np.expm1(log_miss), 1e-9, 1 - 1e-9)
        # d loss / d log_miss; d log_miss / d z of a sentence is -p
        g_doc = np.where(self.y > 0, (1 - toxic) / toxic, -1.0)
        g_sentence = -g_doc[self.doc] * p
        g = np.empty_like(w)
        g[:-1] = np.bincount(self.feature, g_sentence[self.sentence], len(w) - 1) / n + L2 * w[:-1]
        g[-1] = (g_sentence.sum() - (g_doc * self.plain * p0).sum()) / n
        return g


def fit_bags(toxic: np.ndarray, plain: np.ndarray, hits: list[list[list[int]]], n_features: int) -> tuple[float, np.ndarray]:
    """Noisy-or likelihood by Adam. Weights of features start at nothing and only evidence moves them."""
    if len(np.unique(toxic)) < 2:
        raise ValueError("documents of both labels are needed")
    bags = Bags(toxic, plain, hits)
    w = np.zeros(n_features + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, EPOCHS + 1):
        g = bags.gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[-1]), w[:-1]


def prior(n: dict[int, int]) -> Model:
    """A model that tells nothing but how many documents of either label there are."""
    return Model(math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_features: int = TRAIN_FEATURES) -> Model:
    """Fits the model on labelled documents that are not held out.

    About train_docs of them are used at most, chosen by a hash of the id (all, if there are fewer). Features are the words
    and prefixes most over-represented in toxic ones by a log-odds score, at most FEATURES: the driver gets these and,
    of each training document, the numbers of its kept features, of about train_features in all at most: beyond that,
    fewer documents by the same hash. Rows of one id are one document, the text that sorts last. Rows without id, label or with an unknown label are
    left out. Without labels of both kinds the score is the share of toxic ones (0.5 if none) whatever the text.
    """
    ids = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.col("label_id").isNotNull() & (F.crc32(F.col("label_id").cast("string")) % 5 != 0)).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    counts = ids.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in counts}
    total = sum(n.values())
    if len(n) < 2:
        return prior(n)
    if total > train_docs:
        ids = ids.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(train_docs / total * (1 << 20)))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the sample is bounded whatever the corpus, so its ids may go to every task and no text is shuffled for it
    train = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "toxic").agg(F.max("text").alias("text"))
    train = cut(train, "labelled")
    seen = train.mapInArrow(_feature_rows, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    lift = F.log((F.col("a") + 0.5) / n[1]) - F.log((F.col("b") + 0.5) / n[0])
    top = seen.where(F.col("a") >= LEAST_DOCS).withColumn("score", lift * F.sqrt("a")).where(lift > 1.0)
    names = [r["feature"] for r in top.orderBy(F.desc("score"), "feature").limit(FEATURES).select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}
    bags = train.mapInArrow(_bags(index), "label_id long, toxic int, plain int, hits array<array<int>>").withColumn("size", F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + F.size(h) + 1))
    bags = cut(bags, "bags")
    size = bags.agg(F.sum("size")).first()[0] or 0
    chosen = bags if size <= train_features else bags.where(F.pmod(F.xxhash64("label_id", F.lit("bag")), F.lit(1 << 20)) < int(train_features / size * (1 << 20)))
    table = chosen.orderBy("label_id").select("toxic", "plain", "hits").toArrow()
    drop_cut(train)
    drop_cut(bags)
    bags = table
    toxic = np.array(bags["toxic"].to_pylist(), dtype=np.int64)
    if len(np.unique(toxic)) < 2:
        return prior({k: int((toxic == k).sum()) for k in (0, 1)})
    bias, weights = fit_bags(toxic, np.array(bags["plain"].to_pylist()), bags["hits"].to_pylist(), len(names))
    return Model(bias, {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3})


def _scored(model: Model) -> Callable:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, bad = [], []
            for text in batch.column("text"):
                s, b = model.document(text.as_py() or "")
                scores.append(s)
                bad.append([{"start": x, "end": y, "score": z} for x, y, z in b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(bad, spans)], names=["doc_id", "score", "offending"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, offending (spans of sentences in code points) of every row of docs.

    Null texts count as empty and get the base score; repeated rows score alike, as do texts that tie. Whole texts are
    read, however long. An empty table gives an empty result; other columns are ignored.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def _accepted(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.document(t.as_py() or "")[0] < 0.5 for t in batch.column("__text")], pa.bool_()))

    return run


def passing(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, all columns as they were."""
    marked = small_batches(docs).withColumn("__text", text_or_empty(text_col))
    return marked.mapInArrow(_accepted(model), marked.schema).drop("__text")
