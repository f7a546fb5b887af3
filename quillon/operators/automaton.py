"""Which stored values occur in which texts: automata over many values at once, keyed by session and dealt out where a session is large."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import pii

#: Shorter folds are no evidence: they occur in any text.
LEAST = 4
#: Values of one automaton, and texts that one task runs through it, about.
VALUES, TEXTS = 10_000, 100_000
FOUND = "id long, vid long, cls string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (session, shard, bucket), a key's values (is_text 0) before its texts. Of the values in a text the one of least vid is told."""
    import ahocorasick

    at, whole, automata = None, {}, {}
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            key = (r["session"], r["shard"], r["bucket"])
            if key != at:
                at, whole, automata = key, {}, {"digits": ahocorasick.Automaton(), "letters": ahocorasick.Automaton()}
            own = (r["vid"], r["cls"])
            if not r["is_text"]:
                whole[r["raw"]] = min(whole.get(r["raw"], own), own)
                for fold, automaton in automata.items():
                    if len(r[fold]) >= LEAST:
                        automaton.add_word(r[fold], min(automaton.get(r[fold], own), own))
                continue
            hits = [whole[r["raw"]]] if r["raw"] in whole else []
            for fold, automaton in automata.items():
                if len(automaton):
                    if automaton.kind != ahocorasick.AHOCORASICK:
                        automaton.make_automaton()
                    hits += [hit for _, hit in automaton.iter(r[fold])]
            if hits:
                found.append((r["id"], *min(hits)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "vid", "cls"])


def held(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, vid, cls): for each text the stored value of least vid that its session holds and that the text is or contains, folded.

    values (session, vid, cls, value), texts (session, id, text). A session's values are cut into shards and its texts into buckets, every
    text meets every shard, and each task holds one shard; sums of a session decide how many there are. Blank texts hold nothing.
    """
    shards = values.groupBy(F.col("session").alias("vs")).agg(F.ceil(F.count("*") / VALUES).cast("int").alias("shards"))
    buckets = texts.groupBy(F.col("session").alias("ts")).agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("buckets"))
    sizes = shards.join(buckets, F.col("vs") == F.col("ts")).select(F.col("vs").alias("own"), "shards", "buckets")
    folds = lambda c: [F.col(c).alias("raw"), pii.digit_fold(F.col(c)).alias("digits"), pii.text_fold(F.col(c)).alias("letters")]
    blank_id, blank_vid = F.lit(None).cast("long"), F.lit(None).cast("long").alias("vid")
    v = values.join(sizes, F.col("session") == F.col("own")).select(
        "session", F.pmod(F.xxhash64("vid"), "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(0).alias("is_text"), blank_id.alias("id"), "vid", "cls", *folds("value")
    )
    t = texts.where(F.trim("text") != "").join(sizes, F.col("session") == F.col("own")).select(
        "session", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id"), "buckets").cast("int").alias("bucket"), F.lit(1).alias("is_text"), "id", blank_vid, F.lit(None).cast("string").alias("cls"), *folds("text")
    )
    dealt = v.union(t).repartition("session", "shard", "bucket").sortWithinPartitions("session", "shard", "bucket", "is_text")
    return dealt.mapInArrow(_run, FOUND).groupBy("id").agg(F.min(F.struct("vid", "cls")).alias("m")).select("id", "m.vid", "m.cls")
