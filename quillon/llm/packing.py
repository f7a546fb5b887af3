"""Best-fit packing: bounded-space online best-fit over tokenised documents."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.base import small_batches, text_or_empty

#: Tokens of a sequence, open bins of a packer, the id that ends a document.
CAPACITY, OPEN_BINS, END_ID = 4096, 1024, 1
#: A packer is dealt about so many documents: few enough for one task, enough to leave no trace of its last open bins.
DOCS_PER_PACKER = 250_000
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and the longest of them; then it forgets all and begins anew.
REMEMBERED, LONGEST = 1_000_000, 40
#: Bytes of texts whose new words are learnt at once.
GROUPED = 1 << 20
# The vocabulary's own split of lower-case text into words, for the characters of Latin-1.
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
LATIN_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LATIN_LETTER + rb"]+|[" + LATIN_NUMBER + rb"]|[^" + LATIN_SPACE + LATIN_LETTER + LATIN_NUMBER + rb"]+")
LATIN_LOWER = bytes(ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of a text as little-endian bytes.

    A text of Latin-1 characters is cut into lower-case words as the vocabulary's own rules cut it; merges never cross
    words, so its ids are those of its words in a row, and words seen before are looked up. New ones are encoded
    together and parted where a token ends a word. Any other text, and one with a special token's string, is encoded
    as a whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; their new words are learnt together."""
        cut = []
        for text in texts:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            special = raw is None or (b"<|" in raw and any(t in raw for t in self.special))
            cut.append(None if special else LATIN_WORDS.findall(raw.translate(LATIN_LOWER)))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*[c for c in cut if c]).difference(known)
        extra = self._learn(sorted(new)) if new else {}
        if extra is None:
            return [self._whole(t) for t in texts]
        if extra:
            return [self._whole(t) if c is None else b"".join([known[w] if w in known else extra[w] for w in c]) for t, c in zip(texts, cut, strict=True)]
        return [self._whole(t) if c is None else b"".join([known[w] for w in c]) for t, c in zip(texts, cut, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes] | None:
        """Remembers new words; returns those too long to be kept, or None if ends of tokens do not part the words."""
        ids = np.array(self.plain.encode_batch_fast([b"\n".join(new).decode("latin-1")], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            return None
        raw, extra = ids.tobytes(), {}
        for w, a, b in zip(new, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            (self.known if len(w) <= LONGEST else extra)[w] = raw[4 * a : 4 * b]
        return extra


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold GROUPED bytes of text or one row."""
    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())).to_numpy()
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + GROUPED, side="right")))
        yield batch.slice(row, end - row)
        row = end


def pieces_of(vocabulary: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = WordEncoder(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for rows in groups(batch):
                found = encoder.all_ids([t or "" for t in rows.column(1).to_pylist()])
                for doc, ids in zip(rows.column(0).to_pylist(), found, strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Packer:
    """At most `most` open bins. Bit f of `free` is set while a bin with f free places is open.

    The lowest set bit from an item's length up is the fullest bin that takes it. When nothing takes it and all bins
    are in use, the fullest bin closes and a new one opens.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.free, self.n, self.made = capacity, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        self.n -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to capacity tokens."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.n == self.most and length < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            number, room, self.made = self.made, self.capacity, self.made + 1
        if left := room - length:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.n += 1
        return number, self.capacity - room


def packed(capacity: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = TaskContext.get().partitionId() << 40, Packer(capacity, most)
        for batch in batches:
            places = [packer.put(n) for n in batch.column("length").to_pylist()]
            columns = [*batch.columns, pa.array([base + n for n, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(pieces_of(vocabulary, capacity, end_id), PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Packs every row of docs: PIECES plus sequence_id and offset.

    Null and empty texts are the end id alone; only documents longer than a sequence are cut. Pieces (five numbers
    each, no text) are dealt by hash to one packer per DOCS_PER_PACKER rows of docs and come to it in an order of hash
    and id, so a packer that is run again on another executor packs alike. Repeated rows are packed as often as they
    come. An empty table gives an empty result.
    """
    packers = max(1, -(-docs.count() // DOCS_PER_PACKER))
    pieces = tokenised(docs, id_col, text_col, vocabulary, capacity, end_id)
    pieces = pieces.withColumn("deal", F.xxhash64("doc_id", "piece")).repartition(packers, "deal").sortWithinPartitions("deal", "doc_id", "piece", "ids_crc32")
    return pieces.drop("deal").mapInArrow(packed(capacity, open_bins), PIECES + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
