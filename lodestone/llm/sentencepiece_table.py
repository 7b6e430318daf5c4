"""SentencePiece encoding through a table of distinct chunks, and decoding.

A model whose pieces hold the white-space marker at their front alone never merges across the point where a marker
follows something else. Texts are therefore cut there into marked words; distinct ones are segmented once by the
library, and their ids are joined back by position.

1. `chunk_table`: Spark counts the marked words of all texts, segments the TABLE_CHUNKS most frequent ones, each once
   for the whole corpus, and broadcasts them with their ids (a few MB, whatever the corpus).
2. Every task looks its words up there. The rare rest goes into a memo of the task, which is begun anew when it holds
   MEMO_BYTES (one piece of text more at most); that bounds its memory and changes no result.

Texts are read in pieces of PIECE characters, cut at a marker, so that a very long one needs no more than its ids.

Edge cases: a null text is the empty text, whose ids are begin and end alone; repeated rows are encoded each on its
own; an empty table gives no rows; of other columns those named in `keep` are returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.llm.common import cut, map_batches, pieces

MARKER = "▁"
#: Chunks of the broadcast table, which is thus bounded: some 4 MB as sent, 12 MB as a dictionary.
TABLE_CHUNKS = 60_000
#: Longer chunks aren't counted for the table; they are segmented where they stand.
TABLE_LENGTH = 64
#: Bytes that a task's memo of other chunks, and a task's counts, may hold before they are begun anew.
MEMO_BYTES = 16 << 20
#: Bytes of an entry of a dictionary besides its characters and ids.
ENTRY = 180
#: Characters that are cut into chunks at once, and of the texts whose ids are returned at once.
PIECE, BATCH = 1 << 17, 1 << 20
_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> Iterator[list[str]]:
    """The marked words of a text, of some PIECE characters at a time."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + PIECE)
        stop = len(text) if stop < 0 else stop
        while 0 < stop < len(text) and text[stop - 1] in (" ", MARKER):  # not within a run of markers
            stop -= 1
        if stop <= at:
            stop = len(text)
        piece = text[at:stop].replace(" ", MARKER)
        yield _CHUNK.findall(piece if at else MARKER + piece)
        at = stop


class ChunkTable:
    """Encodes and decodes as the library does, begin and end ids included; ids are bytes of little-endian 32-bit numbers."""

    def __init__(self, model: str, common: Mapping[str, bytes] | None = None, memo_bytes: int = MEMO_BYTES) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        named = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) for p in named) or any(p != p.lstrip(MARKER) and len(p) - len(p.lstrip(MARKER)) > 1 and p.strip(MARKER) for p in named):
            raise ValueError("pieces of this model cross white-space markers")
        if self.library.encode("a  b ", out_type=str)[-1] != MARKER:
            raise ValueError("this model drops white space, so chunks can't be cut at it")
        self.marker = np.array([self.library.piece_to_id(MARKER)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        self.common, self.memo, self.held, self.memo_bytes = common or {}, {}, 0, memo_bytes

    def segment(self, new: Sequence[str]) -> list[bytes]:
        """Ids of chunks; the library puts the first marker in front by itself."""
        ids = self.library.encode([c[1:] for c in new], num_threads=1)
        return [self.marker if c == MARKER else np.array(x, "<u4").tobytes() for c, x in zip(new, ids, strict=True)]

    def _piece(self, found: list[str]) -> bytes:
        if self.held > self.memo_bytes:
            self.memo, self.held = {}, 0
        common, memo = self.common, self.memo
        new = [c for c in set(found) if c not in common and c not in memo]
        if new:
            memo.update(zip(new, self.segment(new), strict=True))
            self.held += sum(4 * len(c) + len(memo[c]) + ENTRY for c in new)
        if not common:
            return b"".join(map(memo.__getitem__, found))
        return b"".join([common[c] if c in common else memo[c] for c in found])

    def encode(self, text: str) -> bytes:
        return b"".join([self.begin, *map(self._piece, chunks(text)), self.end])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """chunk, n: how often it stands in all texts; summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["chunk", "n"])

        for b in batches:
            for t in b.column("_text").to_pylist():
                for found in chunks(t or ""):
                    counts.update(found if max(map(len, found)) <= TABLE_LENGTH else (c for c in found if len(c) <= TABLE_LENGTH))
                    if len(counts) * ENTRY > MEMO_BYTES:
                        yield rows()
                        counts = Counter()
        if counts:
            yield rows()

    return map_batches(docs.select(F.col(text).alias("_text")), run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: str, text: str = "text", size: int = TABLE_CHUNKS) -> dict[str, bytes]:
    """The `size` most frequent chunks of up to TABLE_LENGTH characters, with their ids; each is segmented once, in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(table.segment(b.column("chunk").to_pylist()), pa.binary())], names=["chunk", "ids"])

    top = chunk_counts(docs, text).filter("n > 1").orderBy(F.desc("n"), "chunk").limit(size)
    got = cut(map_batches(top.select("chunk"), run, "chunk string, ids binary")).toArrow()
    return dict(zip(got.column("chunk").to_pylist(), got.column("ids").to_pylist(), strict=True))


Finish = Callable[[ChunkTable, list[bytes]], dict[str, pa.Array]]


def map_encoded(docs: DataFrame, finish: Finish, fields: Sequence[StructField], model: str | None = None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, and what `finish` makes of the ids of some texts at a time."""
    model = model or default_model()
    common = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model, text))
    taken = docs.select(*keep, docs[text].alias("_text"))
    schema = StructType([docs.schema[k] for k in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, common.value)
        for whole in batches:
            texts = [t or "" for t in whole.column("_text").to_pylist()]
            for a, b in pieces(texts, BATCH):
                made = finish(table, [table.encode(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([whole.slice(a, b - a).column(k) for k in keep] + [made[f.name] for f in fields], names=[f.name for f in schema])

    return map_batches(taken, run, schema)


def encode(docs: DataFrame, model: str | None = None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, ids (array of int, begin and end included) and n_tokens."""

    def finish(_: ChunkTable, ids: list[bytes]) -> dict[str, pa.Array]:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        ends = np.append(np.zeros(1, np.int64), np.cumsum(sizes)).astype(np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))), "n_tokens": pa.array(sizes)}

    return map_encoded(docs, finish, [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())], model, keep, text)


def decode(encoded: DataFrame, model: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and decoded, the text of the column ids (null: empty)."""
    model = model or default_model()
    schema = StructType([encoded.schema[k] for k in keep] + [StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for whole in batches:
            texts = pa.array([table.library.decode(x.as_py() or []) for x in whole.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*(whole.column(k) for k in keep), texts], names=schema.names)

    return map_batches(encoded.select(*keep, "ids"), run, schema)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text."""

    def finish(table: ChunkTable, ids: list[bytes]) -> dict[str, pa.Array]:
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([sha256(table.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        }

    return map_encoded(docs, finish, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())], model)
