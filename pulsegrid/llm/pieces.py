"""SentencePiece encoding and decoding with a distinct-chunk table.

Where no piece has a whitespace marker behind another character, a merge cannot
cross from one marked word into the next, so a text's segmentation is the
concatenation of its marked words' segmentations.  A chunk is a run of markers
and the characters up to the next marker.  The chunks of a batch of texts are
found by vectorised scans and hashed, each distinct chunk is segmented once by
the library, and ids come back by position.  Chunks seen before in the same task
are kept in a table of bounded size, in two generations: when the young one is full
it becomes the old one, and what is asked for again comes back from there, so the
frequent chunks stay.  Equal hashes count only with a second, independent hash.

A model whose pieces do cross markers, or which normalises text, is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.words import hash_spans, slices, text_buffers

MARK = "▁"
#: Chunks that a task remembers at most, and the bytes of the longest chunk remembered.
REMEMBERED, LONGEST = 500_000, 64


def checked_model(model_file: str) -> bytes:
    """The model's bytes, if chunks can be segmented apart."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(model_file, "rb") as f:
        data = f.read()
    model = pb.ModelProto.FromString(data)
    spec = model.normalizer_spec
    crossing = [p.piece for p in model.pieces if MARK in p.piece.lstrip(MARK)]
    if crossing or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("chunks of this model cannot be segmented apart")
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces):
        raise ValueError("user-defined pieces are matched across chunks")
    return data


class Chunks:
    """Segments texts by distinct chunk.

    Ids come as decimals joined by commas, or as ``packed`` 16-bit little-endian integers.
    """

    def __init__(self, model: bytes, packed: bool = False):
        self.packed = packed
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.anchor = self.processor.piece_to_id("a")
        self.known: dict[int, tuple[bytes, int, bytes, int]] = {}
        self.older: dict[int, tuple[bytes, int, bytes, int]] = {}

    def segment(self, chunks: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        """(ids, number of ids, decoded bytes) of chunks, each given without its first marker."""
        ids = self.processor.encode([c.decode() for c in chunks], num_threads=1)
        prefix = self.processor.encode("")  # ids that the model adds to any text: none
        marker = self.processor.piece_to_id(MARK)
        ids = [x[len(prefix) :] if c else [marker] for x, c in zip(ids, chunks, strict=True)]
        if self.packed:
            return [(np.array(x, dtype="<u2").tobytes(), len(x), b"") for x in ids]
        # decoding drops the marker of a leading piece; behind another piece it stays
        plain = self.processor.decode([[self.anchor, *x] for x in ids], num_threads=1)
        return [(",".join(map(str, x)).encode(), len(x), t[1:].encode()) for x, t in zip(ids, plain, strict=True)]

    def encoded(self, column: pa.Array) -> Iterator[tuple[bytes, int, bytes]]:
        """For each text: ids, number of ids, decoded text (empty with ``packed``)."""
        data, offsets = text_buffers(column)
        for i, j in slices(offsets):
            yield from self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _remembered(self, key: int, mark: int) -> tuple[bytes, int, bytes, int] | None:
        row = self.known.get(key)
        if row is None and (row := self.older.get(key)) is not None:
            self._remember(key, row)
        return row if row is not None and row[3] == mark else None

    def _remember(self, key: int, row: tuple[bytes, int, bytes, int]) -> None:
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.older = {}, self.known
        self.known[key] = row

    def _slice(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[bytes, int, bytes]]:
        n = len(data)
        raw = data.tobytes()
        if MARK.encode() in raw:  # a literal marker is a space to the library
            texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            raw = b"".join(texts)
            data, n = np.frombuffer(raw, dtype=np.uint8), len(raw)
        space = data == 32
        head = np.zeros(n + 1, dtype=bool)
        head[offs] = True  # the dummy prefix marks the first word of a text
        head = head[:n]
        behind = np.concatenate(([False], space[:-1])) if n else space
        # a chunk begins at the start of a text and at a space that no space of the same text precedes
        starts = np.flatnonzero(head | (space & ~behind))
        # the dummy prefix and leading spaces are one run of markers: head covers both
        ends = np.concatenate((starts[1:], [n]))
        first = head[starts]
        # behind the first marker: a leading chunk's is the dummy prefix, any other's its first space
        begins = np.where(first, starts, starts + 1)
        hashes, check = hash_spans(data, begins, ends), hash_spans(data, begins, ends, seed=1)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if (odd := np.flatnonzero(check != check[at][back])).size:  # two chunks of one hash: each such place for itself
            back[odd] = len(distinct) + np.arange(len(odd))
            distinct, at = np.concatenate((distinct, hashes[odd])), np.concatenate((at, odd))
        keys, marks = distinct.tolist(), check[at].tolist()
        rows = [self._remembered(k, m) for k, m in zip(keys, marks, strict=True)]
        new = [k for k, r in enumerate(rows) if r is None]
        b, e = begins[at].tolist(), ends[at].tolist()
        for k in range(0, len(new), 50_000):
            group = new[k : k + 50_000]
            for x, r in zip(group, self.segment([raw[b[x] : e[x]] for x in group]), strict=True):
                rows[x] = (*r, marks[x])
                if e[x] - b[x] <= LONGEST:
                    self._remember(keys[x], rows[x])
        ids = np.empty(len(rows), dtype=object)
        plain = np.empty(len(rows), dtype=object)
        ids[:], plain[:] = [r[0] for r in rows], [r[2] for r in rows]
        counts = np.array([r[1] for r in rows], dtype=np.int64)
        sums = np.concatenate(([0], np.cumsum(counts[back])))
        bounds = np.searchsorted(starts, offs)
        comma = b"" if self.packed else b","
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if x == y:
                yield b"", 0, b""
                continue
            own = back[x:y]
            text = b"".join(plain[own].tolist())
            yield comma.join(ids[own].tolist()), int(sums[y] - sums[x]), text[1:]


def shipped(spark, model_file: str) -> str:
    """Sends a checked model file to every executor; its name there."""
    checked_model(model_file)
    spark.sparkContext.addFile(model_file)
    return model_file.rsplit("/", 1)[-1]


def encoded(docs: DataFrame, model_file: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``, or
    (doc_id, n_tokens, ids, decoded) with ``ids``.

    No begin or end ids, no sampling.  A null text is an empty one and has no
    ids; rows that repeat a doc_id stay; an empty table gives no rows.
    """
    name = shipped(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(name), "rb") as f:
            chunks = Chunks(f.read())
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                rows, counts, plain = [], [], []
                for x, n, text in chunks.encoded(b.column(1)):
                    counts.append(n)
                    if ids:
                        rows.append([int(v) for v in x.split(b",")] if x else [])
                        plain.append(text.decode())
                    else:
                        rows.append(hashlib.sha256(x).hexdigest())
                        plain.append(hashlib.sha256(text).hexdigest())
                made = [pa.array(counts, pa.int64()), pa.array(rows, pa.list_(pa.int32()) if ids else pa.string()), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "n_tokens", *names])

    names = ("ids", "decoded") if ids else ("ids_sha256", "decoded_sha256")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[0]} {'array<int>' if ids else 'string'}, {names[1]} string")
