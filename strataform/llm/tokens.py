"""Op 7: token ids in Arrow stream files of fixed-size-list batches.

Documents are dealt by ranges of their ids; each range streams through the tokenizer into
one file whose rows are sequences of ``length`` ids with their mask, the last one padded.
Ids are stored in 16 bits where the vocabulary allows, so a reader that maps the file gets
ids and masks as slices of the mapped buffers, nothing copied. A second stream beside it
holds each document's id, start and length. A manifest row names the files that a finished
task wrote; files of lost or repeated attempts are in no manifest.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, shared_dir, sole

MANIFEST = "part int, path string, n_docs long, n_ids long"
#: Letters, then marks: the splitter always parts the two.
MARKED = regex.compile(r"( ?\p{L}+)([^\s\p{L}\p{N}]+)")
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Words a Python worker remembers, over all its tasks; about 350 MB.
MOST_KNOWN = 1_500_000
_CACHES: dict[tuple[str, str], WordCache] = {}


class WordCache:
    """Encodes with the tokenizers library, remembering the ids of words seen before.

    The byte-level splitter never joins text across a single space or line break between two
    other characters, but for the space going to the word after it. So such texts are cut
    there and only new words are encoded; any other run of white space, or the string of an
    added token, sends the whole text to the library. Ids are the library's either way.
    """

    def __init__(self, path: str, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.dtype, self.known = dtype, {}

    @classmethod
    def of(cls, path: str, dtype: str = "<u2") -> WordCache:
        """The worker's own cache, kept from task to task."""
        sole("tokens", _CACHES.clear)
        if (path, dtype) not in _CACHES:
            _CACHES[path, dtype] = cls(path, dtype)
        return _CACHES[path, dtype]

    def raw(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype == "<u2" else "I"
        return [array(code, e.ids).tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Ids of plain words; those ending in marks are put together from both parts' ids."""
        both, whole = [], set()
        for w in words:
            if m := MARKED.fullmatch(w):
                both.append((w, m[1], m[2]))
                whole.update(m.groups())
            elif self.plain(w):
                whole.add(w)
            else:
                self.known[w] = None
        need = [w for w in whole if w not in self.known]
        self.known.update(zip(need, self.raw(need)))
        for w, a, b in both:
            self.known[w] = self.known[a] + self.known[b]

    def parts(self, text: str) -> list[str] | None:
        if "\x01" in text or any(x in text for x in self.added):
            return None
        out = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
        if not out[-1] and len(out) > 1:
            out.pop()
        return out

    @staticmethod
    def plain(part: str) -> bool:
        body = part[1:] if part[:1] == " " else part
        return part == "\n" or bool(body) and len(body.split()) == 1 and not body[0].isspace() and not body[-1].isspace()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        cut_up = [self.parts(t) for t in texts]
        new = set().union(*[p for p in cut_up if p]).difference(self.known)
        if len(self.known) + len(new) > MOST_KNOWN:
            self.known.clear()
            new = set().union(*[p for p in cut_up if p])
        self.learn(new)
        get, out, whole = self.known.__getitem__, [], []
        for i, p in enumerate(cut_up):
            try:
                out.append(b"".join(map(get, p)))
            except TypeError:  # no parts, or one that is not plain
                out.append(b"")
                whole.append(i)
        for i, ids in zip(whole, self.raw([texts[i] for i in whole])):
            out[i] = ids
        return out


def chunks(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``size`` characters; null texts as empty ones."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            keys.append(k)
            texts.append(t)
            held += len(t) + 50
            if held >= size:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceFile:
    """Writes one shard: ``<path>.arrows`` (ids, mask) and ``<path>.index.arrows`` (doc_id, start, n)."""

    INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def __init__(self, uri: str, length: int, dtype: str, rows: int = 256):
        self.fs, path = file_system(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.files = [self.fs.open_output_stream(f"{path}.arrows"), self.fs.open_output_stream(f"{path}.index.arrows")]
        self.ids = pa.ipc.new_stream(self.files[0], self.schema)
        self.index = pa.ipc.new_stream(self.files[1], self.INDEX)
        self.held, self.n_held, self.n_ids, self.n_docs = [], 0, 0, 0

    def add(self, keys: list, ids: list[bytes]) -> None:
        n = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        start = self.n_ids + np.cumsum(n) - n
        self.index.write_batch(pa.record_batch([pa.array(keys, pa.int64()), pa.array(start), pa.array(n)], schema=self.INDEX))
        self.held.append(np.frombuffer(b"".join(ids), self.dtype))
        self.n_held += int(n.sum())
        self.n_ids += int(n.sum())
        self.n_docs += len(keys)
        if self.n_held >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        have = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        # all batches but the last hold as many rows, so a row's batch is found by division
        step = self.length if last else self.length * self.rows
        end = -(-len(have) // step) * step if last else len(have) // step * step
        ids = np.zeros(end, self.dtype)
        ids[: min(end, len(have))] = have[:end]
        mask = np.arange(end) < len(have)
        for at in range(0, end, self.length * self.rows):
            part = slice(at, at + self.length * self.rows)
            self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (ids, mask)], schema=self.schema))
        self.held, self.n_held = [have[end:]], max(0, len(have) - end)

    def close(self) -> None:
        self.flush(True)
        for x in (self.ids, self.index, *self.files):
            x.close()


def open_sequences(uri: str) -> tuple[list[pa.RecordBatch], pa.Table]:
    """The batches of a shard, mapped where the file is local, and its index."""
    from pyarrow import fs as pafs

    fs, path = file_system(uri)
    at = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
    return list(pa.ipc.open_stream(at(f"{path}.arrows"))), pa.ipc.open_stream(at(f"{path}.index.arrows")).read_all()


def sequence(batches: list[pa.RecordBatch], row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file's buffer) and mask of the row-th sequence, found by division."""
    per = batches[0].num_rows
    ids, mask = (batches[row // per].column(i) for i in (0, 1))
    length = ids.type.list_size
    k = row % per
    return ids.flatten().to_numpy()[k * length : (k + 1) * length], mask.flatten()[k * length : (k + 1) * length].to_numpy(zero_copy_only=False)


def ids_between(batches: list[pa.RecordBatch], start: int, n: int) -> np.ndarray:
    """Ids start .. start + n of a shard; a view unless they cross batches."""
    if not n:
        return np.zeros(0, np.uint16)
    per = batches[0].num_rows * batches[0].column(0).type.list_size
    out = []
    for b in range(start // per, (start + n - 1) // per + 1):
        out.append(batches[b].column(0).flatten().to_numpy()[max(0, start - b * per) : start + n - b * per])
    return out[0] if len(out) == 1 else np.concatenate(out)


def write_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 2048, parts: int | None = None, vocabulary: int = 50_257) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) into files in the shared folder; returns the manifest.

    Null texts count as empty: the end id alone. Null ids come first; rows of one id stand in
    order of their texts' hashes. No rows: an empty manifest.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{shared_dir(spark)}/strataform/sequences-{uuid.uuid4().hex}"
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, tok = TaskContext.get().partitionId(), None, None
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], dtype).tobytes()
        for keys, texts in chunks(batches):
            if out is None:
                tok, out = WordCache.of(tokenizer_path, dtype), SequenceFile(uri, length, dtype)
            out.add(keys, [x + end for x in tok.encode(texts)])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": pa.array([out.n_docs], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return cut(rows.mapInArrow(write, MANIFEST), "manifest")


def read_sequences(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start over all files, n_tokens, ids_crc32."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, index = open_sequences(path)
                for part in index.to_batches(20_000):
                    start, n = (part.column(i).to_numpy() for i in (1, 2))
                    crc = [zlib.crc32(ids_between(rows, s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + base), part.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: as many as there are partitions
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.alias("base"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "path").mapInArrow(load, RESULT)


def op7_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return read_sequences(write_sequences(docs, public_tokenizers.path("byte_bpe_50k.json")))
