"""Token ids in the Arrow file format, as fixed-size lists.

Documents are dealt by range on doc_id and sorted inside each range; every
range writes one Arrow IPC file of equal-length sequences,

    ids   fixed_size_list<uint16 or uint32>[length]
    mask  fixed_size_list<bool>[length]      (false on the padding of the last row)

and beside it an index file (doc_id, start, n_tokens) with starts counted in
tokens from the file's first one. The record batches are uncompressed, so a
reader maps the file and gets any sequence as a view, without copying; a
stretch of a document is a slice of at most a few such views. The tokens of a
document start where the previous document ended, through row boundaries.

The texts go through the tokenizer in parts cut before a space or line break that a
non-blank character follows. The tokenizer's splitting pattern always starts
a new piece there, so the concatenated ids equal those of the whole text. A slice
of texts is cut, its distinct parts are found and looked up among the parts met lately as Arrow
arrays; unknown ones are encoded together, and the ids of the slice are put in order by one
numpy gather.

Files get their name from the range number and appear only when complete
(written aside, then renamed), so a task repeated after a lost executor
replaces its file with equal content. One manifest row per file reaches the
driver, to add up where each file starts.

Defined results: a null or empty text is the end id alone; a null doc_id
comes first; rows sharing a doc_id follow each other in the order of their
texts' hashes and may lie in several files; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import giving_back, materialize, prepare, scratch, text_slices
from cohortflow.llm.warc import open_store, store_path

END_ID = 2
LENGTH = 2048
ROWS = 256                       # sequences in a record batch
CACHE = 1_000_000                # parts a worker keeps, about 30 bytes each
JOINED = 500                     # unknown parts that go to the tokenizer together
SLICE = 1 << 23                  # bytes of text worked on at a time
BLANKS = r"\s\x1c-\x1f\x85\xa0 ᠎ -‏ -  　﻿"
#: A space, or a line break, that may share its piece with a blank behind it.
LOOSE_SPACE = re.compile(rf" (?=[{BLANKS}]|\Z)")
LOOSE_BREAK = re.compile(rf"\n(?=[{BLANKS}])")
BLANK = re.compile(f"[{BLANKS}]")
SAFE_CUT = re.compile(rf" (?![{BLANKS}]|\Z)")
#: What stands for a space and a line break in a byte-level vocabulary: the first 33 bytes are not printable, and these
#: are shown by the characters from 256 on.
BREAKS = (chr(256 + ord(" ")), chr(256 + ord("\n")))


def loose(text: str) -> bool:
    """Whether some space or line break of ``text`` may share its piece with a blank beside it."""
    return bool(LOOSE_SPACE.search(text) or LOOSE_BREAK.search(text)
                or text.endswith("\n") and BLANK.search(text[-2:-1]))


class Parts:
    """Ids of the parts of texts, kept for the parts met lately.

    A part begins with a space, which it does not show, or with a line break, which it does.
    What is kept are an Arrow array of parts, the numbers of their ids and these ids one after the
    other, so that looking up, adding and ordering are array operations. Unknown parts go to
    the tokenizer together, as one text: every id whose token starts with a space or line
    break begins a part. Beyond ``CACHE`` parts, those of the last slice remain.
    """

    def __init__(self, tokenizer, code: str):
        self.tokenizer, self.kind = tokenizer, np.dtype(code)
        starts = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            starts[i] = token.startswith(BREAKS)
        self.starts = starts
        self.parts = pa.array([], pa.large_string())
        self.sizes, self.flat = np.empty(0, np.int32), np.empty(0, self.kind)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [p if p[0] == "\n" else " " + p for p in parts]
        ids = self._ids("".join(whole))
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) == len(parts):
            return np.diff(cuts, append=len(ids)).astype(np.int32), ids
        each = [self._ids(p) for p in whole]    # a vocabulary with spaces inside tokens: each by itself
        return np.array([len(x) for x in each], np.int32), np.concatenate(each)

    def known(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of distinct ``parts`` start in the third array, and how many they are."""
        found = pc.index_in(parts, value_set=self.parts)
        unknown = parts.filter(pc.is_null(found))
        new = [self._together(unknown.slice(at, JOINED).to_pylist()) for at in range(0, len(unknown), JOINED)]
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        place[place < 0] = len(self.parts) + np.arange(len(unknown))
        sizes = np.concatenate([self.sizes, *[n for n, _ in new]])
        flat = np.concatenate([self.flat, *[ids for _, ids in new]])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        starts, held = starts[place], sizes[place]
        if len(sizes) <= CACHE:
            self.parts, self.sizes, self.flat = pa.concat_arrays([self.parts, unknown]), sizes, flat
        else:
            self.parts, self.sizes, self.flat = parts, held, flat[_runs(starts, held)]
        return starts, held, flat

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any blanks, cut at safe spaces only; a part may hold anything."""
        parts = SAFE_CUT.split(text)
        return np.concatenate([self._ids(parts[0]), *[self._ids(" " + p) for p in parts[1:]]])

    def encode_all(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, each with ``end_id`` behind it, one after the other, and the texts' numbers of ids."""
        n = len(texts)
        if not n:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        odd = {i: self.encode(t) for i, t in enumerate(texts) if loose(t)}
        plain = pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        # a text's first part has no space before it; a text cut by hand stands there with all its ids
        heads, stops = bounds[:-1], bounds[1:]
        inner = np.ones(len(codes), bool)
        inner[heads] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[inner]] = True
        starts, sizes = np.zeros(len(used), np.int64), np.zeros(len(used), np.int32)
        starts[used], sizes[used], flat = self.known(coded.dictionary.filter(pa.array(used)))
        first = coded.dictionary.take(pa.array(codes[heads])).to_pylist()
        plain_heads = {h: np.array(e.ids, self.kind) for some in [list(dict.fromkeys(first))] for h, e in zip(
            some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))}
        lead = [odd[i] if i in odd else plain_heads[h] for i, h in enumerate(first)]
        lead.append(np.array([end_id], self.kind))
        lead_sizes = np.array([len(x) for x in lead], np.int32)
        starts = np.concatenate([starts, len(flat) + np.cumsum(lead_sizes) - lead_sizes])
        sizes = np.concatenate([sizes, lead_sizes])
        flat = np.concatenate([flat, *lead])
        codes = codes.copy()
        codes[heads] = len(used) + np.arange(n)
        order = np.insert(codes, stops, len(sizes) - 1)
        held = sizes[order]
        ends = np.cumsum(held, dtype=np.int64)
        return flat[_runs(starts[order], held)], np.diff(ends[stops + np.arange(n)], prepend=0)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the run of starts[1], and so on."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_LOADED: dict[str, Parts] = {}


def parts_of(path: str) -> Parts:
    """One tokenizer and cache per worker process and vocabulary."""
    if path not in _LOADED:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True         # their strings in a text are ordinary text
        _LOADED[path] = Parts(tokenizer, "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    return _LOADED[path]


# ------------------------------------------------------------------- writing

class SequenceFile:
    """Writer of one file of equal-length sequences and its document index."""

    def __init__(self, store: pafs.FileSystem, name: str, kind: np.dtype, length: int):
        self.store, self.name, self.length = store, name, length
        self.aside = f"{name}.{uuid.uuid4().hex}"
        self.kind, self.width = pa.from_numpy_dtype(kind), kind.itemsize
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = store.open_output_stream(self.aside)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.total = bytearray(), 0
        self.doc_ids, self.starts, self.sizes = [], [], []

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in order: their ids one after the other, and how many each has."""
        self.doc_ids += doc_ids
        self.starts += (self.total + np.cumsum(sizes) - sizes).tolist()
        self.sizes += sizes.tolist()
        self.total += len(ids)
        self.held += ids.tobytes()
        block = ROWS * self.length * self.width
        whole = len(self.held) // block * block
        for at in range(0, whole, block):
            self._write(bytes(self.held[at:at + block]), ROWS * self.length)
        del self.held[:whole]

    def _write(self, raw: bytes, real: int) -> None:
        rows = len(raw) // (self.length * self.width)
        flat = pa.Array.from_buffers(self.kind, rows * self.length, [None, pa.py_buffer(raw)])
        mask = np.zeros(rows * self.length, dtype=bool)
        mask[:real] = True
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(flat, self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            real = len(self.held) // self.width
            row = self.length * self.width
            self._write(bytes(self.held) + b"\0" * (-len(self.held) % row), real)
        self.writer.close()
        self.out.close()
        index = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "start": pa.array(self.starts, pa.int64()),
                          "n_tokens": pa.array(self.sizes, pa.int64())})
        with self.store.open_output_stream(f"{self.aside}.index") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        self.store.move(f"{self.aside}.index", f"{self.name}.index")
        self.store.move(self.aside, self.name)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH,
                 end_id: int = END_ID) -> DataFrame:
    """Write the files and return their manifest (part, path, n_docs, n_tokens), written once."""
    prepare(docs.sparkSession)
    folder = store_path(folder)
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, file, parts = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for cut in text_slices(batch, "text", SLICE):
                if file is None:
                    parts = parts_of(tokenizer)
                    store, base = open_store(folder)
                    store.create_dir(base, recursive=True)
                    file = SequenceFile(store, f"{base}/part-{part:06d}.arrow", parts.kind, length)
                ids, sizes = parts.encode_all([t or "" for t in cut.column("text").to_pylist()], end_id)
                file.add(cut.column("doc_id").to_pylist(), ids, sizes)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                ([part], [file.name], [len(file.sizes)], [file.total]), schema.types)], schema=schema)

    # by (id, hash of the text), so that the rows of one id are dealt to several files
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
            .repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text").drop("key"))
    return materialize(rows.mapInArrow(giving_back(write), "part long, path string, n_docs long, n_tokens long"),
                       "token-files")


# ------------------------------------------------------------------- reading

class TokenFile:
    """Random access to a file's sequences and documents; local files are mapped, not read."""

    def __init__(self, path: str, store: pafs.FileSystem | None = None):
        local = store is None or isinstance(store, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        source = pa.memory_map(f"{path}.index") if local else store.open_input_file(f"{path}.index")
        self.index = pa.ipc.open_file(source).read_all()
        self._at, self._batch = -1, None

    def _ids(self, number: int) -> np.ndarray:
        if number != self._at:
            self._at, self._batch = number, self.file.get_batch(number)
        return self._batch.column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of row ``i``."""
        ids = self._ids(i // ROWS)
        at = i % ROWS * self.length
        return ids[at:at + self.length], self._batch.column("mask")[i % ROWS].values

    def tokens(self, start: int, size: int) -> Iterator[np.ndarray]:
        """Views that hold tokens ``start`` to ``start + size``, in order."""
        block = ROWS * self.length
        while size:
            ids = self._ids(start // block)
            piece = ids[start % block:start % block + size]
            yield piece
            start, size = start + len(piece), size - len(piece)


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (over all files), n_tokens, ids_crc32."""
    spark = prepare(files.sparkSession)
    folder = store_path(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])
    total, starts = 0, []
    for r in files.orderBy("part").collect():              # one row per file
        starts.append((r["path"], total))
        total += r["n_tokens"]
    listed = spark.createDataFrame(starts, "path string, before long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                file = TokenFile(path, open_store(folder)[0])
                index = file.index
                crcs = []
                for start, size in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist()):
                    crc = 0
                    for piece in file.tokens(start, size):
                        crc = zlib.crc32(piece.astype("<u4"), crc)
                    crcs.append(crc)
                table = pa.table([index["doc_id"], pa.array(index["start"].to_numpy() + before), index["n_tokens"],
                                  pa.array(crcs, pa.int64())], schema=schema)
                yield from table.to_batches(max_chunksize=10_000)

    return listed.repartition(max(1, min(len(starts), 4096)), "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return them per document."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, length), folder)
