"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum for every frame.

A file is a valid zstandard stream: frames of ids (little-endian unsigned 32-bit), then a skippable frame with the
document table (frame and token count of every document), then a skippable frame with the seek table (compressed and
raw size and XXH64 checksum of each frame). A reader reads the end of the file, then only the frames it wants.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEPT, map_arrow, shared_dir

END_ID = 0
FRAME_BYTES = 1 << 20
LEVEL = 3
SKIPPABLE, MAGIC = 0x184D2A5D, b"GLZF0001"
#: Entries of a worker's cache of encoded chunks; only speed depends on it.
CACHE = 1_200_000
#: Characters of texts that are encoded together.
GROUP = 4_000_000


def byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class ChunkEncoder:
    """Ids of whole texts as the tokenizers library gives them, with a cache of the chunks between spaces and line breaks.

    The byte-level pattern never looks back, and where white space stands between two other characters it is one
    space, which goes with what follows, or one line break, which is a token of its own. So such a text is the sum of
    its chunks, each with the space or line break before it. Texts with other white space, or with special tokens, go
    to the library whole.
    """

    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]")
    LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
    #: White space that isn't between two other characters, or isn't one space or line break.
    UNSAFE = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.bytes = dict(enumerate(byte_chars()))
        self.model = self.lib.model.tokenize
        self.mark = {c: self._whole(c) for c in ".,"}
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str, before: str = "Ġ") -> bytes:
        """Of letters alone, after a space or a line break: one word of the pattern, so the library's model has it at once."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model(before + mapped)]).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Chunks that begin with a line break stand after one, all others after a space."""
        known, ask = self.known, []
        letters, plain = self.LETTERS.fullmatch, self.PLAIN.fullmatch
        for c in chunks:
            if c.isascii() and c.isalpha() or letters(c):
                known[c] = self._letters(c)
            elif plain(c):
                stem = c[:-1]
                got = known.get(stem)
                known[c] = (self._letters(stem) if got is None else got) + self.mark[c[-1]]
            elif c[:1] == "\n" and letters(c, 1):
                known[c] = self.line + self._letters(c[1:], "")
            elif c[:1] == "\n" and plain(c, 1):
                known[c] = self.line + self._letters(c[1:-1], "") + self.mark[c[-1]]
            else:
                ask.append(c)
        for c, e in zip(ask, self.lib.encode_batch_fast([c if c[:1] == "\n" else " " + c for c in ask], add_special_tokens=False)):
            known[c] = array("I", e.ids).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > GROUP or i == len(texts) - 1:
                self._encode(texts, out, at, i + 1)
                at, size = i + 1, 0
        return out

    def _encode(self, texts, out, start, end) -> None:
        """Each distinct chunk of these texts is looked up once; Arrow cuts the texts and puts the ids together."""
        rows, cut_, odd = [], [], (*self.special, *self.UNSAFE)
        for i in range(start, end):
            t = texts[i]
            if not t:
                continue
            if any([s in t for s in odd]) or t[0] == " " or t[-1] == " ":
                out[i] = self._whole(t)
            else:  # the line break put before the text goes again below
                rows.append(i)
                cut_.append(f"\n{t}".replace("\n", " \n")[1:])
        if not rows:
            return
        lists = pc.split_pattern(pa.array(cut_, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known.clear()
        get = self.known.get
        ids = list(map(get, chunks))
        holes = [j for j, x in enumerate(ids) if x is None]
        self._learn([chunks[j] for j in holes])
        for j in holes:
            ids[j] = get(chunks[j])
        values = pa.array(ids, pa.large_binary()).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, values), pa.scalar(b"", pa.large_binary()))
        for i, x in zip(rows, joined.to_pylist()):
            out[i] = x[len(self.line) :]


@cache
def encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


KEPT["encoder"] = encoder.cache_clear


def open_fs(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


class FrameWriter:
    """Collects documents' ids and gives the bytes of frames; ``finish`` gives the two tables at the end."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.held, self.size = frame_bytes, [], 0
        self.frames, self.docs = [], []

    def add(self, doc_id, ids: bytes) -> bytes:
        self.held.append(ids)
        self.size += len(ids)
        self.docs.append((doc_id, len(self.frames), len(ids) // 4))
        return self.flush() if self.size >= self.frame_bytes else b""

    def flush(self) -> bytes:
        if not self.held:
            return b""
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw)))
        self.held, self.size = [], 0
        return packed

    def finish(self) -> bytes:
        table = b"".join(struct.pack("<BqIQ", d is not None, d or 0, f, n) for d, f, n in self.docs)
        docs = zstandard.ZstdCompressor(level=LEVEL).compress(table)
        seek = b"".join(struct.pack("<QQQ", *f) for f in self.frames)
        tail = struct.pack("<IIQQ", len(self.frames), len(docs), xxhash.xxh64_intdigest(docs + seek), len(self.docs)) + MAGIC
        return struct.pack("<II", SKIPPABLE, len(docs)) + docs + struct.pack("<II", SKIPPABLE, len(seek) + len(tail)) + seek + tail


class FrameFile:
    """Reads a file of frames: the tables at once, each frame when a document in it is asked for."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(32, end - 32)
        n, n_docs, check, self.n_docs = struct.unpack("<IIQQ", tail[:24])
        if tail[24:] != MAGIC:
            raise ValueError(f"{uri} is no file of token frames")
        seek = self.file.read_at(24 * n, end - 32 - 24 * n)
        docs = self.file.read_at(n_docs, end - 32 - 24 * n - 8 - n_docs)
        if xxhash.xxh64_intdigest(docs + seek) != check:
            raise ValueError(f"{uri}: the tables at its end are damaged")
        self.frames = list(struct.iter_unpack("<QQQ", seek))
        table = zstandard.ZstdDecompressor().decompressobj().decompress(docs)
        self.docs = [(d if has else None, f, k) for has, d, f, k in struct.iter_unpack("<BqIQ", table)]
        self.at = np.concatenate(([0], np.cumsum([f[0] for f in self.frames]))).astype(int).tolist()
        self.begin = []
        last, pos = -1, 0
        for _, f, k in self.docs:
            pos = 0 if f != last else pos
            self.begin.append(pos)
            last, pos = f, pos + k
        self.held: tuple = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            packed, size, check = self.frames[i]
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.at[i]), max_output_size=size)
            if xxhash.xxh64_intdigest(raw) != check:
                raise ValueError(f"frame {i} is damaged")
            self.held = (i, raw)
        return self.held[1]

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document of the file."""
        _, f, n = self.docs[k]
        return self.frame(f)[4 * self.begin[k] : 4 * (self.begin[k] + n)]


def _writer(tokenizer: str, out: str):
    def run(batches):
        enc, w = encoder(tokenizer), FrameWriter()
        part = TaskContext.get().partitionId()
        fs, base = open_fs(out)
        fs.create_dir(base, recursive=True)
        temp, name = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"{base}/{part:06d}.glzf"
        end = np.array([END_ID], "<u4").tobytes()
        total = 0
        with fs.open_output_stream(temp) as f:
            for b in batches:
                texts = ["" if x is None else x for x in b.column("text").to_pylist()]
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode_many(texts)):
                    ids += end
                    total += len(ids) // 4
                    if packed := w.add(d, ids):
                        f.write(packed)
            f.write(w.flush())
            f.write(w.finish())
        fs.move(temp, name)  # a task that runs again puts the same bytes in the same place
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(w.docs)], pa.int64()), pa.array([total], pa.int64())], names=["part", "docs", "tokens"])

    return run


def write_frames(docs: DataFrame, tokenizer: str, out: str, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encodes all rows in ascending order of doc_id (null first, then by hash of the text) to files under ``out``.

    One file a range of ids; gives (file, ids before it, documents) in order. Only these rows reach the driver.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows alike may be very many: the tie lets them lie in several ranges
    dealt = slim.repartitionByRange(n, "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "text")
    rows = sorted(map_arrow(dealt, _writer(tokenizer, out), "part int, docs long, tokens long", "encoder").collect())
    files, start = [], 0
    for part, k, tokens in rows:
        if k:
            files.append((f"{out}/{part:06d}.glzf", start, k))
        start += tokens
    return files


def _reader(batches):
    for b in batches:
        for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f = FrameFile(uri)
            rows: list[tuple] = []
            for k, (d, _, n) in enumerate(f.docs):
                rows.append((d, start, n, zlib.crc32(f.ids(k))))
                start += n
                if len(rows) == 10_000 or k == len(f.docs) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    rows = []


def read_frames(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    named = spark.createDataFrame([(p, s) for p, s, _ in files], "uri string, start long").repartition(len(files))
    return map_arrow(named, _reader, schema)


def encoded_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to files of frames in the shared folder and reads them back.

    Null and empty texts give the end id alone. Rows of equal doc_id follow one another by the hash of their text;
    repeated rows each have their place. No documents give no files and no rows.
    """
    out = f"{shared_dir(docs.sparkSession)}/frames-{uuid.uuid4().hex}"
    return read_frames(docs.sparkSession, write_frames(docs, tokenizer, out, doc_id, text))
