"""Token-ID files: one independent zstandard frame a document, a trailing seek table, checksums in both.

A file follows zstandard's public seekable format: frames with content checksums, then skippable frames. The last is
the seek table (compressed size, size, low 32 bits of XXH64 for each frame); the one before it is our index: JSON
meta and the documents' ids. A reader takes the footer, the table and only the frames it is asked for.

Texts are dealt once, by range of (doc_id, hash of the text), so that an id which a third of all rows share is spread over
many tasks; each task sorts its range, encodes, compresses and writes it. A file holds `ROWS_PER_FILE` documents and gets a
fresh name for each attempt; only attempts that succeed are listed in the manifest, so a lost executor costs a retry and
never a wrong file. Files are read back in as many tasks as there are files.

The encoder is the library's with its defaults: a special token's string in a text is that token. It takes an Arrow batch
at a time: cut on its bytes, distinct pieces looked up once, ids gathered by Arrow. Ids are stored in two
bytes where vocabulary and end id fit, else in four; a width that is too narrow is refused.

Defined results: null text counts as empty (its ids are the end id alone); null doc_ids come first; repeated doc_ids keep
all their rows, in order of a hash of their texts; very long texts are one frame each; columns other than doc_id and text are
not read, whatever their names; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BATCH_ROWS, bounded_batches, fresh_path, materialize, table, tokenizer_file, worker_cache
from graphloom.llm.pieces import RUN, UNITS, UnitCache

END_ID = 0
ROWS_PER_FILE = 8192
#: Most tasks of the one shuffle; beyond, a task writes several files of ROWS_PER_FILE documents.
MOST_TASKS = 20_000
LEVEL = 3
#: Text that is cut into pieces at once; a longer text is cut alone, a piece at a time.
CHUNK_BYTES = 1 << 24
#: ASCII characters that are no letters, digits or white space: together one pre-token where they follow letters.
MARKS = string.punctuation
#: What a byte is: part of no other kind, the space, other ASCII white space, a mark, an ASCII letter or digit, the first of a character that may be white space.
OTHER, SPACE, OTHER_SPACE, MARK, WORD, WIDE = range(6)
KIND = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((SPACE, b" "), (OTHER_SPACE, b"\t\n\x0b\x0c\r"), (MARK, MARKS.encode()), (WORD, string.ascii_letters.encode() + string.digits.encode()), (WIDE, b"\xc2\xe1\xe2\xe3")):
    KIND[list(_bytes)] = _kind
#: Unicode's other white space in UTF-8.
WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

# Of the seekable format: fixed values.
SKIPPABLE = 0x184D2A50
SEEK_SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class LibraryEncoder:
    """Texts to ids (bytes, `width` an id) as the tokenizers library gives them, pieces cached.

    A batch is cut into pieces on its bytes, where the public pattern always cuts: by white space (see pieces), before a
    mark that follows an ASCII letter or digit, and after white space that no token takes along. Each distinct piece is
    looked up once a batch. A piece that is one run of letters is one pre-token, so the library's model alone encodes it;
    marks that follow letters are a pre-token of their own. Every other piece, and every text that holds the string of an
    added token, takes the library's whole way.
    """

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters, self.width = Tokenizer.from_file(path), _byte_letters(), width
        self.model, self.space = self.tokenizer.model, self.letters[32]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = UnitCache(self.piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def piece(self, text: str) -> bytes:
        core = text[1:] if text[0] == " " else text
        if core.isalpha():
            if core.isascii():
                spelled = text if core is text else self.space + core
            else:
                spelled = text.encode().decode("latin-1").translate(self.letters)
            ids = [x.id for x in self.model.tokenize(spelled)]
            return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)
        letters = text.rstrip(MARKS)
        if len(letters) < len(text) and (letters[1:] if letters[:1] == " " else letters).isalpha():
            return self.pieces[letters] + self.pieces[text[len(letters) :]]
        return self.whole(text)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.whole(text)
        out = bytearray()
        for m in UNITS.finditer(text):
            out += self.pieces[m.group()]
        return bytes(out)

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a string column without nulls, in order; some CHUNK_BYTES of text at a time."""
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        k = 0
        while k < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[k : k + BATCH_ROWS]), CHUNK_BYTES, "right")))
            if sizes[k] > CHUNK_BYTES:
                yield self(texts[k].as_py())
            else:
                yield from self._chunk(texts[k : k + n].cast(pa.binary()))
            k += n

    def _chunk(self, texts: pa.Array) -> Iterator[bytes]:
        alone = self._alone(texts)
        if alone:
            plain = np.ones(len(texts), bool)
            plain[list(alone)] = False
            rest = self._plain(texts.filter(pa.array(plain)))
            yield from (self(texts[k].as_py().decode()) if k in alone else next(rest) for k in range(len(texts)))
        else:
            yield from self._plain(texts)

    def _alone(self, texts: pa.Array) -> set[int]:
        """Texts that bytes can't cut: those with an added token's string, or with other than ASCII white space in a run."""
        data, offsets = _bytes_of(texts)
        raw = data.tobytes()
        found = [m.start() for t in self.added if t.encode() in raw for m in re.finditer(re.escape(t.encode()), raw)]
        alone = set((np.searchsorted(offsets, found, "right") - 1).tolist())
        if (KIND[data] == WIDE).any():
            wide = np.searchsorted(offsets, [m.start() for m in WIDE_SPACE.finditer(raw)], "right") - 1
            alone |= {k for k in set(wide.tolist()) - alone if RUN.search(texts[k].as_py().decode())}
        return alone

    def _plain(self, texts: pa.Array) -> Iterator[bytes]:
        data, offsets = _bytes_of(texts)
        kind = KIND[data]
        white, first = (kind == SPACE) | (kind == OTHER_SPACE), np.zeros(len(data) + 1, bool)
        first[offsets] = True
        # A run of white space is cut off before its first character and, unless the text ends with it, before its last.
        last = ~(np.append(white[1:], True) | first[1:])
        starts = first[:-1] | white & (last | ~np.append(False, white[:-1]))
        starts[1:] |= (kind[1:] == MARK) & (kind[:-1] == WORD) | ~white[1:] & (kind[:-1] == OTHER_SPACE)
        at = np.flatnonzero(starts)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype("<i4")), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(map(self.pieces.__getitem__, pieces.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False)), pa.binary()).take(pieces.indices)
        out, ends = _bytes_of(ids)
        bounds, out = ends[np.searchsorted(at, offsets)].tolist(), memoryview(out)
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield bytes(out[a:b])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each value starts, with the end."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "<i4", len(column) + 1, 4 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def encoder(path: str, width: int) -> LibraryEncoder:
    """One a worker process."""
    return worker_cache("token-files", (path, width), lambda: LibraryEncoder(path, width))


def width_for(tokenizer: str, end_id: int, width: int | None = None) -> int:
    """Bytes an id: 2 where every id of the vocabulary and the end id fit, else 4; a given width that is too narrow is refused."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    if end_id < 0 or width not in (None, 2, 4) or most >= 1 << 8 * (width or 4):
        raise ValueError(f"ids up to {most} and end id {end_id} don't fit {width} bytes")
    return width or (2 if most < 1 << 16 else 4)


def compressor(level: int = LEVEL) -> zstandard.ZstdCompressor:
    """Makes one frame of each text it is given, with checksum and size."""
    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Writer:
    """Writes one file through any file system that pyarrow knows."""

    def __init__(self, uri: str, width: int):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.width, self.entries, self.ids = width, [], []

    def add(self, doc_id: int | None, compressed: bytes, size: int, checksum: int) -> None:
        self.out.write(compressed)
        self.entries.append((len(compressed), size, checksum))
        self.ids.append(doc_id)

    def close(self) -> None:
        meta = json.dumps({"width": self.width, "documents": len(self.ids), "null_ids": sum(i is None for i in self.ids)}).encode()
        self.out.write(skippable(SKIPPABLE, struct.pack("<I", len(meta)) + meta + np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()))
        table = np.array(self.entries, "<u4").reshape(-1, 3).tobytes()
        self.out.write(skippable(SEEK_SKIPPABLE, table + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC)))
        self.out.close()


class Reader:
    """Random access to a file's documents; a frame is decompressed only when it is asked for."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        length = 8 + 12 * count + 9
        raw = self.file.read_at(length, size - length)
        if struct.unpack_from("<II", raw) != (SEEK_SKIPPABLE, length - 8):
            raise ValueError(f"{uri}: bad seek table")
        self.table = np.frombuffer(raw, "<u4", 3 * count, 8).reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        at = int(self.offsets[-1])
        index = self.file.read_at(size - length - at, at)
        n = struct.unpack_from("<I", index, 8)[0]
        self.meta = json.loads(index[12 : 12 + n])
        ids = np.frombuffer(index, "<i8", count, 12 + n).tolist()
        self.ids = [None] * self.meta["null_ids"] + ids[self.meta["null_ids"] :]

    def __len__(self) -> int:
        return len(self.table)

    def document(self, k: int) -> np.ndarray:
        """The k-th document's ids, after both checksums."""
        raw = self.zstd.decompress(self.file.read_at(int(self.table[k, 0]), int(self.offsets[k])), max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"document {k}: checksum differs")
        return np.frombuffer(raw, f"<u{self.meta['width']}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id (the file is in ascending order)."""
        first, known = self.meta["null_ids"], np.array(self.ids[self.meta["null_ids"] :], np.int64)
        return list(range(first + int(np.searchsorted(known, doc_id)), first + int(np.searchsorted(known, doc_id, "right"))))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int | None = None, rows_per_file: int = ROWS_PER_FILE, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Writes the files under path and returns the manifest: task, part (both in order), uri, documents, tokens; a row a file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    width, path = width_for(tokenizer, end_id, width), re.sub(r"^file:/(?!/)", "file:///", path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    tasks = max(1, min(most_tasks, -(-docs.count() // rows_per_file)))
    order = [F.asc_nulls_first("doc_id"), "_h", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, compress = encoder(tokenizer, width).batch, end_id.to_bytes(width, "little"), compressor().compress
        task, part, out, uri, size = TaskContext.get().partitionId(), 0, None, "", 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(out.ids)], pa.int64()), pa.array([size // width], pa.int64())], ["task", "part", "uri", "documents", "tokens"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                if out is None:
                    uri = f"{path}/part-{task:06d}-{part:04d}-{uuid.uuid4().hex[:12]}.ids.zst"
                    out, size = Writer(uri, width), 0
                raw = ids + end
                out.add(doc_id, compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                size += len(raw)
                if len(out.ids) >= rows_per_file:
                    yield listed()
                    out, part = None, part + 1
        if out:
            yield listed()

    dealt = docs.repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "task int, part int, uri string, documents long, tokens long"), "token-manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, a task a file; only the manifest's sums cross files."""
    order = Window.orderBy("task", "part")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("uri", before.alias("start"), F.row_number().over(order).alias("file"))
    n = max(1, min(MOST_TASKS, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = Reader(uri), []
                for k, doc_id in enumerate(reader.ids):
                    ids = reader.document(k)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartitionByRange(n, "file").select("uri", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_digests(write_files(docs, fresh_path(spark, "token-files"), tokenizer_file("byte_bpe_50k.json")))
