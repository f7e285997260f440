"""Token ids of a corpus in binary files of bit planes.

A file holds ids in chunks of a fixed number. A chunk is transposed into bit planes, the lowest bit first; each plane
is compressed by zstandard. Layout, little-endian:

    "BPL1"
    chunk:  u32 ids, u8 planes, u32 compressed bytes of each plane, the planes
    footer: zstandard of: u32 chunks, (u64 offset, u32 ids) of each, u64 documents, u8 of each id (1: null),
            i64 document ids, u64 tokens of each
    u64 offset of the footer, "BPL1"
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import scratch, stored, text_of

MAGIC = b"BPL1"
PUNCTUATION = string.punctuation

#: Letters that have one lower case and no other form: those of ASCII and Latin-1.
LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())

CHUNK_IDS = 65536
FILE_IDS = 1 << 22
END_ID = 1

#: Pieces of another kind and plain words whose ids a worker remembers, and the longest of them.
PIECES = 100_000
WORDS = 400_000
REMEMBERED_CHARS = 40

#: Files that a task reads back.
FILES_READ = 8

#: Texts encoded together: as many as have so many characters. Words learned in one string.
GROUP_CHARS = 2_000_000
LEARNED = 200

# What a tokenizer file says that drops white space, lower-cases, and splits letters from other signs.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

MANIFEST = "part int, seq int, file string, first_doc_id bigint, n_docs bigint, n_ids bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it: local folders, and the stores that Arrow reaches."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _plain(piece: str) -> tuple[str, str] | None:
    """A piece as (letters in lower case, ASCII punctuation), where its ids are those of the two in turn: a run of letters
    ends before punctuation, and lower-casing is what the tokenizer does first."""
    word = piece.rstrip(PUNCTUATION)
    if word == word.lower() and word.isalpha() and unicodedata.is_normalized("NFC", word):
        return word, piece[len(word) :]
    return None


def splits_at_spaces(path: str) -> str | None:
    """The mark that ends a word's last id, if the tokenizer's file says that a text's ids are those of its pieces between spaces,
    whatever their case, and that letters and other signs never share an id; else nothing."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    cut = told.get("pre_tokenizer") or {}
    first, *rest = cut.get("pretokenizers") or [{}]
    clean = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers") or []]
    as_known = (
        clean == _NORMALIZERS
        and (first.get("type"), first.get("pattern"), first.get("invert"), first.get("behavior")) == ("Split", {"Regex": _SPLIT}, True, "Removed")
        and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        and not told.get("post_processor")
    )
    return told["model"].get("end_of_word_suffix") or None if as_known else None


class Table:
    """Strings and their ids: Arrow and numpy take few bytes for each, and find those of a group at once."""

    def __init__(self):
        self.names, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, "i8")
        self.long = False

    def find(self, names: pa.Array, most: int) -> tuple[np.ndarray, pa.Array]:
        """Rows of different strings, and those that are new, whose rows begin where the table ends now. A table that would hold
        more than ``most`` is begun anew."""
        at = pc.index_in(names, value_set=self.names)
        if len(self.names) + at.null_count > most:
            self.__init__()
            at = pa.nulls(len(names), pa.int32())
        rows = at.fill_null(-1).to_numpy().astype("i8")
        rows[rows < 0] = len(self.names) + np.arange(at.null_count)
        return rows, names.filter(at.is_null())

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.long = pc.any(pc.greater(pc.utf8_length(names), REMEMBERED_CHARS)).as_py()

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _strung(self.ids, self.sizes, rows)[0], self.sizes[rows]

    def drop_long(self) -> None:
        if self.long:
            short = pc.less_equal(pc.utf8_length(self.names), REMEMBERED_CHARS)
            self.ids, self.sizes = self.of(np.flatnonzero(short.to_numpy(zero_copy_only=False)))
            self.names = self.names.filter(short)


class Encoder:
    """Ids of texts, equal to encoding each whole text.

    Where the tokenizer's file says that it drops white space before it looks for merges, no id spans a space or line break: a
    text's ids are those of its pieces in turn. Pieces that differ by case or punctuation share a word, so a worker remembers the
    ids of words, and of pieces of another kind, in tables of bounded size, and looks up each different piece of a group of texts
    once. All ids come from the tokenizer; many words are given to it at once. With any other file, whole texts are.
    """

    def __init__(self, path: str):
        # A task has one core: threads of the library's own would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = splits_at_spaces(path)
        self.pieces, self.words = Table(), Table()
        if self.mark:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for t, k in vocabulary.items() if t.endswith(self.mark)]] = True

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has: many in a string, cut where an id ends a word."""
        out = [_behind([])]
        groups = [words[k : k + LEARNED] for k in range(0, len(words), LEARNED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            out.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(group) else _behind(self._each(group)))
        ids, sizes = zip(*out, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words and punctuation, and how many each has, from the table or learned for it."""
        rows, new = self.words.find(words, WORDS)
        mark = pc.equal(pc.ascii_ltrim(new, characters=PUNCTUATION), "")
        learned = self._learn(new.filter(pc.invert(mark)).to_pylist()), _behind(self._each(new.filter(mark).to_pylist()))
        ids, sizes = map(np.concatenate, zip(*learned, strict=True))
        # Learned are the words, then the punctuation: back into the order of both.
        order = np.argsort(np.argsort(mark.to_numpy(zero_copy_only=False), kind="stable"))
        self.words.add(new, _strung(ids, sizes, order)[0], sizes[order])
        found = self.words.of(rows)
        self.words.drop_long()
        return found

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.mark:
            return self._each(texts.to_pylist())
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        pieces, offsets = coded.dictionary, split.offsets.to_numpy()
        # Most pieces are Latin letters and punctuation: told without Python, as ``_plain`` tells the others.
        behind = pc.utf8_ltrim(pieces, characters=LETTERS)
        plain = pc.and_(pc.equal(pc.ascii_ltrim(behind, characters=PUNCTUATION), ""), pc.invert(pc.match_substring(pieces, "<|")))
        letters = pc.utf8_lower(pc.ascii_rtrim(pieces.filter(plain), characters=PUNCTUATION))
        at, new = self.pieces.find(pieces.filter(pc.invert(plain)), PIECES)
        parts = {p: _plain(p) for p in new.to_pylist()}
        more = pa.array([w for x in parts.values() if x for w in x], pa.large_string())
        words = pa.concat_arrays([letters, behind.filter(plain), more]).dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        rows, n = words.indices.to_numpy(), len(letters)
        # A new piece of another kind has the ids of its two parts, or its own.
        cut = _cut(*_strung(ids, sizes, rows[2 * n :]))
        pairs = iter([np.concatenate(x) for x in zip(cut[::2], cut[1::2], strict=True)])
        odd = iter(self._each([p for p, x in parts.items() if x is None]))
        self.pieces.add(new, *_behind([next(pairs if x else odd) for x in parts.values()]))
        others, counts = self.pieces.of(at)
        self.pieces.drop_long()
        # A piece's ids are those of one or two parts, a text's those of its pieces; the last part is empty.
        sizes = np.concatenate([sizes, counts, [0]])
        told, two = plain.to_numpy(zero_copy_only=False), np.full((len(pieces), 2), len(sizes) - 1)
        two[told, 0], two[told, 1] = rows[:n], rows[n : 2 * n]
        two[~told, 0] = np.arange(len(at)) + len(words.dictionary)
        ids, ends = _strung(np.concatenate([ids, others]), sizes, two.ravel())
        ids, ends = _strung(ids, np.diff(ends[::2]), coded.indices.to_numpy())
        return _cut(ids, ends[offsets - offsets[0]])

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        end = np.array([END_ID], "<u4")
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.utf8_length(texts).to_numpy().astype("i8"))
        at = 0
        while at < len(texts):
            size = GROUP_CHARS + (ends[at - 1] if at else 0)
            begin, at = at, min(len(texts), int(np.searchsorted(ends, size)) + 1)
            for ids in self._group(texts[begin:at]):
                yield np.concatenate([ids, end])


def _behind(stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ids behind each other, and the size of each."""
    return np.concatenate([np.zeros(0, "<u4"), *stretches]), np.fromiter(map(len, stretches), "i8", len(stretches))


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _strung(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``ids``, which lie behind each other in these sizes, in the order of ``rows``; and where each begins there, and
    the last ends."""
    n = sizes[rows]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((np.cumsum(sizes) - sizes)[rows] - ends[:-1], n)
    at += np.arange(len(at))
    return ids[at], ends


#: Encoders of this process, by the tokenizer's file: a worker that runs several tasks keeps what it remembers.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of ids, lowest bit first, none above the highest bit in use."""
    width = int(ids.max(initial=0)).bit_length()
    bits = ids.astype("<u2" if width <= 16 else "<u4")
    return [np.packbits(((bits >> k) & 1).astype(bool), bitorder="little").tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, "<u2" if len(planes) <= 16 else "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, "u1"), count=n, bitorder="little").astype(ids.dtype) << ids.dtype.type(k)
    return ids.astype("<u4")


class FileWriter:
    """One file, written in chunks as documents come."""

    def __init__(self, out, level: int):
        self.out, self.level = out, level
        self.rest: list[np.ndarray] = []
        self.held = self.at = self.n_ids = 0
        self.chunks: list[tuple[int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= CHUNK_IDS:
            self._flush(CHUNK_IDS)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        cut = 0
        while len(ids) - cut >= max(least, 1):
            chunk = ids[cut : cut + CHUNK_IDS]
            planes = [zstandard.compress(p, self.level) for p in to_planes(chunk)]
            self.chunks.append((self.at, len(chunk)))
            self._put(struct.pack(f"<IB{len(planes)}I", len(chunk), len(planes), *map(len, planes)))
            self._put(b"".join(planes))
            cut += len(chunk)
        self.rest, self.held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(1)
        foot = [struct.pack("<I", len(self.chunks)), *(struct.pack("<QI", *c) for c in self.chunks), struct.pack("<Q", len(self.docs))]
        foot.append(np.array([d is None for d, _ in self.docs], "u1").tobytes())
        foot.append(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        foot.append(np.array([n for _, n in self.docs], "<u8").tobytes())
        start = self.at
        self._put(zstandard.compress(b"".join(foot), self.level))
        self._put(struct.pack("<Q", start) + MAGIC)


class FileReader:
    """Random access to the chunks of a file, and its documents in order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        start, magic = struct.unpack("<Q4s", self._read(size - 12, 12))
        if magic != MAGIC:
            raise ValueError("not a file of bit planes, or cut short")
        foot = zstandard.decompress(self._read(start, size - 12 - start))
        (n,) = struct.unpack_from("<I", foot)
        self.chunks = [struct.unpack_from("<QI", foot, 4 + 12 * k) for k in range(n)]
        at = 4 + 12 * n
        (m,) = struct.unpack_from("<Q", foot, at)
        null = np.frombuffer(foot, "u1", m, at + 8)
        ids = np.frombuffer(foot, "<i8", m, at + 8 + m)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids, strict=True)]
        self.lengths = np.frombuffer(foot, "<u8", m, at + 8 + 9 * m).astype("i8")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n = self.chunks[k]
        _, width = struct.unpack("<IB", self._read(at, 5))
        sizes = struct.unpack(f"<{width}I", self._read(at + 5, 4 * width))
        data, planes = self._read(at + 5 + 4 * width, sum(sizes)), []
        for size in sizes:
            planes.append(zstandard.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, tokens, crc32 of the ids), holding one chunk at a time."""
        k, left = 0, np.zeros(0, "<u4")
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            crc, need = 0, length
            while need:
                if not len(left):
                    left, k = self.chunk(k), k + 1
                crc = zlib.crc32(left[:need].tobytes(), crc)
                taken = min(need, len(left))
                left, need = left[taken:], need - taken
            yield doc_id, length, crc


def write_planes(docs: DataFrame, tokenizer: str, path: str, level: int = 3) -> DataFrame:
    """Encode the texts of ``docs`` (doc_id, text, any others) into files below ``path``; returns the manifest, a row per file.

    Documents are dealt by ranges of ``doc_id`` and sorted within them, so files follow each other in ascending ids. A
    task streams its documents through a chunk at a time. A file's name holds the attempt that wrote it and the manifest
    names files of successful attempts only, so tasks that are lost or run twice leave at most unused files.

    Null texts are empty: the end id alone. Null ids come first. Equal ids keep an order by text. A very long text is
    one document over many chunks. An empty table writes no file and gives no rows. Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, folder = open_fs(path)
        store.create_dir(folder, recursive=True)
        encode = encoder(tokenizer)
        rows: list[dict] = []
        writer = out = None

        def close() -> None:
            writer.close()
            out.close()
            rows[-1] |= {"n_docs": len(writer.docs), "n_ids": writer.n_ids}

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                if writer is None:
                    name = f"part-{part:06d}-{len(rows):05d}-{attempt}.bpl"
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = FileWriter(out, level)
                    rows.append({"part": part, "seq": len(rows), "file": name, "first_doc_id": doc_id})
                writer.add(doc_id, ids)
                if writer.n_ids >= FILE_IDS:
                    close()
                    writer = None
        if writer is not None:
            close()
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["part", "seq", "file", "first_doc_id", "n_docs", "n_ids"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``start``: ids in all files before. Files are summed within their part, then one row per part over all."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("ids").over(over), F.lit(0)).alias("_part"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = manifest.withColumn("_own", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return own.join(before, "part").withColumn("start", F.col("_part") + F.col("_own")).drop("_part", "_own")


def read_planes(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(path)
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{name}") as source:
                    rows = []
                    for doc_id, n, crc in FileReader(source).documents():
                        rows.append((doc_id, start, n, crc))
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=kinds)

    files = with_starts(manifest).select("file", "start")
    # The number of files is given, since a few short rows would else be put together in one task.
    return files.repartition(-(-max(1, manifest.count()) // FILES_READ), "file").mapInArrow(read, DOCUMENTS)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files and read them back, one row per document."""
    path = path or scratch(spark, "planes")
    return read_planes(write_planes(docs, tokenizer, path), path)
