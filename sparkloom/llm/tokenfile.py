"""Token ids in a compact binary file: patched frame-of-reference blocks.

File format, all integers little-endian:

    header   b"PFR1", u32 block length B (ids a block), u64 first id's position among the ids of all files
    blocks   each: u32 minimum, u8 width w, u8 0, u16 number of exceptions e, then the B (last block: fewer) differences to the minimum, their low w
             bits packed from the lowest bit up, padded to a byte, then e u16 places and e u32 high parts (difference >> w)
    documents for each document: i64 id, u64 position of its first id among the ids of all files, u32 number of ids, u8 1 if its id is null
    index    u64 start of each block in the file, u32 documents, u32 blocks, u64 ids, u64 start of the documents, u64 start of the index, b"1RFP"

The width is the least that holds a stated share of a block's differences; the rest are exceptions. So a few large ids don't widen a block.
A reader seeks from the index to the block that holds any id.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import tidy, written, Cache
from .ragged import gather, offsets, slices, strings

BLOCK = 1024
SHARE = 0.9
MAGIC, CIGAM = b"PFR1", b"1RFP"
#: Letters, then marks: the pre-tokenizer parts them.
MARKED = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[.,;:!?]*)$"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ɏ]+$"
DOCUMENT = np.dtype([("doc", "<i8"), ("start", "<u8"), ("n", "<u4"), ("null", "u1")])
TAIL = struct.Struct("<IIQQQ4s")


def pack_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block of 1 to 65,535 ids below 2**32."""
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    place = int(np.ceil(share * len(rest))) - 1
    width = int(np.partition(rest, place)[place]).bit_length()
    high = (rest >> np.uint32(width)) if width < 32 else np.zeros_like(rest)
    places = np.flatnonzero(high)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return b"".join([struct.pack("<IBBH", least, width, 0, len(places)), np.packbits(bits.ravel(), bitorder="little").tobytes(), places.astype("<u2").tobytes(), high[places].astype("<u4").tobytes()])


def unpack_block(data: bytes, n: int) -> np.ndarray:
    """The n ids of a block that starts at data's first byte."""
    least, width, _, exceptions = struct.unpack_from("<IBBH", data)
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, 8), count=n * width, bitorder="little").reshape(n, width)
    out = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    places = np.frombuffer(data, "<u2", exceptions, 8 + size)
    out[places] |= np.frombuffer(data, "<u4", exceptions, 8 + size + 2 * exceptions).astype(np.uint32) << np.uint32(width)
    return out + np.uint32(least)


def pack_file(docs: Iterable[tuple[int | None, np.ndarray]], first: int = 0, block: int = BLOCK) -> bytes:
    """A file of documents (id, ids), in their order; first: the ids in the files before it."""
    docs = list(docs)
    flat = np.concatenate([x for _, x in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    return _file(pa.array([d for d, _ in docs], pa.int64()), np.array([len(x) for _, x in docs], np.int64), flat, first, block)


def _file(docs: pa.Array, n: np.ndarray, ids: np.ndarray, first: int, block: int) -> bytes:
    table = np.zeros(len(docs), DOCUMENT)
    table["doc"], table["null"] = pc.fill_null(docs, 0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False)
    table["n"], table["start"] = n, first + offsets(n)[:-1]
    blocks = [pack_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    head = MAGIC + struct.pack("<IQ", block, first)
    starts = len(head) + offsets(np.array([len(x) for x in blocks], np.int64))
    at = int(starts[-1])
    return b"".join([head, *blocks, table.tobytes(), starts[:-1].astype("<u8").tobytes(), TAIL.pack(len(docs), len(blocks), len(ids), at, at + table.nbytes, CIGAM)])


class TokenFile:
    """Reads a file's documents and any range of its ids."""

    def __init__(self, data: bytes):
        n, blocks, self.n_ids, at, index, mark = TAIL.unpack_from(data, len(data) - TAIL.size)
        if data[:4] != MAGIC or mark != CIGAM:
            raise ValueError("not a token file")
        self.data, (self.block, self.first) = data, struct.unpack_from("<IQ", data, 4)
        self.documents = np.frombuffer(data, DOCUMENT, n, at)
        self.starts = np.frombuffer(data, "<u8", blocks, index)
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            at = int(self.starts[k])
            self.kept = (k, unpack_block(memoryview(self.data)[at:], min(self.block, self.n_ids - k * self.block)))
        return self.kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position among the ids of all files."""
        start -= self.first
        if not n:
            return np.zeros(0, np.uint32)
        got = [self._block(k) for k in range(start // self.block, (start + n - 1) // self.block + 1)]
        return np.concatenate(got)[start % self.block :][:n] if len(got) > 1 else got[0][start % self.block :][:n]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for doc, start, n, null in self.documents.tolist():
            yield None if null else doc, start, self.ids(start, n)


class WordTokenizer:
    """The library's encoding of whole texts, in which each word is encoded once and kept in a bounded cache.

    Its normalizer and pre-tokenizer treat what ASCII white space divides on its own, so the ids of a text are those of its parts in order. Likewise a part of letters and marks is
    the letters' ids and the marks', and A-Z in parts of ASCII characters may be in lower case from the start. (Elsewhere it may not: composition comes first.) A text in which an added
    token of the library stands, as written there or in other case, goes to the library as a whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.added = "|".join(re.escape(x.content) for x in self.library.get_added_tokens_decoder().values())
        suffix = self.library.model.end_of_word_suffix
        self.final = np.zeros(self.library.get_vocab_size(), bool)
        self.final[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.known = Cache(None, 600_000)  # of parts: ids as 32-bit integers

    def _learn(self, new: list[str]) -> None:
        """Puts new parts into the cache."""
        letters = pc.match_substring_regex(pa.array(new, pa.string()), LETTERS).to_pylist()
        plain = [w for w, x in zip(new, letters, strict=True) if x]
        for i in range(0, len(plain), 500):
            self._learn_plain(plain[i : i + 500])
        rest = [w for w, x in zip(new, letters, strict=True) if not x]
        self.known.update(zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch_fast(rest, add_special_tokens=False)), strict=True))

    def _learn_plain(self, words: list[str]) -> None:
        """The same for words of letters alone, of which one text is made: each is one word of it, whose last id alone is one that ends words."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word's last id, and no other, must be one that ends words")
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            self.known[w] = data[at:end]
            at = end

    def _table(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of parts, which are looked up first."""
        held = list(map(self.known.get, parts))
        new = [p for p, ids in zip(parts, held, strict=True) if ids is None]
        if len(new) + len(self.known) > self.known.most:
            self.known.clear()
        self._learn(new)
        held = [self.known[p] if ids is None else ids for p, ids in zip(parts, held, strict=True)]
        return np.frombuffer(b"".join(held), np.uint32), np.fromiter(map(len, held), np.int64, len(held)) // 4

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts, with a null counting as empty; end_id follows each."""
        texts = pc.fill_null(strings(texts), "")
        whole = pc.match_substring_regex(texts, self.added, ignore_case=True) if self.added else pa.array(np.zeros(len(texts), bool))
        by_library = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        lists = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = strings(lists.flatten()).dictionary_encode()
        marked = pc.extract_regex(words.dictionary, MARKED)
        is_marked = marked.is_valid().to_numpy(zero_copy_only=False)
        letters, marks = (strings(marked.field(i).filter(pa.array(is_marked))) for i in (0, 1))
        letters = pc.if_else(pc.string_is_ascii(letters), pc.ascii_lower(letters), letters).dictionary_encode()
        marks = marks.dictionary_encode()
        rest = words.dictionary.filter(pa.array(~is_marked)).to_pylist()
        flat, n = self._table([*letters.dictionary.to_pylist(), *marks.dictionary.to_pylist(), *rest])

        # two places for each different word, of which the second may be empty
        n_letters, n_marks, n_words = len(letters.dictionary), len(marks.dictionary), len(words.dictionary)
        pair = np.full((n_words, 2), len(n), np.int64)
        pair[is_marked, 0] = letters.indices.to_numpy()
        pair[is_marked, 1] = n_letters + marks.indices.to_numpy().astype(np.int64)
        pair[~is_marked, 0] = n_letters + n_marks + np.arange(len(rest))
        n, begins = np.append(n, 0), offsets(n)
        sizes = n[pair].sum(axis=1)
        texts_of_library = [np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in by_library.tolist()]
        table = np.concatenate([gather(flat, begins[pair.ravel()], n[pair.ravel()]), *texts_of_library, np.array([] if end_id is None else [end_id], np.uint32)])
        sizes = np.concatenate([sizes, [len(x) for x in texts_of_library], [int(end_id is not None)]]).astype(np.int64)

        of, ends = words.indices.to_numpy().astype(np.int64), offsets(per_text)[1:]
        each = np.insert(of, np.concatenate([ends[by_library], ends]), np.concatenate([n_words + np.arange(len(by_library)), np.full(len(ends), len(sizes) - 1)]))
        per_text[by_library] += 1
        return gather(table, offsets(sizes)[each], sizes[each]), offsets(sizes[each])[offsets(per_text + 1)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


#: Ids in one file at least, but for a partition's last; a file ends with a document.
FILE_IDS = 1_000_000


def write_files(docs: DataFrame, path: str, end_id: int = 2, block: int = BLOCK, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files of the ids of all texts in ascending order of their ids, as rows (part long, seq int, first long, n_ids long, file binary) of a written table.

    part and seq give the files' order; first is the position of a file's first id among all ids. Each document's ids end with end_id, so a null or
    empty text has that one alone. Rows that share an id lie next to each other, in the order of their texts; a null id sorts first; an
    empty table gives no files. Other columns aren't read. Texts are dealt out by ranges of ids, so files grow in number, not in size,
    and only a count for each part comes to the driver. The table is in the shared folder, written by Spark, so that any file system will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), word_tokenizer(path)
        seq = first = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def image() -> pa.RecordBatch:
            ids, n, flat = zip(*held, strict=True)
            columns = [pa.array([part], pa.int64()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([_file(pa.concat_arrays(ids), np.concatenate(n), np.concatenate(flat), first, block)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "first", "n_ids", "file"])

        for batch in batches:
            for some in slices(batch, 1):
                ids, (flat, at) = some.column(0), words.encode(some.column(1), end_id)
                low = 0
                while low < len(ids):  # a file ends with the document that fills it
                    high = min(len(ids), int(np.searchsorted(at, at[low] + file_ids - size)))
                    high = max(high, low + 1)
                    held.append((ids.slice(low, high - low), np.diff(at[low : high + 1]), flat[at[low] : at[high]]))
                    size += int(at[high] - at[low])
                    low = high
                    if size >= file_ids:
                        yield image()
                        seq, first, held, size = seq + 1, first + size, [], 0
        if held:
            yield image()

    ordered = docs.select(docs[id_col].cast("long").alias("d"), docs[text_col].cast("string").alias("t")).repartitionByRange("d").sortWithinPartitions("d", "t")
    files = written(ordered.mapInArrow(tidy(run), "part long, seq int, first long, n_ids long, file binary"))
    before, at = [], 0
    for part, n in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        before.append((part, at))
        at += n
    offsets = docs.sparkSession.createDataFrame(before, "part long, before long")  # a row for each part, of which there are as many as shuffle partitions
    return files.join(F.broadcast(offsets), "part").select("part", "seq", (files["first"] + offsets["before"]).alias("first"), "n_ids", "file")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and ids array<long>, from files alone."""
    return _read(files, with_ids=True)


def _read(files: DataFrame, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(data.as_py())
                docs, starts, n, crc, lists = [], [], [], [], []
                for doc, start, count, ids in ((d, s, len(x), x) for d, s, x in file):
                    docs.append(doc)
                    starts.append(first + start - file.first)
                    n.append(count)
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        lists.append(ids.astype(np.int64))
                columns = [pa.array(x, pa.int64()) for x in (docs, starts, n, crc)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(lists, pa.list_(pa.int64()))] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return files.select("first", "file").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_digests(files: DataFrame) -> DataFrame:
    """read_files() without the ids."""
    return _read(files, with_ids=False)
