"""Byte-level BPE encoding and decoding as a monoid over encoded spans.

An encoded span is its list of ids, the empty list is the unit, and joining is the associative product: it equals the encoding of the joined bytes.
A span is halved until it is short, the leaves are encoded by merging bytes, and neighbours are joined up the tree. A join re-encodes a window around
the seam. If that leaves the outermost id on both sides as it was, every adjacent pair of ids in the result occurs in a valid encoding, and an id list
all of whose adjacent pairs are valid is the encoding of its bytes, as every token of the vocabulary is what merging its own bytes gives; so nothing
outside the window can change. Otherwise the window doubles, at worst to the whole span.

Each match of the pattern is a span of its own; the encoding of a text is the concatenation of its matches' encodings. Decoding concatenates up the
same kind of tree. The trees of many spans are worked on together, level by level, in numpy.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import tidy, Cache
from .ragged import gather, offsets, slices, strings

#: Bytes of a leaf, and ids on either side of a seam in the first window.
LEAF, WINDOW = 8, 4
#: Windows of more bytes are merged one by one.
TOGETHER = 64
#: Matches that are kept; fewer where ids and bytes leave the worker, which take memory too.
MOST_KNOWN, FEW_KNOWN = 400_000, 100_000
NONE = np.int32(2**31 - 1)
#: A space next to other white space.
SPACES = re.compile(r" \s|\s ").search
#: Latin letters, then marks: two matches of a pattern that keeps letters and other signs apart and lets one space lead.
PLAIN = "^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[.,;:!?]*)$"


class Pairs:
    """The ids that pairs of ids merge to, in an open hash table."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            mine = free[first]
            self.keys[at[mine]], self.values[at[mine]] = keys[mine], values[mine]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged ids; NONE where there are none."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._place(keys)
        found, out = self.keys[at], self.values[at]
        left = np.flatnonzero((found != keys) & (found >= 0))
        out[found < 0] = NONE
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            out[left] = np.where(found == keys[left], self.values[at[left]], NONE)
            left = left[(found != keys[left]) & (found >= 0)]
        return out


class ByteBpe:
    """A vocabulary file of base64 tokens and ranks, and the pattern that splits texts. joins counts the seams that were joined."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.text_of = {b: str(b) for b in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            self.size_of[i] = len(token)
        splits = ((self.ranks.get(t[:k]), self.ranks.get(t[k:]), i) for t, i in self.ranks.items() for k in range(1, len(t)))
        self.pairs = Pairs({(a, b): i for a, b, i in splits if a is not None and b is not None})
        self.known = Cache(None, MOST_KNOWN)  # of matches: ids as 32-bit integers
        self.joins = 0

    # merging bytes

    def _merge_some(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans of data of up to TOGETHER bytes: a row of ids for each, with -1 after the last, and their numbers. One pair of each span is merged a round."""
        width, rows = int(sizes.max(initial=1)), np.arange(len(starts))
        ids = np.full((width, len(starts)), -1, np.int32)
        for j in range(width):
            here = np.flatnonzero(sizes > j)
            ids[j, here] = self.of_byte[data[starts[here] + j]]
        n = sizes.astype(np.int64)
        out, counts = np.full((len(starts), width), -1, np.int32), n.copy()
        to = np.full((width, len(starts)), NONE, np.int32)  # what each id and the next merge to
        for j in range(width - 1):
            here = np.flatnonzero(n > j + 1)
            to[j, here] = self.pairs(ids[j, here], ids[j + 1, here])
        while True:
            least = to.min(axis=0)
            open_ = least < NONE
            if not open_.all():
                out[rows[~open_], : len(ids)] = ids[:, ~open_].T
                counts[rows[~open_]] = n[~open_]
                ids, to, n, rows, least = ids[:, open_], to[:, open_], n[open_], rows[open_], least[open_]
                if not len(rows):
                    return out, counts
                top = int(n.max())
                ids, to = ids[:top], to[:top]
            k = (to == least).argmax(axis=0)  # the leftmost of equal ones
            for j in range(len(ids) - 1):
                ids[j] = np.where(j > k, ids[j + 1], ids[j])
                to[j] = np.where(j >= k, to[j + 1], to[j])
            ids[-1], to[-1] = -1, NONE
            at = np.arange(len(rows))
            ids[k, at] = least
            n = n - 1
            to[k, at] = NONE
            right = np.flatnonzero(k < n - 1)
            to[k[right], right] = self.pairs(ids[k[right], right], ids[k[right] + 1, right])
            left = np.flatnonzero(k > 0)
            to[k[left] - 1, left] = self.pairs(ids[k[left] - 1, left], ids[k[left], left])

    def _merge_one(self, data: bytes) -> np.ndarray:
        """The ids of one span of any length, by a heap of pairs."""
        ids = self.of_byte[np.frombuffer(data, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        token, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        heap = [(r, i, token[i], token[i + 1]) for i in range(len(ids) - 1) if (r := ranks.get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i]
            if k < 0 or token[i] is not a or token[k] is not b:
                continue  # one of the two was merged otherwise
            token[i], token[k], ids[i], ids[k] = a + b, None, r, -1
            after[i] = after[k]
            if after[k] >= 0:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(token[x] + token[y])) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of spans of data, one after the other."""
        counts, parts, order = np.zeros(len(starts), np.int64), [], []
        last = 0
        for top in (LEAF, 2 * LEAF, TOGETHER):
            some = np.flatnonzero((sizes > last) & (sizes <= top))
            last = top
            for at in range(0, len(some), 8192):
                here = some[at : at + 8192]
                ids, n = self._merge_some(data, starts[here], sizes[here])
                counts[here] = n
                parts.append(ids[ids >= 0])
                order.append(here)
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            ids = self._merge_one(data[starts[i] : starts[i] + sizes[i]].tobytes())
            counts[i] = len(ids)
            parts.append(ids)
            order.append(np.array([i]))
        if not parts:
            return np.zeros(0, np.int32), counts
        order_ = np.concatenate(order)
        places = np.empty(len(starts), np.int64)
        at_ = offsets(counts[order_])
        places[:] = 0
        places[order_] = at_[:-1]
        return gather(np.concatenate(parts), places, counts), counts

    # the tree

    def encode_spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of the spans of data (bytes) between neighbouring offsets."""
        sizes = np.diff(at)
        long = sizes > LEAF
        if not long.any():
            return self._merge(data, at[:-1], sizes)
        middle = at[:-1][long] + sizes[long] // 2
        ids, counts = self.encode_spans(data, np.sort(np.concatenate([at, middle])))
        # the halves of the i-th span, or the span itself, begin with the first[i]-th list of ids
        first = np.arange(len(sizes)) + np.cumsum(long) - long
        joined, n = self._join(data, middle, ids, offsets(counts), first[long])
        begins = offsets(counts)
        starts = begins[first]
        starts[long] = len(ids) + offsets(n)[:-1]
        out = counts[first]
        out[long] = n
        return gather(np.concatenate([ids, joined]), starts, out), out

    def _join(self, data: np.ndarray, seams: np.ndarray, ids: np.ndarray, begins: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of the joins of the lists left and left + 1 of ids, at these places of data."""
        self.joins += len(left)
        low, seam, high = begins[left], begins[left + 1], begins[left + 2]
        to_byte = offsets(self.size_of[ids])
        lists: list[tuple[np.ndarray, ...]] = []
        middles = [ids]
        used, open_, size = len(ids), np.arange(len(left)), WINDOW
        while len(open_):
            a, b = np.maximum(seam[open_] - size, low[open_]), np.minimum(seam[open_] + size, high[open_])
            from_ = seams[open_] - (to_byte[seam[open_]] - to_byte[a])
            until = seams[open_] + (to_byte[b] - to_byte[seam[open_]])
            found, n = self._merge(data, from_, until - from_)
            start = offsets(n)
            at_start, at_end = a == low[open_], b == high[open_]
            good = (at_start | (found[start[:-1]] == ids[a])) & (at_end | (found[start[1:] - 1] == ids[b - 1])) & ((n > 1) | (at_start & at_end))
            done = open_[good]
            lists.append((done, low[done], a[good] - low[done], used + start[:-1][good], n[good], b[good], high[done] - b[good]))
            middles.append(found)
            used += len(found)
            open_, size = open_[~good], 2 * size
        done, *rest = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.argsort(done)
        rest = [x[order] for x in rest]
        starts, sizes = np.stack(rest[0::2], axis=1).ravel(), np.stack(rest[1::2], axis=1).ravel()
        return gather(np.concatenate(middles), starts, sizes), sizes.reshape(-1, 3).sum(axis=1)

    def join(self, left: Sequence[int], right: Sequence[int]) -> list[int]:
        """The encoding of the bytes of left followed by those of right."""
        if not len(left) or not len(right):
            return [*left, *right]
        a, b = self.decode(left), self.decode(right)
        data = np.frombuffer(a + b, np.uint8)
        return self._join(data, np.array([len(a)]), np.array([*left, *right], np.int32), offsets(np.array([len(left), len(right)])), np.zeros(1, np.int64))[0].tolist()

    def encode_matches(self, matches: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of matches of the pattern."""
        return self.encode_spans(np.frombuffer(b"".join(matches), np.uint8), offsets(np.fromiter(map(len, matches), np.int64, len(matches))))

    # texts

    def _learn(self, matches: set[str]) -> None:
        """Puts new matches into the cache; what is a token needs no tree."""
        data = {m: m.encode("utf-8", "replace") for m in matches}
        self.known.update((m, np.int32(self.ranks[b]).tobytes()) for m, b in data.items() if b in self.ranks)
        new = [m for m, b in data.items() if b not in self.ranks]
        ids, n = self.encode_matches([data[m] for m in new])
        held, at = ids.tobytes(), (4 * offsets(n)).tolist()
        self.known.update((m, held[at[i] : at[i + 1]]) for i, m in enumerate(new))

    def _table(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of matches, which are looked up first."""
        held = list(map(self.known.get, matches))
        new = {m for m, ids in zip(matches, held, strict=True) if ids is None}
        if len(new) + len(self.known) > self.known.most:
            self.known.clear()
        self._learn(new)
        held = [self.known[m] if ids is None else ids for m, ids in zip(matches, held, strict=True)]
        return np.frombuffer(b"".join(held), np.int32), np.fromiter(map(len, held), np.int64, len(held)) // 4

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts, with a null counting as empty.

        No match runs over a single space that stands between two other characters that are no white space, except as its first character, so what lies
        between such spaces is encoded once, with its space. Texts with other white space around spaces are matched as a whole.
        """
        texts = pc.fill_null(strings(texts), "")
        held = texts.to_pylist()
        spaced = np.array([bool(t) and t[0] != " " and t[-1] != " " and not SPACES(t) for t in held], bool)
        lists = pc.split_pattern(pc.if_else(pa.array(spaced), texts, ""), " ")
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = strings(lists.flatten()).dictionary_encode()
        # a text's first word has no space before it
        of, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        of[offsets(per_text)[:-1]] += n_words
        present = np.zeros(2 * n_words, bool)
        present[of] = True
        place = np.cumsum(present) - 1
        after = np.flatnonzero(present[:n_words])
        parts = pa.concat_arrays([pc.binary_join_element_wise("", words.dictionary.take(pa.array(after)), " "), words.dictionary.take(pa.array(np.flatnonzero(present[n_words:])))])

        plain = pc.extract_regex(parts, PLAIN)
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
        word, marks = (strings(plain.field(i).filter(pa.array(is_plain))).dictionary_encode() for i in (0, 1))
        others = [self.pattern.findall(p) for p in parts.filter(pa.array(~is_plain)).to_pylist()]
        whole = [self.pattern.findall(t) if not s else [] for t, s in zip(held, spaced.tolist(), strict=True)]
        more: dict[str, int] = {}
        listed = [[more.setdefault(m, len(more)) for m in x] for x in (*others, *whole)]
        flat, n = self._table([*word.dictionary.to_pylist(), *marks.dictionary.to_pylist(), *more])

        # lists of matches: of each part, then of each text that is matched as a whole
        n_word, n_marks = len(word.dictionary), len(marks.dictionary)
        sizes = np.empty(len(parts) + len(held), np.int64)
        sizes[: len(parts)][is_plain] = 2
        sizes[: len(parts)][~is_plain] = [len(x) for x in others]
        sizes[len(parts) :] = [len(x) for x in whole]
        at, matches = offsets(sizes), np.empty(int(sizes.sum()), np.int64)
        first = at[: len(parts)][is_plain]
        matches[first], matches[first + 1] = word.indices.to_numpy(), n_word + marks.indices.to_numpy().astype(np.int64)
        rest = np.ones(len(matches), bool)
        rest[first] = rest[first + 1] = False
        matches[rest] = [n_word + n_marks + m for x in listed for m in x]
        starts = offsets(n)[:-1]
        ids, ends = gather(flat, starts[matches], n[matches]), offsets(n[matches])
        start, size = ends[at[:-1]], ends[at[1:]] - ends[at[:-1]]

        # each text: its words, and itself if it is matched as a whole
        each = np.insert(place[of], offsets(per_text)[1:], len(parts) + np.arange(len(held)))
        return gather(ids, start[each], size[each]), offsets(size[each])[offsets(per_text + 1)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for None or an empty text."""
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of the ids, concatenated up a tree of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with ids array<int> and decoded binary, the ids' bytes.

    A null text counts as empty and has no ids; repeated rows and null ids stay as they are; an empty table gives an empty one. Other columns, whatever
    their names, are not read. Texts are encoded whole, some megabytes at a time, so memory is bounded by the longest text and a bounded cache.
    path must exist on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        bpe.known.most = FEW_KNOWN
        try:
            for batch in batches:
                for some in slices(batch, 1, 1 << 20):
                    ids, at = bpe.encode_texts(some.column(1))
                    decoded = [bpe.decode(ids[a:b].tolist()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])
        finally:
            bpe.known.clear()  # the worker goes on to other work, which needs the memory
            bpe.known.most = MOST_KNOWN

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(tidy(run), f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; as encode_documents(), without moving ids and bytes out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for some in slices(batch, 1):
                ids, at = bpe.encode_texts(some.column(1))
                a, b = [], []
                for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = ids[low:high].tolist()
                    a.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, own)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(at)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"].cast("string").alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
