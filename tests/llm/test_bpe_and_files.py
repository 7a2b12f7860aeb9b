import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import bpe, tokenfile

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
PARTS = ["a", "The ", " ", "\n", "é", "日本", "\x85", "\x1c", "'s", "1", "..", "\t", "é", "J̌", "Σ", "ΑΣ ", "x" * 70, "　", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "don't", "K", "word.", "WORD, ", " é!", "ab" * 90, "  "]


@pytest.fixture(scope="module")
def library():
    t = bpe.tokenizer(RANKS, P.PATTERN)
    return t, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


def merged(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        k = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[k] + parts[k + 1] not in ranks:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def test_tokens_are_what_their_bytes_merge_to(library):
    """What the windows of join() rely on."""
    assert all(len(merged(b, library[0].ranks)) == 1 for b in list(library[0].ranks)[::7])


def test_encode_is_the_librarys(library):
    t, enc = library
    rng = random.Random(5)
    for _ in range(600):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        assert t.encode(s) == enc.encode_ordinary(s), s
        assert t.decode(t.encode(s)) == s.encode()
    for _ in range(60):
        s = "".join(rng.choice("abcdetnois") for _ in range(rng.randrange(3000)))
        assert t.encode(s) == enc.encode_ordinary(s)
    for s in ("a" * 5001 + "b" + "the" * 3000, "ß" * 2000, "-" * 999):
        assert t.encode(s) == enc.encode_ordinary(s)


def merged_ids(t, data):
    return [t.ranks[x] for x in merged(data, t.ranks)]


def test_join_is_associative(library):
    t, _ = library
    rng = random.Random(6)
    for _ in range(100):
        data = [bytes(rng.choice(b"abcthe") for _ in range(rng.randrange(40))) for _ in range(3)]
        a, b, c = (merged_ids(t, x) for x in data)
        assert t.join(t.join(a, b), c) == t.join(a, t.join(b, c)) == merged_ids(t, b"".join(data))


def test_spans_of_any_bytes(library):
    """Leaves, windows and long merges against the merging of bytes; bytes that are no text too."""
    t, _ = library
    rng = random.Random(12)
    spans = [bytes(rng.choice(b"abcthe \xc3\xa9\xff") for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 17, 60, 300]))) for _ in range(400)] + [b"a" * 777, b"the" * 200]
    ids, n = t.encode_matches(spans)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, s in enumerate(spans):
        wanted = merged_ids(t, s)
        assert ids[at[i] : at[i + 1]].tolist() == wanted and (not s or t._merge_one(s).tolist() == wanted)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_a_corpus_is_joined_up_trees(library):
    """The ids of a corpus come from joins, and are the library's."""
    t, enc = library
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].combine_chunks()
    t.known.clear()
    t.joins = 0
    ids, at = t.encode_texts(texts)
    for i, text in enumerate(texts.to_pylist()):
        assert ids[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(text or "")
    assert t.joins > 1000


def test_rows(spark, library):
    rows = [(1, "Hello the world", "x"), (2, None, "y"), (3, "", None), (1, "Hello the world", "x"), (None, "é", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in found) == sorted((str(d), (t or "").encode()) for d, t, _ in rows)
    own = {r.doc_id: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    ids = library[1].encode_ordinary("Hello the world")
    assert own[1].n_tokens == len(ids) and own[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert own[2].n_tokens == 0 and own[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_blocks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 1024):
        for high in (1, 2, 300, 2**16, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            ids[rng.integers(0, n, max(1, n // 50))] = 2**32 - 1
            assert (tokenfile.unpack_block(tokenfile.pack_block(ids), n) == ids).all()
    outlier = np.append(np.arange(1000, dtype=np.uint32) % 16, np.uint32(2**31))
    assert len(tokenfile.pack_block(outlier)) < 600  # one outlier doesn't widen the block


def test_files():
    docs = [(k, np.arange(k * 300, dtype=np.uint32)) for k in (1, 5, 0, 7)]
    file = tokenfile.TokenFile(tokenfile.pack_file(docs, first=11, block=256))
    assert [(d, s, x.tolist()) for d, s, x in file] == [(1, 11, list(range(300))), (5, 311, list(range(1500))), (0, 1811, []), (7, 1811, list(range(2100)))]
    assert file.ids(311 + 700, 3).tolist() == [700, 701, 702]
    assert list(tokenfile.TokenFile(tokenfile.pack_file([]))) == []
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"x" * 80)


def test_words_are_the_librarys():
    """The library as it is loaded, added tokens in a text included."""
    own, library = tokenfile.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(600)] + [None, "", " "]
    for end in (None, 2):
        ids, at = own.encode(pa.array(texts), end)
        for i, s in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(s or "", add_special_tokens=False).ids + [end] * (end is not None), s


def test_write_and_read(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["the", "a", "word", "x1"]) for _ in range(rng.randrange(40)))) for k in range(200)] + [(500, None), (501, ""), (7, "twin"), (None, "nobody"), (502, "the end <|endoftext|> of it"), (503, "a word " * 50_000), (-(2**63), "the least id")]
    docs = spark.createDataFrame([(d, t, 0, b"x") for d, t in rows], "doc_id long, text string, first int, file binary").repartition(5)
    files = tokenfile.write_files(docs, WORDS, file_ids=100)
    got = tokenfile.read_files(files).orderBy("start").collect()
    library, at = Tokenizer.from_file(WORDS), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert files.count() > 4 and len(got) == len(rows)
    for r, (doc, text) in zip(got, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (doc, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenfile.read_digests(tokenfile.write_files(docs.limit(0), WORDS)).count() == 0
