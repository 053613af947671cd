"""Token files: ids equal the library's, wavelet matrices answer as plain arrays do, rows equal a plain encoding of all texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltstone.llm import queries as Q
from siltstone.llm import token_files as T
from siltstone.llm import wavelet as W
from siltstone.llm.common import Scratch


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(open(T.MODEL, encoding="utf-8").read())


def brute(library, docs):
    rows, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def key(r):
    return r[0] is not None, r[0] or 0, r[1]


def random_text(rng):
    parts = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\xa0", " ", "　", "\x85", "\x1c", "word", "Wörter", "it's", "we'LL", "123", "4,5", "!?", "…", "漢字", "かな", "é", "😀", "​", "a", "'s", "-", "ª", "\x00", "﻿"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))


def test_ids_equal_the_library(library, encoder):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(4000)] + ["", None, "x" * 20_000, " " * 500, "\n" * 300 + "a"]
    texts += ["\n\n<|endoftext|> and", " <|endoftext|>\n<|endoftext|>", "<|endoftext|"]
    ids, counts = (np.concatenate(x) for x in zip(*(next(encoder.encode(pa.array([t], pa.string()))) for t in texts), strict=True))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    ids, counts = (np.concatenate(x) for x in zip(*encoder.encode(pa.array(texts[:4000])), strict=True))
    assert counts.tolist() == [len(w) for w in want[:4000]] and ids.tolist() == [x for w in want[:4000] for x in w]


def test_units_with_one_hash_are_noticed(library, encoder, monkeypatch):
    own = T.Encoder(open(T.MODEL, encoding="utf-8").read())
    monkeypatch.setattr(T.Words, "_hash", lambda self: np.full(len(self.start), 7, np.uint64))
    texts = ["some words of a text", "quite other ones"]
    (ids, counts), = own.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def stored(tmp_path, ids, block=None):
    path = str(tmp_path / f"{len(ids)}.tok")
    table = pa.table({"doc_id": pa.array([1]), "place": pa.array([0])})
    with open(path, "wb") as sink:
        W.write(sink, ids, table)
    return W.TokenFile(path)


@pytest.mark.parametrize("size, top", [(1, 1), (63, 2), (64, 5), (5000, 50_000), (3000, 70_000), (2000, 1)])
def test_wavelet_matrix_answers_as_an_array(tmp_path, monkeypatch, size, top):
    monkeypatch.setattr(W, "BLOCK", 512)
    monkeypatch.setattr(W, "KEPT", 3)
    rng = np.random.default_rng(size)
    ids = (rng.random(size) ** 4 * top).astype(np.uint32)
    f = stored(tmp_path, ids)
    assert (f.ids() == ids).all() and f.documents().num_rows == 1
    for at in rng.integers(size, size=40):
        assert f.access(int(at)) == ids[at]
    for token in {*ids[:10].tolist(), top + 5, 1 << 20}:
        a, b = sorted(rng.integers(0, size + 1, 2).tolist())
        assert f.count(token) == (ids == token).sum() and f.count(token, a, b) == (ids[a:b] == token).sum()
        assert f.positions(token, a, b).tolist() == (a + np.flatnonzero(ids[a:b] == token)).tolist()
    with pytest.raises(IndexError):
        f.access(size)


def test_one_id_reads_few_blocks(tmp_path):
    f = stored(tmp_path, np.random.default_rng(0).integers(0, 50_000, 1 << 20).astype(np.uint16))
    read = []
    raw = f._raw
    f._raw = lambda p, b: read.append((p, b)) or raw(p, b)
    f.access(777_777)
    assert len(read) <= 2 * f.bits


def test_torn_files_are_refused(tmp_path):
    path = tmp_path / "torn.tok"
    path.write_bytes(b"SWMX0001 something")
    with pytest.raises(ValueError):
        W.TokenFile(str(path))


def test_checksums_of_parts():
    rng = random.Random(1)
    for _ in range(20):
        parts = [rng.randbytes(rng.randrange(0, 900)) for _ in range(4)]
        total = 0
        for k, p in enumerate(parts):
            total ^= T.moved_crc(zlib.crc32(p), sum(map(len, parts[k + 1 :])))
        assert total == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("shard, task", [(50, 120), (1 << 20, 1 << 25)])
def test_rows_equal_brute_force(frame, odd_texts, library, shard, task):
    rng = random.Random(5)
    docs = odd_texts + [(100 + i, random_text(rng)) for i in range(200)]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.store_and_read(frame(docs).repartition(5), shard_tokens=shard, task_tokens=task).collect()]
    assert sorted(got, key=key) == sorted(brute(library, docs), key=key)
    assert T.store_and_read(frame([])).count() == 0


def test_occurrences_in_the_files(spark, frame, library, tmp_path):
    rng = random.Random(6)
    docs = [(i, random_text(rng) + " word and word") for i in range(60)]
    scratch = Scratch(spark, "test")
    files = scratch.settle(T.write_shards(T.encode_documents(frame(docs)), f"{scratch.root}/shards", 3, 97), "files")
    token = library.encode(" word", add_special_tokens=False).ids[0]
    want = sorted((i, p) for i, t in docs for p, x in enumerate(library.encode(t, add_special_tokens=False).ids) if x == token)
    assert sorted((r.doc_id, r.place) for r in T.find_token(files, token).collect()) == want
    assert sum(r["count"] for r in T.count_token(files, token).collect()) == len(want)
    assert T.count_token(files, 49_999).agg({"count": "sum"}).first()[0] == 0


def test_query_equals_brute_force(spark, small, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in Q.op12_token_files(spark, small).collect()]
    assert sorted(got, key=key) == brute(library, docs)


def test_units_reach_the_library_in_long_texts(library, encoder):
    """A thousand plain units are ten texts, and odd ones among them keep their places."""

    class Counted:
        texts = 0

        def __getattr__(self, name):
            def call(batch, **options):
                self.texts += len(batch)
                return getattr(library, name)(batch, **options)

            return call

    own = T.Encoder(open(T.MODEL, encoding="utf-8").read())
    own.library = Counted()
    units = [f" w{i}x" if i % 333 else f"a{i}\n\n b" for i in range(1, 1001)]
    ids, sizes = own._library(units)
    want = [library.encode(u, add_special_tokens=False).ids for u in units]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert own.library.texts <= 10 + 3
