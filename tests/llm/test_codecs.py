"""Round trips: archives, pieces, GIF files; URL rules; benchmark leaks."""

import hashlib
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import decontaminate as D
from siltstone.llm import gif_media as G
from siltstone.llm import pieces as P
from siltstone.llm import queries as Q
from siltstone.llm import url_rules as U
from siltstone.llm import warc as W
from siltstone.llm.textops import flat


def test_sql_twins(spark, small, same_rows):
    same_rows(Q.op4_warc(spark, small), Q.OP4_SQL)
    same_rows(Q.op10_url_filters(spark, small), Q.OP10_SQL)


PAGES = "page_id long, url string, html string, digest string, n string"


def test_warc_odd_rows(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big, "x", "x"), (2, None, big, "x", "x"), (3, "u", "small", "x", "x"), (4, "u", "small", "x", "x"), (5, "u", None, "x", "x"), (6, "u", "", "x", "x"), (7, "bad\r\nurl", big, "x", "x"), (8, "u", "z" * 300000, "x", "x")]
    got = {r.page_id: r for r in W.archive_and_read(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 8
    for i, _, html, _, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 7, 3, 4)] == [("revisit", 7), ("revisit", 7), ("response", None), ("response", None), ("response", None)]
    assert W.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_null_and_repeated_ids(spark):
    """Rows of one id with different payloads, one of which another page repeats; rows without an id."""
    a, b = "a" * 1200, "b" * 1300
    rows = [(1, "u", a, "x", "x"), (1, "u", b, "x", "x"), (2, "u", a, "x", "x"), (2, "u", b[:5], "x", "x"), (None, "u", a, "x", "x"), (None, "u", None, "x", "x"), (3, "u", b, "x", "x"), (3, "u", b, "x", "x")]
    got = W.archive_and_read(spark.createDataFrame(rows, PAGES)).collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, 1200, sha(a), "revisit", 2), (1, 1300, sha(b), "revisit", 3), (2, 1200, sha(a), "response", None), (2, 5, sha(b[:5]), "response", None), (None, 1200, sha(a), "response", None), (None, 0, sha(""), "response", None)] + [(3, 1300, sha(b), "response", None)] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_range_merging():
    assert W.coalesce_ranges([(0, 10), (10, 5), (100, 5), (1000, 5)], max_gap=90, max_read=120) == [(0, 3, 105), (3, 4, 5)]
    assert W.coalesce_ranges([]) == []


def test_record_is_checked():
    raw = W.record_head(1, "u", "response", "d", 3, None) + b"abc\r\n\r\n"
    fields, payload = W.parse_record(raw)
    assert payload == b"abc" and fields["warc-type"] == "response"
    with pytest.raises(ValueError):
        W.parse_record(raw[:-1])


@pytest.fixture(scope="module")
def coder():
    return P.Encoder(P.Vocabulary.load())


@pytest.fixture(scope="module")
def library():
    import sentencepiece as spm

    return spm.SentencePieceProcessor(model_file=P.MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdehinorst  \n\t.,12é漢ß😀AZ▁'-")), max_size=60), max_size=5))
def test_ids_equal_the_library(coder, library, texts):
    ids, counts = coder.encode([t.encode() for t in texts])
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.encode(t) for t in texts]
    assert coder.decode(ids, counts) == [t.replace("▁", " ").encode() for t in texts]


def test_unigram_vocabulary(library, tmp_path):
    """A vocabulary of the other kind takes the maximum of the summed scores, as the library does."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(P.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)
    other = tmp_path / "uni.model"
    other.write_bytes(proto.SerializeToString())
    sp, mine = spm.SentencePieceProcessor(model_file=str(other)), P.Encoder(P.Vocabulary.load(str(other)))
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for t in ["hello world", "the quick brown fox", "internationalisation of things"]:
        ids, counts = mine.encode([t.encode()])
        assert mine.decode(ids, counts) == [t.encode()]
        assert abs(score(ids.tolist()) - score(sp.encode(t))) < 1e-3


def test_pieces_odd_rows(frame, odd_texts, library):
    coded = P.encode_documents(frame(odd_texts))
    rows = coded.collect()
    assert all(r.lossless for r in rows) and len(rows) == len(odd_texts)
    key = lambda x: str(x)
    assert sorted([(r.doc_id, list(r.ids)) for r in rows], key=key) == sorted([(i, library.encode(t or "")) for i, t in odd_texts], key=key)
    back = P.decode_documents(coded).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=key) == sorted([(i, t or "") for i, t in odd_texts], key=key)
    assert P.encode_documents(frame([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_gif_round_trip(raw):
    payload = G.pad(raw)
    _, _, frames = G.decode_gif(G.encode_gif(payload))
    assert b"".join(f.samples.tobytes() for f in frames) == payload


@pytest.mark.parametrize("kind", ["zeros", "random", "text"])
def test_gif_large(kind):
    n = 64 * 1500
    payload = {"zeros": bytes(n), "random": np.random.default_rng(0).integers(0, 256, n, dtype=np.uint8).tobytes(), "text": (b"all work and no play " * n)[:n]}[kind]
    w, h, frames = G.decode_gif(G.encode_gif(payload))
    assert len(frames) == 2 and (w, h) == (64, 1024) and b"".join(f.samples.tobytes() for f in frames) == payload
    shown = [G.histogram(c).tolist() for c in G.compose(w, h, frames)]
    assert [t[3] for t in G.timed_frames(w, h, frames)] == shown and [t[:2] for t in G.timed_frames(w, h, frames)] == [(0, 100), (100, 100)]
    w, h, whole = G.decode_gif(G.encode_gif(payload[: 64 * 700]))
    assert [t[3] for t in G.timed_frames(w, h, whole)] == [G.histogram(c).tolist() for c in G.compose(w, h, whole)]


def animation():
    """Two frames by hand: a full red one, then a part that is blue with a transparent spot and disposes to nothing."""
    out = [b"GIF89a", struct.pack("<HHBBB", 2, 2, 0x80, 0, 0), bytes([255, 0, 0, 0, 0, 255])]

    def image(codes):
        bits = "".join(format(c, "03b")[::-1] for c in codes)
        raw = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        return b"\x02" + bytes([len(raw)]) + raw + b"\0"

    out += [b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, 5, 0, 0), b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0), image([4, 0, 0, 4, 0, 0, 5])]
    out += [b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2 | 1, 7, 0, 0), b"\x2c" + struct.pack("<HHHHB", 1, 0, 1, 2, 0), image([4, 1, 0, 5])]
    out += [b"\x21\xf9\x04" + struct.pack("<BHBB", 0, 9, 0, 0), b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0x40), image([4, 1, 5]), b"\x3b"]
    return b"".join(out)


def test_disposal_and_transparency(spark):
    w, h, frames = G.decode_gif(animation())
    shots = [c.copy() for c in G.compose(w, h, frames)]
    red, blue, none = [255, 0, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shots[0].tolist() == [[red, red], [red, red]]
    assert shots[1].tolist() == [[red, blue], [red, red]]
    assert shots[2].tolist() == [[blue, none], [red, none]]
    media = spark.createDataFrame([(1, bytearray(animation()))], "doc_id long, gif binary")
    rows = G.frame_table(media).orderBy("frame").collect()
    assert [(r.start_ms, r.duration_ms, r.pixels) for r in rows] == [(0, 50, 4), (50, 70, 4), (120, 90, 2)]
    assert rows[1].histogram[48] == 3 and rows[1].histogram[3] == 1


def test_damaged_gif():
    good = G.encode_gif(bytes(64))
    for bad in (b"nothing", good[:20], good[:-6], b""):
        with pytest.raises(ValueError):
            G.decode_gif(bad)


def test_features_equal_slow_ones(frame, odd_texts):
    """Features against frames composed pixel by pixel from the payload, for texts of one and of several frames."""
    texts = [(i, t) for i, t in odd_texts if i is not None] + [(50, "ab" * 70000), (51, "é\n" * 30)]
    got = {r.doc_id: r.feature for r in G.store_and_read(frame(texts)).collect()}
    palette = G.default_palette()
    for i, t in texts:
        p = G.pad((t or "").encode())
        rows = [p[k : k + 64] for k in range(0, len(p), 64)]
        canvas, counts, n = [b"\0" * 64] * min(len(rows), 1024), {}, 0
        for k in range(0, len(rows), 1024):
            part, n = rows[k : k + 1024], n + 1
            canvas = part + canvas[len(part) :]
            for sample in b"".join(canvas):
                r, g, b = palette[sample] >> 6
                counts[int(r) * 16 + int(g) * 4 + int(b)] = counts.get(int(r) * 16 + int(g) * 4 + int(b), 0) + 1
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert got[i] == f"{n}x64x{len(canvas)};{n * 100}ms;" + ",".join(f"{c:02d}:{m}" for c, m in top)


def test_gif_odd_rows(frame, odd_texts):
    got = G.store_and_read(frame(odd_texts)).collect()
    assert len(got) == len(odd_texts)
    want = {}
    for i, t in odd_texts:
        raw = (t or "").encode()
        p = G.pad(raw)
        want.setdefault(str(i), (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[str(r.doc_id)]
    one, two = (next(r for r in got if r.doc_id == i) for i in (1, 2))
    assert one[1:] == two[1:]
    assert G.store_and_read(frame([])).count() == 0


def test_url_rules(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/es/ok", "allow"), ("com/de/", "block")]
    urls = [("http://www.Example.org/es/1?x", "example.org/es/", "block"), ("http://example.org/es/okay", "example.org/es/ok", "allow"), ("http://example.org/esx", "org/", "allow"), ("http://a.org", None, "allow"), (None, None, "allow"),
            ("example.org/es/", None, "allow"), ("ftp://x.com/de/", "com/de/", "block"), ("http://xcom/de/", None, "allow"), ("http://notexample.org/es/", "org/", "allow"), ("", None, "allow"), ("http://x.com?/de/", None, "allow"), ("http://a.com#/x://b.org/", None, "allow")]
    rows = spark.createDataFrame([(i, u[0], "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in U.judge_urls(rows, rules).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [u[1:] for u in urls]
    assert (got[0].host, got[0].path) == ("www.example.org", "/es/1") and (got[4].host, got[4].path) == ("", "")
    assert U.judge_urls(rows.filter("false"), rules).count() == 0
    with pytest.raises(ValueError):
        U.judge_urls(rows, rules, max_rules=2)


ITEMS = [(1, " ".join(f"alpha{i}" for i in range(30))), (2, " ".join(f"beta{i}" for i in range(9))), (3, "very short"), (4, None), (5, " ".join(f"gamma{i}" for i in range(40)))]


def test_leaks(spark, frame):
    a, b, g = ITEMS[0][1], ITEMS[1][1], ITEMS[4][1].split()
    changed = [w if i % 7 else "changed" for i, w in enumerate(a.split())]
    docs = [(1, "x y " + a.upper() + ". z"), (2, " ".join(changed)), (3, b + " end"), (4, " ".join(a.split()[:10])), (5, "clean words, very SHORT ones only"), (6, None), (7, ""), (8, " ".join(g[10:25])), (None, a), (9, a + " " + a), (9, a)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    for block in (D.BLOCK_BYTES, 100):  # one block, and several
        got = sorted((str(r.doc_id), r.item_id, r.matched_tokens) for r in D.find_leaks(frame(docs), bench, block).collect())
        assert [x[2] for x in got if x[0] != "2"] == [30, 9, 2, 15, 30, 30, 30]
        assert [x[:2] for x in got] == [("1", 1), ("2", 1), ("3", 2), ("5", 3), ("8", 5), ("9", 1), ("9", 1), ("None", 1)]
    assert D.find_leaks(frame([]), bench).count() == 0 and D.find_leaks(frame(docs), bench.filter("false")).count() == 0
    kept = {r.doc_id for r in D.without_leaks(frame(docs), bench).collect()}
    assert kept == {4, 5, 6, 7}


def test_leaks_equal_exact_containment(spark, small):
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, q in items.items() if q in t}
    got = {(r.doc_id, r.item_id) for r in Q.op1_decontamination(spark, small).collect()}
    assert want <= got


def brute_leaks(items, texts, seeded=True):
    """{(row, item): matched tokens} by all diagonals, one token at a time; ``seeded``: only those on which some mask agrees."""
    toks = lambda t: re.findall("[a-z0-9]+", t.lower())
    out = {}
    for r, text in enumerate(texts):
        d = toks(text)
        for i, item in enumerate(items):
            q = toks(item)
            masks = [*(D.MASKS if len(q) >= D.MIN_ITEM else ()), *D.SHORT_MASKS.get(len(q), ())]
            top = (0, 0)
            for shift in range(1 - len(q), len(d)):
                inside = [0 <= k + shift < len(d) for k in range(len(q))]
                same = [x and q[k] == d[k + shift] for k, x in enumerate(inside)]
                hit = any(all(o == "0" or same[k + j] for j, o in enumerate(m)) and inside[k] and inside[k + len(m) - 1] for m in masks for k in range(len(q) - len(m) + 1))
                if seeded and not hit:
                    continue
                best = matched = score = n = 0
                for k in range(len(q)):
                    if not inside[k] or score + (1 if same[k] else -D.MISMATCH) < 0:
                        score, n = 0, 0
                        continue
                    score, n = score + (1 if same[k] else -D.MISMATCH), n + same[k]
                    if score > best:
                        best, matched = score, n
                if q and matched >= min(D.MIN_MATCH, math.ceil(D.ITEM_SHARE * len(q))):
                    top = max(top, (matched, 1))
            if top[1]:
                out[r, i] = top[0]
    return out


def test_leaks_equal_brute_force(monkeypatch):
    """Both ways, on random texts of few words, monotonous and periodic ones, and copies with substitutions; slices of all sizes."""
    rng = np.random.default_rng(8)
    word = lambda n, v: " ".join(f"w{rng.integers(v)}" for _ in range(n))
    items = [word(rng.integers(1, 40), v) for v in (2, 3, 50, 50, 1000, 1000, 1000)] + ["aa " * 20, "aa bb " * 12, "aa bb cc " * 8, "x y z"]
    texts = [word(60, v) for v in (2, 3, 50)] + ["aa " * 50, "bb aa " * 30, "cc aa bb " * 20 + "aa " * 30, "", "one x y z two"]
    for item in items:
        changed = [t if rng.random() > 0.12 else "other" for t in item.split()]
        texts.append(word(9, 30) + " " + " ".join(changed) + " " + word(9, 30))
    want = brute_leaks(items, texts)
    assert len(want) >= 15
    for size in (1 << 19, 7):
        monkeypatch.setattr(D, "SLICE", size)
        got = D.leaks_of(D.SeedIndex(list(range(len(items))), items), *flat(pa.array(texts, pa.large_string())))
        assert {(int(r), int(i)): int(n) for r, i, n in zip(got["row"], got["item"], got["matched"], strict=True)} == want


@pytest.mark.parametrize("rate, least", [(0.05, 0.999), (0.1, 0.99), (0.15, 0.95), (0.2, 0.9)])
def test_recall_of_substituted_items(rate, least):
    """Of copies with so many tokens substituted at random that are leaks on some diagonal, the share that a seed finds."""
    rng = np.random.default_rng(int(rate * 100))
    items = [" ".join(f"i{k}x{j}" for j in range(n)) for k, n in enumerate(rng.integers(15, 64, 60))]
    texts = [" ".join("before it " + " ".join(t if rng.random() > rate else f"s{rng.integers(1 << 30)}" for t in item.split()) + " behind".split()[0] for item in [q]) for q in items for _ in range(4)]
    got = D.leaks_of(D.SeedIndex(list(range(len(items))), items), *flat(pa.array(texts, pa.large_string())))
    found = set(zip(got["row"].tolist(), got["item"].tolist(), strict=True))
    leaks = {(r, i) for r, t in enumerate(texts) for i in [r // 4] if brute_leaks([items[i]], [t], seeded=False)}
    print("substituted", rate, "leaks", len(leaks), "found", len(found & leaks) / len(leaks))
    assert found <= leaks and len(found) >= least * len(leaks)


def test_monotonous_texts_end():
    """Every place of the items meets every place of the text."""
    import time

    items, begin = ["ha " * 400] * 50, time.process_time()
    got = D.leaks_of(D.SeedIndex(list(range(50)), items), *flat(pa.array(["ha " * 2000, "ho ha " * 500], pa.large_string())))
    assert len(got["row"]) == 50 and set(got["matched"].tolist()) == {400} and time.process_time() - begin < 60


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 7, 10, 12])
def test_periodic_texts_need_bounded_memory(period):
    """Fifty items of 301 tokens against 2,001 tokens of one period: every item is found, with its whole length."""
    import time
    import tracemalloc

    word = [f"w{i}" for i in range(period)]
    item = " ".join(word[i % period] for i in range(301))
    index = D.SeedIndex(list(range(50)), [item] * 50)
    text = " ".join(word[i % period] for i in range(2001))
    begin = time.process_time()
    tracemalloc.start()
    got = D.leaks_of(index, *flat(pa.array([text, "before " + item], pa.large_string())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got["row"]) == 100 and set(got["matched"].tolist()) == {301}
    assert peak < 500e6 and time.process_time() - begin < 30


def test_progressions():
    group, place = np.array([1, 1, 1, 1, 2, 3, 3, 3, 3, 3]), np.array([0, 3, 6, 7, 9, 2, 4, 6, 11, 16])
    first, step, size = D.progressions(group, place)
    runs = [[int(place[f]) + k * int(s) for k in range(n)] for f, s, n in zip(first, step, size, strict=True)]
    assert runs == [[0, 3, 6], [7], [9], [2, 4, 6], [11, 16]]
    assert len(D.progressions(group[:0], place[:0])[0]) == 0


@pytest.mark.parametrize("most", [1 << 19, 5])
def test_runs_of_all_steps_meet_in_all_diagonals(monkeypatch, most):
    """All pairs of equal seeds, and no others, whatever the steps of their runs."""
    monkeypatch.setattr(D, "SLICE", most)
    rng = np.random.default_rng(4)
    for _ in range(30):
        words = lambda n: [f"w{rng.integers(2)}" if rng.random() < 0.2 else f"p{i % 3}" for i in range(n)]
        item, text = words(40), words(60)
        index = D.SeedIndex([1], [" ".join(item)])
        buf, offsets = flat(pa.array([" ".join(text)], pa.large_string()))
        w = D.Words(buf, offsets, lower=True, space=D.NOT_TOKEN)
        for mask in D.MASKS:
            s = D.seeds(w.hash, mask)
            ones = [i for i, c in enumerate(mask) if c == "1"]
            want = {a - b for a in range(60 - len(mask) + 1) for b in range(40 - len(mask) + 1) if all(text[a + i] == item[b + i] for i in ones)}
            got = {int(d) for part in index.probe(s, np.zeros(60, np.int64), len(mask)) for hits in D._slices(part) for d in hits[2]}
            # An entry is of any mask, but the seeds of other masks have other hashes.
            assert got == want


def test_seed_positions():
    h = np.arange(1, 40, dtype=np.uint64)
    for mask in D.MASKS:
        s = D.seeds(h, mask)
        other = h.copy()
        other[mask.index("0")] = 999  # an ignored position
        assert D.seeds(other, mask)[0] == s[0]
        other[0] = 998
        assert D.seeds(other, mask)[0] != s[0]


@pytest.mark.parametrize("size", [8, 9, 10, 11, 12, 14])
def test_leaks_with_every_substitution(size):
    """All sets of up to three substitutions against all stretches; at a document's ends the outer ones are cut off too."""
    item = [f"t{i}" for i in range(size)]
    texts, leaks = [], []
    for r in range(4):
        for gone in itertools.combinations(range(size), r):
            same = [i not in gone for i in range(size)]
            stretches = [(sum(1 if x else -3 for x in same[a:b]), sum(same[a:b]), -b, -a) for a in range(size) for b in range(a + 1, size + 1)]
            best = max(s[0] for s in stretches)
            # The first end of the best stretches, and of these the longest.
            first = max((s for s in stretches if s[0] == best), key=lambda s: (s[2], s[3]))
            words = [w if x else "other" for w, x in zip(item, same, strict=True)]
            while words and words[0] == "other":
                words = words[1:]
            while words and words[-1] == "other":
                words = words[:-1]
            for text in (["a", "b", *[w if x else "other" for w, x in zip(item, same, strict=True)], "c", "d"], words):
                texts.append(" ".join(text))
                leaks.append(first[1] >= min(13, math.ceil(0.8 * size)))
    got = D.leaks_of(D.SeedIndex([1], [" ".join(item)]), *flat(pa.array(texts, pa.large_string())))
    found = set(got["row"].tolist())
    assert any(leaks) and found == {i for i, leak in enumerate(leaks) if leak}
