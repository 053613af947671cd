"""Release archives: the same bytes whatever the partitioning, exact round trips, fewer archives for a pushed filter, no torn ones."""

import hashlib
import os
import random
import tarfile

import pytest

from siltstone.sources import archives as A


def rows(n=300, seed=1):
    rng = random.Random(seed)
    out = [(i * 3, rng.randbytes(rng.randrange(0, 400))) for i in range(n)]
    return out + [(7, None), (None, b"no id"), (6, b"again"), (6, b"again"), (60, b"x" * 5000)]


@pytest.fixture(scope="module")
def released(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("release"))
    manifest = A.write_archives(spark.createDataFrame(rows(), "id long, content binary").repartition(4), f"file://{folder}", 4000).collect()
    return folder, manifest


def test_round_trip(spark, released):
    folder, manifest = released
    want = sorted(((-1 if i is None else i), c or b"") for i, c in rows())
    got = sorted(((-1 if r.id is None else r.id), bytes(r.content)) for r in A.read_archives(spark, f"file://{folder}").collect())
    assert got == want and sum(r.n for r in manifest) == len(want) and len(manifest) > 10
    assert all(r.n_bytes <= 4000 or r.n == 1 for r in manifest)


def test_archives_are_plain_tar_files_with_their_digests(released):
    folder, manifest = released
    for r in manifest:
        path = r.file.removeprefix("file:").replace("//", "/", 1) if r.file.startswith("file:") else r.file
        raw = open(path, "rb").read()
        assert hashlib.sha256(raw).hexdigest() == r.sha256
        with tarfile.open(path) as tar:
            assert len(tar.getnames()) == r.n
    assert not [f for f in os.listdir(folder) if f.startswith(".archive")]


def test_bytes_do_not_depend_on_the_partitioning(spark, released, tmp_path):
    other = A.write_archives(spark.createDataFrame(rows()[::-1], "id long, content binary").repartition(9), f"file://{tmp_path}/r", 4000).collect()
    name = lambda r: (r.file.rsplit("/", 1)[-1], r.sha256, r.n)
    assert sorted(map(name, other)) == sorted(map(name, released[1]))


def test_a_pushed_filter_reads_fewer_archives(spark, released, monkeypatch):
    folder, manifest = released
    monkeypatch.setattr(A, "SPLIT_BYTES", 1)
    all_of = A.ArchiveReader(f"file://{folder}")
    assert sum(len(p.files) for p in all_of.partitions()) == len(manifest)
    some = A.ArchiveReader(f"file://{folder}")
    list(some.pushFilters([A.GreaterThanOrEqual(("id",), 300), A.LessThan(("id",), 330)]))
    picked = [f for p in some.partitions() for f, _ in p.files]
    assert 0 < len(picked) <= 3 and all(r.file in picked for r in manifest if r.least is not None and r.least <= 315 <= r.greatest)
    listed = A.ArchiveReader(f"file://{folder}")
    list(listed.pushFilters([A.In(("id",), (0, 897, None))]))
    assert sum(len(p.files) for p in listed.partitions()) <= 3
    nothing = A.ArchiveReader(f"file://{folder}")
    list(nothing.pushFilters([A.EqualTo(("id",), 10**9)]))
    assert [p.files for p in nothing.partitions()] == [[]]


def test_filters_reach_the_reader_and_torn_archives_outside_are_not_opened(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    manifest = A.write_archives(spark.createDataFrame(rows(), "id long, content binary"), folder, 4000).collect()
    last = max((r for r in manifest if r.greatest is not None), key=lambda r: r.greatest)
    path = str(tmp_path / "r" / last.file.rsplit("/", 1)[-1])
    raw = bytearray(open(path, "rb").read())
    raw[-2000] ^= 1
    open(path, "wb").write(bytes(raw))
    got = A.read_archives(spark, folder)
    assert got.filter("id < 90").count() == sum(i is not None and i < 90 for i, _ in rows())
    assert got.filter("id = 6 OR id = 9").count() == 4
    with pytest.raises(Exception, match="not the archive"):
        got.filter(f"id >= {last.least}").count()
    with pytest.raises(Exception, match="not the archive"):
        got.count()


def test_no_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert A.write_archives(spark.createDataFrame([], "id long, content binary"), folder).count() == 0
    assert A.read_archives(spark, folder).count() == 0
