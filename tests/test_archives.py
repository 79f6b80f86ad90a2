import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tagweave import sources
from tagweave.sources import archives


def content(k):
    r = random.Random(k)
    return [f"line {i} of {k} é {r.random()}" for i in range(r.randint(0, 400))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    for part in "ab":
        with zipfile.ZipFile(at / f"{part}.zip", "w") as z:
            for k in range(12):
                z.writestr(zipfile.ZipInfo(f"{part}/member{k}.txt"), "\r\n".join(content((part, k).__repr__())), zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED)
    for name, mode in (("c.tar", "w"), ("d.tgz", "w:gz"), ("e.tar.xz", "w:xz")):
        with tarfile.open(at / name, mode) as t:
            for k in range(8):
                data = "\n".join(content(repr((name, k)))).encode()
                info = tarfile.TarInfo(f"{name}/member{k}.txt")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (at / "_hidden.zip").write_bytes(b"PK")
    return str(at)


def expected(part, n):
    return sorted((f"{part}/member{k}.txt", x) for k in range(n) for x in content(repr((part, k))))


@pytest.mark.parametrize("pattern, part, n", [("a.zip", "a", 12), ("c.tar", "c.tar", 8), ("d.tgz", "d.tgz", 8), ("e.tar.xz", "e.tar.xz", 8)])
def test_lines_of_members(spark, folder, pattern, part, n):
    got = archives.archive_lines(spark, f"{folder}/{pattern}")
    assert sorted((r.member, r.value) for r in got.collect()) == expected(part, n)


def test_folders_and_patterns(spark, folder):
    got = archives.archive_lines(spark, f"file://{folder}/[ab].zip")
    assert sorted((r.member, r.value) for r in got.collect()) == sorted(expected("a", 12) + expected("b", 12))
    assert archives.archive_lines(spark, folder).select("archive").distinct().count() == 5
    with pytest.raises(Exception, match="nothing"):
        archives.archive_lines(spark, f"{folder}/nothing*.zip").collect()


def test_members_are_dealt_to_tasks(spark, folder):
    whole = archives.archive_lines(spark, f"{folder}/a.zip")
    parts = archives.archive_lines(spark, f"{folder}/a.zip", part_bytes=5_000)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() >= 6
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_names_of_members_prune_tasks(spark, folder):
    every = archives.archive_lines(spark, f"{folder}/a.zip", part_bytes=1)
    one = archives.archive_lines(spark, f"{folder}/a.zip", "a/member4.txt", 1)
    assert one.rdd.getNumPartitions() == 1 < every.rdd.getNumPartitions()
    assert sorted(r.value for r in one.collect()) == sorted(content(repr(("a", 4))))
    both = one.select("value").union(every.where(F.col("member") == "a/member5.txt").select("value"))
    assert both.count() == len(content(repr(("a", 4)))) + len(content(repr(("a", 5)))) and every.count() == len(expected("a", 12))
    assert archives.archive_lines(spark, f"{folder}/a.zip", "none").collect() == []
    assert sources.tar_members(spark, f"{folder}/d.tgz", "member3").count() == len(content(repr(("d.tgz", 3))))


def test_members_are_streams(tmp_path):
    """A member that unpacks to far more than is read at a time."""
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.txt", b"0123456789abcdef\n" * 1_000_000)
    reader = archives.ArchiveReader(str(tmp_path / "x.zip"))
    (part,) = reader.partitions()
    batches = [b.num_rows for b in reader.read(part)]
    assert sum(batches) == 1_000_000 and max(batches) == archives.BATCH_LINES


def test_what_cannot_be_read_says_so(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("a.txt", "a")
    reader = archives.ArchiveReader(str(tmp_path / "x.zip"))
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))
