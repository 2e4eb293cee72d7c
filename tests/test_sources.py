"""Files, caches and versions: what is read back, and what a failure leaves."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.sources import datasource, files
from foliant.sources.snapshots import Snapshots

CHAPTER = "site string, cache_key string, number int, title string, content string"


def everything(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def failing(frame, column="text"):
    """`frame`, of which one row fails in its task once others are written."""
    return frame.withColumn(column, F.when(F.col(column) == "bad", F.raise_error(F.lit("broken"))).otherwise(F.col(column)))


def test_books_in_single_files(spark, tmp_path):
    rows = [(b, n, f"第{n}章", f"text {b} {n}\n") for b in (1, 2, 3, 4) for n in range(1, 40)]
    chapters = spark.createDataFrame(rows, "book int, number int, title string, content string").repartition(5)
    titles = spark.createDataFrame([(1, "A/b"), (2, "书"), (3, "书"), (4, "")], "book int, book_title string")
    files.write_book_files(chapters, titles, ["book"], str(tmp_path / "out"))
    assert everything(tmp_path / "out") == sorted(["A_b.txt", "书.txt", "书 (2).txt", "未命名小说.txt"])
    for name, b in (("A_b", 1), ("书", 2), ("书 (2)", 3), ("未命名小说", 4)):
        want = "\n\n".join(f"第{n}章\n\ntext {b} {n}" for n in range(1, 40)) + "\n"
        assert (tmp_path / "out" / f"{name}.txt").read_text(encoding="utf-8") == want
    # a later book joins those that are there
    files.write_book_files(chapters.where("book = 1"), spark.createDataFrame([(1, "new")], "book int, book_title string"), ["book"], str(tmp_path / "out"))
    assert "new.txt" in everything(tmp_path / "out") and len(everything(tmp_path / "out")) == 5


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(datasource.TextFiles)
    (tmp_path / "old.txt").write_text("old")
    rows = spark.createDataFrame([(f"{i}.txt", 0, "bad" if i == 37 else "fine") for i in range(40)], "file string, place long, text string").repartition(4)
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            failing(rows).write.format("foliant_text_files").option("path", str(tmp_path)).mode(mode).save()
        assert everything(tmp_path) == ["old.txt"] and os.listdir(tmp_path) == ["old.txt"]
    rows.limit(3).write.format("foliant_text_files").option("path", str(tmp_path)).option("end", "").mode("overwrite").save()
    assert len(everything(tmp_path)) == 3 and "old.txt" not in everything(tmp_path)
    for name in ("../x", "/x", "a//b", "_staging/x", ""):
        with pytest.raises(ValueError):
            datasource.checked(name)


def test_rows_of_a_file_must_be_together(spark, tmp_path):
    spark.dataSource.register(datasource.TextFiles)
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("a", 1, "z")], "file string, place long, text string").coalesce(1)
    with pytest.raises(PySparkException):
        rows.write.format("foliant_text_files").option("path", str(tmp_path / "o")).mode("append").save()
    with pytest.raises(PySparkException):
        rows.withColumnRenamed("text", "t").write.format("foliant_text_files").option("path", str(tmp_path / "o")).mode("append").save()


def test_caches_are_read_back_by_both_readers(spark, tmp_path):
    rows = [("s", "k", 1, "第1章", "a\nb"), ("s", "k", 2, "", "no empty line"), ("s", "q", 1234567, "t", "y"), ("t", "k", 3, "第3章", ""), ("t", "k", 3, "第3章", "")]
    files.write_cache_files(spark.createDataFrame(rows, CHAPTER), str(tmp_path))
    want = {("s", "k", 1, "第1章\n\na\nb\n"), ("s", "k", 2, "no empty line\n"), ("s", "q", 1234567, "t\n\ny\n"), ("t", "k", 3, "第3章\n")}
    assert everything(tmp_path)[0] == "s/k/chapters/000001.txt" and len(everything(tmp_path)) == 4
    assert {tuple(r) for r in files.read_cache(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in files.read_cache_files(spark, str(tmp_path)).collect()} == want


def test_only_asked_folders_are_opened(spark, tmp_path):
    rows = [(s, k, n, "t", f"{s}{k}{n}") for s in "abc" for k in "xyz" for n in range(1, 6)]
    files.write_cache_files(spark.createDataFrame(rows, CHAPTER), str(tmp_path))
    for spoiled in ("b/x", "b/y", "c/z", "a/y"):
        (tmp_path / spoiled / "chapters" / "000001.txt").write_bytes(b"\xff\xfe\xff")  # to open it would fail
    (tmp_path / "a" / "x" / "chapters" / "note.txt").write_text("no chapter")
    read = lambda **some: files.read_cache_files(spark, str(tmp_path), **some)
    assert read(sites=["a"], keys=["x", "z"]).count() == 10
    some = read(sites=["a", "b"], first=2, last=4)
    assert some.where("text LIKE '%3%'").count() == 6 and some.count() == 18 and some.where("site = 'a'").count() == 9 and some.count() == 18
    assert read(first=2, last=2).count() == 9 and read(sites=["nowhere"]).count() == 0 and read(sites=[".."]).count() == 0
    with pytest.raises(PySparkException):
        read().count()
    reader = datasource.CacheReader(str(tmp_path), {"sites": {"a"}, "keys": {"x", "y", "none"}}, 0, 9)
    assert [p.books for p in reader.partitions()] == [[("a", "x"), ("a", "y")]]


def cache(spark, rows):
    return spark.createDataFrame(rows, "site string, cache_key string, number int, text string")


def state(frame):
    return {tuple(r)[:3]: r.text for r in frame.collect()}


def test_versions_of_a_cache(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    assert table.read().count() == 0 and table.manifest()["version"] == 0
    assert table.write(cache(spark, [("s", "k", n, f"a{n}") for n in range(1, 5)])) == 1
    assert table.write(cache(spark, [("s", "k", 2, "b2"), ("s", "k", 9, "b9"), ("s", None, 1, "n")])) == 2
    assert table.write(cache(spark, [("s", "k", 9, "c9"), ("s", None, 1, "m"), ("s", "k", 9, "b")])) == 3
    want = {("s", "k", 1): "a1", ("s", "k", 2): "b2", ("s", "k", 3): "a3", ("s", "k", 4): "a4", ("s", "k", 9): "c9", ("s", None, 1): "m"}
    assert state(table.read()) == want and table.read().count() == len(want)
    assert state(table.read(1)) == {("s", "k", n): f"a{n}" for n in range(1, 5)}
    assert table.compact() == 4 and len(table.manifest()["folders"]) == 1 and state(table.read()) == want
    assert table.compact() == 4
    gone = table.vacuum()
    assert len(gone) == 3 and table.versions() == [4] and state(table.read()) == want
    with pytest.raises(LookupError):
        table.read(1)


def test_a_reader_during_a_failed_write_sees_the_old_version(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    table.write(cache(spark, [("s", "k", 1, "a"), ("s", "k", 2, "b")]))
    before, open_ = state(table.read()), table.read()
    rows = cache(spark, [("s", "k", n, "bad" if n == 90 else "new") for n in range(100)]).repartition(8)
    with pytest.raises(PySparkException):
        table.write(failing(rows))
    assert state(open_) == state(table.read()) == before and table.versions() == [1]
    # killed between the rows and their manifest
    table._folder(rows)
    assert state(Snapshots(spark, str(tmp_path)).read()) == before
    assert len(table.vacuum()) >= 1 and state(table.read()) == before


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    real, asked = one.manifest, []

    def late(version=None):
        found = real(version)
        if not asked:
            asked.append(1)
            two.write(cache(spark, [("s", "k", 2, "two")]))  # commits while the first holds an older manifest
        return found

    monkeypatch.setattr(one, "manifest", late)
    assert one.write(cache(spark, [("s", "k", 1, "one")])) == 2
    assert state(two.read()) == {("s", "k", 1): "one", ("s", "k", 2): "two"}


def test_a_row_without_a_text_deletes(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    table.write(cache(spark, [("s", "k", n, "a") for n in (1, 2, 3)]), 4)
    table.write(cache(spark, [("s", "k", 2, None), ("s", "k", 5, None)]))
    assert state(table.read()) == {("s", "k", 1): "a", ("s", "k", 3): "a"} and table.batch() == 4
    table.compact()
    assert state(table.read()) == {("s", "k", 1): "a", ("s", "k", 3): "a"} and table.batch() == 4
