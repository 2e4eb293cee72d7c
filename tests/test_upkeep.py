"""A cache kept by a stream, against the same done by hand."""

import random

import pytest

from foliant.sources.snapshots import Snapshots
from foliant.streaming import upkeep


def batches(rng):
    """Three batches of rows (kind, seq, book, number, url, text)."""
    out, seq = [], 0
    for _ in range(3):
        rows = []
        for book in "abc":
            for _ in range(rng.randrange(3)):
                seq += 1
                urls = rng.sample([f"{book}{i}" for i in range(6)], rng.randrange(2, 6))
                rows += [("link", seq, book, n, u, None) for n, u in enumerate(urls, 1)]
            for n in rng.sample(range(1, 7), 3):
                seq += 1
                rows.append(("chapter", seq, book, n, None, f"text {seq}"))
        out.append(rows)
    return out


def by_hand(all_batches):
    links, kept = {}, {}
    for rows in all_batches:
        for book in {r[2] for r in rows if r[0] == "link"}:
            last = max(r[1] for r in rows if r[0] == "link" and r[2] == book)
            new = {r[3]: r[4] for r in rows if r[0] == "link" and r[2] == book and r[1] == last}
            old, have = links.get(book, {}), {n: t for (b, n), t in kept.items() if b == book}
            common = old.keys() & new.keys()
            changed = bool(old) and (not common or any(old[n] != new[n] for n in common))
            if changed:
                first = {}
                for n in sorted(old):
                    first.setdefault(old[n], n)
                have = {n: have[first[u]] for n, u in new.items() if u in first and first[u] in have}
            kept = {k: t for k, t in kept.items() if k[0] != book} | {(book, n): t for n, t in have.items() if n in new}
            links[book] = new
        for r in sorted(rows, key=lambda r: r[1]):
            if r[0] == "chapter":
                kept[r[2], r[3]] = r[5]
    return {(b, n): u for b, some in links.items() for n, u in some.items()}, kept


def tables(spark, path):
    links, kept = upkeep.state(spark, path)
    return {(r.book, r.number): r.url for r in links.collect()}, {(r.book, r.number): r.text for r in kept.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_replayed_give_the_state_of_each_once(spark, tmp_path, seed):
    all_batches = batches(random.Random(seed))
    frames = [spark.createDataFrame(rows, upkeep.BATCH_SCHEMA) for rows in all_batches]
    path = str(tmp_path / "t")
    for i, frame in enumerate(frames):
        upkeep.upkeep_sink(spark, path, 2)(frame, i)
        upkeep.upkeep_sink(spark, path, 2)(frame, i)  # the same batch again, by another driver
        assert tables(spark, path) == by_hand(all_batches[: i + 1])


def test_a_batch_that_failed_between_its_tables_is_finished(spark, tmp_path, monkeypatch):
    all_batches = batches(random.Random(3))
    frames = [spark.createDataFrame(rows, upkeep.BATCH_SCHEMA) for rows in all_batches]
    path, real = str(tmp_path / "t"), Snapshots.write
    upkeep.upkeep_sink(spark, path)(frames[0], 0)

    def broken(self, rows, batch=None):
        if self.path.endswith("links"):
            raise RuntimeError("lost")
        return real(self, rows, batch)

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "write", broken)
        with pytest.raises(RuntimeError):
            upkeep.upkeep_sink(spark, path)(frames[1], 1)
    upkeep.upkeep_sink(spark, path)(frames[1], 1)
    assert tables(spark, path) == by_hand(all_batches[:2])


def test_as_a_stream(spark, tmp_path):
    all_batches = batches(random.Random(4))
    for i, rows in enumerate(all_batches):
        spark.createDataFrame(rows, upkeep.BATCH_SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema(upkeep.BATCH_SCHEMA).json(str(tmp_path / "in"))
        q = source.writeStream.foreachBatch(upkeep.upkeep_sink(spark, str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert tables(spark, str(tmp_path / "t")) == by_hand(all_batches)
