"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and runs of signs are hashed to `BUCKETS` buckets, singly and in pairs. The raw model counts all documents; the target model counts
labelled ones that are good and not toxic. Both are conditioned on the language (the column `by`, of which the `LANGUAGES` most frequent among the labelled have
models of their own and all others share one), so that how common a language is in either text says nothing. A document's log weight is the log
likelihood ratio of its n-grams, the sum of log target - log raw, of both signs. An n-gram whose two counts differ by no more than chance would have it, a G statistic
under `SURE`, has ratio 0: with some thousand labelled documents most of a ratio would be sampling error otherwise, which grows with a text's length.

Labels come in through at most `LABELS` rows, taken by the order of their hashed ids, so what is broadcast is bounded: these rows, and models of
`BUCKETS` numbers a language.

Sampling: each document's key is its log weight over `temperature` plus Gumbel noise drawn from a hash of its id and the seed, and the k
documents with the greatest keys stay. Unless k is given, each language is sampled by itself, as many documents of it as the share of the target among its
labelled rows says, drawn to the share over all languages by the weight of `PRIOR` rows. The k-th greatest keys are found by counts of keys by leading
bits, so the corpus is never sorted.

Cases: null and empty texts have weight 0; without labels, or without a good document among them, weights are 0 and all
documents stay; rows that share a doc_id draw the
same noise; ties at the k-th key all stay; a document with a null id takes part; null languages are one language; without the column `by` there is one
model; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import byte_table, chunks, mix, prefix_hash, slice_hash, text_bytes, trimmed
from .shared import written

BITS = 17
BUCKETS = 1 << BITS
LABELS = 20_000
LANGUAGES = 15
TEMPERATURE = 1.0
TRUST = 0.5  # added to both counts of an n-gram
SURE = 25.0
PRIOR = 20


def _classes() -> np.ndarray:
    """0: blank; 1: letter or byte of a longer character; 2: digit; 3: sign."""
    c = np.full(256, 3, np.uint8)
    c[[*range(9, 14), 32]] = 0
    c[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    c[48:58] = 2
    return c


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(texts) -> tuple[np.ndarray, np.ndarray, int]:
    """(document row, bucket) of each n-gram of a chunk of texts, and the number of single ones. Words that are all capitals keep a mark."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    kind = CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.r_[start[1:], len(data)]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    prefix = prefix_hash(LOWER[data], byte_table(31))
    h = slice_hash(prefix, start, end)
    loud = (data[start] >= 65) & (data[start] <= 90) & (data[end - 1] >= 65) & (data[end - 1] <= 90) & (end - start > 1)
    h = mix(h + loud.astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    pair = mix(np.where(h[:-1] == h[1:], np.uint64(1), h[:-1] * np.uint64(3) + h[1:]))[row[1:] == row[:-1]]  # a word said twice is one kind of pair
    shift = np.uint64(64 - BITS + 1)
    single = (h >> shift).astype(np.int64)
    double = (pair >> shift).astype(np.int64) + BUCKETS // 2
    return np.r_[row, row[:-1][row[1:] == row[:-1]]], np.r_[single, double], len(single)


def _counts(groups: int):
    def run(batches):
        """One task: n-grams by language and bucket of all documents and of the target's."""
        raw, target = np.zeros(groups * BUCKETS, np.int64), np.zeros(groups * BUCKETS, np.int64)
        for b in chunks(batches):
            row, bucket, _ = features(b.column("text"))
            bucket += np.asarray(b.column("model"))[row].astype(np.int64) * BUCKETS
            raw += np.bincount(bucket, minlength=len(raw))
            good = np.asarray(b.column("good").fill_null(False))
            if good.any():
                target += np.bincount(bucket[good[row]], minlength=len(raw))
        some = np.flatnonzero(raw)
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"bucket": part, "raw": raw[part], "target": target[part]})

    return run


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log target - log raw of each bucket of one language and one size of n-gram."""
    if not target.sum():
        return np.zeros(len(raw))
    due = raw * (target.sum() / raw.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(target > 0, target * np.log(target / due), 0.0) - (target - due))
    return np.where(g >= SURE, np.log((target + TRUST) / (due + TRUST)), 0.0)


def model(docs: DataFrame, labels: DataFrame, most: int = LABELS, by: str = "lang") -> tuple[np.ndarray, list, dict[int, float]]:
    """(log ratios by model and bucket, languages with models of their own, share of the target by model; empty without a target). Counts of
    raw text cover all documents."""
    some = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = (F.coalesce("quality", F.lit(0)) > 0) & (F.coalesce("toxic", F.lit(0)) == 0)
    some = written(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", good.alias("good")))
    language = F.col(by).cast("string") if by in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", language.alias("language")).join(F.broadcast(some), "doc_id", "left")
    known = rows.where("good IS NOT NULL AND language IS NOT NULL").groupBy("language").count().orderBy(F.desc("count"), "language").limit(LANGUAGES)
    languages = [r.language for r in known.collect()]  # LANGUAGES rows at most
    marked = rows.where("good IS NOT NULL").groupBy(model_of(F.col("language"), languages).alias("model")).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good")).collect()  # a row a model
    whole = sum(r.good for r in marked) / max(1, sum(r.n for r in marked))
    shares = {m: whole for m in range(len(languages) + 1)} | {r.model: (r.good + PRIOR * whole) / (r.n + PRIOR) for r in marked} if whole else {}
    groups = len(languages) + 1
    counts = rows.select("text", "good", model_of(F.col("language"), languages).alias("model")).mapInArrow(trimmed(_counts(groups)), "bucket long, raw long, target long")
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # a row a bucket and model at most
    raw, target = np.zeros(groups * BUCKETS), np.zeros(groups * BUCKETS)
    at = np.asarray(total.column("bucket"))
    raw[at], target[at] = np.asarray(total.column("raw")), np.asarray(total.column("target"))
    half = BUCKETS // 2  # single ones, then pairs
    ratio = np.concatenate([log_ratios(raw[i : i + half], target[i : i + half]) for i in range(0, len(raw), half)])
    return ratio.astype(np.float32), languages, shares


def model_of(language: Column, languages: list) -> Column:
    """Place of the language's model; the last one is that of all others."""
    at = F.lit(len(languages))
    for i, x in enumerate(languages):
        at = F.when(language == x, i).otherwise(at)
    return at.cast("int")


def _weights(ratio: np.ndarray):
    def run(batches):
        for b in chunks(batches):
            row, bucket, singles = features(b.column("text"))
            n = b.num_rows
            bucket += np.asarray(b.column("model"))[row].astype(np.int64) * BUCKETS
            weight = np.bincount(row, weights=ratio[bucket], minlength=n) if len(row) else np.zeros(n)
            size = np.bincount(row[:singles], minlength=n) if len(row) else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(size.astype(np.int64)), pa.array(weight), b.column("model")], ["doc_id", "text_hash", "n_words", "log_weight", "model"])

    return run


def weights(docs: DataFrame, ratio: np.ndarray, languages: list, by: str = "lang") -> DataFrame:
    """(doc_id, text_hash, n_words, log_weight, model) for each row of `docs`."""
    language = F.col(by).cast("string") if by in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", model_of(language, languages).alias("model"))
    return rows.mapInArrow(trimmed(_weights(ratio)), "doc_id long, text_hash long, n_words long, log_weight double, model int")


def noise(seed: int) -> Column:
    """Standard Gumbel noise of a document, from 53 bits of a hash of its id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


STEPS = 1 << 20
DIGIT = 14


def kth_greatest(keys: DataFrame, k: dict[int, int]) -> dict[int, int]:
    """For each `model` the k-th greatest of the whole-number column `key` (under 2**46 in size): counts by leading bits, `DIGIT` bits at a
    time for all models at once, so that 2**DIGIT counts a model at most reach the driver."""
    known, low, k = 46, {m: -(1 << 46) for m in k}, dict(k)
    while known > -1 and k:
        shift = max(0, known + 1 - DIGIT)
        lows = F.create_map(*(F.lit(x) for m in k for x in (m, low[m])))[F.col("model")]
        bins = keys.withColumn("_at", F.col("key") - lows).where((F.col("_at") >= 0) & (F.col("_at") < 1 << (known + 1)))
        found = bins.groupBy("model", F.shiftright("_at", shift).alias("bin")).count().toArrow()
        for m in list(k):
            for at, n in sorted((r["bin"], r["count"]) for r in found.filter(pa.compute.equal(found["model"], m)).to_pylist())[::-1]:
                if n >= k[m]:
                    low[m] += at << shift
                    break
                k[m] -= n
            else:
                del k[m]  # fewer rows than asked for
        known = shift - 1
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most: int = LABELS, temperature: float = TEMPERATURE, seed: int = 7, by: str = "lang") -> DataFrame:
    """(doc_id, text_hash, n_words, log_weight, gumbel_key) of the documents that stay."""
    ratio, languages, shares = model(docs, labels, most, by)
    scored = written(weights(docs, ratio, languages, by))
    out = scored.withColumn("gumbel_key", F.col("log_weight") / temperature + noise(seed))
    if k is None and not shares:
        return out.drop("model")
    key = F.floor(F.greatest(F.least(F.col("gumbel_key"), F.lit(3e7)), F.lit(-3e7)) * STEPS).cast("long")
    one = F.lit(0) if k is not None else F.col("model")
    keys = out.select(one.alias("model"), key.alias("key"))
    wanted = {0: k} if k is not None else {r.model: round(shares[r.model] * r["count"]) for r in scored.groupBy("model").count().collect()}  # a row a model
    wanted = {m: n for m, n in wanted.items() if n > 0}
    if not wanted:
        return out.drop("model").limit(0)
    least = kth_greatest(keys, wanted)
    return out.where(key >= F.create_map(*(F.lit(x) for m, n in least.items() for x in (m, n)))[one]).drop("model")
