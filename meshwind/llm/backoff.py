"""Stupid-backoff language-model scores of documents against the rest of their corpus: n-gram count tables joined to exploded n-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, picked, small_batches

#: The backoff factor, the count of an unseen word, fixed-point units in a nat.
ALPHA, UNSEEN, UNIT = 0.4, 0.5, 1_000_000
#: Bytes of text whose n-grams a worker counts before they are sent, and bytes of text a partition of the tables.
AT_ONCE, PART_BYTES = 10 << 20, 6 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Words(dict):
    """Word to its 64-bit hash, kept while few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _codes(texts, cache: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and each text's number of words."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD).split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return np.fromiter((cache[w] for ws in words for w in ws), np.uint64, int(n.sum())).view(np.int64), n


def _bigrams(words: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Document and number of each pair of neighbouring words; numbers of its two words and key of each distinct pair."""
    doc = np.repeat(np.arange(len(n)), n)
    inside = doc[1:] == doc[:-1]
    both, where = np.unique((at[:-1].astype(np.int64) * len(words) + at[1:])[inside], return_inverse=True)
    a, b = np.divmod(both, max(1, len(words)))
    x, y = words.view(np.uint64)[a], words.view(np.uint64)[b]
    key = (x ^ x >> np.uint64(32)) * _MIX[0] + (y ^ y >> np.uint64(29)) * _MIX[1]
    return doc[1:][inside], where, a, b, (key ^ key >> np.uint64(31)).view(np.int64)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by partition, and the partition of each in that order."""
    part = ((keys.view(np.uint64) * _MIX[0] >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    return order, part[order]


def _lists(values: np.ndarray, ends) -> pa.Array:
    """Lists of the values that end there."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _grams(parts: int):
    """A slice's distinct n-grams with their counts, one row for each partition of a table (``to``: twice its number, and one
    more for bigrams)."""

    def rows(codes: np.ndarray, n: np.ndarray, ids: pa.Array, name: int) -> list[pa.Array]:
        words, at, times = np.unique(codes, return_inverse=True, return_counts=True)
        _, where, _, _, keys = _bigrams(words, at, n)
        to, ends, have, counts = [], [], [], []
        for table, (grams, count) in enumerate(((words, times), (keys, np.bincount(where, minlength=len(keys))))):
            order, part = _dealt(grams, parts)
            stops = np.flatnonzero(np.diff(part, append=-1)) + 1 if len(part) else np.empty(0, np.int64)
            to.append(2 * part[stops - 1] + table), ends.append(stops + sum(map(len, have))), have.append(grams[order]), counts.append(count[order])
        own = np.concatenate(ends)
        return [pa.array(np.concatenate(to)), pa.array(np.full(len(own), name)), _lists(np.concatenate(have), own), _lists(np.concatenate(counts).astype(np.int32), own)]

    return _sliced(rows)


def _homes(kind: pa.DataType):
    """One row a slice: its distinct words, its documents with their numbers of words, and the number of each word in turn."""

    def rows(codes: np.ndarray, n: np.ndarray, ids: pa.Array, name: int) -> list[pa.Array]:
        words, at = np.unique(codes, return_inverse=True)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return [pa.array([-1 - name]), one(pa.array(words)), one(ids.cast(kind)), one(pa.array(n, pa.int32())), one(pa.array(at, pa.int32()))]

    return _sliced(rows)


def _sliced(rows):
    """Batches of texts in slices of about AT_ONCE bytes, numbered alike whenever a task runs, each to a batch of ``rows``."""

    def made(codes, n, ids, name: int) -> pa.RecordBatch:
        arrays = rows(np.concatenate(codes), np.concatenate(n), pa.concat_arrays(ids), name)
        return pa.RecordBatch.from_arrays(arrays, [str(k) for k in range(len(arrays))])

    def run(batches):
        cache, task, number = Words(), TaskContext.get().partitionId() << 24, 0
        codes, n, ids, size = [], [], [], 0
        for batch in batches:
            step = max(1, batch.num_rows * (2 << 20) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                c, m = _codes(part.column("text").to_pylist(), cache)
                codes.append(c), n.append(m), ids.append(part.column("id"))
                size += part.nbytes
                if size >= AT_ONCE:
                    yield made(codes, n, ids, task + number)
                    codes, n, ids, size, number = [], [], [], 0, number + 1
        if ids:
            yield made(codes, n, ids, task + number)
        del codes, n, ids, cache
        give_back()

    return run


def _runs(batches):
    """Joined n-grams (to, slice, pos, c) to lists: one a run of neighbouring places of a slice's part."""
    schema = pa.schema([("to", pa.int64()), ("part", pa.int64()), ("first", pa.int32()), ("counts", pa.list_(pa.int64()))])
    for batch in batches:
        to, name, pos, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(to):
            continue
        new = np.r_[True, (to[1:] != to[:-1]) | (name[1:] != name[:-1]) | (pos[1:] != pos[:-1] + 1)]
        starts = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - name[starts]), pa.array(to[starts]), pa.array(pos[starts].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(to)].astype(np.int32)), pa.array(c))], schema=schema)
    give_back()


def _summed(parts: int):
    """A slice's words and the counts that came back, to its documents' sums."""
    units = lambda x: np.rint(np.log(x) * UNIT).astype(np.int64)
    backed_off = round(math.log(ALPHA) * UNIT)

    def run(home: pa.Table, back: pa.Table) -> pa.Table:
        words, n, at = (home.column(c)[0].values.to_numpy().astype(np.int64) for c in ("keys", "n", "at"))
        d, where, a, b, keys = _bigrams(words, at, n)
        one, two = np.zeros(len(words), np.int64), np.zeros(len(keys), np.int64)
        part_of, first, counts = back.column("part").to_numpy(), back.column("first").to_numpy(), back.column("counts").combine_chunks()
        sizes = np.diff(counts.offsets.to_numpy()) if len(counts) else np.empty(0, np.int64)
        values = counts.values.to_numpy()[counts.offsets[0].as_py() : counts.offsets[-1].as_py()] if len(counts) else np.empty(0, np.int64)
        for table, (grams, into) in enumerate(((words, one), (keys, two))):
            order, part = _dealt(grams, parts)
            use = part_of % 2 == table
            begin = np.searchsorted(part, part_of[use] // 2) + first[use]
            ends = np.cumsum(sizes[use])
            place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes[use]), sizes[use])
            into[order[place]] = values[np.repeat(use, sizes)]
        wide, deep = max(1, len(words)), max(1, len(keys))
        own, own_times = np.unique(np.repeat(np.arange(len(n)), n) * wide + at, return_counts=True)
        others = lambda doc, word: one[word] - own_times[np.searchsorted(own, doc * wide + word)]
        pairs, times = np.unique(d * deep + where, return_counts=True)
        doc, pair = np.divmod(pairs, deep)
        left = two[pair] - times
        known = left > 0
        term = units(np.where(known, left, ALPHA)) - np.where(known, units(np.maximum(others(doc, a[pair]), 1)), 0)
        term = np.where(known, term, backed_off + units(np.maximum(others(doc, b[pair]), UNSEEN)))
        begins = np.flatnonzero(n > 0)
        head = at[(np.cumsum(n) - n)[begins]]
        score, seen = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        np.add.at(score, doc, term * times)
        score[begins] += units(np.maximum(others(begins, head), UNSEEN))
        np.add.at(seen, doc[known], times[known])
        return pa.table({"id": home.column("ids")[0].values, "n": n, "seen": seen, "score": score})

    return run


def score_documents(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, n_words, n_seen (places whose bigram other documents have), log_score (in nats), mean_log_score (null without words).

    A word scores its bigram's share of its predecessor, c(ab) / c(a), if other documents have the bigram, else ALPHA times
    its own share c(b) / N of all N words; the first word scores its share. The document's own counts are taken off c first, so
    copies help each other but a text does not help itself; an unseen word counts as UNSEEN times. Logarithms are summed in
    millionths of a nat. Null, empty and wordless texts score 0. Repeated rows count as documents of their own; an empty
    table gives no rows; other columns are ignored.

    The distinct n-grams of each slice of texts, under 64-bit hashes, are dealt by hash and exploded; their sums are the
    count tables of words and bigrams, which are joined to the exploded n-grams where they are; the counts go back to their
    slices, whose documents sum them. A frequent n-gram is one row a slice, so that it crowds no partition.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, field = docs.sparkSession, docs.schema[id_col].dataType
    kind, base = field.simpleString(), picked(docs, id=id_col, text=text_col)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // PART_BYTES)
    tasks = max(2 * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    small_batches(spark)
    dealt = base.mapInArrow(_grams(parts), "to long, slice long, keys array<long>, times array<int>").repartition(tasks, "to")
    grams = dealt.select("to", "slice", F.posexplode(F.arrays_zip("keys", "times")).alias("pos", "g")).select("to", "slice", "pos", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    table = grams.groupBy("to", "key").agg(F.sum("times").alias("c"), F.min("slice").alias("since"))
    # both sides use all columns, so that one shuffle serves them
    joined = grams.join(table.hint("shuffle_hash"), ["to", "key"]).select("to", "slice", "pos", "c", "times", "since")
    back = joined.mapInArrow(_runs, "to long, part long, first int, counts array<long>")
    homes = base.mapInArrow(_homes(to_arrow_type(field)), f"to long, keys array<long>, ids array<{kind}>, n array<int>, at array<int>")
    each = homes.groupBy("to").cogroup(back.groupBy("to")).applyInArrow(_summed(parts), f"id {kind}, n long, seen long, score long")
    name = "spark.sql.requireAllClusterKeysForCoPartition"  # rows dealt by ``to`` are where (to, key) is needed
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        each = materialize(each)
    finally:
        spark.conf.set(name, before)
    total = each.agg(F.sum("n")).first()[0] or 1
    shares = (F.col("n") - F.col("seen")) * round(math.log(max(total, 1)) * UNIT)
    score = (F.col("score") - shares) / F.lit(float(UNIT))
    return each.select("id", F.col("n").alias("n_words"), F.col("seen").alias("n_seen"), score.alias("log_score"), F.when(F.col("n") > 0, score / F.col("n")).alias("mean_log_score"))
