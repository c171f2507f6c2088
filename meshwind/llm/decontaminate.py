"""Benchmark decontamination by Wu-Manber search over word sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, materialize, picked

#: Bytes of benchmark text whose patterns are broadcast at once; a larger benchmark is searched in such blocks.
BLOCK_BYTES = 8 << 20
#: Bytes 0-47, 58-96 and 123-127 separate words once A-Z are lower-cased; bytes of non-ASCII characters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Patterns of ``length`` words. A block is the last two words of the search window (one for single words)."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.skip, self.shift, self.buckets = length - self.block + 1, {}, {}

    def add(self, pattern: tuple[bytes, ...], item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.skip), m - end)
        self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes]):
        """(end, items) of each occurrence, by end."""
        m, skip, shift, buckets = self.length, self.skip, self.shift, self.buckets
        at, n = m - 1, len(words)
        if self.block == 1:
            for at in range(n):
                if (found := buckets.get((words[at],))) is not None:
                    yield at + 1, found[(words[at],)]
            return
        while at < n:
            key = (words[at - 1], words[at])
            by = shift.get(key, skip)
            if by:
                at += by
                continue
            found = buckets[key].get(tuple(words[at - m + 1 : at + 1]))
            if found is not None:
                yield at + 1, found
            at += 1


def compile_patterns(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if size:
            machine = by_length.setdefault(size, WuManber(size))
            for at in range(len(words) - size + 1):
                machine.add(tuple(words[at : at + size]), item)
    return [by_length[k] for k in sorted(by_length)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = 10, keep: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, spans (merged word ranges that occurrences cover), items (sorted ids as strings).

    Texts are lower-cased (A-Z) and cut into words; a pattern is each run of ``window`` consecutive
    words of an item, or all words of a shorter item. Null or empty texts have no words and no hits;
    an item without words matches nothing; a null item id counts as the id "null"; repeated rows and
    ids keep one result row each; an empty table of either kind gives no hits. Other columns are ignored;
    keep: the row itself follows, as a struct ``doc``.
    """
    spark = docs.sparkSession
    bench = picked(benchmark, item=item_col, text=item_text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    cur = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")] if keep else []))
    for block in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in part.collect()], window))
        cur = cur.withColumn("found", arrow_column(spark, _scan(shared), RESULT, F.col("text"), *([F.col("found")] if block else [])))
        if block < blocks - 1:
            cur = materialize(cur)
    return cur.select("id", "found.*", *(["doc"] if keep else []))


def _scan(shared):
    def make():
        machines = shared.value

        def work(texts: pa.Array, earlier: pa.Array | None = None) -> dict:
            counts, spans, items = [], [], []
            for text, old in zip(texts.to_pylist(), earlier.to_pylist() if earlier is not None else [None] * len(texts)):
                words = words_of(text)
                hits, names = [(s["start"], s["end"]) for s in old["spans"]] if old else [], set(old["items"] if old else ())
                for machine in machines:
                    size = machine.length
                    for end, found in machine.search(words):
                        if hits and hits[-1][0] <= end - size <= hits[-1][1] <= end:
                            hits[-1] = (hits[-1][0], end)
                        else:
                            hits.append((end - size, end))
                        names |= found
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                items.append(sorted(names))
            return {"n_words": counts, "spans": spans, "items": items}

        return work

    return make


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op7 digest of find_contamination."""
    found = find_contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
