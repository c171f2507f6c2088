"""MinHash near-duplicate detection with an LSH forest of several sorted signature orders."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, give_back, materialize, picked

#: Signature bytes, sorted orders, rows of a region, forests of a region that are confirmed before the pairs left.
N_HASH, N_TREES, REGION, FORESTS = 128, 16, 1024, 4
#: Documents, and shingles of them, that a block of a candidate component holds; larger components are dealt out as pairs of blocks.
CELL, CELL_SHINGLES = 512, 1_000_000
#: Rows of the id-to-cell table up to which it is broadcast (about 40 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
_A = (np.random.RandomState(11).randint(1, 2**62, N_HASH).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.RandomState(12).randint(0, 2**62, N_HASH).astype(np.uint64)
_ORDERS = [np.random.RandomState(100 + t).permutation(N_HASH) for t in range(N_TREES)]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def bounds(percent: int) -> tuple[int, int]:
    """Equal signature bytes from which a pair is confirmed on full sets, 4.2 standard errors below those expected at the
    similarity asked for, and the bytes that the rows of a run share: a pair at that similarity shares them in about half of the orders."""
    p = percent / 100
    return math.floor(N_HASH * (p + (1 - p) / 256) - 4.2 * math.sqrt(N_HASH * p * (1 - p))), max(1, round(math.log(0.52) / math.log(min(p, 0.99))))


class WordHashes(dict):
    """64-bit hashes of words, kept while few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D separate
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    size = min(width, len(codes))
    mixed = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * _MIX[k % 2] + _MIX[2]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> bytes:
    low = np.full(N_HASH, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(low, (found[at : at + 2048, None] * _A + _B).min(axis=0), out=low)
    return ((low * _MIX[0]) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, width: int, kind: str) -> DataFrame:
    def make():
        cache = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            out = {"id": batch.column("id"), "key": batch.column("key"), "n": [], "fp": [], "sig": []}
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width, cache)
                out["n"].append(len(found))
                out["fp"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                out["sig"].append(signature(found) if len(found) else None)
            if "row" in batch.schema.names:
                out["row"] = batch.column("row")
            return out

        return work

    more = f", row {docs.schema['row'].dataType.simpleString()}" if "row" in docs.columns else ""
    return arrow_map(docs, make, f"id {kind}, key long, n long, fp binary, sig binary{more}")


def ordered_keys(nodes: DataFrame) -> DataFrame:
    """One row a tree: its number, the signature in the tree's order, the set's fingerprint."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, N_HASH)
            fps = batch.column("fp").to_pylist()
            return {"key": [bytes([t]) + row.tobytes() + fp for t, order in enumerate(_ORDERS) for row, fp in zip(sigs[:, order], fps)]}

        return work

    return arrow_map(nodes, make, "key binary")


def forests(equal: np.ndarray, least: int, rounds: int) -> list[tuple[int, int]]:
    """Edges of ``rounds`` edge-disjoint maximum spanning forests (Boruvka) of the pairs with equal >= least."""
    m, out = len(equal), []
    equal = np.where(equal >= least, equal, -1).astype(np.int16)
    np.fill_diagonal(equal, -1)
    for _ in range(rounds):
        comp, taken = np.arange(m), []
        while True:
            open_ = np.where(comp[:, None] != comp[None, :], equal, -1)
            best = open_.argmax(axis=1)
            value = open_[np.arange(m), best]
            rows = np.flatnonzero(value >= 0)
            if not len(rows):
                break
            rows = rows[np.lexsort((-value[rows], comp[rows]))]
            first = rows[np.r_[True, comp[rows][1:] != comp[rows][:-1]]]
            for r in first:
                a, b = comp[r], comp[best[r]]
                if a != b:
                    comp[comp == max(a, b)] = min(a, b)
                    taken.append((int(r), int(best[r])))
        if not taken:
            break
        out += taken
        i, j = np.array(taken).T
        equal[i, j] = equal[j, i] = -1
    return out


def regions(prefix: np.ndarray, lo: int, hi: int, depth: int):
    """Ranges of sorted rows lo..hi that agree on ``depth`` bytes; crowded ranges go deeper until they hold at most REGION rows.

    prefix[i]: bytes that rows i and i+1 share. Neighbouring small parts are joined again up to REGION rows;
    rows that agree everywhere are covered by half-overlapping ranges.
    """
    if hi - lo <= REGION:
        yield lo, hi
        return
    if depth >= N_HASH:
        for at in range(lo, max(lo + 1, hi - REGION // 2), REGION // 2):
            yield at, min(hi, at + REGION)
        return
    cuts = [lo, *(np.flatnonzero(prefix[lo : hi - 1] <= depth) + lo + 1).tolist(), hi]
    start = None
    for a, b in zip(cuts, cuts[1:]):
        if b - a > REGION:
            if start is not None:
                yield start, a
                start = None
            yield from regions(prefix, a, b, depth + 1)
        elif start is None:
            start = a
        elif b - start > REGION:
            yield start, a
            start = a
    if start is not None:
        yield start, hi


def candidate_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs of fingerprints whose signatures nearly agree, from longest-common-prefix neighbours in each sorted order."""
    least, depth = bounds(percent)

    def run(batches):
        rows = [k for batch in batches for k in batch.column(0).to_pylist()]
        if len(rows) < 2:
            return
        table = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        del rows
        prefix = np.empty(len(table) - 1, np.int32)
        for at in range(0, len(prefix), 8192):
            end = min(len(prefix), at + 8192)
            differ = table[at : end, : N_HASH + 1] != table[at + 1 : end + 1, : N_HASH + 1]
            prefix[at:end] = np.where(differ.any(axis=1), differ.argmax(axis=1) - 1, N_HASH)  # byte 0 is the tree
        near = np.flatnonzero(prefix >= depth)
        breaks = np.flatnonzero(np.diff(near) > 1) if len(near) else []
        ends = [*(near[breaks] + 2), near[-1] + 2] if len(near) else []
        starts = [near[0], *near[np.asarray(breaks) + 1]] if len(near) else []
        out = {"u": [], "v": [], "equal": []}
        for first, last in zip(starts, ends):
            for lo, hi in regions(prefix, int(first), int(last), depth):
                if hi - lo < 2:
                    continue
                sigs = table[lo:hi, 1 : N_HASH + 1]
                if hi - lo == 2:
                    pairs, equal = [(0, 1)], np.array([[0, (sigs[0] == sigs[1]).sum()]])
                    if equal[0, 1] < least:
                        continue
                else:
                    equal = np.empty((hi - lo, hi - lo), np.int16)
                    step = max(1, (4 << 20) // (N_HASH * (hi - lo)))
                    for r in range(0, hi - lo, step):
                        equal[r : r + step] = np.count_nonzero(sigs[r : r + step, None, :] == sigs[None, :, :], axis=2)
                    pairs = forests(equal, least, FORESTS)
                for i, j in pairs:
                    u, v = sorted((table[lo + i, N_HASH + 1 :].tobytes(), table[lo + j, N_HASH + 1 :].tobytes()))
                    out["u"].append(u), out["v"].append(v), out["equal"].append(int(equal[i, j]))
            if len(out["u"]) > 100_000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {"u": [], "v": [], "equal": []}
        if out["u"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        del table, prefix, near, out
        give_back()

    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("equal", pa.int32())])
    return keys.mapInArrow(run, "u binary, v binary, equal int").groupBy("u", "v").agg(F.max("equal").alias("equal"))


def run_numbers(nodes: DataFrame, depth: int) -> DataFrame:
    """fp, comp, n, sig and the runs of a node: one number a tree, of the tree and the first ``depth`` bytes of its order."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, N_HASH)
            return {"fp": batch.column("fp"), "comp": batch.column("comp"), "n": batch.column("n"), "sig": batch.column("sig"), "runs": np.stack([_run(sigs, t, depth) for t in range(N_TREES)], axis=1).tolist()}

        return work

    return arrow_map(nodes, make, "fp binary, comp binary, n long, sig binary, runs array<long>")


def _run(sigs: np.ndarray, tree: int, depth: int) -> np.ndarray:
    out = np.full(len(sigs), tree, np.int64)
    for k in _ORDERS[tree][:depth]:
        out = out << 8 | sigs[:, k]
    return out


MEMBER = "cell string, run long, block string, fp binary, comp binary, sig binary"


def left_links(nodes: DataFrame, comp: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between different components: every pair of a run with enough equal bytes is confirmed on full sets.

    A run is all rows that share the first bytes in a tree. It is cut into blocks of about REGION rows, a large component into
    blocks of its own, and each pair of blocks is compared in a cell of its own unless both hold one and the same component.
    A first pass over the cells only names the rows that have a near row there; those rows' sets go to the cells, where
    pairs are found again and confirmed. So no pair is written but the links, and those of a cell are a spanning set.
    """
    least, depth = bounds(percent)
    labelled = nodes.select("fp", "sig", "n").join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    labelled = materialize(run_numbers(labelled, depth))
    rows = labelled.select("fp", "comp", "n", F.explode("runs").alias("run"))
    name = F.xxhash64("comp")
    mixed = materialize(rows.groupBy("run").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b").select("run"))
    mixed = F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed
    rows = rows.join(mixed, "run")
    sizes = rows.groupBy("run", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("big", (F.col("m") > REGION // 2) | (F.col("w") > CELL_SHINGLES // 2))
    small = sizes.groupBy("run").agg(*[F.sum(F.when(F.col("big"), 0).otherwise(F.col(c))).alias(f"{c}_rest") for c in "mw"])
    parts = lambda m, w: F.greatest(F.lit(1), F.ceil(F.col(m) / REGION), F.ceil(F.col(w) / CELL_SHINGLES))
    block = F.when(F.col("big"), F.concat_ws("/", F.hex("comp"), F.pmod(F.xxhash64("fp"), parts("m", "w")))).otherwise(F.pmod(name, parts("m_rest", "w_rest")).cast("string"))
    rows = materialize(rows.join(sizes, ["run", "comp"]).join(small, "run").select("fp", "run", block.alias("block"), F.when(F.col("big"), F.col("comp")).alias("own")))
    blocks = rows.select("run", "block", "own").distinct()
    both = blocks.join(blocks.select("run", F.col("block").alias("other"), F.col("own").alias("others")), "run")
    both = both.where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("own") == F.col("others"), F.lit(False)))
    cell = F.concat_ws(":", "run", "block", "other")
    dealt = both.select("run", cell.alias("cell"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    sent = rows.join(dealt, ["run", "block"]).select("cell", "run", "block", "fp").join(labelled.select("fp", "comp", "sig"), "fp")

    def run(batches):
        cell, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "run", "block", "fp", "comp", "sig"))):
                if row[0] != cell:
                    yield from named(held)
                    cell, held = row[0], []
                held.append(row)
        yield from named(held)
        give_back()

    def named(held: list[tuple]):
        _, runs, sides, _, comps, sigs = zip(*held) if held else [()] * 6
        i, j, _ = near_pairs(runs, sides, comps, sigs, least, depth)
        if len(i):
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*(held[k] for k in np.unique(np.r_[i, j]).tolist())))), schema=schema)

    schema = pa.schema([("cell", pa.string()), ("run", pa.int64()), ("block", pa.string()), ("fp", pa.binary()), ("comp", pa.binary()), ("sig", pa.binary())])
    members = materialize(sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, MEMBER))
    sets = sent_sets(members.select("fp", "cell"), nodes, docs, width)

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have, fps, comps = {fp: np.frombuffer(x, np.uint64) for fp, x in zip(right["fp"], right["found"])}, left["fp"].tolist(), left["comp"].tolist()
        i, j, equal = near_pairs(left["run"].tolist(), left["block"].tolist(), comps, left["sig"].tolist(), least, depth)
        order = np.argsort(-equal, kind="stable")
        return spanning(((fps[a], fps[b], comps[a], comps[b]) for a, b in zip(i[order].tolist(), j[order].tolist())), have, percent)

    return members.groupBy("cell").cogroup(sets.groupBy("cell")).applyInPandas(check, "u binary, v binary")


def near_pairs(runs, sides, comps, sigs, least: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of a cell's rows, of its two blocks or within its only one, with enough equal bytes and different
    components, and their equal bytes; a pair only in its first common run."""
    none = np.empty(0, np.int64)
    if len(runs) < 2:
        return none, none, none
    tree = runs[0] >> 8 * depth
    sigs = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, N_HASH)
    comp, side = (np.unique(np.array(x, object), return_inverse=True)[1] for x in (comps, sides))
    one = side.max() == 0
    left, right = (np.arange(len(runs)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step, found = max(1, (4 << 20) // (N_HASH * len(right))), []
    for at in range(0, len(left), step):
        some = left[at : at + step]
        equal = np.count_nonzero(sigs[some, None, :] == sigs[None, right, :], axis=2)
        i, j = np.nonzero((equal >= least) & (comp[some, None] != comp[None, right]))
        value, i, j = equal[i, j], some[i], right[j]
        new = i < j if one else np.ones(len(i), bool)
        for t in range(tree if len(i) else 0):
            new &= _run(sigs[i], t, depth) != _run(sigs[j], t, depth)
        found.append((i[new], j[new], value[new]))
    return tuple(np.concatenate(x) for x in zip(*found))


def spanning(pairs, have: dict, percent: int) -> pd.DataFrame:
    """Of (u, v, group of u, group of v) in turn those that are similar enough on full sets and join two groups."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for u, v, g, h in pairs:
        a, b = root(g), root(h)
        if a != b:
            x, y = have[u], have[v]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[max(a, b)] = min(a, b)
                    out.append((u, v))
    return pd.DataFrame(out, columns=["u", "v"])


def sent_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cell, fp, found): the shingle set of each wanted (fp, cell), made from the text of one document of the node."""
    cells = wanted.groupBy("fp").agg(F.collect_set("cell").alias("cells"))
    to = materialize(cells.join(nodes.select("fp", "id", "key"), "fp").select(F.col("id").alias("to_id"), F.col("key").alias("to_key"), "fp", "cells"))
    to = F.broadcast(to) if to.count() <= BROADCAST_ROWS else to
    texts = docs.join(to, (F.col("key") == F.col("to_key")) & F.col("id").eqNullSafe(F.col("to_id")))

    def make():
        cache = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            out = {"cell": [], "fp": [], "found": []}
            for fp, cells_, text in zip(*(batch.column(c).to_pylist() for c in ("fp", "cells", "text"))):
                found = shingle_set(text, width, cache).tobytes()
                for cell in cells_:
                    out["cell"].append(cell), out["fp"].append(fp), out["found"].append(found)
            return out

        return work

    return arrow_map(texts.select("fp", "cells", "text"), make, "cell string, fp binary, found binary")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v), or a spanning subset of them, whose full sets pass 100 * intersection >= percent * union.

    Each candidate component is confirmed in one task, or by pairs of blocks of it if it has over CELL members or CELL_SHINGLES
    shingles, so that a set travels once rather than once a pair; pairs already joined within a task are skipped.
    """
    comp = materialize(components(pairs).join(nodes.select(F.col("fp").alias("node"), "n"), "node"))
    wide = comp.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).alias("blocks"))
    cells = comp.join(wide, "comp").select("node", "comp", "n", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    at = lambda side: cells.select(F.col("node").alias(side), "comp", F.col("n").alias(f"n_{side}"), F.col("block").alias(f"b_{side}"))
    dealt = pairs.join(at("u"), "u").join(at("v").drop("comp"), "v")
    dealt = dealt.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))  # else the sets can't be similar enough
    dealt = materialize(dealt.select("u", "v", "equal", F.concat_ws(":", F.hex("comp"), F.least("b_u", "b_v"), F.greatest("b_u", "b_v")).alias("cell")))
    sets = sent_sets(dealt.select(F.col("u").alias("fp"), "cell").unionAll(dealt.select(F.col("v").alias("fp"), "cell")), nodes, docs, width)

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have = {fp: np.frombuffer(x, np.uint64) for fp, x in zip(right["fp"], right["found"])}
        left = left.sort_values(["equal", "u", "v"], ascending=[False, True, True])
        return spanning(zip(left["u"], left["v"], left["u"], left["v"]), have, percent)

    return dealt.groupBy("cell").cogroup(sets.groupBy("cell")).applyInPandas(check, "u binary, v binary")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", width: int = 5, percent: int = 85, row_col: str | None = None) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id of the linked group), kept.

    Rows with equal shingle sets collapse to one node; nodes are linked when 100 * intersection >=
    percent * union on full sets. Null, empty and blank texts have no shingles and link with nothing: their
    component is their own id. Repeated rows and ids each keep their row; a null id never is a component's
    smallest unless all its ids are null, and ``kept`` compares null-safely. An empty table gives no rows;
    other columns are ignored. With row_col, the column of a unique, stable row key, the result has it as ``row``, and
    ``stays`` marks the one row of each component with the smallest id, then key, and every row without shingles.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = {} if row_col is None else {"row": row_col}
    base = picked(docs, id=id_col, text=text_col, **own).withColumn("key", F.xxhash64("text"))
    rows = materialize(sketches(base, width, kind))
    base = base.drop("row")
    first = F.min(F.struct("id", "key"))
    nodes = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("low"), first.alias("row"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = materialize(nodes.select("fp", "low", "row.id", "row.key", "sig", "n"))
    parts = max(spark.sparkContext.defaultParallelism, -(-nodes.count() * N_TREES // 40_000))
    keys = materialize(ordered_keys(nodes.select("sig", "fp")))
    pairs = materialize(candidate_pairs(keys.repartitionByRange(parts, "key").sortWithinPartitions("key"), percent))
    links = materialize(confirmed(pairs, base, nodes, width, percent))
    comp = materialize(components(links))
    left = materialize(left_links(nodes, comp, base, width, percent))  # else each task holds two Python workers, which live on
    comp = materialize(components(links.unionAll(left)))
    named = nodes.select("fp", "low").join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component"))
    of = named.join(lowest, "comp").select("fp", "component")
    found = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component"))
    out = rows.select("id", "n", "fp", *own).join(of, "fp", "left").withColumn("component_id", found)
    columns = ["id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")]
    if row_col is None:
        return out.select(*columns)
    order = F.struct(F.col("id").isNull(), "id", "row")
    best = rows.where("fp is not null").groupBy("fp").agg(F.min(order).alias("best")).join(named.select("fp", "comp"), "fp")
    best = best.groupBy("comp").agg(F.min("best").alias("best")).select(F.col("best.row").alias("first"))
    out = out.select("row", "fp", *columns).join(best, F.col("row") == F.col("first"), "left")
    return out.select("id", "row", "n_shingles", "component_id", "kept", (F.col("fp").isNull() | F.col("first").isNotNull()).alias("stays"))
