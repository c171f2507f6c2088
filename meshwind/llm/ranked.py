"""Ranked lexical search: an inverted index whose postings become treaps, doc order across and impact order down."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, picked, slices, small_batches

#: Bytes of text of a shard of the index, and of a batch that is cut into terms at once.
SHARD_BYTES, AT_ONCE = 16 << 20, 4 << 20
#: Terms of the queries that one block holds (they are broadcast); postings of the queries that are traversed together.
BLOCK_TERMS, POSTINGS_AT_ONCE = 100_000, 400_000
#: Shards that are searched first for a score that the rest must reach.
FIRST_SHARDS = 6
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term string, df int, places array<int>, counts array<int>, ids array<{id}>"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in turn, and each text's number of terms."""
    texts = texts.fill_null("").cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.large_string())
    data = texts.buffers()[2]
    folded = pa.py_buffer(data.to_pybytes().translate(_FOLD) if data else b"")
    words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], folded]))
    flat = words.flatten()
    whole = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    return flat.filter(whole), np.bincount(owner[whole.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _shard(name: int, terms: pa.ChunkedArray, sizes: np.ndarray, ids: pa.Array, schema: pa.Schema):
    """Record batches of a shard: its documents (null term: ids, and counts of terms), then a row a term."""
    whole = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
    none = lambda n, kind: pa.nulls(n, kind)
    yield pa.RecordBatch.from_arrays([pa.array([name]), none(1, pa.string()), pa.array([len(sizes)], pa.int32()), none(1, schema.field("places").type), whole(sizes, pa.int32()), whole(ids, ids.type)], schema=schema)
    coded = terms.combine_chunks().dictionary_encode()
    if not len(coded):
        return
    wide = len(sizes)
    pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * wide + np.repeat(np.arange(wide), sizes), return_counts=True)
    code, place = np.divmod(pairs, wide)
    stops = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
    names, step = coded.dictionary.cast(pa.string()), 20_000
    for at in range(0, len(names), step):
        ends = stops[at : at + step + 1]
        lists = lambda a: pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(a[ends[0] : ends[-1]].astype(np.int32)))  # noqa: E731, B023
        part = names.slice(at, step)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), part, pa.array(np.diff(ends).astype(np.int32)), lists(place), lists(counts), none(len(part), schema.field("ids").type)], schema=schema)


def build_index(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The inverted index of all texts, written as a table.

    Each shard, about SHARD_BYTES of text, has one row for its documents (term null: their ids, counts of terms) and one a
    term: df, places of the documents that hold it in the shard, ascending, and how often. Null and empty texts are documents
    without terms. A very long text makes a large shard of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    field = docs.schema[id_col].dataType
    kind = to_arrow_type(field)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(kind))])

    def run(batches):
        name, terms, sizes, ids, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def made():
            yield from _shard(name, pa.chunked_array(terms, pa.large_string()), np.concatenate(sizes), pa.concat_arrays(ids).cast(kind), schema)

        for batch in batches:
            for part in slices(batch, AT_ONCE):
                found, n = terms_of(part.column("text"))
                terms.append(found), sizes.append(n), ids.append(part.column("id"))
                size += part.nbytes
                if size >= SHARD_BYTES:
                    yield from made()
                    name, terms, sizes, ids, size = name + 1, [], [], [], 0
        if ids:
            yield from made()
        del terms, sizes, ids
        give_back()

    return materialize(picked(docs, id=id_col, text=text_col).mapInArrow(run, INDEX.format(id=field.simpleString())))


class Treaps:
    """One treap a term over a shard's postings: places in search order, impacts (ties by a mix of the place) in heap order."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray, stops: np.ndarray):
        self.place, self.impact = places, impacts
        mixed = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        keys = (impacts << 24 | mixed.astype(np.int64)).tolist()
        left, right, roots = [-1] * len(keys), [-1] * len(keys), []
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
            spine: list[int] = []  # the rightmost path
            for k in range(a, b):
                key, under = keys[k], -1
                while spine and keys[spine[-1]] < key:
                    under = spine.pop()
                left[k] = under
                if spine:
                    right[spine[-1]] = k
                spine.append(k)
            roots.append(spine[0] if spine else -1)
        # a last node stands for an empty subtree
        self.left, self.right, self.roots = np.array([*left, -1], np.int32), np.array([*right, -1], np.int32), np.array(roots, np.int32)

    def top(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each node's subtree the topmost node with low <= place < high, or -1."""
        nodes = nodes.copy()
        go = np.flatnonzero(nodes >= 0)
        while len(go):
            at = nodes[go]
            place = self.place[at]
            small, large = place < low[go], place >= high[go]
            go, at, small = go[small | large], at[small | large], small[small | large]
            nodes[go] = np.where(small, self.right[at], self.left[at])
            go = go[nodes[go] >= 0]
        return nodes


def _leaders(group: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are among the k largest values of their group, in order of group and value; and the place of each in it."""
    order = np.lexsort((-value, group))
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return order[rank < k], rank[rank < k]


def traverse(treaps: Treaps, weights: np.ndarray, query: np.ndarray, term: np.ndarray, least: np.ndarray, wide: int, k: int):
    """(query, place, score) of every document whose score reaches its query's k-th best: all treaps of a query at once.

    A state is a query and a range of places, with the topmost node in the range of each of its terms. Its bound, the
    sum of these nodes' weighted impacts, is a maximum over the range, and exact for a range of one. States below
    ``least`` (a lower bound of each query's k-th best score, raised on the way) are pruned with their subtrees, the others
    halved. The documents on top of the most promising ranges are scored at once, which raises the bound early.
    """
    least = least.copy()
    width = 1 << max(0, (wide - 1).bit_length())
    node = treaps.roots[term]
    query, term, node = query[node >= 0], term[node >= 0], node[node >= 0]
    owner, at = np.unique(query, return_inverse=True)  # a state's query; an entry's state
    low = np.zeros(len(owner), np.int64)
    order = np.argsort(at, kind="stable")
    at, node, weight = at[order], node[order], weights[term[order]]
    while len(owner):
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        bound = np.add.reduceat(weight * treaps.impact[node], begin)
        if width > 1:
            some, rank = _leaders(owner, bound, k)
            full = some[rank == k - 1]  # only queries with k ranges
            chosen = np.isin(owner[some], owner[full])
            some = some[chosen]
            if len(some):
                number = np.full(len(owner), -1)
                number[some] = np.arange(len(some))
                use = number[at] >= 0
                mine, start = at[use], np.flatnonzero(np.diff(at[use], prepend=-1))
                value = weight[use] * treaps.impact[node[use]]
                high = np.repeat(np.maximum.reduceat(value, start), np.diff(np.append(start, len(value))))
                lead = np.zeros(len(owner), np.int64)
                lead[mine[value == high]] = treaps.place[node[use][value == high]]
                spot = treaps.top(node[use], lead[mine], lead[mine] + 1)
                exact = np.add.reduceat(np.where(spot >= 0, weight[use] * treaps.impact[spot], 0), start)
                ranked, place = _leaders(owner[mine[start]], exact, k)
                kth = ranked[place == k - 1]
                np.maximum.at(least, owner[mine[start]][kth], exact[kth])
        else:
            kth, rank = _leaders(owner, bound, k)
            kth = kth[rank == k - 1]
            np.maximum.at(least, owner[kth], bound[kth])
        good = (bound >= least[owner]) & (bound > 0)
        entries = good[at]
        number = np.cumsum(good) - 1
        owner, low, bound = owner[good], low[good], bound[good]
        at, node, weight = number[at[entries]], node[entries], weight[entries]
        if width == 1:
            return owner, low, bound
        width //= 2
        first = low[at]
        # children of a state stand side by side, so that entries stay in order of states
        both = np.concatenate([2 * at, 2 * at + 1])
        nodes = np.concatenate([treaps.top(node, first, first + width), treaps.top(node, first + width, first + 2 * width)])
        order = np.argsort(both, kind="stable")
        order = order[nodes[order] >= 0]
        states, at = np.unique(both[order], return_inverse=True)
        node, weight = nodes[order], np.concatenate([weight, weight])[order]
        owner, low = owner[states // 2], low[states // 2] + states % 2 * width
    return owner, low, np.zeros(0, np.int64)


def _search(block, n_docs: int, n_terms: int, k: int, kind: pa.DataType):
    """A shard's rows of the block's terms to (query, doc_id, score) of the documents that can be among the best k."""

    def run(shard: pa.Table) -> pa.Table:
        queries, stops, terms, weights, least = block.value
        shard = shard.combine_chunks()
        idx = shard.column("idx").fill_null(-1).to_numpy()
        home = int(np.flatnonzero(idx < 0)[0])
        ids, sizes = shard.column("ids")[home].values, shard.column("counts")[home].values.to_numpy().astype(np.int64)
        rows = shard.take(pa.array(np.flatnonzero(idx >= 0))).combine_chunks()
        idx = idx[idx >= 0]
        flat = lambda c: np.concatenate([np.empty(0, np.int64), *[x.flatten().to_numpy() for x in rows.column(c).chunks]]).astype(np.int64)
        places, times = flat("places"), flat("counts")
        length = np.diff(np.concatenate([[0], np.cumsum(rows.column("df").to_numpy())]))
        m = 100 - 50 + 50 * sizes * n_docs // max(1, n_terms)
        treaps = Treaps(places, 1_000_000_000 * times // (1000 * times + 20 * m[places]), np.concatenate([[0], np.cumsum(length)]))
        spot = np.full(len(weights), -1)  # the row of a term in this shard
        spot[idx] = np.arange(len(idx))
        query, term = np.repeat(np.arange(len(queries)), np.diff(stops)), spot[terms]
        weight = weights[idx]
        query, term = query[term >= 0], term[term >= 0]
        cost = np.cumsum(np.bincount(query, length[term], len(queries)))
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy().astype(np.int64)] = np.arange(len(ids))  # null ids are last
        out = []
        group = (cost // POSTINGS_AT_ONCE).astype(np.int64)
        for g in np.unique(group[query]):
            use = group[query] == g
            q, place, score = traverse(treaps, weight, query[use], term[use], least, len(ids), k)
            order = np.lexsort((rank[place], -score, q))
            new = np.flatnonzero(np.diff(q[order], prepend=-1))
            order = order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < k]
            out.append((queries[q[order]], place[order], score[order]))
        q, place, score = (np.concatenate([np.empty(0, np.int64), *[x[c] for x in out]]) for c in range(3))
        return pa.table({"query": q, "doc_id": ids.take(pa.array(place)).cast(kind), "score": score})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, *, k: int = 50, item_col="item_id", text_col="text") -> DataFrame:
    """The k documents of the index with the highest scores above 0 for each item: item_id, rank, doc_id, score.

    Items are searched for in blocks of about BLOCK_TERMS terms, each over the whole index. Document counts come from the
    index: all documents with terms, all terms, and those that hold a term. A first few shards give a score that every
    item's k-th best document reaches at least; the other shards start pruning from it. Null and empty items have no rows;
    repeated rows of an item are searched for each; equal scores rank by doc_id, nulls last; an empty index gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    field, name = index.schema["ids"].dataType.elementType, items.schema[item_col].dataType.simpleString()
    homes = index.where("term is null")
    held = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    n_docs, n_terms = homes.agg(F.coalesce(F.sum(F.size(F.filter("counts", lambda x: x > 0))), F.lit(0)), F.coalesce(F.sum(held), F.lit(0))).first()
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = picked(items, item=item_col, text=text_col).select("item", F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
    asked = materialize(asked.where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    first = [r[0] for r in homes.select("shard").orderBy(F.xxhash64("shard"), "shard").limit(FIRST_SHARDS).collect()]
    out = []
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        rows = part.select("query", "terms").orderBy("query").collect()
        names = {t: i for i, t in enumerate(dict.fromkeys(t for r in rows for t in r["terms"]))}
        queries, stops = np.array([r["query"] for r in rows], np.int64), np.cumsum([0] + [len(r["terms"]) for r in rows])
        terms = np.array([names[t] for r in rows for t in r["terms"]], np.int64)
        known = F.broadcast(spark.createDataFrame(list(names.items()), "term string, idx int"))
        hits = index.join(known, "term", "left").where("term is null or idx is not null").select("shard", "idx", "df", "places", "counts", "ids")
        weights = np.zeros(len(names), np.int64)
        for i, df in index.select("term", "df").join(known, "term").groupBy("idx").agg(F.sum("df")).collect():
            weights[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        least = np.ones(len(queries), np.int64)

        def scored(some: DataFrame, least: np.ndarray) -> DataFrame:
            shared = spark.sparkContext.broadcast((queries, stops, terms, weights, least))  # noqa: B023
            made = _search(shared, n_docs, n_terms, k, to_arrow_type(field))
            return some.groupBy("shard").applyInArrow(made, f"query long, doc_id {field.simpleString()}, score long")

        early = materialize(_best(scored(hits.where(F.col("shard").isin(first)), least), k).drop("rank"))
        reached = early.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
        for query, kth in reached.select("query", "kth").collect():
            least[np.searchsorted(queries, query)] = kth
        late = scored(hits.where(~F.col("shard").isin(first)), least)
        best = materialize(_best(early.unionAll(late), k))
        out.append(best.join(part.select("query", "item"), "query").select(F.col("item").alias("item_id"), "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {name}, rank int, doc_id {field.simpleString()}, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def search_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op12 digest: the whole index of the documents, and each benchmark item's best 50 of them.

    Cases are those of build_index and search; other columns of both tables are ignored.
    """
    return search(build_index(docs), benchmark)
