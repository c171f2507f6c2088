"""SentencePiece (BPE model) encoding and decoding by suffix-array matching and edge relaxation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, picked

#: The vocabulary file's place; its bytes (bounded by MODEL_BYTES) are broadcast.
MODEL_PATH, MODEL_BYTES = "/opt/tokenizers/piece_bpe_32k.model", 32 << 20
#: Characters that one suffix array indexes, bytes of texts encoded at once, pairs of pieces whose verdict a worker keeps
#: for long units, and slots for those of other units.
INDEX_CHARS, AT_ONCE, KEPT_PAIRS, SLOTS = 1 << 17, 1 << 19, 300_000, 1 << 21
#: Characters from which a unit is settled position by position; code points whose pairs are looked up in a table.
LONG, NEAR = 64, 512
#: Stands between units of an indexed text; no text has a lone surrogate.
BETWEEN = "\ud800"
_WORKERS: dict[bytes, Encoder] = {}


class Vocabulary:
    """Pieces, scores and byte pieces of a BPE model with identity normalisation, a space before the text, and byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = len(model)
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.size = n
        self.out = [b""] * n
        for p, i in self.ids.items():
            self.out[i] = p.replace("▁", " ").encode()
        for b, i in self.byte_ids.items():
            self.out[i] = bytes([b])

    def merge(self, text: str, least: int = 1) -> list[str]:
        """BPE by definition: join the neighbours whose union has the best score, leftmost among equals, until none is a piece.
        least: stop at so many parts."""
        parts, get, none = list(text), self.scores.get, -float("inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.out.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


class Encoder:
    """Encodes texts by units: a run of spaces and what follows, cut further wherever no piece holds both neighbours.

    BPE has the prefix property: a prefix's last piece is the one piece t that ends there, whose start is reached by a
    piece s, such that s and t stay apart when s + t is encoded. So edges (occurrences of pieces), taken by end
    position, settle each position with exactly one piece. Runs of spaces have equal scores, so ties between them go by place; see _spaced.
    """

    def __init__(self, proto: bytes):
        v = self.v = Vocabulary(proto)
        self.unk = v.size  # stands for a character without a piece
        names = sorted(p for p in v.ids if "▁" not in p[1:])
        self.sizes = np.array([len(p) for p in names], np.int32)
        self.longest = int(self.sizes.max())
        self.spelled = np.array([[ord(c) for c in p] + [0] * (self.longest - len(p)) for p in names], np.int64)
        self.name_ids = np.array([v.ids[p] for p in names], np.int32)
        inside = {p[k : k + 2] for p in names for k in range(len(p) - 1)}  # neighbours within pieces
        self.joined = np.unique(np.array([ord(x) << 21 | ord(y) for x, y in inside], np.int64))
        self.near = np.zeros((NEAR, NEAR), bool)
        for x, y in inside:
            if ord(x) < NEAR and ord(y) < NEAR:
                self.near[ord(x), ord(y)] = True
        self.text = [""] * (v.size + 1)
        for p, i in v.ids.items():
            self.text[i] = p
        self.first = np.array([ord(t[0]) if t else 0 for t in self.text], np.int64)
        self.last = np.array([ord(t[-1]) if t else 0 for t in self.text], np.int64)
        self._history()
        self.slots, self.verdict = np.full(SLOTS, -1, np.int32), np.zeros(SLOTS, bool)
        self.apart_: dict[int, bool] = {}
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in v.out])]).astype(np.int64)
        self.out_bytes = np.frombuffer(b"".join(v.out), np.uint8)

    def _history(self) -> None:
        """When and of which two parts each piece is merged, whether it encodes to itself, and every pair whose union is a piece."""
        v, n = self.v, self.unk + 1
        self.whole, self.when, self.parts = np.ones(n, bool), np.zeros(n, np.int32), np.full((n, 2), -1, np.int32)
        order = sorted(v.ids, key=lambda p: (-v.scores[p], v.ids[p]))
        at, turn, before = {}, 0, None
        for p in order:  # equal scores are equally early
            turn += v.scores[p] != before
            at[p], before = turn, v.scores[p]
        pairs = {}
        for p, i in v.ids.items():
            for k in range(1, len(p)):
                if p[:k] in v.ids and p[k:] in v.ids:
                    pairs[v.ids[p[:k]] * n + v.ids[p[k:]]] = at[p]
            if len(p) > 1:
                left = v.merge(p, 2)
                self.whole[i] = len(left) == 2
                if len(left) == 2:
                    self.when[i], self.parts[i] = at[p], [v.ids[x] for x in left]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_when = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)

    def _stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces stay apart side by side: their merges are undone, the later first, and at each state the two that
        touch must not have been merged sooner than the merge that was just undone."""
        n = self.unk + 1
        out, go = np.ones(len(left), bool), np.arange(len(left))
        x, y, limit = left.astype(np.int64), right.astype(np.int64), np.full(len(left), 1 << 30)
        while len(go):
            keys = x * n + y
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined = (self.pairs[at] == keys) & (self.pair_when[at] < limit)
            out[go[joined]] = False
            a, b = self.when[x], self.when[y]
            first = a > b
            on = ~joined & (first | (b > 0))
            limit = np.where(first, a, b + 1)[on]
            x, y = np.where(first, self.parts[x, 1], x)[on], np.where(first, y, self.parts[y, 0])[on]
            go = go[on]
        return out

    def _within(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring characters, whether some piece holds them so."""
        near = (x < NEAR) & (y < NEAR)
        out = self.near[np.where(near, x, 0), np.where(near, y, 0)] & near
        far = np.flatnonzero(~near)
        if len(far):
            keys = x[far].astype(np.int64) << 21 | y[far]
            out[far] = self.joined[np.minimum(np.searchsorted(self.joined, keys), len(self.joined) - 1)] == keys
        return out

    def _stay(self, key: int) -> bool:
        """Whether two pieces stay apart side by side; key: left * (unk + 1) + right."""
        ok = self.apart_.get(key)
        if ok is None:
            if len(self.apart_) > KEPT_PAIRS:
                self.apart_.clear()
            a, b = divmod(key, self.unk + 1)
            ok = self.apart_[key] = a == self.unk or b == self.unk or self.v.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return ok

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * np.int32(self.unk + 1) + right
        at = (keys.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)
        new = np.flatnonzero(self.slots[at] != keys)
        out = self.verdict[at]
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            said = self._stays(left[new[first]], right[new[first]])
            out[new] = said[back]
            self.slots[at[new[first]]] = fresh
            self.verdict[at[new[first]]] = said
            clash = self.slots[at[new[first]]] != fresh  # two in one slot: the last one's key and verdict belong together
            self.slots[at[new[first]][clash]] = -1
        return out

    def edges(self, chars: np.ndarray):
        """(start, end, piece) of every occurrence of a piece that encodes to itself, and of every character without a piece.

        The suffixes of chars are sorted by their first ``longest`` characters, held as a few numbers each; a binary search in
        each number's column in turn narrows every piece to its range of suffixes. BETWEEN has no piece.
        """
        alphabet, code = np.unique(chars, return_inverse=True)
        n, bits = len(chars), int(len(alphabet) + 1).bit_length()
        span = min(self.longest, 62 // bits)  # characters a number holds
        padded = np.concatenate([code.astype(np.int64) + 1, np.zeros(self.longest + span, np.int64)])
        one = np.zeros(n + self.longest, np.int64)
        for k in range(span):
            one = one << bits | padded[k : k + len(one)]
        levels = range(0, self.longest, span)
        order = np.lexsort([one[k : k + n] for k in reversed(levels)])
        at = np.searchsorted(alphabet, self.spelled)
        spelled = np.where(self.spelled > 0, at + 1, 0)
        known = ((self.spelled == 0) | (alphabet[np.minimum(at, len(alphabet) - 1)] == self.spelled)).all(axis=1)
        use = np.flatnonzero(known & self.whole[self.name_ids])
        spelled, sizes = spelled[use], self.sizes[use]
        low, high = np.zeros(len(use), np.int64), np.full(len(use), n, np.int64)
        for k in levels:
            column, go = one[k : k + n][order], np.flatnonzero(sizes > k)
            least, most = np.zeros(len(go), np.int64), np.zeros(len(go), np.int64)
            for j in range(k, k + span):
                c = spelled[go, j] if j < self.longest else 0
                open_ = sizes[go] <= j
                least, most = least << bits | np.where(open_, 0, c), most << bits | np.where(open_, (1 << bits) - 1, c)
            low[go], high[go] = _search(column, least, low[go], high[go], False), _search(column, most, low[go], high[go], True)
        count = high - low
        which = np.repeat(np.arange(len(use), dtype=np.int32), count)
        start = order.astype(np.int32)[np.arange(len(which), dtype=np.int32) - np.repeat((np.cumsum(count) - count - low).astype(np.int32), count)]
        alone = np.flatnonzero(np.array([chr(c) not in self.v.ids and c != ord(BETWEEN) for c in alphabet.tolist()], bool)[code]).astype(np.int32)
        return np.r_[start, alone], np.r_[start + sizes[which], alone + 1], np.r_[self.name_ids[use][which], np.full(len(alone), self.unk, np.int32)]

    def _units(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units within chars, each unit's followed by the next's, and how many each has."""
        a, b, piece = self.edges(chars)
        last, came = np.full(len(chars) + 1, -1, np.int32), np.zeros(len(chars) + 1, np.int32)
        unit_at = np.full(len(chars), -1, np.int32)
        unit_at[_spread(starts, sizes)] = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        short = (sizes <= LONG)[unit_at[a]]
        step = b - starts[unit_at[a]]
        order = np.flatnonzero(short)
        order = order[np.argsort(step[order].astype(np.int16), kind="stable")]
        head = a == starts[unit_at[a]]
        i, j, t, h, s = a[order], b[order], piece[order], head[order], step[order]
        cuts = np.flatnonzero(np.diff(s, prepend=-1, append=-1)) if len(s) else np.empty(0, np.int64)
        for lo, hi in zip(cuts, cuts[1:]):  # edges that end at the same place of their units
            good = h[lo:hi].copy()
            rest = np.flatnonzero(~good)
            good[rest] = self._apart(last[i[lo:hi][rest]], t[lo:hi][rest])
            last[j[lo:hi][good]], came[j[lo:hi][good]] = t[lo:hi][good], i[lo:hi][good]
        rest = np.flatnonzero(~short)
        rest = rest[np.argsort(b[rest], kind="stable")]
        settled: dict[int, int] = {}
        for i, j, t, h in zip(a[rest].tolist(), b[rest].tolist(), piece[rest].tolist(), head[rest].tolist()):  # long units, by end position
            if j not in settled and (h or self._stay(settled[i] * (self.unk + 1) + t)):
                settled[j] = t
                last[j], came[j] = t, i
        ends = starts + sizes
        if (last[ends] < 0).any():
            raise AssertionError("a unit has an end that no piece reaches")
        on_path = np.zeros(len(chars) + 1, bool)
        at, begin = ends, starts
        while len(at):  # back from every unit's end, a piece at a time
            on_path[at] = True
            at = came[at]
            more = at > begin
            at, begin = at[more], begin[more]
        places = np.flatnonzero(on_path)
        return self._bytes(last[places], chars[places - 1], unit_at[places - 1], len(starts))

    def _bytes(self, ids: np.ndarray, char: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes."""
        lone = np.flatnonzero(ids == self.unk)
        if len(lone):
            spelled = [[self.v.byte_ids[y] for y in chr(c).encode()] for c in char[lone].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[lone] = [len(x) for x in spelled]
            ids, unit = np.repeat(ids, wide), np.repeat(unit, wide)
            ids[ids == self.unk] = np.concatenate(spelled)
        return ids, np.bincount(unit, minlength=n)

    def _spaced(self, n: int, headed: bool) -> list[int]:
        """Pieces of n spaces before a unit. Runs of spaces have the least score, so a word and its own space are merged first;
        then spaces join from the left wherever the joined run is a piece."""
        runs: list[int] = []
        for _ in range(n - headed):
            runs.append(1)
            while len(runs) > 1 and "▁" * (runs[-2] + runs[-1]) in self.v.ids:
                runs[-2:] = [runs[-2] + runs[-1]]
        return [self.v.ids["▁" * k] for k in runs]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and where each text's begin (one more entry than texts)."""
        full = [t for t in texts if t]
        text = BETWEEN.join("▁" + t for t in full).replace(" ", "▁") + BETWEEN
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        space, gap = chars == ord("▁"), chars == ord(BETWEEN)
        before = np.r_[True, ~space[:-1]]  # what stands before is no space, or the text's beginning
        new = space & before
        new[0] = True
        new[1:] |= ~space[1:] & ~gap[1:] & ~space[:-1] & ~self._within(chars[:-1], chars[1:])
        new[1:] |= gap[1:]  # the separator is a unit of its own, so that each ends before it
        starts = np.flatnonzero(new).astype(np.int32)
        sizes = np.diff(starts, append=np.int32(len(chars)))
        number, reps = self._distinct(chars, starts, sizes)
        ids, count = self._encode_distinct(chars, starts[reps], sizes[reps])
        first = np.cumsum(count) - count
        flat = ids[_spread(first[number], count[number])]
        doc = (np.cumsum(gap, dtype=np.int32) - gap)[starts]  # texts that have ended before each unit
        per = np.zeros(len(texts), np.int64)
        per[[k for k, t in enumerate(texts) if t]] = np.bincount(doc, weights=count[number], minlength=len(full)).astype(np.int64) if full else 0
        return flat, np.concatenate([[0], np.cumsum(per)])

    def _distinct(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Number of each unit among the distinct ones, and one unit of each: by hashes, which are checked character by character."""
        seed, name = 0x9E3779B97F4A7C15, np.empty(len(starts), np.uint64)
        blocks = [(lo, hi, int(starts[lo]), int(starts[hi - 1] + sizes[hi - 1])) for lo, hi in _blocks(np.cumsum(sizes), INDEX_CHARS)]
        while True:
            power = np.cumprod(np.full(int(sizes.max()), seed, np.uint64))
            for lo, hi, a, b in blocks:
                mixed = power[np.arange(a, b) - np.repeat(starts[lo:hi], sizes[lo:hi])]
                mixed *= chars[a:b].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)
                name[lo:hi] = np.add.reduceat(mixed, starts[lo:hi] - a)
            name ^= name >> np.uint64(31)
            _, reps, number = np.unique(name, return_index=True, return_inverse=True)
            other = reps[number]
            if (sizes[other] == sizes).all() and all((chars[_spread(starts[other[lo:hi]], sizes[lo:hi])] == chars[a:b]).all() for lo, hi, a, b in blocks):
                return number, reps
            seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64 | 1

    def _encode_distinct(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of distinct units, some INDEX_CHARS of them indexed at once, and how many each has: none of the separator."""
        sizes = np.where(chars[starts] == ord(BETWEEN), 0, sizes)
        spaces = np.zeros(len(starts), np.int64)
        second = np.flatnonzero((sizes > 1) & (chars[starts] == ord("▁")))
        second = second[chars[starts[second] + 1] == ord("▁")]
        for k in second.tolist():
            run = chars[starts[k] : starts[k] + sizes[k]] != ord("▁")
            spaces[k] = int(run.argmax()) if run.any() else sizes[k]
        skip = np.maximum(spaces - 1, 0)  # of several spaces the word's own stays with it
        skip[spaces == sizes] = sizes[spaces == sizes]
        own, wide = starts + skip, sizes - skip
        out, count = [], np.zeros(len(starts), np.int64)
        some = np.flatnonzero(wide)
        load = np.cumsum(wide[some] + 1)
        for lo, hi in _blocks(load, INDEX_CHARS):
            use = some[lo:hi]
            padded = np.full(int((wide[use] + 1).sum()), ord(BETWEEN), np.int32)
            begins = np.cumsum(wide[use] + 1) - wide[use] - 1
            padded[_spread(begins, wide[use])] = chars[_spread(own[use], wide[use])]
            ids, n = self._units(padded, begins, wide[use])
            count[use] = n
            out.append(ids)
        ids = np.concatenate(out) if out else np.empty(0, np.int32)
        if not len(second):
            return ids, count
        first, parts = np.cumsum(count) - count, []
        at = 0
        for k in second.tolist():  # a lone space before a word joins the spaces before it
            lo, hi = int(first[k]), int(first[k] + count[k])
            parts.append(ids[at:lo])
            alone = hi > lo and ids[lo] == self.v.ids["▁"]
            lead = self._spaced(int(spaces[k]), hi > lo and not alone)
            parts.append(np.array(lead, np.int32))
            at = lo + alone
            count[k] += len(lead) - alone
        return np.concatenate([*parts, ids[at:]]).astype(np.int32), count

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, at = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(at, at[1:])]

    def spelled_out(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the ids decode to, and where each text's begin, the space before it included."""
        wide = np.diff(self.out_at)[flat]
        ends = np.concatenate([[0], np.cumsum(wide)])
        return self.out_bytes[_spread(self.out_at[flat], wide)], ends[at]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges in turn."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends):
        return np.empty(0, np.int32)
    kind = np.int32 if max(int(ends[-1]), int((starts + sizes).max())) < 1 << 31 else np.int64  # half the memory
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(len(out), dtype=kind)
    return out


def _blocks(load: np.ndarray, size: int):
    """Ranges of entries whose running total ``load`` grows by about size; at least one entry each."""
    lo = 0
    while lo < len(load):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def _search(column: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search for each value in its own sorted range low..high of the column."""
    low, high = low.copy(), high.copy()
    while (go := np.flatnonzero(low < high)).size:
        mid = (low[go] + high[go]) // 2
        up = column[mid] <= value[go] if right else column[mid] < value[go]
        low[go] = np.where(up, mid + 1, low[go])
        high[go] = np.where(up, high[go], mid)
    return low


def encoder(proto: bytes) -> Encoder:
    key = hashlib.sha256(proto).digest()
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Encoder(proto)
    return _WORKERS[key]


def encode_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", model_path: str = MODEL_PATH, ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip, and the ids if asked for.

    round_trip: whether decoding the ids gives the text's bytes back; false only for texts with the character U+2581, which
    the model writes for a space. Null and empty texts have no ids; repeated rows are encoded alike; an empty table gives no
    rows; other columns are ignored unless in ``keep`` (then they follow, prefixed ``c_``).
    """
    with open(model_path, "rb") as f:
        proto = f.read(MODEL_BYTES + 1)
    if len(proto) > MODEL_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def make():
        use = encoder(shared.value)

        def work(column: pa.Array) -> dict:
            texts = [t or "" for t in column.to_pylist()]
            flat, at = use.encode_flat(texts)
            said, ends = use.spelled_out(flat, at)
            flat = flat.astype("<i4")
            same = [said[lo + 1 : hi].tobytes() == t.encode() for t, lo, hi in zip(texts, ends.tolist(), ends[1:].tolist())]
            digests = [hashlib.sha256(flat[lo:hi]).hexdigest() for lo, hi in zip(at.tolist(), at[1:].tolist())]
            return {"n_tokens": np.diff(at), "ids_sha256": digests, "round_trip": same, "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))}

        return work

    base = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), *[docs[f"`{c}`"].alias(f"c_{c}") for c in keep])
    coded = base.withColumn("t", arrow_column(docs.sparkSession, make, "struct<n_tokens:bigint,ids_sha256:string,round_trip:boolean,ids:array<int>>", F.col("text"), slice_bytes=AT_ONCE))
    return coded.select("id", *[f"t.{c}" for c in ("n_tokens", "ids_sha256", "round_trip", *(["ids"] if ids else []))], *[f"c_{c}" for c in keep])


def decode_documents(encoded: DataFrame, *, id_col="id", ids_col="ids", model_path: str = MODEL_PATH) -> DataFrame:
    """Per row: id, text from ids (null: empty); bytes that are no UTF-8 become U+FFFD."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read(MODEL_BYTES))

    def make():
        v = encoder(shared.value).v

        def work(batch: pa.RecordBatch) -> dict:
            return {"id": batch.column("id"), "text": [v.decode(x or ()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]}

        return work

    return arrow_map(picked(encoded, id=id_col, ids=ids_col), make, f"id {encoded.schema[id_col].dataType.simpleString()}, text string")
