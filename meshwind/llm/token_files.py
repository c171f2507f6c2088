"""Token ids as binary files: one array of ids, document boundaries and document ids in Elias-Fano form."""

from __future__ import annotations

import array
import json
import os
import string
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, picked, shared_dir, slices, small_batches
from .elias_fano import EliasFano, encode

#: The vocabulary file's place; its bytes (bounded by VOCABULARY_BYTES) are broadcast.
TOKENIZER_PATH, VOCABULARY_BYTES = "/opt/tokenizers/word_bpe_49k.json", 32 << 20
#: The id that ends each document.
END_ID = 1
#: A file is closed at so many bytes of ids or documents; a document is never split. Ids are read so many bytes at once.
FILE_BYTES, FILE_DOCS, READ_BYTES = 64 << 20, 1 << 19, 8 << 20
#: Bytes of texts encoded at once, words whose ids a worker keeps (the first it meets), characters of the longest of these.
AT_ONCE, KEPT_WORDS, KEPT_CHARS = 4 << 20, 500_000, 40
#: Places of the parts at a file's end: bytes of ids, of boundaries, of document ids; documents with a null id; the first id; bytes an id; mark.
_FOOT = struct.Struct("<QQQQqB3x4s")
_MARK = b"MWT1"
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"
_WORKERS: dict[str, WordEncoder] = {}


def _cut_table() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and whether a text is cut between two kinds: white space 0, letters 1, digits 2, marks 3,
    apostrophe 4, all else 5."""
    kinds = np.full(256, 5, np.uint8)
    for kind, chars in enumerate((b" \t\n\v\f\r", string.ascii_letters.encode(), string.digits.encode(), string.punctuation.encode(), b"'")):
        kinds[list(chars)] = kind
    cut = np.zeros((6, 6), bool)
    cut[0, 1:] = cut[1, 2:5] = cut[2, 1:5] = cut[3, 1:3] = cut[4, 2] = True
    return kinds, cut.reshape(-1)


_KINDS, _CUT = _cut_table()


#: Fixed values of the vocabulary's file: how it normalises and splits a text. With others, texts are encoded whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: Byte-level vocabularies write printable bytes as Latin-1 and the others, in turn, from U+0100 on.
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordEncoder:
    """Ids of texts from the ids of their distinct words.

    The vocabulary takes runs of letters, single digits and runs of marks apart, and drops white space. So texts are cut
    where that is sure whatever else they hold: after white space, and between ASCII letters, digits and marks, but not after an
    apostrophe (contractions), nor around other characters (normalisation), nor in texts that may hold special tokens.
    A word of Latin letters is normalised by writing it in small letters, so it goes to the model at once.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.kept = Tokenizer.from_str(vocabulary), {}
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        spec = json.loads(vocabulary)
        self.cuts = (spec["normalizer"] or {}).get("normalizers") == _NORMAL and (spec["pre_tokenizer"] or {}).get("pretokenizers") == _PIECES

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in turn, and where those of each text start."""
        texts = pa.concat_arrays([pa.array(["", ""], pa.large_string()), texts.fill_null("").cast(pa.large_string())])[2:]
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[2 : len(texts) + 3]
        data = texts.buffers()[2]
        kinds = _KINDS[np.frombuffer(data, np.uint8)[: offsets[-1]]] if data else np.empty(0, np.uint8)
        starts = np.ones(len(kinds) + 1, bool)
        starts[1:-1] = _CUT[kinds[:-1] * np.uint8(6) + kinds[1:]] if self.cuts else False
        for mark in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)):
                starts[offsets[k] + 1 : offsets[k + 1]] = False
        starts[offsets] = True
        edges = np.flatnonzero(starts)
        words = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), data])
        return words, np.searchsorted(edges, offsets)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, each text's closed by ``end``; and each text's number of ids, with the end."""
        words, starts = self._words(texts)
        coded = words.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if self.cuts:
            names = [w.rstrip(" \t\n\v\f\r") for w in names]
        ids = list(map(self.kept.get, names))
        new = [k for k, x in enumerate(ids) if x is None]
        rest, room, tokenize = [], len(self.kept) < KEPT_WORDS, self.model.model.tokenize
        for k in new:
            word = names[k]
            small = word.lower() if self.cuts and word.isalpha() and max(word) < "\u0180" else ""
            if small.isalpha():
                spelled = small if small.isascii() else small.encode().decode("latin-1").translate(BYTE_CHARS)
                ids[k] = array.array("I", [t.id for t in tokenize(spelled)]).tobytes()
            else:
                rest.append(k)
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for k, found in zip(some, self.model.encode_batch_fast([names[k] for k in some], add_special_tokens=False)):
                ids[k] = array.array("I", found.ids).tobytes()
        if room:
            self.kept.update((names[k], ids[k]) for k in new if len(names[k]) <= KEPT_CHARS)
        sizes, flat = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32)
        ends = np.cumsum(sizes)
        each = sizes[codes]
        where = np.repeat((ends[codes] - np.cumsum(each)).astype(np.int32), each) + np.arange(int(each.sum()), dtype=np.int32)
        stops = np.concatenate([[0], np.cumsum(each)])[starts]
        return np.insert(flat[where], stops[1:], np.uint32(end)), np.diff(stops) + 1


def _worker(vocabulary: str) -> WordEncoder:
    if vocabulary not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[vocabulary] = WordEncoder(vocabulary)
    return _WORKERS[vocabulary]


class TokenFile:
    """A file that is being written: ids go out as they come, the other parts at the end."""

    def __init__(self, store: fs.FileSystem, path: str, width: int):
        self.name, self.width = f"{uuid.uuid4().hex}.tok", width
        self.sink = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.bytes, self.ids, self.sizes, self.docs = 0, [], [], 0

    def add(self, docs: np.ma.MaskedArray, ids: np.ndarray, sizes: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.sink.write(data)
        self.bytes += len(data)
        self.docs += len(sizes)
        self.ids.append(docs), self.sizes.append(sizes)

    def close(self) -> tuple[str, int, int]:
        """Name, documents, tokens."""
        ids, ends = np.ma.concatenate(self.ids), np.cumsum(np.concatenate(self.sizes))
        known = ids.compressed()
        first = int(known[0]) if len(known) else 0
        apart = known.view(np.uint64) - np.array([first], np.int64).view(np.uint64)  # fits 64 bits whatever the signs
        wide = len(apart) and int(apart[-1]) >= 1 << 63
        boundaries, names = encode(ends), known.astype("<i8").tobytes() if wide else encode(apart.view(np.int64))
        self.sink.write(boundaries + names + _FOOT.pack(self.bytes, len(boundaries), len(names), len(ids) - len(known), first, self.width | 128 * bool(wide), _MARK))
        self.sink.close()
        return self.name, len(ids), int(ends[-1])


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str = TOKENIZER_PATH, id_col="doc_id", text_col="text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts into files under ``folder``, in ascending order of their document ids; the manifest, written as a table.

    Rows are dealt by ranges of the id; a place in the input breaks ties, so that rows of one id may lie in several ranges.
    Each attempt of a task writes files of its own names; the manifest lists those of the attempt that counted. Ids must be
    whole numbers of at most 64 bits, or null.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold whole numbers")
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    if len(text) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    vocabulary = spark.sparkContext.broadcast(text)
    small_batches(spark)
    dealt = picked(docs, id=id_col, text=text_col).withColumn("place", F.monotonically_increasing_id()).repartitionByRange("id", "place").sortWithinPartitions("id", "place")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        encoder, part, seq, out = _worker(vocabulary.value), TaskContext.get().partitionId(), 0, None
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)

        def done(file: TokenFile) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seq, *file.close()), schema)], schema=schema)

        for batch in batches:
            for piece in slices(batch, AT_ONCE):
                ids, sizes = encoder.encode(piece.column("text"), end_id)
                names = piece.column("id").cast(pa.int64())
                out = out or TokenFile(store, path, encoder.width)
                out.add(np.ma.array(names.fill_null(0).to_numpy(), mask=names.is_null().to_numpy(zero_copy_only=False)), ids, sizes)
                if out.bytes >= FILE_BYTES or out.docs >= FILE_DOCS:
                    yield done(out)
                    seq, out = seq + 1, None
            del batch
        if out:
            yield done(out)
        give_back()

    return materialize(dealt.select("id", "text").mapInArrow(run, MANIFEST))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``: ids in all files before. Parts are summed first, so that one task sees a row a part only."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = parts.select("part", before(Window.orderBy("part"), "n").alias("carried"))
    own = before(Window.partitionBy("part").orderBy("seq"), "n_tokens")
    return manifest.withColumn("own", own).join(carried, "part").select("*", (F.col("own") + F.col("carried")).alias("first")).drop("own", "carried")


def read_tokens(manifest: DataFrame, folder: str, *, ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers), and its ids if asked for.

    A task reads one file at a time: its end, then ids between the boundaries that select gives, READ_BYTES or one document at once.
    """
    small_batches(manifest.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] * ids)])

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                with store.open_input_file(f"{path}/{name}") as source:
                    for rows in read_file(source, first):
                        if ids:
                            rows["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows["n_tokens"])]).astype(np.int32)), pa.array(rows["ids"].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
        give_back()

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return with_starts(manifest).select("file", "first").repartition("file").mapInArrow(run, kind)


def read_file(source, first: int = 0):
    """Dicts of arrays for runs of documents of one open file; ids holds the run's ids in turn."""
    size = source.size()
    foot = source.read_at(_FOOT.size, size - _FOOT.size)
    ids_bytes, edge_bytes, name_bytes, nulls, least, width, mark = _FOOT.unpack(foot)
    if mark != _MARK or ids_bytes + edge_bytes + name_bytes + _FOOT.size != size:
        raise ValueError("not a whole token file")
    edges, names = EliasFano(source.read_at(edge_bytes, ids_bytes)), source.read_at(name_bytes, ids_bytes + edge_bytes)
    wide, width = width & 128, width & 127
    names = np.frombuffer(names, "<i8") if wide else EliasFano(names)
    at, n = 0, len(edges)
    begin = 0
    while at < n:
        # a few thousand boundaries at once, as many documents as fit
        stops = edges.select(np.arange(at, min(n, at + 4096)))
        take = max(1, int(np.searchsorted(stops, begin + READ_BYTES // width, side="right")))
        stops = stops[:take]
        ids = np.frombuffer(source.read_at((int(stops[-1]) - begin) * width, begin * width), f"<u{width}").astype("<u4")
        starts = np.concatenate([[begin], stops[:-1]])
        crc = [zlib.crc32(ids[a - begin : b - begin]) for a, b in zip(starts.tolist(), stops.tolist())]
        place = np.arange(at, at + take) - nulls
        known = np.maximum(place, 0)
        if len(names) == 0:
            value = np.zeros(take, np.int64)
        else:
            value = names[known] if wide else (names.select(known).view(np.uint64) + np.array([least], np.int64).view(np.uint64)).view(np.int64)
        yield {"doc_id": pa.array(value, mask=place < 0), "start": starts + first, "n_tokens": stops - starts, "ids_crc32": crc, "ids": ids}
        at, begin = at + take, int(stops[-1])


def token_report(docs: DataFrame, *, tokenizer: str = TOKENIZER_PATH) -> DataFrame:
    """The op13 digest: write the ids of all documents, read every file back.

    A null or empty text has its end id only. Null ids come first; rows that share an id follow one another in some order and
    count each. A very long text is one document of one file. An empty table gives no rows; other columns are ignored.
    """
    folder = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, tokenizer=tokenizer), folder)
