"""Token ids in binary shard files, each a wavelet matrix.

A shard holds the ids of a run of documents as bit-planes: the highest bit of all ids, then (ids stably parted by
that bit) the next, and so on. With ones counted before each block of a plane, `access`, `count`, `rank` and
`select` of any token take one step a plane; nothing else is stored. Planes are compressed in small chunks of one
file, so that such a question unpacks a few of them and not the file; `token_counts` and `token_places` ask a whole
folder.

Documents are sorted by doc_id (nulls first; equal ids by a checksum of the text) into partitions, and each partition writes files
of about SHARD_TOKENS ids to the shared folder, under a name that a repeated task writes again with the same bytes.
Only the number of ids of each partition comes to the driver. Executors write through Arrow's file systems (local or
mounted folders, s3, gs, hdfs); the files are read with Spark's own binary source.

Cases: a null text is an empty one and has the end id alone; a text of any length goes whole into one shard;
repeated rows are separate documents; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import bound_batches, dealt, held, new_path, tokenizer_path
from strandline.llm.treebpe import byte_alphabet
from strandline.llm.words import PieceCache, Pieces, Words, odd_texts, taken, text_slices

SHARD_TOKENS = 1 << 21
BLOCK = 512  # bits of a plane between two stored counts
CHUNK = 1 << 15  # bytes of a plane that are compressed together
MAGIC = b"SLWM2\n"
_HEAD = "<6sBQQQ"
_ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, null_ids: np.ndarray, first: int = 0) -> bytes:
    """A shard's file. first: number of ids before it in its partition.

    After the head stand the sizes of all parts, then the parts: the documents' ids, lengths and null marks, the counts
    of ones before each BLOCK of each plane, and the planes' chunks, compressed one by one where that makes them smaller."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    parts = [squeeze(doc_ids.astype("<i8").tobytes()), squeeze(lengths.astype("<i8").tobytes()), squeeze(np.packbits(null_ids).tobytes())]
    chunks = []
    for level in range(bits - 1, -1, -1):
        bit = (rest & rest.dtype.type(1 << level)) != 0
        plane = np.packbits(bit)
        padded = np.pad(plane, (0, -len(plane) % (BLOCK // 8)))
        parts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)))).astype("<u4").tobytes())
        for at in range(0, len(plane), CHUNK):
            raw = plane[at : at + CHUNK].tobytes()
            small = squeeze(raw)
            chunks.append(small if len(small) < len(raw) else raw)
        rest = np.concatenate((rest[~bit], rest[bit]))
    parts += chunks
    return struct.pack(_HEAD, MAGIC, bits, len(ids), len(doc_ids), first) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class WaveletShard:
    """A shard read from its file's bytes; a question about single tokens unpacks only the chunks that it touches."""

    def __init__(self, data: bytes):
        import zstandard

        magic, self.bits, self.n, n_docs, self.first = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.data, self.width = memoryview(data), -(-self.n // 8)
        self.each = -(-self.width // CHUNK)  # chunks of a plane
        at = struct.calcsize(_HEAD)
        sizes = np.frombuffer(data, "<u8", 3 + self.bits * (1 + self.each), at).astype(np.int64)
        self.ends = at + 8 * len(sizes) + np.cumsum(sizes)
        self.sizes = sizes
        unpack = zstandard.ZstdDecompressor().decompress
        docs, lengths, nulls = (unpack(self._part(k)) for k in range(3))
        self.doc_ids, self.lengths = np.frombuffer(docs, "<i8"), np.frombuffer(lengths, "<i8")
        self.null_ids = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n_docs).astype(bool)
        self.before = [np.frombuffer(self._part(3 + k), "<u4") for k in range(self.bits)]
        self.zeros = [self.n - int(b[-1]) for b in self.before]
        self.open: dict[tuple[int, int], np.ndarray] = {}  # chunks unpacked so far, by plane and number

    def _part(self, k: int) -> memoryview:
        return self.data[self.ends[k] - self.sizes[k] : self.ends[k]]

    def _chunk(self, plane: int, c: int) -> np.ndarray:
        known = self.open.get((plane, c))
        if known is None:
            import zstandard

            part, raw = self._part(3 + self.bits + plane * self.each + c), min(CHUNK, self.width - c * CHUNK)
            known = np.frombuffer(part if len(part) == raw else zstandard.ZstdDecompressor().decompress(part), np.uint8)
            self.open[plane, c] = known
        return known

    def _bit(self, plane: int, i: int) -> int:
        c, at = divmod(i >> 3, CHUNK)
        return int(self._chunk(plane, c)[at]) >> (7 - (i & 7)) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        whole = int(self.before[plane][block])
        if i % BLOCK:
            c, at = divmod(block * (BLOCK // 8), CHUNK)
            bytes_, more = self._chunk(plane, c), at + (i % BLOCK >> 3)
            whole += int(_ones[bytes_[at:more]].sum()) + (int(_ones[bytes_[more] >> (8 - (i & 7))]) if i & 7 else 0)
        return whole

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            token, i = token << 1 | int(bit), self.zeros[k] + ones if bit else i - ones
        return token

    def _range(self, token: int, to: int) -> tuple[int, int]:
        """Where the ids equal to `token` among the first `to` stand after the last plane."""
        start = 0
        for k in range(self.bits):
            a, b = self._ones(k, start), self._ones(k, to)
            start, to = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (start - a, to - b)
        return start, to

    def rank(self, token: int, i: int) -> int:
        """How often `token` stands among the first i ids."""
        if token >> self.bits:
            return 0
        start, end = self._range(token, min(max(i, 0), self.n))
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) 0 or 1 of a plane."""
        per = self.before[plane].astype(np.int64)
        if not bit:
            per = np.minimum(np.arange(len(per)) * BLOCK, self.n) - per
        block = int(np.searchsorted(per, k, side="right")) - 1
        c, at = divmod(block * (BLOCK // 8), CHUNK)
        some = np.unpackbits(self._chunk(plane, c)[at : at + BLOCK // 8], count=min(BLOCK, self.n - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(some == bit)[k - int(per[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of `token`."""
        if token >> self.bits:
            raise IndexError(k)
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def document(self, i: int) -> tuple[int, int]:
        """(number of the document in this shard, place in it) of the id at place i."""
        ends = np.cumsum(self.lengths)
        k = int(np.searchsorted(ends, i, side="right"))
        return k, i - int(ends[k] - self.lengths[k])

    def tokens(self) -> np.ndarray:
        """All ids: the planes' partings undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            plane = np.concatenate([np.empty(0, np.uint8), *(self._chunk(k, c) for c in range(self.each))])
            bit = np.unpackbits(plane, count=self.n).view(bool)
            for c in range(self.each):
                del self.open[k, c]
            back = np.empty_like(out)
            back[~bit] = out[: self.zeros[k]]
            back[bit] = out[self.zeros[k] :] | out.dtype.type(1 << (self.bits - 1 - k))
            out = back
        return out


class WordBpe:
    """Ids of whole texts by a word-end BPE file that drops white space: pieces are encoded once each."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(file)
        self.full.no_truncation()
        self.full.no_padding()
        self.model, self.alphabet = self.full.model, dict(enumerate(byte_alphabet()))
        # Texts with what may start an added token are left to the library, word by word.
        self.never = sorted({t.content[:2] for t in self.full.get_added_tokens_decoder().values()})
        self.words = PieceCache(lambda w: self.full.encode(w, add_special_tokens=False).ids)
        self.pieces = PieceCache(self.piece)
        # Pieces are cut by the pattern of one file; that is used only where it gives what the library gives.
        self.patterned = True
        sample = pa.array(["Abc", "été,", "Über.%%%", "it's I'LL", "x1y22", "(a)", "L'été", "!!", "don't've", "a\tb\n c"])
        ids, counts = self.encode_batch(sample, 0)
        whole = [self.full.encode(t, add_special_tokens=False).ids + [0] for t in sample.to_pylist()]
        self.patterned = ids.tolist() == list(chain.from_iterable(whole)) and counts.tolist() == list(map(len, whole))

    @classmethod
    def of(cls, name: str) -> WordBpe:
        return held(f"words {name}", lambda: cls(tokenizer_path(name)))

    def piece(self, text: str) -> list[int]:
        part = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(part)]

    def encode_batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end with `end` after each text, number of each text's)."""
        odd = odd_texts(texts, self.never) if self.patterned else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        cut = Pieces(plain, joined=False)
        found = [self._joined(self.pieces(cut.pieces), cut.codes.to_numpy(), cut.starts, end)]
        if odd.any():
            words = Words(texts.filter(pa.array(odd)))
            found.append(self._joined(self.words(words.words), words.codes, words.starts, end))
            parts = [iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(()) for ids, counts in found]
            each = [next(parts[int(o)]) for o in odd]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return found[0]

    @staticmethod
    def _joined(values: pa.Array, codes: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        values = pa.concat_arrays([values, pa.array([np.uint32(end).tobytes()], pa.binary())])
        data, at = taken(values, pa.array(np.insert(codes.astype(np.int32), starts[1:], len(values) - 1)))
        return data.view("<u4"), np.diff(at[starts + np.arange(len(starts))]) // 4


def write_shards(documents: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> dict[int, int]:
    """Writes the shards of `documents` (doc_id, text) to a folder that all executors share; gives the number of ids of each partition."""

    def write(batches):
        from pyarrow import fs

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        store, folder = fs.FileSystem.from_uri(path)
        engine = WordBpe.of(vocabulary)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def save():
            nonlocal seq, first, held, size
            ids, docs, lengths, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{folder}/shard-{part:07d}-{seq:05d}.wm"
            draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(draft) as out:
                out.write(pack(ids, docs, lengths, nulls, first))
            store.move(draft, name)
            row = (part, seq, len(docs), len(ids))
            seq, first, held, size = seq + 1, first + len(ids), [], 0
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("part", "seq", "n_docs", "n_tokens"), row, strict=True)})

        for batch in batches:
            docs = batch.column("doc_id")
            null = docs.is_null().to_numpy(zero_copy_only=False)
            docs = docs.fill_null(0).to_numpy(zero_copy_only=False)
            for at, texts in text_slices(batch.column("text")):
                ids, lengths = engine.encode_batch(texts, end_id)
                stops = np.cumsum(lengths)
                done = 0
                while done < len(texts):
                    begun = stops[done - 1] if done else 0
                    to = max(done + 1, int(np.searchsorted(stops, begun + shard_tokens - size, side="right")))
                    held.append((ids[begun : stops[to - 1]], docs[at + done : at + to], lengths[done:to], null[at + done : at + to]))
                    size += int(stops[to - 1] - begun)
                    done = to
                    if size >= shard_tokens or done < len(texts):
                        yield save()
        if held:
            yield save()

    spark = documents.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    bound_batches(spark)
    # The checksum lets ranges cut among rows of one doc_id (or without one), however many these are.
    keys = "doc_id", F.xxhash64("text"), "text"
    ordered = dealt(documents.select("doc_id", "text"), *keys[:2]).sortWithinPartitions(*keys)
    rows = ordered.mapInArrow(write, "part long, seq long, n_docs long, n_tokens long").groupBy("part").agg({"n_tokens": "sum"}).collect()
    return {r[0]: r[1] for r in rows}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(path).select("path", "content")


def _partition(name: str) -> int:
    return int(re.search(r"shard-(\d+)-", name)[1])


def _bases(sizes: dict[int, int]) -> dict[int, int]:
    """How many ids stand before each partition's."""
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part], total = total, total + sizes[part]
    return bases


def read_shards(spark: SparkSession, path: str, sizes: dict[int, int]) -> DataFrame:
    """A row for each document of the shards of `write_shards`: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    bases = _bases(sizes)

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                shard = WaveletShard(data.as_py())
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                base = bases[_partition(name.as_py())] + shard.first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=shard.null_ids),
                        pa.array(base + ends - shard.lengths),
                        pa.array(shard.lengths),
                        pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32)), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not sizes:
        return spark.createDataFrame([], schema)
    return _files(spark, path).mapInArrow(read, schema)


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of `tokens` stands in the shards of a folder, by their counts alone."""

    def count(batches):
        for batch in batches:
            for data in batch.column("content"):
                shard = WaveletShard(data.as_py())
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    return _files(spark, path).select("content").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(spark: SparkSession, path: str, sizes: dict[int, int], tokens: list[int]) -> DataFrame:
    """(token, doc_id, place, position): where each of `tokens` stands, in its document and among all ids, by select."""
    bases = _bases(sizes)

    def find(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                shard = WaveletShard(data.as_py())
                base = bases[_partition(name.as_py())] + shard.first
                for token in tokens:
                    places = shard.occurrences(token)
                    of = [shard.document(i) for i in places]
                    yield pa.RecordBatch.from_pydict({
                        "token": pa.array([token] * len(of), pa.int64()),
                        "doc_id": pa.array([None if shard.null_ids[d] else int(shard.doc_ids[d]) for d, _ in of], pa.int64()),
                        "place": pa.array([p for _, p in of], pa.int64()),
                        "position": pa.array([base + i for i in places], pa.int64()),
                    })

    return _files(spark, path).mapInArrow(find, "token long, doc_id long, place long, position long")


def digests(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """The contract's row for each document, from the files. These are the query's product; they stay in a new folder
    under the shared one, which its owner empties."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    sizes = write_shards(documents, path, vocabulary, end_id)
    return read_shards(spark, path, sizes).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32")


__all__ = ["WaveletShard", "WordBpe", "digests", "pack", "read_shards", "token_counts", "token_places", "write_shards"]
