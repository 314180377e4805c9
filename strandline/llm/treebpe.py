"""BPE encoding and decoding by tree concatenation.

The pre-tokenizer splits most text into short pieces, which a worker cuts from the bytes of many texts at once, encodes
once each and keeps. A piece that it leaves unsplit (letters, digits, signs or blanks without end) would take one long
run of merges. Its leaves are encoded in one parallel batch instead, then neighbours are joined level by level: the tokens around a join are
re-encoded in a window that grows until its first and last token are those that were there already. A sequence of
BPE tokens is the encoding of its text exactly if each adjacent pair is the encoding of the pair's text, so the
tokens outside such a window stand and the result equals that of one run over the whole piece.

Cases: a null text is an empty one and has no ids; texts may be of any length; rows are independent, so ties,
repeated rows and empty tables need no rule; other columns pass through untouched (`with_tokens` refuses names that are
taken).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bound_batches, held, tokenizer_path
from strandline.llm.words import SLICE_BYTES, PieceCache, Pieces, odd_texts, taken, text_slices

#: A piece of more bytes than this is joined from leaves of this many.
LEAF = 256
#: Odd text is cut into pieces in runs of about as many characters, each before a blank (for the pre-tokenizer and Python
#: alike) that follows a non-blank.
RUN = 1 << 16
_cut = re.compile(r"(?<=\S)(?=[ \n\t\r])")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE uses for each byte: itself where printable in Latin-1, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _pre_tokenizer_of(tokenizer) -> dict:
    made = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    return {k: v for k, v in made.items() if k != "trim_offsets"}


class TreeBpe:
    """A byte-level BPE tokenizer file; `of` gives one for each worker process."""

    def __init__(self, file: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(file)
        self.full.no_truncation()
        self.full.no_padding()
        self.plain = Tokenizer(self.full.model)
        self.model, self.leaf = self.full.model, leaf
        self.alphabet = dict(enumerate(byte_alphabet()))
        byte_of = {c: b for b, c in self.alphabet.items()}
        self.token = {i: t for t, i in self.full.get_vocab(with_added_tokens=False).items()}
        self.bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for i, t in self.token.items()}
        added = self.full.get_added_tokens_decoder()
        self.bytes |= {i: t.content.encode() for i, t in added.items()}
        # Tokens that are cut out of the text first; with looser matching rules only the library itself is used.
        self.plain_added = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        self.added = {t.content: i for i, t in added.items()}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        # The pattern above is for this pre-tokenizer; with another, the library cuts every text.
        self.patterned = self.full.normalizer is None and _pre_tokenizer_of(self.full) == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.pieces = PieceCache(self.piece)
        self.table = pa.array([self.bytes.get(i, b"") for i in range(max(self.bytes, default=-1) + 1)], pa.binary())

    @classmethod
    def of(cls, name: str) -> TreeBpe:
        return held(f"tree {name}", lambda: cls(tokenizer_path(name)))

    def mapped(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.alphabet)

    def piece(self, text: str) -> list[int]:
        """The ids of one piece of plain text that the pre-tokenizer leaves whole."""
        # Of printable ASCII only the space has another character in the byte alphabet.
        part = text.replace(" ", self.alphabet[32]) if text.isascii() and text.isprintable() else self.mapped(text)
        return self.tree(part) if len(part) > self.leaf else [t.id for t in self.model.tokenize(part)]

    def chunk(self, text: str) -> list[int]:
        """The ids of a text without added tokens."""
        if len(text) <= self.leaf:
            return self.full.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = _cut.search(text, at + RUN)
            to = cut.start() if cut else len(text)
            for part, _ in self.full.pre_tokenizer.pre_tokenize_str(text[at:to]):
                ids += self.tree(part) if len(part) > self.leaf else [t.id for t in self.model.tokenize(part)]
            at = to
        return ids

    def run(self, part: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch(part, add_special_tokens=False)]

    def tree(self, part: str) -> list[int]:
        """The ids of one unsplit piece (in the byte alphabet): leaves, then joins of neighbours until one sequence is left."""
        parts = self.run([part[i : i + self.leaf] for i in range(0, len(part), self.leaf)])
        while len(parts) > 1:
            joined = self.join([(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)])
            parts = joined + parts[len(joined) * 2 :]
        return parts[0] if parts else []

    def join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The ids of each pair's text; the windows of all pairs grow together, each round in one batch."""
        out: list[list[int]] = [[]] * len(pairs)
        open_ = [(k, 2, 2) for k in range(len(pairs))]
        while open_:
            spans = [(k, min(i, len(pairs[k][0])), min(j, len(pairs[k][1]))) for k, i, j in open_]
            windows = self.run(["".join(self.token[t] for t in pairs[k][0][len(pairs[k][0]) - i :] + pairs[k][1][:j]) for k, i, j in spans])
            open_ = []
            for (k, i, j), ids in zip(spans, windows, strict=True):
                left, right = pairs[k]
                start_stands = i == len(left) or ids[0] == left[-i]
                end_stands = j == len(right) or ids[-1] == right[j - 1]
                if start_stands and end_stands:
                    out[k] = left[: len(left) - i] + ids + right[j:]
                else:
                    open_.append((k, i if start_stands else 2 * i, j if end_stands else 2 * j))
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of any text, as the library gives them."""
        if not self.plain_added:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        ids: list[int] = []
        for segment in self.specials.split(text) if self.specials else [text]:
            if segment in self.added:
                ids.append(self.added[segment])
            elif segment:
                ids += self.chunk(segment)
        return np.array(ids, np.uint32)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, start of each text's and the end) of texts without nulls."""
        if not (self.plain_added and self.patterned):
            return joined([self.encode(t) for t in texts.to_pylist()])
        odd = odd_texts(texts, list(self.added))
        if odd.any():
            plain = iter(slices(*self.encode_batch(texts.filter(pa.array(~odd)))))
            return joined([self.encode(texts[i].as_py()) if o else next(plain) for i, o in enumerate(odd.tolist())])
        cut = Pieces(texts, joined=True)
        data, starts = taken(self.pieces(cut.pieces), cut.codes)
        return data.view("<u4"), starts[cut.starts] // 4

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters, as in the library."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decode_batch(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The texts of ids end to end; `starts` has where each text's begin, and the end."""
        data, at = taken(self.table, pa.array(ids.astype(np.int32)))
        at = at[starts]
        try:
            data.tobytes().decode()
            whole = not ((data[at[:-1][at[:-1] < len(data)]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([self.decode(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.string())
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def slices(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the parts end to end, start of each and the end)."""
    return np.concatenate([np.empty(0, np.uint32), *parts]).astype(np.uint32), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def encode(text: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """The ids of a text column as little-endian unsigned 32-bit integers in a binary."""

    @F.arrow_udf("binary")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        engine, out = TreeBpe.of(vocabulary), []
        for _, part in text_slices(texts):
            ids, starts = engine.encode_batch(part)
            data = ids.astype("<u4").tobytes()
            out.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(data)]))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return bpe_encode(text)


def decode(ids: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """The text of a binary column of ids as `encode` makes it."""

    @F.arrow_udf("string")
    def bpe_decode(column: pa.Array) -> pa.Array:
        engine, out = TreeBpe.of(vocabulary), []
        column = column.fill_null(b"")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES // 2, side="right")))
            part = pa.concat_arrays([column.slice(at, to - at)])
            starts = np.concatenate(([0], np.cumsum(sizes[at:to]))) // 4
            offset = int(np.frombuffer(part.buffers()[1], np.int32)[part.offset])
            ids = np.frombuffer(part.buffers()[2], "<u4", count=int(starts[-1]), offset=offset) if starts[-1] else np.empty(0, np.uint32)
            out.append(engine.decode_batch(ids, starts))
            at = to
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return bpe_decode(ids)


def with_tokens(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """`df` with its texts' ids and (unless None) the text that these decode to. A column of `df` that has one of these
    names already is an error: give another name."""
    if clash := {c.lower() for c in df.columns} & {ids.lower(), (decoded or ids).lower()}:
        raise ValueError(f"the table has columns {sorted(clash)}; name the new ones otherwise")
    bound_batches(df.sparkSession)
    df = df.withColumn(ids, encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), vocabulary))
    return df if decoded is None else df.withColumn(decoded, decode(F.col(f"`{ids}`"), vocabulary))


def digests(documents: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """The contract's row for each document."""
    tokens = with_tokens(documents.select("doc_id", "text"), vocabulary=vocabulary)
    return tokens.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
