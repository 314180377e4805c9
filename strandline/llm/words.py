"""Word splitting of whole Arrow batches: one native pass splits and numbers the words, Python sees each distinct word once."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time, so that memory does not follow the batch; one longer text makes a slice of its own.
SLICE_BYTES = 8 << 20

_identity = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else as it is.
LOWER_ASCII = np.where((_identity >= 65) & (_identity <= 90), _identity + 32, _identity).astype(np.uint8)
#: A-Z to a-z; what is neither an ASCII letter or digit nor part of a non-ASCII character becomes a space.
ALNUM_ASCII = np.where(
    ((LOWER_ASCII >= 48) & (LOWER_ASCII <= 57)) | ((LOWER_ASCII >= 97) & (LOWER_ASCII <= 122)) | (_identity >= 128), LOWER_ASCII, 32
).astype(np.uint8)


def text_slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES):
    """(first row, string array without nulls) for runs of rows of about `most` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Each byte through `table` (which leaves bytes of 128 and more alone, so the result is UTF-8 again)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(table[values]))


def as_list(strings: pa.Array) -> list[str]:
    """The strings as Python ones; by way of numpy this takes a tenth of to_pylist()'s time."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class Words:
    """The words of a run of texts: `codes` numbers them by `distinct`, text i has codes[starts[i]:starts[i + 1]]."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None, single_space: bool = False):
        if table is not None:
            texts = translated(texts, table)
        lists = pc.split_pattern(texts, " ") if single_space else pc.ascii_split_whitespace(texts)
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        if not single_space:
            empty = pc.index(self.words, "").as_py() if len(self.words) else -1
            if empty >= 0:
                keep = codes != empty
                starts = np.concatenate(([0], np.cumsum(keep)))[starts]
                codes = codes[keep]
        self.codes, self.starts = codes, starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def docs(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def distinct(self) -> list[str]:
        return as_list(self.words)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its words' `values` (one for each distinct word)."""
        return np.bincount(self.docs, weights=values[self.codes], minlength=len(self.starts) - 1)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat[starts[c] : starts[c] + lengths[c]] of each code c, end to end."""
    of = lengths[codes]
    if not len(of):
        return flat[:0]
    ends = np.cumsum(of)
    return flat[np.repeat(starts[codes] - (ends - of), of) + np.arange(ends[-1])]


def _class_of(byte: int) -> int:
    if byte in b"\t\n\r ":
        return 0
    if chr(byte).isalpha() and byte < 128 or byte >= 128:
        return 1
    return 2 if 48 <= byte <= 57 else 3


#: Blank, letter (and what is not ASCII), digit or sign.
BLANK, LETTER, DIGIT, SIGN = range(4)
_CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)
#: Control characters that regular expressions may take as blanks, or not.
_CONTROL = np.array([b < 32 and b not in b"\t\n\r" or b == 127 for b in range(256)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of a string array, where each text begins, and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)), offsets - offsets[0]


def _latin(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of bytes beyond ASCII, those before them, which belong to a letter of Latin-1)."""
    high = np.flatnonzero(v >= 128)
    before = np.where(high > 0, v[high - 1], 0) if len(high) else v[high]
    return high, before, (v[high] == 0xC3) | (before == 0xC3) & (v[high] < 0xC0) & (v[high] != 0x97) & (v[high] != 0xB7)


def odd_texts(texts: pa.Array, never: list[str] = ()) -> np.ndarray:
    """Which texts hold more than ASCII without control characters and the letters of Latin-1, or a string of `never`."""
    v, offsets = _bytes_of(texts)
    high, _, latin = _latin(v)
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(offsets, np.concatenate((high[~latin], np.flatnonzero(_CONTROL[v]))), side="right") - 1] = True
    for text in never:
        odd |= pc.match_substring(texts, text).to_numpy(zero_copy_only=False)
    return odd


class Pieces:
    """The pieces into which the pattern of byte-level BPE cuts the texts of a run: `codes` numbers them by `pieces`,
    text i has codes[starts[i]:starts[i + 1]].

    All is done on the bytes of the run at once: a piece ends where the class of a byte (blank, letter, digit, sign)
    changes, which is right unless a text is one of `odd_texts`. joined: one space belongs to the piece after it, and
    runs of digits are whole (else blanks are no pieces, digits are pieces of their own and letters become lower-case
    ones)."""

    def __init__(self, texts: pa.Array, joined: bool):
        v, offsets = _bytes_of(texts)
        first = offsets[:-1][np.diff(offsets) > 0]
        begins = np.zeros(len(v) + 2, bool)  # first bytes of texts; the two more stand for what lies beyond the run
        begins[first] = begins[len(v) :] = True
        if not joined:
            v = LOWER_ASCII[v]
            high, before, _ = _latin(v)
            capital = high[(before == 0xC3) & (v[high] >= 0x80) & (v[high] <= 0x9E)]
            v[capital] += 32
        kind = _CLASS[v]
        cut = np.ones(len(v) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1 : len(v)]) if len(v) else None
        cut[first] = True
        if joined:
            after_blank = np.flatnonzero(cut[1:-1] & (kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~begins[1 : len(v)]) + 1 if len(v) else first
            cut[after_blank - 1] = True
            cut[after_blank] = v[after_blank - 1] != 32
        else:
            cut[: len(v)] |= kind == DIGIT
        self._contractions(v, cut, begins)
        starts = np.flatnonzero(cut[: len(v)])
        whole = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(v)).astype(np.int32)), pa.py_buffer(v))
        of = np.searchsorted(starts, offsets)
        if not joined:
            keep = kind[starts] != BLANK
            of = np.concatenate(([0], np.cumsum(keep)))[of]
            whole = whole.filter(pa.array(keep))
        coded = whole.dictionary_encode()
        self.codes, self.pieces, self.starts = coded.indices, coded.dictionary, of

    @staticmethod
    def _contractions(v: np.ndarray, cut: np.ndarray, begins: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pieces, where a piece starts with the sign."""
        at = np.flatnonzero((v == 39) & cut[: len(v)])
        if not len(at):
            return
        one, two = (np.where(at + k < len(v), v[np.minimum(at + k, len(v) - 1)], 0) for k in (1, 2))
        inside, further = ~begins[at + 1], ~begins[np.minimum(at + 2, len(v))]
        short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long_ = inside & further & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for which, size in ((short, 2), (long_, 3)):
            here = at[which]
            cut[here + 1] = False
            cut[here + size] = True  # at the end of the run this is the mark beyond it


class PieceCache:
    """What make(piece) gives (some ids) for the pieces of many runs, as little-endian 32-bit numbers in binary values.

    Pieces are kept as Arrow strings, of which a lookup hashes all at once: a tenth of a dictionary's memory. When
    more than `limit` are held, only those of the last run stay; pieces beyond `longest` bytes are made each time."""

    def __init__(self, make, limit: int = 600_000, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.names, self.values = pa.array([], pa.string()), pa.array([], pa.binary())

    def __call__(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece."""
        place = pc.index_in(pieces, value_set=self.names)
        if not place.null_count:
            return self.values.take(place)
        new = pieces.filter(place.is_null())
        made = [self.make(p) for p in as_list(new)]
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        flat = np.fromiter(chain.from_iterable(made), "<u4", int(ends[-1]))
        made = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(flat)])
        rank = np.cumsum(place.is_null().to_numpy(zero_copy_only=False)) - 1 + len(self.values)
        out = pa.concat_arrays([self.values, made]).take(pc.coalesce(place.cast(pa.int64()), pa.array(rank)))
        whole = len(self.names) + len(new) > self.limit
        names, values = (pieces, out) if whole else (new, made)
        short = pc.less_equal(pc.binary_length(names), self.longest)
        names, values = names.filter(short), values.filter(short)
        self.names = names if whole else pa.concat_arrays([self.names, names])
        self.values = values if whole else pa.concat_arrays([self.values, values])
        return out


def taken(values: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of values[c] of each code c end to end, where each begins, and the end)."""
    all_ = values.take(codes)
    offsets = np.frombuffer(all_.buffers()[1], np.int32)[all_.offset : all_.offset + len(all_) + 1]
    data = all_.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)), offsets.astype(np.int64) - offsets[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) that spreads numbers over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
