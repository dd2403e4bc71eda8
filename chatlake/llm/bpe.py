"""Byte-pair encoding and decoding by a pair occurrence index.

The texts of a partition are cut into pieces, equal pieces are kept once (by their bytes), and the symbols of all
distinct pieces lie in one array. Each adjacent pair that has a merge rank is listed with all its
positions; ranks that are active are applied in ascending order, each at all its positions at once,
and only the lists of pairs beside a merge are updated. A partition is indexed INDEX_BYTES of text at a time; a longer
text is indexed alone, in memory in proportion to it.

Nulls are encoded like empty texts (no ids). Empty tables give empty tables, repeated rows repeated rows. Columns of
the input other than the named ones are ignored. Of pairs that overlap, as in a run of one symbol, the first is merged.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .session import ready, table

#: Bytes of text whose pieces are indexed together.
INDEX_BYTES = 4 << 20

# The characters with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that the pattern splits off after an apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_OTHER, _LETTER, _DIGIT, _BLANK, _SPECIAL = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _BLANK
    return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library's JSON format, as arrays that are broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        self.special = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        parts = [b""] * size
        for token, i in vocab.items():
            parts[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            parts[i] = token
        self.size = size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * size + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        self.classes = _classes()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        k = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.key_ranks[at], -1)


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a file, read by the driver only."""
    return Vocabulary(path)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each starts."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[first]
    cp = lead.astype(np.int32)
    for low, high, n, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            v = cp[which] & bits
            for j in range(1, n + 1):
                v = (v << 6) | (data[first[which] + j] & 0x3F)
            cp[which] = v
    return cp, first


def pieces(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, special: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the pieces before merging, and the special id of a piece or -1."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    cp, first = _code_points(data)
    n = len(cp)
    kind = classes[cp]
    wall = np.zeros(n + 1, bool)  # a document or a special token starts here, or one has just ended
    wall[np.searchsorted(first, offsets)] = True
    marks: dict[int, int] = {}
    raw = data.tobytes() if special else b""
    bounds = offsets
    for token, i in (special or {}).items():
        at = raw.find(token)
        while at >= 0:
            d = int(np.searchsorted(bounds, at, "right"))
            if at + len(token) <= bounds[d]:
                a, b = np.searchsorted(first, (at, at + len(token)))
                kind[a:b] = _SPECIAL
                wall[a] = wall[b] = True
                marks[int(a)] = i
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    start = wall[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    size = np.diff(np.append(runs, n))
    blank = kind[runs] == _BLANK
    last = runs + size - 1
    inside = ~wall[np.minimum(last + 1, n)]  # something that is no blank follows in the same text
    tail = blank & inside
    begin = start
    glued = tail & (cp[last] == 0x20)
    begin[last[tail]] = True  # the last blank stands alone or opens the next piece
    begin[last[glued] + 1] = False
    # endings after a lone apostrophe that no space precedes
    one = np.flatnonzero((size == 1) & (kind[runs] == _OTHER) & (cp[runs] == 0x27) & begin[runs])
    at = runs[one]
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == _LETTER) & ~wall[at + 1]]
    if len(at):
        two = np.minimum(at + 2, n - 1)
        second_ok = (at + 2 < n) & (kind[two] == _LETTER) & ~wall[np.minimum(at + 2, n)]
        length = np.zeros(len(at), np.int64)
        for e in _ENDINGS:
            hit = cp[at + 1] == ord(e[0])
            if len(e) == 2:
                hit &= second_ok & (cp[two] == ord(e[1]))
            length = np.where((length == 0) & hit, len(e), length)
        at, length = at[length > 0], length[length > 0]
        begin[at + 1] = False
        rest = at + 1 + length
        keep = rest < n
        begin[rest[keep]] = True
    where = np.flatnonzero(begin)
    starts = first[where]
    ends = np.append(starts[1:], len(data))
    ids = np.full(len(where), -1, np.int64)
    if marks:
        spots = np.fromiter(marks, np.int64, len(marks))
        ids[np.searchsorted(where, spots)] = np.fromiter(marks.values(), np.int64, len(marks))
    return starts, ends, ids


def merge_all(symbols: np.ndarray, piece_ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Apply the merges to the symbols of all pieces; the ids left, and how many each piece has.

    An index maps each rank to the positions of its pair. It is used in ascending order of rank:
    a merge makes pairs of higher ranks only, as a token is always made before it is merged."""
    n = len(symbols)
    tok = np.empty(n + 1, np.int32)
    tok[:n] = symbols
    tok[n] = -1
    nxt = np.arange(1, n + 2, dtype=np.int32)
    prv = np.arange(-1, n, dtype=np.int32)
    nxt[piece_ends - 1] = n  # the last place stands for "none"
    prv[piece_ends[piece_ends < n]] = n
    if n:
        prv[0] = n
    nxt[n] = prv[n] = n
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def listed(at: np.ndarray) -> None:
        after = nxt[at]
        r = v.ranks(tok[at], tok[after])
        some = r >= 0
        if not some.any():
            return
        at, r = at[some], r[some]
        if len(at) > 1:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = (np.flatnonzero(r[1:] != r[:-1]) + 1).tolist()
        else:
            cuts = []
        lo = 0
        for hi in [*cuts, len(at)]:
            k = int(r[lo])
            have = index.get(k)
            if have is None:
                index[k] = [at[lo:hi]]
                heapq.heappush(heap, k)
            else:
                have.append(at[lo:hi])
            lo = hi

    listed(np.flatnonzero(nxt[:n] != n))
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        a, b, new = v.left[r], v.right[r], v.new[r]
        after = nxt[at]
        ok = (tok[at] == a) & (tok[after] == b)
        if not ok.all():
            at, after = at[ok], after[ok]
            if not len(at):
                continue
        if a == b and len(at) > 1:  # of a run of equal symbols, every second position from its start
            order = np.argsort(at, kind="stable")
            at, after = at[order], after[order]
            chained = np.zeros(len(at), bool)
            chained[1:] = at[1:] == after[:-1]
            heads = np.flatnonzero(~chained)
            place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            at, after = at[place % 2 == 0], after[place % 2 == 0]
        beyond = nxt[after]
        tok[at] = new
        tok[after] = -2
        nxt[at] = beyond
        prv[beyond] = at
        prv[n] = n
        left = prv[at]
        left = left[tok[left] != new]  # its pair is listed from its own place
        listed(np.concatenate((at[beyond != n], left[left != n])))
    alive = np.flatnonzero(tok[:n] >= 0)
    counts = np.diff(np.searchsorted(alive, np.append(0, piece_ends)))
    return tok[alive], counts


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] for each i, one after another."""
    total = int(counts.sum())
    if total == 0:
        return values[:0]
    shift = starts - (np.cumsum(counts) - counts)
    return values[np.repeat(shift, counts) + np.arange(total)]


def encode(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents and their offsets."""
    hashes, spans, doc_pieces = [], [], []
    for a, b in tx.chunks(offsets):
        lo, hi = offsets[a], offsets[b]
        part, off = data[lo:hi], offsets[a : b + 1] - lo
        s, e, special = pieces(part, off, v.classes, v.special)
        hashes.append(tx.span_hashes(part, s, e))
        spans.append(np.stack([s + lo, e + lo, special]))
        doc_pieces.append(np.diff(np.searchsorted(s, off)))
    if not hashes:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    start, end, special = np.concatenate(spans, axis=1)
    keys = tx.exact_keys(data, start, end, np.concatenate(hashes))
    some = special >= 0
    keys[some] = special[some].astype(np.uint64) | np.uint64(1 << 61)
    del hashes, spans
    coded = pa.array(keys.view(np.int64)).dictionary_encode()
    codes, unique = coded.indices.to_numpy(), len(coded.dictionary)
    del keys, coded
    where = np.empty(unique, np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    start, end, special = start[where], end[where], special[where]
    # the symbols of distinct pieces; a special piece is one symbol that no merge takes
    some = special >= 0
    length = np.where(some, 1, end - start)
    symbols = v.of_byte[spread(data, start, length)]
    ends = np.cumsum(length)
    symbols[ends[some] - 1] = special[some]
    ids, counts = merge_all(symbols, ends, v)
    starts = np.cumsum(counts) - counts
    per_doc = np.concatenate(doc_pieces)
    piece_counts = counts[codes]
    out = spread(ids, starts[codes], piece_counts)
    at = np.append(0, np.cumsum(piece_counts))
    return out, at[np.append(0, np.cumsum(per_doc))]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents and their offsets; ids outside the vocabulary give nothing."""
    known = (ids >= 0) & (ids < v.size)
    safe = np.where(known, ids, 0)
    length = np.where(known, v.lengths[safe], 0)
    out = spread(v.bytes, v.ends[safe] - v.lengths[safe], length)
    return out, np.append(0, np.cumsum(length))[offsets]


def encoded_batches(batches: Iterator[pa.RecordBatch], v: Vocabulary, keep: Callable, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Encode batch by batch in pieces of INDEX_BYTES; keep(batch slice, ids, offsets, data, data offsets) makes the output."""
    for batch in tx.gathered(batches, INDEX_BYTES):
        data, off = tx.utf8(batch.column(batch.schema.get_field_index(text_col)))
        for a, b in tx.chunks(off, INDEX_BYTES):
            part, part_off = data[off[a] : off[b]], off[a : b + 1] - off[a]
            yield from keep(batch.slice(a, b - a), *encode(part, part_off, v), part, part_off)
            tx.trim()


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id and `ids` array<int>, as the tokenizers library encodes it without
    adding special tokens. Null texts have no ids; repeated rows give repeated rows."""
    ready(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def keep(batch, ids, at, *_):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lambda it: encoded_batches(it, shared.value, keep), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: its id and `text`, as the tokenizers library decodes with special tokens kept.
    Null lists give empty texts, bytes that are no UTF-8 give U+FFFD."""
    ready(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        v = shared.value
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            out, at = decode(flat, np.append(0, np.cumsum(n)), v)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())], ["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass; digests of the ids and of the decoded text."""
    ready(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        v = shared.value

        def keep(batch, ids, at, *_):
            raw = ids.astype("<u4").tobytes()
            out, to = decode(ids, at, v)
            text = out.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist())], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        yield from encoded_batches(batches, v, keep)

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())
