"""Removal of repeated passages, exact to the byte, with suffix arrays.

Every byte that a passage of LENGTH bytes covers is removed if the passage also starts in a document with a smaller id.

1. Documents with the same text are one; only the smallest id's text goes on. The texts are kept as groups of 1 to 16 MB, in a
   bucketed table, so later joins by group move no text. A group sends one row to each part of the anchors, whatever its windows:
   rows grow as groups times parts, so a group of a large table is large.
2. In each group the passages are cut into runs that share an anchor: the byte string of ANCHOR bytes that is smallest, by its hash,
   within the passage. The same passage has the same anchor wherever it stands. A group is worked on in windows of about a
   megabyte; a longer text is cut into windows that overlap by a passage, so memory does not grow with groups or texts. For each
   run a window sends a 64-bit record of its anchor and content, once, with the smallest id.
3. By anchor, the records tell which runs also occur in a smaller document as they are, and which others share an anchor and
   what stands at one side of it, that is, may share a passage with a run of other content. All the rest is unique.
4. The bytes of the latter runs go to a suffix array each for a part of the anchors: passages whose hash no other document has
   there are left out, the rest is put in order by two-stage sorting, and stretches with common prefixes of at least LENGTH bytes
   are one passage, whose smallest id decides. An anchor with a great many contents is dealt out by passage instead, one copy a
   window, so no anchor lands in one task.
5. The removed places of each text are united as intervals; digests are taken of what is left.

Copies of whole texts (by MD5) and runs with equal records are taken as equal without a look at their bytes. Of the records of
one part, some 640,000 for 8 MB of text, two different ones are equal by chance once in about 90 million parts.

Nulls: a null text is empty. A null id counts as larger than all others; rows that share an id remove nothing from one another.
A text shorter than LENGTH loses nothing. Passages never cross documents. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import batched
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, in_tasks, scratch_path, table
from kinegrid.llm.suffixes import SEPARATOR, common_prefixes, two_stage

LENGTH, ANCHOR = 50, 24
#: Least and most bytes of text in a group, and groups there are between the two; bytes of it that are worked on at a time.
GROUP_LEAST, GROUP_MOST, GROUPS, WINDOW = 1 << 20, 1 << 24, 128, 1 << 20
#: Places that are hashed at a time, so that the arrays stay in the processor's cache; bytes of runs that a group holds before it sends them.
BLOCK, HELD_BYTES = 1 << 15, 16 << 20
#: Rows that a group sends at a time.
ROWS = 64
#: Bytes of text for each part of the anchors.
PART_BYTES = 8 << 20
#: Contents of one anchor in a suffix array; beyond it they are dealt out by passage.
HOT_CONTENTS = 2000
#: Ids of copies sent to every executor; beyond it they are dealt out by id.
SENT_COPIES = 500_000
LAST_ID = (1 << 63) - 1
CONTENT_BITS = 36

_rng = np.random.default_rng(7_050_024)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (_rng.integers(0, 1 << 63, 5, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of the bytes' numbers times their powers, before each place and at the end."""
    sums = np.zeros(len(data) + 1, np.uint64)
    for s in range(0, len(data), BLOCK):
        x = _BYTE[data[s : s + BLOCK]]
        x *= powers[s : s + len(x)]
        x[:1] += sums[s : s + 1]
        np.cumsum(x, out=sums[s + 1 : s + 1 + len(x)])
    return sums


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, both modulo 2**64."""
    size = 1 << max(10, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[size] = tuple(made)
    return _powers[size]


class Runs:
    """The runs of passages of a group of texts (joined with a separator after each) that share an anchor."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length = length
        self.data = np.frombuffer(bytes([SEPARATOR]).join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        n = len(self.data)
        starts = n - length
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.anchor = self.content = np.zeros(0, np.uint64)
        if starts <= 0:
            return
        at, gram = self._anchors(starts)
        valid = np.zeros(starts, bool)
        for begin, size in zip(self.begin.tolist(), sizes.tolist(), strict=True):
            if size >= length:
                valid[begin : begin + size - length + 1] = True
        new = np.ones(starts, bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        self.first = np.flatnonzero(new & valid)
        end = np.ones(starts, bool)
        end[:-1] = new[1:] | ~valid[1:]
        self.last = np.flatnonzero(end & valid)
        self.doc = np.searchsorted(self.begin, self.first, side="right") - 1
        self.anchor = gram[at[self.first]]
        powers, self._inverse = _power_tables(n)
        self._sums = _sums(self.data, powers)
        self.content = self.hashes(self.first, self.last + length)
        self._place = at[self.first].astype(np.int64)

    def _anchors(self, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of each passage's anchor, and the hash of the ANCHOR bytes at each place."""
        n = len(self.data)
        place_bits = np.uint64(max(20, n.bit_length()))
        at, gram = np.empty(starts, np.int32 if n >> 31 == 0 else np.int64), np.empty(n, np.uint64)
        for s in range(0, starts, BLOCK):
            e = min(starts, s + BLOCK)
            x = _BYTE[self.data[s : e + self.length - 1]]
            two = x[:-1] * _STEP[0] + x[1:]
            four = two[:-2] * _STEP[1] + two[2:]
            eight = four[:-4] * _STEP[2] + four[4:]
            sixteen = eight[:-8] * _STEP[3] + eight[8:]
            own = _mix(sixteen[: len(x) - ANCHOR + 1] * _STEP[4] + eight[16:])
            gram[s : s + len(own)] = own
            key = (own >> place_bits << place_bits) | np.arange(s, s + len(own), dtype=np.uint64)
            width, span = self.length - ANCHOR + 1, 1
            while 2 * span <= width:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < width:
                key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
            at[s:e] = key & ((np.uint64(1) << place_bits) - np.uint64(1))
        return at, gram

    def sides(self, which: np.ndarray) -> np.ndarray:
        """Of some runs: hashes of the anchor with what stands on its left and on its right, 16 bits each."""
        first, last, place, half = self.first[which], self.last[which] + self.length, self._place[which], -(-(self.length - ANCHOR) // 2)
        left, right = (self._side(first, last, begin, end) for begin, end in ((place - half, place + ANCHOR), (place, place + ANCHOR + half)))
        return (left << np.uint32(16)) | right

    def _side(self, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """15 bits of the hash of an anchor with what stands at one side, and a 1; 0 if the run does not reach so far."""
        inside = (begin >= first) & (end <= last)
        bits = self.hashes(np.where(inside, begin, 0), np.where(inside, end, 0)) >> np.uint64(49)
        return np.where(inside, (bits.astype(np.uint32) << np.uint32(1)) | np.uint32(1), np.uint32(0)).astype(np.uint32)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings from begin to end."""
        return _mix((self._sums[end] - self._sums[begin]) * self._inverse[begin] + (end - begin).astype(np.uint64))


class Window(Runs):
    """Runs of some texts of a group, or of a stretch of a long one. docs, offsets: which text each piece is of, and where it begins there."""

    def __init__(self, docs: list[int], offsets: list[int], pieces: list[bytes], ids: np.ndarray, length: int):
        super().__init__(pieces, length)
        self.docs, self.offsets = np.array(docs, np.int64), np.array(offsets, np.int64)
        self.ids = ids[self.docs]


def windows(texts: list[bytes], ids: np.ndarray, length: int, size: int = WINDOW) -> Iterator[Window]:
    """Every passage of the texts lies in one window, and starts in no other."""
    docs, offsets, pieces, held = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            piece = text[at : at + size + length - 1]
            if pieces and held + len(piece) > size:
                yield Window(docs, offsets, pieces, ids, length)
                docs, offsets, pieces, held = [], [], [], 0
            docs.append(k)
            offsets.append(at)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield Window(docs, offsets, pieces, ids, length)


def _records(runs: Window, parts: int) -> tuple:
    """For each distinct content: its first run (the smallest id's), part and record, in the order they are sent; for each run: its place there."""
    if not len(runs.first):
        return runs.first, runs.first, runs.content, runs.first
    order = np.argsort(runs.content)
    new = np.append(True, runs.content[order[1:]] != runs.content[order[:-1]])
    first = np.minimum.reduceat(order, np.flatnonzero(new))
    part = ((runs.anchor[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    sent = np.argsort((part << 32) | first)
    back = np.empty(len(sent), np.int64)
    back[sent] = np.arange(len(sent))
    place = np.empty(len(order), np.int64)
    place[order] = back[np.cumsum(new) - 1]
    first, part = first[sent], part[sent]
    record = ((runs.anchor[first] & np.uint64((1 << (64 - CONTENT_BITS)) - 1)) << np.uint64(CONTENT_BITS)) | (runs.content[first] >> np.uint64(64 - CONTENT_BITS))
    return first, part, record, place


def _squeeze(values: np.ndarray) -> bytes:
    body = values.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _swell(body: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), kind)


def _thin(ids: np.ndarray) -> bytes:
    """The first id and the steps to the others, in as few bytes each as the largest needs; steps wrap around 2**64."""
    steps = np.diff(ids.view(np.uint64))
    return ids[:1].tobytes() + steps.astype(np.min_scalar_type(int(steps.max(initial=0)))).tobytes()


def _full(body: bytes, n: int) -> np.ndarray:
    """The n ids of _thin."""
    ids = np.empty(n, np.uint64)
    ids[0] = np.frombuffer(body, np.uint64, 1)[0]
    if n > 1:
        ids[1:] = np.frombuffer(body, f"u{(len(body) - 8) // (n - 1)}", offset=8)
    return np.cumsum(ids, out=ids).view(np.int64)


def _row_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def group_size(total: int) -> int:
    """Bytes of text in a group, of so many in the table."""
    return min(GROUP_MOST, max(GROUP_LEAST, total // GROUPS))


_GROUP = pa.schema([("g", pa.int32()), ("ids", pa.binary()), ("keys", pa.list_(pa.string())), ("sizes", pa.binary()), ("body", pa.binary())])


def _texts(sizes: bytes, body: bytes) -> list[bytes]:
    lengths = np.frombuffer(sizes, np.int64)
    view, ends = memoryview(_swell(body, np.uint8)), np.cumsum(lengths)
    return [view[e - n : e] for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]


def _grouped(docs: DataFrame, groups: int, buckets: int) -> str:
    """Write the texts (d, key, text) as a bucketed table of groups; its name."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [_squeeze(np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.binary())], ["g", "d", "key", "body"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, keys = None, [], set()

        def out() -> pa.RecordBatch:
            texts = [_swell(b, np.uint8) for _, _, b in held]
            return _row_batch([(g, np.array([d for d, _, _ in held], np.int64).tobytes(), [k for _, k, _ in held], np.array([len(t) for t in texts], np.int64).tobytes(), _squeeze(np.concatenate(texts)))], _GROUP)

        for batch in batches:
            for own, d, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != g:
                    if held:
                        yield out()
                    g, held, keys = own, [], set()
                if key not in keys:  # rows that repeat both id and text
                    keys.add(key)
                    held.append((d, key, body))
        if held:
            yield out()

    name = f"repeats_{uuid.uuid4().hex}"
    placed = docs.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("g"), "d", "key", "text").mapInArrow(squeeze, "g int, d long, key string, body binary")
    rows = placed.repartition(buckets, "g").sortWithinPartitions("g", "d").mapInArrow(gather, "g int, ids binary, keys array<string>, sizes binary, body binary")
    rows.write.bucketBy(buckets, "g").option("path", scratch_path(docs.sparkSession, name)).option("compression", "none").saveAsTable(name)
    return name


def _send_records(groups: DataFrame, parts: int, length: int, window: int) -> DataFrame:
    """p, g, records, sides, ids: what each group has to say to each part of the anchors."""
    schema = pa.schema([("p", pa.int32()), ("g", pa.int32()), ("records", pa.binary()), ("sides", pa.binary()), ("ids", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, ids, _, sizes, body in zip(*batch.columns, strict=True):
                ids = np.frombuffer(ids.as_py(), np.int64)
                found = []
                for runs in windows(_texts(sizes.as_py(), body.as_py()), ids, length, window):
                    first, part, record, _ = _records(runs, parts)
                    found.append((part, record, runs.sides(first), runs.ids[runs.doc[first]]))
                part = np.concatenate([f[0] for f in found])
                if not len(part):
                    continue
                order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
                record, sides, d = (np.concatenate([f[k] for f in found])[order] for k in (1, 2, 3))
                part = part[order]
                found.clear()
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                rows = [(int(part[a]), g, a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                for k in range(0, len(rows), ROWS):
                    yield _row_batch([(p, g.as_py(), record[a:b].tobytes(), sides[a:b].tobytes(), _thin(d[a:b])) for p, g, a, b in rows[k : k + ROWS]], schema)

    return in_tasks(groups, send, "p int, g int, records binary, sides binary, ids binary")


UNIQUE, KNOWN, COMPARED, DEALT = 0, 1, 2, 3


def _met(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row has the same key and side; a side of 0 meets none."""
    _, place, counts = np.unique((key << np.uint64(16)) | side.astype(np.uint64), return_inverse=True, return_counts=True)
    return (counts[place] > 1) & (side > 0)


def judge_records(record: np.ndarray, sides: np.ndarray, d: np.ndarray, hot: int = HOT_CONTENTS) -> np.ndarray:
    """A code for each record: KNOWN if a smaller id has the same, COMPARED (DEALT, if there are very many) if its anchor has other contents in another document that agree with it on one side.

    A passage that two contents share has at least half of what it is longer than the anchor on one side of it.
    """
    order = np.argsort(record)
    record, sides, d = record[order], sides[order], d[order]
    new = np.concatenate([[True], record[1:] != record[:-1]])
    same = np.cumsum(new) - 1
    known = d > np.minimum.reduceat(d, np.flatnonzero(new))[same]
    anchor = record >> np.uint64(CONTENT_BITS)
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    of_anchor = np.cumsum(new_anchor) - 1
    starts = np.flatnonzero(new_anchor)
    contents = np.add.reduceat(new.astype(np.int64), starts)
    low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(np.where(known, -1 << 62, d), starts)
    open_ = ~known & ((contents > 1) & (low < high))[of_anchor]
    at = np.flatnonzero(open_)
    open_[at] = _met(anchor[at], sides[at] >> np.uint32(16)) | _met(anchor[at], sides[at] & np.uint32(0xFFFF))
    code = np.where(known, KNOWN, np.where(open_, np.where((contents > hot)[of_anchor], DEALT, COMPARED), UNIQUE)).astype(np.uint8)
    out = np.empty(len(code), np.uint8)
    out[order] = code
    return out


def _judge(sent: DataFrame, hot: int) -> DataFrame:
    """g, p, codes: the answer to every row of records."""
    schema = pa.schema([("g", pa.int32()), ("p", pa.int32()), ("codes", pa.binary())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held = None, []

        def out() -> pa.RecordBatch:
            code = judge_records(*(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)), hot)
            ends = np.cumsum([len(h[1]) for h in held])
            return _row_batch([(g, p, code[e - len(r) : e].tobytes()) for (g, r, _, _), e in zip(held, ends.tolist(), strict=True)], schema)

        for batch in batches:
            for own, g, record, side, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != p:
                    if held:
                        yield out()
                    p, held = own, []
                held.append((g, np.frombuffer(record, np.uint64), np.frombuffer(side, np.uint32), _full(ids, len(record) // 8)))
        if held:
            yield out()

    return in_tasks(sent.repartition(F.col("p")).sortWithinPartitions("p", "g"), judge, "g int, p int, codes binary")


_PLACES = "g int, q int, ids binary, doc binary, at binary, size binary, body binary"


def _apply(groups: DataFrame, answers: DataFrame, parts: int, length: int, window: int) -> DataFrame:
    """Two kinds of rows. q null: removed places of a group (doc, at, size). q: runs to compare in part q, with their bytes."""
    schema = pa.schema([("g", pa.int32()), ("q", pa.int32()), *((n, pa.binary()) for n in ("ids", "doc", "at", "size", "body"))])
    answered = answers.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p", "codes"))).alias("codes"))

    def sent(g: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for rows in batched(_united(g, held), ROWS):
            yield _row_batch(list(rows), schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, ids, sizes, body, codes in zip(*batch.columns, strict=True):
                ids = np.frombuffer(ids.as_py(), np.int64)
                codes = codes.as_py()
                answers = np.frombuffer(b"".join(c["codes"] for c in codes), np.uint8)
                sizes_of = np.zeros(parts, np.int64)
                sizes_of[[c["p"] for c in codes]] = [len(c["codes"]) for c in codes]
                held, n, used = [], 0, np.cumsum(sizes_of) - sizes_of
                for runs in windows(_texts(sizes.as_py(), body.as_py()), ids, length, window):
                    first, part, _, place = _records(runs, parts)
                    if not len(first):
                        continue
                    counts = np.bincount(part, minlength=parts)
                    code = answers[(used - np.cumsum(counts) + counts)[part] + np.arange(len(part))]
                    used += counts
                    held.append(_answered(runs, first, place, code[place], parts))
                    n += int(held[-1][1][-1].sum())
                    if n > HELD_BYTES:
                        yield from sent(g.as_py(), held)
                        held, n = [], 0
                if held:
                    yield from sent(g.as_py(), held)

    joined = groups.select("g", "ids", "sizes", "body").join(answered.hint("shuffle_hash"), "g")
    return in_tasks(joined.select("g", "ids", "sizes", "body", "codes"), apply, _PLACES)


def _answered(runs: Window, first: np.ndarray, place: np.ndarray, code: np.ndarray, parts: int) -> tuple:
    """Of a window: the places that are removed; the runs to compare, with their part, begin in the data, ids and places; the data."""
    length, own = runs.length, runs.ids[runs.doc]
    behind = own > own[first][place]  # a smaller id of this window has the same content
    gone = [np.flatnonzero(behind | (code == KNOWN))]
    begins, ends = [runs.first[gone[0]]], [runs.last[gone[0]] + length]
    sent = []
    for kind in (COMPARED, DEALT):
        at = np.flatnonzero(~behind & (code == kind))
        begin, end, q = runs.first[at], runs.last[at] + length, runs.anchor[at]
        if kind == DEALT and len(at):
            n = runs.last[at] - begin + 1
            begin = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            end = begin + length
            q = runs.hashes(begin, end)
            _, one, of = np.unique(q, return_index=True, return_inverse=True)  # the first copy has the smallest id
            copy = (runs.data[begin[one][of][:, None] + np.arange(length)] == runs.data[begin[:, None] + np.arange(length)]).all(axis=1)
            holder = runs.ids[np.searchsorted(runs.begin, begin, side="right") - 1]
            later = copy & (holder > holder[one][of])
            begins.append(begin[later])
            ends.append(end[later])
            begin, end, q = begin[~later], end[~later], q[~later]
        sent.append((begin, end, ((q >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)))
    begin, end, q = (np.concatenate(x) for x in zip(*sent, strict=True))
    which = np.searchsorted(runs.begin, begin, side="right") - 1
    return _places(runs, np.concatenate(begins), np.concatenate(ends)), (q, begin, runs.ids[which], *_places(runs, begin, end)), runs.data


def _united(g: int, held: list[tuple]) -> Iterator[tuple]:
    """Rows of some windows of a group: the places that are removed, then the runs to compare, a row for each part."""
    yield g, None, None, *(np.concatenate([h[0][k] for h in held]).tobytes() for k in range(3)), None
    data = np.concatenate([h[2] for h in held])
    ahead = np.cumsum([0, *(len(h[2]) for h in held[:-1])])
    q, begin, ids, doc, at, size = (np.concatenate([h[1][k] + (a if k == 1 else 0) for h, a in zip(held, ahead.tolist(), strict=True)]) for k in range(6))
    order = np.argsort(q, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(q[order])) + 1) if len(order) else []:
        n = size[some].astype(np.int64)
        inside = np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield g, int(q[some[0]]), ids[some].tobytes(), doc[some].tobytes(), at[some].tobytes(), size[some].tobytes(), _squeeze(data[inside])


def _places(runs: Window, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    piece = np.searchsorted(runs.begin, begin, side="right") - 1
    return runs.docs[piece].astype(np.int32), begin - runs.begin[piece] + runs.offsets[piece], (end - begin).astype(np.int32)


def _shared_stretches(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, place in it and size of the stretches of passages whose hash segments of different ids have; no shared passage is left out."""
    begin = np.cumsum(sizes) - sizes
    powers, inverse = _power_tables(len(data) + 1)
    sums = _sums(data, powers)
    n = np.maximum(sizes - length + 1, 0)
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    segment = np.repeat(np.arange(len(sizes)), n)
    if not len(at):
        return at, at, at
    key = (sums[at + length] - sums[at]) * inverse[at]
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    starts, own = np.flatnonzero(new), ids[segment[order]]
    shared = np.zeros(len(at), bool)
    shared[order] = np.repeat(np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts), np.diff(np.append(starts, len(order))))
    kept = np.flatnonzero(shared)
    edge = np.append(True, (np.diff(at[kept]) > 1) | (np.diff(segment[kept]) > 0)) if len(kept) else np.zeros(0, bool)
    first = kept[edge]
    last = kept[np.append(edge[1:], True)] if len(kept) else first
    return segment[first], at[first] - begin[segment[first]], at[last] - at[first] + length


def shared_starts(segments: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of every passage that also starts in a segment of a smaller id, by a suffix array over all of them."""
    of, place, cut_sizes = _shared_stretches(segments, sizes, ids, length)
    if not len(of):
        return of, of
    at = (np.cumsum(sizes) - sizes)[of] + place
    segments = segments[np.repeat(at, cut_sizes) + np.arange(cut_sizes.sum()) - np.repeat(np.cumsum(cut_sizes) - cut_sizes, cut_sizes)]
    sizes, ids = cut_sizes, ids[of]
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.full(begin[-1], SEPARATOR, np.uint8)
    data[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = segments
    order = two_stage(data, length)
    holder = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(data)) + length <= (begin[:-1] + sizes)[holder]
    order = order[whole[order]]  # whole passages that are equal are neighbours among all suffixes, and among these
    if not len(order):
        return order, order
    segment = holder[order]
    alike = common_prefixes(data, order, length) >= length
    starts = np.flatnonzero(~alike) if not alike[0] else np.concatenate([[0], np.flatnonzero(~alike)])
    least = np.minimum.reduceat(ids[segment], starts)
    later = ids[segment] > np.repeat(least, np.diff(np.append(starts, len(order))))
    return of[segment[later]], place[segment[later]] + order[later] - begin[segment[later]]


def _compare(runs: DataFrame, length: int) -> DataFrame:
    """g, doc, at, size: places found by the suffix arrays, one for each part."""
    schema = pa.schema([("g", pa.int32()), *((n, pa.binary()) for n in ("doc", "at", "size"))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, held = None, []

        def out() -> pa.RecordBatch:
            group = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            ids, doc, at, size = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            segment, place = shared_starts(np.concatenate([h[5] for h in held]), size.astype(np.int64), ids, length)
            group, doc, at = group[segment], doc[segment], at[segment] + place
            order = np.lexsort((at, doc, group))
            group, doc, at = group[order], doc[order], at[order]
            edge = np.append(True, (np.diff(group) > 0) | (np.diff(doc) > 0) | (np.diff(at) > length)) if len(at) else np.zeros(0, bool)
            first, last = np.flatnonzero(edge), np.flatnonzero(np.append(edge[1:], True)) if len(at) else order  # passages in a row are one place
            group, doc, size, at = group[first], doc[first], (at[last] - at[first] + length).astype(np.int32), at[first]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            rows = [(int(group[a]), doc[a:b].tobytes(), at[a:b].tobytes(), size[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
            return _row_batch(rows, schema)

        for batch in batches:
            for own, g, ids, doc, at, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != q:
                    if held:
                        yield out()
                    q, held = own, []
                held.append((g, np.frombuffer(ids, np.int64), np.frombuffer(doc, np.int32), np.frombuffer(at, np.int64), np.frombuffer(size, np.int32), _swell(body, np.uint8)))
        if held:
            yield out()

    placed = runs.select("q", "g", "ids", "doc", "at", "size", "body").repartition(F.col("q")).sortWithinPartitions("q", "g")
    return in_tasks(placed, compare, "g int, doc binary, at binary, size binary")


_RESULT = "key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(groups: DataFrame, places: DataFrame) -> DataFrame:
    """Digest of each text after the places are removed."""
    schema = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    gathered = places.groupBy("g").agg(F.collect_list(F.struct("doc", "at", "size")).alias("places"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sizes, body, found in zip(*batch.columns, strict=True):
                texts, found = _texts(sizes.as_py(), body.as_py()), found.as_py() or []
                doc = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x["doc"], np.int32) for x in found)])
                start = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["at"], np.int64) for x in found)])
                end = start + np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x["size"], np.int32) for x in found)])
                order = np.lexsort((start, doc))
                doc, start, end = doc[order], start[order], end[order]
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                rows = []
                for key, text, a, b in zip(keys.as_py(), texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    reach = np.maximum.accumulate(end[a:b])
                    edge = np.append(True, start[a + 1 : b] > reach[:-1]) if b > a else np.zeros(0, bool)
                    first, last = start[a:b][edge].tolist(), reach[np.append(edge[1:], True)].tolist() if b > a else []
                    left, at = hashlib.sha256(), 0
                    for x, y in zip(first, last, strict=True):
                        left.update(text[at:x])
                        at = y
                    left.update(text[at:])
                    rows.append((key, len(text), sum(last) - sum(first), len(first), left.hexdigest()))
                yield _row_batch(rows, schema)

    joined = groups.select("g", "keys", "sizes", "body").join(gathered.hint("shuffle_hash"), "g", "left")
    return joined.select("keys", "sizes", "body", "places").mapInArrow(remove, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_bytes: int | None = None, part_bytes: int = PART_BYTES, hot: int = HOT_CONTENTS, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text)."""
    if length < ANCHOR:
        raise ValueError(f"passages have {ANCHOR} bytes at least")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"), F.md5(text).alias("key"), text.alias("text"))
    narrow = cut(keyed.select("doc_id", "d", "key", F.octet_length("text").cast("long").alias("n")), "narrow")
    least = narrow.groupBy("key").agg(F.min("d").alias("least"), F.max("n").alias("n"))
    rows = cut(narrow.drop("n").join(least, "key"), "rows")
    total = least.agg(F.sum("n")).first()[0] or 0
    copies = rows.where("d > least").select("d", "key")
    copies = F.broadcast(copies) if copies.count() <= SENT_COPIES else copies
    groups = max(1, ceil(total / (group_bytes or group_size(total))))
    parts = max(1, ceil(total / part_bytes))
    name = _grouped(keyed.join(copies, ["d", "key"], "left_anti"), groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        texts = spark.table(name)
        answers = cut(_judge(_send_records(texts, parts, length, window), hot), "answers")
        applied = cut(_apply(texts, answers, parts, length, window), "applied")
        found = _compare(applied.where("q IS NOT NULL"), length)
        places = applied.where("q IS NULL").select("g", "doc", "at", "size").unionByName(found)
        digests = cut(_remove(texts, cut(places, "places")), "digests")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    whole = (F.col("d") > F.col("least")) & (F.col("n") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    out = rows.join(digests, "key")
    return out.select("doc_id", F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(whole, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_repeats": op2_repeats}
