"""Token ids in a bit-packed file format.

Texts are encoded with a tokenizers vocabulary; each document's ids end with an end id. The ids of all documents, in ascending
id order, form one sequence. It is kept as a Parquet dataset of blocks: a block holds whole documents, about BLOCK_IDS ids,
every id in the fewest bits that the vocabulary needs, so one block unpacks with a few numpy calls and any document is found
from the block's offsets. Parquet is the container, so the files live wherever Spark can write and a lost executor's block is
written again.

Nulls: a null text is empty and has the end id alone; a null id sorts first. Repeated rows follow one another; ties are in the
order of their ids' checksum. An empty table gives an empty dataset. A very long
text is encoded in chunks; its ids are held whole.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import in_tasks, large, scratch_path, table

BLOCK_IDS = 1 << 16
#: Distinct words whose ids a task keeps; beyond them it begins anew.
KEPT_WORDS = 250_000
#: Bytes of text encoded at a time; the work arrays take about 50 times as much.
CHUNK = 512 << 10
OTHER, LETTER, SPACE, UNSURE = range(4)
#: Words up to this many bytes are looked up as two numbers of 64 bits, which hold their bytes and their size.
SHORT = 15
_FIRST = np.tril(np.full((SHORT + 1, 16), 255, np.uint8), -1)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Bytes of words that the pre-tokenizer may cut further: digits, fractions and contractions.
_MIXED = np.isin(np.arange(256), [*b"0123456789'\xc2"])


def _kinds() -> np.ndarray:
    """The kind of each character below 0x800. Latin, Greek and Cyrillic have the same here and in the library; the rest is unsure."""
    sure = re.compile("[\t\n\r\x20-\x7e\xa1-\u0377\u037a-\u037f\u0384-\u038a\u038c\u038e-\u03a1\u03a3-\u052f]")
    return np.array([(LETTER if c.isalnum() else SPACE if c.isspace() else OTHER) if sure.match(c) else UNSURE for c in map(chr, range(0x800))], np.uint8)


_KIND = _kinds()


def _byte_level() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    seen = [x for x in range(256) if 33 <= x <= 126 or 161 <= x != 173]
    return np.array([x if x in seen else 256 + x - sum(y < x for y in seen) for x in range(256)], "<u2")


_CHARACTER = _byte_level()


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below the vocabulary's size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of a fixed width, one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """Ids start to start + n of what pack() made, read without what comes before."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")[start * bits - 8 * first :][: n * bits]
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches of the given sizes, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character in UTF-8 data."""
    kind = _KIND[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC0)
    two = lead[data[lead] < 0xE0]
    kind[data >= 0x80] = UNSURE
    kind[two] = kind[two + 1] = _KIND[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
    return kind


def word_starts(data: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer cuts data; begins: where texts begin, at 0 too. A word keeps its digits and contractions.

    A run of white space before something else gives its last character away: a blank to the word after it, another stands alone.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    before = np.append(np.uint8(SPACE), kind[:-1])
    after = np.append(kind[1:], np.uint8(SPACE))
    quote = np.flatnonzero((data == 39) & (after == LETTER) & ~first[1:])
    inner = quote[(before[quote] == LETTER) & ~first[quote]]
    kind[inner] = LETTER
    new = first[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    blank = np.append(False, data[:-1] == 32) & ~first[:-1]
    new &= ~(blank & (kind != SPACE))
    last = (kind == SPACE) & (np.append(kind[1:], np.uint8(SPACE)) != SPACE) & ~first[1:]
    new |= last
    lone = quote[(first[quote] | ((kind[quote - 1] == SPACE) & (data[quote - 1] != 32))) & (kind[quote] == OTHER)]
    new[lone + 1] = False  # a contraction without its word
    return np.flatnonzero(new)


def _numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of at most SHORT bytes as two numbers each, different for different words."""
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(16, np.uint8)), 16)[starts] & _FIRST[sizes]
    rows[:, SHORT] = sizes
    return np.ascontiguousarray(rows.view("<u8").T)


class Encoder:
    """Encodes texts through the ids of their distinct words, as the byte-level pre-tokenizer cuts them.

    Byte-pair merges never cross these words, so a text's ids are those of its words, one after the other. Words are looked up
    by their bytes, short ones many at a time in a table of slots, and the library encodes the new ones: its model takes those
    that are one piece for the pre-tokenizer, the others go in one text, where the token of a leading space, or of a line feed
    put between, marks the next word. When enough words are kept, all are forgotten. Texts with other characters than _KIND is
    sure of, or with a special token, go to the library as a whole.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.bits = bits_for(self.library.get_vocab_size())
        self.spaced = np.zeros(1 << self.bits, bool)
        for token, at in self.library.get_vocab().items():
            self.spaced[at] = token.startswith("\u0120")
        self.feed = self._ids(["\n"])[0][0]
        self.most = kept
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Drop the words kept; the vocabulary stays. What is dropped takes no memory, and none is sent to the tasks with a driver's encoder."""
        self.slots = self.words = self.places = self.sizes = self.ids = None
        self.long = {}
        self.count = self.filled = 0

    def _begin(self) -> None:
        """Room for the words to be kept; memory is taken as words come."""
        self.forget()
        most = self.most + CHUNK // 2 + 256  # a chunk has no more distinct words than this adds
        self.slot_bits = most.bit_length() + 1
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        self.words, self.ids = np.empty((2, most), np.uint64), np.empty(4 * most, "<u4")
        self.places, self.sizes = np.empty(most, np.int64), np.empty(most, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of words that are one piece each, and how many each has."""
        text = _CHARACTER[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-16-le")
        ids, counts, at = [], [], 0
        for size in map(len, words):
            found = self.model.tokenize(text[at : at + size])
            ids += [t.id for t in found]
            counts.append(len(found))
            at += size
        return ids, counts

    def _mixed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any words, and how many each has."""
        got, alone = {}, []
        for spaced in (True, False):
            kind = [w for w in words if (w[0] == 32) == spaced]
            for at in range(0, len(kind), 10_000):
                part = kind[at : at + 10_000]
                ids = self._ids([(b"".join(part) if spaced else b"\n" + b"\n".join(part)).decode()])[0]
                starts = np.flatnonzero(self.spaced[ids] if spaced else ids == self.feed)
                if len(starts) != len(part) or starts[0]:
                    alone += part
                    continue
                body, places, skipped = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)], 0 if spaced else 4
                got.update(zip(part, [body[a + skipped : b] for a, b in zip(places[:-1], places[1:], strict=True)], strict=True))
        got.update(zip(alone, [ids.tobytes() for ids in self._ids([w.decode() for w in alone])], strict=True))
        found = list(map(got.__getitem__, words))
        return np.frombuffer(b"".join(found), "<u4"), np.array(list(map(len, found)), np.int64) // 4

    def _keep(self, ids, counts) -> np.ndarray:
        """Put the ids of new words behind those kept; the numbers of the words."""
        ids, counts = np.asarray(ids, "<u4"), np.asarray(counts, np.int64)
        k, at = self.count, self.filled
        self.count, self.filled = k + len(counts), at + len(ids)
        if self.filled > len(self.ids):
            self.ids = np.append(self.ids[:at], np.empty(self.filled, "<u4"))
        self.ids[at : self.filled] = ids
        self.places[k : self.count], self.sizes[k : self.count] = at + np.cumsum(counts) - counts, counts
        return np.arange(k, self.count, dtype=np.int32)

    def _slots_of(self, words: np.ndarray) -> np.ndarray:
        mixed = words[0] * _FACTORS[0] + words[1] * _FACTORS[1]
        return ((mixed ^ (mixed >> np.uint64(32))) * _FACTORS[0] >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """The numbers of short words that are kept, or -1."""
        found, left, slots = np.full(words.shape[1], -1, np.int32), np.arange(words.shape[1]), self._slots_of(words)
        while len(left):
            held = self.slots[slots]
            same = (held >= 0) & (self.words[0][held] == words[0][left]) & (self.words[1][held] == words[1][left])
            found[left[same]] = held[same]
            next_ = (held >= 0) & ~same
            left, slots = left[next_], (slots[next_] + 1) & (len(self.slots) - 1)
        return found

    def _add(self, words: np.ndarray, ids, counts) -> None:
        """Keep distinct new short words."""
        numbers, slots = self._keep(ids, counts), self._slots_of(words)
        self.words[:, numbers] = words
        while len(numbers):
            free = self.slots[slots] < 0
            self.slots[slots[free]] = numbers[free]
            left = self.slots[slots] != numbers
            numbers, slots = numbers[left], (slots[left] + 1) & (len(self.slots) - 1)

    def _numbers_of(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of words of data; new ones are encoded and kept."""
        numbers, body, mixed = np.empty(len(starts), np.int32), data.tobytes(), np.logical_or.reduceat(_MIXED[data], starts)
        cut = lambda some: [body[a:b] for a, b in zip(starts[some].tolist(), (starts + sizes)[some].tolist(), strict=True)]
        short, long = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        words = _numbers(data, starts[short], sizes[short])
        found = self._find(words)
        new = np.flatnonzero(found < 0)
        if len(new):
            new = new[np.lexsort(words[:, new])]
            first = new[np.append(True, (words[:, new[1:]] != words[:, new[:-1]]).any(0))]
            for encode, some in ((self._pieces, first[~mixed[short[first]]]), (self._mixed, first[mixed[short[first]]])):
                if len(some):
                    self._add(words[:, some], *encode(cut(short[some])))
            found[new] = self._find(words[:, new])
        numbers[short] = found
        if len(long):
            met = cut(long)
            fresh = {w: m for w, m in zip(met, mixed[long].tolist(), strict=True) if w not in self.long}
            for encode, some in ((self._pieces, [w for w, m in fresh.items() if not m]), (self._mixed, [w for w, m in fresh.items() if m])):
                if some:
                    self.long.update(zip(some, self._keep(*encode(some)).tolist(), strict=True))
            numbers[long] = list(map(self.long.__getitem__, met))
        return numbers

    def _chunk(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of data that begin at starts, and how many each has."""
        if self.slots is None or self.count > self.most or self.filled > 16 * self.most:
            self._begin()
        gc.disable()  # nothing here makes cycles, and the many strings would be scanned again and again
        numbers = self._numbers_of(data, starts, np.diff(np.append(starts, len(data))))
        gc.enable()
        counts = self.sizes[numbers]
        return self.ids[_stretches(self.places[numbers], counts)], counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none)."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            ends = offsets[at : stop + 1] - offsets[at]
            own = np.flatnonzero(np.diff(ends))
            ids, cuts = np.zeros(0, "<u4"), np.zeros(stop - at + 1, np.int64)
            if len(own):
                data = np.frombuffer(texts.buffers()[2], np.uint8, int(ends[-1]), int(offsets[at]))
                kind = kinds_of(data)
                whole = np.maximum.reduceat(kind, ends[own]) == UNSURE
                if any(x in memoryview(data).tobytes() for x in self.special):
                    whole |= [any(x in texts[at + k].as_buffer().to_pybytes() for x in self.special) for k in own.tolist()]
                starts = word_starts(data, kind, ends[own])
                text_of = np.searchsorted(ends[own], starts, side="right") - 1
                starts = starts[~whole[text_of] | np.isin(starts, ends[own])]
                ids, counts = self._words(data, starts, dict.fromkeys(ends[own][whole].tolist()))
                cuts = np.append(0, np.cumsum(counts))[np.searchsorted(starts, ends)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]
            at = stop

    def _words(self, data: np.ndarray, starts: np.ndarray, whole: dict[int, None]) -> tuple[np.ndarray, np.ndarray]:
        """As _chunk, for any length of data; the words at the places of `whole` are texts for the library."""
        ids, counts, k = [], [], 0
        ends = np.append(starts[1:], len(data))
        limits = sorted({*(np.flatnonzero(np.diff(starts // CHUNK)) + 1).tolist(), *np.searchsorted(starts, list(whole)).tolist(), len(starts)} | {i + 1 for i in np.searchsorted(starts, list(whole)).tolist()})
        for stop in limits:
            if stop > k:
                part = data[starts[k] : ends[stop - 1]]
                if int(starts[k]) in whole:
                    ids += self._ids([part.tobytes().decode()])
                    counts.append(np.array([len(ids[-1])]))
                else:
                    some, n = self._chunk(part, starts[k:stop] - starts[k])
                    ids.append(some)
                    counts.append(n)
                k = stop
        return np.concatenate(ids), np.concatenate(counts)


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return large(("encoder", path), lambda: Encoder(path))


def _parts(ids: np.ndarray, crc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each document. An id that fills several ranges (its bound repeats) is dealt over them by its checksum, in order."""
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return low + ((crc * (high - low + 1)) >> 32)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Packed ids of every document: part (a range of ids), doc_id, n, packed, crc. The bounds of the ranges, one number each, come from a pass over the ids alone."""
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    bounds = np.array(wanted or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 1024):
                packed, n, crc = [], [], []
                for found in own.encode(batch.column(1).slice(at, 1024)):
                    found = np.append(found, end)
                    n.append(len(found))
                    crc.append(zlib.crc32(found))
                    packed.append(pack(found, own.bits))
                some = ids.slice(at, len(n))
                part = _parts(some.fill_null(-(1 << 63)).to_numpy(), np.array(crc, np.int64), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), some, pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(crc, pa.int64())], ["part", "doc_id", "n", "packed", "crc"])
        own.forget()

    return in_tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "part int, doc_id long, n long, packed binary, crc long", keeps=True)


BLOCKS = "part int, block int, start_in_part long, n_ids long, bits int, doc_ids array<long>, doc_n array<long>, packed binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode the documents and write the dataset of blocks to path."""
    vocabulary = vocabulary or public_vocabulary()
    bits = encoder(vocabulary).bits

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_n", pa.list_(pa.int64())), ("packed", pa.binary())])
        part, block, start, waiting = None, 0, 0, 0
        held_ids: list = []
        held_n: list[int] = []
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            nonlocal block, start, held_ids, held_n, held
            total = sum(held_n)
            body = b"".join(held) if bits % 8 == 0 else pack(np.concatenate([unpack(x, bits, n) for x, n in zip(held, held_n, strict=True)]), bits)
            made = pa.RecordBatch.from_pylist([{"part": part, "block": block, "start_in_part": start, "n_ids": total, "bits": bits, "doc_ids": held_ids, "doc_n": held_n, "packed": body}], schema)
            block, start, held_ids, held_n, held = block + 1, start + total, [], [], []
            return made

        for batch in batches:
            for p, doc_id, n, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    if held:
                        yield out()
                    part, block, start, waiting = p, 0, 0, 0
                held_ids.append(doc_id)
                held_n.append(n)
                held.append(packed)
                waiting += n
                if waiting >= block_ids:
                    waiting = 0
                    yield out()
        if held:
            yield out()

    encoded = encode_documents(docs, vocabulary, end_id, parts)
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_tasks(encoded.repartition(n, "part").sortWithinPartitions("part", "doc_id", "crc"), blocks, BLOCKS).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `start`, the ids before them; the sums have a row for each part."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids from the files: doc_id, start, n_tokens, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, start, lengths, ids in _documents(batches):
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + offsets[:-1].astype(np.int64)), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "start", "n_tokens", "ids"])

    return in_tasks(_placed(spark, path).select("start", "n_ids", "bits", "doc_ids", "doc_n", "packed"), read, "doc_id long, start long, n_tokens long, ids array<int>")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            start, n, bits, doc_ids, lengths, packed = (batch.column(k)[row].as_py() for k in range(6))
            yield doc_ids, start, np.array(lengths, np.int64), unpack(packed, bits, n)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> list[int]:
    """Ids start to stop of the whole sequence; only the blocks that hold them are read and only those ids unpacked."""
    found: list[int] = []
    for b in _placed(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).select("start", "n_ids", "bits", "packed").orderBy("start").toLocalIterator():
        low, high = max(start, b.start) - b.start, min(stop, b.start + b.n_ids) - b.start
        found += unpack(b.packed, b.bits, high - low, low).tolist()
    return found


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Read back from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, start, lengths, ids in _documents(batches):
            ends = np.cumsum(lengths)
            body = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_tasks(_placed(spark, path).select("start", "n_ids", "bits", "doc_ids", "doc_n", "packed"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_rows(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' files to the shared folder and read them back as checksums."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, vocabulary)
    return checksums(spark, path)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))


QUERIES = {"op10_tokens": op10_tokens}
