"""MinHash near-duplicates by min-max hashing.

Each document's set of word shingles is hashed under PERMUTATIONS; of each both the smallest and the largest value are kept, so
every evaluation gives two signature values. Bands of BAND_ROWS values from different permutations make the bucket keys: at a
similarity of 0.8 a pair shares none of the 46 buckets about once in a million.

Documents with the same set are one node from the start. Inside a bucket every node is held against HUBS hub nodes, drawn by
hashes that differ among the bands, never all against all. Links are confirmed on the full sets and components are formed.
Only buckets that still hold several components go on: there the signatures of nodes of different components are compared,
and those that agree in LIKELY of their values are confirmed on the full sets too, in the same task; no pair leaves it but the
links. A large bucket is cut into blocks that go to many tasks, each with a bounded part of the nodes to compare them with. At 0.8 a signature agrees in less about three times in ten thousand million, so no link is lost between the hubs.

Nulls: a null or blank text has no shingles, is linked with nothing and keeps its own id; a null id is never the smallest id of
a component that has another. Rows that repeat an id are judged by their own texts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, in_tasks, set_aside, table
from kinegrid.llm.components import components

PERMUTATIONS, BAND_ROWS = 138, 6
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Hubs of a bucket, and different orders in which the bands draw them.
HUBS, DRAWS = 2, 8
#: Share of equal signature values from which a pair is confirmed in the end.
LIKELY = 0.65
#: Ids sent to every executor to pick documents; beyond it the documents are dealt out by id.
SENT_IDS = 500_000
#: Shingles of the members that a task compares at a time in a bucket of several components.
BLOCK = 1_000_000
#: Bytes kept of each shingle's hash where two sets are compared.
KEPT_BYTES = 5

_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_ROW_KEYS = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_POWERS = np.multiply.accumulate(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(max(n, 2 * len(_POWERS)), 0x9E3779B97F4A7C15, np.uint64))
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word; A-Z lower-cased, words parted by ASCII white space."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = data != 32
    if not inside.any():
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    new = np.concatenate([[True], np.diff(at) > 1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    terms = _BYTE[data[at]] * _powers(int(place.max()) + 1)[place]
    return _mix(np.add.reduceat(terms, first))


def shingle_set(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text's whole sequence is its one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(runs)]
    return np.unique(_mix(runs ^ np.uint64(size)))


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of the whole set."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The set's bucket keys, one for each band (half the bands hold minima, half maxima), and a byte of each signature value."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 1024):
        values = x[None, at : at + 1024] * _A + _B
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    values = np.concatenate([low, high])
    rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return _mix((rows * _ROW_KEYS).sum(axis=1, dtype=np.uint64)).view(np.int64), (_mix(values.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


SIGNATURE = "doc_id long, n long, node long, bands array<long>, signature binary, own long"


def _own(text: str = "text") -> Column:
    """A 64-bit key of the very text, to tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def signatures(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, n (shingles), node (key of the set; null if empty), bands, signature, own (key of the text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, nodes, bands, values = [], [], [], []
                for text in part.column(1):
                    own = shingle_set(text.as_py(), size)
                    n.append(len(own))
                    nodes.append(set_key(own) if len(own) else None)
                    keys, signature = band_keys(own) if len(own) else (own.view(np.int64), None)
                    bands.append(keys)
                    values.append(signature)
                ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands))), pa.array(values, pa.binary()), part.column(2)], ["doc_id", "n", "node", "bands", "signature", "own"])

    return in_tasks(docs.select(F.col("doc_id").cast("long"), "text", _own().alias("own")), sign, SIGNATURE)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The sets of the wanted nodes (node, doc_id of a document that has it): node, n, body (sorted hashes, KEPT_BYTES each)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = [shingle_set(t.as_py(), size) for t in part.column(0)]
                bodies = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :]).tobytes() for s in own]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) if len(s) else None for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(bodies, pa.binary())], ["node", "n", "body"])

    count = wanted.count()
    ids = wanted.select("doc_id").distinct()
    few = count <= SENT_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = cut(in_tasks(texts, make, "node long, n long, body binary"), "sets")
    return sets.dropDuplicates(["node"]) if sets.count() > count else sets  # more only if rows repeat an id


def _unpacked(body: bytes) -> np.ndarray:
    rows = np.frombuffer(body, np.uint8).reshape(-1, KEPT_BYTES)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, 8 - KEPT_BYTES :] = rows
    return wide.view(np.uint64).ravel()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, member) whose sets have 100 * intersection >= percent * union, as edges u, v."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_set = None, None
        for batch in batches:
            linked = []
            for hub, n_hub, hub_body, n, body in zip(*(batch.column(k) for k in (0, 2, 3, 4, 5)), strict=True):
                if (hub := hub.as_py()) != last:
                    last, hub_set = hub, _unpacked(hub_body.as_py())
                both = np.concatenate([hub_set, _unpacked(body.as_py())])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (n_hub.as_py() + n.as_py() - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    members = pairs.join(sets.withColumnRenamed("node", "member"), "member")
    hubs = sets.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("body").alias("hub_body"))
    # a pair can be linked only if its sizes allow it
    fit = (100 * F.col("n") >= percent * F.col("n_hub")) & (100 * F.col("n_hub") >= percent * F.col("n"))
    both = members.join(hubs, "hub").where(fit)
    return in_tasks(both.select("hub", "member", "n_hub", "hub_body", "n", "body"), check, "u long, v long")


def _with_hubs(keyed: DataFrame) -> DataFrame:
    """The members of buckets of two and more, each with its bucket's hubs: key, node, hub_0, hub_1. A bucket streams by; its first rows are its hubs. Neither column has nulls."""
    fields = [("key", pa.int64()), ("node", pa.int64()), *((f"hub_{k}", pa.int64()) for k in range(HUBS))]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)  # the first rows of the bucket that the last batch ended in
        empty = np.zeros(0, bool)
        told = empty
        for batch in batches:
            new = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1)
            rows, done = np.concatenate([held, new]), np.concatenate([told, np.zeros(len(new), bool)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            sizes = np.diff(np.append(starts, len(rows)))
            first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
            keep = (size > 1) & ~done
            hubs = [rows[np.minimum(first + k, first + size - 1), 1][keep] for k in range(HUBS)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(rows[keep, k] for k in range(2)), *hubs)], schema=pa.schema(fields))
            tail = slice(starts[-1], starts[-1] + HUBS)
            held = rows[tail]
            told = np.full(len(held), sizes[-1] > 1)

    draw = F.xxhash64("node", F.pmod("key", F.lit(DRAWS)))
    placed = keyed.repartition(F.col("key")).sortWithinPartitions("key", draw)
    return in_tasks(placed.select("key", "node"), stream, "key long, node long" + "".join(f", hub_{k} long" for k in range(HUBS)))


def _open(members: DataFrame) -> DataFrame:
    """Nodes of buckets that hold several components. members: key, node, label."""
    mixed = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")
    return members.join(mixed, "key", "left_semi")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """The members of each bucket dealt out as units of bounded size: key, b, c, role, and a member's own columns.

    The open members of a bucket, those outside its largest component, are cut into chunks (c), all its members into blocks (b),
    by hashes, so that each has about `block` shingles, or 16 times that. A unit is one chunk (role 0) against one block (role 1
    for open members, 2 for those of the largest component): together the units of a bucket hold every pair.
    """
    weight = F.sum(F.col("n") + 64)
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("rows"), weight.alias("w"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("rows", "label", "w")).alias("top"), F.sum("w").alias("w"))
    parts = lambda w, size: F.greatest(F.lit(1), F.ceil(w / F.lit(size))).cast("int")
    sizes = sizes.select("key", F.col("top.label").alias("top"), parts(F.col("w"), 16 * block).alias("blocks"), parts(F.col("w") - F.col("top.w"), block).alias("chunks"))
    unit = lambda b, c, role: F.struct(b.cast("int").alias("b"), c.cast("int").alias("c"), F.lit(role).alias("role"))
    spread = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    streamed = lambda role: F.transform(each("chunks"), lambda c: unit(spread("block", "blocks"), c, role))
    held = F.transform(each("blocks"), lambda b: unit(b, spread("chunk", "chunks"), 0))
    units = F.when(F.col("label") == F.col("top"), streamed(2)).otherwise(F.concat(held, streamed(1)))
    return members.join(sizes, "key").withColumn("unit", F.explode(units)).select("key", "unit.*", "node", "label", "signature", "n", "body")


def _links_between(open_members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links u, v between components that share a bucket, at least one for a node and another component it is linked with. open_members: key, node, label, signature, n, body.

    Within a bucket each node outside the largest component is held against the nodes of other components: first by the
    signatures, then, where LIKELY, on the full sets. A task keeps one chunk of the open members; the rest streams by, and only
    links leave the task.
    """

    class Side:
        def __init__(self, rows: list[tuple]):
            self.role, self.node, self.label, self.n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 4))
            self.values = np.stack([np.frombuffer(r[3], np.uint8) for r in rows])
            self.bodies = [r[5] for r in rows]

    def links(chunk: Side, sets: list[np.ndarray], seen: Side) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        for k in range(len(sets)):
            fit = (seen.label != chunk.label[k]) & (100 * np.minimum(seen.n, chunk.n[k]) >= percent * np.maximum(seen.n, chunk.n[k]))
            other = np.flatnonzero(fit & ((seen.role == 2) | (seen.node > chunk.node[k])))  # a pair of open members meets twice
            near = other[(seen.values[other] == chunk.values[k]).mean(axis=1) >= LIKELY]
            linked = []
            for j in near.tolist():
                own = _unpacked(seen.bodies[j])
                place = np.minimum(np.searchsorted(sets[k], own), len(sets[k]) - 1)
                common = int((sets[k][place] == own).sum())
                linked.append(100 * common >= percent * (chunk.n[k] + seen.n[j] - common))
            near = near[np.array(linked, bool)]
            _, one = np.unique(seen.label[near], return_index=True)
            found += [(int(chunk.node[k]), int(seen.node[j])) for j in near[one].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, chunk, sets, some, weight = None, [], None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, sets, held
            if chunk is None:
                chunk, sets, held = Side(held), [_unpacked(r[5]) for r in held], []
            return links(chunk, sets, Side(some))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for *own, role, node, label, signature, n, body in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    if own != unit or weight >= block:
                        if some:
                            yield flush()
                        some, weight = [], 0
                    if own != unit:
                        unit, held, chunk = own, [], None
                    if role == 0:
                        held.append((role, node, label, signature, n, body))
                    elif held or chunk:
                        some.append((role, node, label, signature, n, body))
                        weight += n + 64
        if some:
            yield flush()

    placed = _dealt(open_members, block).repartition(F.col("key"), F.col("b"), F.col("c")).sortWithinPartitions("key", "b", "c", "role")
    return in_tasks(placed.select("key", "b", "c", "role", "node", "label", "signature", "n", "body"), stream, "u long, v long")


def linked_nodes(signed: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """node, label of every node that is linked with a smaller one. signed, nodes: written tables."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    members = cut(_with_hubs(keyed), "members")
    pairs = members.select("node", F.explode(F.array(*[f"hub_{k}" for k in range(HUBS)])).alias("hub")).where("node != hub")
    pairs = pairs.select(F.least("node", "hub").alias("hub"), F.greatest("node", "hub").alias("member")).distinct()
    sets = _sets(docs, cut(nodes.select("node", "doc_id").join(members.select("node").distinct(), "node", "left_semi"), "wanted"), size)
    edges = cut(confirm(pairs, sets, percent), "links")
    labels = components(edges)
    labelled = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    left = cut(_open(labelled), "open")
    signature = signed.select("node", "signature").join(left.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    more = cut(_links_between(left.join(signature.join(sets, "node"), "node"), percent), "links")
    return components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))


def _labelled(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: signatures of the rows, nodes with an id each, and label (a node) of every node that is linked with a smaller one."""
    signed = cut(signatures(docs, size), "signatures")
    nodes = cut(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    return signed, nodes, cut(linked_nodes(signed, nodes, docs, percent, size), "labels")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest id reachable through links), kept (its own id is that)."""
    signed, nodes, labels = _labelled(docs, percent, size)
    least = nodes.select("node", F.col("doc_id").alias("least"))
    ends = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct()).join(least, "node")
    smallest = ends.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = ends.join(smallest, "label").select("node", "component_id")
    rows = signed.select("doc_id", "n", "node").join(least, "node", "left").join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "least"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each group, with its own columns, and all rows without shingles.

    The row with the smallest id stays (null ids last); of rows that share it, the one whose text has the smallest hash.
    """
    signed, _, labels = _labelled(docs, percent, size)
    rows = signed.where("node IS NOT NULL").groupBy("node", "doc_id", "own").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own", "n")).alias("first")
    chosen = rows.groupBy("node").agg(first).select("node", "first.doc_id", "first.own", "first.n").join(labels, "node", "left")
    chosen = chosen.groupBy(F.coalesce("label", "node").alias("label")).agg(first).select("first.doc_id", "first.own", (F.col("first.n") > 1).alias("again"))
    blank = signed.where("node IS NULL").select("doc_id", "own", F.lit(False).alias("again")).distinct()
    kept = cut(chosen.unionByName(blank).toDF("_id", "_own", "_again"), "kept")
    safe, back = set_aside(docs)
    sent = F.broadcast(kept) if kept.count() <= SENT_IDS else kept
    out = safe.join(sent, safe["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (_own() == kept["_own"]))
    once = out.where("NOT _again").select(*back)
    if not kept.where("_again").limit(1).count():
        return once
    whole = F.struct(*[F.col(f"`{c}`") for c in safe.columns])
    copies = out.where("_again").groupBy("_id", "_own").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row")).select("row.*")
    return once.unionAll(copies.select(*back))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80, size=2)


QUERIES = {"op6_minhash": op6_minhash}

ORACLE_SQL = {
    "op6_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM w, unnest(generate_series(1, greatest(1, len(w) - 1))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, w.doc_id = k.component_id AS kept FROM w JOIN k ON w.doc_id = k.a LEFT JOIN n ON w.doc_id = n.doc_id""",
}
