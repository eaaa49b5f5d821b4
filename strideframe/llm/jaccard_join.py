"""Exact Jaccard join of word-shingle sets by pivots, regions and triangle-inequality windows.

Documents with one and the same set are first folded into one. A total order of shingles that puts
frequent ones last gives every set a prefix; two sets that reach the similarity share a shingle of
their prefixes, and the first that they share is an early one of the smaller set. The sets of a
shingle, by size, fall into runs without a gap that the similarity rules out; a run begins with a set that
has the shingle early, its pivot. All runs of a pivot form its region, so that every linked pair meets in a
region. Shingles are dealt out packed, ten bytes each, with a short tag of the set; tags that several sets
share are regions, too. Regions above `block` members are dealt out as pairs of blocks. A parity sketch, whose Hamming distance never
exceeds the symmetric difference, tells which members of a region can be linked at all; only their full
sets are shipped, once for each group of such members. In a group the metric-space join proper runs: Voronoi cells around pivots,
windows by the triangle inequality that copy boundary members, and recursion down to small cells.
Only links that join two so far separate groups leave a task, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import SIMILAR, WORDS_A_SHINGLE, kept_table
from strideframe.llm.components import components

#: A sketch has the next power of two from twice the set's size on, so that unrelated sets of any size differ in it.
LEAST_BITS = 256
#: One set in so many is counted to find frequent shingles; the order changes speed only, never results.
COUNTED = 16
FREQUENT = 8
FREQUENT_BITS = 1 << 23
MOST_FREQUENT = 1 << 20
#: Rows whose texts and sets a Python task holds at a time; Spark's batches are larger.
SLICE = 512
#: A shingle of a prefix as it is dealt out: the upper half of its hash, a tag of its set, and the
#: set's size class twice, plus one if a smaller or equal set must have met it before.
POSTING = np.dtype([("rest", "<i4"), ("tag", "<i4"), ("tag_top", "i1"), ("rank", "i1")])
TAG_BYTES = 5
#: Size classes a factor of 1 / similarity spans, and their most distance between linked sets (one more, for rounding).
CLASSES = 2
#: Postings that a bucket holds on average, and that a task packs at a time.
BUCKET = 1 << 16
PACK = 1 << 18
MOST_BUCKETS = 1 << 23


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z in lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if len(found) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)] if found else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(found) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _bits(n: int) -> int:
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def _sketch(shingles: np.ndarray) -> bytes:
    bits = _bits(len(shingles))
    parity = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _profiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _slices(batches):
            ids, sizes, keys, sketches, counted = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = shingle_set(text, width)
                key = _set_id(shingles)
                ids.append(doc_id)
                sizes.append(len(shingles))
                keys.append(key)
                sketches.append(_sketch(shingles) if len(shingles) else None)
                counts = key[0] % COUNTED == 0 and key not in seen
                if counts:
                    seen.add(key)
                counted.append(shingles.view(np.int64).tolist() if counts else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, pa.binary()), pa.array(counted, pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "sketch", "counted"])
    return run


def _size_class(n: int) -> int:
    return min(127, int(CLASSES * math.log(n) / math.log(SIMILAR[1] / SIMILAR[0])))


def _prefixes(width: int, frequent: bytes, buckets: int, tag_bytes: int):
    """Packed postings of the prefixes, a row for each bucket of shingles met in some sets of the task."""
    bits = np.frombuffer(frequent, np.uint8)
    low, high = SIMILAR

    def packed(postings: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        postings, bucket = postings[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(postings[c]))) for c in POSTING.names]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *lists], names=["bucket", *POSTING.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, places, n_held = [], [], 0
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                shingles = shingle_set(text, width)
                n = len(shingles)
                key = _set_id(shingles)
                if not n or key in seen:
                    continue
                seen.add(key)
                slot = (shingles % np.uint64(FREQUENT_BITS)).astype(np.int64)
                late = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                ordered = np.concatenate([shingles[~late], shingles[late]]) if late.any() else shingles
                ordered = ordered[:n - (-(-low * n // high)) + 1]
                tag = np.int64(int.from_bytes(key[:tag_bytes], "big"))
                postings = np.empty(len(ordered), POSTING)
                postings["rest"] = (ordered >> np.uint64(32)).astype(np.int32)
                postings["tag"], postings["tag_top"] = tag.astype(np.int32), (tag >> 32).astype(np.int8)
                postings["rank"] = (2 * _size_class(n) + (np.arange(len(ordered)) * (high + low) > n * (high - low))).astype(np.int8)
                held.append(postings)
                places.append(((ordered & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
                n_held += len(ordered)
                if n_held >= PACK:
                    yield packed(np.concatenate(held), np.concatenate(places))
                    held, places, n_held = [], [], 0
        if held:
            yield packed(np.concatenate(held), np.concatenate(places))
    return run


def _unpacked(packed: DataFrame) -> DataFrame:
    """(place, tag): bucket, rest and rank of each posting in one number, which sorts by shingle and rank."""
    unsigned = lambda c, most: F.col(c)[F.col("at")].cast("long").bitwiseAND(F.lit(most))
    each = packed.select("*", F.posexplode("rest").alias("at", "value"))
    place = F.shiftleft("bucket", 40).bitwiseOR(F.shiftleft(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 8)).bitwiseOR(unsigned("rank", 0xFF))
    return each.select(place.alias("place"), unsigned("tag", 0xFFFFFFFF).bitwiseOR(F.shiftleft(unsigned("tag_top", 0xFF), 32)).alias("tag"))


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, tag) of the runs of each shingle; the input is sorted by place.

    A set goes on if it stands at most the similarity's distance behind one that has the shingle
    early. The last such set is all that is carried from batch to batch, under its pivot's tag.
    """
    place, tag = np.array([], np.int64), np.array([], np.int64)
    for batch in batches:
        place, tag = (np.concatenate([old, new.to_numpy()]) for old, new in zip((place, tag), batch.columns, strict=True))
        shingle, sizes = place >> 8, (place & 0xFF) >> 1
        early = np.flatnonzero(place & 1 == 0)
        if not len(early):
            place, tag = place[:0], tag[:0]
            continue
        begins = np.ones(len(early), bool)
        begins[1:] = (shingle[early[1:]] != shingle[early[:-1]]) | (sizes[early[1:]] - sizes[early[:-1]] > CLASSES + 1)
        pivot = early[np.maximum.accumulate(np.where(begins, np.arange(len(early)), 0))]
        last = np.searchsorted(early, np.arange(len(place)), "right") - 1
        near = early[last]
        meets = (last >= 0) & (shingle[near] == shingle) & (sizes - sizes[near] <= CLASSES + 1)
        pivots = tag[pivot[last]]
        meets &= pivots != tag
        yield pa.RecordBatch.from_arrays([pa.array(pivots[meets]), pa.array(tag[meets])], names=["pivot", "tag"])
        place, tag = place[early[-1:]], tag[pivot[-1:]]


def _frequent_bits(profiles: DataFrame) -> bytes:
    """A bit table of fixed size that marks shingles which many sets hold."""
    counts = profiles.where("counted is not null").select(F.explode("counted").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    counts = kept_table(counts, "frequent")
    by_size = counts.groupBy(F.floor(F.log2("count")).alias("size")).count().orderBy(F.desc("size")).collect()  # at most 64 rows
    least, total = 64, 0
    for row in by_size:
        total += row["count"]
        if total > MOST_FREQUENT:
            break
        least = row["size"]
    slot = F.pmod(F.col("shingle"), F.lit(FREQUENT_BITS))
    parts = (counts.where(F.floor(F.log2("count")) >= least).select(slot.alias("slot"))
             .groupBy(F.floor(F.col("slot") / 32768).cast("long").alias("part"))
             .agg(F.bitmap_construct_agg(F.pmod(F.col("slot"), F.lit(32768)).cast("long")).alias("bits")))
    table = np.zeros(FREQUENT_BITS // 8, np.uint8)
    for row in parts.toLocalIterator():  # at most FREQUENT_BITS / 32768 rows of 4 KB
        piece = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[row["part"] * 4096:row["part"] * 4096 + len(piece)] |= piece
    return table.tobytes()


def close_groups(members: list[tuple[int, bytes, int]], crossed: bool) -> list[list[int]]:
    """Places of members (size, sketch, block), grouped by pairs whose size and sketch allow the similarity.

    A sketch folds to half its length, so sets on both sides of a power of two compare as well.
    `crossed` leaves out pairs within a block, which another task sees. Members without a partner
    are in no group; linked members are always in one.
    """
    low, high = SIMILAR
    order = sorted(range(len(members)), key=lambda k: members[k][0])
    whole = [int.from_bytes(members[k][1], "little") for k in order]
    sizes = [members[k][0] for k in order]
    blocks = [members[k][2] for k in order]
    groups = _Groups(len(order))
    for i, n in enumerate(sizes):
        bits, mine, block = _bits(n), whole[i], blocks[i]
        for j in range(i + 1, len(order)):
            m = sizes[j]
            if n * high < m * low:
                break
            if crossed and blocks[j] == block:
                continue
            other = whole[j]
            if _bits(m) != bits:
                other = (other ^ (other >> bits)) & ((1 << bits) - 1)
            if (mine ^ other).bit_count() * (high + low) <= (n + m) * (high - low):
                groups.join(i, j)
    out: dict[int, list[int]] = {}
    for k in range(len(order)):
        out.setdefault(groups.find(k), []).append(order[k])
    return [g for g in out.values() if len(g) > 1]


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal first columns; the input is clustered by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if held and held[0][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of close members, named by their members, so that a group met in many regions is one."""
    for rows in _runs(batches, 3):
        for group in close_groups([(r[5], r[6], r[3]) for r in rows], rows[0][1] != rows[0][2]):
            keys = sorted(rows[k][4] for k in group)
            name = xxhash.xxh3_128_digest(b"".join(keys))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.binary()), pa.array(keys, pa.binary())], names=["group", "key"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, 1):
        links = linked_groups([np.frombuffer(r[2], np.uint64) for r in rows])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in links], pa.binary()), pa.array([rows[j][1] for _, j in links], pa.binary())], names=["left", "right"])


class _Groups:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def linked_groups(sets: list[np.ndarray], cell: int = 32, pivots: int = 8) -> list[tuple[int, int]]:
    """Links that span the groups of sets with a Jaccard distance of at most 1 - similarity.

    Metric-space join: pivots split the members into Voronoi cells; a member is copied to each
    cell whose pivot is at most twice the reach further than its own. Cells are joined in the same
    way. Where cells overlap too much to help, or are small, one pivot at a time is compared with
    all; then only members beyond its reach, and those within it that the triangle inequality does
    not part from them, go on.
    """
    low, high = SIMILAR
    reach = (high - low) / high
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.array([], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    groups, links = _Groups(len(sets)), []

    def shared(pivot: int, members: np.ndarray, joined: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mine = flat[starts[pivot]:starts[pivot + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[joined], offsets)
        mark[mine] = False
        return common

    def distances(pivot: int, members: np.ndarray, joined: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        common = shared(pivot, members, joined, offsets)
        union = sizes[pivot] + sizes[members] - common
        for other in members[common * high >= union * low].tolist():
            if other != pivot and groups.join(pivot, other):
                links.append((pivot, other))
        return 1 - common / union

    def laid_out(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([flat[starts[m]:starts[m + 1]] for m in members]), np.concatenate([[0], np.cumsum(sizes[members])[:-1]])

    waiting = [np.arange(len(sets))]
    while waiting:
        members = waiting.pop()
        if len(members) < 2:
            continue
        joined, offsets = laid_out(members)
        if len(members) > cell:
            chosen = members[:: max(1, len(members) // pivots)][:pivots]
            apart = np.stack([distances(p, members, joined, offsets) for p in chosen])
            if len({groups.find(int(m)) for m in members}) == 1:
                continue
            window = apart <= apart.min(axis=0) + 2 * reach + 1e-9
            cells = [members[w] for w in window]
            if sum(map(len, cells)) <= 1.5 * len(members) and max(map(len, cells)) < 0.8 * len(members):
                waiting += cells
                continue
            rest = ~np.isin(members, chosen)
            members = members[rest]
            if len(members) < 2:
                continue
            joined, offsets = laid_out(members)
        apart = distances(int(members[0]), members, joined, offsets)
        outer = apart > reach + 1e-9
        if outer.any():
            boundary = ~outer & (apart >= apart[outer].min() - reach - 1e-9)
            boundary[0] = outer[0] = False
            waiting.append(np.concatenate([members[outer], members[boundary]]))
    return links


def jaccard_classes(docs: DataFrame, width: int = WORDS_A_SHINGLE, block: int = 512, tag_bytes: int = TAG_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the groups of documents that links connect.

    Two documents link when 100 * |A and B| >= 75 * |A or B| for their sets of `width`-word
    shingles, A-Z in lower case; with fewer words the whole sequence is the one shingle. A null,
    empty or blank text has an empty set, links with nothing and is its own component. Rows that
    repeat a doc_id give a row each, and share the least component id of their texts' groups. Rows
    with a null doc_id have no identity to report and are left out. Other columns are ignored. `block`
    and `tag_bytes` (5 at most) change the work only, never results.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = kept_table(texts.mapInArrow(_profiles(width), "doc_id long, n long, key binary, sketch binary, counted array<long>"), "profiles")
    sets = kept_table(profiles.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    frequent = _frequent_bits(profiles)

    low, high = SIMILAR
    postings = profiles.agg(F.sum(F.col("n") - F.ceil(F.col("n") * low / high) + 1)).head()[0] or 0
    buckets = min(MOST_BUCKETS, -(-postings // BUCKET) or 1)
    packed = texts.select("text").mapInArrow(_prefixes(width, frequent, buckets, tag_bytes), "bucket long, rest array<int>, tag array<int>, tag_top array<tinyint>, rank array<tinyint>")
    met = _unpacked(packed.repartition("bucket")).sortWithinPartitions("place", "tag")  # by Spark: a task keeps one Python worker
    reach = kept_table(met.mapInArrow(_reached, "pivot long, tag long").distinct(), "reach")

    tagged = sets.select("key", "n", "sketch", F.conv(F.hex(F.substring("key", 1, tag_bytes)), 16, 10).cast("long").alias("tag"))
    shared = tagged.groupBy("tag").count().where("count > 1").select(F.col("tag").alias("pivot"))
    pivots = reach.select("pivot").unionByName(shared).distinct().select("pivot", F.col("pivot").alias("tag"))
    members = reach.unionByName(pivots)

    blocks = kept_table(members.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    sized = members.join(blocks, "pivot")
    mine = F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int")
    cells = sized.select("pivot", "tag", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("pivot", "tag", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))

    cells = cells.join(tagged, "tag").select("pivot", "a", "b", "mine", "key", "n", "sketch")
    clustered = cells.repartition("pivot", "a", "b").sortWithinPartitions("pivot", "a", "b")
    active = kept_table(clustered.mapInArrow(_close, "group binary, key binary").distinct(), "active")

    wanted = active.select("key").distinct().join(sets.select("key", "first"), "key").select(F.col("first").alias("doc_id"), "key")
    wanted = kept_table(wanted, "wanted")
    slots = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(FREQUENT_BITS)).alias("slot"))
    table = np.zeros(FREQUENT_BITS // 8, np.uint8)  # a bit table of fixed size: it only spares texts the join
    for row in (slots.groupBy(F.floor(F.col("slot") / 32768).cast("long").alias("part"))
                .agg(F.bitmap_construct_agg(F.pmod(F.col("slot"), F.lit(32768)).cast("long")).alias("bits")).toLocalIterator()):
        piece = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[row["part"] * 4096:row["part"] * 4096 + len(piece)] |= piece
    bits = table.tobytes()

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = np.frombuffer(bits, np.uint8), set()
        for batch in _slices(batches):
            slot = batch.column(2).to_numpy()
            keep = np.flatnonzero((marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            keys, values = [], []
            for text in batch.column(1).take(pa.array(keep)).to_pylist():
                shingles = shingle_set(text, width)
                key = _set_id(shingles)
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    values.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "shingles"])

    found = texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FREQUENT_BITS)).alias("slot")).mapInArrow(full_sets, "key binary, shingles binary")
    found = kept_table(found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "found")

    clustered = active.join(found, "key").select("group", "key", "shingles").repartition("group").sortWithinPartitions("group")
    links = kept_table(clustered.mapInArrow(_joined, "left binary, right binary").distinct(), "links")
    ids = sets.select(F.col("key").alias("left"), F.col("first").alias("u"))
    edges = links.join(ids, "left").join(ids.select(F.col("left").alias("right"), F.col("u").alias("v")), "right").select("u", "v")
    repeated = profiles.where("n > 0").join(sets.select("key", "first"), "key").where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    if _ids_repeat(profiles):
        edges = edges.unionByName(repeated)
        classes = kept_table(components(edges, "u", "v"), "classes")
        return profiles.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    classes = kept_table(components(edges, "u", "v"), "classes")
    named = sets.select("key", F.col("first").alias("node")).join(classes, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return profiles.select("doc_id", "n", "key").join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _ids_repeat(profiles: DataFrame) -> bool:
    return not profiles.groupBy("doc_id").count().where("count > 1").isEmpty()
