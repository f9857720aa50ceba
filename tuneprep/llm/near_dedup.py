"""Near-duplicate documents by bottom-k sketches.

Every document's distinct word shingles are hashed by one function. The ``SKETCH`` smallest
hashes are its sketch; the ``KEYS`` smallest of them put it into inverted lists. Two documents
that share a list are compared by the sketch of their union; what may be similar enough is
confirmed on the full sets. Documents with equal sets are one class with one representative.

Nothing is capped. Lists of up to ``LIST`` members are compared whole, in one task. A longer list is
the mark of a common passage, and a similar pair nearly always shares shorter lists too: of
``KEYS`` values two documents of similarity 0.8 share 12.8 on average, and fewer than ``HOT_KEYS``
with probability 4e-6. So only documents with ``HOT_KEYS`` or more values in long lists meet
there, in random blocks; sets of five or fewer from as many values on as a partner must share, as they
have no more to share. Then members that are still apart from their list's main
family are compared with all of the list, block by block. A pair of similarity 0.8 or more
shares no value at all with probability 0.2 ** KEYS, and its estimate falls below ``ESTIMATE`` with
probability about 1e-6.

The estimates only join documents into families, by few links in place of all pairs, so a group of n copies
costs about n rows and not its pairs. Any linked pair is inside one family. There the full sets
are compared: a family of up to ``LIST`` in one task, a larger one in blocks and then, for members
apart from its main component, against all its blocks.

Defined cases: a NULL or empty text, or one without words, has an empty set and links with nothing;
fewer words than a shingle make one shingle of the whole sequence; repeated texts are linked; rows of equal
doc_id are each returned, with the component of the smallest id any of them reaches; rows with NULL
doc_id are returned unlinked, with NULL component and kept; very long texts are hashed whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.components import components, joined
from tuneprep.llm.words import BASE, find_words, hash_words, mix, powers, slices, text_bytes, windows
from tuneprep.storage import materialize

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
SKETCH, KEYS = 64, 16
LIST, HOT_KEYS = 256, 5
ESTIMATE = 0.55
FILTER_BITS = 27
SET_BYTES = 6
PAD = np.uint32(0xFFFFFFFF)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    data, bounds = text_bytes(column)
    starts, ends, first = find_words(data, bounds)
    words = hash_words(data, starts, ends, lower=True, seed=3)
    hashes, at = windows(words, first, width)
    cut = np.searchsorted(at, first)
    factors = powers(width)
    for row, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        n = first[row + 1] - first[row]
        if 0 < n < width:
            whole = (words[first[row] : first[row + 1]] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n) * BASE
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.unique(hashes[a:b])


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, "text"):
            sets = list(shingle_sets(cut.column("text"), width))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": cut.column("doc_id"),
                    "n_shingles": np.array([len(s) for s in sets], np.int64),
                    "same": pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                    "keys": pa.array([s[:KEYS].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    "sketch": pa.array([(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                }
            )


def union_estimate(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarity of pairs of rows, from the smallest values of both sketches together."""
    both = np.sort(np.concatenate([sketches[i], sketches[j]], axis=1), axis=1)
    shared = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    rank = np.arange(both.shape[1] - 1) - (np.cumsum(shared, axis=1) - shared)
    size = np.minimum((both != PAD).sum(axis=1) - shared.sum(axis=1), SKETCH)
    return (shared & (rank < size[:, None])).sum(axis=1) / np.maximum(size, 1)


def _joined(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components with few links: every node with the smallest one that it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in parent if root(x) != x]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join whatever pairs may be similar, within each list block.

    Rows come sorted by (value, block, guest): rep, component, n_shingles, sketch. Guests are compared with
    the block's own rows only, and pairs of one component are left out.
    """
    for rows in _grouped(batches, ["value", "block"]):
        reps = rows.column("rep").to_numpy()
        comp = rows.column("component").to_numpy()
        sizes = rows.column("n_shingles").to_numpy()
        guest = rows.column("guest").to_numpy(zero_copy_only=False)
        group = rows.column("group").to_numpy()
        raw = rows.column("sketch").to_pylist()
        sketches = np.full((len(raw), SKETCH), PAD, np.uint32)
        for k, s in enumerate(raw):
            sketches[k, : len(s) // 4] = np.frombuffer(s, "<u4")
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        # Every own row with all later rows of its block.
        stop = np.repeat(ends, np.diff(np.append(0, ends)))
        later = np.where(guest, 0, stop - np.arange(len(stop)) - 1)
        found: list[tuple[int, int]] = []
        for a, b in _bands(later):
            left = np.repeat(np.arange(a, b), later[a:b])
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
            low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
            ok = (comp[left] != comp[right]) & (SIMILARITY[1] * low >= SIMILARITY[0] * high)
            left, right = left[ok], right[ok]
            if len(left):
                ok = union_estimate(sketches, left, right) >= ESTIMATE
                found += zip(reps[left[ok]].tolist(), reps[right[ok]].tolist(), strict=True)
            if len(found) > 1 << 17:
                found = _joined(found)
        if found:
            yield _pairs(_joined(found))


def _bands(later: np.ndarray, pairs: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of rows with a bounded number of pairs."""
    total = np.cumsum(later)
    a = 0
    while a < len(later):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + pairs, "right")))
        yield a, b
        a = b


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8_192) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group ends, with the group's number in column ``group``."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if len(rest) < rows:
            continue
        number = _numbers(rest, keys)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield _with_group(rest.slice(0, cut), number[:cut])
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield _with_group(rest, _numbers(rest, keys))


def _numbers(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(rows), bool)
    for key in keys:
        values = rows.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _with_group(rows: pa.Table, number: np.ndarray) -> pa.RecordBatch:
    return rows.append_column("group", pa.array(number)).combine_chunks().to_batches()[0]


def _id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of hashed ids: 16 bits for each id, at most ``2**bits`` (16 MB), so its size is bounded.

    It only spares work: what it lets through is joined exactly afterwards.
    """
    size = min(1 << bits, max(1 << 12, 1 << (16 * ids.count()).bit_length()))
    piece = 1 << 18
    places = ids.select(F.pmod(F.xxhash64("rep"), F.lit(size)).alias("place")).withColumn("piece", F.expr(f"place div {piece}"))

    def pack(rows):
        import pandas as pd

        marks = np.zeros(piece, np.uint8)
        marks[rows["place"].to_numpy() % piece] = 1
        return pd.DataFrame({"piece": rows["piece"][:1], "marks": [np.packbits(marks).tobytes()]})

    found = places.distinct().groupBy("piece").applyInPandas(pack, "piece long, marks binary").toPandas()
    marks = np.zeros((max(1, size // piece), piece // 8), np.uint8)
    for number, packed in zip(found["piece"], found["marks"], strict=True):
        marks[number] = np.frombuffer(packed, np.uint8)
    return np.unpackbits(marks.ravel())[:size].astype(bool)


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch, "text"):
            packed = []
            for s in shingle_sets(cut.column("text"), width):
                short = np.unique(s >> np.uint64(64 - 8 * SET_BYTES)).astype("<u8")
                packed.append(short.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(packed, pa.binary())], ["rep", "full"])


def _similar(own: list[np.ndarray], other: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Index pairs (own, other) whose sets are similar enough."""
    values, place = np.unique(np.concatenate([*own, *other]), return_inverse=True)
    sizes = np.array([len(x) for x in (*own, *other)])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = np.zeros(len(values), np.int64)
    base, n = starts[len(own)] if other else ends[-1], sizes[len(own) :]
    for i in range(len(own)):
        mine = place[starts[i] : ends[i]]
        marks[mine] = 1
        both = np.add.reduceat(marks[place[base:]], starts[len(own) :] - base)
        marks[mine] = 0
        for j in np.flatnonzero(SIMILARITY[1] * both >= SIMILARITY[0] * (sizes[i] + n - both)):
            yield i, int(j)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between members of a family's block, and between its own members and guests, joined to few.

    Rows come sorted by (family, block, guest): rep, component, full. Own members are held, guests pass by
    ``LIST`` at a time.
    """
    key, own, guests = None, [], []
    pairs: list[tuple[int, int]] = []

    def flush(last: bool) -> None:
        for others in (own if last and len(own) > 1 and not seen_guests[0] else [], guests):
            if own and others:
                for i, j in _similar([x[2] for x in own], [x[2] for x in others]):
                    x, y = own[i], others[j]
                    if x[1] != y[1]:
                        pairs.append((min(x[0], y[0]), max(x[0], y[0])))
        guests.clear()

    seen_guests = [False]
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("family", "block", "guest", "rep", "component", "full"))
        for family, block, guest, rep, component, full in zip(*columns, strict=True):
            if (family, block) != key:
                flush(True)
                key, seen_guests[0] = (family, block), False
                own.clear()
            wide = np.zeros((len(full) // SET_BYTES, 8), np.uint8)
            wide[:, :SET_BYTES] = np.frombuffer(full, np.uint8).reshape(-1, SET_BYTES)
            row = (rep, component, wide.view("<u8").ravel())
            if guest:
                seen_guests[0] = True
                guests.append(row)
                if len(guests) == LIST:
                    flush(False)
            else:
                own.append(row)
        if len(pairs) > 4096:
            yield _pairs(_joined(pairs))
            pairs.clear()
    flush(True)
    if pairs:
        yield _pairs(_joined(pairs))


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _with_guests(rows: DataFrame, key: str, blocks, salt: int) -> DataFrame:
    """Deal members of each ``key`` to blocks; those outside its main component also visit all other blocks."""
    block = F.pmod(F.xxhash64("rep", F.lit(salt)), blocks).cast("int")
    rows = rows.withColumns({"block": block, "guest": F.lit(False)})
    sizes = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(key).agg(F.max(F.struct("n", "component")).alias("m"))
    rows = rows.join(main.select(key, F.col("m.component").alias("main")), key)
    visits = F.array_except(F.sequence(F.lit(0), blocks - 1), F.array("block"))
    guests = rows.where("component <> main").withColumns({"block": F.explode(visits), "guest": F.lit(True)})
    return rows.unionByName(guests).drop("main")


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows with their component so far, without the keys whose members are all in one."""
    rows = rows.join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "rep")), "labelled")
    apart = rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return rows.join(apart.where("lo <> hi").select(key), key, "left_semi")


class NearDuplicates:
    """The steps of one run over (doc_id, text)."""

    def __init__(self, docs: DataFrame, width: int = SHINGLE_WORDS):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width = width
        schema = "doc_id long, n_shingles long, same binary, keys array<long>, sketch binary"
        self.sketches = materialize(self.docs.mapInArrow(lambda b: _sketches(b, width), schema), "sketches")
        counted = self.sketches.where("n_shingles > 0 and doc_id is not null")
        self.classes = materialize(
            counted.groupBy("same").agg(
                F.min("doc_id").alias("rep"),
                F.first("n_shingles").alias("n_shingles"),
                F.first("keys").alias("keys"),
                F.first("sketch").alias("sketch"),
            ),
            "classes",
        )

    def lists(self) -> DataFrame:
        """(value, rep, members, hot) of all lists with several members that can give a pair."""
        # Two different sets share at most n of n + 1 values, so the smallest sets have no partner.
        paired = self.classes.where(f"n_shingles * {SIMILARITY[1] - SIMILARITY[0]} >= {SIMILARITY[0]}")
        least = F.expr(f"least({HOT_KEYS}, ({SIMILARITY[0]} * n_shingles + {SIMILARITY[1] - 1}) div {SIMILARITY[1]})")
        keys = paired.select("rep", least.alias("least"), F.explode("keys").alias("value"))
        counts = keys.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = materialize(
            keys.join(counts, "value").withColumn("hot", F.col("members") > LIST), "shared-values"
        )
        hot_reps = shared.where("hot").groupBy("rep", "least").count().where("count >= least").select("rep")
        hot = shared.where("hot").join(hot_reps, "rep", "left_semi").select("value", "rep")
        hot_counts = hot.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        hot = hot.join(hot_counts, "value").withColumn("hot", F.lit(True))
        return materialize(shared.where("not hot").drop("least").unionByName(hot), "lists")

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Links of maybe similar pairs over rows with value, block, guest, rep and component."""
        members = rows.join(self.classes.select("rep", "n_shingles", "sketch"), "rep")
        columns = ["value", "block", "guest", "rep", "component", "n_shingles", "sketch"]
        dealt = members.select(*columns).repartition("value", "block").sortWithinPartitions("value", "block", "guest", "rep")
        return dealt.mapInArrow(_compare, "a long, b long")

    def families(self) -> DataFrame:
        """(node, component): documents joined by estimates; every linked pair is in one family."""
        lists = self.lists()
        blocks = F.ceil(F.col("members") / LIST).cast("int")
        block = F.pmod(F.xxhash64("rep", F.lit(0)), blocks).cast("int")
        first = lists.withColumns({"component": F.col("rep"), "block": block, "guest": F.lit(False)})
        labels = components(self.candidates(first))
        hot = lists.where("hot").drop("hot")
        if hot.isEmpty():
            return labels
        rest = _with_guests(_labelled(hot, labels, "value"), "value", blocks, 2)
        return joined(labels, self.candidates(rest))

    def full_sets(self, reps: DataFrame) -> DataFrame:
        """(rep, full): whole shingle sets of the given representatives, from another scan of the texts."""
        known = self.docs.sparkSession.sparkContext.broadcast(_id_filter(reps))

        @F.arrow_udf("boolean")
        def maybe(places: pa.Array) -> pa.Array:
            return pa.array(known.value[places.to_numpy(zero_copy_only=False)])

        width = self.width
        place = F.pmod(F.xxhash64("doc_id"), F.lit(len(known.value)))
        passing = self.docs.where(F.col("doc_id").isNotNull()).where(maybe(place))
        sets = passing.mapInArrow(lambda b: _full_sets(b, width), "rep long, full binary")
        return materialize(sets.join(reps, "rep", "left_semi"), "full-sets")

    def linked(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """True links, joined to few, over rows with family, block, guest, rep and component."""
        members = rows.join(sets, "rep").select("family", "block", "guest", "rep", "component", "full")
        dealt = members.repartition("family", "block").sortWithinPartitions("family", "block", "guest", "rep")
        return dealt.mapInArrow(_link, "a long, b long")

    def components(self) -> DataFrame:
        """(node, component) by true links alone."""
        families = self.families().select(F.col("node").alias("rep"), F.col("component").alias("family"))
        sets = self.full_sets(families.select("rep"))
        sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
        members = materialize(families.join(sizes, "family"), "members")
        blocks = F.ceil(F.col("members") / LIST).cast("int")
        block = F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int")
        first = members.withColumns({"component": F.col("rep"), "block": block, "guest": F.lit(False)})
        labels = components(self.linked(first, sets))
        large = members.where(F.col("members") > LIST)
        if large.isEmpty():
            return labels
        # Within its block every member has met all others; what is apart there visits the other blocks.
        apart = _labelled(large, labels, "family")
        return joined(labels, self.linked(_with_guests(apart, "family", blocks, 3), sets))

    def run(self) -> DataFrame:
        labels = self.components().withColumnsRenamed({"node": "rep"})
        of_class = self.classes.select("same", "rep").join(labels, "rep", "left")
        of_class = of_class.select("same", F.coalesce("component", "rep").alias("component_id"))
        counted = F.when(F.col("n_shingles") > 0, F.col("same"))  # empty sets join nothing
        found = self.sketches.select("doc_id", "n_shingles", counted.alias("same")).join(of_class, "same", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
        return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    return NearDuplicates(docs, width).run()


def deduplicate(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all columns; NULL ids stay.

    Only the ids to drop are joined with the documents.
    """
    dropped = near_duplicates(docs, width).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
