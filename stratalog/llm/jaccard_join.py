"""Exact n-gram Jaccard self-join by pivots, their regions and triangle-inequality windows.

Jaccard distance is a metric. Almost every pair of documents is at distance 1, so regions around
freely chosen pivots would all be replicated into each other. The regions are therefore seeded by
prefix filtering, which decides the candidates: a pivot meets the sets that share one of its rarest
shingles. A set belongs to the region of every pivot that it meets, not to that of the nearest one
alone, so this is no Voronoi partition, and a region that is too large is cut by distance to its pivot,
not around new pivots. The metric's part is in the rings and windows:

1. A set that is linked with another has at most (1 - t) of its shingles alone. Sets with more are
   linked with nothing; they are found by counting a share of all shingles, chosen by hash.
2. Of each remaining set the rarest shingles are its keys, one more than it can have alone, by one
   ranking for all sets; linked sets have a key in common.
3. Pivots and regions. Each key with several sets has the set with the smallest id as pivot; a
   pivot's region is all sets that share any of its keys. Linked sets share a key and so a region.
4. Recursion. A region small enough for a task is joined there: each set in turn is the pivot of
   what is left, distances to it are exact, and sets whose distances from the region's pivot differ
   by more than the link distance are not compared. A larger region is cut into distance rings
   around its pivot, as wide as the link distance, and those into blocks; each block meets the
   blocks of its own and of the next ring (the boundary window), each meeting in a task of its own.
   Sets that are linked to the pivot are not compared with one another: they are connected already.

Regions return a spanning forest of their links, so a group of N copies makes fewer than N rows per
task. Equal sets are one class before any of this. Components come from alternating star
contraction, on tables of classes, with no collection on the driver. Shingles meet in packed sorted
blocks; ones that many sets of a block share are kept out of their buckets and only marked there, so
no bucket grows with a hot group. Nothing is capped or sampled: `block_shingles` and `bucket_bytes`
only decide how large a task gets.

Defined results: null or wordless texts have the empty set and are linked with nothing, each its
own component; a text of fewer than n words has its whole sequence as its one shingle; rows with
equal ids count as one document (their links add up); rows with a null id take part and get the
smallest id of their component, null if there is none; ids that aren't whole numbers are compared as
text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import byte_batches, dropped, free_name, lean, size_of, small_batches, utf8, written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _mix(a):
    """A 64-bit finaliser (splitmix64), vectorised."""
    import numpy as np

    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of word n-grams; keeps the hashes of words it has seen."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: bytes | None):
        import numpy as np
        import xxhash

        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 7)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
        return np.unique(out)


def set_id(shingles) -> int:
    """A 64-bit hash of a set's shingles."""
    import numpy as np

    with np.errstate(over="ignore"):
        return int(_mix(np.add.reduce(_mix(shingles ^ np.uint64(0x51ED270B)), keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


SIGNED = "kind int, doc_id long, set_id long, n_shingles long, kept long, block long, member int, bucket int, first long, steps binary, members binary"
DOCUMENT, KEYS, FREQUENT = 0, 1, 2
KEY_BITS, BLOCK_SETS, BLOCK_KEYS = 48, 60_000, 2_000_000
FREQUENT_SETS, ELSEWHERE, FILLER = 32, 65_001, 65_002


def most_unshared(n, percent: int):
    """How many of its n shingles a set can have alone if it is linked with another."""
    return (100 - percent) * n // 100


def _key_rows(block: int, keys: list, buckets: int):
    """The keys of a block's sets as rows (KEYS): (bucket, first, steps, members), sorted, as steps of
    32 bits with the sets' numbers in the block. Keys of FREQUENT_SETS sets or more become rows of
    their own (FREQUENT) and leave one mark (ELSEWHERE) for every FREQUENT_SETS sets."""
    import numpy as np

    member = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    flat, member = flat[order], member[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((first, [len(flat)])))
    rows, keep = [], np.ones(len(flat), dtype=bool)
    for at, n in zip(first[size >= FREQUENT_SETS].tolist(), size[size >= FREQUENT_SETS].tolist()):
        rows.append((FREQUENT, None, None, None, None, block, None, None, int(flat[at]), None, member[at : at + n].astype("<u2").tobytes()))
        marks = n // FREQUENT_SETS
        keep[at + marks : at + n] = False
        member[at : at + marks] = ELSEWHERE
    flat, member = flat[keep], member[keep]
    bucket = flat // -(-(1 << KEY_BITS) // buckets)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(flat) else []
    for a, b in zip(edges[:-1], edges[1:]):
        own, who = flat[a:b], member[a:b]
        steps = np.diff(own, prepend=own[0])
        if (steps >> 32).any():  # steps of more than 32 bits are made of several
            fill = steps >> 32
            places = np.repeat(np.arange(len(own)), fill + 1)
            last = np.concatenate((places[1:] != places[:-1], [True]))
            who = np.where(last, who[places], FILLER)
            steps = np.where(last, steps[places] - (fill[places] << 32) + fill[places], (1 << 32) - 1)
        rows.append((KEYS, None, None, None, None, block, None, int(bucket[a]), int(own[0]), steps.astype("<u4").tobytes(), who.astype("<u2").tobytes()))
    return rows


def _signed_batch(rows: list, id_kind: str = "long"):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64() if id_kind == "long" else pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(SIGNED.split(", "), kinds)])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)


class _Block:
    """Numbers sets within blocks and yields the rows of full blocks. Blocks are numbered on from a random
    62-bit number: a task may run several of these, one after another, with one partition number."""

    def __init__(self, buckets: int):
        import secrets

        self.buckets, self.block, self.keys, self.held = buckets, secrets.randbits(62), [], 0

    def add(self, keys) -> tuple[int, int]:
        self.keys.append(keys)
        self.held += len(keys)
        return self.block, len(self.keys) - 1

    def rows(self, last: bool = False, id_kind: str = "long"):
        if self.keys and (last or len(self.keys) >= BLOCK_SETS or self.held >= BLOCK_KEYS):
            if rows := _key_rows(self.block, self.keys, self.buckets):
                yield _signed_batch(rows, id_kind)
            self.block, self.keys, self.held = self.block + 1, [], 0


def _id(docs: DataFrame, doc_id: str):
    """The ids as they are compared and returned: whole numbers as long, all others as text."""
    whole = isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.col(f"`{doc_id}`").cast("long" if whole else "string")


def _digest(text: str):
    """Tells texts under one document id, or without any, apart when a set's text is looked up."""
    return F.xxhash64(text)


def _signatures(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Of (_id, _text). DOCUMENT rows: each document's set and, for the first of equal sets in a task, its
    block and number there and (in first) its text's digest. KEYS and FREQUENT rows: a share of the sets' shingles, chosen by hash, twice as
    large as the share that a linked set can have alone."""
    id_kind = docs.schema["_id"].dataType.simpleString().replace("bigint", "long")
    share = min(1 << 16, (100 - percent) * 2 * (1 << 16) // 100 + 1)

    def run(batches):
        import numpy as np

        shingler, seen, block = Shingler(n), set(), _Block(buckets)
        for batch in byte_batches(batches, "_text", 8 << 20):
            out = []
            for did, digest, value in zip(batch.column("_id").to_pylist(), batch.column("_digest").to_pylist(), utf8(batch.column("_text"))):
                s = shingler(value)
                sid = set_id(s) if len(s) else None
                if len(seen) > 500_000:
                    seen.clear()
                if sid is None or sid in seen:
                    out.append((DOCUMENT, did, sid, len(s), *[None] * 7))
                    continue
                seen.add(sid)
                keys = s[(s & np.uint64(0xFFFF)) < np.uint64(share)] >> np.uint64(64 - KEY_BITS)
                out.append((DOCUMENT, did, sid, len(s), len(keys), *block.add(keys), None, digest, None, None))
                yield from block.rows(id_kind=id_kind)
            if out:
                yield _signed_batch(out, id_kind)
        yield from block.rows(last=True, id_kind=id_kind)

    return docs.select("_id", "_text", _digest("_text").alias("_digest")).mapInArrow(lean(run), SIGNED.replace("doc_id long", f"doc_id {id_kind}"))


def _entries(table):
    """(keys, members, blocks) of a bucket's KEYS rows, sorted by key, and for every entry how many
    sets have its key (marks count FREQUENT_SETS)."""
    import numpy as np

    keys, members, blocks = [], [], []
    for first, steps, who, block in zip(*(table.column(c).to_pylist() for c in ("first", "steps", "members", "block"))):
        keys.append(first + np.cumsum(np.frombuffer(steps, dtype="<u4").astype(np.int64)))
        members.append(np.frombuffer(who, dtype="<u2").astype(np.int32))
        blocks.append(np.full(len(keys[-1]), block, dtype=np.int64))
    keys, members, blocks = np.concatenate(keys), np.concatenate(members), np.concatenate(blocks)
    real = members != FILLER
    keys, members, blocks = keys[real], members[real], blocks[real]
    order = np.argsort(keys, kind="stable")
    keys, members, blocks = keys[order], members[order], blocks[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sets = np.add.reduceat(np.where(members == ELSEWHERE, FREQUENT_SETS, 1), first)
    return keys, members, blocks, np.repeat(sets, np.diff(np.concatenate((first, [len(keys)]))))


def _by_block(blocks, *columns):
    """(block, bytes of each column's part) for every block, from parallel arrays."""
    import numpy as np

    order = np.argsort(blocks, kind="stable")
    blocks, columns = blocks[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))) if len(blocks) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield (int(blocks[a]), *(c[a:b].tobytes() for c in columns))


def _possible(held: DataFrame, percent: int) -> DataFrame:
    """(set_id, doc_id, digest) of the sets that don't have too many shingles alone."""

    def shared(table):
        import pyarrow as pa

        _, members, blocks, sets = _entries(table)
        own = (sets > 1) & (members != ELSEWHERE)
        rows = list(_by_block(blocks[own], members[own].astype("<u2")))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "members": pa.array([r[1] for r in rows], pa.binary())})

    met = held.filter(F.col("kind") == KEYS).select("bucket", "block", "first", "steps", "members").groupBy("bucket").applyInArrow(shared, "block long, members binary")
    frequent = held.filter(F.col("kind") == FREQUENT).select("block", "members")
    none, id_kind = lambda t: F.lit(None).cast(t), held.schema["doc_id"].dataType.simpleString()
    documents = held.filter((F.col("kind") == DOCUMENT) & F.col("block").isNotNull()).select("block", none("binary").alias("members"), "member", "set_id", "doc_id", F.col("first").alias("digest"), "n_shingles", "kept")
    rows = met.unionByName(frequent).select("block", "members", none("int").alias("member"), none("long").alias("set_id"), none(id_kind).alias("doc_id"), *(none("long").alias(c) for c in ("digest", "n_shingles", "kept")))

    def count(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sets = table.filter(pc.is_valid(table.column("member")))
        if not sets.num_rows:
            return sets.select(["set_id", "doc_id", "digest"])
        member = sets.column("member").to_numpy()
        n = np.zeros(int(member.max()) + 1, dtype=np.int64)
        for who in table.column("members").to_pylist():
            if who is not None:
                n += np.bincount(np.frombuffer(who, dtype="<u2"), minlength=len(n))
        alone = sets.column("kept").to_numpy() - n[member]
        keep = alone <= most_unshared(sets.column("n_shingles").to_numpy(), percent)
        return sets.filter(pa.array(keep)).select(["set_id", "doc_id", "digest"])

    return documents.unionByName(rows).groupBy("block").applyInArrow(count, f"set_id long, doc_id {id_kind}, digest long")


def _rare_keys(spark, sets: DataFrame, percent: int, buckets: int, size: int) -> DataFrame:
    """(key, set_id): each set's rarest shingles, one more than it can have alone. Shingles are ranked
    by the logarithm of the number of sets that have them, then by hash; two linked sets have one of
    theirs in common. Shingles that no other set has are left out."""

    def pack(batches):
        import numpy as np

        block = _Block(buckets)
        for batch in batches:
            shingles = batch.column("shingles")
            offsets, flat = np.asarray(shingles.offsets), np.asarray(shingles.values).view(np.uint64)
            out = []
            for k, sid in enumerate(batch.column("set_id").to_pylist()):
                s = flat[offsets[k] : offsets[k + 1]]
                keys = np.unique(s >> np.uint64(64 - KEY_BITS))
                out.append((DOCUMENT, None, sid, len(s), len(keys), *block.add(keys), *[None] * 4))
                yield from block.rows()
            if out:
                yield _signed_batch(out)
        yield from block.rows(last=True)

    held = written(spark, sets.mapInArrow(lean(pack), SIGNED), "rare-keys", size, spark.sparkContext.defaultParallelism)
    ranked = "block long, members binary, ranks binary, keys binary, first long, rank int"

    def rank(table):
        import numpy as np
        import pyarrow as pa

        keys, members, blocks, sets_ = _entries(table)
        ranks = np.floor(np.log2(sets_)).astype(np.uint8)
        own = (sets_ > 1) & (members != ELSEWHERE)
        rows = [(*r, None, None) for r in _by_block(blocks[own], members[own].astype("<u2"), ranks[own], keys[own].astype("<i8"))]
        marked = members == ELSEWHERE
        found, at = np.unique(keys[marked], return_index=True)
        rows += [(None, None, None, None, int(k), int(r)) for k, r in zip(found.tolist(), ranks[marked][at].tolist())]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
        columns = list(zip(*rows)) or [[]] * 6
        return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(ranked.split(", "), columns, kinds)})

    met = held.filter(F.col("kind") == KEYS).select("bucket", "block", "first", "steps", "members").groupBy("bucket").applyInArrow(rank, ranked)
    met = written(spark, met, "ranks", size, spark.sparkContext.defaultParallelism)
    frequent = held.filter(F.col("kind") == FREQUENT).select("block", "members", "first")
    frequent = frequent.join(met.filter("block is null").select("first", "rank"), "first").select("block", "members", F.lit(None).cast("binary").alias("ranks"), F.lit(None).cast("binary").alias("keys"), "first", "rank")
    none = lambda t: F.lit(None).cast(t)
    numbers = [none(t).alias(c) for c, t in (("member", "int"), ("set_id", "long"), ("n_shingles", "long"), ("kept", "long"))]
    rows = met.filter("block is not null").unionByName(frequent).select("*", *numbers)
    documents = held.filter(F.col("kind") == DOCUMENT).select(
        "block", *(none(t).alias(c) for c, t in (("members", "binary"), ("ranks", "binary"), ("keys", "binary"), ("first", "long"), ("rank", "int"))), "member", "set_id", "n_shingles", "kept"
    )

    def choose(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sets_ = table.filter(pc.is_valid(table.column("member")))
        members, ranks, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for who, r, k, first, one in zip(*(table.column(c).to_pylist() for c in ("members", "ranks", "keys", "first", "rank"))):
            if who is None:
                continue
            members.append(np.frombuffer(who, dtype="<u2").astype(np.int64))
            size = len(members[-1])
            ranks.append(np.full(size, one, np.int64) if r is None else np.frombuffer(r, dtype=np.uint8).astype(np.int64))
            keys.append(np.full(size, first, np.int64) if k is None else np.frombuffer(k, dtype="<i8"))
        members, ranks, keys = np.concatenate(members), np.concatenate(ranks), np.concatenate(keys)
        number = sets_.column("member").to_numpy()
        width = int(number.max()) + 1 if len(number) else 0
        n, kept, ids = (np.zeros(width, np.int64) for _ in range(3))
        n[number], kept[number], ids[number] = (sets_.column(c).to_numpy() for c in ("n_shingles", "kept", "set_id"))
        order = np.lexsort((keys, ranks, members))
        members, keys = members[order], keys[order]
        common = np.bincount(members, minlength=width)
        place = np.arange(len(members)) - np.repeat(np.cumsum(common) - common, common)
        wanted = most_unshared(n, percent) + 1 - (kept - common)
        own = place < wanted[members]
        return pa.table({"key": pa.array(keys[own], pa.int64()), "set_id": pa.array(ids[members[own]], pa.int64())})

    return documents.unionByName(rows).groupBy("block").applyInArrow(choose, "key long, set_id long")


def _shingle_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of wanted's (set_id, doc_id, digest), from the texts once more. The texts are
    shuffled compressed."""

    def packed(batches):
        import pyarrow as pa
        import zstandard

        codec = zstandard.ZstdCompressor(level=1)
        for batch in byte_batches(batches, "_text", 8 << 20):
            packed_texts = pa.array([codec.compress(t or b"") for t in utf8(batch.column("_text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_digest"), packed_texts], names=["_id", "_digest", "_packed"])

    def run(batches):
        import pyarrow as pa
        import zstandard

        codec, shingler = zstandard.ZstdDecompressor(), Shingler(n)
        for batch in byte_batches(batches, "_packed", 4 << 20):
            out: list = [[], []]
            for sid, value in zip(batch.column("set_id").to_pylist(), batch.column("_packed").to_pylist()):
                s = shingler(codec.decompress(value))
                if len(s) and set_id(s) == sid:  # another text under the same document id is not the one asked for
                    out[0].append(sid)
                    out[1].append(s.view("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["set_id", "shingles"])

    rows = docs.select("_id", "_text", _digest("_text").alias("_digest"))
    rows = rows.mapInArrow(lean(packed), f"_id {docs.schema['_id'].dataType.simpleString()}, _digest long, _packed binary")
    wanted = wanted.hint("merge")  # it grows with the corpus; the same plan at every size
    rows = rows.join(wanted, rows["_id"].eqNullSafe(wanted["doc_id"]) & (rows["_digest"] == wanted["digest"])).select("set_id", "_packed")
    return rows.mapInArrow(lean(run), "set_id long, shingles array<long>")


def local_links(ids, sets, percent: int, sides=None, skip=None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (sorted arrays), found pivot by pivot. sides: 0/1
    per set; then only sets of different sides are compared. skip: sets not compared with each other."""
    import numpy as np

    m = len(ids)
    if m < 2:
        return []
    size = np.array([len(x) for x in sets], dtype=np.int64)
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    mark = np.zeros(len(vocabulary), dtype=np.int64)

    def shared(i: int, low: int, high: int):
        """Sizes of the intersections of set i with the sets from low to high."""
        own = flat[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        end = starts[high - 1] + size[high - 1]
        common = np.add.reduceat(mark[flat[starts[low] : end]], starts[low:high] - starts[low])
        mark[own] = 0
        return common

    # In the order of distance from the first pivot; a set meets those in its window only.
    common = shared(0, 0, m)
    distance = 1 - common / (size + size[0] - common)
    order = np.argsort(distance, kind="stable")
    ids, size, distance = np.asarray(ids)[order], size[order], distance[order]
    flat = np.concatenate([flat[starts[k] : starts[k] + n] for k, n in zip(order.tolist(), size.tolist())])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    sides = None if sides is None else np.asarray(sides)[order]
    skip = None if skip is None else np.asarray(skip, dtype=bool)[order]
    ends = np.searchsorted(distance, distance + (100 - percent) / 100 + 1e-9, "right")
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(m - 1):
        low, high = i + 1, int(ends[i])
        if low >= high:
            continue
        common = shared(i, low, high)
        near = 100 * common >= percent * (size[low:high] + size[i] - common)
        if sides is not None:
            near &= sides[low:high] != sides[i]
        if skip is not None and skip[i]:
            near &= ~skip[low:high]
        for j in (np.flatnonzero(near) + low).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                links.append((int(ids[i]), int(ids[j])))
    return links


def _region_links(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, block_shingles: int, spark, size: int) -> DataFrame:
    """Links (a, b) of the regions in members (pivot, set_id), each region's pivot included."""
    members = members.join(sizes, "set_id")
    regions = members.groupBy("pivot").agg(F.sum("n_shingles").alias("total"))
    small = F.col("total") <= block_shingles
    members = members.join(regions, "pivot")

    def joined(key, table):
        import numpy as np
        import pyarrow as pa

        ids = np.asarray(table.column("set_id"))
        _, keep = np.unique(ids, return_index=True)
        shingles = table.column("shingles").combine_chunks()
        offsets, flat = np.asarray(shingles.offsets), np.asarray(shingles.values)
        sets = [flat[offsets[i] : offsets[i + 1]] for i in keep.tolist()]
        names = table.column_names
        side = np.asarray(table.column("side"))[keep] if "side" in names else None
        skip = np.asarray(table.column("linked"))[keep] if "linked" in names else None
        links = local_links(ids[keep], sets, percent, None if side is None or not side.any() else side, skip)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    with_sets = members.join(sets, "set_id")
    out = with_sets.filter(small).select("pivot", "set_id", "shingles").groupBy("pivot").applyInArrow(joined, "a long, b long")

    # Large regions: exact distances from the pivot, then rings as wide as the link distance.
    pivots = sets.join(regions.filter(~small).select(F.col("pivot").alias("_p")), sets["set_id"] == F.col("_p"), "left_semi")
    pivots = pivots.select(F.col("set_id").alias("pivot"), F.col("shingles").alias("_pivot_set"))
    common = F.size(F.array_intersect("shingles", "_pivot_set"))
    union = F.size("shingles") + F.size("_pivot_set") - common
    far = with_sets.filter(~small).join(pivots, "pivot")
    # Ring k holds distances over (k - 1) * r up to k * r: linked sets are in one ring or in neighbours.
    # Rings 0 and 1 are linked to the pivot and count as ring 1.
    r = max(100 - percent, 1)
    ring = F.expr(f"greatest(1, cast((100 * differ + whole * {r} - 1) div (whole * {r}) as int))")
    far = far.select("pivot", "set_id", "n_shingles", (union - common).alias("differ"), union.alias("whole")).withColumn("ring", ring).drop("differ", "whole")
    far = written(spark, far, "rings", size, spark.sparkContext.defaultParallelism)
    near_pivot = far.filter((F.col("ring") == 1) & (F.col("set_id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("set_id").alias("b"))
    counts = far.groupBy("pivot", "ring").agg(F.sum("n_shingles").alias("held"))
    blocks = counts.select("pivot", "ring", F.greatest(F.lit(1), F.ceil(F.col("held") * 2 / block_shingles)).cast("int").alias("n"))
    after = blocks.select("pivot", (F.col("ring") - 1).alias("ring"), F.col("n").alias("n_next"))
    before = blocks.select("pivot", (F.col("ring") + 1).alias("ring"), F.col("n").alias("n_before"))
    far = far.join(blocks, ["pivot", "ring"]).join(after, ["pivot", "ring"], "left").join(before, ["pivot", "ring"], "left")
    far = far.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n")).cast("int"))
    none = F.expr("cast(array() as array<struct<r1:int,b1:int,r2:int,b2:int,side:int>>)")
    meet = "named_struct('r1', {}, 'b1', {}, 'r2', {}, 'b2', {}, 'side', {})"
    same = F.expr(
        "transform(sequence(0, n - 1), k -> " + meet.format("ring", "least(block, k)", "ring", "greatest(block, k)", "if(block <= k, 0, 1)") + ")"
    )
    up = F.expr("transform(sequence(0, n_next - 1), k -> " + meet.format("ring", "block", "ring + 1", "k", "0") + ")")
    down = F.expr("transform(sequence(0, n_before - 1), k -> " + meet.format("ring - 1", "k", "ring", "block", "1") + ")")
    meetings = F.concat(
        F.when(F.col("ring") > 1, same).otherwise(none),
        F.when(F.col("n_next").isNotNull(), up).otherwise(none),
        F.when(F.col("n_before").isNotNull(), down).otherwise(none),
    )
    far = far.select("pivot", "set_id", (F.col("ring") == 1).alias("linked"), F.explode(meetings).alias("m")).select("pivot", "set_id", "linked", "m.*")
    far = far.join(sets, "set_id")
    across = far.groupBy("pivot", "r1", "b1", "r2", "b2").applyInArrow(lambda key, t: joined(key, t), "a long, b long")
    return out.unionByName(near_pivot).unionByName(across)


def components(edges: DataFrame, a: str = "a", b: str = "b", about: int | None = None) -> DataFrame:
    """(node, root): each node of edges with the smallest node that it is connected with, by
    alternating large-star and small-star rounds. Tables of edges only; nothing goes to the driver
    but a count and a checksum a round."""
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now, state = written(spark, now, "edges", about, 2), None
    for _ in count():  # each round brings nodes nearer to their roots
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        before, now = now, written(spark, small, "edges", 8 * size_of(now), least=2)
        dropped(before)
        got = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = got


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, block_shingles: int = 400_000, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id of its component of
    documents whose n-gram sets have a Jaccard similarity of percent / 100 or more)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(_id(docs, doc_id).alias("_id"), F.col(f"`{text}`").alias("_text"))
    size = size_of(docs)
    buckets = max(64, min(1 << 20, size // bucket_bytes))
    held = written(spark, _signatures(docs, n, percent, buckets), "signatures", size)
    signed = held.filter(F.col("kind") == DOCUMENT).select("doc_id", "set_id", "n_shingles")
    possible_ = written(spark, _possible(held, percent), "possible", size, spark.sparkContext.defaultParallelism)
    possible = possible_.groupBy("set_id").agg(F.min(F.struct("doc_id", "digest")).alias("d")).select("set_id", "d.*")
    sets = written(spark, _shingle_sets(docs, n, possible).dropDuplicates(["set_id"]), "sets", size)
    keys = written(spark, _rare_keys(spark, sets, percent, buckets, size), "keys", size, spark.sparkContext.defaultParallelism)
    shared = keys.groupBy("key").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last")).filter("pivot != last").select("key", "pivot")
    members = written(spark, keys.join(shared, "key").select("pivot", "set_id").distinct(), "members", size, spark.sparkContext.defaultParallelism)
    sizes = sets.select("set_id", F.size("shingles").cast("long").alias("n_shingles"))
    links = _region_links(members, sets, sizes, percent, block_shingles, spark, size)
    # Rows that share a document id are one document: their classes are connected.
    repeated = signed.filter("set_id is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"))
    several = repeated.filter("a != b").select("doc_id", "a")
    same = signed.join(several, "doc_id").select("a", F.col("set_id").alias("b")).filter("a != b and b is not null")
    roots = components(links.unionByName(same), about=size)
    dropped(possible_, sets, keys, members)
    classes = signed.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "root").select("set_id", "component_id")
    out = signed.select("doc_id", "set_id", "n_shingles").join(classes, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest id. Rows that share an id
    stay or go together; rows with a null id stay."""
    found = jaccard_components(docs, doc_id, text, n, percent)
    name = free_name(docs, "_gone")
    gone = found.filter("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    gone = gone.hint("merge")  # it grows with the corpus; the same plan at every size
    return docs.join(gone, _id(docs, doc_id) == F.col(name), "left_anti")
