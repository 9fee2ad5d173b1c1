"""Benchmark decontamination by suffix arrays over the training text.

A shard is a run of documents that one task holds. Its words become ids of the benchmark's
vocabulary (0: a word no benchmark item has). The shard's suffix array lists its suffixes in order,
to the depth of a window; a suffix that starts with words no window has in this order can't match
and is left out. Every suffix of every benchmark item is binary-searched in it; the interval found
holds all places where the item's window occurs verbatim. Places are joined into spans of document
words, with the items they come from and the longest verbatim match of each document.

The benchmark is the stated query set: it is read in blocks of block_bytes and each block passes
over all documents, adding to the spans found before. The driver and each task hold one block at a
time, whatever the benchmark's size: a pass that others follow is written and its block let go.
Documents are never shuffled. A verbatim match is what one item and a document share without a gap,
of a window's length or more; shorter ones don't contaminate and aren't looked for.

Defined results: null and wordless texts have no words, no spans, no items; an item without words
matches nothing; an item shorter than the window is one window as a whole; items with equal ids
count as one; null item ids read "null"; an empty benchmark or an empty table gives rows without
matches or no rows; texts of any length are searched whole; clashing column names get underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import byte_batches, free_name, lean, size_of, small_batches, utf8, written

#: Bytes of word characters stay (A-Z in lower case), all others become a space.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
TABLE_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Windows:
    """The windows of a block of items, as sorted search keys."""

    def __init__(self, items: list[tuple[str, bytes]], length: int):
        import numpy as np

        self.length = length
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        index = {n: k for k, n in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(length, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[k : k + size]), set()).add(index[name])
        windows = sorted(found)
        self.sizes = np.array([len(w) for w in windows], dtype=np.int64)
        self.shortest = int(self.sizes.min()) if windows else 0
        low = np.zeros((len(windows), length), dtype=">u4")
        high = np.full((len(windows), length), 0xFFFFFFFF, dtype=">u4")
        for k, w in enumerate(windows):
            low[k, : len(w)] = high[k, : len(w)] = w
        self.low, self.high = (x.view(f"S{4 * length}").ravel() for x in (low, high))
        self.item_starts = np.concatenate(([0], np.cumsum([len(found[w]) for w in windows]))).astype(np.int64)
        self.items = np.array([i for w in windows for i in sorted(found[w])], dtype=np.int64)
        self.pairs = np.zeros(1 << TABLE_BITS, dtype=bool)
        for w in windows:
            for a, b in zip(w, w[1:]):
                self.pairs[self.pair(a, b)] = True

    @staticmethod
    def pair(a, b):
        return (a * 2654435761 + b * 40503) & ((1 << TABLE_BITS) - 1)

    def suffixes(self, ids, ends, at):
        """The suffix array of the suffixes at `at`, and its keys in order; ends: of each word's document."""
        import numpy as np

        places = at[:, None] + np.arange(self.length)
        inside = places < ends[at][:, None]
        keys = np.where(inside, ids[np.minimum(places, len(ids) - 1)], 0)
        keys *= np.cumprod(keys > 0, axis=1)
        keys = np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * self.length}").ravel()
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def search(self, ids, ends, shard: int = 400_000):
        """(place, window) of every occurrence of a window."""
        import numpy as np

        if not self.shortest or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start = ids > 0
        if self.shortest > 1:
            fits = np.zeros(len(ids), dtype=bool)
            both = np.flatnonzero(start[:-1] & start[1:])
            fits[both] = self.pairs[self.pair(ids[both], ids[both + 1])]
            run = np.concatenate(([0], np.cumsum(~fits)))
            need = self.shortest - 1
            start = np.zeros(len(ids), dtype=bool)
            start[: len(ids) - need] = run[need : len(ids)] == run[: len(ids) - need]
        at, places, windows = np.flatnonzero(start), [], []
        for k in range(0, len(at), shard):
            array, keys = self.suffixes(ids, ends, at[k : k + shard])
            low = np.searchsorted(keys, self.low, "left")
            count = np.searchsorted(keys, self.high, "right") - low
            short = self.sizes == self.length
            count[short] = np.searchsorted(keys, self.low[short], "right") - low[short]
            hit = np.flatnonzero(count > 0)
            n = count[hit]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            places.append(array[np.repeat(low[hit], n) + offset])
            windows.append(np.repeat(hit, n))
        return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, windows))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_documents(texts: list[bytes | None], windows: Windows):
    """Per text: its number of words, its hit spans, its items, its longest verbatim match."""
    import numpy as np

    get, counts, parts = windows.vocabulary.get, [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter([get(w, 0) for w in words], dtype=np.int64, count=len(words)))
    counts = np.array(counts, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    ends = np.repeat(starts[1:], counts)
    places, found = windows.search(ids, ends)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    longest = [0] * len(texts)
    if not len(places):
        return counts, spans, items, longest
    document = np.searchsorted(starts, places, "right") - 1
    order = np.argsort(places, kind="stable")
    for k in order.tolist():
        d, a = int(document[k]), int(places[k] - starts[document[k]])
        spans[d].append((a, a + int(windows.sizes[found[k]])))
    n = windows.item_starts[found + 1] - windows.item_starts[found]
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = windows.items[np.repeat(windows.item_starts[found], n) + offset]
    for pair in np.unique(np.repeat(document, n) * len(windows.names) + item).tolist():
        items[pair // len(windows.names)].add(windows.names[pair % len(windows.names)])
    # A verbatim match is a run of places one after another whose windows an item has in this order.
    at, item, size = np.repeat(places, n), item, np.repeat(windows.sizes[found], n)
    order = np.lexsort((at, item))
    at, item, size = at[order], item[order], size[order]
    breaks = np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] > at[:-1] + 1)))
    first = np.flatnonzero(breaks)
    last = np.concatenate((first[1:], [len(at)])) - 1
    for a, b, s in zip(at[first].tolist(), at[last].tolist(), size[last].tolist()):
        d = int(np.searchsorted(starts, a, "right") - 1)
        longest[d] = max(longest[d], b + s - a)
    return counts, [_joined(s) for s in spans], items, longest


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The benchmark's rows in lists of about block_bytes; the driver holds one partition at a time."""
    block, held = [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text).cast("binary")).toLocalIterator():
        if row[1] is None:
            continue
        if block and held + len(row[1]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], bytes(row[1])))
        held += len(row[1])
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    columns: list[str] | None = None,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """columns of docs (all, by default) with n_words, hit_spans (word ranges, end exclusive),
    hit_items (ids as strings, sorted) and longest_match (words)."""
    keep = docs.columns if columns is None else columns
    names = [free_name(docs, n) for n in ("n_words", "hit_spans", "hit_items", "longest_match")]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [T.LongType(), span, T.ArrayType(T.StringType()), T.LongType()]
    extra = [T.StructField(n, k) for n, k in zip(names, kinds)]
    spark = docs.sparkSession
    small_batches(spark)
    out, number, blocks = docs, -1, _blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        number, after = number + 1, next(blocks, None)
        last = after is None
        kept = [f for f in docs.schema.fields if not last or f.name in keep]
        shipped = spark.sparkContext.broadcast(block)
        later, columns_in = number > 0, [f.name for f in kept]

        def run(batches, shipped=shipped, later=later, columns_in=columns_in):
            import pyarrow as pa

            windows = Windows(shipped.value, window)
            spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for batch in byte_batches(batches, text, 4 << 20):
                counts, spans, items, longest = _search_documents(utf8(batch.column(text)), windows)
                if later:
                    old = [batch.column(n).to_pylist() for n in names[1:]]
                    spans = [_joined([(x["start"], x["end"]) for x in a] + b) for a, b in zip(old[0], spans)]
                    items = [set(a) | b for a, b in zip(old[1], items)]
                    longest = [max(a, b) for a, b in zip(old[2], longest)]
                found = [
                    pa.array(counts, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_kind),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    pa.array(longest, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns_in), *found], names=[*columns_in, *names])

        out = out.mapInArrow(lean(run), T.StructType([*kept, *extra]))
        if not last:
            out = written(spark, out, "leaks", size_of(docs))
            shipped.destroy()
        block = after
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of the benchmark."""
    found = find_contamination(docs, benchmark, window, text)
    return found.filter(F.size(found.columns[len(docs.columns) + 1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
