"""Quality rules with an isolation forest over their statistics.

Rule statistics are counted over every whole text. The base rule rejects documents with too few
words or too many repeated ones. The rest is judged by an isolation forest: trees of random splits
over random subsamples of the statistics, in which anomalous documents end on short paths. The
anomaly score is 2 ** (-mean path / expected path), and its threshold is calibrated on labelled
rows: the highest balanced accuracy among the thresholds that keep at least keep_good of the rows
labelled good. Anomalies that only labels can tell from good text are left alone.

Fitting counts every row that passes the base rule, by its rates and its label. The rates are coarse,
so the driver gets few distinct ones with their counts, however many rows there are. From these
counts, each tree's subsample, which belongs to the method, is drawn out of all rows; the threshold is
calibrated on all labelled rows. Statistics and verdicts cover all rows, without a shuffle; the
statistics are written once, since fitting, calibration and scoring read them.

Defined results: null texts have no words and zeros throughout, and fail the base rule, as empty
ones do; repeated rows count each and get equal verdicts; rows with null ids are judged like all others; without
labels of both kinds the forest rejects nothing; an empty table gives an empty table; other columns
pass through unchanged if asked for, and clashing names get underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import added, byte_batches, free_name, lean, size_of, small_batches, utf8, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_marks", "n_bare"]
SYMBOLS = b"#*$%&|<>"
DROP_LOW = bytes(range(0x80, 0xC0))
FEATURES = 7
TREES, SAMPLE = 400, 64


def statistics(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text. n_upper and n_letters count A-Z and A-Za-z; n_marks is punctuation
    repeated at word ends; n_bare counts words without letter or digit."""
    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, DROP_LOW))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        once: set = set()
        more = {w for w in windows if w in once or once.add(w)} if len(set(windows)) < len(windows) else set()
        if more:
            end = 0
            for i, w in enumerate(windows):
                if w in more:
                    repeat += i + 5 - max(i, end)
                    end = i + 5
    upper = sum(map(joined.count, UPPER))
    letters = len(joined) - len(joined.translate(None, LETTERS))
    distinct = set(words)
    bare = sum(1 for w in words if w in BARE or (len(w) < 4 and not w.translate(None, PUNCTUATION)))
    marks = sum(map(joined.count, (b"!!", b"***", b"###", b"&&&", b"%%%", b"$$$", b"...")))
    return n, chars, symbols, dup, repeat, len(distinct), upper, letters, marks, bare


LETTERS = bytes([*range(65, 91), *range(97, 123)])
UPPER = [bytes([b]) for b in range(65, 91)]
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
BARE: frozenset[bytes] = frozenset({b"|", b"-", b"*"})


def features(counts):
    """Coarse rates of the counts (rows of COUNTS), the forest's inputs: coarse, so that a split has
    to part real differences."""
    import numpy as np

    c = np.asarray(counts, dtype=float).reshape(-1, len(COUNTS))
    n, chars, symbols, lines, repeated, distinct, upper, letters, marks, bare = c.T
    some = np.maximum(n, 1)
    return np.column_stack(
        (
            np.clip(np.floor(chars / some), 2, 12),
            np.round(np.minimum(symbols / some, 1.5), 1),
            np.round(np.minimum(distinct / np.power(some, 0.75), 4) * 2) / 2,
            np.round(upper / np.maximum(letters, 1), 1),
            np.round(np.minimum(marks / some, 2), 1),
            np.round(bare / some, 1),
            np.floor(np.minimum((repeated + 10 * lines) / some, 1) * 5) / 5,
        )
    )


class Forest:
    """Isolation trees as flat arrays; score(x) is 0.5 for average rows and near 1 for anomalies.
    counts: how often each row of x comes, once by default."""

    def __init__(self, x, trees: int = TREES, sample: int = SAMPLE, seed: int = 11, counts=None):
        import numpy as np

        random = np.random.default_rng(seed)
        ends = np.cumsum(np.ones(len(x), dtype=np.int64) if counts is None else counts)
        total = int(ends[-1])
        self.size = min(sample, total)
        self.limit = int(np.ceil(np.log2(max(2, self.size)))) + 4
        # every tree has rows of its own where there are enough, else they are drawn anew for each
        dealt = random.choice(total, trees * self.size, replace=False) if total >= trees * self.size else None
        own = lambda k: dealt[k * self.size : (k + 1) * self.size] if dealt is not None else random.choice(total, self.size, replace=False)
        self.trees = [self._grow(x[np.searchsorted(ends, own(k), "right")], random) for k in range(trees)]
        self.threshold = 2.0

    @staticmethod
    def expected(n):
        import numpy as np

        n = np.asarray(n, dtype=float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, x, random):
        import numpy as np

        feature, cut, left, right, depth = [], [], [], [], []

        def node(rows, level: int) -> int:
            own = len(feature)
            feature.append(-1)
            cut.append(0.0)
            left.append(own)
            right.append(own)
            depth.append(level + float(self.expected(len(rows))))
            low, high = rows.min(axis=0), rows.max(axis=0)
            split = np.flatnonzero(high > low)
            if level < self.limit and len(rows) > 1 and len(split):
                f = int(random.choice(split))
                at = random.uniform(low[f], high[f])
                below = rows[:, f] < at
                if below.any() and not below.all():
                    feature[own], cut[own] = f, at
                    left[own], right[own] = node(rows[below], level + 1), node(rows[~below], level + 1)
            return own

        node(x, 0)
        return tuple(np.array(v) for v in (feature, cut, left, right, depth))

    def score(self, x):
        import numpy as np

        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.limit):
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(x[rows, f] < cut[at], left[at], right[at]))
            total += depth[at]
        return 2 ** (-total / len(self.trees) / max(float(self.expected(self.size)), 1e-9))


def calibrate(scores, good, keep_good: float = 0.995, counts=None) -> float:
    """The threshold (scores at or above it are rejected) with the best balanced accuracy among
    those that keep keep_good of the good rows; 2 (nothing is rejected) without rows of both kinds.
    counts: how many rows each score stands for, one by default."""
    import numpy as np

    scores, good = np.asarray(scores), np.asarray(good, dtype=bool)
    counts = np.ones(len(scores), dtype=np.int64) if counts is None else np.asarray(counts)
    scores, good, counts = (v[counts > 0] for v in (scores, good, counts))
    if good.all() or not good.any():
        return 2.0
    cuts, at = np.unique(scores, return_inverse=True)
    below = lambda own: (n := np.bincount(at, np.where(own, counts, 0), len(cuts))).cumsum() - n
    kept = below(good) / counts[good].sum()
    caught = 1 - below(~good) / counts[~good].sum()
    allowed = kept >= keep_good
    if not allowed.any() or (best := np.argmax(np.where(allowed, kept + caught, -1))) is None or kept[best] + caught[best] <= 1:
        return 2.0
    last = cuts[best - 1] if best else cuts[best]
    return float((last + cuts[best]) / 2)


def _named(df: DataFrame) -> dict[str, str]:
    """By count, the column that count_statistics made: of equal names, the one with the most underscores."""
    return {n: max((c for c in df.columns if c.lstrip("_").lower() == n), key=len) for n in COUNTS}


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words"):
    return (F.col(n_words) < 10) | (F.lit(100) * F.col(n_repeat) > F.lit(20) * F.col(n_words))


def count_statistics(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all, by default) with the COUNTS."""
    keep = docs.columns if columns is None else columns
    names = [free_name(docs, c) for c in COUNTS]
    schema = added(docs.select(*[F.col(f"`{c}`") for c in keep]), *((n, T.LongType()) for n in names))

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, text, 8 << 20):
            counted = list(zip(*(statistics(t) for t in utf8(batch.column(text))))) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in counted)], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def rate_counts(stats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> DataFrame:
    """The distinct features of stats' rows that pass the base rule: rates, with the numbers n of rows,
    n_good of those labelled 1 and n_bad of those labelled 0. stats: what count_statistics gives."""
    names = _named(stats)
    passing = stats.select(F.col(f"`{doc_id}`").alias("_key"), *(F.col(f"`{names[c]}`").alias(c) for c in COUNTS)).filter(~base_failed())
    schema = added(passing.select("_key"), ("rates", T.ArrayType(T.DoubleType())))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = features(np.column_stack([np.asarray(batch.column(c)) for c in COUNTS]))
            rates = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), rates], names=schema.names)

    rows = passing.mapInArrow(lean(run), schema).groupBy("_key", "rates").agg(F.count("*").alias("n"))
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).hint("merge")  # labels may be as many as documents
    rows = rows.join(known, F.col("_key") == F.col("_id"), "left")
    labelled = lambda y: F.sum(F.when(F.col("_y") == y, F.col("n")).otherwise(0))
    return rows.groupBy("rates").agg(F.sum("n").alias("n"), labelled(1).alias("n_good"), labelled(0).alias("n_bad"))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", trees: int = TREES, sample: int = SAMPLE) -> Forest | None:
    """The forest of stats' rows that pass the base rule, with its threshold; None without rows. stats:
    what count_statistics gives."""
    import numpy as np

    found = rate_counts(stats, labels, label, doc_id).toArrow().combine_chunks()
    if not found.num_rows:
        return None
    x = np.array(found.column("rates").to_pylist())
    order = np.lexsort(x.T)  # the same forest in whatever order the rows come
    n, good, bad = (found.column(c).to_numpy()[order] for c in ("n", "n_good", "n_bad"))
    forest = Forest(x[order], trees, sample, counts=n)
    scores = forest.score(x[order])
    forest.threshold = calibrate(np.tile(scores, 2), np.repeat([True, False], len(scores)), counts=np.concatenate((good, bad)))
    return forest


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats (what count_statistics gives) with anomaly (0 to 1), base_failed and kept."""
    names = _named(stats)
    score, failed, kept = (free_name(stats, n) for n in ("anomaly", "base_failed", "kept"))
    rule = base_failed(f"`{names['n_words']}`", f"`{names['n_repeat_words']}`")
    if forest is None:
        return stats.withColumns({score: F.lit(0.0), failed: rule, kept: ~rule})
    schema = added(stats, (score, T.DoubleType()))
    shipped = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = features(np.column_stack([np.asarray(batch.column(names[c])) for c in COUNTS]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.score(x), pa.float64())], names=schema.names)

    out = stats.mapInArrow(lean(run), schema)
    return out.withColumns({failed: rule, kept: ~rule & (F.col(score) < F.lit(forest.threshold))})


def apply_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with COUNTS, anomaly, base_failed and kept."""
    small_batches(docs.sparkSession)
    stats = written(docs.sparkSession, count_statistics(docs.select(doc_id, text), text, [doc_id]), "rule-statistics", size_of(docs))
    return judge(stats, fit(stats, labels, doc_id=doc_id))
