"""Unigram token counts by dynamic programming shared through a trie.

The vocabulary is a public list of byte pieces in the order of their ranks; a piece's unigram score
is the Zipf log-probability of its rank, -log(rank + 2). Texts are cut into pre-tokens (a run of
ASCII white space, or an optional space and a run of other bytes), and a pre-token counts as many
tokens as its best-scored segmentation has (of equal scores the one whose last piece is shorter at
the first difference, reading back from the end).

The distinct pre-tokens of a task are inserted in a trie. A node's forward score is the best over
all pieces that end there: the score of an ancestor node plus that piece. It is computed once when
the node is made, however many pre-tokens share the prefix, and the node where a pre-token ends
keeps its token count. The trie is emptied when it has node_limit nodes, and pre-tokens longer than
long_bytes run through the same recurrence without being inserted, so memory is bounded.

Defined results: null and empty texts count 0 tokens and 0 pre-tokens; bytes that are no piece have
the score of the last rank, each its own token; texts of any length are counted whole; repeated rows
count alike; an empty table gives an empty table; clashing column names get underscores.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import added, byte_batches, free_name, lean, small_batches, utf8

PRE_TOKEN = re.compile(rb"[\x09-\x0D]+| ?[^\x20\x09-\x0D]+| +")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 piece and its rank a line, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TrieCounter:
    def __init__(self, ranks: dict[bytes, int], node_limit: int = 600_000, long_bytes: int = 64):
        self.scores = {p: -math.log(r + 2) for p, r in ranks.items()}
        self.unknown = -math.log(max(ranks.values(), default=0) + 2)
        #: The length of the longest piece by its last three bytes: no longer one can end in them.
        self.reach: dict[bytes, int] = {}
        for p in ranks:
            self.reach[p[-3:]] = max(self.reach.get(p[-3:], 0), len(p))
        self.node_limit, self.long_bytes = node_limit, long_bytes
        self._empty()

    def _empty(self) -> None:
        self.children: dict[int, int] = {}  # node * 256 + byte -> node
        self.best, self.tokens = [0.0], [0]
        self.ends: dict[bytes, int] = {}  # pre-token -> its terminal count

    def _step(self, text: bytes, end: int, best, tokens) -> tuple[float, int]:
        """Forward score and token count of text[:end] from those of its prefixes, by length."""
        scores, top, count = self.scores, -math.inf, 0
        for start in range(end - 1, max(-1, end - self.reach.get(text[max(0, end - 3) : end], 2) - 1), -1):
            score = scores.get(text[start:end])
            if score is None:
                if start < end - 1:
                    continue
                score = self.unknown
            if best[start] + score > top:
                top, count = best[start] + score, tokens[start] + 1
        return top, count

    def _count(self, text: bytes) -> int:
        if len(text) > self.long_bytes:
            best, tokens = [0.0], [0]
            for end in range(1, len(text) + 1):
                top, n = self._step(text, end, best, tokens)
                best.append(top)
                tokens.append(n)
            return tokens[-1]
        if len(self.best) > self.node_limit:
            self._empty()
        node, best, tokens = 0, [0.0], [0]
        for end, byte in enumerate(text, 1):
            key = node * 256 + byte
            child = self.children.get(key)
            if child is None:
                top, n = self._step(text, end, best, tokens)
                child = self.children[key] = len(self.best)
                self.best.append(top)
                self.tokens.append(n)
            node = child
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        self.ends[text] = tokens[-1]
        return tokens[-1]

    def count(self, text: bytes | None) -> tuple[int, int]:
        """(tokens, pre-tokens) of a text."""
        total, parts = 0, PRE_TOKEN.findall(text or b"")
        for p in parts:
            n = self.ends.get(p)
            total += self._count(p) if n is None else n
        return total, len(parts)


_COUNTERS: dict[str, TrieCounter] = {}


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all, by default) with n_tokens and n_pretokens. ranks goes to the executors
    once; its size is that of the vocabulary file."""
    keep = docs.columns if columns is None else columns
    schema = added(
        docs.select(*[F.col(f"`{c}`") for c in keep]), (free_name(docs, "n_tokens"), T.LongType()), (free_name(docs, "n_pretokens"), T.LongType())
    )
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa

        if key not in _COUNTERS:
            _COUNTERS[key] = TrieCounter(shipped.value)
        counter = _COUNTERS[key]
        for batch in byte_batches(batches, text, 8 << 20):
            found = [counter.count(t) for t in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                names=schema.names,
            )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), schema)
