"""Exact encoding with a merge-type SentencePiece vocabulary, and decoding.

Method: every piece goes into an Aho-Corasick automaton; encoding walks the text from left to
right, takes the longest piece that matches at a position and accepts it only if it is compatible
with the piece before it, that is, if merging the characters of the two anew gives the same two
pieces. If no piece that starts there fits, the position is marked in a bitfield of failed
positions and the walk goes back one piece and tries the next shorter one there. A segmentation in
which all neighbours are compatible is the one that merging gives, and no position is tried again
once it failed, so the work is linear in the text.

No merge can cross a place where no piece has these two characters side by side. Texts are cut
there (before white space after another character, and around characters that occur in no longer
piece) and each distinct part is encoded once per task, in a table of bounded size.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty
text; a model of another type, or one that normalises texts, is an error; text of any length is encoded whole; equal texts give equal ids; an empty table gives an
empty table; other columns pass through unchanged, and the operator's columns get an underscore
before them if their name is taken.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratalog.llm.common import added, byte_batches, free_name, lean, small_batches, without_cycles

SPACE = "▁"
NONE = -2
#: texts that the usual ways of normalising change
PROBES = ["a  b", " a ", "ＡBC ①ﬁ", "e\u0301 é", "\tx\n y", "\u00a0x\u3000y", "▁a", "ABC def 123"]


class MergeEncoder:
    """One vocabulary: encode(text) -> ids, decode(ids) -> text, as the library gives them."""

    def __init__(self, model: bytes, table_size: int = 300_000):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes_at = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        # A piece that merging its own characters doesn't give can't occur in a result.
        self.usable, self.halves, self.last_halves = set(), {}, ("", "")
        for p in self.ids:
            if len(p) == 1 or self._merge(p) == [p]:
                self.usable.add(p)
                if len(p) > 1:
                    self.halves[p] = self.last_halves
        self.ranks = {p: k for k, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p]))}
        self.automaton = ahocorasick.Automaton()
        for p in self.usable:
            self.automaton.add_word(p, self.ids[p])
        if len(self.automaton):
            self.automaton.make_automaton()
        # By id: the piece, its length, and the longest usable piece that it starts with, itself
        # excepted. The last entries are what a character that is no piece (-1) has.
        self.n = n
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.size = [*map(len, self.pieces), 1]
        self.shorter = [NONE] * (n + 1)
        for p in self.usable:
            self.shorter[self.ids[p]] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.usable), -1 if len(p) > 1 else NONE)
        self.fits: dict[int, bool] = {}
        long = [p for p in self.ids if len(p) > 1]
        joined = {a for p in long for a in p}
        self.crossed = any(b == SPACE and a != SPACE for p in long for a, b in zip(p, p[1:]))
        inner = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        self.parts = re.compile((f"{SPACE}*[{inner}]+|" if inner else "") + f"{SPACE}+|[^{SPACE}{inner}]+") if not self.crossed else re.compile(r"(?s).+")
        self.inner = joined
        self.table: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.table_size = table_size
        # prepared() knows one way of preparing texts; a model that asks for another is refused.
        if any(self.encode(t) != list(lib.encode(t)) for t in PROBES):
            raise ValueError("the model's type or its way of normalising texts isn't supported")

    def _merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the left one of equals. Keeps the two
        halves of the last merge."""
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        part: list[str | None] = list(text)
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.scores.get(both := part[a] + part[b])) is not None:
                heapq.heappush(queue, (-score, a, b, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != both:
                continue
            self.last_halves = (part[a], part[b])
            part[a], part[b], right[a] = both, None, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p is not None]

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b anew ends in a and b: no merge across the border
        comes before the merges that made the two. These are undone from the last one on, and the
        border's neighbours are compared with the ones undone so far. Equal scores (runs of spaces)
        depend on places, so there the merging is done in full."""
        if SPACE + SPACE in a + b:
            return self._merge(a + b) == [a, b]
        ranks, halves, last = self.ranks, self.halves, 1 << 60
        while True:
            if ranks.get(a + b, last) < last:
                return False
            of_a, of_b = (ranks[a] if a in halves else -1), (ranks[b] if b in halves else -1)
            if of_a > of_b:
                last, a = of_a, halves[a][1]
            elif of_b >= 0:
                last, b = of_b + 1, halves[b][0]  # of equal merges the left one comes first
            else:
                return True

    def _fit(self, a: int, b: int) -> bool:
        """_compatible by ids, kept in a table of bounded size."""
        if len(self.fits) >= 200_000:
            self.fits.clear()
        fit = self.fits[a * self.n + b] = self._compatible(self.pieces[a], self.pieces[b])
        return fit

    def backtrack(self, text: str) -> list[int]:
        """The ids of text's pieces; -1 stands for a character that is no piece."""
        total, size, shorter, fits, n = len(text), self.size, self.shorter, self.fits, self.n
        if not total:
            return []
        # Matches come by their ends, so of those with one start the longest comes last.
        longest = [-1] * total
        if len(self.automaton):
            for end, token in self.automaton.iter(text):
                longest[end - size[token] + 1] = token
        failed, out = None, []
        at, before, token = 0, -1, longest[0]
        end = size[token]
        while True:
            if failed is None or not (failed[end >> 3] >> (end & 7)) & 1:
                fit = True if before < 0 or token < 0 else fits.get(before * n + token)
                if fit if fit is not None else self._fit(before, token):
                    out.append(token)
                    if end == total:
                        return out
                    at, before, token = end, token, longest[end]
                    end += size[token]
                    continue
            token = shorter[token]
            while token == NONE:  # nothing that starts here fits: back to the piece before
                failed = failed if failed is not None else bytearray(total // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no segmentation: the vocabulary is not of merge type")
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
                token = shorter[token]
            end = at + size[token]

    def _ids_of(self, part: str) -> list[int]:
        found = self.backtrack(part)
        if -1 not in found:
            return found
        out, at = [], 0
        for token in found:
            if token >= 0:
                out.append(token)
            elif self.bytes_at:
                out.extend(self.bytes_at[b] for b in part[at].encode())
            else:
                out.append(self.unknown)
            at += self.size[token]
        return out

    def _entry(self, part: str) -> str:
        """The part's ids as text, "12,7". The table has two generations: a full one becomes the older,
        and what is still used moves over from there, so frequent parts stay. Texts are small, and
        the cycle collector doesn't walk them."""
        if (known := self.older.pop(part, None)) is None:
            known = ",".join(map(str, self._ids_of(part)))
            if len(part) > 256:
                return known
        if len(self.table) >= self.table_size:
            self.older, self.table = self.table, {}
        self.table[part] = known
        return known

    def prepared(self, text: str) -> str:
        return (" " + text).replace(" ", SPACE) if text else ""

    def encode_text(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        out, get = [], self.table.get
        for p in self.parts.findall(self.prepared(text)):
            known = get(p)
            if known is None:
                known, get = self._entry(p), self.table.get
            out.append(known)
        return ",".join(out)

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_text(text or "")
        return list(map(int, ids.split(","))) if ids else []

    def forget(self) -> None:
        """Empties the older table; between tasks a worker holds the vocabulary and the younger one."""
        self.older = {}

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_ENCODERS: dict[str, MergeEncoder] = {}


def encoder(model: bytes) -> MergeEncoder:
    """One encoder per worker process and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = MergeEncoder(model)
    return _ENCODERS[key]


def read_model(path: str) -> bytes:
    """The model file, read on the driver and sent with the task (about 0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(df: DataFrame, model: bytes, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """df with token_ids (array of int, if ids), n_tokens (long) and decoded (string), or, with
    digests, ids_sha256 and decoded_sha256 in their place: the digests of the same results, made
    batch by batch so that neither needs to leave the worker."""
    wanted: list[tuple[str, T.DataType]] = [("n_tokens", T.LongType())]
    if ids:
        wanted += [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    if digests:
        wanted += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names = [free_name(df, n) for n, _ in wanted]
    schema = added(df, *((n, t) for n, (_, t) in zip(names, wanted)))

    def run(batches):
        import pyarrow as pa

        codec, kinds = encoder(model), {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32())}
        for batch in byte_batches(batches, text, 2 << 20):
            columns: dict[str, list] = {n: [] for n, _ in wanted}
            for value in batch.column(text).to_pylist():
                with without_cycles():
                    joined = codec.encode_text(value or "")
                    own = list(map(int, joined.split(","))) if joined else []
                    back = codec.decode(own) if own else ""
                columns["n_tokens"].append(len(own))
                if ids:
                    columns["token_ids"].append(pa.array(own, pa.int32()))
                    columns["decoded"].append(back)
                if digests:
                    columns["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    columns["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            if ids:
                sizes = [0, *accumulate(map(len, columns["token_ids"]))]
                flat = pa.concat_arrays(columns["token_ids"]) if columns["token_ids"] else pa.array([], pa.int32())
                columns["token_ids"] = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            found = [v if isinstance(v, pa.Array) else pa.array(v, kinds.get(n, pa.string())) for n, v in columns.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[f.name for f in schema.fields])
        codec.forget()

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)
