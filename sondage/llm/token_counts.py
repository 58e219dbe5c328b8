"""Token counts by a finite-state compilation of a byte-level byte-pair tokenizer.

Two deterministic machines, both compiled from the tokenizer file:

pieces   a machine over character classes (letter, digit, white space, space, other) cuts
         a stretch of text into the pieces that the tokenizer never merges across
tokens   a transducer over bytes within a piece.  Its state holds, for the longest suffix
         that may still grow into a token, the last token of every prefix in it and that
         prefix's count; a byte leads to the next state and emits the change of the
         token count.  There are finitely many states; they are determinized when first met.

The last token of a prefix is the longest suffix token that the tokenizer would leave
beside the last token of what comes before it (``Compiled.beside``): the two are compared by
the ranks at which the parts along their common edge are made and used up.

A text is cut into chunks anywhere; each sees a few characters on both sides, which decide the
edges of its pieces.  A chunk's state map leads from entry states to (exit state, count): every
edge leads to the start state, so only the part before a chunk's first edge is run once per entry.
The entry is known if its piece begins among the characters seen before the chunk; else
the states that any start among those leads to are the entries.  Maps compose like
functions; a long document's maps are composed by a parallel scan over tasks, 64 at a time.  Of a
document whose states stay outside the maps, the chunks are run in order, one state carried along.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import shuffle_partitions, written

CHUNK_CHARS = 1 << 15
CONTEXT = 256  # characters seen on both sides of a chunk: more than a special string, twice the longest token of one sign
FAN = 64  # maps composed by a task at a time
KEPT = 600_000  # stretches and pieces whose count is kept at a time
STATES = 200_000  # compiled states that are kept at a time
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# what lies between synchronizing places: white space after something else starts a new stretch
STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def kind(c: str) -> str:
    """The class of a character: w(hite space), L(etter), N(umber) or o(ther)."""
    if c in WHITE:
        return "w"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "o"


def pieces(text: str) -> Iterator[str]:
    """The pieces of a stretch of text, in order.

    An apostrophe ending, else a run of one class with at most one space before it; a run
    of white space leaves its last character to what follows (a space joins it).
    """
    if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):  # a word, as most are
        yield text
        return
    i, n = 0, len(text)
    while i < n:
        ending = next((e for e in ENDINGS if text.startswith(e, i)), None) if text[i] == "'" else None
        if ending:
            yield ending
            i += len(ending)
            continue
        j = i + 1 if text[i] == " " and i + 1 < n and kind(text[i + 1]) != "w" else i
        k = kind(text[j])
        e = j + 1
        while e < n and kind(text[e]) == k:
            e += 1
        if k == "w" and e < n and e - i > 1:
            e -= 1
        yield text[i:e]
        i = e


class Compiled:
    """The transducer of a tokenizer file, with states made when first met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        # longer special strings are looked for first; the group keeps them when a text is split
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in set(self.special)}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # a token's parts and the rank at which it is made; single bytes are there from the start
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y = raw[a], raw[b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(x + y, (x, y, r))
        self.tokens = {bytes([b]) for b in letters.values()} | set(self.parts)
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        # tokens that the merges never leave whole are none
        self.tokens = {t for t in self.tokens if t not in self.parts or self.beside(*self.parts[t][:2], self.parts[t][2])}
        self.pairs = {}
        self.counts: dict[str, int] = {}  # of stretches and of pieces, which are stretches too
        self.reset()

    def reset(self) -> None:
        """Forget the states (they are compiled anew when met again)."""
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}  # by state and byte
        self.start = self._state((b"", (None,), (0,)))

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, int, float]]:
        """The parts along a token's right (left) edge: (part, rank that makes it, rank that uses it up)."""
        out, used = [], float("inf")
        while token in self.parts:
            a, b, made = self.parts[token]
            out.append((token, made, used))
            token, used = (b if right else a), made
        return [*out, (token, -1, used)]

    def beside(self, a: bytes, b: bytes, until: float = float("inf")) -> bool:
        """Does nothing merge across the edge of tokens a and b before rank ``until``?

        Two parts meet if one is not used up before the other is made.  Of equal ranks the
        left place comes first: a part that its own pair uses up on the left is gone, one
        that would be used up on the right is still there.
        """
        known = self.pairs.get((a, b)) if until == float("inf") else None
        if known is None:
            known = True
            for x, x_made, x_used in self._edge(a, True):
                for y, y_made, y_used in self._edge(b, False):
                    r = self.rank.get((x, y))
                    if r is not None and r < until and x_made < r < x_used and y_made < r <= y_used:
                        known = False
            if until == float("inf"):
                self.pairs[a, b] = known
        return known

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition of a state by a byte: (next state, change of the count)."""
        text, last, count = self.keys[state]
        text += bytes([byte])
        n = len(text)
        # last[i], count[i] belong to the prefix that ends i bytes into ``text``
        for i in range(n):
            token = text[i:]
            if token in self.tokens and count[i] is not None and (last[i] is None or self.beside(last[i], token)):
                break
        else:
            raise ValueError("no token fits")
        last, count, emitted = (*last, token), (*count, count[i] + 1), count[i] + 1 - count[-1]
        i = 0
        while i < n and text[i:] not in self.prefixes:
            i += 1
        # only prefixes after which a token may still begin tell states apart
        base, keep = count[-1], [k == n or text[k:] in self.prefixes for k in range(i, n + 1)]
        made = self._state((text[i:], tuple([x if k else None for x, k in zip(last[i:], keep, strict=True)]),
                            tuple([c - base if k else None for c, k in zip(count[i:], keep, strict=True)])))
        self.steps[state << 8 | byte] = made, emitted
        return made, emitted

    def piece(self, data: bytes) -> int:
        """Tokens of a piece: the sum of what the transitions emit."""
        if len(self.keys) > STATES:
            self.reset()
        state, n, get = self.start, 0, self.steps.get
        for byte in data:
            state, emitted = get(state << 8 | byte) or self._step(state, byte)
            n += emitted
        return n

    def count(self, text: str) -> int:
        """Tokens of a stretch of text from the start state; special strings are one each."""
        total, known = 0, self.counts
        for i, j, special in self.spans(text):
            p = text[i:j]
            n = 1 if special else known.get(p)
            if n is None:
                n = self.piece(p.encode())
                if len(p) < 64:
                    known[p] = n
            total += n
        return total

    def spans(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(from, to, is it a special string?) of the pieces of a text, in order."""
        at = 0
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield at, at + len(part), True
                at += len(part)
            else:
                for p in pieces(part):
                    yield at, at + len(p), False
                    at += len(p)

    def run(self, keys: list[tuple], data: bytes) -> tuple[list[tuple], list[int]]:
        """The states that entry states lead to, and the tokens emitted; equal states go on as one."""
        counts = [0] * len(keys)
        for k in range(0, len(data), 256):
            if len(self.keys) > STATES:
                self.reset()
            done = {}
            for key in set(keys):
                state, n = self._state(key), 0
                for byte in data[k:k + 256]:
                    state, emitted = self.steps.get(state << 8 | byte) or self._step(state, byte)
                    n += emitted
                done[key] = self.keys[state], n
            counts = [c + done[key][1] for c, key in zip(counts, keys, strict=True)]
            keys = [done[key][0] for key in keys]
        return keys, counts

    def total(self, stretches: list[str]) -> int:
        """Tokens of stretches between synchronizing places, each distinct one counted once."""
        if len(self.counts) > KEPT:
            self.counts = {}
        known = self.counts
        out = list(map(known.get, stretches))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    s = stretches[i]
                    if (n := known.get(s)) is None:
                        n = self.count(s)
                        if len(s) < 64:
                            known[s] = n
                    out[i] = n
        return sum(out)


_LOADED: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """The transducer of a file, built once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Compiled(path)
    return _LOADED[path]


START = (b"", (None,), (0,))  # the state between two pieces
SPECIAL = "special"  # the state within a special string, which is counted where it begins
StateMap = dict  # entry state -> (exit state, tokens emitted)


def state_map(machine: Compiled, before: str, text: str, after: str, entry: tuple | str | None = None) -> StateMap:
    """The map of a chunk between the characters seen before and after it.

    ``before`` is shorter than CONTEXT only at the start of a document, ``after`` at its end.
    With ``entry`` the chunk is run from that state alone.
    """
    window, a = before + text + after, len(before)
    b = a + len(text)
    parts = STRETCH.findall(text)
    if len(parts) > 1:  # whole stretches lie between the first and the last synchronizing place
        total, last = machine.total(parts[1:-1]), b - len(parts[-1])
        spans = [*machine.spans(window[:a + len(parts[0])]), *((last + i, last + j, x) for i, j, x in machine.spans(window[last:]))]
    else:
        total, spans = 0, machine.spans(window)
    spans = [x for x in spans if x[1] > a and x[0] < b]
    heads, leave = {START: 0}, START
    if spans and spans[0][0] < a:  # the chunk begins within a piece
        i, j, special = spans.pop(0)
        if special:
            heads = {SPECIAL: 0}
            ends = [SPECIAL]
        else:
            if entry is not None:
                enter = [entry]
            else:
                known = i > 0 or a < CONTEXT
                enter = list({machine.run([START], window[k:a].encode())[0][0]: None for k in ([i] if known else range(a))})
            ends, counts = machine.run(enter, window[a:min(j, b)].encode())
            heads = dict(zip(enter, counts, strict=True))
        if j > b:
            return {key: (end, heads[key]) for key, end in zip(heads, ends, strict=True)}
    if spans and spans[-1][1] > b:  # it ends within one
        i, _, special = spans.pop()
        if special:
            leave, n = SPECIAL, 1
        else:
            (leave,), (n,) = machine.run([START], window[i:b].encode())
        total += n
    total += sum(1 if special else machine.total([window[i:j]]) for i, j, special in spans)
    return {key: (leave, n + total) for key, n in heads.items()}


def compose(f: StateMap, g: StateMap) -> StateMap:
    """The map of the text of f followed by that of g; entries that g's entries don't continue are left out."""
    return {key: (g[leave][0], n + g[leave][1]) for key, (leave, n) in f.items() if leave in g}


MAP_ROW = "row long, id long, hash long, n int, chunk int, n_bytes long, enter array<string>, leave array<string>, count array<long>"
MAP_COLUMNS = [x.split()[0] for x in MAP_ROW.split(", ")]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk_chars: int = CHUNK_CHARS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Counts are those of the tokenizers library without added special tokens; special
    strings inside a text are one token each, as is its default.  A null text is empty and
    has 0 tokens.  Null, repeated and equal ids are counted row by row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    d = d.withColumn("n", F.length("text"))
    small = d.where(F.col("n") <= chunk_chars).select("id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([machine.total(STRETCH.findall(t)) for t in texts], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    # long texts: chunk rows are dealt over all tasks, then their maps meet by document; the row tells repeated ones apart
    spark = docs.sparkSession
    long_ = (d.where(F.col("n") > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "id", "n", "text", F.xxhash64("text").alias("hash"))
             .select("*", F.explode(F.expr(f"sequence(0, cast((n - 1) div {chunk_chars} as int))")).alias("chunk")))
    long_ = long_.withColumn("seen", F.least(F.col("chunk") * F.lit(chunk_chars), F.lit(CONTEXT))).select(
        "row", "id", "hash", "n", "chunk", "seen",
        F.expr(f"substring(text, chunk * {chunk_chars} - seen + 1, seen + {chunk_chars + CONTEXT})").alias("text"))

    def parts(b: pa.RecordBatch) -> Iterator[tuple[str, str, str]]:
        for seen, text in zip(b.column("seen").to_pylist(), b.column("text").to_pylist(), strict=True):
            yield text[:seen], text[seen:seen + chunk_chars], text[seen + chunk_chars:]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for b in batches:
            sizes, enter, leave, count = [], [], [], []
            for before, text, after in parts(b):
                m = state_map(machine, before, text, after)
                sizes.append(len(text.encode()))
                enter.append([repr(key) for key in m])
                leave.append([repr(x) for x, _ in m.values()])
                count.append([n for _, n in m.values()])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sizes, pa.int64()), pa.array(enter, pa.list_(pa.string())),
                 pa.array(leave, pa.list_(pa.string())), pa.array(count, pa.list_(pa.int64()))], names=MAP_COLUMNS)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        each = [dict(zip(e, zip(x, map(int, n), strict=True), strict=True)) for e, x, n in zip(pdf["enter"], pdf["leave"], pdf["count"], strict=True)]
        m = reduce(compose, each)
        out = pdf.iloc[:1].copy()
        out["chunk"], out["n_bytes"] = out["chunk"] // FAN, pdf["n_bytes"].sum()
        out["id"] = out["id"].astype("Int64")
        for column, values in zip(MAP_COLUMNS[6:], (list(m), [x for x, _ in m.values()], [n for _, n in m.values()]), strict=True):
            out[column] = [values]
        return out

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, doc, state, done, total = compiled(tokenizer), None, START, -1, 0
        for b in batches:
            out: list[list] = [[], [], [], []]
            for *key, chunk, (before, text, after) in zip(*(b.column(c).to_pylist() for c in ("id", "hash", "n", "chunk")), parts(b), strict=True):
                if key != doc:
                    doc, state, done, total = key, START, -1, 0
                if chunk == done:  # of equal rows one is run
                    continue
                ((state, n),) = state_map(machine, before, text, after, state).values()
                done, total = chunk, total + n
                if chunk == (key[2] - 1) // chunk_chars:
                    for column, value in zip(out, (*key, total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                                             names=["id", "hash", "n", "n_tokens"])

    row = "id long, n_bytes long, n_tokens long"
    counted = small.mapInArrow(whole, row)
    made = written(long_.repartition(shuffle_partitions(spark), "row", "id", "chunk").mapInArrow(maps, MAP_ROW), "token-maps")
    most = made.agg(F.max("chunk")).first()[0]
    if most is not None:
        composed = made
        while most > 0:
            composed = composed.groupBy("row", "id", "hash", "n", F.expr(f"chunk div {FAN}")).applyInPandas(fold, MAP_ROW)
            most //= FAN
        through = F.array_position("enter", F.lit(repr(START)))
        composed = written(composed.select("id", "hash", "n", "n_bytes", F.when(
            (through > 0) & (F.get("leave", (through - 1).cast("int")) == repr(START)), F.get("count", (through - 1).cast("int"))).alias("n_tokens")), "token-composed")
        counted = counted.unionByName(composed.where("n_tokens IS NOT NULL").select("id", "n_bytes", "n_tokens"))
        rest = composed.where("n_tokens IS NULL")
        if rest.limit(1).count():
            same = lambda x: (F.col("l.id").eqNullSafe(x["id"]) & (F.col("l.hash") == x["hash"]) & (F.col("l.n") == x["n"]))
            keys = rest.select("id", "hash", "n").distinct()
            ordered = (long_.alias("l").join(keys, same(keys), "left_semi").repartition(shuffle_partitions(spark), "id", "hash", "n")
                       .sortWithinPartitions("id", "hash", "n", "chunk").mapInArrow(in_order, "id long, hash long, n int, n_tokens long"))
            ordered = written(ordered, "token-ordered")
            counted = counted.unionByName(rest.drop("n_tokens").alias("l").join(ordered, same(ordered)).select("l.id", "n_bytes", "n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
