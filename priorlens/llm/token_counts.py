"""Token counts by a compiled tokenizer: a deterministic transducer whose transitions carry emitted-token counts.

The tokenizer is sentencepiece BPE with byte fallback. Compilation rests on a property of BPE: in the encoding of a prefix
of the text, the last token is the one candidate piece that ends there and may follow the last token of the shorter prefix
before it, and whether one piece may follow another can be told from the two alone (their joint merge never crosses the
border). So a state needs only the longest suffix that may still grow into a piece, with the last token and the relative
count at each place inside it: finitely many. A transition on a character emits count(prefix + c) - count(prefix).
States and transitions are compiled when first met and kept in a bounded table.

A text is cut into chunks. A chunk's state map says what it does to any state that enters it: the count and the exit state
from ``START``, and for any other entry the place from which both go the same way, at the latest the chunk's first
synchronising point (a space mark after another character, which no piece spans). State maps compose associatively; a
prefix scan over the chunks gives the state and the count after each.

Null and empty texts have 0 tokens. Repeated rows each get a row; only id and text are read. Memory is bounded by the tables
and a text with its marked copy, whether it has spaces or not.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import mapped, resident, small_batches
from .byte_bpe import _schema
from .common import pick

SPACE = "▁"
CHUNK = 1 << 16
#: Compiled transitions and known units kept per worker; each table is emptied when full. Units of more than LONG characters
#: aren't kept. The tables are looked at after each SCAN chunks.
TRANSITIONS, UNITS, LONG, SCAN = 500_000, 200_000, 64, 4


class Transducer:
    """Pieces by merge order (smaller merges first). States are numbered as they are met; ``START`` is the one at a border."""

    START = 0

    def __init__(self, order: dict[str, int]):
        self.order = order
        self.starts = {p[:i] for p in order for i in range(1, len(p))}
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.units: dict[str, int] = {}
        self.reset()

    def reset(self, state: int | None = None) -> int:
        """Forget all compiled states but one, and give its new number; the others are void then."""
        start = ("", (None,), (0,))
        keep = start if state is None else self.states[state]
        self.states, self.number = [start], {start: 0}
        # (state, character) as one integer -> (next state, change of the count) as one integer
        self.table: dict[int, int] = {}
        if keep not in self.number:
            self.number[keep] = len(self.states)
            self.states.append(keep)
        return self.number[keep]

    def border_holds(self, left: str, right: str) -> bool:
        """Merge the characters of both by the order: does no merge cross the border?"""
        symbols, border, order, never = [*left, *right], len(left) - 1, self.order, 1 << 60
        ranks = [order.get(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            if i == border:
                return False
            if i < border:
                border -= 1
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = order.get(symbols[i - 1] + symbols[i], never)
            if i < len(ranks):
                ranks[i] = order.get(symbols[i] + symbols[i + 1], never)
        return len(symbols) == (2 if left else 1)

    def is_whole(self, piece: str) -> bool:
        """Is the piece what its own characters merge to?"""
        if piece not in self.whole:
            self.whole[piece] = piece in self.order and self.border_holds("", piece)
        return self.whole[piece]

    def may_follow(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        if (left, right) not in self.follows:
            if len(self.follows) > TRANSITIONS:
                self.follows.clear()
            self.follows[left, right] = self.border_holds(left, right)
        return self.follows[left, right]

    def _compile(self, state: int, c: str) -> int:
        """The transition from a state on a character."""
        if c not in self.order:  # bytes instead, which never merge
            return self.START << 6 | len(c.encode()) + 32
        live, last, counts = self.states[state]
        text = live + c
        for k in range(len(text)):
            piece = text[k:]
            if piece in self.order and self.is_whole(piece) and self.may_follow(last[k], piece):
                break
        else:
            raise AssertionError(f"no piece ends after {text!r}")
        more = counts[k] + 1
        m = 0
        while m < len(text) and text[m:] not in self.starts:
            m += 1
        # only places from which a piece may still begin tell states apart
        alive = [text[i:] in self.starts for i in range(m, len(text))]
        at = tuple(last[m + i] if x else None for i, x in enumerate(alive))
        n = tuple(counts[m + i] - more if x else 0 for i, x in enumerate(alive))
        new = (text[m:], (*at, piece), (*n, 0))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new] << 6 | more + 32

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state after a text, and by how much the count of tokens changes."""
        n, table = -32 * len(text), self.table
        for c in text:
            key = state << 21 | ord(c)
            packed = table.get(key)
            if packed is None:
                packed = table[key] = self._compile(state, c)
            state = packed >> 6
            n += packed & 63
        return state, n

    def unit(self, text: str) -> int:
        """Tokens of a text that stands between two synchronising points."""
        n = self.units.get(text)
        if n is None:
            n = self.run(self.START, text)[1]
            if len(text) <= LONG:
                if len(self.units) >= UNITS:
                    self.units.clear()
                self.units[text] = n
        return n


class StateMap:
    """What a stretch of text does to the state before it: ``apply`` gives the state after it and the change of the count.

    ``exit`` and ``count`` are the result from ``START``. From another state both readers step side by side until they are in
    one state, or at the stretch's first synchronising point: from there on they agree. Joined maps hold their two parts, no
    text of their own, so a text's maps take memory in proportion to it."""

    __slots__ = ("text", "head", "left", "right", "exit", "count")

    def __init__(self, exit: int, count: int, text: str = "", head: int = -1, left: StateMap | None = None, right: StateMap | None = None):
        self.exit, self.count, self.text, self.head, self.left, self.right = exit, count, text, head, left, right

    @classmethod
    def of(cls, t: Transducer, chunk: str) -> StateMap:
        first = _SYNC.search(chunk)
        if first is None:
            return cls(*t.run(t.START, chunk), chunk, -1)
        at, last = first.end() - 1, chunk.rindex(SPACE)
        while chunk[last - 1] == SPACE:
            last -= 1
        middle = chunk[at:last]
        if SPACE * 2 in middle:
            n = sum(map(t.unit, _UNIT.findall(middle)))
        else:
            units, known = middle.split(SPACE)[1:], t.units
            try:
                n = sum([known[SPACE + u] for u in units])
            except KeyError:
                n = sum([t.unit(SPACE + u) for u in units])
        exit, more = t.run(t.START, chunk[last:])
        return cls(exit, t.run(t.START, chunk[:at])[1] + n + more, chunk[:at], at)

    def then(self, t: Transducer, other: StateMap) -> StateMap:
        exit, n = other.apply(t, self.exit)
        return StateMap(exit, self.count + n, left=self, right=other)

    def apply(self, t: Transducer, state: int) -> tuple[int, int]:
        if state == t.START:
            return self.exit, self.count
        if self.left is not None:
            state, n = self.left.apply(t, state)
            if state == self.left.exit:
                return self.exit, n + self.count - self.left.count
            state, more = self.right.apply(t, state)
            return state, n + more
        other, more, text = t.START, 0, self.text
        for i in range(len(text)):
            c = text[i]
            state, n = t.run(state, c)
            other, m = t.run(other, c)
            more += n - m
            if state == other:
                return self.exit, self.count + more
        # without a synchronising point the whole stretch was read
        return (state if self.head < 0 else self.exit), self.count + more


_SYNC = re.compile(f"[^{SPACE}]{SPACE}")
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


def prefix_scan(t: Transducer, maps: list[StateMap]) -> list[StateMap]:
    """maps composed from the first to each: pairs are joined, scanned at half the length, and spread again."""
    if len(maps) < 2:
        return maps
    pairs = [a.then(t, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
    halves = prefix_scan(t, pairs)
    return [maps[0]] + [halves[i // 2] if i % 2 else halves[i // 2 - 1].then(t, maps[i]) for i in range(1, len(maps))]


class Counter:
    """Counts as sentencepiece does for a .model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        ids = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        ids.sort(key=lambda i: -m.get_score(i))
        order = {m.id_to_piece(i): k for k, i in enumerate(ids)}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in order):
            raise ValueError("a piece spans a space: its texts have no synchronising points")
        self.transducer = Transducer(order)
        probe = "a  ﬁ Ａ́  x\t\n"
        # a model whose normalizer changes nothing but spaces needs no call into the library
        self.plain = m.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    @classmethod
    def load(cls, path: str) -> Counter:
        return resident(path, lambda: cls(path))

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE) if self.plain else self.model.normalize(text)
        t = self.transducer
        state, n = t.START, 0
        # a scan at a time, so that between two of them the tables can be emptied and a text's maps don't pile up
        for a in range(0, len(marked), SCAN * chunk):
            if len(t.table) > TRANSITIONS:
                state = t.reset(state)
            maps = [StateMap.of(t, marked[i : i + chunk]) for i in range(a, min(a + SCAN * chunk, len(marked)), chunk)]
            state, more = prefix_scan(t, maps)[-1].apply(t, state)
            n += more
        return n


def token_counts(docs: DataFrame, path: str, limit: int = 4096, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def make():
        counter = Counter.load(path)
        return lambda texts: {"n_tokens": [counter.count(x) for x in texts], "n_bytes": [len(x.encode()) if x else 0 for x in texts]}

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    out = rows.mapInArrow(mapped(make, "text", _schema(kind, n_bytes=pa.int64(), n_tokens=pa.int64()), ["doc_id"]), f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
