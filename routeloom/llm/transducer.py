"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary with word ends is compiled, as far as texts need it, into a deterministic transducer. A
state holds what can still matter of a word's prefix: for each place from which a vocabulary entry may still be
growing, the last token before that place and the token count there, relative to the count here. A transition
reads one byte letter and is annotated with the change of the token count; the last letter of a pre-token has
transitions of its own, which end in the state between pre-tokens. Two tokens may stand side by side exactly if
merging their letters gives the two again, which fixes the last token of every prefix; so the counts are exact.

Before it, a scanner of seven states cuts a text into pre-tokens by character class. The state of both together is
(scanner's state, transducer's state, letter read last, whose transition depends on whether it is the last one). Texts
are cut into chunks at any place. The map of a chunk takes a state before it to (state after it, tokens emitted
in it). There are too many states to tabulate all, so a map is tabulated at the states that are asked of it; at white
space all states agree, so what follows the first one in a chunk is computed once for all of them. Maps compose
associatively by a prefix scan; a map has a fixed size, whatever the length of a text or of its words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, forget
from .tokens import SPACES, doubtful, ids_of, lowered, rare, spelled

END = "</w>"
LETTER, NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Endings that follow an apostrophe as one pre-token (fixed values).
ENDINGS = {"s", "t", "m", "d", "re", "ve", "ll"}
BETWEEN = re.compile(rf"[{SPACES}]+")


class State:
    __slots__ = ("key", "next", "last")

    def __init__(self, key):
        self.key, self.next, self.last = key, {}, {}


class Transducer:
    """Counts of pre-tokens; compiled lazily, at most `states` states at a time."""

    def __init__(self, path: str, states: int = 120_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tokens = set(model["vocab"])
        self.growing = {t[:n] for t in self.tokens for n in range(1, len(t.removesuffix(END)))}
        self.limit = states
        self._fresh()

    def _fresh(self) -> None:
        self.start = State(("", ((0, None, 0),)))
        self.states = {self.start.key: self.start}
        self.beside: dict[tuple, bool] = {}

    def _stands(self, before: str | None, token: str) -> bool:
        """Whether a token may follow another (None: begins the pre-token)."""
        known = self.beside.get((before, token))
        if known is None:
            body = token.removesuffix(END)
            letters = [*(before or ""), *body]
            if body != token:
                letters[-1] += END
            known = self.beside[before, token] = self._merged(letters) == ([token] if before is None else [before, token])
        return known

    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _token(self, state: State, letter: str) -> tuple[str, int]:
        """The last token once the letter is read, and the change of the count."""
        tail, places = state.key
        for back, before, count in places:  # from the longest
            token = (tail[len(tail) - back :] if back else "") + letter
            if token in self.tokens and self._stands(before, token):
                return token, count + 1
        raise ValueError(f"no token ends in {letter!r}: the vocabulary lacks a byte")

    def _next(self, state: State, letter: str) -> tuple[State, int]:
        token, change = self._token(state, letter)
        tail, places = state.key
        tail += letter
        live = [(back + 1, before, count - change) for back, before, count in places if tail[len(tail) - back - 1 :] in self.growing]
        live.append((0, token, 0))
        key = (tail[len(tail) - live[0][0] :] if live[0][0] else "", tuple(live))
        if len(self.states) >= self.limit:
            self._fresh()
        to = self.states.setdefault(key, State(key))
        state.next[letter] = (to, change)
        return to, change

    def _last(self, state: State, letter: str) -> int:
        change = state.last[letter] = self._token(state, letter + END)[1]
        return change

    def count(self, pre_token: str) -> int:
        letters = spelled(pre_token)
        state, total = self.start, 0
        for c in letters[:-1]:
            state, change = state.next.get(c) or self._next(state, c)
            total += change
        c = letters[-1]
        change = state.last.get(c)
        return total + (self._last(state, c) if change is None else change)


def pre_tokens(word: str) -> Iterator[str]:
    """The scanner: one pass over a run without white space. States: between, in letters, in others, after an
    apostrophe that begins a pre-token, and after that with a first r, v or l."""
    state, start = "", 0
    for i, c in enumerate(word):
        kind = "L" if LETTER.match(c) else "N" if NUMBER.match(c) else "O"
        if state in ("'r", "'v", "'l"):
            if state[1] + c in ENDINGS:
                yield word[start : i + 1]
                state, start = "", i + 1
                continue
            yield "'"  # it stood alone; the letter after it begins a run
            state, start = "L", i - 1
        elif state == "'":
            if c in ENDINGS:
                yield word[start : i + 1]
                state, start = "", i + 1
                continue
            if c in "rvl":
                state = "'" + c
                continue
            state = "O"
        if state and state != kind:
            yield word[start:i]
            state, start = "", i
        if not state:
            start = i
            if kind == "N":
                yield c
                start = i + 1
            else:
                state = "'" if c == "'" else kind
    if state in ("'r", "'v", "'l"):
        yield "'"
        yield word[start + 1 :]
    elif state:
        yield word[start:]


CHUNK = 1 << 10  # code points; shorter texts are one chunk


class Map:
    """Of a stretch of text: state before -> (state after, tokens emitted), tabulated at the states asked for."""

    __slots__ = ("of", "known")

    def __init__(self, of):
        self.of, self.known = of, {}

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        key = (state[0], state[1].key, state[2])
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self.of(state)
        return found


def compose(a: Map, b: Map) -> Map:
    """First a, then b."""

    def of(state: tuple) -> tuple[tuple, int]:
        middle, n = a(state)
        after, m = b(middle)
        return after, n + m

    return Map(of)


def scan(maps: list[Map]) -> list[Map]:
    """All prefixes' maps: pairs are composed, the half as long list is scanned, and the rest filled in."""
    if len(maps) < 2:
        return maps
    odd = scan([compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
    return [maps[0] if not i else odd[i // 2] if i % 2 else compose(odd[i // 2 - 1], maps[i]) for i in range(len(maps))]


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str, chunk: int = CHUNK):
        self.machine, self.chunk, self.path = Transducer(path), chunk, path
        with open(path, encoding="utf-8") as f:
            specials = [t["content"] for t in json.load(f)["added_tokens"]]
        self.specials = specials
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        self.part = Memo(self.machine.count, 150_000)
        self.word = Memo(lambda w: sum(map(self.part.__getitem__, pre_tokens(w))), 250_000)
        self.start = ("", self.machine.start, None)

    def feed(self, state: tuple, text: str) -> tuple[tuple, int]:
        """Read letters without white space, one by one: state before -> (state after, tokens emitted)."""
        machine, part = self.machine, self.part
        (kind, node, last), n = state, 0
        for c in text:
            new = "L" if LETTER.match(c) else "N" if NUMBER.match(c) else "O"
            held = ""
            if len(kind) == 2:  # an apostrophe and r, v or l
                if kind[1] + c in ENDINGS:
                    n += part[kind + c]
                    kind = ""
                    continue
                n += part["'"]
                held, kind = kind[1], "L"
            elif kind == "'":
                if c in ENDINGS:
                    n += part["'" + c]
                    kind = ""
                    continue
                if c in "rvl":
                    kind += c
                    continue
                held, kind = "'", "O"
            if held:
                node, last = machine.start, held
            if kind and kind != new:
                n += self._end(node, last)
                kind = ""
            if not kind:
                if new == "N":
                    n += part[c]
                    continue
                if c == "'":
                    kind = c
                    continue
                kind, node, last = new, machine.start, None
            for letter in spelled(c):
                if last is not None:
                    node, change = node.next.get(last) or machine._next(node, last)
                    n += change
                last = letter
        return ((kind, node, last) if kind in ("L", "O") else (kind, machine.start, None)), n

    def _end(self, node: State, letter: str) -> int:
        change = node.last.get(letter)
        return self.machine._last(node, letter) if change is None else change

    def finish(self, state: tuple) -> int:
        """Tokens emitted where white space or the end of the text follows."""
        kind, node, last = state
        return 0 if not kind else sum(map(self.part.__getitem__, kind)) if kind[0] == "'" else self._end(node, last)

    def chunk_map(self, text: str, lo: int, hi: int) -> Map:
        first = BETWEEN.search(text, lo, hi)
        if first is None:
            return Map(lambda state: self.feed(state, text[lo:hi]))
        *words, tail = BETWEEN.split(text[first.end() : hi])
        fixed = sum(map(self.word.__getitem__, filter(None, words)))
        after, n = self.feed(self.start, tail)
        fixed += n

        def of(state: tuple) -> tuple[tuple, int]:
            head = text[lo : first.start()]
            if not state[0]:  # between pre-tokens a word's rest counts like a word
                return after, (self.word[head] if head else 0) + fixed
            before, m = self.feed(state, head)
            return after, m + self.finish(before) + fixed

        return Map(of)

    def _count(self, text: str) -> int:
        text = lowered(text) + " "  # its end is like white space
        whole = scan([self.chunk_map(text, i, min(len(text), i + self.chunk)) for i in range(0, len(text), self.chunk)])[-1]
        after, n = whole(self.start)
        return n + self.finish(after)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() and rare().search(text) and doubtful().search(text):  # the character classes differ between Unicode versions
            return len(ids_of(self.path).whole(text)) // 4
        if any(s in text for s in self.specials):
            return sum(map(self._count, self.special.split(text))) + len(self.special.findall(text))
        return self._count(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row of `docs` (doc_id, text).

    Null and empty texts have no bytes and no tokens; repeated rows give repeated rows; other columns are not read.
    Texts of any length, also without white space, take memory in proportion to the text alone. `path`: a byte-pair
    vocabulary with word ends. No shuffle; a worker keeps a bounded part of the transducer.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        forget(counts.word, counts.part)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counts(t) for t in texts]
            yield pa.record_batch([b.column(0), pa.array([len(t.encode("utf-8", "replace")) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, SCHEMA)
