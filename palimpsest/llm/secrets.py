"""Operator 6: secrets by fixed patterns and by probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

#: Fixed by the contract of the query: patterns, least lengths, order of kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Lower-case parts one of which every assignment's key holds.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Labelled credentials of each kind, and ordinary tokens, that are learnt from at most.
EXAMPLES = 1_500
#: Shortest token that is scored, as values of assignments are no shorter, and the gain in bits a character over ordinary
#: tokens that makes it a secret; bits that it must gain in all, as few tokens are credentials: one in a million.
LEAST_TOKEN, GAIN, PRIOR = LEAST_ASSIGN, 1.0, 20.0
#: Forms of tokens whose kind a task keeps in mind.
MEMO = 1 << 18
#: Confidence of the compatibility test of two states.
ALPHA = 0.05
#: In a text's form: runs of credential characters, with dots inside only.
_TOKEN = re.compile(rb"[0fFzZ+/_=-]+(?:\.+[0fFzZ+/_=-]+)*")


def base_spans(text: str, longest: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: what the fixed patterns find, in code points.

    longest, where known, is a bound on the longest run of credential characters.
    """
    found, low = [], text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if longest is None or longest >= LEAST_HEX:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if found else found


def symbol(c: str) -> str:
    """Class of a character of a credential: formats differ by classes, not by single letters."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "f"
    if "A" <= c <= "F":
        return "F"
    return "z" if c.islower() else "Z" if c.isupper() else c


#: Characters that a class stands for.
WIDTH = {"0": 10, "f": 6, "F": 6, "z": 20, "Z": 20}


_FORM = bytes(ord(symbol(chr(i))) if i < 128 and (chr(i).isalnum() or chr(i) in "+/_=.-") else 32 for i in range(256))
_CREDENTIAL = bytes(i if _FORM[i] != 32 else 32 for i in range(256))
_LOWER_FORM = bytes.maketrans(b"FZ", b"fz")


def form(text: str) -> bytes:
    """The text's characters as classes, one byte each, blanks for those that credentials don't hold."""
    return text.encode("ascii", "replace").translate(_FORM)


def tokens(forms: bytes) -> set[bytes]:
    """The different tokens of a form: runs without blanks, dots at their ends left out."""
    return {w.strip(b".") for w in set(forms.split())}


@dataclass
class State:
    stops: int = 0
    passes: dict[str, int] = field(default_factory=dict)
    next: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.stops + sum(self.passes.values())


class Automaton:
    """A probabilistic automaton by state merging over the prefix tree of the examples.

    States are taken in order from the root. A candidate is folded into the first settled state with which the
    Hoeffding test finds it compatible, in stopping, in each symbol and below; else it is settled itself.
    """

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.states = [State()]
        self.alpha = alpha
        for text in sorted(examples):
            at = 0
            for s in map(symbol, text):
                st = self.states[at]
                st.passes[s] = st.passes.get(s, 0) + 1
                if s not in st.next:
                    st.next[s] = len(self.states)
                    self.states.append(State())
                at = st.next[s]
            self.states[at].stops += 1
        self._merge()
        self.total = len(examples)

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            p, q = self.states[x], self.states[y]
            n, m = p.total, q.total
            if self._differ(p.stops, n, q.stops, m):
                return False
            for s in p.passes.keys() | q.passes.keys():
                if self._differ(p.passes.get(s, 0), n, q.passes.get(s, 0), m):
                    return False
            todo += [(p.next[s], q.next[s]) for s in p.next.keys() & q.next.keys() if p.next[s] != q.next[s]]
        return True

    def _fold(self, into: int, source: int) -> None:
        todo = [(into, source)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            p, q = self.states[x], self.states[y]
            p.stops += q.stops
            for s, k in q.passes.items():
                p.passes[s] = p.passes.get(s, 0) + k
                if s in p.next:
                    todo.append((p.next[s], q.next[s]))
                else:
                    p.next[s] = q.next[s]

    def _merge(self) -> None:
        settled, seen = [0], {0}
        i = 0
        while i < len(settled):
            for s in sorted(self.states[settled[i]].next):
                blue = self.states[settled[i]].next[s]
                if blue in seen:
                    continue
                for red in settled:
                    if self._compatible(red, blue):
                        self.states[settled[i]].next[s] = red
                        self._fold(red, blue)
                        i = -1  # edges of settled states have changed: look from the root again
                        break
                else:
                    settled.append(blue)
                    seen.add(blue)
                    continue
                break
            i += 1
        number = {q: k for k, q in enumerate(settled)}
        self.states = [State(self.states[q].stops, self.states[q].passes, {s: number[t] for s, t in self.states[q].next.items() if t in number}) for q in settled]

    def bits(self, text: str) -> float:
        """Negative log2 likelihood of the text and its end; what was never seen has a share of half a count."""
        return self.form_bits("".join(map(symbol, text)))

    def form_bits(self, text: str) -> float:
        at, out = 0, 0.0
        kinds = 12
        for s in text:
            st = self.states[at] if at is not None else None
            n = st.total if st else 0
            out -= math.log2(((st.passes.get(s, 0) if st else 0) + 0.5) / (n + 0.5 * kinds) / WIDTH.get(s, 1))
            at = st.next.get(s) if st else None
        st = self.states[at] if at is not None else None
        return out - math.log2(((st.stops if st else 0) + 0.5) / ((st.total if st else 0) + 0.5 * kinds))


@dataclass
class Model:
    kinds: dict[str, Automaton]
    ordinary: Automaton
    known: dict[bytes, str | None] = field(default_factory=dict, repr=False)

    def kind(self, token: str, gain: float = GAIN) -> str | None:
        """The kind whose automaton gives the token the best likelihood, if it gains enough over ordinary tokens."""
        return self.form_kind(form(token), gain)

    def form_kind(self, token: bytes, gain: float = GAIN) -> str | None:
        """kind() of a token's form: automata see nothing else of it."""
        if not self.kinds:
            return None
        if token in self.known:
            return self.known[token]
        plain = token.decode()
        bits, kind = min((a.form_bits(plain), k) for k, a in self.kinds.items())
        # a word in capitals is no rarer
        usual = min(self.ordinary.form_bits(plain), self.ordinary.form_bits(token.translate(_LOWER_FORM).decode()) + 1)
        found = kind if usual - bits >= max(PRIOR, gain * len(token)) else None
        if len(self.known) < MEMO:
            self.known[token] = found
        return found


def _value(text: str, kind: str, a: int, z: int) -> str:
    return ASSIGN.match(text, a)[2] if kind == "assign" else text[a:z]


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """(form, start, end) of the tokens long enough to be scored that no base span touches. base is sorted by start.

    Tokens and spans are both in order, so one pass over both tells which tokens are free.
    """
    at, reach = 0, 0
    for m in _TOKEN.finditer(form(text)):
        a, z = m.span()
        if z - a < LEAST_TOKEN:
            continue
        while at < len(base) and base[at][1] < z:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            yield m[0], a, z


def fit(docs: DataFrame, examples: int = EXAMPLES) -> Model:
    """Infers an automaton for the values of each kind and one for ordinary tokens.

    The fixed patterns label the credentials of all documents; tokens that no pattern touches are the ordinary ones.
    Of each kind's different values those of least hash are learnt from, so many at most: a sample that is the same
    however the rows are dealt, for which each task sends no more than that of each kind. A corpus without credentials
    gives a model that adds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {k: {} for k in ("", *KINDS)}
        limit = dict.fromkeys(least, 1 << 64)

        def add(kind: str, value: str) -> None:
            h = xxhash.xxh64_intdigest(value)
            if h < limit[kind]:
                own = least[kind]
                own[value] = h
                if len(own) >= 2 * examples:
                    for v, x in sorted(own.items(), key=lambda p: (p[1], p[0]))[examples:]:
                        del own[v]
                        limit[kind] = min(limit[kind], x)

        for whole in batches:
            for b in common.pieces(whole):
                for t in common.strings(b):
                    spans = base_spans(t)
                    for k, a, z in spans:
                        add(k, _value(t, k, a, z))
                    if spans:
                        free = {t[a:z] for _, a, z in candidates(t, spans)}
                    else:
                        free = {w.strip(".") for w in set(t.encode("ascii", "replace").translate(_CREDENTIAL).decode().split())}
                    for v in free:
                        if len(v) >= LEAST_TOKEN:
                            add("", v)
        rows = [(k, v, h - (1 << 63)) for k, own in least.items() for v, h in sorted(own.items(), key=lambda p: (p[1], p[0]))[:examples]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "h"])

    found = common.stage(docs.select("text").filter("text is not null").mapInArrow(run, "kind string, value string, h long").distinct(), "secret-examples")
    by = {k: [r["value"] for r in found.filter(F.col("kind") == k).orderBy("h", "value").limit(examples).collect()] for k in ("", *KINDS)}
    return Model({k: Automaton(by[k]) for k in KINDS if by[k]}, Automaton(by[""]))


def all_spans(model: Model, text: str, gain: float = GAIN) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans and, where they have none, tokens that an automaton takes for its kind.

    The different forms of a text's tokens are judged first; places are looked up only where one of them is a secret's.
    """
    forms = tokens(form(text))
    base, more = base_spans(text, max(map(len, forms), default=0)), []
    if model.kinds:
        known = model.known
        like = {f for f in forms if len(f) >= LEAST_TOKEN and (known[f] if f in known else model.form_kind(f, gain))}
        if like:
            more = [(f"like_{model.form_kind(f, gain)}", a, z) for f, a, z in candidates(text, base) if f in like]
    if not (base or more):
        return []
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[0], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def scan(docs: DataFrame, model: Model, gain: float = GAIN) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans; no shuffle.

    Spans of the automata are named like_<kind>. Null and empty texts have none, and base_sha256 is then that of the
    empty string. Very long texts are scanned whole, in one pass over their tokens. Other columns, null keys and repeated
    rows pass through; input columns of the five names are replaced. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def each(batch):
            every = [all_spans(m, t, gain) for t in common.strings(batch)]
            base = [[s for s in x if s[0] in KINDS] for x in every]
            counts = [[sum(s[0] == k for s in x) for x in base] for k in KINDS]
            return [*counts, [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], [joined(x) for x in every]]

        return each

    names = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    return common.add_columns(docs, names, make)
