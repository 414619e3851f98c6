"""Operator 10: secret scans with probabilistic automata learned from credentials.

Three patterns find labelled credentials (an assigned value, an access key, a
long hexadecimal run; runs without a letter are numbers and teach nothing).
For each of those kinds, and for ordinary long tokens with and without digits, a
probabilistic automaton is inferred from the sample's prefix tree over classes
of characters.  States are merged whenever the frequencies of their symbols and
ends differ by less than a Hoeffding bound allows, recursively:

* first states of one depth, from the root down, so that the many branches of
  a random format become one chain that keeps its length and the places of its
  marks and prefix;
* then states of different depths, which makes loops of formats of any length.
  Few visits are no evidence: both states need ``MIN_VISITS``, from which on the
  bound tells a state where strings end from one where they do not.

Every long token of every text is then scored: the log likelihood by the best
credential automaton whose format it fits, less the higher one of the two
automata of ordinary tokens, per character.  A token fits a format if it is no
less likely than all but a hundredth of the labelled strings are by an automaton
that has not seen them (learned from the other half).  Tokens over the
threshold, which lies between the two samples' ratios, and apart from pattern
matches, are added as spans of kind "format".  Spans are in code points, the end
exclusive; an assign span covers the whole match.

The samples are the ``MAX_FIT`` strings of lowest hash of each kind, of at most
``MAX_VALUE`` bytes each; tokens of any length are scored whole.  Ordinary tokens
that fit a credential's format teach nothing.  Null and empty texts have no spans; without
credentials or ordinary tokens to learn from nothing is added; repeated rows are
scanned alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import doc_columns, doc_rows, map_docs
from claimspark.llm.scan import byte_set, byte_values, lists, owner, span_hashes, spans, text_chunks
from claimspark.plans.session import save

KINDS = ("assign", "access", "hex", "format")
MAX_FIT, MAX_VALUE = 500, 512
MIN_VISITS = 8
CHUNK_BYTES = 1 << 20   # of text that a task works on at a time
ALPHA = 0.05        # of the Hoeffding bound
UNSEEN = math.log(1e-4)

# fixed values: the patterns of the three kinds
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
MIN_TOKEN = MIN_ASSIGN  # the shortest labelled value

_HEX = byte_set([*range(0x30, 0x3A), *range(0x61, 0x67)])
_TOKEN = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-"])
_DOTTED = _TOKEN | byte_set(b".")


def _symbol_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, codes in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ",
                               b"+", b"/", b"_", b"=", b"-", b".")):
        table[list(codes)] = k
    return table


SYMBOLS, N_SYMBOLS = _symbol_classes(), 11

#: Ordinary words are in capitals or have some in front, which makes no credential of them; capitals inside are left.
_INNER_CAPITAL = re.compile(rb"[a-z0-9][A-Z]")


def _folded(text: bytes) -> bytes:
    return text if _INNER_CAPITAL.search(text) and text.upper() != text else text.lower().replace(b"_", b"-")


def _texts_with(raw: bytes, needles: tuple[bytes, ...], off: np.ndarray) -> np.ndarray:
    at = []
    for needle in needles:
        k = raw.find(needle)
        while k >= 0:
            at.append(k)
            k = raw.find(needle, k + 1)
    return np.unique(np.searchsorted(off, at, "right") - 1) if at else np.empty(0, np.int64)


def _base(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, start of the value, text) of every pattern match, in bytes of the chunk."""
    raw, found = data.tobytes(), []
    for d in _texts_with(raw.lower(), _KEYWORDS, off):
        a, b = int(off[d]), int(off[d + 1])
        found += [(0, a + m.start(), a + m.end(), a + m.start(2), int(d))
                  for m in _ASSIGN.finditer(raw[a:b]) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    for d in _texts_with(raw, (b"AKIA",), off):
        a, b = int(off[d]), int(off[d + 1])
        found += [(1, a + m.start(), a + m.end(), a + m.start(), int(d))
                  for m in _ACCESS.finditer(raw[a:b]) if m.end() - m.start() >= MIN_ACCESS]
    starts, ends, first = spans(data, off, _HEX)
    long = np.flatnonzero(ends - starts >= MIN_HEX)
    found += [(2, a, b, a, d) for a, b, d in zip(starts[long].tolist(), ends[long].tolist(), owner(first, long).tolist())]
    return found


def _tokens(data: np.ndarray, off: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, texts) of long tokens that touch no match; dots are part of a token inside it alone."""
    starts, ends, first = spans(data, off, _DOTTED)
    long = np.flatnonzero(ends - starts >= MIN_TOKEN)
    starts, ends, text = starts[long], ends[long], owner(first, long)
    parts, stops, _ = spans(data, off, _TOKEN)
    a, b = np.searchsorted(parts, starts), np.searchsorted(stops, ends, "right") - 1
    some = np.flatnonzero(a <= b)  # not dots alone
    starts, ends, text = parts[a[some]], stops[b[some]], text[some]
    long = np.flatnonzero(ends - starts >= MIN_TOKEN)
    starts, ends, text = starts[long], ends[long], text[long]
    touched = np.zeros(len(data) + 1, np.int32)
    for _, a, b, _, _ in found:
        touched[a] += 1
        touched[b] -= 1
    sums = np.concatenate([[0], np.cumsum(np.cumsum(touched[:-1]) > 0)])
    apart = sums[ends] == sums[starts]
    return starts[apart], ends[apart], text[apart]


@dataclass
class Automaton:
    """Per state: next state, log probability of each symbol and of the end."""

    step: np.ndarray
    symbol: np.ndarray
    end: np.ndarray
    ordinary: bool = False

    def likelihood(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log likelihood per symbol of each string."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        state, total = np.zeros(len(size), np.int64), np.zeros(len(size))
        left = len(size)
        for k in range(int(size.max()) if len(size) else 0):
            while left and size[order[left - 1]] <= k:
                left -= 1
            on = order[:left]
            s = symbols[off[on] + k]
            total[on] += self.symbol[state[on], s]
            state[on] = self.step[state[on], s]
        return (total + self.end[state]) / np.maximum(size + 1, 1)


@dataclass
class _Node:
    ends: int = 0
    count: dict[int, int] = field(default_factory=dict)
    next: dict[int, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.ends + sum(self.count.values())


def _alike(f1: int, n1: int, f2: int, n2: int) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) <= bound


def _compatible(nodes: list[_Node], a: int, b: int) -> bool:
    todo, met = [(a, b)], {(a, b)}
    while todo:
        x, y = (nodes[k] for k in todo.pop())
        n, m = x.total, y.total
        if not n or not m:
            continue
        if not _alike(x.ends, n, y.ends, m):
            return False
        for s in {*x.count, *y.count}:
            if not _alike(x.count.get(s, 0), n, y.count.get(s, 0), m):
                return False
            if s in x.next and s in y.next and x.next[s] != y.next[s] and (x.next[s], y.next[s]) not in met:
                met.add((x.next[s], y.next[s]))
                todo.append((x.next[s], y.next[s]))
    return True


def _fold(nodes: list[_Node], into: int, tree: int) -> None:
    """Add a subtree's counts to a state and its successors; where those lack a branch it is moved over."""
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        x, y = nodes[a], nodes[b]
        x.ends += y.ends
        for s, n in y.count.items():
            x.count[s] = x.count.get(s, 0) + n
            if s in x.next:
                todo.append((x.next[s], y.next[s]))
            else:
                x.next[s] = y.next[s]


def _tree(strings: list[bytes]) -> list[_Node]:
    """The prefix tree; the root is node 0."""
    nodes = [_Node()]
    for text in sorted(strings):
        at = 0
        for s in SYMBOLS[np.frombuffer(text, np.uint8)].tolist():
            node = nodes[at]
            node.count[s] = node.count.get(s, 0) + 1
            if s not in node.next:
                node.next[s] = len(nodes)
                nodes.append(_Node())
            at = node.next[s]
        nodes[at].ends += 1
    return nodes


def _pool_depths(nodes: list[_Node]) -> None:
    """Merges compatible states of one depth, the most visited first; a tree becomes a graph of levels."""
    level = [0]
    while level:
        edges = [(p, s) for p in level for s in sorted(nodes[p].next)]
        edges.sort(key=lambda e: (-nodes[nodes[e[0]].next[e[1]]].total, e[1], e[0]))
        below: list[int] = []
        for parent, s in edges:
            child = nodes[parent].next[s]
            if child in below:
                continue
            for state in below:
                if _compatible(nodes, state, child):
                    nodes[parent].next[s] = state
                    _fold(nodes, state, child)
                    break
            else:
                below.append(child)
        level = below


def _merge_depths(nodes: list[_Node]) -> list[int]:
    """Merges well visited states of different depths, nearest to the root first; returns the states that stay."""
    kept, queue = [0], deque([0])
    while queue:
        parent = queue.popleft()
        for s in sorted(nodes[parent].next):
            child = nodes[parent].next[s]
            if child in kept:
                continue
            for state in kept:
                if min(nodes[state].total, nodes[child].total) >= MIN_VISITS and _compatible(nodes, state, child):
                    # what leads to the child leads to the state; its visits are shared out over a loop, not added twice
                    for node in nodes:
                        for t, to in node.next.items():
                            if to == child:
                                node.next[t] = state
                    _absorb(nodes, state, child)
                    if state not in queue:
                        queue.append(state)  # it may have new branches
                    break
            else:
                kept.append(child)
                queue.append(child)
    reached, todo = {0}, [0]
    while todo:
        for to in nodes[todo.pop()].next.values():
            if to not in reached:
                reached.add(to)
                todo.append(to)
    return sorted(reached)


def _absorb(nodes: list[_Node], into: int, gone: int) -> None:
    """Adds a state's counts, and recursively those of what follows where both have a branch."""
    todo, met = [(into, gone)], set()
    while todo:
        a, b = todo.pop()
        if a == b or (a, b) in met:
            continue
        met.add((a, b))
        x, y = nodes[a], nodes[b]
        x.ends += y.ends
        for s, n in list(y.count.items()):
            x.count[s] = x.count.get(s, 0) + n
            if s in x.next:
                todo.append((x.next[s], y.next[s]))
            else:
                x.next[s] = y.next[s]


def infer(strings: list[bytes], ordinary: bool = False) -> Automaton:
    """The merged prefix tree of a sample, as a probabilistic automaton.

    A symbol that a state has not met costs half a visit and goes where most of
    the state's strings go; in a credential's format only if the sample has it.
    """
    nodes = _tree([_folded(x) for x in strings] if ordinary else strings)
    _pool_depths(nodes)
    kept = _merge_depths(nodes)
    alphabet = range(N_SYMBOLS) if ordinary else {s for k in kept for s in nodes[k].count}
    sink, place = len(kept), {state: k for k, state in enumerate(kept)}
    step = np.full((sink + 1, N_SYMBOLS), sink, np.int64)
    symbol, end = np.full((sink + 1, N_SYMBOLS), UNSEEN), np.full(sink + 1, UNSEEN)
    for state, k in place.items():
        node = nodes[state]
        if node.count:
            usual = max(sorted(node.count), key=lambda s: node.count[s])
            for s in alphabet:
                step[k, s] = place[node.next[usual]]
                symbol[k, s] = math.log(0.5 / (node.total + 1))
        for s, n in node.count.items():
            step[k, s] = place[node.next[s]]
            symbol[k, s] = math.log(n / node.total)
        if node.ends:
            end[k] = math.log(node.ends / node.total)
    return Automaton(step, symbol, end, ordinary)


def _likelihoods(machine: Automaton, strings: list[bytes]) -> np.ndarray:
    strings = [_folded(x) for x in strings] if machine.ordinary else strings
    data = SYMBOLS[np.frombuffer(b"".join(strings), np.uint8)]
    return machine.likelihood(data, np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64))


def _least(strings: list[bytes]) -> float:
    """The likelihood that all but a hundredth of the strings reach by an automaton of the other half."""
    halves = [sorted(set(strings))[k::2] for k in (0, 1)]
    if not halves[1]:
        return float(_likelihoods(infer(strings), strings).min()) - 1e-9
    unseen = [_likelihoods(infer(halves[1 - k]), halves[k]) for k in (0, 1)]
    return float(np.quantile(np.concatenate(unseen), 0.01)) - 1e-9


@dataclass
class Scorer:
    """Automata of the kinds, with the least likelihood that fits each format, and those of ordinary tokens."""

    credentials: list[tuple[Automaton, float]]
    ordinary: list[Automaton]
    threshold: float = math.inf

    def accepts(self, strings: list[bytes]) -> np.ndarray:
        """Whether some format fits and explains the string better than ordinary text, by the threshold."""
        return self.fitted(strings) - self.usual(strings) > self.threshold

    def fitted(self, strings: list[bytes]) -> np.ndarray:
        """The likelihood by the best format that fits; -inf where none does."""
        each = [(_likelihoods(a, strings), least) for a, least in self.credentials]
        return np.max([np.where(x >= least, x, -np.inf) for x, least in each], axis=0)

    def usual(self, strings: list[bytes]) -> np.ndarray:
        return np.max([_likelihoods(a, strings) for a in self.ordinary], axis=0)


def _has_letter(text: bytes) -> bool:
    return any(x > 0x40 and x != 0x5F for x in text)


def fit(credentials: dict[str, list[bytes]], ordinary: list[list[bytes]]) -> Scorer:
    """Automata of each kind of credential and of each list of ordinary tokens, and the threshold between them."""
    credentials = {k: own for k, v in credentials.items() if (own := [x for x in v if _has_letter(x)])}
    out = Scorer([(infer(v), _least(v)) for v in credentials.values()], [])
    if not out.credentials:
        return out
    ordinary = [[x for x, fits in zip(v, np.isfinite(out.fitted(v))) if not fits] for v in ordinary if v]
    out.ordinary = [infer(v, ordinary=True) for v in ordinary if v]
    if not out.ordinary:
        return Scorer([], [])
    labelled, plain = [x for v in credentials.values() for x in v], [x for v in ordinary for x in v]
    high = out.fitted(labelled) - out.usual(labelled)
    low = np.maximum(out.fitted(plain) - out.usual(plain), 0.0)
    high = high[np.isfinite(high)]
    if not len(high):
        return Scorer([], [])
    out.threshold = max(float(np.quantile(low, 0.999) + np.quantile(high, 0.05)) / 2, 0.0) + 1e-9
    return out


def _sample(limit: int):
    """The strings of lowest hash of each kind that a task meets; kinds 3 and 4 are long tokens without and with a digit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, bytes]] = {k: {} for k in range(5)}
        values = byte_values(fold=False)
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0), CHUNK_BYTES):
                found = _base(data, off)
                starts, ends, _ = _tokens(data, off, found)
                raw = data.tobytes()
                digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data < 0x3A))])
                plain = digits[starts] == digits[ends]
                own = [(np.array([x[3] for x in found if x[0] == k], np.int64), np.array([x[2] for x in found if x[0] == k], np.int64)) for k in range(3)]
                for kind, (a, b) in enumerate([*own, (starts[plain], ends[plain]), (starts[~plain], ends[~plain])]):
                    short = b - a <= MAX_VALUE
                    a, b = a[short], b[short]
                    if len(a):
                        h, one = np.unique(span_hashes(data, a, b, values) >> np.uint64(1), return_index=True)
                        for k, i in zip(h[:limit].tolist(), one[:limit].tolist()):
                            best[kind][k] = raw[a[i]:b[i]]
                        best[kind] = dict(sorted(best[kind].items())[:limit])
        rows = [(kind, h, text) for kind, own in best.items() for h, text in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.binary())], ["kind", "hash", "value"])
    return run


def train(docs: DataFrame, limit: int = MAX_FIT) -> Scorer:
    """Learns from the ``limit`` strings of lowest hash of each kind; those alone reach the driver."""
    texts = doc_columns(docs).select("text")
    sampled = save(texts.mapInArrow(_sample(limit), "kind int, hash long, value binary"), "credentials").distinct()
    kinds = [[bytes(r.value) for r in sampled.filter(F.col("kind") == k).orderBy("hash", "value").limit(limit).collect()]
             for k in range(5)]
    return fit(dict(zip(KINDS, kinds[:3])), kinds[3:])


def _scanned(docs: DataFrame, scorer: Scorer) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # a few automata
    values = byte_values(fold=False)

    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        for lo, hi, data, off in text_chunks(batch.column(1), CHUNK_BYTES):
            found = _base(data, off)
            rows = [(d, a, k, b) for k, a, b, _, d in found]
            starts, ends, text = _tokens(data, off, found)
            if len(starts) and shared.value.ordinary:
                raw = data.tobytes()
                _, one, place = np.unique(span_hashes(data, starts, ends, values), return_index=True, return_inverse=True)
                over = shared.value.accepts([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])[place]
                rows += [(d, a, 3, b) for d, a, b in zip(text[over].tolist(), starts[over].tolist(), ends[over].tolist())]
            rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = points[off[rows[:, 0]]]
            each = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for k in rows[:, 2]], pa.string()), pa.array(points[rows[:, 1]] - base),
                 pa.array(points[rows[:, 3]] - base)], ["kind", "start", "end"])
            yield hi - lo, [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                            lists(each, np.bincount(rows[:, 0], minlength=hi - lo))]
    return map_docs(docs, run, "doc_id bigint, text string, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secrets(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, text and spans (kind, start, end; by start, then kind as in ``KINDS``): one row per document."""
    return _scanned(doc_columns(docs), scorer)


def redact(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows, with all their columns, their texts without secrets; n_chars, if there, is the new length."""
    out = _scanned(doc_rows(docs), scorer).withColumn("clean", redacted(F.col("text"), F.col("spans")))
    fresh = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
             if "n_chars" in docs.columns else None}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def written(spans_column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans_column: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def take(state, s):
        gap = F.when(s["start"] >= state["at"], F.concat(
            F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))).otherwise("")
        return F.struct(F.concat(state["done"], gap).alias("done"), F.greatest(state["at"], s["end"]).alias("at"))
    out = F.aggregate(spans_column, empty, take,
                      lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans_column) > 0, out).otherwise(text)
