"""Operator 9: toxicity by a subsequence-kernel SVM with Nystroem landmarks.

The kernel compares two words by the three-letter subsequences that they share,
each weighted by ``DECAY`` for every skipped letter (at most two): inserted or
dropped letters lower the likeness a little and do not end it.  Punctuation
inside a word is skipped and single letters that stand apart are put together,
so spelled-out insults stay words.

A second kernel compares two runs of up to ``RUN`` neighbouring words of one
sentence by the subsequences of two words that they share, weighted alike for
skipped words: a phrase made of ordinary words can be toxic too.  A sentence
ends at a full stop, exclamation or question mark before white space.

Training (``fit``): a toxic document has one word or run at least that makes it
so.  It stands for the document: first what is most typical of toxic documents,
then in each round what the last model scores highest.  Words and runs of clean
documents are the other class, the highest-scoring ones added in each round.
The kernel values against the landmarks are whitened by the landmarks' own
kernel matrix, and a linear squared-hinge SVM is fitted there, one for words and
one for runs.  Runs are told apart by the ``MAX_PAIRS`` pairs of words that are
most typical of toxic documents.

Scoring: since a kernel value against a landmark is a sum over subsequences, the
machines fold into one weight for each subsequence, so a word costs a few
table look-ups.  A text scores as its highest word or, if that is more, its
highest run with a known pair.  Logistic curves turn both into 0 to 1; that of
words is fitted on the training documents, that of runs on the third of them
that the machine of runs has not seen.  Either machine alone can make a text
toxic, so runs have to do good among that third's documents that words do not
catch, where a clean one rejected weighs as much as ``SURE`` toxic ones caught;
else their curve is moved, or they are left out.  Texts are sorted and words numbered by their hashes
before anything is learned, so the order of the rows does not matter.

Labels are read only for documents whose crc32(doc_id as text) is not divisible
by five; at most ``MAX_FIT_DOCS`` of each class, and of at most
``MAX_FIT_BYTES`` bytes each, are used.  Every text is scored whole.

Null and empty texts get the score of a text without words; without any
labelled document of both classes every score is the share of toxic ones (0
without labels); a null doc_id has no label and is not held out; repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import doc_columns, doc_rows, map_docs
from claimspark.llm.scan import mix, release, span_hashes, text_chunks

MAX_FIT_DOCS, MAX_FIT_BYTES = 4000, 1 << 16
DECAY = 0.5
LANDMARKS, ROUNDS, NEGATIVES = 256, 4, 6000
PIECE, STRIDE = 24, 12  # longer words are read in overlapping pieces
RUN, GAPS = 8, 3        # words of a run; a pair's words are at most GAPS places apart
SURE = 9                # toxic documents that runs have to catch for each clean one that they reject
CHUNK_BYTES = 1 << 20   # of text that a task works on at a time
MAX_PAIRS, MIN_DOCS = 2000, 3  # a known pair is in MIN_DOCS toxic documents at least

_PAIRS = [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
_EDGE, _WHITE = 63, 255


def _symbols() -> np.ndarray:
    """0: skipped; 255: white space; else one of 62 symbols."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = _WHITE
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    table[0x30:0x3A] = 27
    table[0x80:] = 28 + np.arange(128) % 35
    return table


def _words(data: np.ndarray, off: np.ndarray):
    """(symbols, starts, ends, first, sentences): the words of each text, pieces of long words one by one.

    Words of one sentence have the same number, which grows from sentence to sentence.
    """
    s = _symbols()[data]
    keep = s != 0
    stop = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    stop[:-1] &= s[1:] == _WHITE
    sentence = np.cumsum(stop, dtype=np.int32)[keep]
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    s = s[keep]

    def runs():
        inside = s != _WHITE
        edge = np.zeros(len(s) + 1, bool)
        edge[off] = True
        before, after = np.append(False, inside), np.append(inside, False)
        before[edge] = False
        after[edge] = False
        return np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1

    starts, ends = runs()
    if len(starts) > 1:  # drop the white space between two single letters of one text
        text = np.searchsorted(off, starts, "right")
        single = (ends - starts == 1) & (s[starts] <= 26)
        near = np.flatnonzero(single[:-1] & single[1:] & (text[:-1] == text[1:]))
        gap = np.zeros(len(s) + 1, np.int32)
        gap[ends[near]] = 1
        gap[starts[near + 1]] -= 1
        keep = np.cumsum(gap[:-1]) == 0
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        s, sentence = s[keep], sentence[keep]
        starts, ends = runs()
    long = np.flatnonzero(ends - starts > PIECE)
    if len(long):
        more = (ends[long] - starts[long] - PIECE + STRIDE - 1) // STRIDE
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = np.repeat(starts[long], more) + k * STRIDE
        stop = np.minimum(extra + PIECE, np.repeat(ends[long], more))
        ends[long] = starts[long] + PIECE
        starts, ends = np.concatenate([starts, extra]), np.concatenate([ends, stop])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    # a text ends a sentence
    return s, starts, ends, np.searchsorted(starts, off), sentence[starts] + np.searchsorted(off, starts, "right")


def _hashes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(s, starts, ends, mix(np.arange(7, 263, dtype=np.uint64)) | np.uint64(1))


def _subsequences(words: list[bytes]):
    """(word number, subsequence, weight) of each three-symbol subsequence, and the norm of each word."""
    gap = bytes(4)
    joined = gap.join(bytes([_EDGE]) + w + bytes([_EDGE]) for w in words) + gap
    s = np.frombuffer(joined, np.uint8).astype(np.int32)
    size = np.array([len(w) + 6 for w in words])
    word = np.repeat(np.arange(len(words)), size)[:len(s)]
    n = len(s) - 4
    number, code, weight = [], [], []
    for a, b in _PAIRS:
        ok = np.flatnonzero((s[:n] > 0) & (s[a:a + n] > 0) & (s[b:b + n] > 0) & (word[:n] == word[b:b + n]))
        number.append(word[ok])
        code.append(s[ok] << 12 | s[ok + a] << 6 | s[ok + b])
        weight.append(np.full(len(ok), DECAY ** (b - 2), np.float32))
    number, code, weight = np.concatenate(number), np.concatenate(code), np.concatenate(weight)
    norm = np.sqrt(np.bincount(number, weight * weight, minlength=len(words)))
    return number, code, weight, np.maximum(norm, 1.0)


def _pairs(h: np.ndarray, sentence: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the pairs of words ``gap`` places apart in one sentence."""
    at = np.flatnonzero(sentence[gap:] == sentence[:-gap])
    return at, mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + gap])


@dataclass
class Runs:
    """The machine of runs: a weight for each known pair of words."""

    codes: np.ndarray    # ascending
    weights: np.ndarray
    offset: float = 0.0
    slope: float = 1.0   # of the logistic curve
    shift: float = 0.0

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.codes >> np.uint64(44)] = True

    def known(self, h: np.ndarray, sentence: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, pair numbers) of the known pairs, for each gap."""
        out = []
        for gap in range(1, GAPS + 1):
            at, code = _pairs(h, sentence, gap)
            some = np.flatnonzero(self.maybe[code >> np.uint64(44)])
            at, code = at[some], code[some]
            place = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
            same = self.codes[place] == code
            out.append((at[same], place[same]))
        return out

    def values(self, known: list, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, values) of the runs that begin with a known pair."""
        starts = np.unique(np.concatenate([at for at, _ in known]))
        stop = np.minimum(starts + RUN, np.searchsorted(sentence, sentence[starts], "right"))
        total = np.full(len(starts), self.offset)
        for gap, (at, place) in enumerate(known, 1):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[place] * DECAY ** (gap - 1))])
            total += sums[np.searchsorted(at, np.maximum(stop - gap, starts))] - sums[np.searchsorted(at, starts)]
        return starts, total

    def highest(self, h: np.ndarray, sentence: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The highest run of each text; -inf without a known pair."""
        out = np.full(len(first) - 1, -np.inf)
        if len(h) > 1:
            starts, value = self.values(self.known(h, sentence), sentence)
            np.maximum.at(out, np.searchsorted(first, starts, "right") - 1, value)
        return out


@dataclass
class Model:
    weights: np.ndarray  # of each of 2**18 subsequences
    offset: float
    slope: float         # of the logistic curve
    shift: float
    runs: Runs | None = None

    def words(self, words: list[bytes]) -> np.ndarray:
        """The machine's value for each word."""
        if not words:
            return np.empty(0)
        number, code, weight, norm = _subsequences(words)
        return np.bincount(number, self.weights[code] * weight, minlength=len(words)) / norm + self.offset

    def texts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The higher of each text's highest word (an empty word without any) and highest run, both on their curves."""
        s, starts, ends, first, sentence = _words(data, off)
        out = np.full(len(off) - 1, self.offset)
        h = _hashes(s, starts, ends)
        if len(starts):
            _, one, place = np.unique(h, return_index=True, return_inverse=True)
            raw = s.tobytes()
            value = self.words([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])[place]
            has = np.flatnonzero(np.diff(first))
            out[has] = np.maximum.reduceat(value, first[has])
        out = self.slope * out + self.shift
        return out if self.runs is None else np.maximum(out, self.runs.slope * self.runs.highest(h, sentence, first) + self.runs.shift)

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last coefficient is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(20):
        margin = 1 - y * (x @ w)
        on = margin > 0
        c = 2 * cost * weight[on]
        grad = ridge * w - x[on].T @ (c * y[on] * margin[on])
        step = np.linalg.solve(np.diag(ridge) + (x[on].T * c) @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.column_stack([value, np.ones(len(value))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        w = w - np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 1e-2 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def _distinct_rows(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, counts) of the rows that differ in values or label, in the order they come in."""
    keys = np.array([int.from_bytes(blake2b(row.tobytes() + (b"+" if label > 0 else b"-"), digest_size=8).digest(), "little")
                     for row, label in zip(rows, y)], np.uint64)
    _, one, count = np.unique(keys, return_index=True, return_counts=True)
    order = np.argsort(one)
    return one[order], count[order]


def _fit_runs(h: np.ndarray, sentence: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray] | None:
    """The machine of runs, every document's highest run, and which documents it has not seen; none where runs do not tell those."""
    n = len(toxic)
    part = np.array([int(mix(h[first[d]:first[d + 1]].sum(dtype=np.uint64, keepdims=True))[0] % 3) for d in range(n)])

    def codes(d: int) -> np.ndarray:
        own, its = h[first[d]:first[d + 1]], sentence[first[d]:first[d + 1]]
        return np.unique(np.concatenate([_pairs(own, its, g)[1] for g in range(1, GAPS + 1)])) if len(own) > GAPS else np.empty(0, np.uint64)
    learn = [np.flatnonzero((part > 0) & (toxic == k)) for k in (0, 1)]
    if not len(learn[0]) or not len(learn[1]):
        return None
    code, in_toxic = np.unique(np.concatenate([codes(d) for d in learn[1]]), return_counts=True)
    code, in_toxic = code[in_toxic >= MIN_DOCS], in_toxic[in_toxic >= MIN_DOCS]
    if not len(code):
        return None
    in_clean = np.zeros(len(code), np.int64)
    for d in learn[0]:
        own = codes(d)
        at = np.minimum(np.searchsorted(code, own), len(code) - 1)
        in_clean[at[code[at] == own]] += 1
    value = np.log((in_toxic + 0.1) / (len(learn[1]) + 1)) - np.log((in_clean + 0.1) / (len(learn[0]) + 1))
    best = np.flatnonzero(value > np.log(3))
    best = np.sort(best[np.argsort(-(value * in_toxic)[best], kind="stable")[:MAX_PAIRS]])
    if not len(best):
        return None
    out = Runs(code[best], value[best])
    known = out.known(h, sentence)
    doc_of = lambda places: np.searchsorted(first, places, "right") - 1
    rng = np.random.default_rng(7)
    seen, y = np.empty((0, len(best)), np.float32), np.empty(0)
    for _ in range(ROUNDS):
        starts, total = out.values(known, sentence)
        doc = doc_of(starts)
        order = np.lexsort((-total, doc))
        one = order[np.append(True, doc[order][1:] != doc[order][:-1])]  # the highest run of each document
        one = one[part[doc[one]] > 0]
        stop = np.minimum(starts[one] + RUN, np.searchsorted(sentence, sentence[starts[one]], "right"))
        x = np.zeros((len(one), len(best)), np.float32)
        for gap, (at, place) in enumerate(known, 1):
            run = np.searchsorted(starts[one], at, "right") - 1
            ok = (run >= 0) & (at + gap < stop[run])
            np.add.at(x, (run[ok], place[ok]), DECAY ** (gap - 1))
        label = np.where(toxic[doc[one]] == 1, 1.0, -1.0)
        seen, y = np.vstack([seen[y < 0], x]), np.concatenate([y[y < 0], label])
        one, count = _distinct_rows(seen, y)
        seen, y = seen[one], y[one]
        if not (y > 0).any():
            return None
        if not (y < 0).any():
            seen, y, count = np.vstack([seen, np.zeros((1, len(best)), np.float32)]), np.append(y, -1.0), np.append(count, 1)
        marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:LANDMARKS // 2] for k in (1, -1)])
        spectrum, basis = np.linalg.eigh((seen[marks] @ seen[marks].T).astype(float))
        good = spectrum > 1e-6 * spectrum.max()
        whiten = basis[:, good] / np.sqrt(spectrum[good])
        share = np.where(y > 0, count / count[y > 0].sum(), count / count[y < 0].sum()) * len(y) / 2
        w = _svm((seen @ seen[marks].T) @ whiten, y, share)
        out = Runs(code[best], seen[marks].T @ (whiten @ w[:-1]), float(w[-1]))
    highest = out.highest(h, sentence, first)
    test = np.flatnonzero((part == 0) & np.isfinite(highest))
    if not len(test) or toxic[test].sum() < MIN_DOCS:
        return None
    out.slope, out.shift = _logistic(highest[test], toxic[test])
    return (out, highest, part == 0) if out.slope > 0 else None


def _calibrated(runs: Runs, highest: np.ndarray, unseen: np.ndarray, caught: np.ndarray, toxic: np.ndarray) -> Runs | None:
    """Judges runs by the unseen documents that words do not catch, a clean one rejected as SURE toxic ones caught.

    The curve stays as it is where it does good; else its even point goes half
    way down from the last of the documents that do most good to the next one.
    None where runs do no good.
    """
    rest = np.flatnonzero(unseen & ~caught & np.isfinite(highest))
    rest = rest[np.argsort(-highest[rest], kind="stable")]
    value = highest[rest]
    gain = np.cumsum(np.where(toxic[rest] == 1, 1, -SURE))
    ends = np.flatnonzero(np.append(value[1:] != value[:-1], True)) if len(rest) else np.empty(0, np.int64)
    if not len(ends) or gain[ends].max() < MIN_DOCS:
        return None
    above = int((runs.slope * value + runs.shift >= 0).sum())
    if above and gain[above - 1] >= MIN_DOCS:
        return runs
    last = int(ends[np.argmax(gain[ends])])
    point = (value[last] + value[last + 1]) / 2 if last + 1 < len(value) else value[last]
    runs.shift = -runs.slope * float(point)
    return runs


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The model of labelled texts (1: toxic)."""
    toxic = np.asarray(toxic, np.int64)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        share = min(max(float(toxic.mean()) if len(toxic) else 0.0, 1e-13), 1 - 1e-13)
        return Model(np.zeros(1 << 18, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.array(pc.sort_indices(pa.Table.from_arrays([texts, pa.array(toxic)], ["text", "toxic"]),
                                     sort_keys=[("text", "ascending"), ("toxic", "ascending")]))
    texts, toxic = texts.take(pa.array(order)), toxic[order]
    spelled: dict[int, bytes] = {}
    pair_doc, pair_hash = [], []
    every, told, bounds = [], [], [np.zeros(1, np.int64)]
    n_words = n_sentences = 0
    for lo, _, data, off in text_chunks(texts, CHUNK_BYTES):
        s, starts, ends, first, sentence = _words(data, off)
        raw, h = s.tobytes(), _hashes(s, starts, ends)
        every.append(h)
        told.append(sentence + n_sentences)
        bounds.append(first[1:] + n_words)
        n_words, n_sentences = n_words + len(h), int(told[-1][-1]) + 1 if len(h) else n_sentences
        own, one = np.unique(h, return_index=True)
        for k, at in zip(own.tolist(), one.tolist()):
            if k not in spelled:
                spelled[k] = raw[starts[at]:ends[at]]
        d = np.repeat(np.arange(lo, lo + len(off) - 1, dtype=np.int32), np.diff(first))
        by = np.lexsort((h, d))
        h, d = h[by], d[by]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.empty(0, bool)
        pair_doc.append(d[new])
        pair_hash.append(h[new])
    doc, h = np.concatenate(pair_doc), np.concatenate(pair_hash)
    names, word = np.unique(h, return_inverse=True)
    words = [spelled[k] for k in names.tolist()]
    if not words:
        return fit(pa.array([""]), np.array([0]))
    runs = _fit_runs(np.concatenate(every), np.concatenate(told), np.concatenate(bounds), toxic)
    label = toxic[doc]
    in_toxic = np.bincount(word[label == 1], minlength=len(words))
    in_clean = np.bincount(word[label == 0], minlength=len(words))
    value = np.log((in_toxic + 0.1) / (toxic.sum() + 1)) - np.log((in_clean + 0.1) / ((toxic == 0).sum() + 1))
    clean = np.flatnonzero(in_clean)
    rng = np.random.default_rng(7)
    negative = rng.permutation(clean)[:NEGATIVES]
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    shown = doc[begin]  # texts with a word
    size = np.diff(np.append(begin, len(doc)))
    model = None
    for _ in range(ROUNDS):
        best = np.maximum.reduceat(value[word], begin)
        is_best = value[word] == np.repeat(best, size)
        witness = word[is_best & (toxic[doc] == 1)]
        positive, count = np.unique(witness, return_counts=True)
        used = np.isin(positive, clean, invert=True) | (count > 3 * in_clean[positive])
        positive, count = positive[used], count[used]
        if not len(positive):
            break
        negative = np.setdiff1d(negative, positive)
        pick = np.argsort(-count, kind="stable")
        common = positive[pick[:LANDMARKS // 4]]
        rest = rng.permutation(positive[pick[LANDMARKS // 4:]])[:LANDMARKS // 4]
        marks = np.concatenate([common, rest, rng.permutation(negative)[:LANDMARKS // 2]])
        number, code, weight, norm = _subsequences([words[k] for k in marks])
        features, column = np.unique(code, return_inverse=True)
        table = np.zeros((len(features), len(marks)), np.float32)
        np.add.at(table, (column, number), weight / norm[number])

        def kernel(chosen: np.ndarray) -> np.ndarray:
            out = np.zeros((len(chosen), len(marks)), np.float32)
            for at in range(0, len(chosen), 250):
                part = chosen[at:at + 250]
                n, c, w, g = _subsequences([words[k] for k in part])
                f = np.minimum(np.searchsorted(features, c), len(features) - 1)
                known = features[f] == c
                np.add.at(out, at + n[known], table[f[known]] * (w[known] / g[n[known]])[:, None])
            return out

        spectrum, basis = np.linalg.eigh(kernel(marks).astype(float))
        good = spectrum > 1e-6 * spectrum.max()
        whiten = basis[:, good] / np.sqrt(spectrum[good])
        chosen = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        share = np.concatenate([count / count.sum(), np.full(len(negative), 1 / len(negative))]) * len(chosen) / 2
        w = _svm(kernel(chosen) @ whiten, y, share)
        flat = np.zeros(1 << 18, np.float32)
        flat[features] = table @ (whiten @ w[:-1])
        model = Model(flat, float(w[-1]), 1.0, 0.0)
        value = np.concatenate([model.words(words[k:k + 20000]) for k in range(0, len(words), 20000)])
        hard = clean[np.argsort(-value[clean], kind="stable")[:NEGATIVES // 3]]
        negative = np.union1d(negative, hard)
    if model is None:
        model = fit(pa.array([""]), np.array([0]))
        caught = np.zeros(len(toxic), bool)
    else:
        highest = np.full(len(toxic), model.offset)
        highest[shown] = np.maximum.reduceat(value[word], begin)
        model.slope, model.shift = _logistic(highest, toxic)
        caught = model.slope * highest + model.shift >= 0
    model.runs = _calibrated(*runs, caught, toxic) if runs else None
    return model


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a bounded sample in one task: at most 2 * MAX_FIT_DOCS texts of MAX_FIT_BYTES bytes."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.int32())])).combine_chunks()
    text, toxic = rows.column("text").combine_chunks(), rows.column("toxic").to_numpy()
    m = fit(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks), toxic)
    yield pa.RecordBatch.from_arrays(
        [pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([[m.offset, m.slope, m.shift]]),
         pa.array([m.runs.codes.tobytes() if m.runs else None], pa.binary()),
         pa.array([m.runs.weights.astype(float).tobytes() if m.runs else None], pa.binary()),
         pa.array([[m.runs.offset, m.runs.slope, m.runs.shift] if m.runs else None], pa.list_(pa.float64()))],
        ["weights", "rest", "codes", "pairs", "runs"])
    del rows, text, toxic, m
    release()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """Fits the model in one task on a bounded sample; the sample is the lowest hashes of each class."""
    docs = doc_columns(docs)
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    short = docs.filter((F.octet_length("text") > 0) & (F.octet_length("text") <= max_bytes))
    able = known.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [able.filter(F.col("toxic") == k).orderBy(*order).limit(max_docs) for k in (0, 1)]
    sample = short.join(F.broadcast(parts[0].union(parts[1])), "doc_id")  # at most 2 * max_docs rows
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    row = sample.repartition(1).mapInArrow(
        _fit_task, "weights binary, rest array<double>, codes binary, pairs binary, runs array<double>").first()
    if row is None:
        return fit(pa.array([], pa.string()), np.array([]))
    runs = Runs(np.frombuffer(row.codes, np.uint64), np.frombuffer(row.pairs), *row.runs) if row.runs else None
    return Model(np.frombuffer(row.weights, np.float32), *row.rest, runs)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB

    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        for lo, hi, data, off in text_chunks(batch.column(1), CHUNK_BYTES):
            score = shared.value.score(shared.value.texts(data, off))
            yield hi - lo, [batch.column(0).slice(lo, hi - lo), pa.array(score)]
    return map_docs(docs, run, "doc_id long, score double")


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    return _scored(doc_columns(docs), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    return _scored(doc_rows(docs), model).filter("score < 0.5").select("row.*")
