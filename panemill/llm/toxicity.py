"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two units by their common subsequences of three and four letters, which may skip letters: each skip
costs a factor ``DECAY``.  So "i-d-i.o.t" or "idxiot" stay close to "idiot".  Units of a sentence are its words, letters spelled out
one by one, neighbouring words run together (two to ``PARTS``, also across line ends, so an insult that blanks split is one unit again), and windows
within long runs of letters.  Units are stripped to letters and carry a mark of their start.

Words run together and windows are far more than words.  The sum of their subsequences of three letters comes from prefix sums over a text's letters, and
only those that reach the least sum of a telling word, whole or with a letter put in anywhere, of positive value (``Windows``) are scored in full: no such word lies below it.

Labels belong to documents, but a toxic document's sentences are mostly clean.  Training is therefore by witnesses: a
toxic document is represented by its highest-scoring unit, a clean one by a sample of its units (``NEGATIVES``) and the highest-scoring of all
(``HARDEST``), run-together ones too, and the machine is trained anew as witnesses and hardest negatives change.  A telling word is learnt together with what
hides it: other letters at every inner place, a letter doubled or left out.  Features are the Nyström coordinates of a unit's kernel values with
the landmarks.  Since the decision is linear in those values, and the kernel is an inner product over subsequences, the
trained machine folds into one weight for each subsequence: scoring costs the same for any number of landmarks.

A document's score is a logistic function of its highest unit, fitted on labelled documents set aside, of which toxic ones count a second time with a letter put into their
telling word.

Learning uses a bounded sample of labelled documents (``SAMPLE``), of each ``UNITS`` different words at most; scoring reads every whole text.

Cases: a null or empty text, or one without a unit of three letters, gets the score of no evidence; without both labels
every document gets the share of toxic labels; labels that are null or of unknown documents are ignored; repeated rows are scored
alike; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.llm.common import crc_mod

#: Labelled documents to learn from at most.
SAMPLE = 4000
#: Units that a labelled document is learnt by at most; random and hardest units of clean documents that a round learns from at most.
UNITS, NEGATIVES, HARDEST = 5000, 6000, 2000
#: Words that are run together at most; letters of such a unit, least and most; run-together units of a document that training looks at.
PARTS, JOINED, LOOKED_AT = 4, (4, 13), 20
#: Letters put in at each inner place of a telling word to learn from, and how many documents' weight a telling word's variants have together, as a multiple of its own.
PUT_IN, HIDDEN = 8, 1.0
LANDMARKS = 512
DECAY = 0.6
#: Letters skipped by a subsequence at most.
SKIPS = 2
WINDOW, STRIDE = 16, 4
ROUNDS = 4
#: What an ordinary unit counts as a multiple of its documents.
CLEAN = 40
#: Share of toxic documents from which a telling word is one that may be split or run together.
FREQUENT = 0.05
#: Log-likelihood ratio from which a unit counts as telling: far beyond what any of a million units reaches by chance.
SURPRISE = 14.0
REMEMBERED = 400_000
THRESHOLD = 0.7
#: Numbers of subsequences of three letters (exact) and of four (hashed).
_THREE, _FOUR = 1 << 18, 1 << 22
_NOT_LETTER = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[ \t]{1,3}[^\W\d_]){2,}(?!\S)")
NO_UNIT = -2.0
#: What begins a unit that is cut out of a word.
INSIDE = "\x01"


def units_of(text: str | None) -> set[str]:
    """Lower-case words, and runs of three and more letters that stand alone, joined."""
    low = (text or "").lower()
    found = set(low.split())
    found.update("".join(run.split()) for run in _SPELLED.findall(low))
    return found


def _windows(word: str) -> list[str]:
    """The letters of a unit behind a start mark, in windows; a unit that begins inside a word (``INSIDE``) has no mark."""
    letters = ("" if word[:1] == INSIDE else "^") + (word if word.isalpha() else _NOT_LETTER.sub("", word))
    if len(letters) <= WINDOW:
        return [letters]
    return [letters[at : at + WINDOW] for at in range(0, len(letters) - WINDOW + STRIDE, STRIDE)]


def _codes(strings: list[str]) -> np.ndarray:
    """Letters as numbers below 64, a row for each of strings of one length."""
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1)
    latin = (points >= 97) & (points <= 122)
    return np.where(latin, points - 96, np.where(points == ord("^"), 0, 27 + points % 37)).astype(np.uint32)


def _subsequences(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and weights of the subsequences of 3 and of 4 of a string, and as a whole of unit length."""
    found = []
    for n in (3, 4):
        at = [p for p in combinations(range(length), n) if p[-1] - p[0] - n + 1 <= SKIPS]
        weight = np.array([DECAY ** (p[-1] - p[0] - n + 1) for p in at])
        found.append((np.array(at, np.int64).reshape(-1, n), weight))
    norm = np.sqrt(sum((w**2).sum() for _, w in found)) or 1.0
    return [(at, w / norm) for at, w in found]


_plans: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of strings of one length: a row each."""
    length = len(strings[0])
    if length not in _plans:
        _plans[length] = _subsequences(length)
    codes, keys, weights = _codes(strings), [], []
    for k, (at, weight) in enumerate(_plans[length]):
        key = codes[:, at[:, 0]]
        for place in range(1, at.shape[1]):
            key = (key << np.uint32(6)) | codes[:, at[:, place]]
        keys.append(key if k == 0 else ((key * np.uint32(2654435761)) >> np.uint32(10)) + np.uint32(_THREE))
        weights.append(weight)
    return np.hstack(keys), np.concatenate(weights)


def unit_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Folded decision values of units; NO_UNIT for those of fewer than three letters."""
    out = np.full(len(words), NO_UNIT)
    sized: dict[int, tuple[list[int], list[str]]] = {}
    for k, word in enumerate(words):
        for part in _windows(word):
            if len(part) > 3:
                own = sized.setdefault(len(part), ([], []))
                own[0].append(k)
                own[1].append(part)
    for at, parts in sized.values():
        for k in range(0, len(parts), 1024):
            keys, weight = features(parts[k : k + 1024])
            np.maximum.at(out, at[k : k + 1024], weights[keys] @ weight.astype(np.float32))
    return out


class Landmarks:
    """Kernel features of a few units (their first window), for the subsequences that any of them has."""

    def __init__(self, words: list[str]):
        found = [features(_windows(word)[:1]) for word in words]
        self.used = np.unique(np.concatenate([keys[0] for keys, _ in found]))
        self.slot = np.full(_THREE + _FOUR, len(self.used), np.int32)  # the last row stays zero
        self.slot[self.used] = np.arange(len(self.used))
        self.table = np.zeros((len(self.used) + 1, len(words)), np.float32)
        for k, (keys, weight) in enumerate(found):
            np.add.at(self.table[:, k], self.slot[keys[0]], weight)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of units with the landmarks."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        sized: dict[int, list[int]] = {}
        first = [_windows(word)[0] for word in words]
        for k, part in enumerate(first):
            sized.setdefault(len(part), []).append(k)
        for at in sized.values():
            for k in range(0, len(at), 64):
                own = at[k : k + 64]
                keys, weight = features([first[i] for i in own])
                out[own] = np.einsum("bcl,c->bl", self.table[self.slot[keys]], weight.astype(np.float32))
        return out

    def coordinates(self, words: list[str], whiten: np.ndarray) -> np.ndarray:
        """Nyström coordinates of units, a block of kernel values at a time."""
        out = np.empty((len(words), whiten.shape[1]), np.float32)
        for at in range(0, len(words), 2048):
            out[at : at + 2048] = self.kernel(words[at : at + 2048]) @ whiten
        return out

    def gram(self) -> np.ndarray:
        """Kernel values of the landmarks with one another, a few subsequences at a time in double precision."""
        out = np.zeros((self.table.shape[1],) * 2)
        for at in range(0, len(self.table), 8192):
            own = self.table[at : at + 8192].astype(float)
            out += own.T @ own
        return out

    def folded(self, alphas: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, from one for each landmark; a few subsequences at a time in double precision."""
        out = np.zeros(_THREE + _FOUR, np.float32)
        for at in range(0, len(self.used), 8192):
            own = self.used[at : at + 8192]
            out[own] = self.table[at : at + len(own)] @ alphas
        return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the rows within the margin; the last is the offset."""
    width = x.shape[1] + 1
    w = np.zeros(width)
    penalty = np.eye(width) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        gram, target = penalty.copy(), np.zeros(width)
        for at in range(0, len(x), 2048):  # a few rows at a time, in double precision
            own, sign = np.hstack([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))]), y[at : at + 2048]
            inside = sign * (own @ w) < 1
            own, sign, weight = own[inside], sign[inside], cost[at : at + 2048][inside]
            gram += (own * weight[:, None]).T @ own
            target += own.T @ (weight * sign)
        new = np.linalg.solve(gram, target)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, a little ridge; the last is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def variants(word: str, rng: np.random.Generator, weights: np.ndarray | None = None) -> list[str]:
    """Units that hide a word: with a letter put in at each inner place, by chance and, once there are weights, those that score lowest; doubled, or left out."""
    letters = _windows(word)[0][1:]
    out = [letters[:at] + _LETTERS[k] + letters[at:] for at in range(1, len(letters)) for k in rng.permutation(26)[:PUT_IN]]
    out += [letters[:at] + letters[at - 1 :] for at in range(1, len(letters))]
    out += [INSIDE + letters] * PUT_IN
    if len(letters) > 4:
        at = int(rng.integers(1, len(letters)))
        out.append(letters[:at] + letters[at + 1 :])
    if weights is not None:
        every = hidden(word)
        out += [every[k] for k in np.argsort(unit_scores(every, weights), kind="stable")[: len(out)].tolist()]
    return out


def hidden(word: str) -> list[str]:
    """A word with every single letter at every inner place."""
    letters = _windows(word)[0][1:]
    return [letters[:at] + c + letters[at:] for at in range(1, len(letters)) for c in _LETTERS]


#: Letters of texts that are worked on together.
TOGETHER = 300_000
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """The number of each code point: 0 for what is no letter, 255 for white space."""
    global _kinds
    if _kinds is None:
        points = np.arange(0x110000)
        chars = list(map(chr, range(0x110000)))
        letter = np.fromiter((c.isalpha() for c in chars), bool, 0x110000)
        white = np.fromiter((c.isspace() for c in chars), bool, 0x110000)
        latin = (points >= 97) & (points <= 122)
        _kinds = np.where(white, 255, np.where(letter, np.where(latin, points - 96, 27 + points % 37), 0)).astype(np.uint8)
    return _kinds


class Windows:
    """Finds words run together, and windows within long runs of letters, whose subsequences of three letters have at least a given sum."""

    def __init__(self, weights: np.ndarray, least: float):
        self.three, self.least = np.ascontiguousarray(weights[:_THREE]), least
        self.norm = np.array([1.0 if n < 4 else _norm(n) for n in range(JOINED[1] + 2)])

    def _sums(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each window of letters the sum of its subsequences of three, with a mark at its start where it begins a word."""
        n, w = len(codes), self.three
        c = np.concatenate([codes, np.zeros(6, np.uint8)]).astype(np.int32)
        head, middle = c[:n] << 12, c << 6
        by = [head | middle[k : n + k] for k in (1, 2, 3)]
        spans = [w[by[0] | c[2 : n + 2]]]
        spans += [DECAY ** (k - 2) * sum(w[by[j] | c[k : n + k]] for j in range(k - 1)) for k in (3, 4)]
        total = np.zeros(len(starts))
        for span, own in zip((3, 4, 5), spans, strict=True):
            upto = np.concatenate([[0.0], np.cumsum(own, dtype=float)])
            total += upto[np.maximum(ends - span + 1, starts)] - upto[starts]
        # The mark is letter 0, and windows have four letters at least.
        first = np.flatnonzero(begins)
        pair = lambda i, j: w[middle[first + i] | c[first + j]]
        mark = np.zeros(n)
        mark[first] = pair(0, 1) + DECAY * (pair(0, 2) + pair(1, 2)) + DECAY**2 * (pair(0, 3) + pair(1, 3) + pair(2, 3))
        return (total + mark[starts]) / self.norm[ends - starts + begins[starts]]

    def of(self, text: str | None) -> list[str]:
        return self.of_many([text])[0]

    def of_many(self, texts: list[str | None]) -> list[list[str]]:
        """The found units of each text; small texts are worked on together."""
        out: list[list[str]] = [[] for _ in texts]
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > TOGETHER or k == len(texts) - 1:
                self._block(texts[at : k + 1], out, at)
                at, size = k + 1, 0
        return out

    def _block(self, texts: list[str | None], out: list[list[str]], offset: int) -> None:
        lows = [(text or "").lower() + "\n" for text in texts]
        points = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kind_table()[points]
        white = kind == 255
        at = np.flatnonzero((kind > 0) & ~white)
        if len(at) < JOINED[0]:
            return
        word = np.cumsum(white, dtype=np.int32)[at]
        begins = np.concatenate(([True], word[1:] != word[:-1]))
        first = np.flatnonzero(begins)
        bounds = np.concatenate([first, [len(at)]])
        text_of = np.searchsorted(np.cumsum(list(map(len, lows))), at[first], "right")
        least, most = JOINED
        starts, ends = [], []
        for parts in range(2, PARTS + 1):
            if len(first) >= parts:
                lo, hi = bounds[: len(first) - parts + 1], bounds[parts:]
                fits = (hi - lo >= least) & (hi - lo <= most) & (text_of[: len(lo)] == text_of[parts - 1 :])
                starts.append(lo[fits])
                ends.append(hi[fits])
        length = np.diff(bounds)
        stop = np.repeat(bounds[1:], length)
        inside = np.flatnonzero(np.repeat(length >= most, length))
        for size in range(least, most + 1):
            own = inside[inside + size <= stop[inside]]
            starts.append(own)
            ends.append(own + size)
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        found = np.flatnonzero(self._sums(kind[at], starts, ends, begins) >= self.least)
        letters = points[at].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        owner = text_of[np.searchsorted(first, starts[found], "right") - 1] + offset
        marks = np.where(begins[starts[found]], "", INSIDE).tolist()
        for k, lo, hi, mark in zip(owner.tolist(), starts[found].tolist(), ends[found].tolist(), marks, strict=True):
            out[k].append(mark + letters[lo:hi])


def _norm(length: int) -> float:
    """What the weights of a string's subsequences are divided by."""
    return float(np.sqrt(sum(DECAY ** (2 * (p[-1] - p[0] - n + 1)) for n in (3, 4) for p in combinations(range(length), n) if p[-1] - p[0] - n + 1 <= SKIPS))) or 1.0


def least_sum(weights: np.ndarray, offset: float, words: list[str]) -> float:
    """The least sum of subsequences of three letters of any of the words, whole or with a letter put in, that has a positive value; infinite without words."""
    found = np.inf
    only = np.concatenate([weights[:_THREE], np.zeros(_FOUR, np.float32)])
    for word in words:
        letters = _windows(word)[0][1:]
        if JOINED[0] <= len(letters) < JOINED[1]:
            shown = [letters, *hidden(word)]
            shown += [INSIDE + u for u in shown]
            telling = unit_scores(shown, weights) + offset > 0
            found = min(found, float(unit_scores(shown, only)[telling].min(initial=np.inf)))
    return found - 1e-5


def _long_enough(word: str) -> bool:
    return len(_windows(word)[0]) > 3


def train(bags: list[tuple[int, list[str]]], joined: Callable[[np.ndarray, float], list[list[str]]]) -> dict:
    """From (label, units) of documents, in a fixed order: the folded weights, the offset, the logistic weights, the least sum of windows.

    ``joined`` gives the documents' highest run-together units and windows, in the same order, once there are weights and a least sum.
    """
    bags = [(label, [u for u in units if _long_enough(u)]) for label, units in bags]
    share = sum(label for label, _ in bags) / len(bags) if bags else 0.0
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(bags)).tolist()  # whatever order the ids bring
    learnt, aside = [j for k, j in enumerate(order) if k % 4], order[::4]
    fit = [bags[j] for j in learnt]
    if any(len({bags[j][0] for j in part}) < 2 for part in (learnt, aside)):
        return {"share": share}
    seen = {label: Counter() for label in (0, 1)}
    for label, units in fit:
        seen[label].update(set(units))
    bad = max(1, sum(label for label, _ in fit))
    good = len(fit) - bad
    words = sorted(seen[0].keys() | seen[1].keys())
    p, n = (np.array([seen[label][w] for w in words], float) for label in (1, 0))
    del seen
    number = {word: k for k, word in enumerate(words)}
    own = [np.array([number[u] for u in units], np.int64) for label, units in fit if label and units]
    del number, fit
    odds = np.log((p + 0.1) / (bad + 0.2)) - np.log((n + 0.1) / (good + 0.2))
    strength = np.where(odds > 0, odds * np.sqrt(p), odds)
    rng = np.random.Generator(np.random.PCG64(5))
    by = np.argsort(-strength, kind="stable")[: LANDMARKS // 2]
    usual = np.argsort(-n, kind="stable")[: LANDMARKS // 4]
    rest = rng.permutation(len(words))[: LANDMARKS // 4]
    chosen = [words[k] for k in dict.fromkeys([*by.tolist(), *usual.tolist(), *rest.tolist()])]
    landmarks = Landmarks(chosen)
    values, vectors = np.linalg.eigh(landmarks.gram())
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))

    score, folded, offset = strength, None, 0.0
    negatives = set(np.flatnonzero(n > 0)[rng.permutation(int((n > 0).sum()))[:NEGATIVES]].tolist())
    both = p + n
    surprise = p * np.log(np.maximum(p, 1) * (bad + good) / (both * bad)) + n * np.log(np.maximum(n, 1) * (bad + good) / (both * good))
    telling = (odds > 1.5) & (surprise > SURPRISE)
    # A telling word of its letters only: with marks it is the same unit, and a word that only holds another one is none.
    names = [words[k] for k in np.flatnonzero(telling & (p >= FREQUENT * bad)).tolist()]
    runs: list[list[str]] = [[] for _ in bags]
    joints: list[str] = []
    for k in range(ROUNDS):
        # The witnesses of a toxic document: its telling units, or else the highest-scoring one.
        witness = Counter(chain.from_iterable(units[telling[units]].tolist() or [int(units[np.argmax(score[units])])] for units in own))
        witness = {k: c for k, c in witness.items() if p[k] * good > n[k] * bad}
        negatives.update(np.argsort(-np.where((n > 0) & (odds < 0), score, -np.inf), kind="stable")[:HARDEST].tolist())
        blurred = [(v, min(c, 100) * HIDDEN / len(own)) for k, c in sorted(witness.items()) if telling[k] for own in (variants(words[k], rng, folded),) for v in own]
        if k:
            runs = joined(folded, least_sum(folded, offset, names))
            usual_runs = Counter(u for j in learnt if not bags[j][0] for u in runs[j])
            found = sorted(usual_runs)
            hardest = np.argsort(-unit_scores(found, folded), kind="stable")[:HARDEST].tolist() if found else []
            joints = sorted({found[k] for k in hardest} | set(joints))
        rows = sorted(set(witness) | negatives)
        x = landmarks.coordinates([words[k] for k in rows] + [v for v, _ in blurred] + joints, whiten.astype(np.float32))
        y = np.array([1.0 if k in witness else -1.0 for k in rows] + [1.0] * len(blurred) + [-1.0] * len(joints))
        cost = np.array([float(witness[k]) if k in witness else CLEAN * min(n[k], 25) for k in rows] + [c for _, c in blurred] + [CLEAN * min(max(1, usual_runs[u]), 25) for u in joints])
        w = _machine(x, y, np.sqrt(cost), ridge=0.02)
        del x
        folded, offset = landmarks.folded(whiten @ w[:-1]), float(w[-1])
        score = np.maximum(unit_scores(words, folded) + offset, NO_UNIT)
    least = least_sum(folded, offset, names)
    runs = joined(folded, least)
    value = lambda units: unit_scores(units, folded) + offset if units else np.zeros(0)
    tops, labels = [], []
    told = set(words[k] for k in np.flatnonzero(telling).tolist())
    for j in aside:
        tops.append([top(value([*bags[j][1], *runs[j]]))])
        labels.append(float(bags[j][0]))
        if bags[j][0] and (shown := sorted(told & set(bags[j][1]))):
            disguised = [v for u in shown for v in variants(u, rng)]
            tops.append([top(np.array([value([disguised[int(rng.integers(len(disguised)))]])[0]]))])
            labels.append(1.0)
    return {"share": share, "weights": folded, "offset": offset, "logistic": _logistic(np.array(tops), np.array(labels)), "least": least}


def top(scores: np.ndarray) -> float:
    """The highest unit's decision value, bounded: beyond the margin it says no more."""
    return float(np.clip(scores.max(), NO_UNIT, 1.0)) if len(scores) else NO_UNIT


def learnt_from(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> dict:
    """The model from sampled labelled rows, ``SAMPLE`` at most; the sample is the same in each run."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & (crc_mod(F.col(id_col), 3) != 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", F.xxhash64("id", "text").alias("key"), "text")

    def some(units: set[str]) -> list[str]:
        return sorted(sorted(units, key=lambda u: zlib.crc32(u.encode()))[:UNITS]) if len(units) > UNITS else sorted(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [some(units_of(text)) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(units, pa.list_(pa.string()))], names=["id", "label", "key", "units"])

    kind = docs.schema[id_col].dataType.simpleString()
    bags = sample.mapInArrow(run, f"id {kind}, label int, key long, units array<string>")
    # An id may stand for many rows: the bound counts rows.
    found = bags.orderBy(F.xxhash64("id", "key"), "id", "label", "key").limit(SAMPLE).toArrow()
    found = found.take(pc.sort_indices(found, [("id", "ascending"), ("label", "ascending"), ("key", "ascending")]))
    keys, shared = found.column("key").to_pylist(), {}  # one copy of each unit
    rows = [(label.as_py(), [shared.setdefault(u, u) for u in units.as_py()]) for label, units in zip(found.column("label"), found.column("units"), strict=True)]
    del found, shared

    def joined(weights: np.ndarray, least: float) -> list[list[str]]:
        model = docs.sparkSession.sparkContext.broadcast((weights, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Windows(*model.value)
            for batch in batches:
                units = []
                for found in finder.of_many(batch.column(1).to_pylist()):
                    found = sorted(set(found))
                    best = np.argsort(-unit_scores(found, model.value[0]), kind="stable")[:LOOKED_AT].tolist() if found else []
                    units.append([found[k] for k in best])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.string()))], names=["key", "units"])

        found = sample.select("key", "text").where(F.col("key").isin(keys)).mapInArrow(run, "key long, units array<string>").dropDuplicates(["key"]).collect()
        model.destroy()
        by = {r["key"]: r["units"] for r in found}
        return [by.get(key, []) for key in keys]

    return train(rows, joined)


class Scorer:
    """Scores the texts of one task; remembers the units it has met."""

    def __init__(self, model: dict):
        self.model, self.memo = model, {}
        self.windows = Windows(model["weights"], model["least"]) if "weights" in model else None

    def _values(self, units: list[str]) -> list[float]:
        return np.maximum(unit_scores(units, self.model["weights"]) + self.model["offset"], NO_UNIT).tolist()

    def scores(self, texts: pa.Array) -> np.ndarray:
        model, out = self.model, []
        if "weights" not in model:
            return np.full(len(texts), model["share"])
        for at in range(0, len(texts), 500):
            own = [value.as_py() for value in texts.slice(at, 500)]
            units = list(map(units_of, own))
            if len(self.memo) > REMEMBERED:
                self.memo = {}
            if new := list(set().union(*units).difference(self.memo)):
                self.memo.update(zip(new, self._values(new), strict=True))
            tops = [top(np.fromiter(map(self.memo.__getitem__, own), float, len(own))) for own in units]
            # Run-together units hardly ever come again: they aren't remembered.
            runs = self.windows.of_many(own)
            every = list(set().union(*runs))
            value = dict(zip(every, self._values(every), strict=True))
            tops = np.array([max(t, top(np.array([value[u] for u in own]))) for t, own in zip(tops, runs, strict=True)])
            out.append(1 / (1 + np.exp(-np.clip(tops * model["logistic"][0] + model["logistic"][1], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 from 0.7 on)."""
    model = docs.sparkSession.sparkContext.broadcast(learnt_from(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1)), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double")
    held_out = F.coalesce(crc_mod(F.col("id"), 3) == 1, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents that are not predicted toxic, all columns, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(learnt_from(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(text_col)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
