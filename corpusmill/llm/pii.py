"""Personal data: pattern matches, and spans that a linear-chain CRF labels.

The CRF works on the words of a line. A word's features are two shapes (letters
collapsed with digits kept, and all runs collapsed) and the shapes of its
neighbours. It is trained here, by maximum likelihood, on a small labelled
table that `labelled_lines` makes by rule; the weights are broadcast (one row per
shape of that table). Tasks decode all lines of a batch together with Viterbi in numpy.
A labelled run may hold several entities side by side: it is split into the pieces that
have the parts of its kind (an exact check) and touch no pattern match, so that as
much of the run as possible is covered.

Defined results: a null text counts as empty and has no spans; texts are scanned whole;
repeated rows give equal results; positions are code points, end exclusive. Other
columns stay when named in `carry`; result columns replace those of their name.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill.llm.common import chunks, span_hashes, text_buffer, word_spans

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
TRAINING_LINES = 600
LISTS = 0.5  # as many lines again, for each line, that hold entities of one kind side by side
PHONE_FORMS = ("+9 (999) 999-9999", "+99 99 9999999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+99-999-999-999")
PHONE_WORDS = ("+9 999 999 9999", "999 999 9999")
EPOCHS = 60

# The base patterns. Possessive runs and the look-behind keep the leftmost matches and take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, not sorted."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # an address needs its sign, so look from there to both sides
        start = at
        while start > end and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) < 4 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


# -- shapes -------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per word: letter runs collapsed, and all runs collapsed."""
    kind = _CLASS[raw]
    new = np.ones(len(raw), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    out = []
    for kept in (new | (kind == ord("9")), new):
        place = np.concatenate([[0], np.cumsum(kept)])
        out.append(span_hashes(kind[kept], place[starts], place[ends]))
    return out[0], out[1]


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of a word's features, a column each; a neighbour in another line is none."""
    fine, coarse = shapes(raw, starts, ends)
    before, after = np.zeros_like(coarse), np.zeros_like(coarse)
    if len(line):
        same = line[1:] == line[:-1]
        before[1:][same], after[:-1][same] = coarse[:-1][same], coarse[1:][same]
    return np.stack([h + np.uint64(i) for i, h in enumerate((fine, coarse, before, after))], axis=1)


# -- the model ----------------------------------------------------------------


@dataclass(frozen=True)
class Crf:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # one more row than keys: zeros for features not seen
    moves: np.ndarray  # [from, to]

    def emissions(self, feature: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, feature.ravel())
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != feature.ravel()] = len(self.keys)
        return self.weights[at].reshape(*feature.shape, -1).sum(axis=1)


def _number(rng: random.Random, form: str) -> str:
    return "".join(rng.choice("0123456789") if c == "9" else c for c in form)


def _card(rng: random.Random) -> str:
    digits = "4" + _number(rng, "99999999999999")
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def labelled_lines(n: int = TRAINING_LINES, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The labelled table: lines of invented words with personal data and with other numbers in between, then lists."""
    rng = random.Random(seed)
    parts = ("ba", "con", "die", "fu", "ge", "hol", "min", "per", "rat", "sul", "tor", "vi", "é", "ñ")
    host = lambda: f"{word()}{rng.choice(['', '1', '27'])}.{rng.choice(['com', 'org', 'example.com', 'co.uk'])}"

    def word() -> str:
        return "".join(rng.choices(parts, k=rng.randint(1, 4)))

    def name() -> str:
        return word() + rng.choice(["", ".", "_"]) + rng.choice([word(), _number(rng, "99"), ""])

    def plain() -> str:
        w = word()
        w = rng.choice([w, w, w, w.capitalize(), w.upper()])
        return w + rng.choice([""] * 8 + [",", ".", ";", ":", "?", "!", "***", "&&&", "$$$", ")"])

    def other() -> list[str]:
        form = rng.choice(
            ["9", "99", "999", "9.", "9.9.", "9.99", "99:99", "9999", "9999-99-99", "99/99/9999", "9,999,999", "9.9.9", "$99.99"]
            + ["99%", "(99)", "[9]", "v9.9.9", "9999999", "99-99", "9999999999999999999999", "9-99-999999-9", "#99", "99th", "p9"]
        )
        if rng.random() < 0.2:
            return [rng.choice(["password=", "key:", '"', "id="]) + "".join(rng.choices("0123456789abcdef", k=18))]
        return [_number(rng, form) + rng.choice(["", "", ",", "."])]

    def personal(kind: int, phones: tuple[str, ...] = PHONE_FORMS, ends: tuple[str, ...] = ("", "", "", ",", ".", ")")) -> tuple[list[str], int]:
        if kind == 1:
            text = rng.choice([f"{name()}@{host()}", f"{name()} (at) {host()}", f"{name()}[at]{host()}", f"{name()} [at] {host()}"])
        elif kind == 2:
            text = ".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", "", ":8080", "/24"])
        elif kind == 3:
            c = _card(rng)
            sign = rng.choice(["", "", " ", "-", "."])
            text = sign.join(c[i : i + 4] for i in range(0, 16, 4))
        else:
            text = _number(rng, rng.choice(phones))
        words = text.split(" ")
        words[-1] += rng.choice(ends)
        return words, kind

    lines = []
    for _ in range(n):
        words: list[str] = []
        labels: list[int] = []
        for _ in range(rng.randint(2, 6)):
            draw = rng.random()
            new, label = ([plain() for _ in range(rng.randint(1, 4))], 0) if draw < 0.6 else (other(), 0) if draw < 0.8 else personal(rng.randint(1, 4))
            words += new
            labels += [label] * len(new)
        lines.append((words, labels))
    for _ in range(int(LISTS * n)):
        words = [plain() for _ in range(rng.randint(0, 3))]
        labels = [0] * len(words)
        kind, phones = rng.randint(1, 4), rng.choice([(form,) for form in (*PHONE_FORMS, *PHONE_WORDS)] + [PHONE_FORMS + PHONE_WORDS] * 2)
        ends = rng.choice([("",), (",",), (";",)])
        for _ in range(rng.randint(1, 4)):
            new, label = personal(kind, phones, ends)
            words += new
            labels += [label] * len(new)
        last = [plain() for _ in range(rng.randint(0, 2))]
        lines.append((words + last, labels + [0] * len(last)))
    return lines


def train(lines: list[tuple[list[str], list[int]]] | None = None, epochs: int = EPOCHS, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with an L2 penalty, by full gradients and Adam steps."""
    lines = labelled_lines() if lines is None else lines
    texts = pa.array([" ".join(words) for words, _ in lines])
    raw, offsets = text_buffer(texts)
    starts, ends, line = word_spans(raw, offsets)
    feature = features(raw, starts, ends, line)
    keys, inverse = np.unique(feature.ravel(), return_inverse=True)
    inverse = inverse.reshape(feature.shape)
    truth = np.concatenate([labels for _, labels in lines])
    n, wide, k = len(lines), max(len(labels) for _, labels in lines), len(LABELS)
    length = np.bincount(line, minlength=n)
    column = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length)
    inside = np.zeros((n, wide), bool)
    inside[line, column] = True
    gold_moves = np.zeros((k, k))
    joined = line[1:] == line[:-1]
    np.add.at(gold_moves, (truth[:-1][joined], truth[1:][joined]), 1)
    theta = [np.zeros((len(keys), k)), np.zeros((k, k))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, epochs + 1):
        scores = np.zeros((n, wide, k))
        scores[line, column] = theta[0][inverse].sum(axis=1)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, wide):
            x = np.logaddexp.reduce(forward[:, t - 1, :, None] + theta[1], axis=1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t, None], x, forward[:, t - 1])
        for t in range(wide - 2, -1, -1):
            x = np.logaddexp.reduce(theta[1] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(inside[:, t + 1, None], x, 0.0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        share = np.exp(forward + backward - z[:, None, None])[line, column]
        share[np.arange(len(truth)), truth] -= 1
        gradient = np.zeros_like(theta[0])
        for f in range(feature.shape[1]):
            np.add.at(gradient, inverse[:, f], share)
        expected = np.zeros((k, k))
        for t in range(1, wide):
            pair = forward[:, t - 1, :, None] + theta[1] + (scores[:, t] + backward[:, t])[:, None, :] - z[:, None, None]
            expected += np.exp(pair[inside[:, t]]).sum(axis=0)
        for i, g in enumerate((gradient / n + decay * theta[0], (expected - gold_moves) / n + decay * theta[1])):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] -= 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    weights = np.vstack([theta[0], np.zeros((1, k))]).astype(np.float32)
    return Crf(keys, weights, theta[1].astype(np.float32))


def viterbi(scores: np.ndarray, moves: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Best label of each word; words of a line stand together, and lines run in parallel by position."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int8)
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    length = np.diff(np.append(begin, n))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # lines longer than each position
    back = np.zeros((n, k), dtype=np.int8)
    best = scores[begin].copy()
    final = np.zeros((len(begin), k), dtype=scores.dtype)
    for t in range(length[0]):
        a = active[t]
        if t:
            step = best[:a, :, None] + moves
            came = step.argmax(axis=1)
            best = np.take_along_axis(step, came[:, None, :], axis=1)[:, 0] + scores[begin[:a] + t]
            back[begin[:a] + t] = came
        final[:a] = best[:a]
    out = np.zeros(n, dtype=np.int8)
    label = final.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        a = active[t]
        out[begin[:a] + t] = label[:a]
        label[:a] = back[begin[:a] + t, label[:a]]
    return out


_TRIM = " \t\r\n,.;:!?()[]{}<>\"'"
_UNIT = re.compile(r"[^\s,;|/]+")
_DIGITS = frozenset("0123456789")


def _holds(kind: int, piece: str) -> bool:
    """Whether a labelled run has the parts of its kind."""
    digits = re.sub("[^0-9]", "", piece)
    if kind == 1:
        return re.fullmatch(r"[\w.%+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\.[\w-]+)+", piece) is not None
    if kind == 2:
        return bool(_IP.match(piece)) and all(int(x[-4:]) <= 255 for x in re.findall("[0-9]+", piece)[:4])
    if kind == 3:
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 .-]+", piece) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9 ().-]+", piece) is not None and not piece.isdigit()


def crf_spans(model: Crf, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, start byte in the row, end byte, label) of each labelled run of words in a line."""
    raw, offsets = text_buffer(texts)
    starts, ends, row = word_spans(raw, offsets)
    if not len(starts):
        return []
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    line = newline[starts] + row  # grows from line to line and from row to row
    feature = features(raw, starts, ends, line)
    label = viterbi(model.emissions(feature), model.moves, line)
    some = np.flatnonzero(label)
    runs = []
    for i in some.tolist():
        if runs and runs[-1][1] == i - 1 and label[i] == label[i - 1] and line[i] == line[i - 1]:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(int(row[a]), int(starts[a] - offsets[row[a]]), int(ends[b] - offsets[row[a]]), int(label[a])) for a, b in runs]


def _pieces(kind: int, run: str, touched: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """(start, end) of the entities that stand in a labelled run, so that they cover as much of it as possible.

    Words are also cut at signs that stand in no entity. A number has at most 19 digits, an address at most
    three words, so no word is tried with more than a few after it.
    """
    left, right = (_TRIM.replace("(", ""), _TRIM.replace("(", "").replace(")", "")) if kind == 4 else (_TRIM, _TRIM)

    def entity(a: int, b: int) -> tuple[int, int] | None:
        piece = run[a:b].rstrip(right)
        b = a + len(piece)
        piece = piece.lstrip(left)
        a = b - len(piece)
        return (a, b) if _holds(kind, piece) and not touched(a, b) else None

    one = entity(0, len(run))
    if one:
        return [one]
    units = [m.span() for m in _UNIT.finditer(run)]
    if kind > 1:  # only words with digits count; a sign before them belongs to them
        marks = [run[a:b] in ("+", "(") for a, b in units]
        units = [
            (units[i - 1][0] if i and marks[i - 1] else a, b) for i, (a, b) in enumerate(units) if any(c in _DIGITS for c in run[a:b])
        ]
    size = [sum(c in _DIGITS for c in run[a:b]) for a, b in units] if kind > 1 else [1] * len(units)
    most = (0, 3, 19, 19, 15)[kind]
    best: list[tuple[int, int, tuple[int, int] | None, int]] = [(0, 0, None, 0)] * (len(units) + 1)
    for i in range(len(units) - 1, -1, -1):  # (covered, fewest pieces, first piece, next unit) from each unit on
        best[i] = (*best[i + 1][:2], None, i + 1)
        total = 0
        for j in range(i, len(units)):
            total += size[j]
            if total > most:
                break
            found = entity(units[i][0], units[j][1])
            if found:
                option = (best[j + 1][0] + found[1] - found[0], best[j + 1][1] - 1, found, j + 1)
                if option[:2] > best[i][:2]:
                    best[i] = option
    out, i = [], 0
    while i < len(units):
        if best[i][2]:
            out.append(best[i][2])
        i = best[i][3]
    return out


def _spans(model: Crf, texts: pa.Array) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per row: base spans, and base with added ones, in order."""
    strings = [t or "" for t in texts.to_pylist()]
    base = [sorted(base_spans(t)) for t in strings]
    found = [list(b) for b in base]
    now, data, at, place = -1, b"", 0, 0
    begins: list[int] = []
    reach: list[int] = []

    def touched(s: int, e: int) -> bool:
        i = bisect_left(begins, e)
        return i > 0 and reach[i - 1] > s

    for row, a, b, label in crf_spans(model, texts):  # row by row, and in order
        if row != now:
            now, data, at, place = row, strings[row].encode(), 0, 0
            begins = [s for s, _, _ in base[row]]
            reach = list(accumulate((e for _, _, e in base[row]), max))
        place += len(data[at:a].decode())
        run, start, at = data[a:b].decode(), place, a
        for s, e in _pieces(label, run, lambda s, e, start=start: touched(start + s, start + e)):
            found[row].append((start + s, label - 1, start + e))
    return [(b, sorted(f)) for b, f in zip(base, found)]


def find(df: DataFrame, model: Crf, text: str = "text", carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns `carry`, with `base` and `found`: spans as arrays of kind:start:end."""
    carry = [c for c in carry if c.lower() not in ("base", "found")]
    kind = T.ArrayType(T.StringType(), False)
    schema = T.StructType([df.schema[c] for c in carry] + [T.StructField(c, kind, False) for c in ("base", "found")])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, 4 << 20):
            both = _spans(shared.value, batch.column(text))
            named = [[[f"{KINDS[k]}:{s}:{e}" for s, k, e in spans] for spans in side] for side in zip(*both)] or [[], []]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), *(pa.array(x, pa.list_(pa.string())) for x in named)],
                names=[*carry, "base", "found"],
            )

    return df.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def redact(df: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """`df` with each span of `text` replaced by its kind in brackets; the other columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def clean(value: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return value
        parts, at = [], 0
        for s, k, e in spans:
            if s >= at:
                parts += [value[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*parts, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, 4 << 20):
            found = [f for _, f in _spans(shared.value, batch.column(text))]
            new = [clean(t, f) for t, f in zip(batch.column(text).to_pylist(), found)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return df.mapInArrow(run, df.schema)


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")
