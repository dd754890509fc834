"""Secrets: pattern matches, and runs of high entropy found with a sliding window.

A candidate is a maximal run of token characters. For each character class (hex,
letters of one case with digits, and letters with digits in base-64 style) a window
slides over the candidate's characters; its Shannon entropy comes from the counts in
the window, which change by one character in and one out per step. Neighbouring
windows above the class's threshold join into a span of kind `hexent`, `lowent`,
`upent` or `b64ent`. Spans of known harmless form are suppressed, and so are spans
inside a pattern match. The form is that of the span, not of the candidate around it.

Defined results: a null text counts as empty and gives no spans; texts are scanned
whole; repeated rows give equal results; positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill.llm.common import chunks

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run is as long as it gets, so the bound may stand here
KINDS = ("assign", "access", "hex", "hexent", "b64ent", "lowent", "upent")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class -> characters, window, least entropy in bits. A random window of the class passes clearly.
CLASSES = {
    "hexent": (frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    "lowent": (frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.4),
    "upent": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.3),
    "b64ent": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.9),
}
#: Forms that are no secrets: letters of one case, words joined by signs, UUIDs, repeated signs, placeholders.
#: They are those of a span, with the rest of the parts between signs in which it begins and ends.
ALLOWED = re.compile(
    r"""(?x) [0-9+/_=-]+ | [a-z+/_=-]+ | [A-Z+/_=-]+ | [a-z]?(?>[A-Z]*+[a-z]{2,}+[+/_=-]?)++[A-Z]* | (?>[A-Z]?[a-z]{2,}+[0-9]{0,4}+[+/_=-]?)++
    | [0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12} | .*(?:EXAMPLE|example|PLACEHOLDER|placeholder|xxxx|XXXX).*"""
)
#: In one case, random keys look like many short words with numbers, so one or two words are allowed.
ALLOWED_ONE_CASE = re.compile(
    r"[0-9]{0,4}(?:(?:[a-z]{3,}[0-9]{0,4}){1,2}|(?:[A-Z]{3,}[0-9]{0,4}){1,2})|.*(?:EXAMPLE|example|PLACEHOLDER|placeholder|xxxx|XXXX).*"
)
#: Plain words with a placeholder between signs say nothing of the parts beside them.
_ASIDE = re.compile(r"(?<![^+/_=-])(?=[a-zA-Z]*(?:EXAMPLE|[Ee]xample|PLACEHOLDER|[Pp]laceholder|xxxx|XXXX))(?:[A-Z]?[a-z]+|[A-Z]+)(?![^+/_=-])")
_SIGNS = frozenset("+/_=-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, not sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def entropy_spans(candidate: str, alphabet: frozenset[str], width: int, least: float) -> list[tuple[int, int]]:
    """Joined windows whose entropy is at least `least`; windows hold characters of the class only."""
    share = [c * log2(c) if c else 0.0 for c in range(width + 1)]
    out: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, begin = 0.0, 0  # sum of c log c over the window, and the window's first place
    for i, new in enumerate(candidate):
        if new not in alphabet:
            counts, total, begin = {}, 0.0, i + 1
            continue
        c = counts.get(new, 0)
        if i - begin == width:
            old = candidate[begin]
            o = counts[old]
            total += share[o - 1] - share[o]
            counts[old] = o - 1
            begin += 1
            c = counts.get(new, 0)
        total += share[c + 1] - share[c]
        counts[new] = c + 1
        if i - begin == width - 1 and log2(width) - total / width >= least - 1e-9:
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((begin, i + 1))
    return out


def _both(piece: str, one: str, other: str) -> bool:
    return any(map(getattr(str, one), piece)) and any(map(getattr(str, other), piece))


def _mixed(piece: str) -> bool:
    """Letters with digits, or letters of both cases."""
    return _both(piece, "isdigit", "isalpha") or _both(piece, "isupper", "islower")


def _in_order(piece: str) -> bool:
    """Whether most characters follow the one before, as in an alphabet."""
    return 2 * sum(ord(y) - ord(x) == 1 for x, y in zip(piece, piece[1:])) > len(piece)


def _harmless(kind: str, whole: str, a: int, b: int) -> bool:
    piece = whole[a:b]
    if kind == "b64ent":
        if piece.lower() == piece or piece.upper() == piece:
            return True  # one case: the other classes have it
    elif not _both(piece, "isdigit", "isalpha"):
        return True
    while a > 0 and whole[a - 1] not in _SIGNS:
        a -= 1
    while b < len(whole) and whole[b] not in _SIGNS:
        b += 1
    form = ALLOWED_ONE_CASE if kind in ("lowent", "upent") else ALLOWED
    return not _mixed(piece) or _in_order(piece) or form.fullmatch(whole[a:b]) is not None or form.fullmatch(piece) is not None


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """Candidates, cut at words that are placeholders."""
    for found in CANDIDATE.finditer(text):
        whole, at = found.group(), 0
        for aside in _ASIDE.finditer(whole):
            yield found.start() + at, whole[at : aside.start()]
            at = aside.end()
        yield found.start() + at, whole[at:]


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Entropy spans outside the base ones that no allowed form explains."""
    out = []
    for at, whole in _parts(text):
        if not _mixed(whole):
            continue
        taken = [(s, e) for s, _, e in base if s < at + len(whole) and e > at]
        for kind, rule in CLASSES.items():
            for a, b in entropy_spans(whole, *rule):
                s, e = a + at, b + at
                if not any(x < e and y > s for x, y in taken) and not _harmless(kind, whole, a, b):
                    out.append((s, KINDS.index(kind), e))
                    taken.append((s, e))
    return out


def spans_of(text: str | None) -> tuple[list[str], list[str]]:
    """Base spans and all spans, each as kind:start:end in order."""
    base = base_spans(text or "")
    added = added_spans(text or "", base)
    name = lambda spans: [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)]
    return name(base), name(base + added)


def find(df: DataFrame, text: str = "text", carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns `carry`, with `base` and `found`, which replace carried columns of these names: spans as arrays of kind:start:end."""
    carry = [c for c in carry if c.lower() not in ("base", "found")]
    schema = T.StructType(
        [df.schema[c] for c in carry]
        + [T.StructField(c, T.ArrayType(T.StringType(), False), False) for c in ("base", "found")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            both = [spans_of(t) for t in batch.column(text).to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array([b for b, _ in both], kind), pa.array([f for _, f in both], kind)],
                names=[*carry, "base", "found"],
            )

    return df.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")
