"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

For each character class, candidates are its maximal runs of at least the
class's window. A window slides over a candidate; the sum of c*log2(c) over its
character counts changes by one entering and one leaving character, so each
step costs the same whatever the window. A candidate is a secret when some
window reaches the class's entropy and the allow list doesn't suppress it. A
placeholder's name in it suppresses only itself: the parts beside it are judged.

Defined results: a null or empty text has no spans. Spans are code points, end
exclusive. An entropy span is left out if no window that reaches the entropy
extends beyond earlier spans; otherwise it stays whole, so spans may overlap.
Repeated rows, and rows with a null or repeated id, are scanned each by itself.
Time is in proportion to a text's length, whatever is in it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts, pieces

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: kind, characters, window, bits a character that some window must reach
CLASSES = (("entropy_hex", re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0), ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.6))

#: Candidates that match one of these are never secrets.
ALLOW = (
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*"),  # numbers and dates
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[A-Za-z0-9]{0,6}(?:[-_=+/][A-Za-z0-9]{0,6})+"),  # rules and short parts between separators
)
PLACEHOLDER = re.compile(r"(?i:example|placeholder|x{4,}|changeme)")

#: Words, also joined ones and paths of words; judged by pairs of letters too, as random letters look the same.
LETTERS = re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*=*")
#: Pairs of letters that are common in words; random letters have about a quarter of their pairs here.
PAIRS = frozenset(
    "th he in er re an on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op sa ay ke fr av ag ap gr bo sp do uc ei ov ep da cu sc gi ga qu ue ff va um up lu ru eg ck br ki ei au zu mm nn ub in".split()
)
PAIR_WINDOW, PAIR_LEAST = 19, 9


def wordlike(s: str) -> bool:
    """Whether a run of letters reads as words: of the pairs in every window at least PAIR_LEAST of PAIR_WINDOW are common ones."""
    low = s.lower()
    seen = [low[i : i + 2] in PAIRS for i in range(len(low) - 1) if low[i].isalpha() and low[i + 1].isalpha()]
    n = sum(seen[:PAIR_WINDOW])
    if n * PAIR_WINDOW < PAIR_LEAST * min(len(seen), PAIR_WINDOW):
        return False
    for i in range(PAIR_WINDOW, len(seen)):
        n += seen[i] - seen[i - PAIR_WINDOW]
        if n < PAIR_LEAST:
            return False
    return True


_CLOG = [0.0, *(c * math.log2(c) for c in range(1, 257))]


def peak_entropy(s: str, window: int) -> float:
    """The highest Shannon entropy, in bits a character, of any window of s."""
    counts: dict[str, int] = {}
    total = least = 0.0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _CLOG[n + 1] - _CLOG[n]
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _CLOG[n - 1] - _CLOG[n]
        if i == window - 1 or i >= window and total < least:
            least = total
    return math.log2(window) - least / window if len(s) >= window else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


#: The same as runs of HEX of 24 and more, as a run is maximal; found faster.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def _parts(s: str, allow: tuple[re.Pattern, ...]) -> Iterator[tuple[int, str]]:
    """What is left to judge of a candidate: its parts beside placeholders, with their places."""
    at = 0
    for end, after in [*((m.start(), m.end()) for m in PLACEHOLDER.finditer(s)), (len(s), len(s))]:
        part = s[at:end]
        if part and not any(x.fullmatch(part) for x in allow) and not (LETTERS.fullmatch(part) and wordlike(part)):
            yield at, part
        at = after


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW, taken: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Candidates with a window that reaches the entropy and isn't within the spans taken or the candidates found before."""
    found, taken = [], _merged(taken or [])
    for kind, run, window, least in CLASSES:
        ends = [b for _, b in taken]
        for m in run.finditer(text):
            a = m.start()
            if any(_beyond(part, a + at, window, least, taken, ends) for at, part in _parts(m[0], allow)):
                found.append((a, KINDS.index(kind), m.end()))
        taken = _merged([*taken, *((a, b) for a, _, b in found)])
    return found


def _beyond(part: str, start: int, window: int, least: float, taken: list[tuple[int, int]], ends: list[int]) -> bool:
    """Whether a window of the part at start reaches the entropy and extends beyond the spans taken, which are apart; ends: theirs."""
    if peak_entropy(part, window) < least:
        return False
    end, free, at = start + len(part), [], start
    for k in range(bisect_right(ends, start), len(taken)):
        x, y = taken[k]
        if x >= end:
            break
        if at < x:
            free.append((at, x))
        at = max(at, y)
    if at < end:
        free.append((at, end))
    # All windows that touch a free stretch lie within window - 1 characters of it.
    return any(peak_entropy(part[max(0, x - start - window + 1) : y - start + window - 1], window) >= least for x, y in free)


def all_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the patterns, and these with the added ones."""
    base = base_spans(text)
    return base, sorted([*base, *entropy_spans(text, allow, [(a, b) for a, _, b in base])])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[re.Pattern, ...] = ALLOW) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (the spans as structs)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", T.ArrayType(span))]

    def make():
        def f(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in fields]
            for text in texts:
                base, every = all_spans(text, allow)
                kinds = [k for _, k, _ in base]
                row = [*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every]]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            return out

        return f

    return map_texts(docs, id_col, text_col, make, fields)


def redacted(text: str, mark: str = "[SECRET]", allow: tuple[re.Pattern, ...] = ALLOW) -> str:
    """The text with a mark in place of every span; spans that overlap give one mark."""
    out, at = [], 0
    for a, _, b in all_spans(text, allow)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", allow: tuple[re.Pattern, ...] = ALLOW) -> DataFrame:
    """All rows and columns, with a mark in place of every secret; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for piece in pieces(batch, text_col):
                column = piece.column(at)
                clean = pa.array([redacted(x, mark, allow) if x else x for x in column.to_pylist()], column.type)
                yield piece.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(run, docs.schema)
