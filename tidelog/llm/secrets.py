"""Secret scans: patterns, and multipart credentials whose parts are linked within a scope."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The patterns that always count, and the least length of what they catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Parts that are too weak alone: identifiers of an account, secrets without a name, endpoints.
WEAK_ACCESS = re.compile(r"""\b(?:(?:client|access|account|app|tenant)[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})|\b(?:AKIA|ASIA|AIza)[A-Za-z0-9_-]{6,}""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.IGNORECASE | re.ASCII)
#: A text without any of these has no part of a credential besides a bare run.
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS_HINTS = ("akia", "asia", "aiza", "id", "user", "login")
#: Code points between a bare run and an identifier at most (named parts are linked in their whole scope), and entropy in bits a character from which a bare run may be a secret.
REACH, ENTROPY = 400, 3.5

KINDS = ("assign", "access", "hex", "linked_access", "linked_secret", "linked_endpoint")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, leftmost and non-overlapping for each kind."""
    lower = text.lower()
    out: list[Span] = []
    if any(hint in lower for hint in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy(run: str) -> float:
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def _is_secret(run: str) -> bool:
    classes = (any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run))
    return classes[0] and sum(classes) >= 2 and entropy(run) >= ENTROPY


def _near(spans: list[Span], others: list[Span], scope_of) -> list[Span]:
    """The spans that have one of the others in their scope within REACH code points: a join of two sorted lists of intervals.

    The others don't overlap each other, so of those before a span the last is the nearest, and of those behind it the first.
    """
    starts, ends = [s for _, s, _ in others], [e for _, _, e in others]
    out = []
    for span in spans:
        _, start, end = span
        before, behind = bisect.bisect_right(ends, start) - 1, bisect.bisect_left(starts, end)
        left = before >= 0 and ends[before] >= start - REACH and scope_of(starts[before]) == scope_of(start)
        if left or behind < len(others) and starts[behind] <= end + REACH and scope_of(starts[behind]) == scope_of(start):
            out.append(span)
    return out


def _beside(spans: list[Span], others: list[Span], scope_of) -> list[Span]:
    """The spans that have one of the others, not overlapping, anywhere in their scope."""
    first_end: dict[int, int] = {}
    last_start: dict[int, int] = {}
    for _, a, b in others:
        k = scope_of(a)
        first_end[k], last_start[k] = min(b, first_end.get(k, b)), max(a, last_start.get(k, a))
    return [x for x in spans if (k := scope_of(x[1])) in first_end and (first_end[k] <= x[1] or last_start[k] >= x[2])]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts, reported only where complementary ones are in the same scope, for bare secrets also within reach.

    A scope is a block of lines between empty ones. A bare secret, or a named one too short to count alone, counts next to an
    account identifier; an identifier next to a bare or a named secret; an endpoint next to both.
    """
    lower = text.lower()
    named = sorted((s for s in base if s[0] in ("assign", "hex")), key=lambda s: s[1])
    access = [("linked_access", m.start(), m.end()) for m in WEAK_ACCESS.finditer(text)] if any(h in lower for h in _ACCESS_HINTS) else []
    strong = sorted((s for s in base if s[0] == "access"), key=lambda s: s[1])
    if not access and not strong:
        return []
    short = [("linked_secret", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) < ASSIGN_LEAST] if any(h in lower for h in _ASSIGN_HINTS) else []
    taken = sorted((s, e) for _, s, e in [*base, *short])
    ends_so_far = list(itertools.accumulate((e for _, e in taken), max))
    free = lambda s, e: (i := bisect.bisect_left(taken, (e,))) == 0 or ends_so_far[i - 1] <= s
    secrets = [("linked_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if free(m.start(), m.end()) and _is_secret(m[0])]
    if not secrets and not named and not short:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    scope_of = lambda at: bisect.bisect_left(breaks, at)
    both = lambda *lists: sorted((s for x in lists for s in x), key=lambda s: s[1])
    weak_access = [s for s in access if free(s[1], s[2])]
    access_near = sorted({*_near(weak_access, secrets, scope_of), *_beside(weak_access, both(named, short), scope_of)}, key=lambda s: s[1])
    all_ids = both(weak_access, strong)
    secret_near = both(_near(secrets, all_ids, scope_of), _beside(short, all_ids, scope_of))
    ends = []
    if (all_access := both(access_near, strong)) and (all_secrets := both(secret_near, named)):
        points = [("linked_endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
        ends = _beside(_beside([p for p in points if free(p[1], p[2])], all_access, scope_of), all_secrets, scope_of)
    return [*access_near, *secret_near, *ends]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex (long), base_sha256 and spans (kind:start:end, comma-joined).

    Base spans always count; linked spans are parts of credentials that only count together.
    Offsets are code points, ends exclusive. A document's parts are linked inside its
    row, so nothing is shuffled. A null or empty text has no spans. Null ids stay null. Patterns and the join take time
    in proportion to a text's length. Repeated rows are scanned each; other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, spans = [], []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                base = base_spans(text)
                for k in counts:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined([*base, *linked_spans(text, base)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
