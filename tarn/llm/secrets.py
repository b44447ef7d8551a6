"""Secret scans with multipart credential linking.

Base spans come from three patterns. Besides, weak candidates are gathered: account or client identifiers, high-entropy
strings and endpoints. Each means little alone, so an interval join within a scope (SCOPE code points between two parts, in one
document) looks for complementary parts: a weak identifier needs a secret near it, a weak secret an identifier or an
endpoint, an endpoint a secret. Only linked ones are reported. Scopes never cross documents, so nothing shuffles.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import map_columns, read_table

SCOPE, LEAST_ENTROPY = 256, 3.5
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])(?ai:access_?key_?id|client_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,}+)")
WEAK_ID_WORDS = ("key", "client", "account", "user", "login")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+")
#: Which roles complete a weak candidate.
NEEDS = {"weak_id": {"secret"}, "weak_secret": {"id", "endpoint"}, "weak_endpoint": {"secret"}}
ROLES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "weak_endpoint": "endpoint"}

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def weak_candidates(text: str, base: list[Span]) -> list[Span]:
    """Candidates that touch no base span, and of secrets those that touch no endpoint."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WEAK_ID_WORDS):
        found += [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "http" in text else []
    starts = [e[0] for e in ends]
    for m in WEAK_SECRET.finditer(text):
        s, k = m[0], bisect_left(starts, m.end())
        if (not k or ends[k - 1][2] <= m.start()) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= LEAST_ENTROPY:
            found.append((m.start(), 4, m.end()))
    found += ends
    # base spans of one kind do not overlap, so the one that begins last before an end is the only one to look at
    kinds = [[s for s in base if s[1] == k] for k in range(3)]
    starts = [[s[0] for s in spans] for spans in kinds]
    return [(a, k, b) for a, k, b in sorted(found) if not any((i := bisect_left(starts[j], b)) and kinds[j][i - 1][2] > a for j in range(3))]


def linked(parts: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans with a complement that ends or begins within scope of them: an interval join on sorted starts and ends."""
    starts: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    ends: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    for a, k, b in parts + weak:
        starts[ROLES[KINDS[k]]].append(a)
        ends[ROLES[KINDS[k]]].append(b)
    for found in (*starts.values(), *ends.values()):
        found.sort()

    def near(s: Span, role: str) -> bool:
        after, before = bisect_left(starts[role], s[2]), bisect_right(ends[role], s[0])
        return (after < len(starts[role]) and starts[role][after] - s[2] <= scope) or (before > 0 and s[0] - ends[role][before - 1] <= scope)

    return [s for s in weak if any(near(s, r) for r in NEEDS[KINDS[s[1]]])]


def joined(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    A null text is empty and has no spans; texts and spans of any length go whole. Equal texts have equal spans; ids may be null or repeat.
    Spans that begin together come in the order of KINDS. Further columns are left out. An empty table gives no rows.
    """

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            base = [base_spans(t or "") for t in x["text"]]
            more = [linked(b, weak_candidates(t or "", b)) for t, b in zip(x["text"], base, strict=True)]
            yield {"doc_id": x["doc_id"]} | {f"n_{KINDS[k]}": [sum(s[1] == k for s in b) for b in base] for k in range(3)} | {
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(sorted(b + m)) for b, m in zip(base, more, strict=True)], "n_linked": [len(m) for m in more]
            }

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
