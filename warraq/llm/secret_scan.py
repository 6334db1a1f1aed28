"""Secret scans with multipart credential linking.

A scan of each whole text finds the base kinds (assign, access, hex) and weak parts: identifiers,
opaque values and endpoints that mean little alone.  Identifiers, secrets and endpoints are then
joined by their intervals within a scope (at most SCOPE code points from the end of one to the start
of the other): in sorted order each part finds its nearest complements, without pairs of all.  A
weak part is reported only when its complements are there: an identifier near a secret, an opaque
value near an identifier or endpoint, an endpoint near both.  The join's rows, (identifier, secret,
endpoint), are reported as credentials.  Base findings always stay.

Defined results: a null text counts as empty, with no findings and the hash of the empty list; a
weak part that overlaps a base finding is that finding's own and is dropped, but an endpoint that
wholly contains base findings is kept as an endpoint; repeated rows have equal results each; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, text_of

#: Kinds in the order in which equal starts are listed: base ones, then weak ones.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"""(?:user_?name|user|login|client_?id|account_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.I | re.A)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,11}://[^\s"'<>]{3,}|(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+""", re.I | re.A)
#: Code points between parts that belong together, from the end of one to the start of the other, at most.
SCOPE = 200


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def opaque(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found = [(m.start(), 3, m.end()) for m in IDENT.finditer(text)] + [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if opaque(m[0])]
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    out = []
    for start, kind, end in sorted(found):
        before, within = bisect_left(starts, start), bisect_left(starts, end)
        if kind == 5:  # base findings inside an endpoint leave it one
            own = before and reach[before - 1] > start or any(b > end for _, _, b in base[before:within])
        else:
            own = within and reach[within - 1] > start
        if not own:
            out.append((start, kind, end))
    return out


def nearest_of(parts: list[tuple[int, int, int]], *kinds: int):
    """A function (start, end) to (gap, part): the part of the kinds with the least gap, the first on
    ties; None where there is no part of the kinds."""
    own = sorted((p for p in parts if p[1] in kinds), key=lambda p: (p[0], p[2]))
    starts = [p[0] for p in own]
    # of the parts that start no later, the one that reaches farthest is the nearest
    farthest = list(accumulate(own, lambda p, q: q if q[2] > p[2] else p))

    def nearest(start: int, end: int):
        i = bisect_right(starts, start)
        found = [(max(0, start - farthest[i - 1][2]), farthest[i - 1])] if i else []
        if i < len(own):
            found.append((max(0, own[i][0] - end), own[i]))
        return min(found, default=None)

    return nearest


IDENTIFIERS, SECRETS, ENDPOINTS = (1, 3), (0, 2, 4), (5,)


def linked_parts(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int = SCOPE):
    """The weak parts with their complements within scope, and the credentials: rows (identifier,
    secret, endpoint), None where there is none in scope, of secrets with any of the two."""
    parts = base + weak
    identifier, secret, endpoint = (nearest_of(parts, *k) for k in (IDENTIFIERS, SECRETS, ENDPOINTS))

    def near(join, part):
        found = join(part[0], part[2])
        return found[1] if found and found[0] <= scope else None

    met = {
        3: lambda p: near(secret, p),
        4: lambda p: near(identifier, p) or near(endpoint, p),
        5: lambda p: near(identifier, p) and near(secret, p),
    }
    kept = [p for p in weak if met[p[1]](p)]
    joined = [(near(identifier, p), p, near(endpoint, p)) for p in sorted(parts) if p[1] in SECRETS]
    return kept, [c for c in joined if c[0] or c[2]]


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, credentials string"


def scanned(text: str, scope: int) -> tuple:
    """The columns of SCANNED after the id."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    more, joined = linked_parts(base, weak, scope)
    kinds = [k for _, k, _ in base]
    place = lambda p: f"{p[0]}:{p[2]}" if p else "-"
    rows = ",".join("+".join(map(place, c)) for c in joined)
    return (*(kinds.count(k) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(more), rows)


def _scan(scope):
    names = [c.split()[0] for c in SCANNED.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in SCANNED.split(", ")]

    def run(batches):
        for batch in batches:
            found = list(zip(*(scanned(text, scope) for text in batch.column(1).to_pylist()))) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types[1:]))], names=names)

    return run


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts and hash of the base kinds, all spans, the number
    of linked weak parts, and the credentials (identifier+secret+endpoint, each start:end or -)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInArrow(_scan(scope), SCANNED)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


QUERIES = {"op4_secret_scan": op4_secret_scan}
