"""Secret scan: base patterns, and linking of weak parts of multipart credentials.

Base spans are taken as they are. The method adds to them: it collects parts with a role (an access identifier,
a secret or an endpoint) and joins them as intervals. Two parts of different roles are linked when they lie in
one scope, which is a block of text without an empty line, and within a distance of each other. A weak part,
which alone would be noise, is reported only when it is linked; base spans take part as strong ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import cells, mapped, spread

#: Fixed patterns of the base kinds, in their order, and the least length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
#: Every match of ASSIGN has one of these, whatever its case.
HINTS = ("passw", "secret", "token", "api")

#: Code points between two parts that may still be linked, unless the caller gives another reach.
REACH = 400

#: Weak parts, of any length: kind, role, pattern, group of the span, least entropy in bits a character.
WEAK = (
    ("user", "identifier", re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII), 1, 0.0),
    ("email", "identifier", re.compile(r"\b[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}\b", re.ASCII), 0, 0.0),
    ("key40", "secret", re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])", re.ASCII), 0, 4.0),
    ("short", "secret", re.compile(r"""\b(?:pw|pwd|pass|key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""", re.IGNORECASE | re.ASCII), 1, 2.5),
    ("url", "endpoint", re.compile(r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\s\"'<>]{3,}", re.ASCII), 0, 0.0),
    ("host", "endpoint", re.compile(r"""\b(?:host(?:name)?|server|endpoint|region|bucket)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.:/-]{3,})""", re.IGNORECASE | re.ASCII), 1, 0.0),
)
#: A weak pattern is tried only where one of its marks occurs (None: always).
MARKS = {
    "user": ("user", "login", "client", "account", "access"),
    "email": ("@",),
    "key40": None,
    "short": ("pw", "pass", "key", "auth"),
    "url": ("://",),
    "host": ("host", "server", "endpoint", "region", "bucket"),
}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"}
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind in their order; end is exclusive."""
    low = text.lower() if low is None else low
    out = []
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    names = [*KINDS, *(w[0] for w in WEAK)]
    return sorted(spans, key=lambda s: (s[0], names.index(s[2]), s[1]))


def linked_spans(text: str, base: list[tuple[int, int, str]], low: str, reach: int | None = REACH) -> list[tuple[int, int, str]]:
    """Weak parts that stand in one scope, within reach, of a part with another role.

    Strong parts link too, but two endpoints and identifiers alone are no credential: a weak part counts only if
    a secret is among the roles that its link brings together. Without a reach (None) the scope alone decides.
    """
    reach = len(text) if reach is None else reach
    weak = []
    for kind, role, pattern, group, least in WEAK:
        marks = MARKS[kind]
        if marks is not None and not any(m in low for m in marks):
            continue
        for m in pattern.finditer(text):
            if not least or entropy(m[group]) >= least:
                weak.append((m.start(group), m.end(group), kind, role))
    if not weak:
        return []
    covers = list(accumulate((b for _, b, _ in base), max))  # the furthest end of the base spans up to each
    starts = [a for a, _, _ in base]
    inside = lambda a, b: (k := bisect_right(starts, a)) and covers[k - 1] >= b
    weak = [w for w in weak if not inside(w[0], w[1])]
    parts = {r: sorted([(a, b) for a, b, k, role in weak if role == r] + [(a, b) for a, b, k in base if ROLES[k] == r]) for r in ("identifier", "secret", "endpoint")}
    furthest = {r: list(accumulate((b for _, b in p), max)) for r, p in parts.items()}
    cuts = [m.start() for m in BLANK.finditer(text)]
    scope = lambda at: bisect_left(cuts, at)
    out = []
    for a, b, kind, role in weak:
        for other in ("identifier", "endpoint") if role == "secret" else ("secret",):
            near = parts[other]
            k = bisect_left(near, (a,))
            # The last part that starts before, with the furthest end so far: a part that runs on past it holds no
            # white space, so it is in the same scope. After it, the first that starts is the nearest.
            before = k > 0 and a - furthest[other][k - 1] <= reach and scope(near[k - 1][0]) == scope(a)
            after = k < len(near) and near[k][0] - b <= reach and scope(near[k][0]) == scope(a)
            if before or after:
                out.append((a, b, kind))
                break
    return out


def scan(text: str | None, reach: int | None = REACH) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a whole text; a null text counts as empty."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    return base, ordered([*base, *linked_spans(text, base, low, reach)])


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])


def scan_secrets(docs: DataFrame, *, reach: int | None = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (array of spans), found (array of all spans, base ones among them) for each row of docs.

    Weak parts are found only with a complement in the same scope at most reach code points away; with None, anywhere
    in the scope. Spans are in code points of the whole text, end exclusive, by start and then kind. Null and empty texts have
    none. Every row is scanned alone: repeated rows get equal results. Other columns are ignored. An empty table
    gives an empty one.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", T.ArrayType(SPAN)), T.StructField("found", T.ArrayType(SPAN))])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        named = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            got = [scan(text, reach) for (text,) in cells([batch], text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array([named(g[c]) for g in got], kind) for c in (0, 1))], [f.name for f in schema])

    return mapped(spread(docs.select(id_col, text_col)), run, schema)
