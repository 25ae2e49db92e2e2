"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Base spans come from three patterns (assign, access, hex).  The lexer reads
``name = literal``, ``name: literal``, ``"name": "literal"``, ``name := ...``,
``name => ...`` pairs, also with a type between (``name: str = ...``, ``var
name string = ...``); literals may hold escaped quotes or run over lines
between triple quotes.  A literal keeps its place; a plain name on the right
side, ``${name}`` or a ``+`` chain of literals and names is resolved through
the constants bound earlier in the text, and of a call that reads a setting
(``getenv("NAME", "default")``) the defaults count.  A literal is scored by
the names it reaches (how sensitive they are, directly or through constants)
times how much it looks like key material or a passphrase; at 0.5 or more it
becomes a ``literal`` span.  Base spans always stay.

Spans are code points, end exclusive.  Null and empty texts have none
(digest of the empty string).  Repeated rows get equal results, an empty
table an empty result; texts are scanned whole, whatever their length.
Bytes are scanned (all patterns are ASCII) and offsets are turned into code
points in one running count per text.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import map_rows, prepare, table, utf8
from trafficlens.llm.registry import register

# The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # maximal runs, as a run that starts earlier is matched first
KINDS = ("assign", "access", "hex", "literal")

#: A prefilter in C for each pattern: without it the pattern cannot match.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_MAP = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))

# How sensitive a name's parts are.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
             "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8,
             "bearer": 0.8, "key": 0.6, "private": 0.7, "signature": 0.6, "salt": 0.6, "dsn": 0.6, "session": 0.5}
THRESHOLD = 0.5

OPERATOR = re.compile(rb":=|=>|=(?!=)|:(?!:|//)")
NAME_BACKWARDS = re.compile(rb"""[ \t]*+\]?["'`]?([A-Za-z0-9_.\-]*[A-Za-z_])""")  # on the reversed text
# Typed declarations, on the reversed text: the name before ``: type``, or between a keyword and a type.
ANNOTATED = re.compile(rb"""[ \t]*+[A-Za-z0-9_.\[\], |<>?*&]*+:[ \t]*+["']?([A-Za-z0-9_.\-]*[A-Za-z_])""")
DECLARED = re.compile(rb"[ \t]*+[A-Za-z0-9_.\[\]*<>]++[ \t]++([A-Za-z0-9_]+)[ \t]++(?:rav|tsnoc|tel|lav|lanif|citats)(?![A-Za-z0-9_])")
_QUOTED = (rb'"""((?:(?!""").)*+)"""|' rb"'''((?:(?!''').)*+)'''|"
           rb"""\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`""")
TERM = re.compile(rb"""[ \t]*+(?:""" + _QUOTED + rb"""|\$\{([A-Za-z_][A-Za-z0-9_.]*)\}"""
                  rb"""|\$?([A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9+/_=\-])|([A-Za-z0-9+/_.=\-]{8,}))""", re.S)
LITERAL, REFERENCE, WORD, BARE = (1, 2, 3, 4, 5), 6, 7, 8
# A call's literals: of one that reads a setting, those behind its name; of one that only wraps a text, all.
CALL = re.compile(rb"[ \t]*\(")
ARGUMENT = re.compile(rb"[ \t\n]*+,?[ \t\n]*+(?:" + _QUOTED + rb")", re.S)
GETTERS = (b"getenv", b"get", b"env", b"environ", b"lookup", b"config", b"getproperty", b"setting")
WRAPPERS = (b"str", b"bytes", b"string", b"secretstr", b"secret", b"b64decode", b"bytearray")
PLUS = re.compile(rb"[ \t]*\+")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def sensitivity(name: str) -> float:
    """Largest weight of a name's parts (camel case, snake case, dots); ``api key`` counts as one part."""
    parts = [p.lower() for p in PARTS.findall(name)]
    parts += [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


def passphrase(value: bytes) -> float:
    """0.6 for several words that do not read like a message, 1 for a private key, else 0."""
    if b"PRIVATE KEY" in value:
        return 1.0
    words = value.split()
    message = value.rstrip()[-1:] in b".?!:" or any(
        k in value.lower() for k in (b"password", b"token", b"secret", b"key", b"please", b"enter", b"your", b"must", b"invalid"))
    return 0.6 if len(words) >= 3 and len(value) >= 16 and b"\n" not in value and not message else 0.0


def randomness(value: bytes) -> float:
    """0 to 1: how much a literal looks like key material (length, entropy, mixed characters), or like a passphrase."""
    n = len(value)
    if n < 8:
        return 0.0
    if b" " in value or b"\t" in value or b"\n" in value:
        return passphrase(value)
    counts: dict[int, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    digits = any(48 <= c <= 57 for c in value)
    alpha = any(65 <= c <= 90 or 97 <= c <= 122 for c in value)
    return min(1.0, entropy / 3.0) * min(1.0, n / 12) * (1.0 if digits and alpha else 0.6)


def call_literals(text: bytes, callee: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    """The spans that a call behind ``callee`` hands on, and where they end; ``at``: behind the callee."""
    called = CALL.match(text, at)
    last = callee.rpartition(b".")[2].lower()
    if not called or not (last in WRAPPERS or last.endswith(GETTERS)):
        return [], at
    spans, pos = [], called.end()
    while arg := ARGUMENT.match(text, pos):
        spans.append(arg.span(arg.lastindex))
        pos = arg.end()
    return (spans if last in WRAPPERS else spans[1:]), pos


def literal_spans(text: bytes) -> list[tuple[int, int, float]]:
    """Byte spans of literals whose score by target names reaches the threshold, with that score.

    Each binding is a node: its own literals and the nodes of the names it
    uses.  Weights of sensitive names go from each node to the older ones it
    uses, last node first, so every binding and use is looked at once.
    """
    bound: dict[bytes, int] = {}
    nodes: list[tuple[list[tuple[int, int]], list[int]]] = []
    weights: list[float] = []
    back = text[::-1]
    at = 0
    for op in OPERATOR.finditer(text):
        if op.start() < at:
            continue
        name = NAME_BACKWARDS.match(back, len(text) - op.start())
        if not name:
            continue
        spans: list[tuple[int, int]] = []
        uses: list[int] = []
        pos = op.end()
        while term := TERM.match(text, pos):
            k, end = term.lastindex, term.end()
            if k in LITERAL or k == BARE:
                spans.append(term.span(k))
            elif term.group(k) in bound:
                uses.append(bound[term.group(k)])
            elif k == WORD:
                handed, end = call_literals(text, term.group(k), end)
                spans += handed or [term.span(k)]  # a bare word: a literal in configuration files
            pos = end
            more = PLUS.match(text, pos)
            if not more:
                break
            pos = more.end()
        if not spans and not uses:
            continue
        if text[op.start():op.end()] != b":":
            at = pos
        names = [name.group(1)[::-1]]
        if text[op.start():op.end()] == b"=":
            typed = ANNOTATED.match(back, len(text) - op.start()) or DECLARED.match(back, len(text) - op.start())
            if typed:
                names.append(typed.group(1)[::-1])
        for target in names:
            bound[target] = len(nodes)
        nodes.append((spans, uses))
        weights.append(max(sensitivity(t.decode()) for t in names))
    best: dict[tuple[int, int], float] = {}
    for i in range(len(nodes) - 1, -1, -1):
        if weight := weights[i]:
            spans, uses = nodes[i]
            for s in spans:
                best[s] = max(weight, best.get(s, 0.0))
            for u in uses:
                weights[u] = max(weight, weights[u])
    scored = ((a, b, w * randomness(text[a:b])) for (a, b), w in sorted(best.items()))
    return [(a, b, w) for a, b, w in scored if w >= THRESHOLD]


def scan_text(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, in bytes, by start, then in the order of KINDS."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.translate(HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if b"=" in text or b":" in text:
        found += [(a, 3, b) for a, b, _ in literal_spans(text)]
    found.sort()
    return [(a, b, KINDS[k]) for a, k, b in found]


def code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte spans as code point spans, counting each stretch of the text once."""
    places = sorted({p for a, b, _ in spans for p in (a, b)})
    at = chars = 0
    to = {}
    for p in places:
        chars += len(text[at:p].decode())
        at = p
        to[p] = chars
    return [(to[a], to[b], k) for a, b, k in spans]


def redact(text: bytes, spans: list[tuple[int, int, str]], mark: bytes = b"<secret>") -> bytes:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return b"".join([*out, text[at:]])


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "secret_spans array<struct<start:long,end:long,kind:string>>, redacted string")


def secret_scan(docs: DataFrame, keep: list[str] | None = None, redacted: bool = True) -> DataFrame:
    """``docs`` with counts and spans of secrets, and the redacted text (null for null texts, or if not asked for)."""
    prepare(docs.sparkSession)

    def run(batches):
        for cols in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secret_spans", "redacted")}
            valid = cols["text"].is_valid().to_pylist()
            for t, ok in zip(utf8(cols["text"]), valid):
                raw = scan_text(t)
                spans = code_points(t, raw)
                base = [s for s in spans if s[2] != "literal"]
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_digest(base).encode()).hexdigest())
                out["spans"].append(_digest(spans))
                out["secret_spans"].append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                out["redacted"].append((redact(t, raw) if raw else t).decode() if ok and redacted else None)
            span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
            kinds = {"base_sha256": pa.string(), "spans": pa.string(), "redacted": pa.string(),
                     "secret_spans": pa.list_(span)}
            yield {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    return map_rows(docs, {"text": "text"}, run, SCHEMA, keep)


@register("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan(table(spark, sf_dir, "documents"), keep=["doc_id"], redacted=False)
    return got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, with secrets in its text replaced and ``n_chars`` to match."""
    columns = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.col("text"))
    got = secret_scan(boxed, keep=["own"])
    changed = F.size("secret_spans") > 0
    new = {"text": F.col("redacted"),
           "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("own.n_chars"))}
    return got.select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in columns])
