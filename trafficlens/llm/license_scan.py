"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard
parser evaluates the tags' ``AND`` / ``OR`` / ``WITH`` expressions.

A text is lower-cased (A-Z only) and cut into words of digits, letters and
non-ASCII characters; phrases are searched as consecutive words.  The base
phrases give the base labels; the longer phrase list (names, notices, short
names, identifiers written out, in both spellings) and the identifiers of
well-formed tag expressions add labels of their own; an identifier of no known
family is labelled ``other``.

A tag's expression is evaluated in one pass over its postfix form:
``required`` has the labels that every way to satisfy it needs, ``choices``
those that only some need.  ``score`` (0 to 1) is the chance that the text
carries a licence statement: 1 - prod(1 - weight) over its distinct findings;
each required label of an expression is one, its choices together are one.

Null and empty texts have no words, no places, empty labels and score 0.
Malformed expressions (unbalanced, missing operand, stray characters) add
nothing.  Repeated rows get equal results; an empty table gives an empty
result.  Texts of any length are scanned whole, one batch of rows at a time.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm.common import map_rows, prepare, table, utf8
from trafficlens.llm.registry import register

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

BASE_WEIGHT, TAG_WEIGHT = 0.9, 0.95

# Further notice phrases: label and how strongly the phrase alone speaks for a licence statement.
NOTICE_PHRASES = {
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "creative commons attribution": ("cc", 0.8),
    "licensed under cc": ("cc", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "all rights reserved": ("proprietary", 0.5),
    "permission to use copy modify and or distribute this software": ("isc", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "boost software license": ("boost", 0.9),
    "common development and distribution license": ("cddl", 0.9),
    "zlib license": ("zlib", 0.8),
    "artistic license": ("artistic", 0.8),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "python software foundation license": ("psf", 0.9),
    "server side public license": ("sspl", 0.9),
    "open software license": ("osl", 0.8),
    "academic free license": ("afl", 0.8),
    "dedicated to the public domain": ("public-domain", 0.7),
}

# Identifiers with their versions, as they stand in headers and file lists.
IDENTIFIERS = {"apache": ("2.0", "1.1"), "gpl": ("2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"),
               "mpl": ("1.1", "2.0"), "epl": ("1.0", "2.0"), "cc by": ("3.0", "4.0"), "cc by sa": ("3.0", "4.0"),
               "cc0": ("1.0",), "cddl": ("1.0", "1.1")}


def notice_phrases() -> dict[str, tuple[str, float]]:
    """All notice phrases: those listed, short names with versions, and ``licence`` beside ``license``."""
    out = dict(NOTICE_PHRASES)
    for name, versions in IDENTIFIERS.items():
        label = "cc" if name.startswith("cc") and name != "cddl" else name
        for v in versions:
            major, minor = v.split(".")
            for form in (f"{name} {major} {minor}", f"{name} v{major}", f"{name} v{major} {minor}", f"{name} version {major}",
                         f"{name}v{major}"):
                out.setdefault(form, (label, 0.6))
    for name in ("gpl", "lgpl", "agpl"):
        out[f"gnu {name}"] = (name, 0.7)
    both = {**out, **{p: (label, BASE_WEIGHT) for p, label in BASE_PHRASES.items()}}
    out |= {p.replace("license", "licence"): x for p, x in both.items() if "license" in p}
    out |= {p.replace("licensed", "licenced"): x for p, x in out.items() if "licensed" in p}
    return out


TAG = "spdx license identifier"

# Identifier prefixes (lower case) and their label.
FAMILIES = (("apache", "apache"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("mit", "mit"),
            ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("isc", "isc"), ("cc", "cc"), ("unlicense", "unlicense"),
            ("zlib", "zlib"), ("bsl", "boost"), ("cddl", "cddl"), ("artistic", "artistic"), ("wtfpl", "wtfpl"),
            ("python", "psf"), ("psf", "psf"), ("sspl", "sspl"), ("osl", "osl"), ("afl", "afl"))

#: Every byte to what the words' alphabet makes of it: A-Z lower-cased, letters, digits and non-ASCII kept, else a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))

TAG_LINE = re.compile(r"spdx[^0-9A-Za-z\n]*license[^0-9A-Za-z\n]*identifier[ \t]*:?[ \t]*([^\n]*)", re.I | re.A)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
PRIORITY = {"or": 1, "and": 2, "with": 3}
NOTICES = notice_phrases()


def automaton() -> ahocorasick.Automaton:
    """Finds all phrases in text of the form " word word ... "; a finding is (phrase, number of characters)."""
    out = ahocorasick.Automaton()
    for p in {*BASE_PHRASES, *NOTICES, TAG}:
        out.add_word(f" {p} ", (p, len(p) + 2))
    out.make_automaton()
    return out


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order (operators lower-cased), or None if it is malformed.

    Text behind the expression (a comment's end, say) is left out: reading
    stops where neither an operator nor a closing bracket may continue it.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # one is due
    for m in TOKEN.finditer(expression):
        word = m.group()
        op = word.lower()
        if op == "(":
            if not operand:
                break
            stack.append(op)
        elif op == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif op in PRIORITY:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRIORITY[stack[-1]] >= PRIORITY[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        else:
            if not operand:
                break
            out.append(word)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> list[frozenset[str]] | None:
    """The ways to satisfy an expression: one set of licence ids per alternative (None: malformed).

    ``AND`` joins obligations, ``OR`` offers a choice, ``WITH`` attaches an
    exception to the licence before it (``GPL-2.0 WITH x`` is one id).
    Only distinct alternatives are held.
    """
    rpn = postfix(expression)
    if rpn is None:
        return None
    stack: list[frozenset[frozenset[str]]] = []
    for t in rpn:
        if t in PRIORITY:
            b, a = stack.pop(), stack.pop()
            if t == "or":
                stack.append(a | b)
            elif t == "and":
                stack.append(frozenset(x | y for x in a for y in b))
            else:
                if len(a) != 1 or len(b) != 1 or len(next(iter(a))) != 1:
                    return None
                (x,), (y,) = next(iter(a)), next(iter(b))
                stack.append(frozenset([frozenset([f"{x} WITH {y}"])]))
        else:
            stack.append(frozenset([frozenset([t])]))
    return sorted(stack[0], key=sorted)


def expression_ids(expression: str) -> list[str]:
    """Licence ids of a well-formed expression, each once, in order; empty if malformed.

    Read from the postfix form in one pass, so a long expression stays linear.
    """
    rpn = postfix(expression)
    if rpn is None:
        return []
    out: list[str] = []
    for t in rpn:
        if t == "with":
            exception, licence = out.pop(), out.pop()
            out.append(f"{licence} WITH {exception}")
        elif t not in PRIORITY:
            out.append(t)
    return list(dict.fromkeys(out))


def family(identifier: str) -> str:
    low = identifier.lower()
    return next((label for prefix, label in FAMILIES if low.startswith(prefix)), "other")


def obligations(expression: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """(required, choices): labels that every way to satisfy an expression needs, and those that only some need.

    None for a malformed expression.  One pass over the postfix form; as
    labels are few, a long expression stays linear.  An exception (``WITH``)
    belongs to the licence before it and needs a single one there.
    """
    rpn = postfix(expression)
    if rpn is None:
        return None
    stack: list[tuple[frozenset[str], frozenset[str], bool]] = []  # required, all, a single licence
    for t in rpn:
        if t not in PRIORITY:
            one = frozenset([family(t)])
            stack.append((one, one, True))
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            if not (a[2] and b[2]):
                return None
            stack.append((a[0], a[1], False))
        elif t == "and":
            stack.append((a[0] | b[0], a[1] | b[1], False))
        else:
            stack.append((a[0] & b[0], a[1] | b[1], False))
    required, every, _ = stack[0]
    return required, every - required


def scan_text(text: bytes, machine: ahocorasick.Automaton) -> dict:
    words = text.translate(WORD_BYTES).split()
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "",
           "labels": "", "required": "", "choices": "", "score": 0.0, "expressions": [], "ids": [], "starts": [], "phrases": []}
    flat = " " + b" ".join(words).decode("latin-1") + " "
    found = [(end - n + 1, p) for end, (p, n) in machine.iter(flat)]
    if not found:
        return out
    found.sort()
    weight: dict[str, float] = {}
    base, labels, required, choices = set(), set(), set(), set()
    at = word = 0
    tagged = False
    for start, p in found:
        word += flat.count(" ", at, start)
        at = start
        if p == TAG:
            tagged = True
            continue
        out["starts"].append(word)
        out["phrases"].append(p)
        if p in BASE_PHRASES:
            out["n_base"] += 1
            out["first_word"] = word if out["first_word"] is None else out["first_word"]
            out["last_word"] = word
            base.add(BASE_PHRASES[p])
            labels.add(BASE_PHRASES[p])
            weight[p] = BASE_WEIGHT
        if p in NOTICES:
            label, w = NOTICES[p]
            labels.add(label)
            weight[p] = max(w, weight.get(p, 0))
    if tagged:
        for m in TAG_LINE.finditer(text.decode()):
            got = obligations(m.group(1))
            if got is None:
                continue
            out["expressions"].append(m.group(1).strip())
            out["ids"] += [x for x in expression_ids(m.group(1)) if x not in out["ids"]]
            required |= got[0]
            choices |= got[1]
            for x in got[0]:
                weight[f"id {x}"] = max(0.5 if x == "other" else TAG_WEIGHT, weight.get(f"id {x}", 0))
            if got[1]:
                weight["one of " + ",".join(sorted(got[1]))] = 0.5 if got[1] == {"other"} else TAG_WEIGHT
    labels |= required | choices
    miss = 1.0
    for k in sorted(weight):
        miss *= 1 - weight[k]
    out |= {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - miss,
            "required": ",".join(sorted(required)), "choices": ",".join(sorted(choices - required))}
    return out


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "required string, choices string, score double, expressions array<string>, ids array<string>, starts array<long>, phrases array<string>")


def license_scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the scan's counts, labels, score, tag expressions, and the phrases with their word starts."""
    prepare(docs.sparkSession)

    def run(batches):
        machine = automaton()
        for cols in batches:
            got = [scan_text(t, machine) for t in utf8(cols["text"])]
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "required": pa.string(), "choices": pa.string(), "score": pa.float64(),
                     "expressions": pa.list_(pa.string()), "ids": pa.list_(pa.string()), "starts": pa.list_(pa.int64()),
                     "phrases": pa.list_(pa.string())}
            yield {k: pa.array([g[k] for g in got], kinds.get(k, pa.int64())) for k in got[0]}

    return map_rows(docs, {"text": "text"}, run, SCHEMA, keep)


@register("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                      "required", "choices")
