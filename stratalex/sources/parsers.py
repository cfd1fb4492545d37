"""Symbols of source files by line and brace scanning.

No grammar libraries are at hand, so declarations are recognised by their
heads and end where their braces close; comments and strings are blanked out
first. Spans have lines from 1 on, start <= end, and a name, kind and text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

SPANS = "name string, kind string, start_line int, end_line int, body string"

_NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S)


def blank(text):
    """The text with comments and strings replaced by spaces, line by line the same."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_EDGE = re.compile(r"[{}()\[\];\n]")


def closing(code, at):
    """Where the brace block that begins at or after `at` closes; without one, the end of the statement."""
    depth = 0
    for m in _EDGE.finditer(code, at):
        c, i = m[0], m.start()
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth <= 0 and c == "}":
                return i
        elif depth == 0 and (c == ";" or (code[at:i].strip() and not code[i : i + 80].split("\n\n")[0].strip().startswith("{"))):
            return i
    return len(code) - 1


class Source:
    """One file: its text, the text without comments and strings, and where its lines begin."""

    def __init__(self, text):
        self.text, self.code, self.lines = text, blank(text), text.split("\n")
        self.starts = [0]
        for x in self.lines[:-1]:
            self.starts.append(self.starts[-1] + len(x) + 1)

    def line(self, at):
        return bisect.bisect_right(self.starts, at)

    def span(self, start, name, kind, end=None):
        """(name, kind, first line, last line, body, start, end) of a declaration that begins at start."""
        end = closing(self.code, start) if end is None else end
        a, z = self.line(start), self.line(max(end, start))
        return name, kind, a, z, "\n".join(self.lines[a - 1 : z]), start, end


GO = [
    (re.compile(r"^func\s*\(\s*\w*\s*\*?\s*(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)", re.M), "Method"),
    (re.compile(r"^func\s+(?P<name>\w+)", re.M), "Function"),
    (re.compile(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", re.M), "Struct"),
    (re.compile(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", re.M), "Interface"),
    (re.compile(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?!struct\b|interface\b)\S", re.M), "Type"),
]
SCRIPT = [
    (re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)", re.M), "Function"),
    (re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)", re.M), "Struct"),
    (re.compile(r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)", re.M), "Interface"),
    (re.compile(r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:type|(?:const\s+)?enum)\s+(?P<name>[\w$]+)", re.M), "Type"),
    (re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>", re.M), "Function"),
]
MEMBER = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*(?P<name>#?[\w$]+)\s*(?:<[^>\n]*>)?\([^;{]*\)\s*(?::[^{;\n]+)?\{", re.M)
WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "else", "do"}
SOLIDITY_TOP = re.compile(r"^[ \t]*(?:abstract\s+)?(?P<what>contract|library|interface)\s+(?P<name>\w+)", re.M)
SOLIDITY = re.compile(r"^[ \t]*(?P<what>function|modifier|event|struct|enum|constructor|receive|fallback)\b[ \t]*(?P<name>\w*)", re.M)
SOLIDITY_KINDS = {"modifier": "Modifier", "event": "Event", "struct": "Struct", "enum": "Type", "constructor": "Constructor", "receive": "Method", "fallback": "Method"}


GROUP = re.compile(r"^type\s*\(", re.M)
GROUPED = re.compile(r"^[ \t]+(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?[ \t]+(?P<what>struct\b|interface\b|\S)", re.M)


def _begin(m):
    """Where a match's first character that isn't blank is."""
    return m.start() + len(m[0]) - len(m[0].lstrip())


def parse_go(text):
    src, out = Source(text), []
    for head, kind in GO:
        for m in head.finditer(src.code):
            owner = m.groupdict().get("owner")
            out.append(src.span(m.start(), f"{owner}.{m['name']}" if owner else m["name"], kind))
    for g in GROUP.finditer(src.code):
        end, at = _group_end(src.code, g.end() - 1), g.end()
        while m := GROUPED.search(src.code, at, end):
            kind = {"struct": "Struct", "interface": "Interface"}.get(m["what"], "Type")
            own = src.span(_begin(m), m["name"], kind)
            out.append(own)
            at = max(m.end(), own[6])
    return out


def _group_end(code, at):
    depth = 0
    for m in re.compile(r"[()]").finditer(code, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.start()
    return len(code)


def parse_script(text):
    src, out = Source(text), []
    for head, kind in SCRIPT:
        for m in head.finditer(src.code):
            out.append(src.span(_begin(m), m["name"], kind))
    for owner, kind, _, _, _, a, z in list(out):
        if kind == "Struct":
            for m in MEMBER.finditer(src.code, a, z):
                if m["name"] not in WORDS:
                    out.append(src.span(_begin(m), f"{owner}.{m['name']}", "Method"))
    return out


def parse_solidity(text):
    src, out, tops = Source(text), [], []
    for m in SOLIDITY_TOP.finditer(src.code):
        got = src.span(_begin(m), m["name"], "Interface" if m["what"] == "interface" else "Contract")
        tops.append(got)
        out.append(got)
    for m in SOLIDITY.finditer(src.code):
        start = _begin(m)
        name = m["name"] or m["what"]
        owner = next((t[0] for t in tops if t[5] < start <= t[6]), "")
        kind = SOLIDITY_KINDS.get(m["what"], "Method" if owner else "Function")
        out.append(src.span(start, f"{owner}.{name}" if owner else name, kind))
    return out


PARSERS = {"go": parse_go, "typescript": parse_script, "javascript": parse_script, "solidity": parse_solidity}


def spans_of(language, text):
    """Sorted (name, kind, start_line, end_line, body) of one file; unknown languages have none."""
    if not text or language not in PARSERS:
        return []
    return sorted({x[:5] for x in PARSERS[language](text) if x[0] and x[4]}, key=lambda x: (x[2], -x[3], x[0]))


def symbols(files, key="path", language="language", text="text"):
    """One row per symbol of each file: key, language, name, kind, start_line, end_line, body."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = [(k, g, *s) for k, g, t in zip(b[key], b[language], b[text]) for s in spans_of(g, t)]
            yield pd.DataFrame(rows, columns=[key, language, "name", "kind", "start_line", "end_line", "body"])

    kinds = dict(files.dtypes)
    return files.select(key, language, F.coalesce(text, F.lit("")).alias(text)).mapInPandas(run, f"`{key}` {kinds[key]}, `{language}` string, {SPANS}")
