"""Facts of Go source files by scanning tokens: comments, calls, constructors, receivers, imports.

No Go parser is at hand. The scanner knows comments, strings and brackets, so
heads, calls and their first arguments are told apart; it doesn't check that a
file compiles.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)|(?P<rune>'(?:\\.|[^'\\\n])+')"
    r"|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign><-|:=|\S)",
    re.S,
)
OPEN, CLOSE = "([{", ")]}"


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    last: int


class Call(NamedTuple):
    """A call: its name, the places of its first token and of its brackets, and its lines."""

    name: str
    at: int
    open: int
    close: int
    line: int
    last: int


class Scan:
    """The tokens of one file, without and with its comments."""

    def __init__(self, text):
        self.tokens, self.comments = [], []
        line, at, after = 1, 0, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            last = line + m[0].count("\n")
            token = Token(m.lastgroup, m[0], line, last)
            if token.kind == "comment":
                self.comments.append((token, len(self.tokens)))
            else:
                self.tokens.append(token)
            line, at = last, m.end()
        self.pairs, open_ = {}, []
        for i, t in enumerate(self.tokens):
            if t.text in OPEN and t.kind == "sign":
                open_.append(i)
            elif t.text in CLOSE and t.kind == "sign" and open_:
                self.pairs[open_.pop()] = i
        self.begins = {z: a for a, z in self.pairs.items()}

    def text(self, i):
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i):
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def call_at(self, i):
        """The call whose name ends at token i, or None; heads of functions are no calls."""
        if self.kind(i) != "name" or self.text(i + 1) != "(" or self.kind(i + 1) != "sign" or self.text(i) in KEYWORDS:
            return None
        if self.head_of(i):
            return None
        close = self.pairs.get(i + 1)
        if close is None:
            return None
        first, name = i, self.text(i)
        if self.text(i - 1) == ".":
            first = i - 2
            if self.kind(i - 2) == "name" and self.text(i - 3) != ".":
                name = f"{self.text(i - 2)}.{name}"
            while self.text(first - 1) == "." and first >= 2:
                first -= 2
        return Call(name, first, i + 1, close, self.tokens[max(first, 0)].line, self.tokens[close].last)

    def head_of(self, i):
        """True for the name in `func name(` and `func (r T) name(`."""
        if self.text(i - 1) == "func":
            return True
        if self.text(i - 1) != ")":
            return False
        begin = self.begins.get(i - 1)
        return begin is not None and self.text(begin - 1) == "func"

    def calls(self):
        for i in range(len(self.tokens)):
            c = self.call_at(i)
            if c:
                yield c

    def literal(self, at, close):
        """The content of the first argument if it is one string literal, else None."""
        if self.kind(at) == "string" and (self.text(at + 1) == "," or at + 1 == close):
            return self.text(at)[1:-1]
        return None


KEYWORDS = {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "type", "var", "const", "import", "map", "chan", "interface", "struct", "else"}


def comment_body(raw):
    if raw.startswith("//"):
        return raw[2:].strip()
    return raw[2:].removesuffix("*/").strip()


# invariants

#: Comment markers of the first and second tier, and words that make an error message a rule.
MARKERS = {"CRITICAL": 1, "IMPORTANT": 1, "WARNING": 1, "Deprecated": 1, "INVARIANT": 2, "CONSENSUS": 2, "SECURITY": 2}
RULE_WORDS = ("must", "cannot", "consensus", "validator", "byzantine", "invariant", "forbidden", "illegal")
MARKER = re.compile(r"([A-Za-z][A-Za-z0-9_]+)\s*[:\-]")
TIER3_PER_FILE = 10
#: Paths whose tests state rules all the same.
RULE_TESTS = ("systemcontracts/test/",)


def is_rule(text):
    low = text.lower()
    return any(w in low for w in RULE_WORDS)


def _rule(scan, call):
    """(marker, text) if a call states a rule."""
    if call.name not in ("panic", "Errorf", "errors.New", "fmt.Errorf") or call.close == call.open + 1:
        return None
    at = call.open + 1
    own = scan.literal(at, call.close)
    if own is not None:
        return (call.name, own) if own and is_rule(own) else None
    for i in (at, at + 2):  # f( or pkg.f(
        inner = scan.call_at(i) if i == at or scan.text(at + 1) == "." else None
        if inner:
            ends = scan.text(inner.close + 1) == "," or inner.close + 1 == call.close
            if ends and inner.name in ("fmt.Sprintf", "fmt.Errorf"):
                text = scan.literal(inner.open + 1, inner.close)
                if text and is_rule(text):
                    return f"{call.name}+{inner.name}", text
            return None
    if call.name == "panic" and scan.kind(at) == "name" and (scan.text(at + 1) == "," or at + 1 == call.close):
        near = _comment_above(scan, call.line)
        return ("panic(ident)", near) if near else None
    return None


def _groups(scan):
    """Runs of comments without code or an empty line between: (last line, joined bodies)."""
    out = []
    for token, place in scan.comments:
        body = comment_body(token.text)
        if out and out[-1][2] == place and token.line <= out[-1][0] + 1:
            out[-1] = (token.last, f"{out[-1][1]} {body}".strip(), place)
        else:
            out.append((token.last, body, place))
    return out


def _comment_above(scan, line):
    for last, body, _ in _groups(scan):
        if last < line <= last + 3 and is_rule(body):
            return body
    return None


def invariants(path, text, most=TIER3_PER_FILE):
    """(tier, marker, start_line, end_line, text) of a Go file: marked comments, then up to `most` calls that state rules.

    Tests state no rules by calls, but for those under RULE_TESTS.
    """
    scan = Scan(text)
    out = []
    for token, _ in scan.comments:
        body = comment_body(token.text)
        m = MARKER.match(body)
        if m and m[1] in MARKERS:
            out.append((MARKERS[m[1]], m[1], token.line, token.last, body))
    if path.endswith("_test.go") and not any(x in path.replace("\\", "/") for x in RULE_TESTS):
        return out
    found, beyond = 0, -1
    for call in sorted(scan.calls(), key=lambda c: (c.at, -c.close)):
        if found >= most:
            break
        if call.at <= beyond:  # inside one that was taken
            continue
        told = _rule(scan, call)
        if told:
            out.append((3, told[0], call.line, call.last, told[1]))
            found, beyond = found + 1, call.close
    return out


# conventions

#: Calls that tell how a package logs.
LOGGERS = {
    "log15.New": "log15", "log15.Info": "log15", "log15.Warn": "log15", "log15.Error": "log15", "zap.L": "zap", "zap.S": "zap",
    "zap.NewProduction": "zap", "slog.Info": "slog", "slog.Warn": "slog", "slog.Error": "slog", "slog.Debug": "slog",
    "log.Printf": "stdlib_log", "log.Print": "stdlib_log", "log.Println": "stdlib_log", "log.Fatal": "stdlib_log",
}


def conventions(path, text):
    """{(group, name): n} of one Go file; group "" holds the plain counters."""
    out = {("", "file_count"): 1}

    def add(group, name, n=1):
        out[group, name] = out.get((group, name), 0) + n

    if path.endswith("_test.go"):
        add("", "test_files")
    scan = Scan(text)
    for i, t in enumerate(scan.tokens):
        if t.kind == "name" and t.text == "import":
            to = scan.pairs.get(i + 1, i + 1) if scan.text(i + 1) == "(" else i + 2
            for j in range(i + 1, to + 1):
                if scan.kind(j) == "string":
                    if "stretchr/testify" in scan.text(j):
                        add("", "testify_uses")
                    elif "golang.org/x/sync/errgroup" in scan.text(j):
                        add("", "errgroup_uses")
        elif t.text == "func" and scan.text(i + 1) == "(" and scan.kind((scan.pairs.get(i + 1) or -2) + 1) == "name":
            if scan.text(scan.pairs[i + 1] + 2) == "(" and scan.kind(i + 2) == "name" and scan.text(i + 3) not in (")", ".", "["):
                add("receivers", scan.text(i + 2))
        elif t.text == "func" and scan.kind(i + 1) == "name" and scan.text(i + 1).startswith("New"):
            add("", "new_constructors")
        elif t.text == "range" and scan.text(i - 1) in (":=", "=") and scan.text(i - 3) == "," and scan.text(i - 2) in ("tc", "tt"):
            add("", "table_driven")
        elif t.text == "sync" and scan.text(i + 1) == "." and scan.text(i + 2) in ("Mutex", "RWMutex") and scan.text(i - 1) != ".":
            add("", "mutexes")
    for c in scan.calls():
        if c.name == "fmt.Errorf":
            own = scan.text(c.open + 1) if scan.kind(c.open + 1) == "string" and (scan.text(c.open + 2) == "," or c.open + 2 == c.close) else ""
            add("errors", "fmt.Errorf_wrap" if "%w" in own else "fmt.Errorf_plain")
        elif c.name == "errors.New":
            add("errors", "errors.New")
        elif c.name == "errors.Wrap":
            add("errors", "pkg/errors.Wrap")
        elif c.name == "make" and "chan" in (scan.text(c.open + 1), scan.text(c.open + 2) if scan.text(c.open + 1) == "<-" else ""):
            add("", "channels")
        elif c.name in LOGGERS:
            add("loggers", LOGGERS[c.name])
    return out
