from hypothesis import given, settings
from hypothesis import strategies as st

from stratalex.sources import parsers

GO = """package a

// func Not() {}
type Cache struct {
	m map[string]int // {
}

type Store interface {
	Get(k string) int
}

type ID string

func New(n int) *Cache {
	s := "}"
	return &Cache{}
}

func (c *Cache) Get(k string) int {
	if k == "" {
		return 0
	}
	return c.m[k]
}
"""
TS = """export class Server {
  private n = 1;
  async listen(port: number): Promise<void> {
    if (port) { return; }
  }
}
export interface Opts { a: string }
type Name = string;
export const add = (a: number, b: number) => {
  return a + b;
};
function run() {
  return 1;
}
"""
SOL = """contract Token is Base {
  event Moved(address a);
  struct Item { uint a; }
  modifier only() { _; }
  constructor() { x = 1; }
  function move(address to) public only returns (bool) {
    return true;
  }
}
function free() pure {
}
"""


def told(language, text):
    return {(n, k, a, z) for n, k, a, z, _ in parsers.spans_of(language, text)}


def test_go():
    assert told("go", GO) == {("Cache", "Struct", 4, 6), ("Store", "Interface", 8, 10), ("ID", "Type", 12, 12), ("New", "Function", 14, 17), ("Cache.Get", "Method", 19, 24)}


def test_typescript():
    assert {("Server", "Struct", 1, 6), ("Server.listen", "Method", 3, 5), ("Opts", "Interface", 7, 7), ("Name", "Type", 8, 8), ("add", "Function", 9, 11), ("run", "Function", 12, 14)} <= told("typescript", TS)


def test_solidity():
    assert told("solidity", SOL) == {
        ("Token", "Contract", 1, 9), ("Token.Moved", "Event", 2, 2), ("Token.Item", "Struct", 3, 3), ("Token.only", "Modifier", 4, 4), ("Token.constructor", "Constructor", 5, 5), ("Token.move", "Method", 6, 8), ("free", "Function", 10, 11),
    }


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(parsers.PARSERS)), st.lists(st.sampled_from(["func f(", "type T struct {", "}", "{", "\n", "class A {", "contract C {", "function g()", '"', "'", "`", "//", "/*", "*/", "(", ")", ";", "x", "é"]), max_size=40).map(" ".join))
def test_any_text_gives_sound_spans(language, text):
    for name, kind, a, z, body in parsers.spans_of(language, text):
        assert 1 <= a <= z and name and kind and body


def test_symbols_of_files(spark):
    df = spark.createDataFrame([("a.go", "go", GO), ("b.sol", "solidity", SOL), ("c.md", "markdown", "# x"), ("d.go", "go", None)], "path string, language string, text string")
    got = parsers.symbols(df)
    assert got.count() == 12 and got.filter("path = 'a.go' and name = 'Cache.Get'").first().start_line == 19


def test_grouped_types():
    text = "package p\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB interface{ F() }\n\tC = int\n\tD []string\n)\n\nfunc f() {}\n"
    assert [(n, k, a, z) for n, k, a, z, _ in parsers.spans_of("go", text)] == [("A", "Struct", 4, 6), ("B", "Interface", 7, 7), ("C", "Type", 8, 8), ("D", "Type", 9, 9), ("f", "Function", 12, 12)]
