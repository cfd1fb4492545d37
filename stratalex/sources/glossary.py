"""Aliases from markdown: rows of tables with a Hangul key, and glosses `phrase (english)`; a YAML writer and loaders of YAML files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stratalex.functions import exprs as X

HANGUL = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
#: Particles that don't begin a phrase, and what a key doesn't begin with.
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "와", "과", "도")
DECORATION = r"^(?:[#><\[(=]|\*\*|//|[-*+] |```)"
ENDS = r"[).,;:?!\n]"


def _trim(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_hangul(c):
    return c.rlike(HANGUL)


def is_gloss(c):
    """At most 80 bytes of letters, digits, spaces and -_./ with a Latin letter among them."""
    return (F.octet_length(c) <= 80) & c.rlike(r"^[\p{L}\p{Nd} _./-]+$") & c.rlike("[A-Za-z]")


def last_phrase(c):
    """The last three words, at most, after the last sign, without leading particles; empty without Hangul."""
    own = F.regexp_extract(c, rf"(?s)((?:(?!{ENDS}).)*)$", 1)
    words = F.filter(F.split(_trim(own), r"\s+"), lambda w: w != "")
    lead = F.coalesce(F.get(F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*PARTICLES), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(words))
    rest = F.slice(words, lead + 1, F.greatest(F.size(words) - lead, F.lit(0)))
    kept = F.when(F.size(rest) > 3, F.slice(rest, F.size(rest) - 2, F.lit(3))).otherwise(rest)
    out = F.array_join(kept, " ")
    return F.when(has_hangul(out), out).otherwise("")


def english_tokens(cell):
    """Texts in backticks, glosses in parentheses and identifier-like words of a table's cell."""
    ticks = F.regexp_extract_all(cell, F.lit(r"`([^`]*)`"), F.lit(1))
    rest = F.regexp_replace(cell, r"^(?:.*?`[^`]*`)+", "")  # what follows the last text in backticks
    parens = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(r"\(([^)]*)\)"), F.lit(1)), _trim), is_gloss)
    words = F.filter(F.split(rest, r"[ \t,*()`]+"), lambda w: (F.octet_length(w) >= 3) & ~has_hangul(w) & w.rlike("[A-Za-z]"))
    own = F.transform(F.concat(ticks, parens, words), _trim)
    return F.filter(own, lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$"))


def table_rows(line):
    """array of (key, value) of a table's row whose first cell holds Hangul."""
    cells = F.split(line, r"\|", -1)
    first = F.when(_trim(F.get(cells, F.lit(0))) == "", 1).otherwise(0)
    last = F.when(_trim(F.element_at(cells, -1)) == "", F.size(cells) - 1).otherwise(F.size(cells))
    key, value = _trim(F.get(cells, first)), _trim(F.get(cells, first + 1))
    ok = _trim(line).startswith("|") & (F.size(cells) >= 3) & (last - first >= 2) & has_hangul(key) & (value != "") & ~value.startswith("---")
    found = F.transform(english_tokens(value), lambda v: F.struct(key.alias("key"), v.alias("value")))
    return F.when(ok, found).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def inline_glosses(line):
    """array of (key, value) of `phrase (english)` in a line."""
    # each piece ends at a parenthesis; what stands before it since the last one is its phrase
    parts = F.regexp_extract_all(line, F.lit(r"[^(]*\([^)]*\)"), F.lit(0))

    def gloss(p, i):
        before = F.array_join(F.slice(parts, F.lit(1), i), "")
        own = F.regexp_extract(p, r"^([^(]*)\(", 1)
        inner = _trim(F.regexp_extract(p, r"\(([^)]*)\)$", 1))
        key = last_phrase(F.regexp_replace(F.concat(before, own), r"\s+$", ""))
        return F.when((key != "") & is_gloss(inner), F.struct(key.alias("key"), inner.alias("value")))

    return F.filter(F.transform(parts, gloss), lambda x: x.isNotNull())


def glossary(docs, text="text"):
    """(phrase, keywords): sorted aliases of all lines of docs; values of more than 60 bytes and decorated keys are left out."""
    lines = docs.select(F.explode(X.lines(F.regexp_replace(X.text(F.col(text)), "\r\n?", "\n"))).alias("line"))
    lines = lines.filter(F.contains("line", F.lit("|")) | F.contains("line", F.lit("(")))
    each = lines.select(F.explode(F.concat(table_rows(F.col("line")), inline_glosses(F.col("line")))).alias("x")).select("x.*")
    own = each.filter((F.col("key") != "") & ~F.col("key").rlike(DECORATION) & (F.col("value") != "") & (F.octet_length("value") <= 60))
    pairs = own.distinct()  # pre-aggregated: a phrase has few keywords
    return pairs.groupBy(F.col("key").alias("phrase")).agg(F.array_sort(F.collect_list("value")).alias("keywords"))


def write_yaml(aliases, path):
    """Write (phrase, keywords) as a YAML file of sorted aliases; a glossary is as large as a language's terms, not as its texts."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("aliases:\n")
        for r in aliases.orderBy("phrase").toLocalIterator():
            if r.keywords:
                f.write(f"  {json.dumps(r.phrase, ensure_ascii=False)}:\n")
                f.writelines(f"    - {json.dumps(v, ensure_ascii=False)}\n" for v in r.keywords)


# YAML files


def load_yaml(path):
    """A YAML (or JSON) file's value."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    try:
        import yaml
    except ImportError as e:  # JSON is YAML too
        try:
            return json.loads(body)
        except ValueError:
            raise ImportError("reading YAML needs the yaml package") from e
    return yaml.safe_load(body)


def load_policy(path):
    """The validated rules of a policy file, in order; no path: none."""
    from stratalex.operators import rules

    return rules.validate_policy((load_yaml(path) or {}).get("categories") or []) if path else []


def load_aliases(path):
    """{phrase: [keywords]} of an alias file; phrases that are blank are refused."""
    out = {}
    for phrase, words in ((load_yaml(path) or {}).get("aliases") or {}).items():
        if not str(phrase).strip():
            raise ValueError("aliases: a blank phrase")
        out[str(phrase)] = [str(w) for w in words or []]
    return out


def load_fixture(spark, path):
    """(query_id, intent, file, from_line, to_line) of an evaluation's queries; ids are unique, intents and files not empty, ranges in order."""
    rows, seen = [], set()
    for q in (load_yaml(path) or {}).get("queries") or []:
        want = q.get("expected") or {}
        a, z = want.get("line_range") or (0, 0)
        if not q.get("id") or q["id"] in seen:
            raise ValueError(f"fixture: id {q.get('id')!r} is missing or occurs twice")
        if not q.get("intent") or not want.get("file") or a < 1 or z < a:
            raise ValueError(f"fixture: query {q['id']} lacks an intent, a file or a range of lines")
        seen.add(q["id"])
        rows.append((q["id"], q["intent"], want["file"], int(a), int(z)))
    return spark.createDataFrame(rows, "query_id string, intent string, file string, from_line int, to_line int")


def load_pull_fixture(spark, path):
    """(id, repo, pr_number, base_sha, changed_files, changed_symbols) of a set of pull requests to plan anew."""
    rows, seen = [], set()
    for e in (load_yaml(path) or {}).get("prs") or []:
        if not e.get("id") or e["id"] in seen or not e.get("repo") or int(e.get("pr_number") or 0) <= 0:
            raise ValueError(f"pull requests: entry {e.get('id')!r} is incomplete or occurs twice")
        seen.add(e["id"])
        rows.append((e["id"], e["repo"], int(e["pr_number"]), e.get("base_sha") or "", list(e.get("changed_files") or []), list(e.get("changed_symbols") or [])))
    return spark.createDataFrame(rows, "id string, repo string, pr_number int, base_sha string, changed_files array<string>, changed_symbols array<string>")


#: Languages that a project's configuration may name.
CONFIG_LANGUAGES = ("go", "typescript", "solidity", "markdown")


def load_project(path):
    """{"languages", "ignore", "file_header_lines", "build_roots", "important_symbols"} of a project's configuration.

    A version other than 1, unknown languages, negative numbers of lines, empty
    or absolute build roots and patterns that don't compile are errors.
    """
    import re

    told = load_yaml(path) or {}
    if str(told.get("schema_version") or "") != "1":
        raise ValueError("configuration: schema_version must be 1")
    languages = list(told.get("languages") or [])
    if [x for x in languages if x not in CONFIG_LANGUAGES]:
        raise ValueError(f"configuration: a language beyond {', '.join(CONFIG_LANGUAGES)}")
    lines = int((told.get("chunking") or {}).get("file_header_lines") or 0)
    if lines < 0:
        raise ValueError("configuration: file_header_lines is negative")
    roots = [str(r).strip() for r in told.get("build_roots") or []]
    if [r for r in roots if not r or r.startswith("/")]:
        raise ValueError("configuration: build_roots are paths within the repository")
    important = list(told.get("important_symbols") or [])
    for x in important:
        re.compile(x)
    return {
        "languages": languages, "ignore": list(told.get("ignore") or []), "file_header_lines": lines or 50,
        "build_roots": roots, "important_symbols": important,
    }


def is_important(symbol, patterns):
    """Whether one of the patterns occurs in a symbol's name; none does in an empty name."""
    out = F.lit(False)
    for p in patterns:
        out = out | symbol.rlike(p)
    return (symbol != "") & out
