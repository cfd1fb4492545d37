"""Column expressions: identities, paths, tokens, snippets, redaction, vectors.

All are built from Spark's own functions, so they stay inside the JVM. Lengths
that the engine's rules count in bytes use octet_length.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: Language tags by file extension.
LANGUAGES = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".sol": "solidity", ".md": "markdown", ".markdown": "markdown"}
#: Words that a query's keywords leave out.
STOPWORDS = ("the", "and", "for", "with", "this", "that", "how", "what", "why", "when", "where", "which", "from", "into", "onto", "out", "off", "all")
#: Words that the evaluation's tokens leave out.
EVAL_STOPWORDS = (
    "the", "and", "of", "to", "in", "for", "on", "with", "by", "is", "be", "are", "this", "that", "as", "an", "or", "if",
    "it", "at", "from", "we", "into", "was", "were", "has", "have", "had", "but", "not",
    "그리고", "또는", "또한", "그러나", "하지만", "및", "에서", "에게", "에는", "에서는",
)
#: Separators of code tokens ("-" and "_" are parts of identifiers).
SEPARATORS = r"[ \t\n\r./\\#:;,()\[\]{}<>\"'`!?=+*|&^~]+"
SUBWORDS = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<!^)[_-]"
TRUNCATED = "\n// ... [TRUNCATED]"


def text(col):
    """A text column without nulls: the engine reads null as empty."""
    return F.coalesce(col, F.lit(""))


# identities


def content_hash(col):
    return F.sha2(text(col).cast("binary"), 256)


def chunk_id(file, start, end, content):
    return F.sha2(F.concat(file, F.lit("\n"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("\n"), content), 256)


# paths


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def language_of(path):
    ext, out = extension(path), F.lit("")
    for lang in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin([e for e, g in LANGUAGES.items() if g == lang]), lang).otherwise(out)
    return out


def is_test_path(path, lang):
    base = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(path == "", False)
        .when(lang == "go", base.endswith("_test.go"))
        .when(lang == "typescript", base.rlike(r"\.(test|spec)\.tsx?$"))
        .when(lang == "javascript", base.rlike(r"\.(test|spec)\.jsx?$"))
        .when(lang == "solidity", base.endswith(".t.sol") | F.arrays_overlap(F.split(path, "/"), F.array(F.lit("test"), F.lit("tests"))))
        .otherwise(False)
    )


def dirname(path):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def glob_regex(glob, doublestar=True):
    """An anchored regex of a path glob: `*` and `?` stay within a segment, `**` spans segments where allowed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if doublestar and glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if doublestar and glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            to = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : to].replace("\\", "\\\\") + "]", to
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(path, glob, doublestar=True):
    return path.rlike(glob_regex(glob, doublestar))


def matches_any(path, globs, doublestar=True):
    out = F.lit(False)
    for g in globs:
        out = out | glob_match(path, g, doublestar)
    return out


def ignored(path, patterns):
    """Directory patterns (ending in "/") are anchored at the root; others match the path or its last part."""
    base, out = F.element_at(F.split(path, "/"), -1), F.lit(False)
    for p in (x.strip() for x in patterns):
        if not p:
            continue
        out = out | (path.startswith(p) | (path == p[:-1]) if p.endswith("/") else glob_match(path, p, False) | glob_match(base, p, False))
    return out


# words


def slugify(col):
    s = F.regexp_replace(F.lower(text(col)), r"[^\p{L}\p{Nd}]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "section").otherwise(s)


def collapse_whitespace(col):
    return F.regexp_replace(F.regexp_replace(text(col), r"[ \t\n\r]+", " "), "^ | $", "")


def keywords(col):
    found = F.split(F.lower(F.regexp_replace(text(col), r"[^A-Za-z0-9]+", " ")), " ")
    return F.filter(found, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOPWORDS))


def code_tokens(col):
    """Lower-cased tokens of code text: each run between separators, then its camel- and snake-case parts."""
    raw = F.filter(F.split(text(col), SEPARATORS), lambda w: w != "")

    def parts(w):
        low = F.lower(w)
        plain = w.rlike(r"^\p{Ll}+$")  # nothing to cut: the usual case, without looking around each letter
        subs = F.filter(F.transform(F.split(w, SUBWORDS), lambda s: F.lower(s)), lambda s: (F.octet_length(s) >= 2) & (s != low))
        none = F.array().cast("array<string>")
        own = F.when(F.octet_length(low) >= 2, F.array(low)).otherwise(none)
        return F.when(plain, own).otherwise(F.concat(own, subs))

    return F.flatten(F.transform(raw, parts))


#: Words of small letters of two bytes at least, which code_tokens keeps as they are.
_BOUNDARY = SEPARATORS.removeprefix("[").removesuffix("]+")
SMALL_WORDS = rf"(?<![^{_BOUNDARY}])(?:\p{{Ll}}{{2,}}+|[\p{{Ll}}&&[^a-z]])(?![^{_BOUNDARY}])"


def code_token_bag(col):
    """The tokens of code_tokens in another order, for where it doesn't matter: only what isn't a word of small letters is looked at word by word."""
    return F.concat(F.regexp_extract_all(text(col), F.lit(SMALL_WORDS), F.lit(0)), code_tokens(F.regexp_replace(text(col), SMALL_WORDS, " ")))


def eval_tokens(col):
    """Lower-cased runs of a-z, 0-9 and Hangul of two characters at least, without stop words."""
    found = F.split(F.lower(text(col)), r"[^a-z0-9\p{IsHangul}]+")
    return F.filter(found, lambda w: (F.char_length(w) > 1) & ~w.isin(*EVAL_STOPWORDS))


def plain_words(col):
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text(col)), r"[^\p{L}\p{Nd}_]+"), lambda w: w != "")


def symbol_key(col):
    return F.regexp_replace(F.regexp_replace(F.lower(text(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def pascal_symbols(col):
    """ASCII words that begin with a capital and hold a small letter, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(text(col), "[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Z][A-Za-z0-9]*[a-z]")))


def expand_aliases(intent, aliases):
    """intent with the keywords of all aliases whose phrase it holds: `... [aliases: a, b]`."""
    low, found = F.lower(intent), F.array().cast("array<string>")
    for phrase in sorted(aliases):
        words = F.array(*[F.lit(w) for w in aliases[phrase]])
        found = F.concat(found, F.when(F.contains(low, F.lit(phrase.lower())), words).otherwise(F.array().cast("array<string>")))
    kept = F.array_sort(F.array_distinct(found))
    return F.when(F.size(kept) == 0, intent).otherwise(F.concat(intent, F.lit(" [aliases: "), F.array_join(kept, ", "), F.lit("]")))


def plan_symbols(col):
    """Capitalised identifiers, with one dotted part, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text(col), F.lit(r"\b[A-Z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)?\b"), F.lit(0)))


#: The heading over the files that a plan expects to change, and what ends that part.
EXPECTED_HEAD = r"(?im)^\s*(?:#{1,6}|\*\*)\s*expected\s*(?:file|change)s?\s*(?:\*\*)?\s*:?\s*$"
EXPECTED_END = r"(?m)^\s*(?:#{1,6}\s+\S|\*\*[^*\n]+\*\*\s*:?\s*$)"


def plan_steps(col):
    """A plan's text before the heading over its expected files."""
    return F.regexp_replace(F.get(F.split(text(col), EXPECTED_HEAD, 2), F.lit(0)), r"^\s+|\s+$", "")


def expected_files(col):
    """Paths of the bullets under that heading, up to the next heading, each once, in order."""
    rest = F.coalesce(F.get(F.split(text(col), EXPECTED_HEAD, 2), F.lit(1)), F.lit(""))
    own = F.get(F.split(rest, EXPECTED_END, 2), F.lit(0))
    return F.array_distinct(F.regexp_extract_all(own, F.lit(r"(?m)^\s*[-*+]\s+([^\s:]+)"), F.lit(1)))


def judge_verdict(col):
    """struct(score, rationale) of a judge's answer, fenced or not, or null; scores are clamped to 0..1.

    The whole answer is tried first, then the first object without inner
    braces that names a score; score 0 without a rationale says nothing.
    """
    fenced = F.regexp_extract(col, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(text(col)))

    def told(s):
        v = F.from_json(s, "score double, rationale string")
        score = F.coalesce(v["score"], F.lit(0.0))
        why = F.coalesce(v["rationale"], F.lit(""))
        ok = F.try_parse_json(s).isNotNull() & s.startswith("{") & ~((score == 0) & (why == ""))
        return F.when(ok, F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), why.alias("rationale")))

    return F.coalesce(told(body), told(F.regexp_extract(body, r'(?s)\{[^{}]*"score"[^{}]*\}', 0)))


def major_minor(col):
    """struct(major, minor) of a version text, or null where it isn't one."""
    part = F.split(F.trim(text(col)), r"\.", 3)
    first, second = F.trim(F.get(part, F.lit(0))), F.trim(F.get(part, F.lit(1)))
    digits = r"^[+-]?[0-9]+$"
    ok = first.rlike(digits) & (second.isNull() | second.rlike(digits))
    return F.when(ok, F.struct(first.cast("int").alias("major"), F.coalesce(second.cast("int"), F.lit(0)).alias("minor")))


def short_sha(col):
    return F.substring(text(col), 1, 12)


def intent_hash(col):
    """The first twelve hexadecimal digits of a text's SHA-256: how logs name an intent."""
    return F.substring(content_hash(col), 1, 12)


def repo_of(url):
    """owner/name of a repository's remote address."""
    ssh = F.regexp_extract(url, r"^git@[^:]*:(.*?)(?:\.git)?$", 1)
    web = F.regexp_replace(F.regexp_replace(url, r"\.git$", ""), r"^https?://github\.com/", "")
    return F.when(url.startswith("git@") & F.contains(url, F.lit(":")), ssh).otherwise(web)


def convention_file(package):
    """The name under which a package's conventions are stored."""
    return F.concat(package, F.lit("/<convention>"))


# snippets and chunks


def lines(col):
    return F.split(text(col), "\n", -1)


def _filled(line):
    return F.regexp_replace(line, r"[\s\x{85}\x{a0}]+", "") != ""


def signature_only(col):
    return F.coalesce(F.get(F.filter(lines(col), _filled), F.lit(0)), F.lit(""))


def signature_with_context(col, n=5):
    """The first line, blank or not, and the next n lines that are not blank."""
    own = lines(col)
    rest = F.slice(F.filter(F.slice(own, F.lit(2), F.size(own)), _filled), 1, n)
    return F.array_join(F.concat(F.slice(own, 1, 1), rest), "\n")


def header_text(col, n=50):
    return F.array_join(F.slice(lines(col), 1, n), "\n")


def truncate_bytes(col, cap):
    """Text of at most cap bytes, with a mark where it was cut; a character that the cut would split is left out."""

    def head(n):
        raw = col.cast("binary")
        whole = lambda i: ~F.hex(F.substring(raw, i + 1, 1)).between("80", "BF")  # noqa: E731  a character ends at byte i
        at = F.when(whole(n), n)
        for back in (1, 2):
            if n > back:
                at = at.when(whole(n - back), n - back)
        return F.substring(raw, F.lit(1), at.otherwise(max(0, n - 3))).cast("string")

    room = cap - len(TRUNCATED)
    cut = head(cap) if room <= 0 else F.concat(head(room), F.lit(TRUNCATED))
    return F.when(F.octet_length(col) > cap, cut).otherwise(col)


def line_windows(col, max_tokens, bytes_per_token=4):
    """array of (from_line, to_line, body): windows of about max_tokens; one window for short text."""
    own, cap = lines(col), max_tokens * bytes_per_token
    size = F.octet_length(text(col))
    mean = F.greatest(F.lit(1), F.ceil(size / F.size(own)).cast("int"))
    step = F.greatest(F.lit(1), F.floor(F.lit(cap) / mean).cast("int"))
    step = F.when(size <= cap, F.size(own)).otherwise(step)
    return F.transform(F.sequence(F.lit(0), F.size(own) - 1, step), lambda i: F.struct((i + 1).alias("from_line"), F.least(i + step, F.size(own)).alias("to_line"), F.array_join(F.slice(own, i + 1, step), "\n").alias("body")))


def embed_text(kind, lang, file, symbol, symbol_kind, body):
    """The text that is embedded for a chunk: a line of context, then the body."""
    label = F.when(lang == "", "unknown").otherwise(lang)
    where = F.concat(F.lit("language: "), label, F.lit(". file: "), file, F.lit("."))
    tail = F.concat(F.lit("\n\n"), body)
    return (
        F.when(kind == "file_header", F.concat(where, F.lit(" file header."), tail))
        .when(kind == "file_full", F.concat(where, F.lit(" whole file."), tail))
        .when(kind == "doc", F.concat(where, F.lit(" section: "), symbol, F.lit(" ("), symbol_kind, F.lit(")."), tail))
        .when(kind == "pr_background", F.concat(F.lit("pull request background. file: "), file, F.lit("."), tail))
        .when(kind == "pr_solution", F.concat(F.lit("pull request solution. file: "), file, F.lit("."), tail))
        .when(kind == "commit_message", F.concat(F.lit("commit message. file: "), file, F.lit("."), tail))
        .when((symbol != "") & (symbol_kind != ""), F.concat(where, F.lit(" symbol: "), symbol, F.lit(" ("), symbol_kind, F.lit(")."), tail))
        .when(symbol != "", F.concat(where, F.lit(" symbol: "), symbol, F.lit("."), tail))
        .otherwise(F.concat(where, tail))
    )


def redact(col, patterns):
    """struct(status, text, redactions, blocked_by, matches): patterns are (id, regex, action), tried on the original text.

    matches names the patterns that were found, in their order, with their actions.
    """
    out, by, any_ = col, F.lit(None).cast("string"), F.lit(False)
    for name, regex, action in patterns:
        hit = col.rlike(regex)
        any_ = any_ | hit
        if action == "block":
            by = F.when(hit, F.lit(name)).otherwise(by)
        elif action == "redact":
            out = F.when(hit, F.regexp_replace(out, regex, f"[REDACTED:{name}]")).otherwise(out)
    status = F.when(by.isNotNull(), "blocked").when(any_, "redacted").otherwise("clean")
    kept = F.when(by.isNotNull(), "").otherwise(out)
    count = F.when(status == "redacted", F.regexp_count(out, F.lit(r"\[REDACTED:"))).otherwise(0)
    told = [F.when(col.rlike(regex), F.struct(F.lit(name).alias("id"), F.lit(action).alias("action"))) for name, regex, action in patterns]
    found = F.filter(F.array(*told), lambda m: m.isNotNull()) if told else F.array().cast("array<struct<id:string,action:string>>")
    return F.struct(
        status.alias("status"), kept.alias("text"), count.alias("redactions"),
        F.coalesce(by, F.lit("")).alias("blocked_by"), found.alias("matches"),
    )


def pr_section(body, names):
    """The text under the first heading of one of the names, up to the next heading."""
    head = rf"(?im)^\s*(?:#{{1,6}}\s+|\*\*)(?:{'|'.join(names)})(?:\s*\*\*)?\s*:?\s*$"
    rest = F.get(F.split(body, head, 2), F.lit(1))
    return F.trim(F.regexp_replace(F.coalesce(F.get(F.split(rest, r"(?m)^\s*(?:#{1,6}\s+|\*\*)", 2), F.lit(0)), F.lit("")), r"^\s+|\s+$", ""))


def marker_tier(marker):
    """1 for established markers, 2 for this engine's own, 3 for all else."""
    return F.when(marker.isin("CRITICAL", "IMPORTANT", "WARNING", "Deprecated"), 1).when(marker.isin("INVARIANT", "CONSENSUS", "SECURITY"), 2).otherwise(3)


# vectors (computed in doubles)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b):
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def normalized_distance(d):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - d / 2))


def normalized_bm25(score):
    return F.when(score <= 0, 0.0).otherwise(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + score))


def unit(v):
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def truncate_vector(v, dim):
    return unit(F.slice(v, 1, dim))


def fnv1a(word):
    """32-bit FNV-1a of an ASCII word, as a bigint."""
    return F.aggregate(F.split(word, ""), F.lit(2166136261).cast("bigint"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(4294967295))))


def pool(rows, mask, mode="mean"):
    """The unit vector of a text's token vectors: the first one (cls), the last one whose mask is 1 (last), or the mean of those."""
    if mode == "cls":
        return unit(F.get(rows, F.lit(0)))
    own = F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: F.transform(x["v"], lambda y: y.cast("double")))
    if mode == "last":
        return unit(F.element_at(own, -1))
    total = F.reduce(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), F.get(own, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / F.size(own)))
