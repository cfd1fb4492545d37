"""Mixing sources to target weights with exact budgets.

A document's size is its number of whitespace words. Sources, in code-point
order with null last, weigh 3, 1, 2, repeating; together they are to give
SHARE of all words. A source gives at most LIMIT times its words; what it can't
give is shared anew by weight. That fixed point is min(cap, level * weight)
with one level for all, and sources reach their caps in the order of
cap / weight, so the level comes from running sums over that order.

Within a source, documents are sorted by a hash-random key (MD5 of the salted
doc_id) and taken until the source's budget is used up: whole epochs first,
then a last part, cut inside a document if need be. Prefix sums are
distributed: the first digits of the key split each source into BUCKETS even
ranges, the buckets' sums give where each begins, and running sums within a
bucket do the rest. One source may hold most rows; its ranges are still dealt
to many tasks.

Defined cases: a null or wordless text has size 0 and is never taken; null
sources form one source, the last; documents of equal key are ordered by
doc_id, then by size, then by a hash of the text; a row without doc_id has the
key of its text; repeated rows are documents each, with their own part of the
budget; an empty table gives an empty result; the result doesn't depend on how
rows are partitioned; the columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.llm.textkit import settle, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
#: Hexadecimal digits of the key that name a range: 16 ** 3 ranges of each source.
DIGITS = 3
SALT = "mix:"


def word_count(text):
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes, weights=WEIGHTS, share=SHARE, limit=LIMIT):
    """(source, source_size, target, budget) of (source, source_size); further columns are carried.

    One row per source: the number of sources is that of a catalogue, not of
    documents, and only these sums are brought together.
    """
    keys = [c for c in sizes.columns if c != "source_size"]
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    own = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    own = own.withColumn("cap", F.col("source_size") * float(limit)).withColumn("at", F.col("cap") / F.col("weight"))
    rising = Window.partitionBy(F.lit(0)).orderBy("at", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    own = own.withColumn("want", F.sum("source_size").over(whole) * float(share))
    left = F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own = own.withColumn("level", left / heavy)
    # sources below the level keep their cap; the first one above it sets the level
    free = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(whole)
    own = own.withColumn("target", F.when(free.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), free["level"] * F.col("weight"))))
    return own.select(*keys, "source_size", "target", F.round("target").cast("bigint").alias("budget"))


def mix_key():
    """The hash-random key of a row: of its doc_id, or of its text where it has none."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(SALT), own).cast("binary"))


def mix(docs, weights=WEIGHTS, share=SHARE, limit=LIMIT):
    """doc_id, source, size, source_size, target, taken, key of each row; taken: words the mix takes, repeats counted."""
    rows = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), mix_key().alias("_key")), "sizes")
    told = take(rows, weights, share, limit)
    return told.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"), F.col("_key").alias("key"))


def take(rows, weights=WEIGHTS, share=SHARE, limit=LIMIT, ties=()):
    """rows (doc_id, source, _size, _key, ...) with source_size, target and _taken added.

    Each row is its own: its place is its own running sum, so repeated rows
    share a source's budget as any others do.
    """
    spot = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # no null, so that both sides are dealt alike
    rows = rows.withColumn("_spot", spot).withColumn("_bucket", F.substring("_key", 1, DIGITS))
    buckets = settle(rows.groupBy("_spot", "source", "_bucket").agg(F.sum("_size").alias("_held")), "buckets")
    want = targets(buckets.groupBy("_spot", "source").agg(F.sum("_held").alias("source_size")), weights, share, limit)
    ahead = Window.partitionBy("_spot").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = buckets.withColumn("_base", F.coalesce(F.sum("_held").over(ahead), F.lit(0))).drop("source", "_held").join(want.drop("source"), "_spot")
    inside = Window.partitionBy("_spot", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "_size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(begin.hint("merge"), ["_spot", "_bucket"])
    at = F.col("_base") + F.col("_before")
    epochs = F.expr("budget div source_size")
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.col("_size") * epochs + F.least(F.col("_size"), F.greatest(F.lit(0), rest - at)))
    return both.withColumn("_taken", taken.cast("bigint")).drop("_spot", "_bucket", "_base", "_before", "budget")


def mixed_documents(docs, weights=WEIGHTS, share=SHARE, limit=LIMIT):
    """The mix itself, with the columns of docs: each row as often as whole epochs take it, and cut where the budget ends.

    Sizes are summed in a pass of their own; the texts then move once, to the
    range of keys that they fall into.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("_size"), mix_key().alias("_key"), F.xxhash64("text").alias("_tie"))
    taken = take(own, weights, share, limit, ties=["_tie"]).filter("_taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))
    each = taken.select("_row", "_size", "_taken", F.explode(copies).alias("_copy"))
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    whole = left >= F.col("_size")
    text = F.when(whole, F.col("_row.text")).otherwise(cut_words(F.col("_row.text"), left))
    new = {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(F.char_length(text)).cast("bigint")
    return each.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in names])


def cut_words(text, n):
    """The first n words of a text, with one space between."""
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(found, F.lit(1), n.cast("int")), " ")


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))) AS key,
         coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0) AS size
  FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS weight,
             2.0::double * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS rise FROM w),
l AS (SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY rise, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, rise) AS level FROM l WHERE level <= rise),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l),
g AS (SELECT *, round(target)::bigint AS budget FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM d)
SELECT p.doc_id, p.size::bigint AS size, g.source_size, g.target,
       CASE WHEN g.source_size = 0 THEN 0
            ELSE p.size * (g.budget // g.source_size) + least(p.size, greatest(0, g.budget % g.source_size - p.before)) END::bigint AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
