"""License scans with MinHash bands over text windows, with DataFrame functions only.

Words are runs of a-z and 0-9 after A-Z are lower-cased; shingles are K
consecutive words, known by 64-bit hashes. A template of at least LONG shingles
is cut into windows of WIDTH shingles at every offset, a document into windows
of WIDTH at every STRIDE, put together from blocks of STRIDE shingles: the
MinHash values of a window are the least of its two blocks'. ROWS values form a
band; windows that agree in one of BANDS bands name a template. A window that
is copied whole agrees in all bands, one of similarity 0.8 in at least one with
probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.98, and a copied template has
several windows. Shorter templates have windows of one shingle, for which the
MinHash value is the shingle's hash and agreement is certain.

Templates that were named are verified exactly: the share of a template's
shingles that the whole document holds must reach CONTAINMENT.

Templates of up to TEMPLATE_WORDS words in all are literals in the plan: the
scan then needs no shuffle. More of them, any number, are tables: documents'
window keys and shingles are joined with the templates' (broadcast up to
BROADCAST_WORDS words of templates, shuffled beyond), and the matches alone are
brought together. Both ways find the same and use no Python.

Defined cases: null or empty texts, and texts of fewer than K words, match
nothing; templates of fewer than K words are refused; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stratalex.llm.textkit import table

K = 5
WIDTH, STRIDE = 16, 8
LONG = 24
ROWS, BANDS = 2, 4
CONTAINMENT = 0.8
#: Words of templates up to which they are literals, and up to which their tables are broadcast (a million rows).
TEMPLATE_WORDS, BROADCAST_WORDS = 1_000, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public notices by which texts state their license.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "gpl-line": "Released under the GNU General Public License",
    "bsd-line": "Released under the BSD 3-Clause License",
    "cc-by-line": "Licensed under a Creative Commons Attribution 4.0 International License",
    "rights-line": "All rights reserved. No part of this publication may be reproduced",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def words_of(text):
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def words(text):
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def seeds():
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(ROWS * BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


def xored(seed):
    # a lambda of two parameters would be given each hash's place
    return lambda h: h.bitwiseXOR(F.lit(seed))


def least(hashes):
    """The MinHash values of an array of hashes: for each seed the least hash XOR seed."""
    return F.array(*[F.array_min(F.transform(hashes, xored(s))) for s in seeds()])


def band_keys(values):
    """One key for each band of an array of MinHash values."""
    return [F.xxhash64(F.lit(b), *[values[ROWS * b + r] for r in range(ROWS)]) for b in range(BANDS)]


def template_rows(spark, templates):
    if any(len(words_of(t)) < K for t in templates.values()):
        raise ValueError(f"a template has fewer than {K} words")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    return with_shingles(rows, "body")


def with_shingles(df, text):
    own = df.withColumn("_w", words(F.col(text))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    at = F.sequence(F.lit(0), F.size("_w") - K)
    return own.withColumn("_s", F.when(F.size("_w") < K, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(K)]))))


def template_windows(shingles):
    """Band keys of the windows of a long template, one array for each window."""
    at = F.sequence(F.lit(1), F.size(shingles) - WIDTH + 1)
    return F.transform(at, lambda i: F.array(*band_keys(least(F.slice(shingles, i, F.lit(WIDTH))))))


def document_windows(blocks):
    """Band keys of a document's windows; blocks: the MinHash values of each STRIDE shingles."""

    def window(b):
        a, c = F.get(blocks, b), F.coalesce(F.get(blocks, b + 1), F.get(blocks, b))
        return F.array(*band_keys([F.least(a[i], c[i]) for i in range(ROWS * BANDS)]))

    none = F.array().cast("array<array<bigint>>")
    return F.when(F.size(blocks) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(blocks) - 2)), window)).otherwise(none)


def with_blocks(own):
    """own, which has the shingles _s, with _b, the MinHash values of its blocks."""
    return own.withColumn("_b", blocks_of(F.col("_s")))


def compile_templates(spark, templates=TEMPLATES):
    """(short: {hash: licenses}, bands: {key: licenses}, sets: {license: distinct hashes})."""
    short, keys, sets = {}, {}, {}
    rows = template_rows(spark, templates)
    wins = template_windows(F.col("_s"))
    rows = rows.select("license", F.col("_s").alias("s"), F.when(F.size("_s") >= LONG, wins).alias("bands"))
    for r in rows.toLocalIterator():
        sets[r.license] = sorted(set(r.s))
        for h in sets[r.license] if r.bands is None else ():
            short.setdefault(h, set()).add(r.license)
        for key in {k for w in r.bands or () for k in w}:
            keys.setdefault(key, set()).add(r.license)
    return short, keys, sets


def scan(docs, templates=None):
    """doc_id, n_words, licenses (sorted names), containment (the largest) of each row of docs (doc_id, text).

    templates: {name: text}, or a table (license, body) of any size.
    """
    templates = TEMPLATES if templates is None else templates
    if not isinstance(templates, dict):
        return scan_tables(docs, templates)
    if sum(len(words_of(t)) for t in templates.values()) > TEMPLATE_WORDS:
        return scan_tables(docs, docs.sparkSession.createDataFrame(sorted(templates.items()), "license string, body string"))
    short, keys, sets = compile_templates(docs.sparkSession, templates)
    own = with_blocks(with_shingles(docs.select("doc_id", "text"), "text"))
    wins = document_windows(F.col("_b"))
    named = F.array_distinct(F.concat(F.filter(F.flatten(wins), lambda k: k.isin(list(keys))), F.filter("_s", lambda h: h.isin(list(short)))))
    own = own.select("doc_id", F.size("_w").cast("bigint").alias("n_words"), named.alias("named"), F.col("_s").alias("s"))
    by_name = {}
    for k, names in [*keys.items(), *short.items()]:
        for n in names:
            by_name.setdefault(n, []).append(k)

    def share(name):
        held = F.size(F.array_intersect(F.col("s"), F.lit(sets[name]))) / F.lit(float(len(sets[name])))
        return F.when(F.exists("named", lambda k: k.isin(by_name[name])), held).otherwise(F.lit(0.0))

    shares = F.when(F.size("named") > 0, F.array(*[F.struct(F.lit(n).alias("name"), share(n).alias("share")) for n in sorted(sets)]))
    found = F.filter(F.coalesce(shares, F.array().cast("array<struct<name:string,share:double>>")), lambda x: x["share"] >= CONTAINMENT)
    own = own.select("doc_id", "n_words", found.alias("found"))
    return own.select("doc_id", "n_words", F.transform("found", lambda x: x["name"]).alias("licenses"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("containment"))


def bound(value, f):
    """f of a value that is worked out once: inside f it is a variable, not an expression that each use repeats."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingles_of(text):
    """The shingles of a text, as with_shingles has them."""
    none = F.array().cast("array<bigint>")

    def cut(h):
        each = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
        return F.when(F.size(h) < K, none).otherwise(each)

    return bound(words(text), lambda w: bound(F.transform(w, lambda x: F.xxhash64(x)), cut))


def blocks_of(shingles):
    """The MinHash values of each STRIDE shingles, as with_blocks has them."""
    at = F.sequence(F.lit(0), F.ceil(F.size(shingles) / STRIDE).cast("int") - 1)
    each = F.transform(at, lambda b: least(F.slice(shingles, b * STRIDE + 1, F.lit(STRIDE))))
    return F.when(F.size(shingles) > 0, each).otherwise(F.array().cast("array<array<bigint>>"))


def scan_tables(docs, templates):
    """scan() by joins with the tables of the templates (license, body)."""
    size = F.size(words(F.col("body")))
    told = templates.agg(F.min(size).alias("least"), F.sum(size).alias("words")).first()
    if told.least is not None and told.least < K:
        raise ValueError(f"a template has fewer than {K} words")
    small = F.broadcast if (told.words or 0) <= BROADCAST_WORDS else lambda df: df
    kept = lambda s: F.when(F.size(s) >= LONG, F.array_distinct(F.flatten(template_windows(s)))).otherwise(F.array_distinct(s))
    own = shingles_of(F.col("body"))
    keys = templates.select("license", F.explode(bound(own, kept)).alias("key"))
    sets = templates.select("license", F.explode(bound(own, lambda s: F.transform(F.array_distinct(s), lambda h: F.named_struct(F.lit("h"), h, F.lit("n"), F.size(F.array_distinct(s)))))).alias("x")).select("license", "x.*")
    rid = F.xxhash64(F.lit(9), F.col("doc_id").isNull(), "doc_id", "text").alias("rid")
    own = docs.select("doc_id", rid, "text")
    asked = bound(shingles_of(F.col("text")), lambda s: F.array_distinct(F.concat(F.flatten(bound(blocks_of(s), document_windows)), s)))
    named = own.select("rid", F.explode(asked).alias("key")).join(small(keys), "key").select("rid", "license").distinct()
    held = own.select("rid", F.explode(F.array_distinct(shingles_of(F.col("text")))).alias("h")).join(small(sets), "h").select("rid", "license", "n", "h").distinct()
    share = held.groupBy("rid", "license").agg((F.count("*") / F.first("n")).alias("share")).filter(F.col("share") >= CONTAINMENT)
    found = share.join(named, ["rid", "license"], "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list("license")).alias("licenses"), F.max("share").alias("containment"))
    rows = own.select("doc_id", "rid", F.size(words(F.col("text"))).cast("bigint").alias("n_words")).join(found, "rid", "left")
    return rows.select("doc_id", "n_words", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def op5_license_scans(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.round("containment", 6).alias("containment"))


def _sql():
    rows = ",\n".join(f"('{n}', [{', '.join(repr(' '.join(w[i : i + K])) for i in range(len(w) - K + 1))}])" for n, w in ((n, words_of(t)) for n, t in sorted(TEMPLATES.items())))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n_words, list_distinct(list_transform(range(1, len(w) - {K} + 2), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) AS s FROM w),
t(license, t) AS (VALUES {rows}),
u AS (SELECT license, list_distinct(t) AS t FROM t),
m AS (SELECT doc_id, license, len(list_intersect(s, t))::double / len(t) AS share FROM s, u WHERE list_has_any(s, t)),
g AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses, max(share) AS containment FROM m WHERE share >= {CONTAINMENT} GROUP BY doc_id)
SELECT s.doc_id, s.n_words::bigint AS n_words, coalesce(g.n, 0) AS n_licenses, coalesce(g.licenses, '') AS licenses, round(coalesce(g.containment, 0), 6)::double AS containment
FROM s LEFT JOIN g ON s.doc_id IS NOT DISTINCT FROM g.doc_id
"""


OP5_SQL = _sql()
