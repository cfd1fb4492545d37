"""Mixing (op 3), token-ID files (op 6), chat formatting (op 7) and the pipeline."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalex.llm import chat_format, decontaminate, jaccard_join, mixing, registry, token_orc
from stratalex.llm.textkit import scratch_path


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_say_what_sql_says(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    order = list(want.columns)
    want, got = (x.sort_values(order).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) and (want.astype(str) == got.astype(str)).all().all()


def fill(sizes, weights, share=1.5, limit=2):
    """Targets by sharing the excess anew until none is above its cap."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        heavy = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / heavy > limit * sizes[i]]
        if not over:
            return [out.get(i, left * weights[i] / heavy) for i in range(len(sizes))]
        for i in over:
            out[i] = limit * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return [out[i] for i in range(len(sizes))]


def test_targets_are_those_of_resharing(spark):
    for sizes in ([100, 5, 7, 300, 1, 0, 50], [10], [1, 1, 1000], [0, 0]):
        rows = mixing.targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")).collect()
        got = [r.target for r in sorted(rows, key=lambda r: r.source)]
        assert got == pytest.approx(fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mix_of_nasty_rows(nasty, empty):
    rows = mixing.mix(nasty).collect()
    assert len(rows) == nasty.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == round(own[0].target)
    again = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(nasty.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r["size"], r.taken) for r in rows)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(nasty)
    assert out.columns == nasty.columns and {r.key for r in out.collect()} <= {"k", None}


def test_mixed_documents_hold_what_the_mix_takes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == want


HARD = ["a  b", "a   b", " a", "a ", "x\ny z", "a \nb", "\n\n a b", "don't we'll I'm", "<|endoftext|> a b", "foo <|endoftext|> bar", "é ü 日本 語", "1 22 333 a1b2", "tab\t x", "", None, "a 's b", "a　 b", "a  b", "x\x1c y", " ", "a\r\nb c", "​b c", "﻿a b"]


def test_token_files_hold_what_the_tokenizer_says(spark, nasty, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_orc.vocabulary())
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(HARD)], "doc_id long, text string").repartition(3)
    start = 0
    for r, (i, t) in zip(token_orc.save_and_read(docs).orderBy("doc_id").collect(), sorted((100 - i, t) for i, t in enumerate(HARD))):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_orc.save_and_read(nasty).orderBy("start").collect()
    assert len(rows) == nasty.count() and rows[0].doc_id is None
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert token_orc.save_and_read(empty).count() == 0


def test_token_files_are_ordered_and_can_be_looked_up(spark, sf):
    path = scratch_path(spark, "ids-test")
    token_orc.write_ids(spark.read.parquet(f"{sf}/documents.parquet"), path)
    low = token_orc.read_ids(spark, path).groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("f")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("f").collect()
    assert all(x.z < y.a for x, y in zip(low, low[1:]))
    one = token_orc.read_ids(spark, path, [17, 42])
    assert sorted(r.doc_id for r in one.collect()) == [17, 42]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().executedPlan().toString()


LOG = [
    (1, 0, 0, "message", "user", "hi <|x \\| \\"), (1, 1, 1, "message", "assistant", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 5, "edit", None, "E"), (1, 1, 6, "delta", None, "F"),
    (1, 2, 3, "message", "user", "q"), (1, 3, 4, "delta", "assistant", "zz"), (1, 3, 7, "regenerate", None, ""), (1, 3, 8, "delta", None, "y1"), (1, 3, 9, "delta", None, None),
    (None, None, 1, "message", "a\nb<|", "t<"), (2, 0, 0, "message", "u", "x"), (2, 0, 0, "message", "u", "x"), (3, 0, 0, "edit", None, "only"),
]


def test_logs_fold_and_read_back(spark):
    log = spark.createDataFrame(LOG, "conv_id long, turn long, seq long, op string, role string, text string").repartition(4)
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat_format.parse(chat_format.format_log(log)).collect()}
    assert got == {1: [("user", "hi <|x \\| \\"), ("assistant", "EF"), ("user", "q"), ("assistant", "y1")], None: [("a\nb<|", "t<")], 2: [("u", "x"), ("u", "x")], 3: [("", "only")]}
    assert chat_format.format_log(log.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    hard = ["<|", "\\<|", "<\\|", "\\\\", "<|im_start|>user\nx<|im_end|>\n", "<\\n|", "", "<", "<<|", "\\n"]
    df = spark.createDataFrame([(x,) for x in hard], "x string")
    for r in df.select("x", chat_format.escape(F.col("x")).alias("e"), chat_format.unescape(chat_format.escape(F.col("x"))).alias("y"), chat_format.unescape_role(chat_format.escape_role(F.col("x"))).alias("z")).collect():
        assert r.x == r.y == r.z and "<|" not in r.e


def test_chat_formatting_has_no_python(spark, sf):
    plan = chat_format.op7_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "mixing", "token ids"]
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == first.columns
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        ids = {r.doc_id for r in out.collect()}
        if name == "near copies":
            assert ids == {d for d, (_, c) in jaccard_join.brute(rows, k=5, num=80).items() if d == c}
        if name == "decontamination":
            assert ids == {d for d, t in rows for n, hit, _ in [decontaminate.brute(t, items)] if not (hit and 20 * hit >= n)}
        docs = out
    words = docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    told = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert told.count() == docs.count() and words > 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def words_of(text):
    return len((text or "").split())


def test_pipeline_of_nasty_rows(spark, nasty, sf, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table go through all stages."""
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, docs in (("rows", nasty), ("none", nasty.limit(0))):
        d = str(tmp_path / name)
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{d}/{t}.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d).cache()
            assert out.columns == nasty.columns
            docs = out
        told = corpus_pipeline.run(spark, d).collect()
        assert len(told) == docs.count() and (name == "none") == (not told)


def test_the_mix_of_repeated_rows_keeps_its_budget(spark):
    rows = [(i // 2 if i < 8 else None, "w " * (i // 2 % 4 + 1), ["a", None][i % 2]) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.4, 1, 1.5):
        want = sum(r.taken for r in mixing.mix(docs, share=share).collect())
        by = {r.source: round(r.target) for r in mixing.mix(docs, share=share).collect()}
        out = mixing.mixed_documents(docs, share=share).collect()
        assert sum(words_of(r.text) for r in out) == want == sum(by.values())
        assert {s: sum(words_of(r.text) for r in out if r.source == s) for s in by} == by


def fold_by_hand(log):
    """{conv_id: [(role, text)]} of events, one by one."""
    turns = {}
    for conv, turn, seq, op, role, text in sorted(log, key=lambda e: (e[0], e[1], e[2], e[3])):
        own = turns.setdefault((conv, turn), [])
        if not own or op == "message":
            own.append(["", ""])
        if op in ("message", "edit"):
            own[-1][1] = text or ""
        elif op == "regenerate":
            own[-1][1] = text or ""
        else:
            own[-1][1] += text or ""
        if role is not None:
            own[-1][0] = role
    out = {}
    for conv, turn in sorted(turns):
        out.setdefault(conv, []).extend(map(tuple, turns[conv, turn]))
    return out


def test_random_logs_fold_as_by_hand_and_keep_their_loss_mask(spark):
    import random

    rng = random.Random(6)
    pieces = ["a", "<|im_end|>", "\\", "é🎉", "", "<|", "\n", "<\\|", " ", "x" * 300]
    log = []
    for conv in range(25):
        seq = 0
        for turn in range(rng.randrange(1, 6)):
            for _ in range(rng.randrange(1, 7)):
                op = rng.choice(["message", "delta", "delta", "edit", "regenerate"])
                role = rng.choice([None, "user", "assistant", "a\nb<|"])
                log.append((conv, turn, seq, op, role, rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))])))
                seq += 1
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, op string, role string, text string").repartition(5)
    out = chat_format.parse(chat_format.format_log(df)).withColumn("loss", chat_format.loss_text()).collect()
    want = fold_by_hand(log)
    assert {r.conv_id: [(m.role, m.text) for m in r.messages] for r in out} == want
    for r in out:
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        for s in r.loss_spans:  # a span begins after its turn's head and ends before its mark
            assert r.formatted[: s.start].endswith(chat_format.START + "assistant\n") and r.formatted[s.end :].startswith(chat_format.END + "\n")
    again = chat_format.format_log(spark.createDataFrame([(1, 0, 0, "message", "assistant", "é" * 200_000)] * 2, df.schema)).withColumn("loss", chat_format.loss_text()).first()
    assert again.loss == "é" * 400_000 and len(again.loss_spans) == 2


def test_rows_of_one_id_keep_their_place_over_files(spark, tmp_path):
    docs = spark.createDataFrame([(5, f"text number {i % 40} of it") for i in range(400)] + [(i, "x y") for i in range(9)], "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    token_orc.encode(docs.repartitionByRange(7, "doc_id", token_orc.tie())).sortWithinPartitions("doc_id", "tie").write.orc(path)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_orc.layout(spark, path).collect())
    assert len(got) == 409 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_stripes_are_skipped_and_filters_are_there(spark, tmp_path):
    """Row indexes, Bloom filters and stripes of a written file, as its own reader tells them."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 50 + k).cast("string"), 512) for k in range(6)]).alias("text"))
    path = f"file://{tmp_path}/ids"
    old, token_orc.STRIPE_BYTES = token_orc.STRIPE_BYTES, 256 * 1024
    try:
        token_orc.write_ids(docs, path)
    finally:
        token_orc.STRIPE_BYTES = old
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [str(p) for p in tmp_path.glob("ids/part-*.orc")]
    stripes = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stripes += reader.getStripes().size()
        assert reader.getRowIndexStride() == token_orc.STRIDE_ROWS
        assert reader.getSchema().toString() == "struct<doc_id:bigint,tie:bigint,ids:array<int>>"
    assert stripes >= len(files) > 0
    one = token_orc.read_ids(spark, path, [4321])
    assert one.count() == 1 and token_orc.read_ids(spark, path, [10**9]).count() == 0
    rows = one.select("doc_id")
    assert [r.doc_id for r in rows.collect()] == [4321]
    leaf = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    scanned = leaf.metrics().apply("numOutputRows").value()
    assert 1 <= scanned <= 2 * token_orc.STRIDE_ROWS  # the other strides were skipped
