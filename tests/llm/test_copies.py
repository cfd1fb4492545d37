"""Exact dedup (op 4) and the Jaccard join (op 9)."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from stratalex.llm import exact_dedup, jaccard_join


def test_fingerprints_compose_and_match_the_definition():
    rng = random.Random(1)
    xs = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 1023, 1024, 1025, 3000, 10240, 0, 7)]
    offs = np.cumsum([0] + [len(x) for x in xs])
    for x, got in zip(xs, exact_dedup.fingerprints(np.frombuffer(b"".join(xs), np.uint8), offs)):
        a = exact_dedup.fingerprint(x)
        assert (a[0] << 31 | a[1]) == got
        k = len(x) // 3
        assert exact_dedup.combine(exact_dedup.fingerprint(x[:k]), exact_dedup.fingerprint(x[k:]), len(x) - k) == a


def test_dedup_of_nasty_rows(nasty):
    rows = exact_dedup.groups(nasty).collect()
    assert len(rows) == nasty.count()
    by = defaultdict(list)
    for r in nasty.collect():
        by[r.text or ""].append(r.doc_id)
    for text, ids in by.items():
        own = [r for r in rows if r.sha == hashlib.sha256(text.encode()).digest()]
        assert len(own) == len(ids) == own[0].group_size
        assert {r.keep_id for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert sum(r.kept for r in own) == 1
    left = exact_dedup.dedup_exact(nasty)
    assert left.columns == nasty.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted(by)


def test_a_collision_separates_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda data, offs: np.zeros(len(offs) - 1, np.int64))
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs).collect()}
    assert rows == {1: (3, 2, False), 3: (3, 2, True), 2: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_dedup_of_nothing(empty):
    assert exact_dedup.groups(empty).count() == 0
    assert exact_dedup.dedup_exact(empty).count() == 0


def gray(seed):
    """Chains of edited texts around the threshold."""
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (1, 3, 4, 9, 20, 60, 200, 700):
        for _ in range(3):
            base = [rng.choice(voc) for _ in range(n)]
            for _ in range(10):
                x = list(base)
                for _ in range(rng.randrange(0, 1 + max(1, n * 3 // 100))):
                    x[rng.randrange(len(x))] = rng.choice(voc)
                if rng.random() < 0.3:
                    x = x[: -max(1, n // 20)] or x
                if rng.random() < 0.4:
                    base = x
                rows.append((len(rows), " ".join(x)))
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = gray(seed) + [(9000, None), (9001, ""), (9002, "A b"), (9003, "a  B")]
    want = jaccard_join.brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_blocks_of_a_large_key_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEET", 7)
    monkeypatch.setattr(jaccard_join, "SMALLEST", 2)
    rows = gray(11)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    assert got == jaccard_join.brute(rows)


def test_linked_sets_share_a_key():
    """The pigeonhole: two sets at the threshold have a retained part in common."""
    rng = np.random.default_rng(3)
    for n in (6, 7, 12, 40, 97, 300, 1500):
        for _ in range(30):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            most = int((1 - 0.85) * n / 0.85)  # rows that one side may have besides
            a = np.sort(np.unique(np.r_[both, rng.integers(0, 2**63, rng.integers(0, most + 1), dtype=np.uint64)]))
            b = np.sort(both)
            if 100 * len(b) < 85 * len(a):
                continue
            ka, _ = jaccard_join.keys_of(a, np.array([0, len(a)]))
            kb, _ = jaccard_join.keys_of(b, np.array([0, len(b)]))
            assert np.isin(ka, kb).any()


def test_join_of_nasty_rows(nasty, empty):
    rows = jaccard_join.link_components(nasty).collect()
    assert len(rows) == nasty.count()
    told = {r.doc_id: r for r in rows}
    assert told[6].component_id == told[5].component_id == 5
    assert told[7].component_id == told[8].component_id == 7
    assert told[0].n_shingles == 0 and told[0].component_id == 0
    kept = jaccard_join.keep_one(nasty)
    assert kept.columns == nasty.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 not in ids and 8 not in ids and len([i for i in ids if i == 5]) == 1 and {0, 1, 2, 50, None} <= set(ids)
    assert jaccard_join.link_components(empty).count() == 0


@pytest.mark.parametrize("num, small, large", [(80, 126, 157), (60, 61, 100), (30, 31, 100)])
def test_partners_of_any_threshold_share_a_key(num, small, large):
    sets = np.sort(np.random.default_rng(1).integers(0, 2**63, large).astype(np.uint64))
    keys, n = jaccard_join.keys_of(np.r_[sets[:small], sets], np.array([0, small, small + large]), num, 100)
    assert set(keys[: n[0]].tolist()) & set(keys[n[0] :].tolist())


def test_sketches_of_very_different_lengths_are_compared():
    sets = np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)
    none = np.zeros(0, np.int64)
    rows = [(i + 1, i + 1, n, jaccard_join.bit_sketch(sets[:n]), none) for i, n in enumerate((100, 500))]
    assert list(jaccard_join._close(0, rows, 20, 100)) == [(1, 2)]


def test_components_at_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for n in (126, 157, 180, 400):
        base = [f"v{rng.randrange(10**9)}" for _ in range(n + 3)]
        for part in (1, 0.81, 0.805, 0.79, 0.65):
            rows.append((len(rows), " ".join(base[: int(n * part) + 3])))
    base = [f"v{rng.randrange(10**9)}" for _ in range(160)]
    rows += [(100, " ".join(base)), (101, " ".join(base[:129]))]
    want = jaccard_join.brute(rows, num=80)
    assert want[101][1] == 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), num=80).collect()}
    assert got == want


def test_rows_without_id_or_with_a_used_one_keep_their_links(spark):
    base = [f"v{i}" for i in range(103)]
    a, b, c = " ".join(base), " ".join(base[4:] + [f"x{i}" for i in range(4)]), " ".join(base[10:] + [f"x{i}" for i in range(10)])
    schema = "doc_id long, text string"
    for mid in (None, 9):
        rows = [(1, a), (mid, b), (2, c)]
        got = {r.doc_id: r.component_id for r in jaccard_join.link_components(spark.createDataFrame(rows, schema)).collect()}
        assert got == {1: 1, mid: 1, 2: 1}
    other = " ".join(f"z{i}" for i in range(50))
    rows = [(7, a), (7, other), (7, other), (None, other + " more"), (None, "alone at last here it is"), (None, None), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(str, (r.component_id for r in jaccard_join.link_components(docs).collect()))) == sorted(map(str, [7, 7, 7, 7, None, None, None, 8]))
    kept = sorted((str(r.doc_id), r.text or "") for r in jaccard_join.keep_one(docs).collect())
    assert kept == sorted([("7", a), ("7", other), ("None", rows[4][1]), ("None", ""), ("None", ""), ("8", "")])
