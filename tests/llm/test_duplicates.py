"""Exact de-duplication, the n-gram join and repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from replylens.llm import components, exact_dedup, ngram_join, queries, substring_dedup

DELETED = dict.fromkeys([0x20, *range(0x09, 0x0E)])


def _equal_texts(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        clean = (text or "").translate(DELETED)
        groups[hashlib.sha256(clean.encode()).hexdigest()].append((doc_id, len(text or "")))
    return groups


def test_exact_duplicates_equal_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op4_exact_dedup(spark, sf).collect()}
    groups = _equal_texts([(r.doc_id, r.text) for r in docs.collect()])
    for sha, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0]))[0]
        for doc_id, _ in members:
            r = got[doc_id]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (
                best, len(members), doc_id == best, sha,
            )
    assert len(got) == docs.count()


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_duplicates_on_hard_rows(hard, nothing, monkeypatch, fan_in):
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    found = exact_dedup.exact_duplicates(hard.repartition(7)).collect()
    assert len(found) == hard.count()
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    empty = [r for r in found if r.doc_id in (3, 4, 5)]
    assert {r.keep_id for r in empty} == {5} and {r.group_size for r in empty} == {3}
    assert {r.keep_id for r in found if r.doc_id in (1, 2, 6)} == {1}
    stays = exact_dedup.drop_exact_duplicates(hard)
    assert stays.columns == hard.columns
    assert stays.count() == len({r.text_sha256 for r in found})
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_a_repeated_row_stays_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id bigint, text string")
    assert sorted(exact_dedup.drop_exact_duplicates(rows).collect()) == [(1, "a"), (1, "b")]


def _shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def _linked(rows, k, percent):
    """{doc_id: {(set size, smallest doc_id reached)}} over all pairs."""
    sets = [(doc_id, _shingles(text, k)) for doc_id, text in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(sets)), key=lambda i: len(sets[i][1]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            a, b = sets[i][1], sets[j][1]
            if not a or 100 * len(a) < percent * len(b):
                break
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    out = defaultdict(set)
    for i, (doc_id, s) in enumerate(sets):
        out[doc_id].add((len(s), least[root(i)]))
    return out


def _near_copies(n):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for group in range(3):
        base = [word() for _ in range(draw.randint(60, 90))]
        for _ in range(n):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "percent", "unit"), [(3, 90, 256), (5, 80, 256), (3, 90, 4), (2, 60, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, k, percent, unit):
    monkeypatch.setattr(ngram_join, "UNIT", unit)
    rows = _near_copies(25)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = defaultdict(set)
    for r in ngram_join.link_components(table, k=k, percent=percent).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got == _linked(rows, k, percent)


def test_join_query_equals_all_pairs(spark, sf, docs):
    got = defaultdict(set)
    for r in queries.op1_ngram_jaccard(spark, sf).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got == _linked([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


def test_join_on_hard_rows(hard, nothing):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(hard).collect()}
    assert {(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 1, 7)} <= got
    assert any(r[0] is None for r in got)
    stays = ngram_join.drop_near_duplicates(hard)
    assert stays.columns == hard.columns
    assert sorted(r.doc_id for r in stays.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9, 9]
    assert ngram_join.link_components(nothing).count() == 0
    assert ngram_join.drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("same_text", [False, True])
def test_ten_thousand_rows_without_id(spark, same_text):
    """Rows of one id do not meet each other's classes: 10,000 of them are no 10^8 pairs."""
    base = [" ".join(f"g{g}w{i}" for i in range(40)) for g in range(2500)]
    text = lambda i: base[0] if same_text else base[i % 2500] + (" more" if i % 4 == 1 else "")
    rows = [(None, text(i)) for i in range(10_000)] + [(7, base[0] + " end")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = ngram_join.link_components(table).collect()
    assert len(got) == 10_001
    assert {r.component_id for r in got} == {None}
    assert {r.n_shingles for r in got if r.doc_id == 7} == {39}
    stays = ngram_join.drop_near_duplicates(table).collect()
    assert {r.doc_id for r in stays} == {None} and len(stays) == 10_000


def test_near_copies_are_decided_row_by_row(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [
        (1, text), (2, text + " more"), (2, "nothing like any other text of the table"), (2, ""), (2, None),
        (None, other), (3, other + " more"), (4, other),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    stays = {(r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(table).collect()}
    assert stays == {rows[i] for i in (0, 2, 3, 4, 5)}


def test_traversal_bounds_never_lose_a_pair():
    draw = np.random.Generator(np.random.PCG64(1))
    base = draw.integers(1, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(draw.choice(base, draw.integers(1, 40))) for _ in range(60)]
    sets.sort(key=len)
    tree = ngram_join.SignatureTree(sets, 256)
    for percent in (50, 80):
        found = set()
        for a, b, most in ngram_join.candidate_pairs(tree, tree, percent, True):
            found |= set(zip(a.tolist(), b.tolist()))
            for i, j, m in zip(a, b, most):
                assert len(np.intersect1d(sets[i], sets[j])) <= m
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    assert (i, j) in found


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)]
    edges += [(200, 201), (201, 202), (202, 200), (300, 300)]
    table = spark.createDataFrame(edges, "u bigint, v bigint")
    got = dict(components.components(table).collect())
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200, 202: 200}
    assert got == want
    assert components.components(table.limit(0)).count() == 0


def _without_repeats(rows, length):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = defaultdict(list)
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(x for x, g in zip(raw, gone) if not g)
        out[doc_id].append((len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return {doc_id: sorted(rows) for doc_id, rows in out.items()}


def _found(table):
    out = defaultdict(list)
    for r in table.collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {doc_id: sorted(rows) for doc_id, rows in out.items()}


@pytest.mark.parametrize("length", [64, 100, 200])
def test_repeated_strings_equal_brute_force(spark, length):
    draw = random.Random(2)
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    shared = noise(260)
    rows = [
        (1, "a" * 500), (2, "ab" * 300), (3, None), (4, ""), (5, "x" * 199), (7, "a" * 250),
        (6, "".join(draw.choice("ab") for _ in range(2000))), (None, "q" * 300),
        (8, "é한" * 100), (8, "é한" * 100), (8, "zz" + "é한" * 90),
    ]
    rows += [(100 + i, noise(300) + shared[i:] + noise(200)) for i in range(20)]
    text = rows[-1][1]
    rows += [(200, text[:400]), (201, text[100:420]), (202, text[:600]), (203, text[:600])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert _found(substring_dedup.remove_repeats(table, length=length)) == _without_repeats(rows, length)


def test_repeated_strings_query(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert _found(queries.op8_substring_dedup(spark, sf)) == _without_repeats(rows, 200)


def test_repeated_strings_on_hard_rows(hard, nothing):
    rows = [(r.doc_id, r.text) for r in hard.collect() if r.doc_id != 7]
    got = _found(substring_dedup.remove_repeats(hard.where("doc_id is null or doc_id <> 7"), length=64))
    assert got == _without_repeats(rows, 64)
    long = _found(substring_dedup.remove_repeats(hard))[7]
    assert long[0][:3] == (150_000, 150_000, 1)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_ten_thousand_equal_rows(spark):
    """An equal row adds no runs to the others': 10,000 of them are no 10^8 runs."""
    draw = random.Random(4)
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    text, other = noise(700), noise(300)
    rows = [(5, text)] * 10_000 + [(None, text[:250] + other), (6, other[:150] + text[300:600])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = _found(substring_dedup.remove_repeats(table))
    whole = (700, 700, 1, hashlib.sha256(b"").hexdigest())
    assert got[5] == [whole] * 10_000
    assert got[None] == [(550, 250, 1, hashlib.sha256(other.encode()).hexdigest())]
    assert got[6] == [(450, 300, 1, hashlib.sha256(other[:150].encode()).hexdigest())]


def test_sliding_minimum():
    draw = np.random.Generator(np.random.PCG64(2))
    values = draw.integers(0, 50, 300, dtype=np.uint64)
    for width in (1, 2, 7, 137, 300):
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert substring_dedup.sliding_minimum(values, width).tolist() == want
