"""Hard negatives, filter audit and line removal against brute force."""

import math
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from replylens.llm import filter_audit, hard_negatives, line_dedup

SPACES = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- hard negatives


def mined(rows, keep=5):
    """The contract, row by row."""
    usable = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        usable.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for anchor, label, v in usable:
        if anchor % 100:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(v, w)), other, l) for other, l, w in usable)
        )
        positives = [(s, o) for s, o, l in scored if l == label and o != anchor][:keep]
        for s, o in positives:
            window = [
                (t, n) for t, n, l in scored if l != label and -80 * s <= -100 * t <= -100 * s
            ]
            out += [(anchor, o, i + 1, n, -s, -t) for i, (t, n) in enumerate(window[:keep])]
    return sorted(out)


def vectors(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    return hard_negatives.integer_vectors(table.repartition(3))


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_CANDIDATES", 100)
    monkeypatch.setattr(hard_negatives, "TILE_BLOCKS", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)


def clustered(n, dims=8, seed=1):
    """Rows around ten centres that lie near each other; ids 0, 20, 40 .. so that a fifth
    are anchors."""
    rng = np.random.default_rng(seed)
    centres = np.ones(dims) + rng.normal(0, 0.4, (10, dims))
    out = []
    for i in range(n):
        label = int(rng.integers(0, 10))
        out.append((20 * i, label, (centres[label] + rng.normal(0, 0.2, dims)).astype("f4").tolist()))
    return out


def test_negatives_equal_brute_force_on_many_tiles(spark, small_tiles):
    rows = clustered(500)
    expected = mined(rows)
    assert len(expected) > 1000
    assert as_rows(hard_negatives.mine(vectors(spark, rows))) == expected


def test_negatives_with_ties_repeats_and_hard_rows(spark, small_tiles):
    rows = [(100 * i, i % 2, [1.0, 0.5]) for i in range(8)]  # every score ties
    rows += [(3, 1, [1.0, 0.5]), (3, 1, [1.0, 0.5]), (200, 0, [0.9, 0.5])]  # repeated ids
    rows += [
        (None, 1, [1.0, 1.0]), (300, None, [1.0, 1.0]), (400, 1, None), (500, 1, [None, 1.0]),
        (600, 1, [float("nan"), 1.0]), (700, 0, [float("inf"), 1.0]), (900, 0, []),
        (1000, 0, [0.0, 0.0]), (1100, 1, [-1.0, -0.5]), (1200, 1, [0.9]),
    ]
    assert as_rows(hard_negatives.mine(vectors(spark, rows))) == mined(rows)
    assert as_rows(hard_negatives.mine(vectors(spark, []))) == []
    lonely = [(100, 1, [1.0]), (101, 2, [1.0])]  # an anchor without positives
    assert as_rows(hard_negatives.mine(vectors(spark, lonely))) == []


@pytest.mark.parametrize("scale", [1.0, 3000.0, 60000.0])
def test_scores_are_exact_at_any_size(spark, scale):
    """Single precision, double precision and integers, by the size of the scores."""
    rows = [(i, l, [x * scale for x in v]) for i, l, v in clustered(60, dims=4, seed=2)]
    rows = [(i, l, [float(np.float32(min(x, 65000.0))) for x in v]) for i, l, v in rows]
    assert as_rows(hard_negatives.mine(vectors(spark, rows))) == mined(rows)


def test_tree_and_pruning():
    rng = np.random.default_rng(3)
    v = (rng.normal(0, 30, (40, 6)) + 200).astype(np.int32)
    parent, edge, depth = hard_negatives.spanning_tree(v)
    apart = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    assert np.allclose(edge[1:], apart[np.arange(1, 40), parent[1:]])
    assert depth[0] == 0 and (depth[1:] == depth[parent[1:]] + 1).all()
    # a minimum tree is no longer than the star around any row
    assert edge.sum() <= apart.sum(axis=1).min() + 1e-6


def test_candidates_outside_the_window_are_not_scored(monkeypatch):
    rng = np.random.default_rng(4)
    v = (rng.normal(0, 2, (30, 6)) + 200).astype(np.int32)
    parent, edge, depth = hard_negatives.spanning_tree(v)
    row = {
        "block": 0, "anchor_id": list(range(30)), "label": [0] * 30, "v": v.tolist(),
        "parent": parent.tolist(), "edge": edge.tolist(), "depth": depth.tolist(),
    }
    x = (rng.normal(0, 2, (900, 6)) + rng.integers(-300, 300, (900, 1))).astype(np.int32)
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    candidates = hard_negatives._Candidates(np.arange(900), np.ones(900, np.int64), x, norm)
    block = hard_negatives._Block.of(row, 6)
    top = np.full(30, 200 * 200 * 6, np.int64)
    window = hard_negatives._Negatives(block, 1000, np.arange(30), top)
    scored = []
    paired = hard_negatives._paired
    monkeypatch.setattr(
        hard_negatives, "_paired", lambda a, x, r, c: (scored.append(len(r)), paired(a, x, r, c))[1]
    )
    hard_negatives._search(window, candidates)
    anchor, score, candidate = window.pairs()
    full = v.astype(np.int64) @ x.astype(np.int64).T
    wanted = (full * 100 >= 80 * top[:, None]) & (full <= top[:, None])
    assert sorted(zip(anchor, candidate)) == sorted(zip(*np.nonzero(wanted)))
    assert (full[anchor, candidate] == score).all()
    assert scored and sum(scored) < full.size / 4


# ---------------------------------------------------------------- filter audit


def audited(docs, labels):
    """The contract, order by order."""
    good, toxic = defaultdict(bool), defaultdict(bool)
    for doc_id, quality, is_toxic in labels:
        good[doc_id] |= quality == 1
        toxic[doc_id] |= is_toxic == 1
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    rows = defaultdict(list)
    for doc_id, text, source in docs:
        text = text or ""
        words = "".join(" " if c in SPACES else c for c in text).split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > smallest[text],
        }
        known = doc_id is not None
        rows[source or ""].append((fails, known and good[doc_id], known and toxic[doc_id]))
    out = {}
    for part, members in rows.items():
        total = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                failing = [m for m in members if m[0][f]]
                only = [m for m in failing if sum(m[0].values()) == 1]
                total[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), len(only),
                    sum(m[1] for m in gone), sum(m[2] for m in gone),
                ]
        for part_, order, step in list(out):
            if part_ == part:
                out[part, order, step].append(total[order[step - 1]])
    return out


FILTER_DOCS = "doc_id bigint, text string, source string, part string, n int, cell string"
WORDS = ["alpha", "beta", "gamma", "Delta", "EPSILON", "zeta#", "ünï", "η"]


def audit(spark, docs, labels):
    table = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], FILTER_DOCS).repartition(3)
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    result = filter_audit.audit_filters(table, said)
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in result.collect()}
    assert result.columns[:3] == ["part", "filter_order", "step"]
    return got


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\x0b\n", "A" * 50, "a|b"]
    for n in (3, 150, 199, 200, 260):
        texts += [" ".join(rng.choices(WORDS, k=n)) for _ in range(2)]
        texts += [" ".join(f"w{i}" for i in range(n))]
        texts += [SPACES.join(f"w{i // 2}" for i in range(n)), f"${n}"]
    docs = [
        (rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "a", "b", "c"]))
        for _ in range(300)
    ]
    docs += docs[:20] + [(7, texts[6], "hot")] * 50 + [(None, texts[7], "hot")] * 50
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]))
              for _ in range(60)]
    got = audit(spark, docs, labels)
    assert got == audited(docs, labels)
    assert len(got) == 5 * 600  # null and '' are one part


def test_audit_of_empty_tables(spark):
    assert audit(spark, [], []) == {}
    assert audit(spark, [], [(1, 1, 1)]) == {}
    one = audit(spark, [(1, "x", "s")], [])
    assert one["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    assert one["s", "BACDE", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_audit_of_a_long_text(spark):
    docs = [(1, "Word " * 400_000, "s"), (2, "Word " * 400_000, "s")]
    got = audit(spark, docs, [(2, 1, 1)])
    assert got["s", "ABCDE", 2] == [0, 2, 0, 0, 1, 1, got["s", "ABCDE", 2][-1]]
    assert got == audited(docs, [(2, 1, 1)])


# ---------------------------------------------------------------- line removal


def cleaned(docs, min_chars=40, min_docs=5):
    """(doc_id, lines, dropped lines, text) by the contract; rows are documents."""
    holders = defaultdict(list)
    for doc_id, text in docs:
        for key in {key_of(line) for line in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders[key].append(doc_id)
    shared = {
        k: max((i for i in ids if i is not None), default=None)
        for k, ids in holders.items() if len(ids) >= min_docs
    }
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in shared or shared[key_of(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def key_of(line):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return line.strip(SPACES).translate(str.maketrans(upper, upper.lower()))


LINES = [
    "This very line stands in a good many of the documents", "THIS VERY line stands in a good many of the DOCUMENTS",
    "\t  This very line stands in a good many of the documents \r", "x" * 39, "x" * 40, "É" * 40, "é" * 40,
    "ß" * 39, "", "   ", "\x0b\x0c", " " + "y" * 39, "한국어 " * 10, "inner  blanks   count " * 3,
    "one\x85line with a next-line sign that is no break here",
]


def random_documents(n, seed=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = rng.choices(LINES, k=rng.randint(0, 6)) + [f"line of its own, number {i}, " + "z" * 30]
        rng.shuffle(lines)
        out.append((i, "\n".join(lines)))
    return out


def line_rows(spark, docs, **options):
    table = spark.createDataFrame(
        [(i, t, "d", 1) for i, t in docs], "doc_id bigint, text string, doc string, n_lines int"
    ).repartition(5)
    report = line_dedup.line_report(table, **options)
    return sorted((tuple(r) for r in report.collect()), key=repr)


@pytest.mark.parametrize("segment_lines", [1 << 21, 16])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines_equal_brute_force(spark, monkeypatch, segment_lines, broadcast_bytes):
    monkeypatch.setattr(line_dedup, "SEGMENT_LINES", segment_lines)
    docs = random_documents(120) + [(500, None), (501, ""), (502, "\n\n"), (503, " \t")]
    got = line_rows(spark, docs, broadcast_bytes=broadcast_bytes)
    assert got == cleaned(docs)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines_of_repeated_and_missing_ids(spark, broadcast_bytes):
    line, other = "a line that is shared by documents without ids", "another one that only rows without ids hold"
    docs = [(None, line), (None, f"{line}\nx"), (1, line), (1, line), (2, f"{line}\n{line}"), (2, line)]
    docs += [(None, other)] * 5
    assert line_rows(spark, docs, broadcast_bytes=broadcast_bytes) == cleaned(docs)
    assert line_rows(spark, [], broadcast_bytes=broadcast_bytes) == []


def test_lines_far_longer_than_a_slice(spark):
    huge = "Abc def " * 400_000  # 3.2 MB
    text = "\n".join(f"line number {i} of a long document, long enough" for i in range(60_000))
    docs = [(i, f" {huge}{i // 5}\t\nend") for i in range(6)]
    docs += [(10 + i, f"{' ' * 2_500_000}short key, but of forty code points or more{' ' * i}") for i in range(5)]
    docs += [(20 + i, text) for i in range(5)]
    got = line_rows(spark, docs)
    assert got == cleaned(docs)
    dropped = {r[0]: r[2] for r in got}
    assert [dropped[i] for i in (0, 4, 5, 10, 14, 20, 24)] == [1, 0, 0, 1, 0, 60_000, 0]


def test_lines_keep_the_columns_of_the_table(spark, hard, nothing):
    line = "this line of forty code points is in five documents"
    more = spark.createDataFrame(
        [(i, f"first\n{line}", "en", "a", 3, "k", True) for i in range(20, 25)], hard.schema
    )
    both = hard.unionByName(more)
    got = line_dedup.drop_repeated_lines(both)
    assert got.columns == both.columns and got.dtypes == both.dtypes
    expected = [
        r if r["doc_id"] not in range(20, 24) else r.asDict() | {"text": "first"} for r in both.collect()
    ]
    expected = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in expected]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert line_dedup.drop_repeated_lines(nothing).collect() == []


def test_filters_never_forget():
    rng = np.random.default_rng(7)
    names = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
    bloom = line_dedup.Bloom.empty(1 << 20)
    bloom.add(names)
    folded = bloom.folded()
    assert len(folded.data) < len(bloom.data)
    assert bloom.knows(names).all() and folded.knows(names).all()
    others = np.setdiff1d(rng.integers(0, 1 << 32, 50_000, dtype=np.uint32), names)
    assert folded.knows(others).mean() < 0.02


def test_labels_are_not_gathered_in_the_driver(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"word {i}", "s") for i in range(20)], "doc_id bigint, text string, source string"
    )
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(10)], "doc_id bigint, quality int, toxic int"
    )
    labels.write.parquet(f"{tmp_path}/labels")  # a file's size is known to the planner
    labels, staged, whole = spark.read.parquet(f"{tmp_path}/labels"), [], filter_audit.stage
    monkeypatch.setattr(filter_audit, "stage", lambda df, name: staged.append(df) or whole(df, name))
    rows = filter_audit.failure_counts(docs, labels).collect()
    assert sum(r.n for r in rows) == 20 and sum(r.good for r in rows) == 5
    # a few rows, which the planner would broadcast if it were let
    plan = staged[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
