"""Language ID, fingerprints, language model, mixing and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from replylens.llm import arrays, language_id, lz_fingerprint, maxent_lm, mixing, queries


def _words(text):
    return (text or "").encode().lower().split()


def test_word_hashes_tell_words_apart():
    texts = ["The  cat\tthe\x0bCAT", None, "", "  ", "é É the", "x" * 5000]
    hashes, bounds = arrays.word_hashes(pa.array(texts))
    words = [_words(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert len(set(zip(hashes.tolist(), flat))) == len(set(flat))


def test_language_id_on_held_out_documents(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, sf).collect()}
    right = []
    for r in docs.collect():
        p = got[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= p.score <= 1
        if p.held_out:
            right.append(p.lang_pred == r.lang)
    assert len(got) == docs.count() and np.mean(right) > 0.9


def test_language_id_on_hard_rows(hard, nothing, docs):
    model = language_id.fit(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(hard, model).collect()]
    assert len(got) == hard.count()
    unknown = {d for d, lang, _ in got if lang == "und"}
    assert unknown == {3, 4, 5, 8} and all(s == 0 for d, lang, s in got if lang == "und")
    stays = language_id.keep_identified(hard, model)
    assert stays.columns == hard.columns and stays.count() == hard.count() - 4
    assert language_id.predict(nothing, model).count() == 0
    none = language_id.fit(nothing)
    assert none.languages == []
    assert {r.lang_pred for r in language_id.predict(hard, none).collect()} == {"und"}


def test_texts_in_no_language_are_rejected(spark, docs, hard):
    train = docs.where(~language_id.held_out(docs.doc_id))
    model = language_id.fit(train, background=True)
    assert len(model.offset) == len(model.languages) + 1
    stays = language_id.keep_identified(docs, model)
    assert stays.columns == docs.columns and stays.exceptAll(docs).count() == 0
    assert stays.count() >= 0.995 * docs.count()
    cipher = str.maketrans("abcdefghijklmnopqrstuvwxyz", "qxzjkvwyphgubfmdcltrsnoaie")
    text = docs.where("lang = 'en'").orderBy("doc_id").first().text
    odd = [
        "дом и сад у реки стоят давно и никто их не видел " * 4, "これは日本語で書かれた文章です。" * 8,
        "Ελληνικά κείμενα γράφονται εδώ και αιώνες " * 4, text.lower().translate(cipher), text, "a", None, "12 3",
    ]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in language_id.keep_identified(rows, model).collect()) == [4, 5]
    assert {r.lang_pred for r in language_id.predict(rows, model).where("doc_id < 4").collect()} == {"und"}
    # a probability of 0 or more rejects all, one above 1 only what has no letter
    assert language_id.keep_identified(rows, model, 0.0).count() == 0
    assert language_id.keep_identified(rows, model, 1.1).count() == 6


def test_without_labels_texts_with_a_letter_stay(spark, hard):
    model = language_id.fit(hard.where("lang is null"), background=True)
    assert model.languages == []
    assert language_id.keep_identified(hard, model).count() == hard.count() - 4


def test_scoring_by_byte_pairs_equals_training_features():
    draw = np.random.Generator(np.random.PCG64(2))
    codes = draw.integers(0, 257, (700, language_id.WINDOW)).astype(np.int32)
    net = language_id.train(codes[:64], draw.integers(0, 3, 64), ["a", "b", "c"], epochs=1)
    hidden = np.maximum(net.features(codes)[0], 0)
    logits = hidden @ net.weights + net.offset
    want = logits - logits.max(1, keepdims=True)
    want = want - np.log(np.exp(want).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(codes, net.paired()), want, atol=1e-4)


def test_phrases_are_those_of_lz78():
    for data in (b"", b"a", b"abababab", b"the cat the cat the cat sat"):
        seen, at, ends = {b""}, 0, []
        for i in range(len(data)):
            if data[at : i + 1] not in seen:
                seen.add(data[at : i + 1])
                ends.append(i)
                at = i + 1
        assert lz_fingerprint.phrase_ends(data) == ends


def test_fingerprints_of_edited_documents(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op5_lz_fingerprint(spark, sf).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    same = {}
    for i, (doc_id, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
    nearer = np.mean([r.near_edited > r.near_next for r in got.values()])
    assert nearer > 0.9


def test_likeness_follows_shared_phrases():
    draw = np.random.Generator(np.random.PCG64(5))
    text = bytes(draw.integers(97, 105, 4000, dtype=np.uint8))
    other = bytes(draw.integers(105, 113, 4000, dtype=np.uint8))
    prints = lz_fingerprint.signatures([text, text, other, b"", b""])
    like = lambda a, b: float(lz_fingerprint.likeness(prints[a], prints[b]))
    assert like(0, 1) == 1 and like(0, 2) < 0.1 and like(3, 4) == 1 and like(0, 3) == 0

    def phrases(data):
        starts = [0, *(e + 1 for e in lz_fingerprint.phrase_ends(data))]
        return {data[a:b] for a, b in zip(starts, starts[1:])}

    half = text[:2000] + other[:2000]
    a, b = phrases(text), phrases(half)
    one, two = lz_fingerprint.signatures([text, half])
    assert abs(float(lz_fingerprint.likeness(one, two)) - len(a & b) / len(a | b)) < 0.15


def test_fingerprints_of_hard_rows(spark, hard, nothing):
    assert lz_fingerprint.compare_with_edited(hard).count() == hard.count()
    assert lz_fingerprint.compare_with_edited(nothing).count() == 0
    prints = {(r.doc_id, r.fingerprint) for r in lz_fingerprint.fingerprints(hard).collect()}
    assert len([p for p in prints if p[0] in (1, 2)]) == 2 and len({p[1] for p in prints if p[0] in (1, 2)}) == 1
    one = spark.createDataFrame([(5, "alone")], "doc_id bigint, text string")
    r = lz_fingerprint.compare_with_edited(one).collect()[0]
    assert (r.n_chars, r.near_next) == (5, 1.0)


def _unigram(rows):
    count = Counter()
    for doc_id, text in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            count.update([*_words(text), None])
    return count, sum(count.values()), len(count)


@pytest.mark.parametrize("known", [1 << 17, 300, 0])
def test_language_model_counts_and_gain(spark, docs, monkeypatch, known):
    monkeypatch.setattr(maxent_lm.known_words, "__defaults__", (known,))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count, n, v = _unigram(rows)
    got = {r.doc_id: r for r in maxent_lm.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words, r = [*_words(text), None], got[doc_id]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 7 == 2)
    if known > 1 << 16:
        for held in (True, False):
            part = [r for r in got.values() if r.held_out == held]
            assert sum(r.score for r in part) > sum(r.base_score for r in part)


def test_number_of_held_words_changes_no_score(spark, docs, monkeypatch):
    scores = []
    for known in (1 << 17, 300, 0):
        monkeypatch.setattr(maxent_lm.known_words, "__defaults__", (known,))
        rows = maxent_lm.score_documents(docs.where("doc_id < 60")).collect()
        scores.append({r.doc_id: r.score for r in rows})
    assert len(scores[0]) == 60
    for other in scores[1:]:
        assert other == pytest.approx(scores[0])


def test_model_probabilities_sum_to_one():
    draw = np.random.Generator(np.random.PCG64(4))
    hashes = np.sort(draw.integers(1, 1 << 63, 90, dtype=np.uint64))
    counts = draw.integers(1, 50, 90)
    model = maxent_lm.untrained(hashes, counts, int(counts.sum()) + 10)
    for table in model.tables:
        table += draw.normal(0, 1, table.shape).astype(np.float32)
    places = np.append(model.place, (maxent_lm.CLASSES - 1) * maxent_lm.WORDS)
    context = np.full(len(places), 77, np.uint64), np.full(len(places), 99, np.uint64)
    total = np.exp(model.log_probabilities(places, *context)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_every_counted_word_has_a_place():
    v, own = 9000, (maxent_lm.CLASSES - 1) * maxent_lm.WORDS
    counts = np.arange(v, 0, -1)
    model = maxent_lm.untrained(np.arange(1, v + 1, dtype=np.uint64), counts, int(counts.sum()), v, held=False)
    rank = np.arange(v + 1)
    context = np.full(v + 1, 77, np.uint64), np.full(v + 1, 99, np.uint64)
    choices = maxent_lm.Choices(model, rank, *context, own, v)
    paths = {}
    for token, node, branch in zip(choices.token, choices.node, choices.branch):
        paths.setdefault(int(token), []).append((int(node), int(branch)))
    assert len({tuple(p) for p in paths.values()}) == v + 1
    keys = choices.needed(True)
    draw = np.random.Generator(np.random.PCG64(5))
    rows = draw.normal(0, 1, (len(keys), maxent_lm.WORDS)).astype(np.float32)
    rows[: (keys >> 60 == 4).sum()] = -60
    last = choices.tail
    for node, branch in set(zip(choices.node[last].tolist(), choices.branch[last].tolist())):
        rows[np.flatnonzero(keys == node | 4 << 60)[0], branch] = 0.5
    choices.meet(model, keys, rows)
    p = choices.log_probabilities(model)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-3)
    assert np.std(p[own:]) > 0.5  # the context tells rare words apart
    assert maxent_lm.row_bits(1 << 33, 1 << 26) > maxent_lm.row_bits(1 << 23, 1 << 17)


def test_words_rank_by_count(spark):
    rows = [(int(t), int(abs(t) % 7)) for t in np.random.Generator(np.random.PCG64(6)).integers(-(1 << 63), 1 << 63, 500)]
    table = spark.createDataFrame(rows, "token bigint, c bigint").repartition(3)
    got = {r.token: r.rank for r in maxent_lm.ranked(table).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0] % (1 << 64)))
    assert [got[t] for t, _ in order] == list(range(len(rows)))


def test_language_model_on_hard_rows(hard, nothing):
    got = maxent_lm.score_documents(hard).collect()
    assert len(got) == hard.count()
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert maxent_lm.score_documents(nothing).count() == 0
    untaught = maxent_lm.score_documents(hard.where("crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untaught)


def _targets(rows):
    """Sources in order with targets, by sharing excess again and again."""
    size = Counter()
    for source, words in rows:
        size[source] += words
    order = sorted(size, key=lambda s: (s is None, s and s.encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(size.values()))
    while True:
        free = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * size[s] + 1e-9]
        if not over:
            return size, target | share
        for s in over:
            target[s] = 3.0 * size[s]
            full.add(s)
            rest -= target[s]


def _check_mixture(table, rows):
    size, target = _targets([(s, len(_words(t))) for _, t, s in rows])
    got = mixing.mixture(table).collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert sorted(got, key=str) == sorted(mixing.mixture(table.repartition(5)).collect(), key=str)
    return got


def test_mixture_query(spark, sf, docs):
    _check_mixture(docs, [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_mixture_with_full_sources(spark):
    draw = np.random.Generator(np.random.PCG64(9))
    rows = []
    for source, n in (("a", 2), ("b", 400), ("c", 30), (None, 1), ("é", 60), ("empty", 3)):
        for _ in range(n):
            words = 0 if source == "empty" else int(draw.integers(1, 60))
            rows.append((len(rows), "w " * words, source))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = _check_mixture(table, rows)
    assert {r.copies for r in got if r.source == "a"} == {3}
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    assert mixed.count() == sum(r.copies for r in got if r.size)


def test_mixture_on_hard_rows(hard, nothing):
    got = mixing.mixture(hard).collect()
    assert len(got) == hard.count()
    assert all(r.taken == 0 for r in got if r.doc_id in (3, 4, 5))
    assert mixing.mix_documents(hard).columns == hard.columns
    assert mixing.mixture(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_pareto_samples_follow_inclusion_odds(spark):
    """Over many seeds a document is taken about as often as its fraction says."""
    rows = [(i, "w " * (4 if i % 2 else 400), "a") for i in range(60)]
    rows += [(100 + i, "w " * 200, "b") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1)
    sizes, plan = mixing.mix_sizes(table)
    fractions = {(r.source, r.size_class): r.fraction + r.whole for r in plan.collect()}
    short = fractions[("a", 3)]
    long = fractions[("a", 9)]
    assert short < long
    got = Counter()
    for r in mixing.mixture(table, seed=5).collect():
        got[(r.source, r.size)] += r.copies
    assert abs(got[("a", 400)] / 30 - long) < 0.15


def test_pipeline_equals_its_parts(spark, sf, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    kept, counts = docs, []
    for _, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, kept, sf)
        assert kept.columns == docs.columns
        counts.append(kept.count())
    rows = docs.collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r.text)]
    assert counts[0] == len(lettered)
    texts = {}
    for r in lettered:
        clean = "".join(r.text.translate(dict.fromkeys([0x20, *range(9, 14)])))
        texts.setdefault(clean, []).append(r)
    assert counts[1] == len(texts)
    best = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in texts.values()]
    from test_duplicates import _linked

    linked = _linked([(r.doc_id, r.text) for r in best], 5, 80)
    assert counts[2] == len({c for s in linked.values() for _, c in s})
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == counts[3]
    said = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows}
    assert all(r.decoded_sha256 == said[r.doc_id] and r.n_tokens == len(r.ids) for r in out)


def test_pipeline_stages_on_hard_rows(spark, sf, hard, nothing):
    by_id = lambda table: sorted((r.doc_id for r in table.collect()), key=str)
    stays = {
        "language_id": [1, 2, 2, 6, 7, 9, 9, None],
        "exact_dedup": [1, 7, 9, 9, None],
        "ngram_jaccard_join": [1, 7, 9, 9, None],
    }
    for start in (hard, nothing):
        kept, before = start, None
        for name, function in corpus_pipeline.STAGES:
            kept = function(spark, kept, sf)
            assert name == "byte_bpe" or kept.columns == start.columns
            found = by_id(kept)
            if start is nothing:
                assert found == []
            elif name in stays:
                assert found == stays[name]
            elif name == "mixing":
                assert found and set(found) <= set(before)
            else:
                assert found == before
            before = found
