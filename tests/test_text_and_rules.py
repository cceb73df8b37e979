from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from replylens.functions import ngrams as N
from replylens.functions import rules as R
from replylens.functions import text as X
from replylens.operators import tfidf as TF
from replylens.operators.tfidf import Features


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_intent_rules(spark):
    cases = {
        "I cannot get in and forgot the password": "account_access",
        "They charged me for premium two times": "billing_subscription",
        "It crashes whenever a track begins": "playback_technical",
        "I can't find that album": "content_availability",
        "Please add a sleep timer": "feature_request_feedback",
        "xyz": "other",
        # first rule wins; a dollar sign needs a word character before it
        "my premium app keeps stopping": "billing_subscription",
        "it was US$5 more": "billing_subscription",
        "it was $5 more": "other",
        "on version 4 now": "playback_technical",
        "on version 42 now": "other",
        # only the straight apostrophe is optional
        "i cant find it": "content_availability",
        "i can’t find it": "other",
    }
    assert apply(spark, R.classify_intent, cases) == list(cases.values())


def test_null_text_is_unclassified(spark):
    assert apply(spark, R.classify_intent, [None]) == ["other"]


def test_escalation(spark):
    rows = [
        ("someone accessed my account", "account_access", None, "account_security"),
        ("I was charged twice, refund please", "billing_subscription", None, "billing_dispute"),
        ("let me talk to a human", "other", 0.9, "explicit_human_request"),
        ("what is this???", "other", 0.9, "high_distress"),
        ("what is this??", "playback_technical", 0.9, "none"),
        ("hello", "other", 0.05, "low_retrieval_confidence"),
        ("hello", "other", None, "unclassified_intent"),
        ("add a song to a list", "content_availability", 0.5, "none"),
        ("add a song to a list", "content_availability", 0.15, "none"),
    ]
    df = spark.createDataFrame(rows, "t string, i string, c double, want string")
    got = df.select(
        R.escalation_reason(F.col("t"), F.col("i"), F.col("c")).alias("got"), "want"
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rule_hits_keep_order(spark):
    assert apply(spark, lambda t: R.all_matches(t, R.INTENT_RULES), ["premium bug", "x"]) == [
        ["billing_subscription", "playback_technical"], [],
    ]


def test_clean_text(spark):
    cases = {
        "see https://a.b/c?d  now": "see now",
        "@help it  broke\n again ": "it broke again",
        "write to a@b.com": "write to a.com",
        " café noir\tx": "café noir x",
        "plain text": "plain text",
        "": "",
    }
    assert apply(spark, X.clean_text, cases) == list(cases.values())


def test_sign_off(spark):
    cases = {
        "Try this. ^CC": "Try this.", "Try this /AB.": "Try this", "No tag": "No tag",
        "lower ^ab": "lower ^ab", "inside /AB text": "inside /AB text",
    }
    assert apply(spark, X.strip_sign_off, cases) == list(cases.values())


def test_transcript_turns(spark):
    text = "Customer: one\nrest of one\nSupport:two \n  Customer:  three\ncustomer: no\nSystem: no\nSupport:"
    [turns] = apply(spark, X.transcript_turns, [text])
    assert [tuple(t) for t in turns] == [
        ("Customer", "one"), ("Support", "two"), ("Customer", " three"), ("Support", ""),
    ]
    assert apply(spark, X.turn_count, [text]) == [3]  # the indented one is no line start
    assert apply(spark, X.has_support_reply, [text, "Support: a", "a Support:"]) == [True, True, False]


def test_claims_and_overlap(spark):
    df = spark.createDataFrame(
        [("It costs $5.50, 20% off within 3 days", "we say 20% off"), ("same words", "Words SAME")],
        "r string, e string",
    )
    rows = df.select(
        X.unsupported_claims(F.col("r"), F.col("e")), X.overlap_score(F.col("r"), F.col("e"))
    ).collect()
    # the word after a number belongs to the claim, the percent sign form comes first
    assert sorted(rows[0][0]) == ["$5.50,", "3 days"]
    assert rows[1][0] == [] and rows[1][1] == 1.0


def test_word_ngrams(spark):
    def grams(t):
        return N.word_ngrams(N.word_tokens(t), (1, 3))

    got = apply(spark, grams, ["A Big big-dog ran", "one", "", "x y"])
    assert got == [
        ["big", "big", "dog", "ran", "big big", "big dog", "dog ran", "big big dog", "big dog ran"],
        ["one"], [], [],
    ]


def brute_char_grams(text, low, high):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        if len(padded) < low:
            out.append(padded)
        for n in range(low, min(high, len(padded)) + 1):
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return out


def test_char_ngrams(spark):
    texts = ["a", "I am OK", "héllo  wörld", "", "abcdefgh"]
    for low, high in ((3, 5), (4, 6), (3, 7)):
        got = apply(spark, lambda t: N.char_ngrams(t, (low, high)), texts)
        assert [sorted(g) for g in got] == [sorted(brute_char_grams(t, low, high)) for t in texts]


def test_char_ngram_totals_spell_each_word_once(spark):
    texts = ["To be, to BE", "be a Bee\tbee", "", "  ", None, "中文 to"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    direct = N.gram_rows(df, N.char_ngrams(F.col("text"), (3, 5))).groupBy("term").count()
    totals = N.char_ngram_totals(df, F.col("text"), (3, 5))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, direct.collect()))
    assert {r.term: r.n for r in totals.collect()}[" to"] == 3
    # words are merged before any n-gram of theirs is a row
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def _windows(words, low, high):
    return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def test_word_ngrams_are_counted_in_batches(spark):
    rows = [(1, ["b", "a", "b", "a", "b"]), (2, []), (3, None), (4, ["a"]), (1, ["a", "b"]), (None, ["é", "b"])]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    got = N.counted_word_ngrams(df, "tokens", (1, 3), "id").collect()
    want = [
        (i, term, n) for i, words in rows for term, n in Counter(_windows(words or [], 1, 3)).items()
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    totals = Counter(term for _i, words in rows for term in _windows(words or [], 1, 3))
    got = N.word_ngram_totals(df, "tokens", (1, 3)).collect()
    assert sorted(map(tuple, got)) == sorted(totals.items())


def test_term_counts_take_no_step_per_token_in_expressions(spark):
    docs = spark.createDataFrame([(1, "The cat the cat")], "doc_id bigint, text string")
    counts = TF.term_counts(docs, Features((1, 2), None, 2))
    assert sorted((r.term, r.tf) for r in counts.collect()) == [
        ("cat", 2), ("cat the", 1), ("the", 2), ("the cat", 2)
    ]
    assert "lambdafunction" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_counted_in_runs_and_long_ngrams_fit(monkeypatch):
    lists = [[f"w{i % 700}x{i}" for i in range(3000)], ["a", "b"] * 4, None, ["a"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["tokens"])
    monkeypatch.setattr(N, "TOKENS_AT_A_TIME", 10)
    parts = list(N._parts([batch]))
    assert [p.num_rows for p in parts] == [1, 2, 1]
    for by_row in (True, False):
        found = Counter()
        for _rows, terms, counts in N._count_ngrams(batch.column(0), (6, 7), by_row):
            for term, n in zip(terms.to_pylist(), counts.to_pylist()):
                found[term] += n
        assert found == Counter(t for words in lists for t in _windows(words or [], 6, 7))
