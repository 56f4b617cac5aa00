"""Classifier, line rules, language model, preferences and the pipeline."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.plain import base_counts, best_fit, near_duplicates, ngram_scores, plain_label_model, plain_regression
from tests.oracle import SMALL, connect, spark_rows, sql_rows
from trawl.llm import line_crf, ngram_lm, preferences, registry, weak_quality


@pytest.fixture(scope="module")
def labelled(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return documents.join(labels, "doc_id")


def test_classifier_agrees_with_labels_it_never_saw(spark, labelled):
    model, scorer = weak_quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = weak_quality.judge(labelled, scorer).join(labelled, "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    assert not [r for r in rows if r["quality"] and not r["kept"]]
    assert all(0 <= a <= 1 for a in model.accuracies())


def test_label_model_finds_accuracies():
    rng, counts = random.Random(2), {}
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6, 0.8, 0.9]
    for _ in range(20_000):
        truth = rng.random() < 0.7
        vote = tuple(weak_quality.NONE if rng.random() < 0.2 else int(truth if rng.random() < p else not truth) for p in right)
        code = weak_quality.pattern_code(vote)
        assert weak_quality.code_votes(code) == vote
        counts[code] = counts.get(code, 0) + 1
    model = weak_quality.LabelModel(counts)
    assert abs(model.prior - 0.7) < 0.05
    assert np.abs(np.array(model.accuracies()) - right).max() < 0.06


def test_classifier_on_odd_tables(odd, empty, texts):
    _, scorer = weak_quality.train(odd)
    rows = weak_quality.judge(odd, scorer).collect()
    assert len(rows) == len(texts) + 1
    assert all(not r["kept"] and r["score"] == 0 for r in rows if r["doc_id"] in (150, 151, 152))
    assert weak_quality.keep(odd, scorer).columns == odd.columns
    _, scorer = weak_quality.train(empty)
    assert weak_quality.judge(empty, scorer).count() == 0


def test_line_counts(odd, texts):
    rows = line_crf.judge(odd, line_crf.train(odd)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(texts[5 if r["doc_id"] is None else r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_line_rules_agree_with_labels(labelled):
    rows = line_crf.judge(labelled, line_crf.train(labelled)).join(labelled, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    assert not [r for r in rows if r["quality"] and not r["kept"]]


def test_line_rules_on_nothing(empty):
    assert line_crf.judge(empty, line_crf.train(empty)).count() == 0


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        field = line_crf.Field(rng.normal(size=(line_crf.WEIGHTS, 2)), rng.normal(size=(2, 2)))
        chain = [tuple(int(rng.integers(0, k)) for k in line_crf.KINDS) for _ in range(rng.integers(1, 9))]

        def score(labels, field=field, chain=chain):
            return sum(field.scores(f)[label] for f, label in zip(chain, labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(chain)), key=score)
        assert math.isclose(score(field.viterbi(chain)), score(best))
    assert field.viterbi([]) == []


def test_expectations_equal_enumeration():
    rng = np.random.default_rng(5)
    emit, moves, lengths = rng.normal(size=(3, 4, 2)), rng.normal(size=(2, 2)), np.array([4, 2, 1])
    labels, pairs = line_crf._expected(emit, moves, lengths)
    expected, expected_pairs = np.zeros_like(labels), np.zeros((2, 2))
    for d, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weights = np.exp([sum(emit[d, t, x] for t, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, w in zip(paths, weights / weights.sum()):
            for t, x in enumerate(p):
                expected[d, t, x] += w
            for a, b in zip(p, p[1:]):
                expected_pairs[a, b] += w
    assert np.allclose(labels, expected) and np.allclose(pairs, expected_pairs)


@pytest.mark.parametrize("strengths", [ngram_lm.STRENGTHS, (7.0,), (50.0, 9.0, 2.0), ()])
def test_scores(docs, texts, scratch, strengths):
    rows = ngram_lm.score_documents(docs, scratch, strengths, bucket=100_000).collect()
    expected = ngram_scores(texts, strengths)
    assert len(rows) == len(expected)
    for r in rows:
        held, n, known, train, base, score = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_scores_on_odd_tables(spark, odd, empty, texts, scratch):
    assert ngram_lm.score_documents(odd, scratch, bucket=100_000).count() == len(texts) + 1
    assert ngram_lm.score_documents(empty, scratch).count() == 0
    twice = [(1, "a b c"), (1, "a b c"), (2, "a b"), (None, None)]
    rows = ngram_lm.score_documents(spark.createDataFrame(twice, "doc_id int, text string"), scratch).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 1), (1, 4), (1, 4), (2, 3)]
    assert {r["train_tokens"] for r in rows} == {4 * (not ngram_lm.held_out(1)) * 2 + 3 * (not ngram_lm.held_out(2)) + (not ngram_lm.held_out(None))}


def test_small_blocks_and_buckets_give_the_same_scores(docs, texts, scratch):
    expected = ngram_scores(texts, ngram_lm.STRENGTHS)
    for r in ngram_lm.score_documents(docs, scratch, block=500, bucket=5_000).collect():
        assert math.isclose(r["score"], expected[r["doc_id"]][5], rel_tol=1e-9)


def test_probabilities_add_up():
    """From any state, the probabilities of all words and of the unknown add up to 1, through arcs and chains of failures."""
    texts = [b"a b a c a b", b"b a b", b"c"]
    strengths, seen = (7.0, 3.0), {}
    for context in (b"", b"a", b"a b", b"b a", b"c c", b"zz a"):
        total = 0.0
        for word in (b"a", b"b", b"c", None, b"unknown"):
            probe = context if word is None else context + b" " + word
            block = ngram_lm.Block.of([*texts, probe], 3)
            training = np.repeat([True, True, True, False], block.lengths)
            keys = list(block.keys())
            counts = [np.bincount(at[training], minlength=len(k)) for k, at in keys]
            automaton = ngram_lm.build_automaton(counts, [at for _, at in keys], block.starts, int(training.sum()), 4, 3, strengths)
            begin, words = int(block.starts[3]), len(probe.split())
            last = begin + words - (word is not None)
            total += 10 ** (automaton.walk(begin, last + 1) - (automaton.walk(begin, last) if last > begin else 0.0))
        seen[context] = total
    assert all(math.isclose(x, 1.0) for x in seen.values()), seen


def test_packed_blocks():
    block = ngram_lm.Block.of([b"a b a c", b"", b"a " * 500, b"x"], 3)
    again = ngram_lm.Block.unpack(block.pack(), block.lengths.tolist(), 3)
    assert (again.tokens == block.tokens).all() and again.starts.tolist() == [0, 5, 6, 507]


def test_failures_form_a_chain():
    """An unseen third word fails from the pair to the last word, and an unseen second one on to the root."""
    block = ngram_lm.Block.of([b"a b c", b"a b", b"x b c", b"a b d", b"a b a"], 3)
    training = np.repeat([True, False, True, False, False], block.lengths)
    keys = list(block.keys())
    counts = [np.bincount(at[training], minlength=len(k)) for k, at in keys]
    automaton = ngram_lm.build_automaton(counts, [at for _, at in keys], block.starts, 8, 5, 2, (7.0, 3.0))
    assert [a[: block.lengths[0]].all() for a in automaton.arcs] == [True, True, True]
    end_after_b = int(block.starts[1] + 2)
    assert [bool(a[end_after_b]) for a in automaton.arcs] == [True, False, False]
    expected = automaton.fails[2][end_after_b] + automaton.fails[1][end_after_b] + automaton.weights[0][end_after_b]
    begin = int(block.starts[1])
    assert math.isclose(automaton.walk(begin, end_after_b + 1) - automaton.walk(begin, end_after_b), expected)


def test_held_out_texts_are_scored_better_than_by_words_alone(spark, scratch):
    rows = ngram_lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), scratch).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "why"), (0, 3, "assistant", "so"), (1, 0, "user", "x"), (1, 1, "assistant", "noé"), (2, 0, "user", None), (2, 1, None, "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "assistant", "alone"), (None, 0, "user", "lost")]
    rows = {r["conv_id"]: r for r in preferences.format_pairs(preferences.with_other_reply(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("chosen", F.lit(1)))).collect()}
    assert set(rows) == {0, 1, 2, 3, 4}
    first = rows[0]
    assert first["n_prompt_turns"] == 3
    assert first["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nwhy<|end|>\n"
    assert (first["chosen"], first["rejected"]) == ("<|assistant|>\nso<|end|>\n", "<|assistant|>\nnoé<|end|>\n")
    for side in ("chosen", "rejected"):
        begin, end = map(int, first[f"{side}_mask"].split(":"))
        assert (first["prompt"] + first[side])[begin:end] == {"chosen": "so", "rejected": "noé"}[side] + "<|end|>\n"
    assert (rows[2]["n_prompt_turns"], rows[2]["chosen"], rows[2]["rejected"]) == (2, "", "")
    assert (rows[3]["n_prompt_turns"], rows[3]["rejected"]) == (1, "")
    assert rows[4]["rejected"] == "" and rows[4]["n_prompt_turns"] == 0


def test_preferences_against_sql(spark):
    df = registry.queries()["op7_preferences"](spark, SMALL)
    names, expected = sql_rows(connect(), registry.oracle_sql()["op7_preferences"])
    assert sorted(df.columns) == names and spark_rows(df) == expected
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))


def test_preferences_of_any_two_sides(spark):
    a, b, c = ("user", "q"), ("assistant", "x"), ("assistant", "y")
    sides = [([a, b], [a, c]), ([b], [c]), ([a, b], [a]), ([a], [a, b]), ([], []), ([a, b], [a, b]), (None, [a, b]), ([a], None), (None, None), ([(None, None), b], [("", ""), c]), ([None, a, b], [a, c])]
    schema = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt_id string"
    rows = {r["id"]: r for r in preferences.format_pairs(spark.createDataFrame([(i, x, y, "k") for i, (x, y) in enumerate(sides)], schema)).collect()}
    render = lambda turns: "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)
    for i, (x, y) in enumerate(sides):
        x, y = ([tuple(v or "" for v in t) for t in side or [] if t] for side in (x, y))
        same = next((n for n, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
        r = rows[i]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], r["prompt_id"]) == (same, render(x[:same]), render(x[same:]), render(y[same:]), "k"), i
        for name, turns in (("chosen", x[same:]), ("rejected", y[same:])):
            parts = [tuple(map(int, m.split(":"))) for m in r[f"{name}_mask"].split(",") if m]
            assert [(r["prompt"] + r[name])[s:e] for s, e in parts] == [f"{t}<|end|>\n" for role, t in turns if role == "assistant"]


def test_label_model_against_votes_one_by_one(spark):
    """Expectation-maximisation over documents instead of counted patterns, written out."""
    texts = [(r[0] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    rows = [weak_quality.votes(weak_quality.measures(t, t.split())) for t in texts if t.split()]
    prior, given = plain_label_model(rows, 200)
    model = weak_quality.LabelModel(Counter(map(weak_quality.pattern_code, rows)))
    assert math.isclose(model.prior, prior, rel_tol=1e-6)
    assert np.allclose(model.given, given, atol=1e-6)
    for vote in rows[:50]:
        good, bad = prior, 1 - prior
        for k, v in enumerate(vote):
            if v != weak_quality.NONE:
                good *= given[1][k][v] / (given[1][k][0] + given[1][k][1])
                bad *= given[0][k][v] / (given[0][k][0] + given[0][k][1])
        assert math.isclose(model.probability(weak_quality.pattern_code(vote)), good / (good + bad), rel_tol=1e-5)


def test_scorer_against_plain_regression():
    """Hashed logistic regression with tables instead of arrays; verdicts follow from the threshold."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Zq9", "words", "##", "and."]) for _ in range(rng.randint(6, 30))).encode() for _ in range(30)]
    rows = [weak_quality.hashed_features(t, t.split(), weak_quality.measures(t, t.split())) for t in texts]
    target = [0.9 if b"##" not in t else 0.2 for t in texts]
    weights, bias = plain_regression(rows, target, weak_quality.ROUNDS, weak_quality.RATE, weak_quality.SHRINK)
    scorer = weak_quality.fit_scorer(rows, np.array(target))
    for text, (places, values) in zip(texts, rows):
        plain = 1 / (1 + math.exp(-(bias + sum(weights.get(p, 0.0) * v for p, v in zip(places, values)))))
        assert math.isclose(scorer.score(text), plain, rel_tol=1e-6)


def test_whole_documents_up_to_a_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "fit", lambda chains: chains)
    rows = [(i, "\n".join(f"line {i} {j} of some text" for j in range(n))) for i, n in enumerate([700, 3, 40, 5000, 8])]
    df = spark.createDataFrame([*rows, (4, "more rows of one id"), (None, "x")], "doc_id int, text string")
    assert sorted(map(len, line_crf.train(df))) == [1, 3, 40, 700, 5000] or sorted(map(len, line_crf.train(df))) == [3, 8, 40, 700, 5000]
    few = line_crf.train(df, lines=800)
    assert sum(map(len, few)) <= 800 and all(len(c) in (0, 1, 3, 8, 40, 700) for c in few)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_repeated_rows_and_small_ids(spark, kind):
    """Every filter and measure takes ids of any integer type, and gives equal rows equal results."""
    text = " ".join(f"word{i % 40} and some more." for i in range(60))
    rows = [(1, text, "k"), (1, text, "k"), (1, "other", "l"), (None, None, None), (2, "", "m"), (3, text, None)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, score string")
    for out in (weak_quality.judge(df, weak_quality.train(df)[1]), line_crf.judge(df, line_crf.train(df))):
        found = [tuple(r) for r in out.collect()]
        assert len(found) == len(rows) and len({f for f in found if f[0] == 1}) == 2
    for kept in (weak_quality.keep(df, weak_quality.train(df)[1]), line_crf.keep(df, line_crf.train(df))):
        assert kept.schema == df.schema and kept.count() <= len(rows)


def test_one_word_of_megabytes(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000)], "doc_id long, text string")
    row = line_crf.judge(df, line_crf.train(df)).first()
    assert (row["n_words"], row["word_chars"], row["kept"]) == (1, 3_000_000, False)


def test_preferences_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preferences.format_pairs(preferences.with_other_reply(empty)).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against a plain version of what it should keep."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if name == "packing":
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(texts)
            assert len({r["sequence_id"] for r in rows}) == best_fit([r["length"] for r in rows])
            continue
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(texts[k] == t for k, t in kept.items())
        if name == "quality classifier":
            scorer = weak_quality.train(docs)[1]
            expected = {k for k, t in texts.items() if scorer.score(t.encode()) >= weak_quality.THRESHOLD}
        elif name == "quality rules":
            field = line_crf.train(docs)
            expected = {k for k, t in texts.items() if line_crf.verdict(t.encode(), field)[6]}
            assert all(not base_counts(texts[k])[5] for k in expected)
        else:
            expected = {k for k, (_, _, keep) in near_duplicates(texts).items() if keep}
        assert set(kept) == expected and 0 < len(kept) < len(texts)
        docs, texts = out, kept
    assert [r for r in corpus_pipeline.run(spark, SMALL).take(1)]
    assert len(corpus_pipeline.STAGES) == 4


def test_pipeline_on_odd_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert name == "packing" or stage(spark, odd, SMALL).columns == odd.columns
        assert stage(spark, empty, SMALL).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, odd, SMALL).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_clean_labelled_documents_survive_the_filters(spark, labelled):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, corpus_pipeline.quality_classifier(spark, docs, ""), "").select("doc_id")
    clean = labelled.filter("quality = 1").select("doc_id", "text").collect()
    long_enough = {r["doc_id"] for r in clean if not base_counts(r["text"])[5]}
    assert long_enough <= {r["doc_id"] for r in kept.collect()}
