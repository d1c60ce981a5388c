import random

import numpy as np

from veldra.llm import mixing
from veldra.storage import Scratch


def test_topics_are_learned(spark):
    rnd = random.Random(1)
    words = {"a": "label box polygon class width".split(), "b": "epoch loss step seed rate".split(), "c": "street house door plot colony".split()}
    rows = [(i, " ".join(rnd.choices(words[k], k=40)), k) for i, k in enumerate(rnd.choices("abc", k=300))] + [(900, "", "n"), (901, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, kind STRING")
    topics = mixing.learn_topics(docs, mixing.vocabulary_folder(), "byte_bpe_50k", k=3)
    enc = mixing.encoder(mixing.vocabulary_folder())
    told = {(k, topics.of(enc.encode(t) if t else [])) for _, t, k in rows}
    assert len(told) == 4 and len({t for _, t in told}) == 4 and ("n", "none") in told
    assert np.array_equal(mixing.learn_topics(docs.repartition(3), mixing.vocabulary_folder(), "byte_bpe_50k", k=3).centres, topics.centres)
    assert len(mixing.learn_topics(docs.limit(0), mixing.vocabulary_folder(), "byte_bpe_50k").centres) == 0
    part = mixing.learn_topics(docs, mixing.vocabulary_folder(), "byte_bpe_50k", k=3, fit_docs=100)
    assert len({(k, part.of(enc.encode(t))) for _, t, k in rows if t}) == 3


def test_no_language_is_left_out():
    langs = [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    cells = [(s, g, "t0", 10.0 + i % 7) for s in "ab" for i, g in enumerate(langs)]
    fit = mixing.rake(cells, {"a": 0.25, "b": 0.75}, {"a": 2, "b": 2})
    totals = {g: sum(fit.weights[s, g, "t0"] * (10.0 + i % 7) for s in "ab") for i, g in enumerate(langs)}
    have = {g: 10.0 + i % 7 for i, g in enumerate(langs)}
    assert max(abs(totals[g] / fit.total - have[g] / sum(have.values())) for g in langs) < 1e-6 and fit.residual < 1e-6
    assert fit.bound_by == ("b",) and len(fit.weights) == 400


def test_report_names_what_sets_the_total(spark):
    rows = [(i, f"box {i} is fine", "EN" if i % 2 else "hi_Latn", "a") for i in range(300)] + [(1000 + i, f"loss {i}", "no language at all", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source STRING, target_share DOUBLE, max_repeats INT")
    sample, report = mixing.draw(docs, targets, Scratch(spark, "t"))
    r = {x.source: x for x in report.collect()}
    assert (r["a"].sets_total, r["b"].sets_total) == (False, True) and abs(r["a"].total_tokens - 6 * r["b"].available_tokens) <= 1
    assert sample.where("source = 'b' and copies > 3 or source = 'a' and copies > 1").count() == 0 and r["b"].most_copies == 3
    langs = {x.lang for x in mixing.sized(docs, Scratch(spark, "t")).select("lang").distinct().collect()}
    assert langs == {"en", "hi-latn", ""}


def test_topics_are_learned_from_every_document(spark):
    rnd = random.Random(2)
    words = {"a": "label box polygon class width".split(), "b": "epoch loss step seed rate".split(), "c": "street house door plot colony".split()}
    rows = [(i, " ".join(rnd.choices(words[k], k=12))) for i, k in enumerate(rnd.choices("abc", weights=(60, 39, 1), k=12_000))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    topics = mixing.learn_topics(docs, mixing.vocabulary_folder(), "byte_bpe_50k", k=4)
    enc = mixing.encoder(mixing.vocabulary_folder())
    counts = np.stack([np.bincount(np.asarray(enc.encode(t)) % mixing.PLACES, minlength=mixing.PLACES) for _, t in rows])
    w = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0)))
    assert np.array_equal(topics.weights, w)
    x = np.log1p(counts) * w
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # every document is nearest to its own topic, and each topic is the direction of what is nearest to it
    at = np.argmax(x @ topics.centres.T, axis=1)
    assert [topics.of(enc.encode(t)) for _, t in rows[:500]] == [f"t{j}" for j in at[:500]] and len(set(at)) == 4
    own = np.stack([x[at == j].sum(0) for j in range(4)])
    assert np.abs(own / np.linalg.norm(own, axis=1, keepdims=True) - topics.centres).max() < 0.02
    told = {r.doc_id: r.topic for r in mixing.sized(docs.selectExpr("doc_id", "'s' AS source", "'en' AS lang", "text"), Scratch(spark, "t")).collect()}
    assert len(told) == 12_000 and "none" not in told.values()
