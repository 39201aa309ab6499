import math
from collections import Counter

import pytest

from tessera.llm import lm_scoring


def test_matches_plain_models(table, spark):
    docs = [(1, "a b a c"), (2, "a b a b"), (3, "x y z x y"), (4, "a x"), (5, ""), (6, None), (6, "rare words here"), (7, "A B")]
    good = spark.createDataFrame([(1,), (2,), (2,), (None,), (88,)], "doc_id long")
    frame = table(docs)
    got = {(r.key, r.n_tokens): r for r in lm_scoring.scored(frame, lm_scoring.train(frame, good, size=6)).collect()}
    words = Counter(w for _, t in docs for w in (t or "").lower().split())
    known = {w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:6]}
    tokens = {i: ["<s>", *[w if w in known else "<u>" for w in (t or "").lower().split()]] for i, (_, t) in enumerate(docs)}

    def model(chosen):
        u, c, b = Counter(), Counter(), Counter()
        for i in chosen:
            u.update(tokens[i][1:]), c.update(tokens[i][:-1]), b.update(zip(tokens[i], tokens[i][1:]))
        n = sum(u.values())

        def loss(i):
            out = 0.0
            for p, w in zip(tokens[i], tokens[i][1:]):
                alone = (u[w] + 0.5) / (n + 0.5 * 8)
                out -= math.log((min(b[p, w], c[p], u[w]) + lm_scoring.PRIOR * alone) / (c[p] + lm_scoring.PRIOR))
            return out / (len(tokens[i]) - 1)

        return loss

    target, background = model([0, 1]), model(range(len(docs)))
    for i, (key, t) in enumerate(docs):
        n = len(tokens[i]) - 1
        r = got[key, n]
        if n:
            assert r.score == pytest.approx(target(i) - background(i), abs=2e-6)
        else:
            assert r.score is None and r.target_loss is None
    assert got[2, 4].score < got[3, 5].score


def test_no_documents(table, spark):
    frame = table([(1, "a")]).filter("doc_id > 1")
    good = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.scored(frame, lm_scoring.train(frame, good)).count() == 0


@pytest.mark.parametrize("chunk", [3, 1_000_000])
def test_every_word_and_bigram_counts(table, spark, monkeypatch, chunk):
    """More words than the former vocabulary of 50,000: the rare ones keep their own counts, in chunks of any size."""
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    n = 30 if chunk == 3 else 55_000
    docs = [(0, " ".join(f"w{i} w{i}" for i in range(n))), (1, "zz1 zz2 zz1 zz2"), (2, "zz3 zz4"), (3, "zz4 zz3"), (4, None)]
    frame = table(docs)
    good = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.key: r for r in lm_scoring.scored(frame, lm_scoring.train(frame, good)).collect()}
    tokens = {k: ["<s>", *(t or "").split()] for k, t in docs}
    size = len({w for t in tokens.values() for w in t[1:]}) + 2

    def loss(chosen, t):
        u, c, b = Counter(), Counter(), Counter()
        for k in chosen:
            u.update(tokens[k][1:]), c.update(tokens[k][:-1]), b.update(zip(tokens[k], tokens[k][1:]))
        n, pairs = sum(u.values()), list(zip(t, t[1:]))
        prior = lm_scoring.PRIOR
        return -sum(math.log((b[p, w] + prior * (u[w] + 0.5) / (n + 0.5 * size)) / (c[p] + prior)) for p, w in pairs) / len(pairs)

    assert set(got) == set(tokens) and got[4].score is None
    for k in range(4):
        assert got[k].target_loss == pytest.approx(loss([1, 2], tokens[k]), abs=2e-6)
        assert got[k].background_loss == pytest.approx(loss(tokens, tokens[k]), abs=2e-6)
    other = table([(9, "zz3 zz4")])
    (r,) = lm_scoring.scored(other, lm_scoring.train(frame, good)).collect()
    assert (r.key, r.target_loss, r.background_loss) == (9, got[2].target_loss, got[2].background_loss)


def test_very_long_text(table, spark):
    """A text of more tokens than a chunk has is scored whole."""
    long = " ".join(f"w{i % 997}" for i in range(1_100_000))
    frame = table([(1, long), (2, "w1 w2 w3"), (2, "w1 w2 w3")])
    good = spark.createDataFrame([(2,)], "doc_id long")
    rows = lm_scoring.scored(frame, lm_scoring.train(frame, good)).collect()
    assert sorted(r.n_tokens for r in rows) == [3, 3, 1_100_000]
    assert len({r.score for r in rows if r.key == 2}) == 1 and all(r.score is not None for r in rows)


def test_any_other_columns(table, spark):
    from pyspark.sql import functions as F

    frame = table([(1, "a b a c"), (2, "x y"), (2, "x y"), (None, "a")])
    good = spark.createDataFrame([(1,)], "doc_id long")
    odd = frame.withColumns({"_good": F.lit(5), "key": F.lit("k"), "t": F.lit(1), "weight": F.lit(9), "a.b": F.lit(0)})
    plain, other = (sorted(map(str, lm_scoring.scored(f, lm_scoring.train(f, good)).collect())) for f in (frame, odd))
    assert plain == other and len(plain) == 4
    assert lm_scoring.scored(frame.filter("doc_id > 9"), lm_scoring.train(frame.filter("doc_id > 9"), good)).count() == 0
