"""The pipeline against plain Python, stage by stage and as a whole."""

import random

import duckdb
import test_decontamination
import test_line_dedup
import test_ngram_join

import corpus_pipeline
from tessera.llm import quality_rules

STOP = "the of and to in that is it for on".split()


def prose(seed, words, lines):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(400)] + STOP * 15
    return "\n".join(" ".join(r.choices(vocabulary, k=words // lines)) for _ in range(lines))


def corpus():
    r = random.Random(9)
    docs, items = [], [(i, prose(900 + i, 30, 1)) for i in range(4)]
    for i in range(24):
        docs.append((i, prose(i, 240, 6)))
    docs += [(30, docs[0][1]), (31, docs[1][1] + "\n" + prose(70, 80, 2)), (32, prose(71, 200, 1) + " " + items[1][1])]
    near = prose(72, 200, 1).split()
    docs += [(33, " ".join(near)), (34, " ".join(near[:100] + ["changed"] + near[101:]))]
    docs += [(40, None), (41, ""), (42, "short text"), (43, docs[3][1].upper()), (44, " ".join(w + "###" for w in docs[4][1].split()))]
    r.shuffle(docs)
    return docs, items


def brute(docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    sql = quality_rules.JUDGED_SQL.replace("{docs}", "documents")
    kept = {k for (k,) in con.execute(f"WITH {sql} SELECT doc_id FROM q_v WHERE kept").fetchall()}
    docs = sorted((d, t) for d, t in docs if d in kept)
    clean = test_line_dedup.brute(docs)
    docs = [(d, clean[i]) for i, (d, _) in enumerate(docs) if clean[i].strip()]
    _, label = test_ngram_join.brute(docs)
    docs = [docs[i] for i in sorted(set(label))]
    out = []
    for d, t in docs:
        words = t.lower().split()
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        if not any(len(s & own) >= 0.8 * len(s) for _, s in (test_decontamination.sets(x) for _, x in items)):
            out.append((d, t))
    return out


def test_run_matches_plain_python(table, spark, tmp_path, monkeypatch):
    docs, items = corpus()
    frame = table(docs)
    path = str(tmp_path / "sf")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    want = brute(docs, items)
    assert {30, 32, 34, 40, 41, 42, 43, 44}.isdisjoint(d for d, _ in want) and len(want) > 20
    before = spark.read.parquet(f"{path}/documents.parquet")
    stage = before
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.common.staged(f(spark, stage, path))
        assert stage.columns == before.columns, name
    assert sorted((r.doc_id, r.text) for r in stage.collect()) == want
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted({r.doc_id for r in rows}) == [d for d, _ in want]
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_empty_and_odd_tables(table, spark, tmp_path):
    """No documents at all, and only null, repeated and short ones: no rows, in the same columns."""
    for n, docs in enumerate(([(1, "x")], [(None, None), (None, None), (2, ""), (2, "")])):
        path = str(tmp_path / f"sf{n}")
        frame = table(docs)
        (frame.filter("doc_id > 5") if n == 0 else frame).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_line_stage_with_odd_columns(table, spark):
    """Columns that the stage has inside, a name with a dot, and none of n_chars."""
    line = "a line that is long enough to be looked at as a copy"
    docs = table([(1, line + "\nown words of the first"), (2, line + "\nown words of the second"), (3, line), (4, None)])
    odd = docs.withColumnsRenamed({"n_chars": "n_removed", "key": "a.b", "rank": "n_lines"})
    for frame in (docs, odd):
        out = corpus_pipeline.drop_copied_lines(spark, frame, "")
        assert out.columns == frame.columns
        assert {r.doc_id: r.text for r in out.collect()} == {1: line + "\nown words of the first", 2: "own words of the second", 4: None}
    assert {r.doc_id: r.n_removed for r in corpus_pipeline.drop_copied_lines(spark, odd, "").collect()} == {r.doc_id: r.n_removed for r in odd.collect() if r.doc_id != 3}
