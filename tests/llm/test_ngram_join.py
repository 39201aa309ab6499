import random

from tessera.llm import ngram_join


def sets(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs):
    s = [sets(t) for _, t in docs]
    n = len(docs)
    links = [[j for j in range(n) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                label[i] = label[j] = min(label[i], label[j])
    return links, label


def near(text, r, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def test_bands_reach_the_recall():
    n, rows = ngram_join.bands()
    assert 1 - (1 - 0.8**rows) ** n >= 0.999 and n * rows <= 64


def test_links_and_groups_match_brute_force(table, prose):
    r = random.Random(4)
    docs = []
    for i in range(30):
        base = prose(i, 120)
        docs += [(len(docs), base)]
        docs += [(len(docs) + x, near(base, r, r.choice([1, 2, 3, 6]))) for x in range(r.randrange(4))]
    big = prose(99, 150)
    docs += [(len(docs) + x, near(big, r, r.choice([1, 2, 3]))) for x in range(60)]
    docs += [(1000, big), (1001, big), (1002, "one two"), (1003, "one two"), (1004, ""), (1005, None), (1006, "")]
    links, label = brute(docs)
    got = {x.key: x for x in ngram_join.linked_documents(table(docs)).collect()}
    for i, (key, _) in enumerate(docs):
        assert got[key].n_links == len(links[i]), key
        assert got[key].class_id == docs[label[i]][0], key
    kept = ngram_join.keep_first(table(docs))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({docs[x][0] for x in label})


def test_block_pairs(table, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(5)
    base = prose(7, 200)
    docs = [(i, near(base, r, 2)) for i in range(40)]
    links, _ = brute(docs)
    got = {x.key: x.n_links for x in ngram_join.linked_documents(table(docs)).collect()}
    assert [got[i] for i in range(40)] == [len(x) for x in links]


def test_odd_tables(table, prose):
    docs = table([(None, prose(1, 80)), (None, prose(1, 80)), (3, None)])
    assert sorted((x.n_links, x.key, x.class_id) for x in ngram_join.linked_documents(docs).collect() if x.key) == [(0, 3, 3)]
    assert [(x.n_links, x.class_id) for x in ngram_join.linked_documents(docs).collect() if x.key is None] == [(1, None)] * 2
    assert ngram_join.keep_first(docs).count() == 2
    assert ngram_join.keep_first(docs).columns == docs.columns
    assert ngram_join.linked_documents(docs.filter("doc_id > 5")).count() == 0


def test_text_ids_great_ids_and_long_texts(table, prose):
    long = prose(5, 60_000)
    docs = table([(2**60 + 1, long), (2**60 + 2, long + " more"), (2**60 + 3, prose(6, 60)), (None, "")])
    rows = {x.key: x for x in ngram_join.linked_documents(docs).collect()}
    assert rows[2**60 + 2].class_id == 2**60 + 1 and rows[2**60 + 2].n_links == 1 and rows[2**60 + 3].n_links == 0
    named = docs.withColumn("doc_id", ngram_join.F.concat(ngram_join.F.lit("d"), "doc_id"))
    assert {x.key: x.class_id for x in ngram_join.linked_documents(named).collect()}[f"d{2**60 + 2}"] == f"d{2**60 + 1}"
