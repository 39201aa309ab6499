import random

from tessera.llm import decontamination


def sets(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_matches_exact_containment(table, spark, prose):
    r = random.Random(1)
    items = [(i, prose(500 + i, r.choice([6, 20, 33, 64, 100]))) for i in range(40)] + [(90, "just three words"), (91, ""), (92, None), (93, prose(501, 20))]
    docs = []
    for i in range(60):
        w = prose(i, r.choice([10, 300, 3000])).split()
        for _, t in r.sample(items[:41], 2):
            part = t.split()
            if r.random() < 0.5:
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "just THREE words"), (102, "just THREE words")]
    want = []
    for d, t in docs:
        words = (t or "").lower().split()
        for i, x in items:
            n, s = sets(x)
            if s:
                own = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
                if len(s & own) >= 0.8 * len(s):
                    want.append((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 200):
        got = decontamination.contaminated(table(docs), bench, most=most)
        assert sorted((x.key, x.item) for x in got.collect()) == sorted(want)
    clean = decontamination.keep_clean(table(docs), bench)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, _ in docs if d not in {a for a, _ in want})
    assert decontamination.contaminated(table(docs), bench.limit(0)).count() == 0


def test_odd_tables(table, spark, prose):
    item = prose(1, 30)
    bench = spark.createDataFrame([(None, item), ("b", item), ("c", None)], "item_id string, text string")
    docs = table([(None, item), (2**60 + 1, prose(2, 60_000) + " " + item + " " + prose(3, 60_000)), (3, None), (3, item), (3, item)])
    got = sorted((str(x.key), str(x.item)) for x in decontamination.contaminated(docs, bench).collect())
    assert got == sorted((k, i) for k in ("None", str(2**60 + 1), "3", "3") for i in ("None", "b"))
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns and [x.doc_id for x in clean.collect()] == [3]
    assert decontamination.contaminated(docs.filter("doc_id < 0"), bench).count() == 0
