import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, spelling_variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one inserted, deleted or replaced letter, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    found, forms = {w: [v for v in n if near(w, v)] for w in n}, {}
    for w, own in found.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted((w, forms.get(w, ""), root(w), n[w], len(found[w]), n[forms[w]] if w in forms else 0) for w in n)


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def variant(r, w):
    i, c = r.randrange(len(w)), r.choice("abcdefgé")
    return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, w[:1] * 2 + w[1:], w.title(), w.upper()])


@pytest.fixture(scope="module")
def docs(table):
    r = random.Random(4)
    base = ["".join(r.choices("abcdefghijklmnopé", k=r.randint(4, 14))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "x" * 3000, "x" * 2999]
    texts = []
    for _ in range(150):
        own = [variant(r, w) if r.random() < 0.3 else w for w in r.choices(base[:12] if r.random() < 0.5 else base, k=30)]
        texts.append(r.choice([" ", ", ", "\n", "7"]).join(own))
    for word, n in (("zzzaaaa", 4), ("zzzaaab", 10), ("zzzaabb", 24), ("zzzabbb", 60)):
        texts += [word] * n
    given = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3]), (900, None), (901, ""), (902, "× naïve NAÏVE naïve naïve")]
    return given, table(given)


def test_against_all_pairs(docs):
    given, df = docs
    want = plain(given)
    assert rows(spelling_variants.variants(df)) == want
    assert sum(w[1] != "" for w in want) > 50 and sum(w[2] not in (w[0], w[1]) for w in want) >= 2


@pytest.mark.parametrize("bucket", [1, 3, 20])
def test_parted_buckets_lose_and_repeat_no_pair(docs, spark, bucket):
    given, df = docs
    want = {w: k for w, _, _, _, k, _ in plain(given) if k}
    vocabulary = common.staged(spelling_variants.words(df))
    assert {r.word: r.n_near for r in spelling_variants.near_words(vocabulary, bucket).collect()} == want
    sizes = spelling_variants.buckets(vocabulary, bucket).groupBy("m", "a", "below", "key").count()
    # what is larger leaves one letter open
    assert sizes.filter((F.col("count") > bucket) & (F.col("below") - F.col("a") > 1)).isEmpty()


def test_dense_words_in_many_lanes(spark):
    r = random.Random(9)
    vocabulary = sorted({"stem" + "".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(600)})
    df = common.staged(spark.createDataFrame([(w, i % 7 + 3) for i, w in enumerate(vocabulary)], "word string, n long"))
    n = {w: i % 7 + 3 for i, w in enumerate(vocabulary)}
    want = {}
    for w in vocabulary:
        own = [v for v in vocabulary if near(w, v)]
        if own:
            want[w] = (len(own), *min((-n[v], v) for v in own))
    assert {r.word: (r.n_near, -r.best_n, r.best) for r in spelling_variants.near_words(df).collect()} == want


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("v", "w7")], "word string, form string")
    assert {r.root for r in spelling_variants.roots(forms).collect()} == {"w20"}


def test_empty_tables(table):
    assert spelling_variants.variants(table([])).count() == 0
    assert spelling_variants.variants(table([(1, None), (2, "a b c"), (3, "once upon")])).count() == 0


def test_sql_on_the_smallest_tables(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted((w, f or "", root, n, k, m or 0) for w, f, root, n, k, m in con.execute(spelling_variants.SQL).fetchall())
    assert rows(spelling_variants.op11_spelling_variants(spark, sf_dir)) == want
