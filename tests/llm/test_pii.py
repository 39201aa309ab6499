import hashlib
import random
import re
import time

import pytest

from tessera.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), n, k, m.end()) for n, k in enumerate(FORMS) for m in re.finditer(FORMS[k], text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TEXTS = [
    None, "", "mail a.b+c@x-y.example.com, x@y, a@b.c@d.e a@b.com_x@y.z @a.b.", "é 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 5 42 4111111111111111", "+1 (743) 555-3824 and +4912 x +1+49 170 1234567.",
    "+" + "1 " * 30, "9" * 30000, "1.1" * 9000, "a" * 50000 + "@b", "日本 x@y.zz 日本 10.1.1.1", "a.b." * 5000 + "@c.d",
]


def test_base_spans_match_plain_search(table):
    docs = table(list(enumerate(TEXTS)) + [(2, TEXTS[2])])
    spans = {}
    rows = pii.common.with_row_id(docs.select("doc_id"))
    for r in pii.pii_spans(docs).filter("base").join(rows, "_row").collect():
        spans.setdefault(r.doc_id, []).append((r.start, list(FORMS).index(r.kind), r.kind, r.end))
    for i, t in enumerate(TEXTS):
        got = sorted(spans.get(i, []))[:: 2 if i == 2 else 1]
        assert ",".join(f"{k}:{a}:{b}" for a, _, k, b in got) == base(t), i


def test_patterns_discover_unseen_identifiers(table):
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(40)]
    docs = [(i, f"the api token = {k} was sent, section {i} of it") for i, k in enumerate(keys)]
    docs += [(50, "the api token = ab-4471-9923 was sent again"), (51, "in 1999 the number 4471 was seen")]
    docs += [(60, f"a key alone {hashlib.md5(b'x').hexdigest()} has no pattern")]
    tokens = pii.instances(pii.occurrences(table(docs)).filter("kind = 'token'"))
    seeds = {r.core for r in tokens.filter("seed = 'secret'").collect()}
    assert 5 < len(seeds & set(keys)) < 35  # a share of the keys is listed, the patterns find the rest
    spans = pii.pii_spans(table(docs)).filter("not base").collect()
    assert sum(s.end - s.start == 32 for s in spans) == 40
    assert [(s.start, s.end) for s in spans if s.end - s.start != 32] == [(16, 28)]


def test_no_span_without_a_pattern(table):
    """Forms other than the base ones add nothing by themselves."""
    docs = [(i, f"{'abcdefgh'[i]} word {hashlib.md5(str(i).encode()).hexdigest()} {'stuvwxyz'[i]} end") for i in range(8)]
    assert pii.pii_spans(table([(i, t.replace("word", f"w{t[0]}")) for i, t in docs])).count() == 0


def test_conflicting_instances_spoil_a_pattern(table):
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(40)]
    docs = [(i, f"value of {k} here") for i, k in enumerate(keys)] + [(100 + i, f"value of {i * 1001} here") for i in range(200)]
    assert pii.pii_spans(table(docs)).filter("not base").count() == 0


def test_held_out_secrets_of_the_tables(spark):
    """The share of secrets that are no seeds and come back through patterns, on the given tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = pii.common.staged(pii.instances(pii.occurrences(docs).filter("kind = 'token'")))
    held = tokens.filter(pii.F.col("core").rlike(pii.SECRET_FORM) & pii.F.col("seed").isNull()).select("core").distinct()
    found = pii.common.staged(pii.believed(tokens))
    back = found.filter("kind = 'secret'").join(held, "core").count()
    assert found.filter("not coalesce(seed, false)").count() >= back > 0
    assert back >= 0.8 * held.count()


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "x@y.zz"), (None, "x@y.zz")]])
def test_odd_tables(table, rows):
    assert pii.pii_spans(table([(1, "")] + rows)).count() == sum(t is not None for _, t in rows)


def test_secrets_in_runs_and_long_keys(table):
    key = hashlib.md5(b"key").hexdigest()
    long = hashlib.sha512(b"key").hexdigest()
    others = [(100 + i, f"token = {hashlib.md5(str(i).encode()).hexdigest()} end") for i in range(40)]
    docs = table([(0, f"token = {key} 4111111111111111 end"), (1, f"token = {long} end"), (2, f"token = {key} 8 end"), *others])
    rows = pii.common.with_row_id(docs.select("doc_id"))
    spans = pii.pii_spans(docs).join(rows, "_row").filter("doc_id < 100").collect()
    assert {(s.doc_id, s.kind, s.start, s.end) for s in spans} == {
        (0, "secret", 8, 40), (0, "card", 41, 57), (1, "secret", 8, 136), (2, "secret", 8, 42)
    }


def test_long_neighbours_are_whole_words(table):
    """Context words are not cut, and a very long one is no other word's end."""
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(40)]
    docs = [(i, f"{'z' * 100}token = {k} end") for i, k in enumerate(keys)]
    (patterns,) = {tuple(r.patterns[:2]) for r in pii.instances(pii.occurrences(table(docs)).filter("kind = 'token'")).collect()}
    assert patterns == ("1 =", "2 " + "z" * 100 + "token =")


def test_a_long_row_of_numbers_costs_what_it_is_long(table):
    """A megabyte of numbers is one run: its tokens carry its place, not its text."""
    r = random.Random(3)
    row = " ".join(str(r.randrange(10**5, 10**8)) for _ in range(110_000))
    assert len(row) > 900_000
    docs = table([(1, row), (2, "call +49 (30) 1234-5678 now"), (3, row[:200_000] + " mail a.b@example.com " + row[:100])])
    start = time.time()
    spans = pii.pii_spans(docs).collect()
    assert time.time() - start < 120
    assert sum(s.kind == "phone" and s.base for s in spans) == 1 and sum(s.kind == "email" and s.base for s in spans) == 1
    tokens = pii.instances(pii.occurrences(docs).filter("kind = 'token'"))
    # the run itself and each of its numbers, whose rows are short
    assert tokens.filter("part").count() > 130_000 and tokens.filter("part").selectExpr("max(length(core)) AS n").first().n < 40
