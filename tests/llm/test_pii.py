"""Personal data against plain Python, and the model against what it should learn."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.llm import common, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    common.configure(spark)


def checks(kind, hit):
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(
            d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return True


def plain(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items())
             for m in re.finditer(p, text or "") if checks(kind, m.group())]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def agrees(row, text):
    base = plain(text)
    spans = [s for s in row.spans.split(",") if s]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in base) for k in BASE]
    assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) <= set(spans)
    assert len(spans) == len(base) + row.n_added
    order = [(int(a), list(BASE).index(k)) for k, a, _ in (s.split(":") for s in spans)]
    assert order == sorted(order)
    mask = [None] * len(text or "")
    for s in set(spans) - set(base):
        _, a, b = s.split(":")
        assert mask[int(a):int(b)] == [None] * (int(b) - int(a))
        mask[int(a):int(b)] = ["x"] * (int(b) - int(a))


def judge(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in pii.personal_data(docs).collect()}


ODD = [
    None, "", " ", "a@b.c", "a@b.c_d@e.f", "a@b.c.d@e.f..", "x..y@z.com.", "@b.c a@.c a@b", "a@b.c@d.e",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256", "0001.002.3.4", "00000000000000000000001.2.3.4", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0000 0000 0000", "1-1", "12",
    "4111111111111111" * 2, "+1 (017) 555-7713", "+1 (017) 555-7713-", "+1234567", "++49 30 1234567 (", "+4 ((((( 9",
    "\x01a@b.c\x01 \x02 4111111111111111\x01", "é😀 a@b.c 😀1.2.3.4ß +49 30 123 456 78", "a" * 2000 + "@b.c",
    "9" * 2000, "a." * 1000, "1 " * 2000, "+1" * 1000, "a@b.c " * 1500 + "1.2.3.4",
    "write to jo [at] mail [dot] com or (030) 555-7713", "10[.]1[.]2[.]3 $0 \\1",
]


def test_odd_texts(spark):
    found = judge(spark, ODD)
    for i, text in enumerate(ODD):
        agrees(found[i], text)


def test_very_long_runs_are_read_once(spark):
    texts = ["a" * 500_000 + "@b.c", "9" * 500_000, "a." * 200_000, "1 " * 200_000, "+1" * 100_000,
             "1.2.3.4 " * 20_000, "a" * 500_000 + "@", "+1" + "(" * 300_000]
    found = judge(spark, texts)
    assert [found[i].n_email for i in range(8)] == [1, 0, 0, 0, 0, 0, 0, 0]
    assert [found[i].n_ip for i in range(8)] == [0, 0, 0, 0, 0, 20_000, 0, 0]
    assert found[0].spans == "email:0:500004"
    assert found[5].spans.endswith(",ip:159992:159999")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1.@-+ 4()_%é\x01,", max_size=60), min_size=60, max_size=120))
def test_random_texts(spark, texts):
    found = judge(spark, texts)
    for i, text in enumerate(texts):
        agrees(found[i], text)


def test_given_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        agrees(r, texts[r.doc_id])


def test_empty_repeated_and_clashing(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "1.2.3.4"), (2, None)], "doc_id long, text string")
    more = docs.withColumns({c: F.lit("x") for c in ("found", "p1", "base", "a.b", "kind", "e0")})
    rows = sorted(((r.doc_id or 0, r.spans) for r in pii.personal_data(more).collect()))
    assert rows == [(0, "ip:0:7"), (1, "email:0:5"), (1, "email:0:5"), (2, "")]


def test_reliabilities_of_planted_labelers():
    rng = random.Random(3)
    right, cast = [0.95, 0.8, 0.9, 0.6, 0.75], [1, 1, 0.5, 0.8, 1]
    counts: dict = {}
    for _ in range(20_000):
        truth = rng.random() < 0.6
        votes = tuple(int(truth if rng.random() < r else not truth) if rng.random() < c else pii.SILENT
                      for r, c in zip(right, cast, strict=True))
        counts[votes] = counts.get(votes, 0) + 1
    prior, weights = pii.reliabilities([(1, v, n) for v, n in counts.items()])
    assert abs(1 / (1 + 2.718281828 ** -prior[1]) - 0.6) < 0.05
    order = sorted(pii.LABELERS, key=lambda n: -weights[1, n, pii.YES])
    assert order[0] == "form" and order[-1] == "edges"
    assert all(weights[1, n, pii.YES] > 0 > weights[1, n, pii.NO] for n in pii.LABELERS)


def test_classifier_adds_what_looks_like_the_rest_and_leaves_codes(spark):
    rng = random.Random(5)
    def number():
        return f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"please call +1 {number()} today, thanks" for _ in range(300)]
    texts += [f"phone {number()} now" for _ in range(100)]
    texts += [f"build hash={rng.randint(10**15, 10**16 - 1)}f and token a{rng.randint(100, 999)}-555-1234x" for _ in range(200)]
    texts += ["nothing to see here, 12 of 30"] * 200
    found = judge(spark, texts)
    added = [found[i].n_added for i in range(len(texts))]
    assert sum(added[300:400]) >= 90
    assert sum(added[400:]) == 0
    for i, text in enumerate(texts):
        agrees(found[i], text)


def test_no_python_on_the_executors(spark, sf_dir):
    plan = pii.personal_data(common.table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
