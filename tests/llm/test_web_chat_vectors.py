"""URL filters, archives, chats, embeddings, components and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle_check
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from furrow.llm import (
    chat, common, components, embedding_dedup, minhash_dedup, packing, queries, url_filters, warc,
)
from furrow.session import work_dir

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "COM", "/de/"),
         ("allow", "a.com", "/de/x"), ("block", "both.net", ""), ("allow", "both.net", ""),
         (None, "x", "/"), ("block", None, "/")]


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    common.configure(spark)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    duck = oracle_check.connect(sf_dir)
    assert oracle_check.differences(
        duck, queries.oracle_sql()[name], queries.queries()[name](spark, sf_dir)) == []


def test_registered():
    names = entry_points.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {n.split("_")[0] for n in names}


# URL filters ----------------------------------------------------------------------------------


def plain_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = defaultdict(set)
    for verdict, own, start in RULES:
        if verdict and own is not None and host and path.startswith(start) \
                and (host == own.lower() or host.endswith("." + own.lower())):
            fits[len(own) + len(start), own.lower() + start].add(verdict)
    if not fits:
        return host, path, None, "allow"
    (_, rule), verdicts = max(fits.items())
    return host, path, rule, "block" if "block" in verdicts else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "nothing", "://", "http://", "http://EXAMPLE.org/es/x", "x://a.b.org", "http://org/",
            "http://x.com/de/", "http://a.com/de/x1", "ftp://www.a.com/de/y#z", "http://a.org?q=/es/",
            "http://notexample.org/es/", "http://both.net", "http://sub.both.net/p", "http://..org/",
            "http://É.ORG/ü", "http://a/b\nc", "http://h://x.org/", "http://" + "a." * 3000 + "org/" + "p" * 9000]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, judged int")
    got = url_filters.judge(pages, url_filters.rule_table(spark, RULES))
    assert got.columns == ["page_id", "url", "host", "judged"]
    want = Counter((i, *plain_judge(u)) for i, u, *_ in rows)
    assert Counter((r["page_id"], *r["judged"]) for r in got.collect()) == want
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark, RULES)).count() == 0
    none = url_filters.judge(pages, url_filters.rule_table(spark, []), otherwise="block").collect()
    assert {r["judged"]["verdict"] for r in none} == {"block"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 7 = 0").unionByName(
        spark.createDataFrame([("elsewhere",), (None,), ("elsewhere",)], "key string"))
    chain = url_filters.build(listed, universe)
    assert len(chain.bits) >= 3 and chain.bits == sorted(chain.bits, reverse=True)
    test = url_filters._test(spark, chain)
    wrong = universe.filter(test(url_filters._hash(F.col("key"), chain.seed)) != (F.expr("crc32(key) % 7") == 0))
    assert wrong.count() == 0


# archives -------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", ["134217728", "2000"])
def test_archives(spark, split):
    magic = warc.MAGIC
    fake = magic + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://a/{i}", "x" * (i * 37 % 900) + (fake + magic) * (i % 3 == 0) + "y" * (i % 7 * 400))
            for i in range(40)]
    rows += [(100, "u", None), (101, None, ""), (None, "z", "q" * 2000), (102, "a\r\nContent-Length: 9\r\n", magic * 3),
             (103, "b", magic * 300), (104, "c", magic * 300), (105, "d", "\r\n\r\n" + magic + "\r\n\r\n"),
             (106, "e", "é中" * 400), (107, "f", "s" * 999), (108, "g", "s" * 999), (109, "h", "l" * 50_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, holder string")
    path = work_dir(spark, "warc")
    warc.write(pages.repartition(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.page_records(warc.read(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = set()
    for i, _, html in rows:
        raw = (html or "").encode()
        want.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if i == 103 else "response",
                  104 if i == 103 else None))
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    raw = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    assert raw.startswith("WARC/1.1\r\n") and raw.endswith("\r\n\r\n")


def test_archive_of_pages_with_two_payloads(spark):
    a, b, c, d = (x * 2000 for x in "abcd")
    rows = [(1, a), (1, b), (2, a), (3, c), (3, d), (4, c), (5, d), (6, a), (6, "small"), (1, a)]
    pages = spark.createDataFrame([(i, "u", html) for i, html in rows], "page_id long, url string, html string")
    path = work_dir(spark, "warc")
    warc.write(pages, path)
    records = warc.read(spark, path)
    holder = {a: 6, b: 1, c: 4, d: 5, "small": 6}
    want = Counter((i, len(x), hashlib.sha1(x.encode()).hexdigest(), "response" if holder[x] == i else "revisit",
                    None if holder[x] == i else holder[x]) for i, x in rows)
    assert Counter(map(tuple, warc.page_records(records).collect())) == want
    named = {r["own"]: r["digest"] for r in records.filter(warc.field("WARC-Type") == "response").select(
        warc.field("WARC-Record-ID").alias("own"), "digest").collect()}
    assert len(named) == 5
    for r in records.filter(warc.field("WARC-Type") == "revisit").select(
            warc.field("WARC-Refers-To").alias("to"), warc.field("WARC-Payload-Digest").alias("sha1")).collect():
        assert "sha1:" + named[r["to"]] == r["sha1"]


def test_archive_of_no_pages(spark):
    path = work_dir(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read(spark, path)).count() == 0


def test_a_broken_chain_ends_its_file(spark):
    record = lambda n, body: f"{warc.MAGIC}WARC-Page-ID: {n}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    path = work_dir(spark, "warc")
    text = record(1, "one") + record(2, "two") + "stray bytes" + record(3, "three")
    spark.createDataFrame([(text,)], "value string").write.text(path)
    assert [r["header"].count("Page-ID: ") for r in warc.read(spark, path).orderBy("at").collect()] == [1, 1]


# chats ----------------------------------------------------------------------------------------


def test_quotations_make_threads(spark):
    rows = [
        (1, 0, "First point is here. Second point stands too.\nA third line of text"),
        (1, 1, "A wholly different answer here."),
        (1, 2, "Anna wrote:\n> First point is here. Second\n> point stands too.\nI agree with you"),
        (1, 3, "> > First point is here.\n> I agree with you\nMe as well then"),
        (1, 4, None), (1, 9, "> nobody said this ever\nfresh start"), (1, 10, ">> FIRST point, is here!\n\nback to it"),
        (2, 0, "I agree with you"), (2, 1, "> I agree with you\n> I agree with you"), (None, 0, "> First point is here."),
        (3, None, "x > y"), (1, 0, "again the same turn said"), (2, 2, "> again the same turn said\nnot of this one"),
    ]
    chats = spark.createDataFrame([(*r, "user", 7) for r in rows], "conv_id long, turn long, text string, role string, depth int")
    got = {(r["conv_id"], r["turn"], r["text"]): (r["thread"], r["parent"], r["depth"])
           for r in chat.reply_order(chats).collect()}
    assert got == {
        (1, 0, rows[0][2]): (0, None, 0), (1, 0, "again the same turn said"): (0, None, 0),
        (1, 1, rows[1][2]): (0, 0, 1), (1, 2, "I agree with you"): (0, 0, 1),
        (1, 3, "Me as well then"): (0, 2, 2), (1, 4, ""): (0, 3, 3), (1, 9, "fresh start"): (9, None, 0),
        (1, 10, "back to it"): (0, 0, 1), (2, 0, "I agree with you"): (0, None, 0), (2, 1, ""): (0, 0, 1),
        (2, 2, "not of this one"): (0, 1, 2), (None, 0, ""): (0, None, 0), (3, None, "x > y"): (None, None, 0),
    }
    assert chat.reply_order(chats.limit(0)).count() == 0


def test_turns_with_gaps(spark):
    rows = [(1, t, f"message {t}") for t in range(0, 400, 2)] + [(2, 7, "one"), (2, 1000, "two"), (3, 5, "alone"),
            (4, -10, "here is something said"), (4, 3, "another"), (4, 90, "> here is something said\nyes"), (4, 95, "on")]
    chats = spark.createDataFrame([(*r, "u") for r in rows], "conv_id long, turn long, text string, role string")
    got = {(r["conv_id"], r["turn"]): (r["thread"], r["parent"], r["depth"])
           for r in chat.reply_order(chats.repartition(5)).collect()}
    want = {(1, t): (0, t - 2 if t else None, t // 2) for t in range(0, 400, 2)}
    assert got == want | {(2, 7): (7, None, 0), (2, 1000): (7, 7, 1), (3, 5): (5, None, 0), (4, -10): (-10, None, 0),
                          (4, 3): (-10, -10, 1), (4, 90): (-10, -10, 1), (4, 95): (-10, 90, 2)}


def test_short_and_unspaced_quotations_link(spark):
    rows = [
        (1, 0, "Shall we go there?"), (1, 1, "Yes, please."), (1, 2, "How come?"), (1, 3, "Nothing of the kind."),
        (1, 4, "> Yes, please.\nfine"), (1, 5, "> How come?\nso"), (1, 6, "> nothing here\n> ...\nwell"),
        (2, 0, "你好，我想问一下。今天天气怎么样？"), (2, 1, "今天天气很好"), (2, 2, "> 今天天气怎么样？\n谢谢"),
        (2, 3, "> 今天天气很好\n好的"),
        # a long sentence outranks short ones, and a whole passage those who said parts of it later
        (3, 0, "The meeting is on Monday. Yes."), (3, 1, "Yes."), (3, 2, "OK."), (3, 3, "No."),
        (3, 4, "> The meeting is on Monday.\n> Yes.\n> OK.\n> No.\nright"),
        (4, 0, "Yes. OK."), (4, 1, "Yes."), (4, 2, "OK."), (4, 3, "> Yes. OK.\nboth"),
    ]
    chats = spark.createDataFrame([(*r, "u") for r in rows], "conv_id long, turn long, text string, role string")
    got = {(r["conv_id"], r["turn"]): (r["parent"], r["n_quoted"]) for r in chat.reply_order(chats).collect()}
    want = {(1, 4): (1, 1), (1, 5): (2, 1), (1, 6): (5, 0), (2, 2): (0, 1), (2, 3): (1, 1), (3, 4): (0, 1),
            (4, 3): (0, 1)}
    assert {k: got[k] for k in want} == want


def test_long_chain(spark):
    chats = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                    F.lit("u").alias("role"), F.lit("text").alias("text"))
    rows = chat.reply_order(chats).collect()
    assert all((r["thread"], r["depth"]) == (0, r["turn"]) for r in rows)


def test_all_messages_stay(spark, sf_dir):
    chats = common.table(spark, sf_dir, "conversations")
    got = queries.queries()["op7_chat_threads"](spark, sf_dir)
    assert Counter(map(tuple, got.select("conv_id", "turn", "role", "text").collect())) == \
        Counter(map(tuple, chats.select("conv_id", "turn", "role", "text").collect()))


# components and embeddings --------------------------------------------------------------------


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    up = {x: x for p in links for x in p if p[0] != p[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    assert {tuple(r) for r in components.components(df).collect()} == {(x, find(x)) for x in up}


def test_components_of_a_path(spark):
    df = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component"] for r in components.components(df).collect()} == {0}


def plain_links(rows, threshold=0.95):
    """Number of links per place, and the components by id."""
    usable = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v
              and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n, up = Counter(), {rows[k][0]: rows[k][0] for k in usable}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, k in enumerate(usable):
        for m in usable[:p]:
            a, b = (np.array(rows[x][1], float) for x in (k, m))
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                n[k] += 1
                n[m] += 1
                x, y = find(rows[k][0]), find(rows[m][0])
                up[max(x, y)] = min(x, y)
    return n, {i: find(i) for i in up}


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(16)
        for k in range(rng.integers(1, 6)):
            rows.append([float(np.float32(x)) for x in base + 0.12 * k * rng.standard_normal(16)])
    dense = rng.standard_normal(16)
    rows += [[float(np.float32(x)) for x in dense + 0.2 * rng.standard_normal(16)] for _ in range(40)]
    rows += [rows[0]] * 3 + [[2 * x for x in rows[0]], [0.0] * 16, None, [], [1.0, None] * 8, [float("nan")] * 16,
                             [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16]
    rows = [(i, v) for i, v in enumerate(rows)] + [(None, rows[0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    n, component = plain_links(rows)
    got = embedding_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    links = sum(r["n_links"] for r in got)
    assert links <= sum(n.values()) and links >= 0.98 * sum(n.values())
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            continue
        assert r["component_id"] == component.get(r["vec_id"], r["vec_id"])
        assert r["kept"] == (r["component_id"] == r["vec_id"])
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    y = x + rng.uniform(0, 1, (400, 1)) * rng.standard_normal((400, 64))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    bits = embedding_dedup.codes(y)
    factor = embedding_dedup.factors(y, bits)
    turned = x @ embedding_dedup.rotation(64, 0)
    estimate = (turned * np.where(bits, 1, -1)).sum(axis=1) / 8 / factor
    error = estimate - (x * y).sum(axis=1)
    bound = embedding_dedup.BOUND * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).all()


# pipeline -------------------------------------------------------------------------------------


def odd_documents(spark):
    words = "the and with that this for was not are from have which their were been".split()
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    copy = text(80)
    rows = [(i, copy if i % 5 == 0 else text(40), "en", ("a", "b", None)[i % 3], 1) for i in range(30)]
    rows += [(40, None, None, "a", 0), (41, "", "en", "b", 0), (42, "12 34", "en", "a", 5), (None, text(30), "en", "a", 1),
             (43, text(5000), "en", "c", 1), (1, text(30), "en", "a", 1), (2, rows[2][1], "en", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumn("language", F.lit(1)).withColumn("token", F.lit("t")).withColumn("__id", F.lit(2))


def test_stages(spark, sf_dir):
    docs = odd_documents(spark)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for empty in (docs.limit(0),):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, sf_dir).count() == 0
    known = common.stored(corpus_pipeline.known_languages(spark, docs, sf_dir), "t")
    assert known.columns == docs.columns
    assert Counter(r["doc_id"] for r in docs.collect()) - Counter(r["doc_id"] for r in known.collect()) == \
        Counter([40, 41, 42])
    single = common.stored(corpus_pipeline.without_near_duplicates(spark, known, sf_dir), "t")
    assert single.columns == docs.columns
    want = {r["doc_id"] for r in minhash_dedup.near_duplicates(known).filter("kept").collect()}
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(want)
    mixed = common.stored(corpus_pipeline.mixed_sources(spark, single, sf_dir), "t")
    assert mixed.columns == docs.columns
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert set(taken) <= want and max(taken.values()) <= 2
    packed = corpus_pipeline.packed_sequences(spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken


def test_run_over_tables(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    kept = {r["doc_id"] for r in minhash_dedup.near_duplicates(docs).filter("kept").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} <= kept
    size, ids = defaultdict(int), {}
    for r in rows:
        size[r["sequence_id"]] += r["length"]
        ids.setdefault((r["doc_id"], r["piece"]), set()).add((r["start"], r["length"], r["ids_crc32"]))
    assert max(size.values()) <= 1024 and all(len(v) == 1 for v in ids.values())
    assert len(size) <= 1.02 * sum(size.values()) / 1024 + 1
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = [r for r in rows if r["piece"] == 0][:20]
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    for r in some:
        own = np.array(t.encode(plain[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert r["ids_crc32"] == zlib.crc32(own[:r["length"]].tobytes())
    assert packing.Capacity().tokens == 1024


@pytest.mark.parametrize("dim", [1, 2, 7, 64])
def test_stored_codes_close_strangers_and_keep_links(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, dim))
    y = x + 0.2 * rng.standard_normal((300, dim))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))

    def side(v):
        return embedding_dedup.Side.of([
            {"code": c.tobytes(), "factor": f, "turned": t.tobytes(), "unit": u}
            for c, f, t, u in zip(*embedding_dedup.sketches(v), strict=True)], dim)

    left_open = embedding_dedup.undecided(side(x), side(y), 0.95)
    assert left_open[x @ y.T >= 0.95].all()
    if dim == 64:
        assert left_open.mean() < 0.02


def test_both_scans_of_archives_split_alike(spark, monkeypatch):
    key, seen, lines = "spark.sql.files.minPartitionNum", [], warc._lines

    def counted(session, path):
        seen.append(session.conf.get(key))
        return lines(session, path)

    monkeypatch.setattr(warc, "_lines", counted)
    path = work_dir(spark, "warc")
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    warc.write(spark.createDataFrame([(i, "u", f"{i}{inner}") for i in range(30)],
                                     "page_id long, url string, html string"), path)
    got = warc.page_records(warc.read(spark, path)).collect()
    assert {r["page_id"]: r["payload_digest"] for r in got} == {
        i: hashlib.sha1(f"{i}{inner}".encode()).hexdigest() for i in range(30)}
    assert len(seen) == 2 and len(set(seen)) == 1
    assert spark.conf.get(key, None) is None
