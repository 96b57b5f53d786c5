"""Tokens, fingerprints, languages, near duplicates, mixing, packing: against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import (
    bpe, common, fingerprints, language_id, minhash_dedup, mixing, packing, queries, shingles,
    token_files,
)
from furrow.session import work_dir

DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    common.configure(spark)


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_DDL)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tied, repeated and long texts, null ids, and clashing extra columns."""
    rows = [
        (1, "", "en", "a"), (2, None, "en", None), (3, " \n\t ", None, "a"), (4, "Word", "en", "b"),
        (5, "one two  three\n\nfour. five, six", "en", "b"), (6, "one two  three\n\nfour. five, six", "en", "b"),
        (6, "one two  three\n\nfour. five, six", "en", "b"), (7, "same id first text of two rows here", "en", "a"),
        (7, "same id other text of two rows there", "en", "a"), (None, "no id at all for this one", "en", "a"),
        (8, "lorem ipsum " * 30_000, "en", None), (9, "ünï cödé – “quoted” 12'345 it's ok", "de", "c"),
    ]
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, "
        "size int, component_id string").withColumn("token", F.lit(1)).withColumn("id", F.lit("z"))


def empty(spark):
    return spark.createDataFrame([], DOC_DDL)


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


# token ids ------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcA é.,'!#\n\t  　中1<|endoftext>"), max_size=40), max_size=6))
def test_word_wise_encoding_is_that_of_whole_texts(texts):
    ids, lengths = bpe.encoder(queries.tokenizer_path()).encode(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [plain_ids(t) for t in texts]


def test_encoder_forgets_and_stays_right():
    small = bpe.Encoder(queries.tokenizer_path(), max_words=2)
    for text in ("alpha beta gamma", "delta beta, alpha", "alpha beta gamma"):
        assert small.encode(pa.array([text]))[0].tolist() == plain_ids(text)


class Recorded:
    """A tokenizer that notes how many words are encoded at once."""

    def __init__(self, inner):
        self.inner, self.sizes = inner, []

    def encode_batch(self, words, **kwargs):
        self.sizes.append(len(words))
        return self.inner.encode_batch(words, **kwargs)


def test_encoder_holds_results_of_few_words_at_a_time():
    codec = bpe.Encoder(queries.tokenizer_path())
    codec.tokenizer = Recorded(codec.tokenizer)
    digits = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(i).translate(digits) for i in range(100_000, 140_000))
    assert codec.encode(pa.array([text]))[0].tolist() == plain_ids(text)
    assert sum(codec.tokenizer.sizes) == 40_001  # the first word with and without a space
    assert max(codec.tokenizer.sizes) <= 1 << 14


def test_words_between_marks_and_white_space_are_encoded_once():
    codec = bpe.Encoder(queries.tokenizer_path())
    codec.tokenizer = Recorded(codec.tokenizer)
    marks = [m + e for m in ",.;:!?)" for e in (" ", "  ", "\n", "\n\n", " \n", "1 ", "\" ")]
    text = " (gamma delta" + "".join(m + a + m + b for m in marks for a, b in (
        ("gamma", "delta"), ("(gamma", "delta"), ("gamma", "'delta'")))
    ids, lengths = codec.encode(pa.array([text, "", text]))
    assert ids.tolist() == 2 * plain_ids(text) and lengths.tolist() == [len(ids) // 2, 0, len(ids) // 2]
    assert sum(codec.tokenizer.sizes) < 50  # each of 49 marks would make several words


# white space in all its forms, what only looks like it, contractions, letters and digits of all kinds
HARD = [*"abZé '.,!0 1\n  \t\r\v\f\x00\x1c\x1f\x7f\x85\xa0\u1680\u180e\u2003\u200a\u200b\u2019\u201d\u2028\u202f"
        "\u205f\u2060\u3000\u3001\ufeff中文あ\u0301ªº×÷²½٣ÀÿſƀжЖ-_<>|()\"@", "😀", "'s", "'ll", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(HARD), max_size=12).map("".join), max_size=5))
def test_pieces_never_cross_what_the_vocabulary_cuts(texts):
    codec = bpe.encoder(queries.tokenizer_path())
    ids, lengths = codec.encode(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
    whole = [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [p.tolist() for p in parts] == whole


def test_pipeline_packs_the_same_pieces_with_less_memory(spark, sf_dir, monkeypatch):
    docs, asked = common.table(spark, sf_dir, "documents"), []
    cut = packing.cut
    monkeypatch.setattr(packing, "cut", lambda *a: asked.append(a[-2:]) or cut(*a))
    found = corpus_pipeline.packed_sequences(spark, docs, sf_dir)
    plain = packing.pack(docs, queries.tokenizer_path(), end=corpus_pipeline.END)
    small, usual = asked
    assert small[0] < usual[0] and small[1] < usual[1]
    few = packing.pack(docs, queries.tokenizer_path(), corpus_pipeline.END, chunk_bytes=1000, max_words=10)
    pieces = [Counter(tuple(r)[:5] for r in df.collect()) for df in (found, plain, few)]
    assert pieces[0] == pieces[1] == pieces[2]


def test_packing_encodes_no_text_whole():
    class NoWhole(Recorded):
        def encode(self, *args, **kwargs):
            raise AssertionError("a whole text goes to the library")

    codec = bpe.Encoder(queries.tokenizer_path())
    texts = ["a  list\n  of (words), (words).\n\nend ", " a\tlist ", "", "of\u00a0words  \u3000 list"]
    wanted = [plain_ids(t) + [2] for t in texts]
    codec.tokenizer = NoWhole(codec.tokenizer)
    assert bpe.with_end(*codec.encode(pa.array(texts)), 2)[0].tolist() == sum(wanted, [])


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_coding_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)


def test_frequent_ids_get_low_ranks():
    table, ranks = token_files.rank(np.array([9, 7, 7, 3, 7, 3]))
    assert table.tolist() == [7, 3, 9] and ranks.tolist() == [2, 0, 0, 1, 0, 1]


def test_token_files(spark, odd):
    path = work_dir(spark, "tokens")
    token_files.write(odd, path, queries.tokenizer_path(), end=0, shards=3, block_bytes=50)
    rows = token_files.read_ids(spark, path).orderBy("start").collect()
    digests = {(r["doc_id"], r["start"]): r for r in token_files.read_digests(spark, path).collect()}
    want = Counter((r["doc_id"], tuple(plain_ids(r["text"]) + [0])) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d or 0))
    before = 0
    for r in rows:
        d = digests[r["doc_id"], r["start"]]
        assert (r["start"], d["n_tokens"]) == (before, len(r["ids"]))
        assert d["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        before += len(r["ids"])
    path = work_dir(spark, "tokens")
    token_files.write(empty(spark), path, queries.tokenizer_path())
    assert token_files.read_digests(spark, path).count() == 0


# shingles and fingerprints --------------------------------------------------------------------


def plain_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB é \t\n中"), max_size=30), min_size=1, max_size=6))
def test_shingle_sets(texts):
    data, limits = common.utf8(pa.array(texts, pa.string()))
    own, plain = list(shingles.shingle_sets(data, limits)), [plain_set(t) for t in texts]
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            assert len(np.intersect1d(a, b)) == len(plain[i] & plain[j])


def test_long_text_is_cut_without_loss(monkeypatch):
    text = "some words of which there are quite a few more than that " * 20
    data, limits = common.utf8(pa.array([text, "short one", text]))
    whole = shingles.shingle_hashes(data, limits)[0]
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    assert (shingles.shingle_hashes(data, limits)[0] == whole).all()


def test_densification_takes_the_first_filled_donor():
    table = np.full((2, fingerprints.BINS), fingerprints._EMPTY)
    table[0, [3, 70, 200]] = [1, 2, 3]
    table[1, ::3] = 7
    out = fingerprints.densified(table)
    for row in range(2):
        for b in range(fingerprints.BINS):
            donor = next(d for d in [b, *fingerprints._ASKED[b]] if table[row, d] != fingerprints._EMPTY)
            assert out[row, b] == table[row, donor]


def test_edit_report(spark, odd, sf_dir):
    for docs in (odd, common.table(spark, sf_dir, "documents")):
        rows = docs.select("doc_id", "text").collect()
        got = fingerprints.edit_report(docs).collect()
        assert len(got) == len(rows)
        same = defaultdict(set)
        if docs is odd:
            assert all(0 <= r["near_next"] <= 1 for r in got)
            continue
        rows.sort(key=lambda r: -r["doc_id"])
        by_id = {r["doc_id"]: r for r in got}
        errors = []
        for i, r in enumerate(rows):
            text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
            n = len(text) // 3
            changed = text[:len(text) - n] + after[:n]
            g = by_id[r["doc_id"]]
            assert g["n_chars"] == len(text)
            assert g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            same[text].add(g["fingerprint"])
            for name, other in (("near_edited", changed), ("near_next", after)):
                a, b = plain_set(text), plain_set(other)
                errors.append(g[name] - (len(a & b) / len(a | b) if a | b else 1.0))
        assert all(len(f) == 1 for f in same.values())
        assert np.abs(errors).mean() < 0.02 and abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.15
    assert fingerprints.edit_report(empty(spark)).count() == 0
    one = fingerprints.edit_report(docs_of(spark, ["a text that follows itself, alone"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# languages ------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark, sf_dir):
    rows = queries.queries()["op3_language_id"](spark, sf_dir).join(
        common.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows} == {True}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and not any(r["rejected"] for r in rows)


def test_language_edges(spark, odd, sf_dir):
    model = language_id.fit(common.table(spark, sf_dir, "documents"), F.lit(True))
    got = language_id.identify(odd.withColumn("language", F.lit(1)), model).collect()
    for r in got:
        has = bool(r["text"]) and any(map(str.isalpha, r["text"]))
        assert (r["language"]["lang"] == "und") == (not has)
        assert has or (r["language"]["score"] == 0 and r["language"]["rejected"])
    strange = docs_of(spark, ["Это предложение написано на другом языке. " * 60, "这是另一种语言的文字。" * 200, "1234 !?"])
    assert all(r["language"]["rejected"] for r in language_id.identify(strange, model).collect())
    assert language_id.identify(empty(spark), model).count() == 0
    none = language_id.fit(empty(spark), F.lit(True))
    assert [r["language"]["lang"] for r in language_id.identify(docs_of(spark, ["some text"]), none).collect()] == ["und"]


UNLEARNED = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem "
          "i sumieniem i powinni postępować wobec innych w duchu braterstwa. Nie wolno nikogo czynić niewolnikiem.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
          "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Kullakin on oikeus elämään.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve "
          "birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak her ferdin hakkıdır.",
    "code": "static int walk(struct node *n) { if (!n) return -1; for (size_t i = 0; i < n->len; ++i) "
            "{ walk(n->child[i]); } return 0; }\nvoid *xmalloc(size_t sz) { void *p = malloc(sz); return p; }",
}


def test_unlearned_languages_are_rejected_and_clean_texts_stay(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs, ~held_out)
    rng = np.random.default_rng(5)
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10)))
                        for _ in range(n)) for n in (40, 100, 500)]
    for text in (*UNLEARNED.values(), *(f"{t} " * 5 for t in UNLEARNED.values()), *letters):
        assert model.predict([text])[2].all(), text[:40]
    clean = [r["text"] for r in docs.filter(held_out & (F.length("text") > 500)).select("text").collect()]
    assert len(clean) > 10 and not model.predict(clean)[2].any()


def test_one_odd_text_sets_no_floor():
    cosines = np.linspace(0.6, 0.9, 1000)
    assert language_id.floor_of(np.append(cosines, 0.01), np.nan) > 0.59
    assert np.isnan(language_id.floor_of(cosines[:3], 0.5))
    assert language_id.floor_of(cosines[:20], 0.5) == 0.5 and language_id.floor_of(cosines[:20], np.nan) <= 0.6
    nan = np.nan
    filled = language_id.filled(np.array([[nan, 0.2, nan, 0.4], [nan, nan, nan, nan]]))
    assert filled.tolist() == [[0.0, 0.2, 0.2, 0.4]] * 2


# near duplicates ------------------------------------------------------------------------------


def plain_components(rows, percent=75):
    """Components of (id, text) rows by comparing all pairs that share a shingle."""
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    posts = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for other, n in Counter(o for x in s for o in posts[x]).items():
            j, t = sets[other]
            if 100 * n >= percent * (len(s) + len(t) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            posts[x].append(k)
    return {i: find(i) for i in up}


def assert_components(docs):
    rows = docs.select("doc_id", "text").collect()
    want = plain_components([(r["doc_id"], r["text"]) for r in rows])
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter((r["doc_id"], len(plain_set(r["text"]))) for r in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_near_duplicates_on_tables(spark, sf_dir):
    assert_components(common.table(spark, sf_dir, "documents"))


def test_near_duplicates_edges(spark, odd):
    assert_components(odd)
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    kept = minhash_dedup.keep_one(odd).collect()
    assert Counter(r["doc_id"] for r in kept) == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1}
    assert kept[0].asDict().keys() == set(odd.columns)


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    """Groups of near copies and a common passage, with lists cut short so that all ways are taken."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(2000)]
    text = lambda n: list(rng.choice(words, n))
    base, passage, texts = text(60), text(60), []
    for k in range(60):
        copy = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            copy[at] = f"x{k}"
        texts.append(" ".join(copy))
        texts.append(" ".join(passage + text(rng.integers(4, 60))))
    for name, value in (("LONG_LIST", 10), ("SHORT_LIST", 4), ("BLOCK", 8)):
        monkeypatch.setattr(minhash_dedup, name, value)
    assert_components(docs_of(spark, texts))


@pytest.mark.parametrize("short", [0, 32])
def test_near_duplicates_that_share_long_lists_only(spark, monkeypatch, short):
    """Every shared list counts as long, and a class may take part in few at first: no pair is lost."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for k in range(60):
        base = list(rng.choice(words, 80))
        for word in (f"x{k}", f"y{k}"):  # near copies, and a text each that shares what tells them apart
            copy = [*base[:40], word, *base[41:]]
            texts += [" ".join(copy), " ".join([*rng.choice(words, 40), *copy[30:60]])]
    texts += [" ".join([*base[:at], "z", *base[at + 1:]]) for at in range(20)]
    for name, value in (("LONG_LIST", 1), ("KEPT_LONG", 1), ("SHORT_LIST", short), ("BLOCK", 4)):
        monkeypatch.setattr(minhash_dedup, name, value)
    assert_components(docs_of(spark, texts))


@pytest.mark.parametrize("other", [60, 58])
def test_an_id_with_two_texts_joins_what_each_is_linked_with(spark, other):
    rng = np.random.default_rng(other)
    words = [f"w{k}" for k in range(2000)]
    a, b, c = (" ".join(rng.choice(words, n)) for n in (60, other, 60))
    near = lambda t: t + " one"
    rows = [(5, a), (5, b), (2, near(a)), (3, near(b)), (9, a), (9, c), (8, c), (1, c), (5, a), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert_components(docs)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 5, 8, 9], 1), 7: 7}


# mixing ---------------------------------------------------------------------------------------


def test_mixing_targets(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = mixing.mix(docs).collect()
    by_source = defaultdict(list)
    for r in rows:
        assert r["mixed"]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["mixed"]["times"] <= 2
        by_source[r["source"]].append(r["mixed"])
    total, names = sum(r["mixed"]["size"] for r in rows), sorted(by_source)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    cap = {s: 2 * by_source[s][0]["source_size"] for s in names}
    want, free, left = {}, set(names), 1.5 * total
    while over := {s for s in free if left * weight[s] > cap[s] * sum(weight[x] for x in free)}:
        want |= {s: cap[s] for s in over}
        free, left = free - over, left - sum(cap[s] for s in over)
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s, mixed in by_source.items():
        assert mixed[0]["target"] == pytest.approx(want[s])
        assert abs(sum(m["times"] * m["size"] for m in mixed) - want[s]) <= max(m["size"] for m in mixed)
    assert {tuple(r["mixed"]) for r in rows} == {tuple(r["mixed"]) for r in mixing.mix(docs).collect()}


def test_mixing_edges(spark, odd):
    rows = mixing.mix(odd.withColumn("mixed", F.lit(0))).collect()
    assert len(rows) == odd.count()
    assert all(r["mixed"]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    taken = mixing.repeated(odd)
    assert taken.columns == odd.columns
    assert taken.count() == sum(r["mixed"]["times"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs_of(spark, [None, ""])).filter("mixed.times > 0").count() == 0


# packing --------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(1, 6), st.sampled_from(["norm", "dot"]))
def test_plan_keeps_every_capacity(lengths, documents, score):
    capacity = packing.Capacity(40, documents, 1600)
    bins = defaultdict(list)
    for run in packing.plan(dict(Counter(lengths)), capacity, score):
        for k in range(run.count):
            bins[run.sequence + k].append((run.offset, run.length))
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= 40 and len(b) <= documents and sum(n * n for _, n in b) <= 1600
    if documents == 6 and lengths and score == "norm":
        assert len(bins) <= -(-sum(lengths) // 40) * 11 // 9 + len(lengths) // 6 + 2


def check_packing(docs, tokens=1024):
    rows = packing.pack(docs, queries.tokenizer_path(), end=2, capacity=packing.Capacity(tokens, 1024, tokens**2)).collect()
    pieces = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(plain_ids(r["text"]) + [2], "<u4")
        cuts = [0, *range(len(ids) % tokens or tokens, len(ids) + 1, tokens)] if len(ids) > tokens else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == pieces
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= tokens
    return len(bins), sum(r["length"] for r in rows)


def test_packing(spark, sf_dir, odd):
    sequences, tokens = check_packing(common.table(spark, sf_dir, "documents"))
    assert sequences <= 1.02 * tokens / 1024 + 1
    check_packing(odd, 64)
    assert packing.pack(empty(spark), queries.tokenizer_path(), end=2).count() == 0
