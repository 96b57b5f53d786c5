"""Personal data by weak supervision, in DataFrame functions only.

Spans that one of four patterns finds and its check accepts are personal data as they are. Further
candidates are spans that fail a check or that a looser pattern finds (spelled-out addresses,
numbers without a country code). Five labelers vote on all of them, yes, no, or not at all: the
form's check and two more patterns, a gazetteer, and the words before the span. How far each vote
is to be trusted, expectation-maximisation estimates per kind from how often the votes occur
together, over the whole table: candidates are reduced to counts of vote patterns, of which there
are at most 3^5 a kind. The resulting probabilities are the soft labels on which the final span
classifier is trained, a naive Bayes model over the span's shape, size and neighbours, again from
counts. It decides about the candidates that the checks did not accept.

Texts are scanned once: the patterns mark their matches with a control character, and the lengths
of the pieces between marks give the places.
"""

from __future__ import annotations

import dataclasses
import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import common

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4

# The patterns of the four kinds, written so that a long run of letters or digits is
# read once. Marks and text that looks like a mark; no pattern takes either.
PATTERNS = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK, MASK = "\x01", "\x02"

#: Spelled-out mail addresses, spelled-out IP addresses, numbers without a country code.
LOOSE = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:[\[({](?:dot|DOT)[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    r"(?<![0-9.])[0-9]{1,3}(?:[\[({](?:\.|dot|DOT)[\])}][0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
])

# Gazetteers.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "co", "eu", "de", "fr", "es",
               "it", "nl", "be", "ch", "at", "uk", "ie", "pt", "pl", "se", "no", "dk", "fi", "us", "ca", "mx",
               "ar", "br", "cl", "in", "jp", "cn", "au", "nz", "za", "ru"]
CALLING_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45",
                 "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65",
                 "66", "81", "82", "84", "86", "90", "91", "92", "98", "212", "351", "352", "353", "358", "420"]
ISSUERS = ["34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6011", "62", "65"]

#: Words before a span that speak for its kind, and words that speak against any.
HINTS = {
    EMAIL: ["mail", "courriel", "correo", "contact", "write", "schreib"],
    IP: ["ip", "host", "server", "serveur", "servidor", "login", "client"],
    CARD: ["card", "carte", "karte", "tarjeta", "visa", "mastercard", "amex", "pay", "credit", "debit"],
    PHONE: ["phone", "tel", "tél", "call", "mobile", "movil", "móvil", "handy", "fax", "whatsapp", "sms", "ruf"],
}
AGAINST = ["version", "release", "section", "chapter", "isbn", "issn", "doi", "order", "invoice", "serial",
           "token", "hash", "sha", "uuid", "build", "ticket", "figure", "table"]

LABELERS = ["form", "known", "near", "edges", "usual"]
YES, NO, SILENT = 1, 0, 2
#: Code points of context that are read before a span.
CONTEXT = 40
SHAPES = 256
ROUNDS = 60
#: Probability from which the classifier adds a span.
ACCEPT = 0.9
#: Lengths that are summed at a time.
CHUNK = 256


def _running(lengths: Column) -> Column:
    """Sums of an array up to each of its values, in chunks, so that no long array is copied per value."""
    none = F.array().cast("array<bigint>")

    def add(total: Column, x: Column) -> Column:
        at = total["at"] + x
        return F.struct(at.alias("at"), F.array_append(total["ends"], at).alias("ends"))

    def add_chunk(total: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(total["at"].alias("at"), none.alias("ends")), add)
        return F.transform(F.array(inner), lambda z: F.struct(
            z["at"].alias("at"), F.concat(total["ends"], z["ends"]).alias("ends")))[0]

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
        lambda i: F.slice(lengths, i * CHUNK + 1, CHUNK))
    return F.aggregate(chunks, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("ends")), add_chunk)["ends"]


def _split(text: Column, pattern: str) -> Column:
    """Pieces of a text: what lies before, in and after each match, in turn."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _matches(pieces: Column, ends: Column) -> Column:
    """start, end (code points), hit, before, after: per match."""
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
                 lambda i: (i % 2 == 1) & (i < F.size(pieces))),
        lambda i: F.struct(
            F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(pieces, i).alias("hit"),
            F.right(F.get(pieces, i - 1), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda s, i: s + F.transform(
            F.array(F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)),
            lambda d: F.when(d > 9, d - 9).otherwise(d))[0])
    return total % 10 == 0


def _passes(kind: int, hit: Column) -> Column:
    """The check of a kind; for cards null where there are too few or too many digits to be one."""
    if kind == IP:
        return F.forall(F.split(hit, "[.]"), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            "^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == CARD:
        return F.when(F.length(_digits(hit)).between(12, 19), luhn(_digits(hit)))
    if kind == PHONE:
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(SILENT)


def _any_word(words: list[str]) -> str:
    return r"(?i)(?:^|[^\p{L}])(?:" + "|".join(words) + ")"


def _by_kind(kind: Column, pick: Callable[[int], Column]) -> Column:
    return reduce(lambda c, k: c.when(kind == k, pick(k)), [IP, CARD, PHONE], F.when(kind == EMAIL, pick(EMAIL)))


def _known(kind: int, hit: Column) -> Column:
    """The gazetteer's vote."""
    if kind == EMAIL:
        last = F.lower(F.substring_index(hit, ".", -1))
        return _vote(last.isin(TOP_DOMAINS), F.lit(True))
    if kind == IP:
        # private, local, shared and unassigned ranges lead to nobody
        return _vote(~hit.rlike(r"^0*(?:0|10|127|2[2-5][0-9]|192[^0-9]+0*168|169[^0-9]+0*254)[^0-9]"), F.lit(True))
    if kind == CARD:
        return _vote(_digits(hit).rlike("^(?:" + "|".join(ISSUERS) + ")"), F.lit(True))
    return _vote(hit.rlike(r"^\+\x20?(?:" + "|".join(CALLING_CODES) + ")"), hit.startswith("+"))


def _usual(kind: int, hit: Column) -> Column:
    """The vote on how the span is usually written."""
    if kind == EMAIL:
        return _vote(~hit.rlike(r"\.\.|^[.-]|[.-]@|^.{65}"), F.lit(True))
    if kind == IP:
        return _vote(~hit.rlike(r"(?:^|[^0-9])0[0-9]"), F.lit(True))
    if kind == CARD:
        return _vote(hit.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|"
                               r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"), F.lit(True))
    return _vote(F.length(_digits(hit)).between(10, 13) & ~hit.rlike(r"[ .()-]{4}"), F.lit(True))


def _candidate(kind: Column, form: Column, m: Column) -> Column:
    """A match as a candidate: its place, its votes and what the classifier looks at."""
    hit, before = m["hit"], m["before"]
    glued = before.rlike(r"[\p{L}\p{N}_=/]$") | m["after"].rlike(r"^[\p{L}\p{N}_=/]")
    hint = _by_kind(kind, lambda k: before.rlike(_any_word(HINTS[k])))
    # runs of letters and of digits by their rough length
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(hit, r"[A-Za-z]+", "a"), r"[0-9]{5,}", "8"), r"[0-9]{3,4}", "4"), r"[0-9]{1,2}", "1")
    return F.struct(
        m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end"), (form == YES).alias("sure"),
        form.alias("form"), _by_kind(kind, lambda k: _known(k, hit)).alias("known"),
        _vote(hint, before.rlike(_any_word(AGAINST))).alias("near"),
        _vote(~glued, glued).alias("edges"), _by_kind(kind, lambda k: _usual(k, hit)).alias("usual"),
        F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("int").alias("shape"),
        F.least(F.length(hit), F.lit(40)).cast("int").alias("size"),
        F.when(glued, 0).when(before.rlike(r"[\s]$") | (before == ""), 1).otherwise(2).alias("left"),
        F.when(hint, 1).otherwise(0).alias("hint"))


#: What the classifier looks at, besides the kind.
FEATURES = ["shape", "size", "left", "hint", "usual"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `found`: the document's candidates, those that the checks accept marked `sure`."""
    kept = docs.select(common.col(id_col).alias("doc_id"), F.translate(
        F.coalesce(common.col(text_col), F.lit("")), MARK, MASK).alias("text"))
    gates = {EMAIL: F.col("text").contains("@"), PHONE: F.col("text").contains("+"), CARD: F.lit(True),
             IP: F.col("text").contains("."), 0: F.lit(True)}
    patterns = {**PATTERNS, 0: LOOSE}
    empty = F.array().cast("array<string>")
    pieces = kept.select("doc_id", *(
        F.when(gates[k], _split(F.col("text"), p)).otherwise(empty).alias(f"p{k}") for k, p in patterns.items()))
    ends = pieces.select("*", *(
        F.when(F.size(f"p{k}") > 1, _running(F.transform(f"p{k}", lambda x: F.length(x).cast("bigint"))))
        .alias(f"e{k}") for k in patterns))
    hits = ends.select("doc_id", *(
        F.when(F.col(f"e{k}").isNotNull(), _matches(F.col(f"p{k}"), F.col(f"e{k}"))).alias(f"m{k}")
        for k in patterns))

    def of_kind(k: int) -> Column:
        # matches too short or too long to be one are no candidates
        checked = F.transform(f"m{k}", lambda m: F.struct(m.alias("m"), _passes(k, m["hit"]).alias("ok")))
        wanted = F.filter(checked, lambda c: c["ok"].isNotNull() if k == CARD else c["ok"])
        return F.transform(wanted, lambda c: _candidate(F.lit(k), F.when(c["ok"], YES).otherwise(NO), c["m"]))

    kind = lambda m: F.when(m["hit"].rlike(r"[A-Za-z0-9._%+-]\x20?[\[({](?:at|AT)[\])}]"), EMAIL) \
        .when(m["hit"].rlike(r"[\[({]"), F.when(m["hit"].rlike(r"[\[({](?:\.|dot|DOT)"), IP).otherwise(PHONE)) \
        .otherwise(PHONE)
    loose = F.transform("m0", lambda m: _candidate(kind(m), F.lit(SILENT), m))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,sure:boolean,form:int,known:int,near:int,"
                          "edges:int,usual:int,shape:int,size:int,left:int,hint:int>>")
    each = hits.select("doc_id", *(F.coalesce(of_kind(k), none).alias(f"c{k}") for k in PATTERNS),
                       F.coalesce(loose, none).alias("c0"))
    strict = F.concat(*(F.col(f"c{k}") for k in PATTERNS))
    both = each.select("doc_id", F.filter(strict, lambda c: c["sure"]).alias("sure"),
                       F.filter(strict, lambda c: ~c["sure"]).alias("failed"), "c0")
    overlaps = lambda c, x: (x["start"] < c["end"]) & (c["start"] < x["end"])
    # a candidate that overlaps an accepted span says nothing new
    others = F.filter(F.concat("failed", "c0"), lambda c: ~F.exists("sure", lambda x: overlaps(c, x)))
    return both.select("doc_id", F.concat("sure", others).alias("found"))


@dataclasses.dataclass
class Model:
    """Log odds: of votes by kind and labeler, and of the classifier's features."""

    prior: dict[int, float]
    votes: dict[tuple[int, str, int], float]
    base: dict[int, float]
    features: dict[tuple[int, str, int], float]


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]]) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): prior and vote log odds per kind.

    Labelers are taken as independent given the truth. It begins with shares of yes among the votes
    cast. A kind without candidates has no entry. Added counts of one keep estimates off 0 and 1.
    """
    prior, votes = {}, {}
    for kind in {k for k, _, _ in counts}:
        own = [(v, n) for k, v, n in counts if k == kind]
        total = sum(n for _, n in own)
        belief = {}
        for v, _ in own:
            cast = [x for x in v if x != SILENT]
            belief[v] = (sum(cast) + 0.5) / (len(cast) + 1)
        for _ in range(ROUNDS):
            yes = sum(n * belief[v] for v, n in own)
            odds = math.log((yes + 1) / (total - yes + 1))
            weight = {}
            for place, name in enumerate(LABELERS):
                for vote in (YES, NO):
                    hit = sum(n * belief[v] for v, n in own if v[place] == vote)
                    miss = sum(n * (1 - belief[v]) for v, n in own if v[place] == vote)
                    hits = sum(n * belief[v] for v, n in own if v[place] != SILENT)
                    misses = sum(n * (1 - belief[v]) for v, n in own if v[place] != SILENT)
                    weight[name, vote] = math.log((hit + 1) / (hits + 2)) - math.log((miss + 1) / (misses + 2))
            belief = {v: 1 / (1 + math.exp(-min(max(odds + sum(
                weight[name, x] for name, x in zip(LABELERS, v, strict=True) if x != SILENT), -500), 500)))
                for v, _ in own}
        prior[kind] = odds
        votes.update({(kind, name, vote): w for (name, vote), w in weight.items()})
    return prior, votes


def _table(entries: dict[tuple[int, str, int], float], name: str) -> Column:
    """(kind * 1000 + value) -> log odds, for one labeler or feature."""
    own = {k * 1000 + v: w for (k, n, v), w in entries.items() if n == name}
    return F.create_map(*(F.lit(x) for item in sorted((own or {-1: 0.0}).items()) for x in item))


def _log_odds(base: dict[int, float], entries: dict, names: list[str], c: Column) -> Column:
    """Sums a candidate's log odds; what the model has not met adds nothing."""
    start = F.create_map(*(F.lit(x) for k in range(1, 5) for x in (k, float(base.get(k, 0.0)))))
    return reduce(lambda a, b: a + b, [
        F.coalesce(F.try_element_at(_table(entries, n), c["kind"] * 1000 + c[n]), F.lit(0.0)) for n in names],
        F.coalesce(F.try_element_at(start, c["kind"]), F.lit(0.0)))


def fit(found: DataFrame) -> Model:
    """The model of all candidates: both steps go over counts, of at most 3^5 vote patterns a kind
    and of at most SHAPES + 50 feature values a kind, which alone reach the driver."""
    c = found.select(F.explode("found").alias("c")).select("c.*")
    counts = [(r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in c.groupBy("kind", *LABELERS).agg(
        F.count(F.lit(1)).alias("n")).collect()]
    prior, votes = reliabilities(sorted(counts))
    row = F.struct("kind", *LABELERS)
    belief = 1 / (1 + F.exp(-_log_odds(prior, votes, LABELERS, row)))
    labelled = c.select("kind", belief.alias("belief"), F.explode(F.array(*(
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in FEATURES))).alias("f"))
    # whole millionths: sums that don't depend on the order of rows
    share = F.round(F.col("belief") * 1_000_000).cast("bigint")
    sums = labelled.groupBy("kind", "f.feature", "f.value").agg(
        F.sum(share).alias("hit"), F.sum(F.lit(1_000_000) - share).alias("miss")).collect()
    base, features = {}, {}
    totals: dict = defaultdict(lambda: [0.0, 0.0, 0])
    for r in sums:
        t = totals[r["kind"], r["feature"]]
        t[0], t[1], t[2] = t[0] + r["hit"] / 1e6, t[1] + r["miss"] / 1e6, t[2] + 1
    for r in sums:
        hits, misses, values = totals[r["kind"], r["feature"]]
        features[r["kind"], r["feature"], r["value"]] = math.log(
            (r["hit"] / 1e6 + 1) / (hits + values)) - math.log((r["miss"] / 1e6 + 1) / (misses + values))
        base[r["kind"]] = math.log((hits + 1) / (misses + 1))
    return Model(prior, votes, base, features)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def judged(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end), in order.

    Of added spans that overlap the one that starts first stays, then the kind listed first.
    """
    place = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    limit = math.log(ACCEPT / (1 - ACCEPT))
    base = F.transform(F.filter("found", lambda c: c["sure"]), place)
    more = F.array_sort(F.transform(F.filter("found", lambda c: ~c["sure"] & (
        _log_odds(model.base, model.features, FEATURES, c) >= limit)), place))
    apart = F.aggregate(
        more, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"),
        lambda kept, c: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > c["start"]), kept)
        .otherwise(F.array_append(kept, c)))
    return found.select("doc_id", F.array_sort(base).alias("base"), F.when(F.size("found") > 0, apart).otherwise(
        F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("added"))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (accepted by pattern and check),
    base_sha256 (of these, as kind:start:end), spans (these and the added ones).

    A null text is empty and has no spans. Rows with equal or null ids are judged each. The
    control character used as mark counts as any other character that no pattern takes. An empty
    table has no candidates and no model. Other columns are ignored.
    """
    found = common.stored(candidates(docs, id_col, text_col), "candidates")
    all_spans = judged(found, fit(found))
    return all_spans.select(
        "doc_id", *(_count(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(KINDS, 1)),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"))
