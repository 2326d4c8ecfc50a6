import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from kmeridian.llm import pii, quality_rules
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    """The five counts and the number of lines, by their definition."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    inside = {j for i, x in enumerate(windows) if times[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if not w:
        return (0,) * 6
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(lines))


def texts_of_all_kinds(rng):
    pieces = ["a", "b", "é", "#", "<|>", "$%&*", "日本", "x y", " ", "c\x85d", "\x1f"]
    gaps = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c"]
    for n in (0, 1, 2, 3, 5, 20, 200):
        for _ in range(8):
            yield "".join(rng.choice(pieces) + rng.choice(gaps, p=[0.6, *[0.4 / 7] * 7]) for _ in range(n))
    yield from (None, "", " \n\t", "same line\nsame line\n\n same line\nsame line", "w " * 50000)


def test_every_count_by_definition(spark):
    texts = list(texts_of_all_kinds(np.random.default_rng(0)))
    assert [quality_rules.counts(t) for t in texts[:-1]] == [brute_counts(t) for t in texts[:-1]]
    assert quality_rules.counts(texts[-1])[::4] == (50000, 50000)
    for t in texts[:-1]:  # both ways of counting repeated words
        w = (t or "").encode().split()
        assert quality_rules.repeat_words(w, most=0) == quality_rules.repeat_words(w)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts[:40])]
    for r in quality_rules.measured(spark.createDataFrame(rows, DOCS)).collect():
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r["_c"]) == want and r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_the_guarantee_holds_in_simulation():
    """Cutoffs that each lose just over the risk: in at most delta of the trials is any of them certified."""
    rng = np.random.default_rng(1)
    rates = [0.002, 0.01, 0.0201, 0.03]  # of cutoffs from lax to strict; the third is over the risk
    wrong = 0
    for _ in range(400):
        sequences = {}
        for s in range(4):
            for rule in range(4):
                u = rng.random(1000)  # a stricter cutoff rejects what a laxer one does, and more
                sequences[s, rule] = [quality_rules.binomial_below(int((u < r).sum()), 1000, 0.02) for r in rates]
        wrong += any(n > 2 for n in quality_rules.certified(sequences, 0.05).values())
    assert wrong / 400 <= 0.05 + 2 * (0.05 * 0.95 / 400) ** 0.5
    assert quality_rules.certified({"a": [0.01, 0.01], "b": [0.04]}, 0.05) == {"a": 2, "b": 1}  # a hands its share on
    assert quality_rules.certified({"a": [0.01, 0.5], "b": [0.04]}, 0.05) == {"a": 1, "b": 0}
    assert quality_rules.certified({}) == {}
    assert abs(quality_rules.binomial_below(0, 100, 0.03) - 0.97**100) < 1e-12


def labelled(spark, n_good=700, n_bad=40, copies=1):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 0) for i in range(n_good)]
    bad = [(10000 + i, " ".join(f"w{i}x{j} ###" for j in range(60)), "en", "s", 0) for i in range(n_bad)]
    few = [(20000, " ".join(f"f{j} #" for j in range(60)), "xx", "s", 0), (20001, " ".join(f"h{j} #" for j in range(60)), None, "s", 0)]
    labels = [(i, 1) for i in range(n_good)] + [(10000 + i, 0) for i in range(n_bad)] + [(20000, 1), (None, 1), (5, None), (20001, 0)]
    docs = spark.createDataFrame((good + bad) * copies + few + [(None, None, "en", None, 0)], DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_are_certified_only_with_evidence(spark):
    docs, labels = labelled(spark)
    cutoffs = quality_rules.fit(quality_rules.measured(docs), labels)
    assert cutoffs["symbols"] == [("en", 1.0)] and not cutoffs["repeats"]  # where both part equally, the laxer one
    out = quality_rules.judged(quality_rules.measured(docs), cutoffs).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == {None, *range(10000, 10040)}
    small, marks = labelled(spark, 200)
    assert not any(quality_rules.fit(quality_rules.measured(small), marks).values())
    many, marks = labelled(spark, 200, copies=5)  # copies are no evidence
    assert not any(quality_rules.fit(quality_rules.measured(many), marks).values())
    none = spark.createDataFrame([], DOCS)
    assert not any(quality_rules.fit(quality_rules.measured(none), labels).values()) and quality_rules.rejecting(none, labels).count() == 0
    assert not any(quality_rules.fit(quality_rules.measured(docs), labels.limit(0)).values())


def test_rejecting_leaves_other_columns_alone(spark):
    docs, labels = labelled(spark)
    clashing = docs.withColumns({"_c": F.lit("c"), "kept": F.lit(1), "base_failed": F.lit("b"), "row": F.lit(2), "a.b": F.lit(3), "_text": F.lit(4)})
    out = quality_rules.rejecting(clashing, labels)
    assert out.columns == clashing.columns
    assert {(r["doc_id"], r["_c"], r["kept"], r["base_failed"], r["row"], r["a.b"], r["_text"]) for r in out.collect()} == {(i, "c", 1, "b", 2, 3, 4) for i in [*range(700), 20000, 20001]}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    """The contract's base spans, by Python's matcher."""
    text, out = text or "", []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def listed(spark, texts, model=None):
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.candidates(F.col("text")).alias("spans"))
    return [r for r in pii.listed(found, np.zeros(pii.CODES, bool) if model is None else model).orderBy("doc_id").collect()]


def test_base_spans_by_brute_force(spark):
    rng = np.random.default_rng(3)
    atoms = ["a@b.c", "x.y%+-_@", "@", "d-e.f", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (017) 555-7713", "+49 30", "+", " ", "  ", "-", "7", "1234", "\n", "é", "\x01", "日", "(", ")", "+5..--9", "378282246310005", "00000000000000000000"]
    texts = ["".join(rng.choice(atoms, int(rng.integers(1, 14)))) for _ in range(600)]
    texts += [None, "", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1", "1 " * 3000, "card 4111-1111-1111-1111-2", "x@y.zz 1.2.3.4 " * 3000]
    for text, r in zip(texts, listed(spark, texts), strict=True):
        want = brute_spans(text)
        assert r["spans"] == ",".join(want), repr(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert tuple(r)[1:5] == tuple(sum(x.startswith(k + ":") for x in want) for k in PATTERNS)


def iban(country, body):
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def planted(rng):
    """Texts with personal data that the base patterns miss, and decoys of the same looks: (text, what is to be found)."""
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    word = lambda: "".join(rng.choice(list("aeioubdglmnrst"), 6))
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    rows = []
    for i in range(60):
        key = hexes(40)
        rows.append((f'{word()} token = "{key}" {word()}', key))
        rows.append((f"{word()} commit {hexes(40)} {word()}", None))
        phone = f"(2{digits(2)}) 5{digits(2)}-{digits(4)}"
        rows.append((f"{word()} tel {phone} {word()}", phone))
        rows.append((f"order 1{digits(2)} 0{digits(2)} {digits(4)} {word()}", None))
        mail = f"{word()} (at) {word()} (dot) com"
        rows.append((f"write {mail} ", mail))
        account = iban("DE", digits(18))
        rows.append((f"IBAN {account} {word()}", account))
        rows.append((f"part {account[:2]}{int(account[2:4]) % 90 + 8:02d}{account[4:]} {word()}", None))
        ssn = f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"
        rows.append((f"{word()} SSN {ssn}, {word()}", ssn))
        rows.append((f"{word()} page 000-{rng.integers(10, 99)}-{digits(4)} {word()}", None))
        rows.append((f"{word()} Peter Schmidt {word()}" if i % 2 else f"name: Peter Schmidt {word()}", "Peter Schmidt"))
        rows.append((f"saint Peter Street {word()}", None))
        rows.append((f"mail {word()}@{word()}.org and +49 30 {digits(7)} {word()}", None))
        rows.append((f"{word()} {word()} {i}-{i + 1} in 2021-03-04, version 1.2.{i}", None))
    return rows


def test_model_adds_what_base_patterns_miss(spark):
    rows = planted(np.random.default_rng(4))
    texts = [t for t, _ in rows]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.candidates(F.col("text")).alias("spans"))
    model = pii.fit(found)
    added, hits, wanted = 0, 0, sum(w is not None for _, w in rows)
    for (text, want), r in zip(rows, pii.listed(found, model).orderBy("doc_id").collect(), strict=True):
        base = brute_spans(text)
        extra = [text[int(a) : int(b)] for s in r["spans"].split(",") if s and s not in base for _, a, b in [s.split(":")]]
        assert set(base) <= set(r["spans"].split(",")) or not base
        assert r["n_spans"] == len(base) + len(extra) and r["flagged"] == bool(r["n_spans"])
        added += len(extra)
        hits += want in extra
    assert hits / wanted >= 0.9 and hits / added >= 0.95, (hits, wanted, added)
    # without the model nothing is added: it decides, not the patterns
    assert [r["spans"] for r in listed(spark, texts)] == [",".join(brute_spans(t)) for t in texts]
    codes = np.array([s["code"] for r in found.collect() for s in r["spans"] if not s["base"]])
    votes = pii._decoded(codes)
    for j in (1, 2, 3):  # every labeler votes both ways among what the model decides
        assert {-1, 1} <= set(votes[:, j].tolist())
    assert model[codes].any() and not model[codes].all()


def test_votes_are_weighed_by_estimated_reliability():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    right = (0.95, 0.7, 0.85)
    votes = np.array([np.where(rng.random(4000) < 0.2, 0, np.where(rng.random(4000) < r, 1, -1) * np.where(truth, 1, -1)) for r in right]).T
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    post, hit, miss = pii.reliabilities(patterns, times.astype(float))
    assert hit[0] > hit[2] > hit[1] and miss[0] > miss[2] > miss[1]
    of = {tuple(p): x for p, x in zip(patterns.tolist(), post, strict=True)}
    guess = np.array([of[tuple(v)] for v in votes.tolist()]) >= 0.5
    majority = votes.sum(axis=1) > 0
    assert (guess == truth).mean() >= (majority == truth).mean() - 0.001 > 0.85
    one = [p.sum() for p in patterns]
    assert all(x < pii.CERTAIN for x, s in zip(post, one, strict=True) if s <= 0)
    alone = pii.reliabilities(np.array([[1, 0, 0]]), np.array([1e6]))[0]
    assert alone[0] < pii.CERTAIN  # one vote proves nothing, however often it is cast
    for n in (2, 200, 2e6):
        assert pii.reliabilities(np.array([[1, 0, 1]]), np.array([n]))[0][0] >= pii.CERTAIN


def test_masking(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    texts = ["pay 4111 1111 1111 1111 or 4111 1111 1111 1112", f'é token = "{key}" x@y.zz.', None, "", "\x01x@y.zz", "+49 30 1234567.4 x", "x@y.zz 1.2.3.4 " * 3000, f'token = "{key}" a', f'token = "{key[::-1]}" b']
    docs = spark.createDataFrame([(i, t, "r", "s", 1) for i, t in enumerate(texts)] + [(None, "a@b.c", "r", "s", 1)] * 2, "doc_id long, text string, row string, spans string, `a.b` int")
    out = pii.masking(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    got = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    assert got[0] == "pay <CARD> or 4111 1111 1111 1112" and got[1] == 'é token = "<SECRET>" <EMAIL>.' and got[2] is None and got[3] == ""
    assert got[4] == "\x01<EMAIL>" and got[6] == "<EMAIL> <IP> " * 3000 and got[7] == 'token = "<SECRET>" a'
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["<EMAIL>"] * 2 and {(r["row"], r["spans"], r["a.b"]) for r in rows} == {("r", "s", 1)}
    assert pii.masking(docs.limit(0)).count() == 0


def test_overlapping_spans_become_one(spark):
    spans = "array<struct<start:int,rank:int,end:int,base:boolean,code:int>>"
    text = "0123456789" * 3
    cases = [[(1, 0, 4), (2, 1, 3), (4, 2, 6)], [(0, 0, 30)], [], [(i, i % 4, i + 2) for i in range(0, 29)], [(2, 3, 9), (3, 0, 12), (20, 1, 21)]]
    rows = [(text, [(a, k, b, True, 0) for a, k, b in c]) for c in cases]
    found = spark.createDataFrame([((t,), s) for t, s in rows], f"row struct<text:string>, spans {spans}")
    got = [r["text"] for r in pii.masked(found, np.zeros(pii.CODES, bool)).collect()]
    want = []
    for c in cases:
        out, at = "", 0
        joined = []
        for a, k, b in c:
            if joined and a < joined[-1][2]:
                joined[-1][2] = max(joined[-1][2], b)
            else:
                joined.append([a, k, b])
        for a, k, b in joined:
            out += text[at:a] + f"<{pii.KINDS[k].upper()}>"
            at = b
        want.append(out + text[at:])
    assert got == want


def test_two_level_sums_and_maxima(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.integers(0, 100, n).tolist(),) for n in (1, 2, 3, 4, 10, 101)]
    df = spark.createDataFrame(rows, "x array<int>")
    out = df.select("x", pii._starts(F.col("x")).alias("s"), pii._before(F.col("x"), F.lit(0), lambda t, y: F.greatest(t, y)).alias("m")).collect()
    for r in out:
        assert r["s"] == [0, *itertools.accumulate(r["x"])][:-1]
        assert r["m"] == [0, *itertools.accumulate(r["x"], max)][:-1]


@pytest.mark.parametrize("text", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00"])
def test_account_numbers_are_checked(spark, text):
    digits = "".join(str(int(c, 36)) for c in (text.replace(" ", "")[4:] + text.replace(" ", "")[:4]))
    got = spark.createDataFrame([(text,)], "t string").select(pii._iban_holds(F.col("t")).alias("x")).first()["x"]
    assert got == (int(digits) % 97 == 1)
