"""Personal data by weak supervision, in DataFrame operations alone.

Candidate spans come from patterns: the four base kinds, whose valid matches are always reported, and looser ones (runs of
digits that fail a check, phones without a plus, addresses with "(at)", account numbers, identity numbers, secrets, names of
a gazetteer of given names). Three labelers vote on every candidate, for, against or not at all: its format (checksums,
numbering plans, make-up), a gazetteer (top-level domains, country codes, issuer prefixes, address blocks, key prefixes,
placeholders, surnames) and the words in front of it. For each kind expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is where it votes, and a posterior for each pattern; the share of personal data among
candidates starts at a half and never counts as more, so that one vote alone proves nothing. A logistic span classifier,
trained on these posteriors over kind, votes and shape, decides: it adds what it takes for personal data with at least CERTAIN
probability. It runs as a table with one bit for each combination of features.

Candidates that overlap a valid base span are dropped before anything is counted, so the fit sees only what it can decide,
and the base spans themselves. All counts cover all documents; what returns to the driver is one row per combination of
kind, votes and shape, at most 8 * 27 * 36 rows whatever the corpus. Positions are code points, ends exclusive. They are
sums of lengths of the pieces between matches; sums and maxima over a text's matches go in two levels (n steps of root n
each), so that thousands of matches in one text stay cheap.

Defined results: null text counts as empty and has no spans (`masked` leaves it null); texts are searched whole; repeated
rows and null ids are handled row by row; of added spans that overlap, the one that begins first stays (then the kind listed
first); an empty table fits no model and nothing is added; other columns keep their values whatever their names. Patterns
are possessive, so that no text makes the matcher recurse or retry.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmeridian.session import saved

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "name")
N_BASE = 4
CERTAIN = 0.9
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Gazetteers, to be replaced by larger ones of the caller: given names begin a name candidate, surnames vote for it.
GIVEN = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Hans", "Peter", "Klaus", "Wolfgang", "Jürgen", "Sabine", "Petra", "Monika", "Ursula", "José", "Antonio", "Manuel", "Francisco", "Carlos", "Carmen", "Josefa", "Isabel", "Jean", "Pierre", "Michel", "Philippe", "Marie", "Nathalie", "Isabelle", "Catherine")
SURNAMES = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Miller", "Davis", "Wilson", "Anderson", "Taylor", "Moore", "Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Meyer", "Wagner", "Becker", "Schulz", "Hoffmann", "García", "González", "Rodríguez", "Fernández", "López", "Martínez", "Sánchez", "Pérez", "Gómez", "Martin", "Bernard", "Dubois", "Durand", "Moreau", "Laurent", "Lefebvre", "Leroy")
LOOSE = {
    "phone": r"(?<![0-9A-Za-z+.,(/-])(?<![0-9][\x20])(?:\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|0[0-9](?:[\x20.-][0-9]{2}){4}|0[0-9]{2,4}[\x20/-]{1,2}[0-9]{5,8})(?![0-9A-Za-z]|[\x20.,-][0-9])",
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Z0-9-]++)*+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Votes of the gazetteer, by kind: for, against.
_GAZETTEER = {
    "email": (r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|mx|us)$", r"(?i)(?:invalid|test|localhost)$|[0-9]$"),
    "ip": (r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^0*(?:0|22[4-9]|2[3-5][0-9])\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38|62)", r"^(?:0|1|7|8|9)|^(.)\1{8}"),
    "phone": (r"^\+?(?:1|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[\x20(]|^\(?[2-9][0-9]{2}\)?[\x20./-]{1,2}[2-9]|^0[1-9]", r"^\(?(?:000|123)\)?[\x20.-]"),
    "iban": (r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)", r"^"),
    "ssn": (r"$^", r"^(?:078-05-1120|219-09-9999|123-45-6789|111-11-1111)$"),
    "secret": (r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|eyJ|SG\.)", r"(?i)example|sample|placeholder|changeme|your|xxxx|0{8}|1234567|abcdefg"),
    "name": (rf"\x20(?:{'|'.join(SURNAMES)})$", r"\x20(?:The|And|Der|Die|Das|Und|Los|Las|Les|Des|January|March|April|May|June|July|August|Street|Avenue|University|College|School|Hospital|Airport|Church)$"),
}
#: Votes of the 25 characters in front, by kind, and what speaks against numbers.
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|adresse|mailto|reach)(?:\x20(?:me|us|at|to))*\W{0,3}$",
    "ip": r"(?i)(?:\bip|server|host|client|from|address)\W{0,3}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|carte|karte|tarjeta|credit)(?:\x20(?:no|number|nr))?\W{0,3}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|t.l.phone|tel.fono|ruf)(?:\x20(?:me|us|at|no|number))*\W{0,4}$",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte)(?:\x20(?:no|number|nr))?\W{0,3}$",
    "ssn": r"(?i)(?:\bssn|social security|security (?:no|number)|seguridad social|s.curit. sociale)(?:\x20(?:no|number))?\W{0,3}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|client[\x20_-]?key|credential|bearer|auth)s?[\"'\x20]{0,2}(?:[=:]|is)?[\"'\x20]{0,3}$",
    "name": r"(?i)(?:name|mr|mrs|ms|dr|herrn?|frau|se.or|se.ora|monsieur|madame|contact|signed|regards|sincerely|patient|customer|employee)\W{0,3}$",
}
_AGAINST = dict.fromkeys(KINDS, r"(?i)(?:version|\bv|isbn|issn|order|serial|part|\bid|hash|invoice|article|page|[=#])\W{0,3}$") | {
    "secret": r"(?i)(?:commit|sha-?[0-9]*|md5|hash|digest|checksum|uuid|guid|revision|\brev|\bid|isbn|etag|build|/)\W{0,3}$",
    "name": r"(?i)(?:saint|san|santa|\bst|rue|street|calle|avenue|city|lake|port|mount|king|queen|pope)\W{0,3}$",
}
_SPAN = "start int, rank int, end int, base boolean, code int"
#: What the classifier looks at: kind, the three votes, length, and what stands before and after.
FEATURES = {"rank": len(KINDS), "format": 3, "known": 3, "around": 3, "size": 4, "before": 3, "after": 3}
CODES = int(np.prod(list(FEATURES.values())))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, zero: Column, join) -> Column:
    """For each value (at least one) what join makes of all before it, from zero on, by way of runs of about the root of
    their number."""

    def of(s: Column) -> Column:
        over = lambda a, n: F.aggregate(F.slice(s["x"], a + 1, n), zero, join)
        runs = F.aggregate(F.sequence(F.lit(0), s["c"] - 1), F.array(zero), lambda t, k: F.concat(t, F.array(join(F.element_at(t, -1), over(k * s["c"], s["c"])))))
        return _let(F.struct(s["x"].alias("x"), s["c"].alias("c"), runs.alias("r")), lambda q: F.transform(F.sequence(F.lit(0), F.size(q["x"]) - 1), lambda i: F.aggregate(F.slice(q["x"], i - i % q["c"] + 1, i % q["c"]), F.get(q["r"], F.floor(i / q["c"]).cast("int")), join)))

    return _let(F.struct(values.alias("x"), F.ceil(F.sqrt(F.size(values))).cast("int").alias("c")), of)


def _starts(lengths: Column) -> Column:
    return _before(lengths, F.lit(0), lambda t, y: t + y)


def _ends_before(spans: Column, counts=None) -> Column:
    """For each span the greatest end of those before it (that count), 0 for the first."""
    end = (lambda s: s["end"]) if counts is None else (lambda s: F.when(counts(s), s["end"]).otherwise(0))
    return _before(F.transform(spans, end), F.lit(0), lambda t, y: F.greatest(t, y))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + _luhn(d, i), lambda s: s % 10 == 0))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _luhn(d: Column, i: Column) -> Column:
    digit = F.substr(d, -i, F.lit(1)).cast("int")
    return F.when(i % 2 == 1, digit).otherwise(F.substr(F.lit("0246813579"), digit + 1, F.lit(1)).cast("int"))


def _iban_holds(match: Column) -> Column:
    """The remainder of the rearranged number by 97 is 1; letters count as 10 to 35."""

    def of(x: Column) -> Column:
        turned = F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))
        value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        step = lambda t, c: _let(value(c), lambda v: (t * F.when(v > 9, 100).otherwise(10) + v) % 97)
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(step(t, c).cast("int")), lambda t: t == 1)

    return _let(F.regexp_replace(match, r"\x20", ""), of)


def _format(kind: str, match: Column, base: bool, valid: Column) -> Column:
    """The vote of the format labeler."""
    if base:
        return _vote(valid, F.lit(True))
    if kind == "phone":  # a numbering plan holds
        return _vote(match.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20./-]{1,2}[2-9][0-9]{2}[\x20.-]|^0[1-9]"), F.lit(True))
    if kind == "email":
        return _vote(match.rlike(r"(?i)(?:\.|dot[)\]])\x20?[a-z]{2,}$"), F.lit(True))
    if kind == "iban":
        return _vote(_iban_holds(match), F.lit(True))
    if kind == "ssn":
        return _vote(match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), F.lit(True))
    if kind == "secret":  # letters and digits well mixed; runs of digits, identifiers and dates are none
        mixed = match.rlike(r"^(?:[A-Za-z_-]*+[0-9]){4}") & match.rlike(r"^(?:[^A-Za-z]*+[A-Za-z]){3}")
        return _vote(mixed & ~match.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|[0-9]{4}-[0-9]{2}-[0-9]{2}|[-_][a-z]+[-_]"), F.lit(True))
    return _vote(match.rlike(r"\x20\p{Lu}\p{Ll}{2,}(?:-\p{Lu}\p{Ll}+)?$"), F.lit(True))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _shape(c: Column) -> Column:
    """0: nothing or white space, 1: letter or digit, 2: other."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^[\p{L}0-9]$"), 1).otherwise(2)


def _none() -> Column:
    return F.array().cast(f"array<struct<{','.join(f.replace(' ', ':') for f in _SPAN.split(', '))}>>")


def _found(text: Column, kind: str, pattern: str, base: bool, only_if: Column | None = None) -> Column:
    """All candidates of a pattern in text, which has no U+0001."""
    pieces = F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01", -1)

    def spans(p: Column) -> Column:
        def span(i: Column, at: Column) -> Column:
            match, front = F.get(p, i), F.get(p, i - 1)
            start, size = F.get(at, i), F.length(match)
            near = F.substr(front, F.greatest(F.length(front) - 24, F.lit(0)) + 1, F.lit(25))
            value = _digits(match) if kind == "card" else match
            valid = _valid(kind, match) if base else F.lit(False)
            votes = (_format(kind, match, base, valid), _vote(value.rlike(_GAZETTEER[kind][0]), value.rlike(_GAZETTEER[kind][1])), _vote(near.rlike(_CONTEXT[kind]), near.rlike(_AGAINST[kind])))
            shape = (F.when(size < 12, 0).when(size < 16, 1).when(size < 20, 2).otherwise(3), _shape(F.substr(front, F.greatest(F.length(front), F.lit(1)), F.lit(1))), _shape(F.substr(F.get(p, i + 1), F.lit(1), F.lit(1))))
            code = F.lit(KINDS.index(kind))
            for x, n in zip((*(v + 1 for v in votes), *shape), list(FEATURES.values())[1:], strict=True):
                code = code * n + x
            return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + size).cast("int").alias("end"), valid.alias("base"), code.cast("int").alias("code"))

        lengths = F.transform(p, lambda x: F.length(x))
        return F.when(F.size(p) < 2, _none()).otherwise(_let(_starts(lengths), lambda at: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: span(i, at))))

    found = _let(pieces, spans)
    return found if only_if is None else F.when(only_if, found).otherwise(_none())


def _clear(spans: Column) -> Column:
    """Sorted candidates without the loose ones that overlap a base span."""

    def of(s: Column) -> Column:
        behind = _ends_before(s, lambda x: x["base"])
        last = F.lit(2**31 - 1)
        ahead = F.reverse(_before(F.transform(F.reverse(s), lambda x: F.when(x["base"], x["start"]).otherwise(last)), last, lambda t, y: F.least(t, y)))
        return _let(F.struct(behind.alias("b"), ahead.alias("a")), lambda q: F.filter(s, lambda x, i: x["base"] | ((F.get(q["b"], i) <= x["start"]) & (F.get(q["a"], i) >= x["end"]))))

    return _let(spans, lambda s: F.when(F.exists(s, lambda x: x["base"]) & F.exists(s, lambda x: ~x["base"]), of(s)).otherwise(s))


def candidates(text: Column, given: tuple[str, ...] = GIVEN) -> Column:
    """The array of a text's candidates by start and kind."""

    def of(t: Column) -> Column:
        has = lambda *x: F.array_contains(F.array(*(t.contains(F.lit(y)) for y in x)), True)
        name = rf"(?<!\p{{L}})(?:{'|'.join(given)})\x20\p{{Lu}}\p{{L}}++(?:-\p{{Lu}}\p{{L}}++)?+"
        found = [
            _found(t, "email", BASE["email"], True, has("@")), _found(t, "ip", BASE["ip"], True), _found(t, "card", BASE["card"], True), _found(t, "phone", BASE["phone"], True, has("+")),
            _found(t, "phone", LOOSE["phone"], False), _found(t, "email", LOOSE["email"], False, has("(at)", "[at]", "(AT)", "[AT]")),
            _found(t, "iban", LOOSE["iban"], False), _found(t, "ssn", LOOSE["ssn"], False, has("-")), _found(t, "secret", LOOSE["secret"], False), _found(t, "name", name, False, has(*given)),
        ]
        return _clear(F.array_sort(F.concat(*found)))

    return _let(F.translate(F.coalesce(text, F.lit("")), "\x01", "\x02"), of)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, spans): the rows of docs, each as a struct, and their candidates."""
    return docs.select(F.struct("*").alias("row"), candidates(F.col(f"`{text}`")).alias("spans"))


def reliabilities(votes: np.ndarray, times: np.ndarray, fixed: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of vote patterns by EM, and each labeler's chance of a vote for where the class is 1, against where it is
    0. A labeler that does not vote says nothing. Both chances begin at 0.85, which weighs as much as all candidates do
    together, so that results do not hang on their number; the prior stays at most at a half. fixed: patterns known to be of
    class 1."""
    known = np.zeros(len(votes), bool) if fixed is None else fixed
    hit = np.full((2, votes.shape[1]), 0.85)
    prior, post = 0.5, np.full(len(votes), 0.5)
    for _ in range(rounds):
        for_, against = votes == 1, votes == -1
        odds = np.log(prior / (1 - prior)) + for_ @ np.log(hit[1] / (1 - hit[0])) + against @ np.log((1 - hit[1]) / hit[0])
        post = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        for c, (w, says) in enumerate(((times * (1 - post), against), (times * post, for_))):
            hit[c] = np.clip((w @ says + 0.85 * times.sum()) / (w @ (votes != 0) + times.sum()), 0.5, 0.99)
        open_ = times * ~known
        prior = float(np.clip((open_ @ post + 1) / (open_.sum() + 2), 0.02, 0.5))
    return post, hit[1], hit[0]


def _decoded(codes: np.ndarray) -> np.ndarray:
    """Features of codes, a row each; votes from -1 to 1."""
    x = np.array(np.unravel_index(codes, tuple(FEATURES.values()))).T
    x[:, 1:4] -= 1
    return x


def _coded(x: np.ndarray) -> np.ndarray:
    """One column for each kind, and each value of a feature within a kind."""
    columns = [x[:, 0] == k for k in range(len(KINDS))]
    for j, n in list(enumerate(FEATURES.values()))[1:]:
        columns += [(x[:, 0] == k) & (x[:, j] == v) for k, v in product(range(len(KINDS)), range(-1, 2) if j < 4 else range(n))]
    return np.column_stack(columns).astype(float)


def trained(codes: np.ndarray, times: np.ndarray, base: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """For every code whether the span classifier is certain, from counts of candidates by code."""
    x, post = _decoded(codes), np.zeros(len(codes))
    for kind in set(x[:, 0].tolist()):
        own = x[:, 0] == kind
        post[own] = reliabilities(x[own, 1:4], times[own], base[own])[0]
    rows, scale = _coded(x), np.log1p(times)
    w = np.zeros(rows.shape[1])
    for _ in range(30):  # Newton's steps on the ridged logistic loss
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (scale * (p - post)) + ridge * w
        curve = rows.T @ (rows * (scale * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -4, 4)
    every = _coded(_decoded(np.arange(CODES))) @ w
    return 1 / (1 + np.exp(-np.clip(every, -30, 30))) >= CERTAIN


def fit(spans: DataFrame, column: str = "spans") -> np.ndarray:
    """The classifier's table: a flag for each code. All flags are off without candidates."""
    rows = spans.select(F.explode(column).alias("s")).groupBy("s.code", "s.base").count().collect()  # a row per code: bounded
    if not rows:
        return np.zeros(CODES, bool)
    return trained(*(np.array([r[c] for r in rows]) for c in ("code", "count", "base")))


def reported(model: np.ndarray, spans: Column) -> Column:
    """The spans reported: those of base kinds, and those that the classifier adds."""
    bits = F.lit("".join("01"[int(x)] for x in model))
    if not model.any():
        return F.filter(spans, lambda s: s["base"])
    chosen = F.filter(spans, lambda s: s["base"] | (F.substr(bits, s["code"] + 1, F.lit(1)) == "1"))
    first = lambda q: F.filter(q["s"], lambda s, i: s["base"] | (F.get(q["e"], i) <= s["start"]))
    return _let(chosen, lambda c: F.when(F.exists(c, lambda s: ~s["base"]), _let(F.struct(c.alias("s"), _ends_before(c, lambda s: ~s["base"]).alias("e")), first)).otherwise(c))


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def listed(found: DataFrame, model: np.ndarray) -> DataFrame:
    """found (doc_id, spans): counts and hash of the base spans, all spans, their number, and whether there are any."""
    rows = found.select("doc_id", F.filter("spans", lambda s: s["base"]).alias("base"), reported(model, F.col("spans")).alias("every"))
    of_kind = lambda k: F.filter("base", lambda s: s["rank"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:N_BASE])]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"), (F.size("every") > 0).alias("flagged"))


def _rewritten(text: Column, spans: Column) -> Column:
    """text with each of the disjoint, sorted spans (start, end, rank) as its kind in angle brackets. The text is first cut
    into runs of about the root of the spans' number, as finding a place in a text takes steps by its length."""
    mark = lambda s: F.element_at(F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS)), s["rank"] + 1)

    def of(q: Column) -> Column:
        m, c = q["m"], q["c"]
        till = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))

        def run(k: Column) -> Column:
            own = F.slice(m, k * c + 1, c)
            begin = till(k * c)
            piece = F.substr(text, begin + 1, F.element_at(own, -1)["end"] - begin)
            return _let(F.struct(own.alias("o"), piece.alias("p"), begin.alias("b")), lambda r: F.array_join(F.transform(r["o"], lambda s, i: _let(F.coalesce(F.get(r["o"], i - 1)["end"], r["b"]), lambda e: F.concat(F.substr(r["p"], e - r["b"] + 1, s["start"] - e), mark(s)))), ""))

        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / c).cast("int")), run), ""), F.substr(text, till(F.size(m)) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(spans.alias("m"), F.ceil(F.sqrt(F.size(spans))).cast("int").alias("c")), of))


def _joined(spans: Column) -> Column:
    """Sorted spans with those that overlap made one, of the first's kind."""

    def of(q: Column) -> Column:
        heads = F.filter(F.transform(q["s"], lambda s, i: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), F.get(q["e"], i).alias("e"))), lambda x: x["e"] <= x["start"])
        return _let(heads, lambda h: F.transform(h, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(h, i + 1)["e"], F.array_max(F.transform(q["s"], lambda s: s["end"]))).alias("end"), x["rank"].alias("rank"))))

    none = F.array().cast("array<struct<start:int,end:int,rank:int>>")
    return F.when(F.size(spans) == 0, none).otherwise(_let(F.struct(spans.alias("s"), _ends_before(spans).alias("e")), of))


def masked(found: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """The rows that with_candidates found, every reported span of their text replaced by its kind in angle brackets;
    overlapping spans become one, of the first's kind. A null text stays null."""
    columns = found.schema["row"].dataType.names
    whole = F.col(f"row.`{text}`")
    new = _let(_let(reported(model, F.col("spans")), _joined), lambda m: _rewritten(whole, m))
    return found.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns))


def masking(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all reported spans masked, by a model of docs itself; texts are searched once."""
    found = saved(with_candidates(docs, text))
    return masked(found, fit(found), text)
