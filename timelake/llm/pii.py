"""Personal data by weak supervision, in DataFrame expressions alone.

Base rules give the spans of four kinds (email, ip, card, phone). Loose patterns give candidates of these and of four
more kinds (secrets such as keys and tokens, bank accounts, names, street addresses). Labelers vote on every base span
and candidate: the base rule, a check of its structure (Luhn, the account check by 97, mixed characters), a gazetteer
(endings, issuers, dialling and country codes, given names, street words), the words before it, and its edges.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each
pattern is personal data. A logistic span classifier is then trained on those posteriors; it sees each vote by the
log-odds that its labeler's reliability gives it, and the span itself: its length, its share of digits, and the
characters on both sides. It decides the candidates. Base spans always stay; candidates that overlap a base span go.

`detect` scans each text once: candidates are written with their documents, counted, and decided when read again. The
driver gets one row for each pattern of kind, votes and span features: at most 8 * 3**5 * 4 * 3 * 3 * 3.

Positions come from the lengths of matches and of the gaps between them, in code points; ends are exclusive. The
patterns use possessive or bounded repeats and start at run edges, so that very long texts take linear time.

Edge cases: null and empty texts have no spans; with no span in a corpus the classifier rejects every candidate. Rows
are judged one by one, so repeated rows, null keys and extra columns are fine, whatever their names; the output column
is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved

#: The first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "name", "address")
RULED = 4
LABELERS = ("rule", "structure", "gazetteer", "context", "edges")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TITLE = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
_WORD = r"\p{Lu}[\p{L}'-]++"
#: Common given names (a fixed list).
GIVEN = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Hans|Peter|Klaus|Jürgen|Stefan|Anna|Ursula|Monika|Sabine|Petra|Jean|Pierre|Michel|Philippe|Marie|Nathalie|Isabelle|Catherine|José|Antonio|Manuel|Francisco|Carmen|Ana|Dolores|Pilar"
#: Words for streets (a fixed list).
STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court"
LOOSE = {
    "email": rf"(?i)(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?[(\[]\x20?at\x20?[)\]]\x20?{_HOST}++(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?{_HOST}++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])3[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}])(?=[A-Z]\p{{Ll}}{{1,9}}\.?\x20\p{{Lu}})(?:(?:{_TITLE})\.?\x20{_WORD}(?:\x20{_WORD})?|(?:{GIVEN})\x20{_WORD})",
    "address": rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}}\x20(?:{_WORD}\x20){{1,3}}(?:{STREET})(?![\p{{L}}])|\p{{Lu}}\p{{L}}{{2,30}}(?:straße|strasse|weg|platz|allee)\x20[0-9]{{1,4}}[a-z]?(?![\p{{L}}0-9])|[0-9]{{1,4}},?\x20(?:rue|calle|avenida)\x20(?:(?:de|du|des|la|del)\x20){{0,2}}{_WORD})",
}
#: What a text must hold before a pattern is tried on it.
HINTS = {
    ("email", True): "instr(t, '@') > 0",
    ("ip", True): r"t rlike '[0-9]\\.[0-9]'",
    ("card", True): r"t rlike '[0-9](?:[\\x20-]?[0-9]){15}'",
    ("phone", True): "instr(t, '+') > 0",
    ("email", False): r"t rlike '[(\\[]\\x20?[dD][oO][tT]'",
    ("ip", False): r"instr(t, ':') > 0 and t rlike '[0-9A-Fa-f]:[0-9A-Fa-f]'",
    ("card", False): r"t rlike '3[0-9]{3}[\\x20-][0-9]{6}'",
    ("phone", False): r"t rlike '[0-9]{3}[.-][0-9]{4}'",
    ("secret", False): r"t rlike '[A-Za-z0-9+/_=-]{20}' and t rlike '[A-Za-z+/_=-][0-9][A-Za-z0-9+/_=-]|[0-9][A-Za-z+/_=-]'",
    ("account", False): r"t rlike '[A-Z]{2}[0-9]{2}'",
    ("name", False): rf"t rlike '(?=[A-Z]\\p{{Ll}}{{1,9}}\\.?\\x20\\p{{Lu}})(?:{_TITLE}|{GIVEN})\\.?\\x20'",
    ("address", False): r"t rlike '[0-9]\\x20\\p{Lu}|(?:straße|strasse|weg|platz|allee)\\x20[0-9]|[0-9],?\\x20(?:rue|calle|avenida)\\x20'",
}
#: Words that speak for a kind when they stand before a span, and words that speak against every kind (fixed values).
CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo", "ip": "ip|server|host|address|login|adresse|servidor", "card": "card|visa|credit|payment|pay|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|handy|anruf|appel|llam",
    "secret": "token|secret|key|password|passwd|pwd|auth|bearer|credential|kennwort|clave", "account": "iban|account|bank|konto|compte|cuenta", "name": "name|contact|signed|author|by|dear|von|par|por", "address": "address|lives?|street|located|wohnt|anschrift|adresse|habite|vive",
}
AGAINST = "version|license|isbn|commit|order|section|serial|checksum|figure"
#: Name endings, address blocks that nobody owns, card issuers, dialling codes, shapes of keys, and account countries (fixed values).
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|de|at|ch|fr|be|es|pt|it|nl|pl|se|no|dk|fi|ie|uk|eu|us|ca|au|jp|cn|in|br|mx|ru)$",
    "ip": r"^(?!0+\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-9]\.)(?:[0-9]{1,3}\.|[0-9A-Fa-f]{1,4}:)",
    "card": r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[68]|35|6011|64[4-9]|65)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[7-9][0-9]|8[0578][0-9]|9[679][0-9])|\(?[2-9][0-9]{2})",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_\w+|sk[-_]\w+|xox[abp]-.+|eyJ.+|[A-Za-z0-9+/]{22,}={1,2})$",
    "account": r"^(?:AD|AE|AL|AT|BA|BE|BG|BR|CH|CY|CZ|DE|DK|EE|ES|FI|FO|FR|GB|GI|GR|HR|HU|IE|IL|IS|IT|KW|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|RS|SA|SE|SI|SK|SM|TR)",
    "name": rf"(?:^|\x20)(?:{GIVEN})(?:\x20|$)",
    "address": rf"(?:\x20(?:{STREET})|straße\x20[0-9]+[a-z]?|strasse\x20[0-9]+[a-z]?|\x20(?:rue|calle|avenida)\x20.*)$",
}
#: Kinds whose spans hold a digit: most texts have none, and one look settles them all.
DIGITS = ("ip", "card", "phone", "secret", "account", "address")
EMPTY = "cast(array() as array<struct<kind:int,start:int,end:int,hit:string,base:boolean>>)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: str, base: bool) -> str:
    """SQL for the array of all matches of a kind in column t, with positions."""
    p, k = _sql((BASE if base else LOOSE)[kind]), KINDS.index(kind)
    empty = EMPTY
    found = f"arrays_zip(split(t, {p}, -1) as g, regexp_extract_all(t, {p}, 0) as h)".replace(" as g", "").replace(" as h", "")
    return f"""if({HINTS[kind, base]}, aggregate({found}, named_struct('pos', 0, 'out', {empty}),
        (a, x) -> named_struct('pos', a.pos + length(x.`0`) + coalesce(length(x.`1`), 0), 'out', if(x.`1` is null, a.out, concat(a.out, array(
            named_struct('kind', {k}, 'start', a.pos + length(x.`0`), 'end', a.pos + length(x.`0`) + length(x.`1`), 'hit', x.`1`, 'base', {str(base).lower()}))))),
        a -> a.out), {empty})"""


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the Luhn check."""
    padded, total = F.lpad(digits, 20, "0"), F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def valid(s: Column) -> Column:
    """The check that a match of a base pattern must pass."""
    n, part = F.length(_digits(s["hit"])), "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    return (
        F.when(s["kind"] == 1, s["hit"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(s["kind"] == 2, (n >= 16) & (n <= 19) & luhn(_digits(s["hit"])))
        .when(s["kind"] == 3, (n >= 8) & (n <= 15))
        .otherwise(True)
    )


def _account_ok(hit: Column) -> Column:
    """Whether the number of a bank account leaves 1 when divided by 97, letters read as 10 to 35 and the head moved behind."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return rest == 1


def with_candidates(docs: DataFrame, text: str = "text", out: str = "_found") -> DataFrame:
    """`docs` with an array of base spans and of loose candidates that overlap none of them, each with votes and features."""
    rest = docs.drop(out) if out != text else docs
    t, base, loose = (free_name(rest, f"_pii_{x}") for x in ("text", "base", "loose"))
    at = rest.withColumn(t, F.coalesce(docs[text].cast("string"), F.lit("")))

    def sql(rule):
        kinds = KINDS[:RULED] if rule else KINDS
        several = lambda own: f"concat({', '.join(_matches(k, rule) for k in own)})"
        return f"concat({several([k for k in kinds if k not in DIGITS])}, if(t rlike '[0-9]', {several([k for k in kinds if k in DIGITS])}, {EMPTY}))"

    at = at.withColumn(base, F.expr(f"(transform(array(`{t}`), t -> {sql(True)}))[0]")).withColumn(base, F.filter(base, valid))
    at = at.withColumn(loose, F.expr(f"(transform(array(`{t}`), t -> {sql(False)}))[0]"))
    clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = F.concat(base, F.filter(loose, clear))
    # most texts have no span: their votes need no text
    at = at.withColumn(out, F.when(F.size(base) + F.size(loose) > 0, F.transform(spans, lambda s: _voted(s, F.col(t)))).otherwise(F.transform(spans, lambda s: _voted(s, F.lit("")))))
    return at.drop(t, base, loose)


def _per_kind(s: Column, tests) -> Column:
    choice = F.when(s["kind"] == 0, tests(KINDS[0]))
    for i, k in enumerate(KINDS[1:], 1):
        choice = choice.when(s["kind"] == i, tests(k))
    return choice


#: Features of a span beside its votes, each a small whole number, and how many values each has.
SHAPE = {"size": 4, "digits": 3, "before": 3, "after": 3}


def _voted(s: Column, text: Column) -> Column:
    """The span with one vote (-1, 0 or 1) of each labeler, and its features."""
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)
    hit = s["hit"]
    before = F.lower(F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40))))
    left, right = F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.substring(text, s["end"] + 1, 1)
    inside = left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]")
    n = F.length(_digits(hit))
    varied = F.size(F.array_distinct(F.split(hit, ""))) >= 9
    checks = {
        "email": F.length(hit) <= 254, "ip": F.length(hit) <= 39, "card": luhn(_digits(hit)), "phone": (n >= 8) & (n <= 15),
        "secret": varied & (n >= 2) & (n < F.length(hit) - 1), "account": _account_ok(hit), "name": hit.rlike(rf"^(?:{_TITLE})|\x20{_WORD}$"), "address": n >= 1,
    }
    shape = _per_kind(s, lambda k: checks[k])
    known = _per_kind(s, lambda k: hit.rlike(GAZETTEER[k]))
    near = _per_kind(s, lambda k: before.rlike(rf"\b(?:{CONTEXT[k]})"))
    rule = F.when(s["base"], 1).when(s["kind"] < RULED, -1).otherwise(0)
    # what a list of names or streets lacks is not thereby wrong
    listed = (s["kind"] < RULED) | (s["kind"] == KINDS.index("account"))
    votes = (rule, vote(shape), vote(known, listed), vote(near, before.rlike(rf"\b(?:{AGAINST})\b")), vote(~inside))
    size, share = F.length(hit), n / F.greatest(F.length(hit), F.lit(1))
    side = lambda c: F.when(c.rlike(r"[\p{L}0-9]"), 2).when(c.rlike(r"[\s]") | (c == ""), 0).otherwise(1)
    features = {"size": F.when(size < 12, 0).when(size < 20, 1).when(size < 40, 2).otherwise(3), "digits": F.when(share < 0.2, 0).when(share < 0.7, 1).otherwise(2), "before": side(left), "after": side(right)}
    named = [*zip(LABELERS, votes, strict=True), *features.items()]
    return F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "base")), *(v.cast("int").alias(name) for name, v in named))


@dataclass(frozen=True)
class Reliability:
    """What was learnt: how often spans of a kind are personal data, each labeler's chance of each vote given the truth
    (chance[truth][labeler][vote + 1]), the log-odds that each vote so carries, and the classifier's weights."""

    prior: tuple[float, ...]
    chance: tuple
    odds: tuple
    weights: tuple[float, ...]
    shape: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]


#: Spans on which each labeler is held to be right (and a quarter as many, wrong) before any is seen.
TRUST = 8.0


def estimate(patterns: list[tuple], rounds: int = 60) -> tuple[list[float], list, list[float]]:
    """EM over (kind, votes, count): prior by kind, chance[truth][labeler][vote + 1], posterior by pattern.

    A labeler that abstains (vote 0) says nothing: chances are those of its votes for and against, given that it votes.
    """
    n = len(LABELERS)
    post = [min(0.95, max(0.05, 0.5 + sum(v) / (2 * n))) for _, v, _ in patterns]
    prior, chance = [0.5] * len(KINDS), []
    for _ in range(rounds):
        votes_of = [[[TRUST, 0.0, TRUST / 4] if truth == 0 else [TRUST / 4, 0.0, TRUST] for _ in range(n)] for truth in range(2)]
        mass = [[1.0, 1.0] for _ in KINDS]
        for (kind, votes, count), p in zip(patterns, post, strict=True):
            for truth, w in ((0, (1 - p) * count), (1, p * count)):
                mass[kind][truth] += w
                for j, v in enumerate(votes):
                    votes_of[truth][j][v + 1] += w
        chance = [[[row[0] / (row[0] + row[2]), 1.0, row[2] / (row[0] + row[2])] for row in side] for side in votes_of]
        prior = [m[1] / sum(m) for m in mass]
        for i, (kind, votes, _) in enumerate(patterns):
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(chance[1][j][v + 1] / chance[0][j][v + 1]) for j, v in enumerate(votes))
            post[i] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
    return prior, chance, post


def vote_odds(chance: list) -> list[list[float]]:
    """The log-odds that each vote of each labeler carries."""
    return [[math.log(chance[1][j][v] / chance[0][j][v]) for v in range(3)] for j in range(len(LABELERS))]


def train_classifier(rows: list[tuple], odds: list, post: list[float], rounds: int = 400, rate: float = 0.3, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights of votes and span features, bias by kind): logistic regression on the posteriors by gradient descent.

    rows: (kind, votes, features, count).
    """
    width = len(LABELERS) + sum(SHAPE.values())
    x, kinds, count = np.zeros((len(rows), width)), np.zeros((len(rows), len(KINDS))), np.array([r[3] for r in rows], float)
    for i, (kind, votes, features, _) in enumerate(rows):
        x[i, : len(LABELERS)] = [odds[j][v + 1] / 4 for j, v in enumerate(votes)]
        at = len(LABELERS)
        for f, size in zip(features, SHAPE.values(), strict=True):
            x[i, at + f] = 1
            at += size
        kinds[i, kind] = 1
    w, b, target = np.zeros(width), np.full(len(KINDS), -1.0), np.array(post)
    for _ in range(rounds if len(rows) else 0):
        e = (1 / (1 + np.exp(-np.clip(x @ w + kinds @ b, -50, 50))) - target) * count / count.sum()
        w, b = w - rate * (x.T @ e + ridge * w), b - rate * 4 * (kinds.T @ e)
    return w, b


def fit_candidates(found: DataFrame, column: str) -> Reliability:
    """Estimate the labelers' reliabilities from all spans in an array column and train the span classifier."""
    spans = found.select(F.explode(column).alias("s"))
    rows = spans.groupBy(*(F.col(f"s.{x}") for x in ("kind", *LABELERS, *SHAPE))).count().collect()  # bounded: see above
    whole = sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in SHAPE), r["count"]) for r in rows)
    votes: dict[tuple, int] = {}
    for kind, v, _, count in whole:
        votes[kind, v] = votes.get((kind, v), 0) + count
    patterns = [(k, v, c) for (k, v), c in sorted(votes.items())]
    prior, chance, post = estimate(patterns)
    likely = {(k, v): p for (k, v, _), p in zip(patterns, post, strict=True)}
    odds = vote_odds(chance)
    w, b = train_classifier(whole, odds, [likely[k, v] for k, v, _, _ in whole])
    shape, at = [], len(LABELERS)
    for size in SHAPE.values():
        shape.append(tuple(map(float, w[at : at + size])))
        at += size
    return Reliability(tuple(prior), tuple(tuple(map(tuple, side)) for side in chance), tuple(map(tuple, odds)), tuple(map(float, w[: len(LABELERS)])), tuple(shape), tuple(map(float, b)))


def fit(docs: DataFrame, text: str = "text") -> Reliability:
    """`fit_candidates` on all texts."""
    return fit_candidates(with_candidates(docs.select(docs[text].alias("text")), out="found"), "found")


def decide(found: DataFrame, model: Reliability, column: str, out: str) -> DataFrame:
    """`found` with `out` instead of its candidates: array of (kind, start, end, base), by kind and start."""
    pick = lambda table, at: F.element_at(F.array(*(F.lit(float(x)) for x in table)), at + 1)

    def z(s):
        votes = sum((pick([o * w / 4 for o in model.odds[j]], s[x] + 1) for j, (x, w) in enumerate(zip(LABELERS, model.weights, strict=True))), F.lit(0.0))
        return votes + sum((pick(table, s[f]) for f, table in zip(SHAPE, model.shape, strict=True)), pick(model.bias, s["kind"]))

    chosen = F.filter(column, lambda s: s["base"] | (z(s) >= 0))
    small = F.array_sort(F.transform(chosen, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "base")))))
    return found.select(*(c for c in found.columns if c not in (column, out)), small.alias(out))


def find(docs: DataFrame, model: Reliability, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with `out`: the base spans and what the classifier adds, for a model that was fitted before."""
    column = free_name(docs, "_pii_found")
    return decide(with_candidates(docs, text, column), model, column, out)


def detect(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with `out`, by a model fitted on all of them: texts are scanned once, and written with their candidates."""
    column = free_name(docs, "_pii_found")
    found = saved(with_candidates(docs, text, column), "candidates")
    return decide(found, fit_candidates(found, column), column, out)


def notation(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(a, s):
        piece = F.array(F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.when(s["start"] >= a["pos"], F.concat(a["parts"], piece)).otherwise(a["parts"]).alias("parts"))

    done = F.aggregate(by_start, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
