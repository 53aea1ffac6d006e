"""Personal data by weak supervision (native DataFrame and SQL functions only).

Candidates are the matches of four base patterns (e-mail, IP address, card, phone; leftmost and
non-overlapping per kind) and of two looser ones (spelled-out addresses, phone numbers without a
country code).  Four labelers vote on each candidate, for, against or not at all: its strict form,
a gazetteer (top-level domains, issuer and reserved prefixes), the words before it, and its
borders.  Expectation-maximisation over the counts of vote patterns, a table of a few hundred rows
at most, estimates how reliable every labeler is and how likely every pattern is personal data;
a logistic span classifier is trained on the patterns with these soft labels.  Base spans that
keep their form always stay; the classifier decides on the others.

Positions are code points, ends exclusive.  They follow from the lengths of the matches and of the
pieces between them, so every text is read whole by the JVM's regular expressions alone.

Cases: null and empty texts have no spans; a null doc_id stays null; repeated rows are judged each;
an empty table gives an empty result and no classifier; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Possessive forms of the base patterns: same matches, no backtracking.  A match may start inside a
#: run only where the match before it ended (\G).
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[{LABEL}]++\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]++",
    "phone": r"(?<![0-9+.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?!\x20?[0-9])",
}
#: What a text must hold for a pattern to be worth running.
NEEDS = {"email": "contains(text, '@')", "ip": "text rlike r'[0-9]\\.[0-9]'", "card": "text rlike r'[0-9][\\x20-]?[0-9]'",
         "phone": "contains(text, '+')"}
LOOSE_NEEDS = {"email": "(contains(text, '[dot]') or contains(text, '(dot)') or contains(text, ' dot '))",
               "phone": "text rlike r'[0-9]{3}[\\x20.-][0-9]{4}'"}
DOMAINS = "com org net edu gov mil int info io co uk de fr es it nl eu us ca au ch at be pt pl ru jp cn br mx in example test"
BEFORE = 32
FOR = {"email": "mail|contact|write|reach", "ip": r"\bip\b|host|server|address|addr", "card": "card|visa|master|pay|credit|amex",
       "phone": r"phone|tel|call|fax|mobile|\bsms\b"}
AGAINST = r"version|\bver\b|\bv\b|isbn|issn|order|serial|invoice|figure|section|\bid\b|\bno\b"
LABELERS = ("form", "names", "context", "border")
SPAN = "struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>>"
ROUNDS = 60
STEPS = 400


def digits(m: str) -> str:
    return f"regexp_replace({m}, r'[^0-9]', '')"


def luhn(d: str) -> str:
    x = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return (f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, {x}, if({x} > 4, 2 * {x} - 9, 2 * {x}))) % 10 = 0")


def valid(kind: str, m: str) -> str:
    """Whether a base match keeps its kind's form."""
    if kind == "email":
        return "true"
    if kind == "ip":
        part = "coalesce(nullif(regexp_replace(p, r'^0+', ''), ''), '0')"
        return f"forall(split({m}, r'\\.'), p -> length({part}) <= 3 and cast(substring({part}, 1, 3) as int) <= 255)"
    low, high = (12, 19) if kind == "card" else (9, 15)
    n = f"length({digits(m)})"
    within = f"{n} between {low} and {high}"
    return f"case when {within} then {luhn(digits(m))} else false end" if kind == "card" else within


def worth(kind: str, m: str) -> str:
    """Whether a match that fails its form is a candidate at all."""
    if kind == "card":
        return f"length({digits(m)}) between 12 and 19"
    return f"length({digits(m)}) >= 7" if kind == "phone" else "true"


def votes(kind: str, m: str, at: str, form: str) -> str:
    """Votes of the labelers: 1 for, 0 against, 2 none."""
    before = f"lower(substring(text, greatest({at} - {BEFORE}, 0) + 1, least({at}, {BEFORE})))"
    last = f"right({before}, 1)"
    after = f"substring(text, {at} + length({m}) + 1, 1)"
    if kind == "email":
        names = f"if(array_contains(split('{DOMAINS}', ' '), lower(regexp_extract({m}, r'([A-Za-z]+)$', 1))), 1, 0)"
    elif kind == "ip":
        names = f"if({m} rlike r'^(0|127|255|2[3-5][0-9])\\.', 0, 1)"
    elif kind == "card":
        names = f"if({digits(m)} rlike r'^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)', 1, 0)"
    else:
        names = f"if({digits(m)} rlike r'^0{{3}}|(.)\\1{{6}}', 0, 2)"
    context = f"case when {before} rlike r'{FOR[kind]}' then 1 when {before} rlike r'{AGAINST}' then 0 else 2 end"
    border = f"if({last} rlike r'[a-z0-9_]' or {after} rlike r'[A-Za-z0-9_]', 0, 1)"
    return f"array({form}, {names}, {context}, {border})"


def found(kind: str, pattern: str, needs: str, base: bool) -> str:
    """SQL: the candidates of one pattern in ``text``, in order."""
    i = KINDS.index(kind)
    form = valid(kind, "x.m")
    vote = f"if({form}, 1, 0)" if base else "2"
    span = (f"named_struct('kind', {i}, 'start', acc.at + length(x.p), 'stop', acc.at + length(x.p) + length(x.m), "
            f"'base', {form if base else 'false'}, 'votes', {votes(kind, 'x.m', '(acc.at + length(x.p))', vote)})")
    keep = f"({form}) or ({worth(kind, 'x.m')})" if base else "true"
    # pieces[k] precedes the k-th match
    return f"""if({needs}, aggregate(
        zip_with(slice(split(text, r'{pattern}', -1), 1, size(regexp_extract_all(text, r'{pattern}', 0))),
                 regexp_extract_all(text, r'{pattern}', 0), (p, m) -> named_struct('p', p, 'm', m)),
        named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
        (acc, x) -> named_struct('at', acc.at + length(x.p) + length(x.m),
                                 'out', if({keep}, concat(acc.out, array({span})), acc.out)),
        acc -> acc.out), cast(array() as array<{SPAN}>))"""


def candidates(text: str = "text") -> Column:
    """All candidates; loose ones only where no base span of good form overlaps them."""
    base = ", ".join(found(k, BASE[k], NEEDS[k], True) for k in KINDS)
    loose = ", ".join(found(k, LOOSE[k], LOOSE_NEEDS[k], False) for k in LOOSE)
    return F.expr(f"""transform(array(concat({base})), b -> concat(b, filter(concat({loose}),
        e -> not exists(b, f -> f.start < e.stop and e.start < f.stop))))[0]""")


def with_candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c) for c in keep])
    return rows.withColumn("cands", candidates())


class SpanClassifier:
    """Reliabilities of the labelers by kind, and the weights of the span classifier."""

    def __init__(self, counts: dict[tuple, float]):
        """``counts``: (kind, votes..) -> number of candidates."""
        self.reliability, self.prior, self.posterior = {}, {}, {}
        for kind in range(len(KINDS)):
            rows = {k[1:]: n for k, n in counts.items() if k[0] == kind}
            if rows:
                self._em(kind, rows)
        self.weights = self._logistic(counts)

    def _em(self, kind: int, rows: dict[tuple, float]) -> None:
        # start: share of votes for, the strict form counting twice
        post = {}
        for v in rows:
            say = [v[0], *[x for x in v if x != 2]]
            post[v] = min(0.95, max(0.05, sum(say) / len(say)))
        total = sum(rows.values())
        for _ in range(ROUNDS):
            prior = (sum(n * post[v] for v, n in rows.items()) + 1) / (total + 2)
            rel = []
            for j in range(len(LABELERS)):
                table = []
                for c in (0, 1):
                    # a vote fits its class more often than not: a prior of two votes to one
                    w = [2.0 if x == c else 1.0 for x in (0, 1, 2)]
                    for v, n in rows.items():
                        w[v[j]] += n * (post[v] if c else 1 - post[v])
                    table.append([x / sum(w) for x in w])
                rel.append(table)
            for v in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rel[j][1][x] / rel[j][0][x]) for j, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        self.reliability[kind], self.prior[kind] = rel, prior
        self.posterior |= {(kind, *v): p for v, p in post.items()}

    def _logistic(self, counts: dict[tuple, float]) -> dict[tuple, float]:
        """Weights (feature -> weight) by gradient steps; a feature is a kind's (labeler, vote) or its bias."""
        def feats(k):
            return [(k[0], "bias", 0), *[(k[0], name, x) for name, x in zip(LABELERS, k[1:], strict=True)]]
        w = {f: 0.0 for k in counts for f in feats(k)}
        sums = dict.fromkeys(w, 1e-6)
        mass = {kind: sum(n for k, n in counts.items() if k[0] == kind) for kind in range(len(KINDS))}
        for _ in range(STEPS):
            grad = {f: 1e-3 * x for f, x in w.items()}
            for k, n in counts.items():
                z = sum(w[f] for f in feats(k))
                g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - self.posterior[k]) * n / mass[k[0]]
                for f in feats(k):
                    grad[f] += g
            for f, g in grad.items():
                sums[f] += g * g
                w[f] -= 0.3 * g / math.sqrt(sums[f])
        return w

    def score_sql(self, x: str) -> str:
        """SQL: log odds of a candidate struct."""
        if not self.weights:
            return "-1.0D"
        terms = []
        for j, name in enumerate(LABELERS):
            cases = " ".join(f"when {x}.kind = {k} and {x}.votes[{j}] = {v} then {w!r}D"
                             for (k, n, v), w in sorted(self.weights.items(), key=str) if n == name)
            terms.append(f"case {cases} else 0.0D end")
        cases = " ".join(f"when {x}.kind = {k} then {w!r}D" for (k, n, _), w in sorted(self.weights.items(), key=str) if n == "bias")
        return " + ".join([f"case {cases} else 0.0D end", *terms])


def train(cands: DataFrame) -> SpanClassifier:
    """Classifier from all candidates of a table with column ``cands``."""
    v = [F.col("c.votes")[j].alias(n) for j, n in enumerate(LABELERS)]
    rows = cands.select(F.explode("cands").alias("c")).select(F.col("c.kind").alias("kind"), *v)
    rows = rows.groupBy("kind", *LABELERS).count().collect()  # 4 * 3^4 rows at most
    return SpanClassifier({tuple(r[:-1]): float(r[-1]) for r in sorted(rows)})


def in_order(spans: str) -> str:
    return f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'kind', s.kind, 'stop', s.stop)))"


def joined(spans: str) -> str:
    name = f"element_at(array({', '.join(repr(k) for k in KINDS)}), s.kind + 1)"
    return f"array_join(transform({in_order(spans)}, s -> concat({name}, ':', s.start, ':', s.stop)), ',')"


def accepted(model: SpanClassifier) -> str:
    """SQL: base spans, and what the classifier takes of the loose ones (a match that fails its form is dropped)."""
    return f"filter(cands, s -> s.base or (s.votes[0] = 2 and ({model.score_sql('s')}) >= 0.0D))"


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans (``kind:start:end``, joined)."""
    cands = cut_lineage(with_candidates(docs).drop("text"))
    model = train(cands)
    base = "filter(cands, s -> s.base)"
    return cands.select(
        "doc_id", *[F.expr(f"cast(size(filter(cands, s -> s.base and s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.expr(joined(base)).alias("base_spans"), F.expr(joined(accepted(model))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) with every span replaced by its kind in brackets."""
    rows = with_candidates(docs, ("lang", "source", "n_chars"))
    model = train(rows.select("cands"))
    name = f"element_at(array({', '.join(repr(k.upper()) for k in KINDS)}), s.kind + 1)"
    pieces = f"""aggregate({in_order(accepted(model))}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, s) -> if(s.start >= acc.at,
            named_struct('at', s.stop, 'out', concat(acc.out, array(substring(text, acc.at + 1, s.start - acc.at), concat('[', {name}, ']')))),
            named_struct('at', greatest(acc.at, s.stop), 'out', acc.out)),
        acc -> concat(acc.out, array(substring(text, acc.at + 1))))"""
    rows = rows.withColumn("_clean", F.when(F.size("cands") == 0, F.col("text")).otherwise(F.array_join(F.expr(pieces), "")))
    return rows.select("doc_id", F.col("_clean").alias("text"), "lang", "source",
                       F.when(F.size("cands") == 0, F.col("n_chars")).otherwise(F.char_length("_clean").cast("bigint")).alias("n_chars"))
