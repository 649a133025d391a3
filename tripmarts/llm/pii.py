r"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans of each kind, which may overlap: the base patterns (email, ip, card, phone) and looser ones (addresses with
written-out signs, telephone numbers without a plus, digit runs that fail the card check). Each span has features of its format (digits,
separators, first digit, length) and of its context (characters around it, cue words before it), all with a few levels.

Training covers all rows: base candidates that pass the checks of their kind count as 1, those that fail as 0. As features have few
levels, the counts per combination are all that the boosted trees need; this table has at most MAX_CELLS rows whatever the
input, only it comes to the driver. Trees of depth 2 are fitted to logistic loss and become column expressions. Thresholds per
kind are set on a held-out fifth of the candidates: the lowest score at which PRECISION holds.

Base spans that pass their checks are always kept; the others are added where their score reaches the threshold and they don't
overlap a base span of their kind. Base patterns are written possessively, which changes no match: no other start or length could match
where these fail, and texts without blanks take linear time and no stack.

Positions are code points, end exclusive. A null text is empty, an empty text has no spans, repeated rows get the same result each, a
null id stays null, an empty table gives no rows. Other columns are not read by `find`; `redact` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmarts import lineage
from tripmarts.llm.common import fresh_name

#: Kinds in the order of results, with the base pattern.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns that add candidates of a kind.
LOOSE = {
    "email": rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: What must be in a text for a pattern to match, as a cheap first test.
NEEDS = {"email": "@", "phone": "+"}
CUES = r"(?i)mail|phone|tel|call|fax|mobil|card|visa|credit|karte|carte|tarjeta|\bip\b|host|server|contact|address|account"
#: Features and their numbers of levels.
FEATURES = {"kind": 4, "digits": 6, "marks": 4, "lead": 3, "before": 4, "after": 4, "cue": 2}
MAX_CELLS = int(np.prod(list(FEATURES.values()))) * 4
ROUNDS, RATE, PRECISION = 24, 0.4, 0.95


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; what a lambda refers to by expression is computed for each of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))


def running_sums(lengths: Column) -> Column:
    """Running sums in blocks of the root of the size, so that growing arrays stay short."""
    def blocks(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda b: _running(F.slice(lengths, b * size + 1, size)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.element_at(p, -1))
        return let(_running(totals), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.get(ends, i) - F.element_at(p, -1)))))
    return let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), lambda size: let(blocks(size), joined))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, value, left, right) of all matches; left and right are what stands around one, up to 24 code points."""
    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.length(v) + F.length(g))
        return let(let(lengths, running_sums), lambda ends: F.transform(found, lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("start"), v.alias("value"), F.right(F.get(gaps, i), F.lit(24)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda v: F.when(F.size(v) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(v, gaps))))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column, digits: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _level(value: Column, *tests: Column) -> Column:
    """Number of the first test that holds, or the number of tests."""
    out = F.lit(len(tests))
    for i, t in reversed(list(enumerate(tests))):
        out = F.when(t, i).otherwise(out)
    return out


def _candidate_of(kind: str, loose: bool):
    return lambda s: _candidate(kind, loose, s)


def _candidate(kind: str, loose: bool, s: Column) -> Column:
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    n = F.length(digits)
    marks = F.regexp_replace(s["value"], "[0-9A-Za-z]", "")
    edge = lambda c: _level(c, c == "", c.rlike(r"^\s$"), c.rlike(r"^[\p{L}\p{N}]$"))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"),
        F.lit(loose).alias("loose"), (F.lit(False) if loose else _valid(kind, s["value"], digits)).alias("valid"),
        _level(n, n == 0, n < 9, n < 13, n < 16, n < 20).alias("digits"), _level(marks, marks == "", ~marks.rlike("[^ ]"), ~marks.rlike("[^ -]")).alias("marks"),
        _level(digits, digits == "", digits.rlike("^[3-6]")).alias("lead"), edge(F.right(s["left"], F.lit(1))).alias("before"), edge(s["right"]).alias("after"),
        F.when(s["left"].rlike(CUES), 1).otherwise(0).alias("cue"), (F.pmod(F.xxhash64(s["value"]), F.lit(5)) == 0).alias("held"))


def candidates(text: Column) -> Column:
    """Array of all candidates of a text, base and loose."""
    arrays = []
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for kind, pattern in patterns.items():
            spans = _spans(text, pattern)
            if not loose and kind in NEEDS:
                spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans)
            made = F.transform(spans, _candidate_of(kind, loose))
            if kind == "card":  # runs of other lengths are no candidates
                made = F.filter(made, lambda c: c["digits"].isin(3, 4))
            arrays.append(made)
    empty = F.filter(F.array(_candidate("card", False, F.struct(F.lit(0).alias("start"), F.lit("").alias("value"), F.lit("").alias("left"), F.lit("").alias("right")))), lambda _: F.lit(False))
    return F.concat(*[F.coalesce(a, empty) for a in arrays])


def fit_trees(cells: list[dict]) -> tuple[list[tuple], float]:
    """Boosted trees of depth 2 over (features, positive, negative) counts, and the start score.

    A tree is (feature, level, (feature, level, value, value), (feature, level, value, value)): left where the level isn't exceeded.
    """
    names = list(FEATURES)
    x = np.array([[c[f] for f in names] for c in cells], int).reshape(-1, len(names))
    pos, neg = (np.array([c[k] for c in cells], float) for k in ("positive", "negative"))
    if not len(x) or not pos.sum() or not neg.sum():
        return [], 0.0 if not len(x) else (4.0 if pos.sum() else -4.0)
    start = float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
    score, trees = np.full(len(x), start), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        best = (-1.0, 0, 0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f, name in enumerate(names):
            for level in range(FEATURES[name] - 1):
                low = rows & (x[:, f] <= level)
                high = rows & ~low
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                if gain > best[0] + 1e-12:
                    best = (gain, f, level)
        return best[1], best[2]

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
        top = split(np.ones(len(x), bool), g, h)
        sides = []
        for side in (True, False):
            rows = (x[:, top[0]] <= top[1]) == side
            f, level = split(rows, g, h)
            values = []
            for part in (rows & (x[:, f] <= level), rows & (x[:, f] > level)):
                value = float(RATE * g[part].sum() / (h[part].sum() + 1))
                score[part] += value
                values.append(value)
            sides.append((names[f], level, *values))
        trees.append((names[top[0]], top[1], *sides))
    return trees, start


def tree_score(c: Column, trees: list[tuple], start: float) -> Column:
    total = F.lit(start)
    for feature, level, low, high in trees:
        leaf = [F.when(c[f] <= k, a).otherwise(b) for f, k, a, b in (low, high)]
        total = total + F.when(c[feature] <= level, leaf[0]).otherwise(leaf[1])
    return total


def _score_of(cell: dict, trees: list[tuple], start: float) -> float:
    def leaf(t: tuple) -> float:
        return t[2] if cell[t[0]] <= t[1] else t[3]
    return start + sum(leaf(low) if cell[f] <= k else leaf(high) for f, k, low, high in trees)


def thresholds(cells: list[dict], held: list[dict], trees: list[tuple], start: float) -> list[float]:
    """Per kind the lowest score from which on PRECISION holds among the held-out candidates.

    Shares are taken with one success and one failure more, so that a few candidates prove nothing. Where no candidate of a kind fails,
    nothing speaks against its format: the least score (zero without candidates).
    """
    out = []
    for kind in range(len(KINDS)):
        rows = sorted(((_score_of(c, trees, start), c["positive"], c["negative"]) for c in held if c["kind"] == kind), reverse=True)
        mine = [c for c in cells if c["kind"] == kind]
        if not any(c["negative"] for c in mine):
            out.append(min((_score_of(c, trees, start) for c in mine), default=0.0))
            continue
        best, p, n = float("inf"), 0, 0
        for i, (s, a, b) in enumerate(rows):
            p, n = p + a, n + b
            if (i + 1 == len(rows) or rows[i + 1][0] < s) and p + 1 >= PRECISION * (p + n + 2):
                best = s
        out.append(best)
    return out


def fit(found: DataFrame, col: str = "candidates") -> tuple[list[tuple], float, list[float]]:
    """Trees, start score and thresholds from the candidates of all rows."""
    each = found.select(F.explode(col).alias("c")).where("NOT c.loose")
    counted = each.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.held").alias("held")).agg(
        F.count_if(F.col("c.valid")).alias("positive"), F.count_if(~F.col("c.valid")).alias("negative"))
    cells = sorted((r.asDict() for r in counted.collect()), key=lambda c: [c[f] for f in FEATURES] + [c["held"]])
    trees, start = fit_trees([c for c in cells if not c["held"]])
    return trees, start, thresholds(cells, [c for c in cells if c["held"]], trees, start)


def _sorted(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def chosen(found: DataFrame, col: str = "candidates") -> DataFrame:
    """Replace the candidates by base and spans: sorted arrays of (kind, start, end)."""
    trees, start, least = fit(found, col)
    enough = lambda c: tree_score(c, trees, start) >= F.element_at(F.array(*[F.lit(x) for x in least]), c["kind"] + 1)
    with_base = found.withColumn("base", F.filter(col, lambda c: c["valid"]))
    apart = lambda c: ~F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter(col, lambda c: ~c["valid"] & enough(c) & apart(c))
    return with_base.withColumn("spans", _sorted(F.concat("base", added))).withColumn("base", _sorted(F.col("base"))).drop(col)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base and spans (arrays of kind number, start, end)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return chosen(lineage.cut(docs.select(docs[id_col].alias(id_col), candidates(text).alias("candidates"))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, of the first (then longest) one's kind.

    Candidates are found once to fit the trees and again to redact, so no text is stored in between.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    trees, start, least = fit(docs.select(candidates(text).alias("candidates")))
    taken = list(docs.columns)
    col, spans = fresh_name(taken, "candidates"), fresh_name(taken, "pii_spans")
    rows = docs.withColumn(col, candidates(text))
    good = F.filter(F.col(col), lambda c: c["valid"] | (tree_score(c, trees, start) >= F.element_at(F.array(*[F.lit(x) for x in least]), c["kind"] + 1)))
    order = F.array_sort(F.transform(good, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["end"].alias("end"), c["kind"].alias("kind"))))
    rows = rows.withColumn(spans, order).drop(col)
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{x}>") for x in KINDS]), k + 1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda a, b: F.substr(F.col(text_col), a + 1, F.greatest(b - a, F.lit(0)))
    walked = F.aggregate(spans, state, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(cut(acc["at"], s["start"]), name(s["kind"]))).alias("parts")))
                         .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))))
    done = F.concat(F.array_join(walked["parts"], ""), F.substr(F.col(text_col), walked["at"] + 1))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(F.col(text_col))).select(*[F.col(c) for c in docs.columns])
