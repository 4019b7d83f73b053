r"""Personal data: overlapping candidates from high-recall generators, scored by boosted trees, selected by calibrated thresholds.

Everything that touches documents is a DataFrame expression without a shuffle: patterns run in the JVM, offsets come
from the lengths of the pieces between matches, features and trees are compiled into one expression. Offsets are
code points, ends exclusive.

Base spans (``email``, ``ip``, ``card``, ``phone``; patterns and limits in ``BASE``) are always kept. The generators in
``EXTRA`` propose more: bare phone numbers, identity numbers, bank account numbers, credentials in assignments, addresses
written out with (at) and (dot). A candidate is taken if the trees' score reaches the threshold of its generator, it
overlaps no base span, and no better scored candidate overlaps it.

The trees are fitted in ``fit`` on ``FIT_ROWS`` labelled lines made by rule from ``SHAPES`` (a bound that doesn't grow with the
data): half of them fit the trees, the other half sets each generator's threshold, halfway below the lowest score at which the
precision on that half still is ``precision``.

Null text counts as empty; a text without spans gives counts of 0, an empty ``spans`` and the digest of the empty string;
repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.tables import take_columns

#: kind: (pattern, cheap test that a text may hold it). Lookbehinds and possessive repeats keep long runs linear and change no match.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]")),
}
EXTRA = {
    "bare_phone": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}")),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"-[0-9]{2}-[0-9]{4}")),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
    "secret": (r"(?i)(?<![a-z])(?:api[_-]?key|token|secret|passw(?:or)?d|key)\x20{0,2}[:=]\x20{0,2}[\"']?[a-z0-9_/+.=-]{6,}+[\"']?", lambda t: t.rlike(r"(?i)(?:token|secret|passw(?:or)?d|key)\x20{0,2}[:=]")),
    "spelled_email": (r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[a-z0-9-]++|\.[a-z0-9-]++)++", lambda t: t.rlike(r"(?i)[\[(]\x20?at\x20?[\])]")),
}
KINDS = [*BASE, *EXTRA]
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}"
CONTEXT = 32  # code points looked at on either side
BLOCK = 128  # matches of a text that are handled together

#: Context words: for the kind, against it.
FOR = r"(?i)(?:phone|tel|call|mobile|fax|ssn|social|passport|identity|id card|iban|account|bank|token|secret|password|login|mail|contact|write)"
AGAINST = r"(?i)(?:order|invoice|part|version|isbn|serial|model|ref|page|chapter|sum|total|example|placeholder)"

FIT_ROWS, TREES, RATE = 4000, 30, 0.3

#: (generator, label, text with # for a digit, @ for a small letter or digit, ^ for a capital). These lines are the labelled data.
SHAPES = [
    ("bare_phone", 1, "call (###) ###-#### today"), ("bare_phone", 1, "phone ###-###-#### home"), ("bare_phone", 1, "his tel ### ### ####."), ("bare_phone", 1, "reach me on ###.###.####, please"),
    ("bare_phone", 0, "order ### ### #### shipped"), ("bare_phone", 0, "invoice ###-###-#### paid"), ("bare_phone", 0, "part no ###.###.#### in stock"), ("bare_phone", 0, "total ### ### #### units"),
    ("national_id", 1, "ssn ###-##-#### on file"), ("national_id", 1, "social security ###-##-####"), ("national_id", 1, "identity card ###-##-####,"), ("national_id", 1, "she gave ###-##-#### at the desk"),
    ("national_id", 0, "invoice ###-##-#### due"), ("national_id", 0, "part ###-##-#### replaced"), ("national_id", 0, "serial ###-##-#### of the pump"), ("national_id", 0, "ref ###-##-####"),
    ("account", 1, "iban DE## #### #### #### #### ##"), ("account", 1, "bank account FR## #### #### #### ####"), ("account", 1, "pay to GB##^^^^##############"), ("account", 1, "account ES######################"),
    ("account", 0, "serial ^^##^^^^^^^^^^^^"), ("account", 0, "model ^^## ^^^^ #### ^^^^ found"), ("account", 0, "version ^^##############"), ("account", 0, "isbn ^^## #### #### ####"),
    ("secret", 1, 'token = "@#@@#@##@@@#@@#@#@@#@##@"'), ("secret", 1, "api_key: @@##@@#@#@@#@##@@#@#@@##"), ("secret", 1, 'the password="@#@@#@^#@" leaked'), ("secret", 1, "secret = @#@@#@##@@@#@@#@#@"),
    ("secret", 0, "key: value"), ("secret", 0, "token = example"), ("secret", 0, "password: required"), ("secret", 0, "the key = placeholder text"), ("secret", 0, "secret: nothing at all"),
    ("spelled_email", 1, "mail ana#@@@@ (at) mail# (dot) org"), ("spelled_email", 1, "write to j.@@@@@@ [at] web@@@ [dot] com"), ("spelled_email", 1, "contact @@@@@ (at) host@@.net"),
    ("spelled_email", 0, "example sum @@ (at) ## (dot) ##"), ("spelled_email", 0, "page ## (at) ##.##"),
]


def _with_spans(docs: DataFrame, text: Column, kinds: list[str]) -> DataFrame:
    """docs with a column _kind each: the matches of its pattern, leftmost and apart, null where the cheap test says no.

    In steps, so that no text is searched more often than once for matches and once for the pieces between them.
    """
    patterns = BASE | EXTRA
    docs = docs.withColumns({f"_hit_{k}": F.when(patterns[k][1](text), F.regexp_extract_all(text, F.lit(patterns[k][0]), F.lit(0))) for k in kinds})
    docs = docs.withColumns({f"_gap_{k}": F.when(F.size(f"_hit_{k}") > 0, F.split(text, patterns[k][0], -1)) for k in kinds})
    lengths = lambda k: F.transform(F.arrays_zip(F.col(f"_hit_{k}").alias("hit"), F.slice(f"_gap_{k}", F.lit(1), F.size(f"_hit_{k}")).alias("gap")), lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long"))
    docs = _with_before(docs, {f"_at_{k}": F.when(F.size(f"_hit_{k}") > 0, lengths(k)) for k in kinds}, _sum)
    docs = docs.withColumns({f"_{k}": F.when(F.size(f"_hit_{k}") > 0, _spans(F.col(f"_at_{k}"), F.col(f"_hit_{k}"), F.col(f"_gap_{k}"))) for k in kinds})
    return docs.drop(*(f"_{x}_{k}" for k in kinds for x in ("hit", "gap", "at")))


def _with_before(found: DataFrame, values: dict[str, Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """Columns of these names: what comes before each of an array of numbers, joined from 0 on; null where the array is empty or null.

    An array that grows by an element is copied each time, so totals are joined over blocks, and then what is within each block.
    """

    def run(some: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(some, F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("all")), step)["all"]

    none = F.lit(0).cast("long")
    found = found.withColumns({f"{c}_v": v for c, v in values.items()})
    found = found.withColumns({f"{c}_b": F.when(F.size(f"{c}_v") > 0, F.transform(F.sequence(F.lit(1), F.size(f"{c}_v"), F.lit(BLOCK)), _slicer(f"{c}_v"))) for c in values})
    found = found.withColumns({f"{c}_t": run(F.transform(f"{c}_b", lambda b: F.aggregate(b, none, join)), none) for c in values})
    found = found.withColumns({c: F.flatten(F.transform(F.arrays_zip(F.col(f"{c}_b").alias("b"), F.col(f"{c}_t").alias("t")), lambda x: run(x["b"], x["t"]))) for c in values})
    return found.drop(*(f"{c}_{x}" for c in values for x in "vbt"))


def _slicer(name: str) -> Callable[[Column], Column]:
    return lambda i: F.slice(name, i, F.lit(BLOCK))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(at: Column, found: Column, between: Column) -> Column:
    """Structs of start, end, match and what stands around it: at is where the piece before each match begins, and there is one more piece than matches."""
    return F.transform(  # contexts come from the pieces on both sides
        F.arrays_zip(at.alias("at"), found.alias("hit"), F.slice(between, 1, F.size(found)).alias("left"), F.slice(between, 2, F.size(found)).alias("right")),
        lambda x: F.struct(
            (x["at"] + F.length(x["left"])).alias("start"), (x["at"] + F.length(x["left"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"),
            F.right(x["left"], F.lit(CONTEXT)).alias("left"), F.left(x["right"], F.lit(CONTEXT)).alias("right"),
        ),
    )


_NONE = "cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, at(i)).otherwise(2 * at(i) - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(IP_VALID)
    n = F.length(_digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(_digits(hit))).otherwise(False)


def _features(kind: str, x: Column) -> list[Column]:
    """Small integers: generator, form of the match, context."""
    hit, digits, flag = x["hit"], _digits(x["hit"]), lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return [
        F.lit(list(EXTRA).index(kind)), F.least(F.length(hit), F.lit(40)), F.least(F.length(digits), F.lit(24)),
        flag(F.length(F.regexp_replace(digits, "(.)(?=.*\\1)", "")) > 3), flag(hit.rlike("[.]")), flag(hit.rlike("[ (]")), flag(hit.rlike("[A-Z]{4}")),
        flag(hit.rlike("[0-9][A-Za-z]|[a-z][0-9]")), flag(x["left"].rlike(FOR)), flag(F.concat(x["left"], hit).rlike(AGAINST)), flag(hit.rlike(FOR)), flag(x["right"].rlike("^[,.]|^$")),
    ]


N_FEATURES = 12
Tree = tuple[int, int, tuple, tuple]


def _best_split(x: np.ndarray, g: np.ndarray, w: np.ndarray, cuts: list[tuple[int, int]]) -> tuple[int, int]:
    def gain(f: int, c: int) -> float:
        low = x[:, f] <= c
        return sum((g[m].sum() ** 2) / (w[m].sum() + 1.0) for m in (low, ~low) if m.any())

    return max(cuts, key=lambda fc: gain(*fc))


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray, trees: int = TREES, rate: float = RATE) -> list[Tree]:
    """Gradient boosting of depth-two trees on the log odds, for distinct rows of features with their counts."""
    cuts = [(f, int(c)) for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1]]
    score = np.zeros(len(x))
    out: list[Tree] = []
    for _ in range(trees if cuts else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        top = _best_split(x, g, h, cuts)
        sides = []
        for side in (x[:, top[0]] <= top[1], x[:, top[0]] > top[1]):
            f, c = _best_split(x[side], g[side], h[side], cuts)
            leaves = []
            for m in (side & (x[:, f] <= c), side & (x[:, f] > c)):
                leaf = float(rate * g[m].sum() / (h[m].sum() + 1.0)) if m.any() else 0.0
                score[m] += leaf
                leaves.append(round(leaf, 6))
            sides.append((f, c, *leaves))
        out.append((*top, *sides))
    return out


def tree_scores(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    score = np.zeros(len(x))
    for f, c, left, right in trees:
        for side, (f2, c2, a, b) in ((x[:, f] <= c, left), (x[:, f] > c, right)):
            score += np.where(side, np.where(x[:, f2] <= c2, a, b), 0.0)
    return score


def _score(trees: list[Tree], features: str) -> str:
    """SQL for the sum of the trees over an array of features; as text, which takes one call to the JVM and not thousands."""
    leaf = lambda s: f"if({features}[{s[0]}] <= {s[1]}, {s[2]!r}D, {s[3]!r}D)"
    return " + ".join(["0D", *(f"if({features}[{f}] <= {c}, {leaf(low)}, {leaf(high)})" for f, c, low, high in trees)])


def labelled_lines(spark: SparkSession, first: int, rows: int) -> DataFrame:
    """(id, kind, label, shape, text): lines made by rule, the same for the same id. Lines from FIT_ROWS on aren't fitted."""
    shapes = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(y).alias("label"), F.lit(t).alias("shape")) for k, y, t in SHAPES))
    lines = spark.range(first, first + rows).select("id", F.get(shapes, (F.col("id") % len(SHAPES)).cast("int")).alias("s")).select("id", "s.*")
    drawn = lambda i, n: F.pmod(F.xxhash64("id", i), F.lit(n)).cast("int")
    letters, capitals = F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ")
    drawing = F.transform(F.split("shape", ""), lambda c, i: F.when(c == "#", drawn(i, 10).cast("string")).when(c == "@", F.substring(letters, drawn(i, 36) + 1, F.lit(1))).when(c == "^", F.substring(capitals, drawn(i, 24) + 1, F.lit(1))).otherwise(c))
    return lines.withColumn("text", F.array_join(drawing, ""))


_models: dict[tuple, tuple[list[Tree], dict[str, float]]] = {}


def fit(spark: SparkSession, precision: float = 0.95, rows: int = FIT_ROWS) -> tuple[list[Tree], dict[str, float]]:
    """Trees and each generator's threshold, from at most ``rows`` labelled lines; what reaches the driver is at most a row for each."""
    if (precision, rows) in _models:
        return _models[precision, rows]
    lines = labelled_lines(spark, 0, rows)
    lines = _with_spans(lines, F.col("text"), list(EXTRA))
    vector = lambda k: F.transform(f"_{k}", lambda x: F.array(*_features(k, x)))
    found = F.coalesce(*(F.when(F.col("kind") == k, vector(k)) for k in EXTRA), F.expr("cast(array() as array<array<int>>)"))
    counted = lines.select("label", (F.col("id") % (2 * len(SHAPES)) < len(SHAPES)).alias("fit"), F.explode(found).alias("v")).groupBy("fit", "v").agg(F.sum("label").alias("positive"), F.count(F.lit(1)).alias("total")).orderBy("fit", "v")
    got = counted.collect()  # bounded by rows
    part = lambda own: (np.array([r["v"] for r in got if r["fit"] == own]).reshape(-1, N_FEATURES), *(np.array([r[c] for r in got if r["fit"] == own], float) for c in ("positive", "total")))
    trees = boost(*part(True))
    x, positive, total = part(False)
    scores = tree_scores(trees, x)
    limits = {}
    for i, kind in enumerate(EXTRA):
        own = np.flatnonzero(x[:, 0] == i)
        order = own[np.argsort(-scores[own], kind="stable")]
        right = np.cumsum(positive[order]) / np.maximum(1, np.cumsum(total[order]))
        ends = [k for k in range(len(order)) if k + 1 == len(order) or scores[order[k]] != scores[order[k + 1]]]
        good = [k for k in ends if right[k] >= precision]
        if good:  # halfway to the next lower score
            last = scores[order[good[-1]]]
            limits[kind] = float(last + (scores[order[good[-1] + 1]] if good[-1] + 1 < len(order) else last - 1)) / 2
        else:
            limits[kind] = float("inf")
    _models[precision, rows] = trees, limits
    return trees, limits


def find_spans(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of structs (start, kind, end), kind an index into KINDS, in order of start, kind, end."""
    trees, limits = fit(docs.sparkSession, precision)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = _with_spans(docs, text, KINDS)
    none = F.expr(_NONE)
    empty = F.expr("cast(array() as array<struct<span: struct<start: bigint, kind: int, end: bigint>, score: double>>)")
    unrated = F.expr("cast(array() as array<struct<span: struct<start: bigint, kind: int, end: bigint>, v: array<int>>>)")

    def bare(kind: str, x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"))

    def sure(kind: str) -> Column:
        return F.coalesce(F.transform(F.filter(f"_{kind}", lambda x: _valid(kind, x["hit"])), lambda x: bare(kind, x)), none)

    def proposed(kind: str) -> Column:
        return F.coalesce(F.transform(f"_{kind}", lambda x: F.struct(bare(kind, x).alias("span"), F.array(*_features(kind, x)).alias("v"))), unrated)

    # Features are built once for each candidate, and one expression of the trees rates the candidates of all generators.
    found = found.withColumns({"base": F.sort_array(F.concat(*map(sure, BASE))), "_more": F.concat(*map(proposed, EXTRA))}).drop(*(f"_{k}" for k in KINDS))
    enough = "array(" + ", ".join(f"{limits[k]!r}D" if np.isfinite(limits[k]) else "double('infinity')" for k in EXTRA) + ")"
    rated = f"transform(_more, x -> named_struct('span', x.span, 'score', {_score(trees, 'x.v')}, 'least', {enough}[x.v[0]]))"
    found = found.withColumn("_more", F.when(F.size("_more") > 0, F.sort_array(F.expr(f"transform(filter({rated}, x -> x.score >= x.least), x -> named_struct('span', x.span, 'score', x.score))"))).otherwise(empty))
    found = _best_scored(_apart(found))
    return found.withColumn("spans", F.when(F.size("_more") > 0, F.sort_array(F.concat("base", F.transform("_more", lambda x: x["span"])))).otherwise(F.col("base"))).drop("_more")


# What is used in several places below is a column of its own, so that it is computed once.


def _apart(found: DataFrame) -> DataFrame:
    """Leaves in _more what overlaps no span of base: the furthest end of the spans that begin before one's end isn't beyond its start."""
    event = lambda key, end, x: F.struct(key.alias("key"), end.alias("end"), x.alias("x"))
    nothing = F.expr("cast(null as struct<span: struct<start: bigint, kind: int, end: bigint>, score: double>)")
    own = F.transform("_more", lambda x: event(x["span"]["end"], F.lit(-1).cast("long"), x))  # at equal keys before spans of base
    events = F.sort_array(F.concat(own, F.transform("base", lambda b: event(b["start"], b["end"], nothing))))
    some = (F.size("_more") > 0) & (F.size("base") > 0)
    found = found.withColumn("_e", F.when(some, events))
    found = _with_before(found, {"_m": F.transform("_e", lambda x: x["end"])}, _max)
    stay = F.filter(F.arrays_zip(F.col("_e").alias("e"), F.col("_m").alias("m")), lambda x: (x["e"]["end"] < 0) & (x["m"] <= x["e"]["x"]["span"]["start"]))
    return found.withColumn("_more", F.when(F.col("_e").isNotNull(), F.sort_array(F.transform(stay, lambda x: x["e"]["x"]))).otherwise(F.col("_more"))).drop("_e", "_m")


def _best_scored(found: DataFrame) -> DataFrame:
    """Leaves in _more (sorted) what no better scored one overlaps; each is compared with the chain of overlapping ones it stands in."""
    found = _with_before(found, {"_m": F.when(F.size("_more") > 1, F.transform("_more", lambda x: x["span"]["end"]))}, _max)
    heads = F.transform(F.arrays_zip(F.col("_more").alias("x"), F.col("_m").alias("m")), lambda y, i: F.when(y["x"]["span"]["start"] >= y["m"], i + 1))
    found = found.withColumn("_h", F.when(F.col("_m").isNotNull(), F.filter(heads, lambda i: i.isNotNull())))
    ends = F.concat(F.slice("_h", F.lit(2), F.size("_h")), F.array(F.size("_more") + 1))
    chains = F.transform(F.arrays_zip(F.col("_h").alias("h"), ends.alias("e")), lambda y: F.slice("_more", y["h"], y["e"] - y["h"]))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda x, y: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["span"] < x["span"]))
    best = F.flatten(F.transform(chains, lambda c: F.when(F.size(c) == 1, c).otherwise(F.filter(c, lambda x: ~F.exists(c, lambda y: meet(x["span"], y["span"]) & better(x, y))))))
    return found.withColumn("_more", F.when(F.col("_h").isNotNull(), best).otherwise(F.col("_more"))).drop("_m", "_h")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """Per row of docs: counts of base spans, the digest of their list, the list of all spans and their number."""
    found = find_spans(take_columns(docs, "doc_id", "text"), precision)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, a span that begins within another only from that one's end; n_chars follows."""
    own = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)), docs["text"].alias("text"))
    found = find_spans(own, precision)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # at: how far the text is written when a span's turn comes; a span within another is dropped.
    found = _with_before(found, {"_at": F.transform("spans", lambda x: x["end"])}, _max)
    told = F.arrays_zip(F.col("_at").alias("at"), F.col("spans").alias("x"))
    told = F.transform(F.filter(told, lambda y: y["x"]["end"] > y["at"]), lambda y: F.struct(y["at"].alias("at"), F.greatest(y["at"], y["x"]["start"]).alias("start"), y["x"]["end"].alias("end"), F.get(names, y["x"]["kind"]).alias("name")))
    found = found.withColumn("_told", F.when(F.size("spans") > 0, told))
    part = lambda of, start, end: F.substring(of, (start + 1).cast("int"), (end - start).cast("int"))
    blocks = F.transform(F.sequence(F.lit(1), F.size("_told"), F.lit(BLOCK)), lambda i: F.slice("_told", i, F.lit(BLOCK)))
    # Each block of spans is cut from its own stretch of the text: finding a code point takes time by its place.
    blocks = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.get(b, F.lit(0))["at"].alias("from"), part("text", F.get(b, F.lit(0))["at"], F.element_at(b, -1)["end"]).alias("own")))
    cut = F.transform(blocks, lambda y: F.array_join(F.transform(y["b"], lambda x: F.concat(part(y["own"], x["at"] - y["from"], x["start"] - y["from"]), x["name"])), ""))
    done = F.concat(F.array_join(cut, ""), F.substring("text", (F.element_at("_told", -1)["end"] + 1).cast("int"), F.length("text")))
    text = F.when(F.size("spans") > 0, done).otherwise(F.col("text"))
    out = found.select(*((text if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
    # In a projection of its own: beside the lambdas of text, a second copy of them gives other lengths.
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
