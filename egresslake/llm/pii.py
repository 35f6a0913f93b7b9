r"""Operator 10: personal data by candidate gradient boosting.

1. High-recall generators propose overlapping spans: address-like, number-like, dotted.
2. A candidate is described by format and context features with few values each (digit count,
   plus sign, separators, brackets, checksum, words in front, what touches it), packed into one cell number.
   There are at most CELLS cells, whatever the corpus, so counts per cell are the whole training
   set: no row is sampled. The label of a candidate is whether a checked base pattern (checksum,
   value ranges, digit counts) matches exactly there.
3. The driver boosts regression trees (logistic loss, Newton leaves) on the cells, weighted by count, of the
   documents whose crc32(id) mod 5 is not 0.
4. The threshold of each generator is calibrated on the other documents' cells: the lowest score at which
   at least PRECISION of the candidates are labelled. Candidates at or over it are
   redactions besides the base spans, which always stay.

Main path: DataFrame functions; the driver's part sees cells only.

Defined results: a null text counts as empty; rows that repeat are handled alike; without candidates
of both labels only base spans are found; an empty table gives an empty result; further
columns are ignored. Places are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import fold, stored
from egresslake.llm.spans import SPAN, by_kind, counted, joined, matches

# The base patterns. Runs are matched possessively and only from their start (or where the match
# before has ended), which finds the same spans in linear time.
_MAIL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators: number, kind of the spans they add, pattern, base kind that labels them.
GENERATORS = (
    (0, "email_like", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++(?:\x20?\.\x20?[A-Za-z0-9-]++)*+", "email"),
    (1, "dotted_like", r"(?:\G|(?<![0-9]))[0-9]++(?:[.:-][0-9]++){3,7}+", "ip"),
    (2, "card_like", r"(?:\G|(?<![0-9]))[0-9](?:[\x20.-]?+[0-9]){11,22}+", "card"),
    (3, "phone_like", r"(?:\G|(?<![0-9+]))[+(]?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,17}+", "phone"),
)
#: Feature name and number of its values; their product is CELLS.
FEATURES = (("generator", 4), ("digits", 8), ("plus", 2), ("separators", 4), ("bracket", 2), ("luhn", 2), ("context", 5), ("touches", 3), ("octets", 2))
CELLS = int(np.prod([n for _, n in FEATURES]))
CONTEXT_CHARS = 24
PRECISION = 0.9
TREES, DEPTH, RATE, LEAST_WEIGHT = 24, 3, 0.3, 1.0


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for the empty string."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.when(F.length(number) > 0, F.aggregate(places, F.lit(0), add) % 10 == 0).otherwise(False)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def base_spans(text: Column) -> Column:
    """Checked base spans of all kinds."""
    card = F.filter(matches(text, "card", 2, CARD), lambda s: F.length(digits(s["found"])).between(16, 19))
    return F.concat(
        matches(text, "email", 0, EMAIL),
        F.filter(matches(text, "ip", 1, IP), lambda s: s["found"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        F.filter(card, lambda s: luhn(digits(s["found"]))),
        F.filter(matches(text, "phone", 3, PHONE), lambda s: F.length(digits(s["found"])).between(8, 15)),
    )


def bucket(n: Column, cuts: tuple[int, ...]) -> Column:
    out = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        out = F.when(n < c, i).otherwise(out)
    return out


def cell(text: Column, s: Column, generator: int) -> Column:
    """The number of a candidate's feature cell."""
    found, number = s["found"], digits(s["found"])
    n = F.length(number)
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT_CHARS), F.least(s["start"], F.lit(CONTEXT_CHARS))))
    word = F.when(before.rlike(r"(?:phone|mobile|call|fax|tel\b|tel[.:])"), 1).when(before.rlike(r"(?:mail|contact|write)"), 2)
    word = word.when(before.rlike(r"(?:card|visa|account|iban|payment)"), 3).when(before.rlike(r"(?:\bip\b|host|addr|server)"), 4).otherwise(0)
    left = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
    right = F.substring(text, s["end"] + 1, F.lit(1))
    touch = F.when(left.rlike(r"[\p{L}\p{N}_]"), 1).when(right.rlike(r"[\p{L}\p{N}_]"), 2).otherwise(0)
    kinds = F.length(F.regexp_replace(found, r"[^\x20.:-]", ""))
    one = F.length(F.regexp_replace(found, r"[^.]", ""))
    separators = F.when(kinds == 0, 0).when(one == kinds, 1).when(one == 0, 2).otherwise(3)
    values = {
        "generator": F.lit(generator), "digits": bucket(n, (1, 7, 8, 10, 12, 16, 20)), "plus": found.startswith("+").cast("int"), "separators": separators,
        "bracket": F.contains(found, F.lit("(")).cast("int"), "luhn": F.when(n.between(12, 23), luhn(number)).otherwise(False).cast("int"),
        "context": word, "touches": touch, "octets": found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$").cast("int"),
    }
    out = F.lit(0)
    for name, size in FEATURES:
        out = out * size + values[name]
    return out


def candidates(text: Column, base: Column) -> Column:
    """Spans of all generators, with feature cell and label."""
    def described(number: int, label: str):
        return lambda s: F.struct(
            *[s[f] for f in ("kind", "rank", "start", "end", "found", "part")],
            cell(text, s, number).alias("cell"),
            F.exists(base, lambda b: (b["kind"] == label) & (b["start"] == s["start"]) & (b["end"] == s["end"])).alias("label"),
        )

    return F.concat(*[F.transform(matches(text, kind, len(KINDS) + n, pattern), described(n, label)) for n, kind, pattern, label in GENERATORS])


@dataclass
class Tree:
    """A split on feature <= cut, or a leaf."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def on(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.on(x), self.high.on(x))

    def column(self, values: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(values[self.feature] <= self.cut, self.low.column(values)).otherwise(self.high.column(values))


def unpacked(cells: np.ndarray) -> np.ndarray:
    out = np.empty((len(cells), len(FEATURES)), dtype=np.int64)
    for i in range(len(FEATURES) - 1, -1, -1):
        out[:, i] = cells % FEATURES[i][1]
        cells = cells // FEATURES[i][1]
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """Tree on gradients g and Hessians h; leaves take a Newton step."""
    total_g, total_h = g.sum(), h.sum()
    leaf = Tree(value=float(RATE * total_g / (total_h + 1.0)))
    best = (1e-6, None)
    for f, (_, size) in enumerate(FEATURES) if depth else []:
        gs, hs = (np.cumsum(np.bincount(x[:, f], v, size))[:-1] for v in (g, h))
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(hs < 1e-3) | (total_h - hs < 1e-3)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    low = x[:, f] <= cut
    return Tree(feature=f, cut=cut, low=grow(x[low], g[low], h[low], depth - 1), high=grow(x[~low], g[~low], h[~low], depth - 1))


def boosted(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, list[Tree]]:
    start = float(np.log((yes.sum() + 0.5) / (no.sum() + 0.5)))
    z, trees = np.full(len(x), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(x, yes - (yes + no) * p, (yes + no) * p * (1 - p), DEPTH))
        z = z + trees[-1].on(x)
    return start, trees


def calibrated(z: np.ndarray, yes: np.ndarray, no: np.ndarray, generator: np.ndarray) -> list[float]:
    """Per generator, the lowest score from which on the labelled share is at least PRECISION; else infinity."""
    out = []
    for number, *_ in GENERATORS:
        mine = np.flatnonzero(generator == number)
        mine = mine[np.argsort(-z[mine], kind="stable")]
        a, b = np.cumsum(yes[mine]), np.cumsum(no[mine])
        ends = np.flatnonzero(np.diff(z[mine], append=-np.inf) != 0) if len(mine) else np.empty(0, int)
        good = [i for i in ends if a[i] >= LEAST_WEIGHT and a[i] >= PRECISION * (a[i] + b[i])]
        out.append(float(z[mine[good[-1]]]) - 1e-9 if good else float("inf"))
    return out


def redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base (checked spans), added (candidates that the model selects)."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    digit = F.col("txt").rlike("[0-9]") | F.col("txt").rlike(r"@|\(at\)|\[at\]")
    d = d.select("id", F.when(digit, F.col("txt")).otherwise("").alias("txt"))
    d = d.withColumn("base", base_spans(F.col("txt")))
    rows = stored(d.select("id", "base", candidates(F.col("txt"), F.col("base")).alias("more")), "candidates")
    each = rows.select((fold(F.col("id")) == 0).alias("held"), F.explode("more").alias("c")).groupBy("held", F.col("c.cell").alias("cell"))
    counts = each.agg(F.sum(F.col("c.label").cast("long")).alias("yes"), F.count(F.lit(1)).alias("rows")).collect()  # at most 2 x CELLS rows
    none = F.array().cast(SPAN)
    learn = [r for r in counts if not r["held"]]
    check = [r for r in counts if r["held"]] or learn
    added = none
    if learn and 0 < sum(r["yes"] for r in learn) < sum(r["rows"] for r in learn):
        def arrays(rs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rs = sorted(rs, key=lambda r: r["cell"])
            yes = np.array([r["yes"] for r in rs], dtype=float)
            return unpacked(np.array([r["cell"] for r in rs], dtype=np.int64)), yes, np.array([r["rows"] for r in rs], dtype=float) - yes

        x, yes, no = arrays(learn)
        start, trees = boosted(x, yes, no)
        cx, cyes, cno = arrays(check)
        cuts = calibrated(start + sum(t.on(cx) for t in trees), cyes, cno, cx[:, 0])

        def chosen(c: Column) -> Column:
            values, rest = [], c["cell"]
            for _, size in reversed(FEATURES):
                values.insert(0, rest % size)
                rest = F.floor(rest / size)
            z = F.lit(start)
            for t in trees:
                z = z + t.column(values)
            cut = F.element_at(F.array(*[F.lit(v) for v in cuts]), (c["rank"] - len(KINDS) + 1).cast("int"))
            return (z >= cut) & ~c["label"]

        added = F.transform(F.filter("more", chosen), lambda c: F.struct(*[c[f] for f in ("kind", "rank", "start", "end", "found", "part")])).cast(SPAN)
    return rows.select(F.col("id").alias(id_col), by_kind(F.col("base")).alias("base"), by_kind(added).alias("added"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Query: counts and digest of the base kinds, and all spans, of every document."""
    d = redactions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select(
        "doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"),
    )
