"""Secrets in texts: fixed patterns, and character Markov models of random strings.

Only built-in SQL functions run on the data. Four kinds of spans are found:

``assign``, ``access``, ``hex``
    matches of the patterns below, leftmost and without overlaps within a kind; a match whose
    counted part is too short is dropped after matching.
``random``
    tokens of ``TOKEN`` that hold a letter, a digit and ``VARIED`` different characters, overlap no
    span above, and are at least ``ODDS`` (natural logarithm) likelier under a first-order Markov
    chain of some kind of random strings than under one of ordinary identifiers.

Spans are in code points, the end exclusive. The chains are trained from labelled samples; what
comes to the driver are at most 128 * 128 counts of character pairs for each label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX_LEAST = 24
#: The runs of [0-9a-f] that are long enough; a run cannot begin inside a longer one.
HEX = rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}+"
KINDS = ("assign", "access", "hex", "random")

_CLASS = "A-Za-z0-9+/_=-"
TOKEN_LEAST = 20
TOKEN = rf"(?<![{_CLASS}])[{_CLASS}]{{{TOKEN_LEAST},}}+"
#: Tokens from which the chain of ordinary identifiers is learned.
WORD = rf"(?<![{_CLASS}])[{_CLASS}]{{6,}}+"
#: One random token among about a million ordinary ones.
ODDS = math.log(1e6)
#: Different characters that a random string has at least.
VARIED = 8
#: Weight of a character's overall frequency against its counts after another character.
SMOOTHING = 4.0
#: Documents whose words are samples of ordinary identifiers, and so many random strings a kind.
SAMPLE = 500
REDACTED = "[redacted]"

#: Values of one array that are folded at a time.
_PIECE = 128


@dataclass(frozen=True)
class Chains:
    """ratios[128 * a + b]: log-likelihood ratio of the character b after a, random to ordinary.

    There is one row of ratios for each kind of random strings.
    """

    ratios: tuple[tuple[float, ...], ...]

    def columns(self) -> list[Column]:
        texts = (",".join(f"{r:.4f}" for r in row) for row in self.ratios)
        return [F.split(F.lit(t), ",").cast("array<double>") for t in texts]


def _pairs(token: Column) -> Column:
    """128 * a + b for all neighbouring characters a, b of an ASCII token."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: c > 0)
    return F.transform(
        F.arrays_zip(
            F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))).alias("a"),
            F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))).alias("b"),
        ),
        lambda p: p["a"] * 128 + p["b"],
    )


def train(samples: DataFrame) -> Chains:
    """Chains from ``samples``: a token in ``token``, and its kind in ``label``.

    The label is ``ordinary``, or else names a kind of random strings: each has a chain of its
    own, since a mixture of alphabets would suit none of them. Null tokens, null labels and
    characters other than letters, digits and ``+/_=-`` are ignored. Counts are smoothed towards
    how often a character occurs at all.
    """
    counts = (
        samples.filter("token is not null and label is not null")
        .select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
        .filter((F.col("pair") >= 0) & (F.col("pair") < 128 * 128))
        .groupBy("label", "pair").count().collect()
    )
    alphabet = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]

    def chain(label: str) -> dict[int, float]:
        table = {r.pair: r["count"] for r in counts if r.label == label}
        after = {b: sum(table.get(128 * a + b, 0) for a in alphabet) for b in alphabet}
        whole = sum(after.values())
        share = {b: (after[b] + 0.5) / (whole + 0.5 * len(alphabet)) for b in alphabet}
        out = {}
        for a in alphabet:
            row = sum(table.get(128 * a + b, 0) for b in alphabet)
            for b in alphabet:
                n = table.get(128 * a + b, 0)
                out[128 * a + b] = math.log((n + SMOOTHING * share[b]) / (row + SMOOTHING))
        return out

    ordinary = chain("ordinary")
    kinds = sorted({r.label for r in counts} - {"ordinary"})
    found = [chain(k) for k in kinds]
    return Chains(
        tuple(
            tuple(one[p] - ordinary[p] if p in one else 0.0 for p in range(128 * 128))
            for one in found
        )
    )


def labelled_samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Samples (token, label): words of ``sample`` documents without base matches, and digests.

    The random strings are digests of the same documents' ids in hexadecimal (``hex``), base 64
    (``wide``) and upper case letters with digits (``upper``). Documents with a null id are not
    sampled.
    """
    ids = (
        docs.filter("doc_id is not null").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    text = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    # at most `sample` ids
    words = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(
        F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("token"),
        F.lit("ordinary").alias("label"),
    )
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    wide = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    upper = F.regexp_replace(F.upper(wide), r"[^A-Z0-9]", "")
    made = ids.select(F.explode(F.create_map(
        F.lit("hex"), digest, F.lit("wide"), wide, F.lit("upper"), upper
    )).alias("label", "token"))
    return words.union(made.select("token", "label"))


def _scan(values: Column, zero: Column, op) -> Column:
    """For each value what ``op``, which is associative, makes of all values before it.

    By pieces: folding within each, then over the pieces' totals, so that long arrays cost little
    more than their length.
    """
    def before(piece: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            piece, start,
            lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )

    def whole(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(held) / _PIECE) - 1, F.lit(0)).cast("int"))
        pieces = F.transform(starts, lambda k: F.slice(held, k * _PIECE + 1, _PIECE))
        totals = F.transform(pieces, lambda p: F.aggregate(p, zero, op))
        return F.flatten(F.zip_with(
            F.transform(pieces, before), before(totals), lambda piece, base: F.transform(piece, lambda x: op(base, x))
        ))

    # as the variable of a function the values are computed once, and not for every piece
    return _let(values, whole)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _running_total(lengths: Column) -> Column:
    """The sum of all lengths before each one."""
    return _scan(lengths, F.lit(0), lambda a, b: a + b)


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _find(df: DataFrame, kind: str, text: str, pattern: str, keep) -> DataFrame:
    """``df`` with the spans of one kind as ``_kind``: (start, rank, end, kind, value)."""
    found, all_spans = f"_{kind}_hits", f"_{kind}_all"
    none = F.array().cast("array<string>")
    guard = {"assign": F.col(text).rlike("[:=]"), "access": F.col(text).contains("AKIA")}.get(kind, F.lit(True))
    df = df.withColumn(found, F.coalesce(F.when(guard, _hits(F.col(text), pattern)), none))
    some = F.size(found) > 0
    between = F.split(F.col(text), pattern, -1)
    lengths = F.zip_with(
        F.transform(F.slice(between, 1, F.size(found)), lambda g: F.length(g)),
        F.concat(F.array(F.lit(0)), F.transform(F.slice(found, 1, F.size(found) - 1), lambda h: F.length(h))),
        lambda gap, before: gap + before,
    )
    df = df.withColumn(f"_{kind}_lengths", F.when(some, lengths))
    starts = F.zip_with(
        _running_total(F.col(f"_{kind}_lengths")), F.col(f"_{kind}_lengths"), lambda s, x: s + x
    )
    spans = F.zip_with(
        starts,
        F.col(found),
        lambda start, value: F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (start + F.length(value)).alias("end"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    df = df.withColumn(all_spans, F.when(some, spans).otherwise(empty))
    return df.withColumn(f"_{kind}", F.filter(all_spans, keep)).drop(found, all_spans, f"_{kind}_lengths")


def _long_assignment(value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 2)) >= ASSIGN_LEAST


def _adding(ratios: Column):
    return lambda total, pair: total + F.element_at(ratios, pair + 1)


def _looks_random(token: Column, ratios: list[Column]) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    varied = F.size(F.array_distinct(F.split(token, ""))) >= VARIED
    scores = [
        F.aggregate(_pairs(token), F.lit(0.0), _adding(ratio)) for ratio in ratios
    ]
    best = F.greatest(F.lit(-math.inf), *scores) if scores else F.lit(-math.inf)
    return F.when(mixed & varied, best >= ODDS).otherwise(False)


def _apart(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span, from one pass over both by start."""
    last = F.lit(2**31 - 1)
    token = F.lit(KINDS[-1])

    def placed(events: Column) -> Column:
        ends = F.transform(events, lambda e: F.when(e["kind"] == token, 0).otherwise(e["end"]))
        starts = F.reverse(F.transform(events, lambda e: F.when(e["kind"] == token, last).otherwise(e["start"])))
        upto = _scan(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        after = F.reverse(_scan(starts, last, lambda a, b: F.least(a, b)))
        return F.zip_with(
            F.zip_with(events, upto, lambda e, end: F.struct(e.alias("span"), end.alias("end"))), after,
            lambda p, start: F.struct(p["span"].alias("span"), p["end"].alias("end"), start.alias("start")),
        )

    free = F.filter(
        _let(F.sort_array(F.concat(base, tokens)), placed),
        lambda p: (p["span"]["kind"] == token) & (p["end"] <= p["span"]["start"]) & (p["start"] >= p["span"]["end"]),
    )
    return F.transform(free, lambda p: p["span"])


def scan(docs: DataFrame, chains: Chains, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the spans of each text as ``out``: an array of (start, rank, end, kind, value).

    Spans are ordered by start, then by kind as in ``KINDS``. A null or empty text has none.
    """
    if out in docs.columns:
        raise ValueError(f"the table already has a column {out}")
    kept = list(docs.columns)
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = _find(df, "assign", "_text", ASSIGN, lambda s: _long_assignment(s["value"]))
    df = _find(df, "access", "_text", ACCESS, lambda s: F.length(s["value"]) >= ACCESS_LEAST)
    df = _find(df, "hex", "_text", HEX, lambda s: F.lit(True))
    df = df.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    ratios = chains.columns()
    df = _find(df, "random", "_text", TOKEN, lambda s: F.lit(True))
    df = df.withColumn("_free", F.when(F.size("_base") == 0, F.col("_random")).otherwise(_apart(F.col("_base"), F.col("_random"))))
    df = df.withColumn("_random", F.filter("_free", lambda s: _looks_random(s["value"], ratios)))
    return df.select(*kept, F.sort_array(F.concat("_base", "_random")).alias(out))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "random")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _replacing(test):
    return lambda hit: F.when(test(hit), F.lit(REDACTED)).otherwise(hit)


def redact(docs: DataFrame, chains: Chains, text: str = "text") -> DataFrame:
    """``docs`` whose texts have every secret replaced by ``REDACTED``; other texts are unchanged.

    Kinds are replaced one after another, so a span that an earlier kind took is gone.
    """
    ratios = chains.columns()
    tests = (
        (ASSIGN, _long_assignment),
        (ACCESS, lambda v: F.length(v) >= ACCESS_LEAST),
        (HEX, lambda v: F.lit(True)),
        (TOKEN, lambda v: _looks_random(v, ratios)),
    )
    guards = (F.col(text).rlike("[:=]"), F.col(text).contains("AKIA"), F.lit(True), F.lit(True))
    df, columns = docs, docs.columns
    for (pattern, test), guard in zip(tests, guards, strict=True):
        df = df.withColumn("_hits", F.when(guard, _hits(F.col(text), pattern)))
        replaced = F.transform("_hits", _replacing(test))
        changed = F.array_join(
            F.zip_with(F.split(F.col(text), pattern, -1), replaced,
                       lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))),
            "",
        )
        df = df.withColumn(text, F.when(F.size("_hits") > 0, changed).otherwise(F.col(text)))
    return df.select(*columns)
