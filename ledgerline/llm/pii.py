"""Personal data: fixed patterns, and contextual extraction bootstrapped from them, in SQL functions only.

The fixed patterns give seed entities. Words around identifier-like tokens form lexical patterns; the graph of
patterns and instances is scored in rounds (a pattern by the share of its instances that are believed, an instance by
the patterns that hold it), and instances believed at the end are found wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_BLANK = r"\x20\x09-\x0D"
_LOCAL = "A-Za-z0-9._%+-"
# The same matches as the plain patterns. Look-behinds and possessive repeats only keep long runs linear: a match that
# fails at the start of a run fails at every later start in it, and \G lets a match begin where the last one ended.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = (
    rf"\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){{11,}}+|(?<![^{_BLANK}])[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+")
SPAN = "array<struct<start:int,end:int,kind:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return n.between(12, 19) & F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(F.lit(False))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(text: Column, pattern: str, keep, row) -> Column:
    """Array of ``row(start, end, match, before, after)`` for the matches with ``keep(match)``, by one pass over the pieces."""
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("matches"))

    def parts(x: Column) -> Column:
        return F.transform(x["matches"], lambda m, i: F.struct(
            m.alias("m"), F.element_at(x["pieces"], i + 1).alias("before"), F.element_at(x["pieces"], i + 2).alias("after")))

    def step(state: Column, x: Column) -> Column:
        start = state["pos"] + F.length(x["before"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.when(keep(x["m"]), F.array_append(state["out"], row(start, end, x["m"], x["before"], x["after"])))
                        .otherwise(state["out"]).alias("out"))

    none = F.slice(F.array(row(F.lit(0), F.lit(0), F.lit(""), F.lit(""), F.lit(""))), 1, 0)
    return F.aggregate(_once(both, parts), F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """Spans (start, end, kind) of the fixed patterns in code points, by start and then in the order of ``KINDS``."""
    found = []
    for kind in KINDS:
        spans = _fold(text, PATTERNS[kind], lambda m, k=kind: _valid(k, m), lambda s, e, m, b, a, k=kind: F.struct(
            s.alias("start"), F.lit(KINDS.index(k)).alias("rank"), e.alias("end"), F.lit(k).alias("kind")))
        gate = text.contains(GATES[kind]) if GATES[kind] else text.rlike("[0-9](?:[\\x20-]?[0-9]){11}")
        if kind == "ip":
            gate = text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
        found.append(F.when(gate, spans).otherwise(F.slice(F.array(F.struct(
            F.lit(0).alias("start"), F.lit(0).alias("rank"), F.lit(0).alias("end"), F.lit("").alias("kind"))), 1, 0)))
    return F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _words(piece: Column) -> Column:
    return F.filter(F.split(F.lower(piece), f"[{_BLANK}]+"), lambda w: w != "")


def _candidates(text: Column) -> Column:
    """Identifier-like tokens with up to two words on either side; long pieces are cut to the part next to the token."""
    def row(start: Column, end: Column, match: Column, before: Column, after: Column) -> Column:
        left = F.slice(F.reverse(_words(F.substring(before, -200, 200))), 1, 2)
        right = F.slice(_words(F.substring(after, 1, 200)), 1, 2)
        token = F.regexp_replace(F.lower(match), r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
        return F.struct(start.alias("start"), end.alias("end"), token.alias("token"), left.alias("left"), right.alias("right"))

    keep = lambda m: (F.length(m) >= 6) & (F.length(_digits(m)) >= 3) | m.contains("@")
    spans = _fold(text, CANDIDATE, keep, row)
    return F.when(text.rlike("[0-9@]"), spans).otherwise(F.slice(F.array(row(F.lit(0), F.lit(0), F.lit(""), F.lit(""), F.lit(""))), 1, 0))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, base and candidates for every row; written below the shared folder, for several steps read it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("base", base_spans(F.col("text")))
    found = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", _candidates(F.col("text")).alias("seen"))
    kind = lambda c: F.element_at(F.transform(
        F.filter("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])), lambda b: b["kind"]), 1)
    marked = F.transform("seen", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), c["left"].alias("left"), c["right"].alias("right"),
        F.when(F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])), kind(c)).alias("kind")))
    return materialise(found.select("doc_id", "text_hash", "base", marked.alias("candidates")), "pii")


def _patterns(c: Column) -> Column:
    """Lexical patterns of an occurrence: two words before, two after, one on either side."""
    left, right = c["left"], c["right"]
    two = lambda side, words: F.when(F.size(words) == 2, F.concat(F.lit(side), F.concat_ws(" ", words)))
    around = F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(F.lit("around "), F.try_element_at(left, F.lit(1)), F.lit(" _ "), F.try_element_at(right, F.lit(1))))
    return F.filter(F.array(two("before ", left), two("after ", right), around), lambda p: p.isNotNull())


def score_instances(found: DataFrame, rounds: int = 100, min_seeds: int = 3, floor: float = 0.3, min_score: float = 0.8) -> DataFrame:
    """(token, kind, score) of the instances that are not seeds, once the rounds over the pattern graph have settled.

    A pattern's confidence for a kind is the believed part of its distinct instances, out of all of them and one
    more; it counts once ``min_seeds`` different seeds or instances of at least ``min_score`` support it and it reaches
    ``floor``. An instance's score is one less the product of the doubts of its patterns. So what a round finds
    promotes patterns for the next. Scores only rise, and rounds end when no pattern is added and no score rises by a
    hundredth; raises after ``rounds`` of them, rather than returning a part. Edges are distinct (pattern, token)
    pairs, so copies of a document add no belief, and every step is an aggregate with map-side sums.
    """
    occurrences = found.select(F.explode("candidates").alias("c")).select(
        F.col("c.token").alias("token"), F.col("c.kind").alias("kind"), F.explode(_patterns(F.col("c"))).alias("pattern")).where("token <> ''")
    edges = materialise(occurrences.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = materialise(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds), "pii-sizes")
    open_edges = materialise(edges.where("kind IS NULL").select("pattern", "token").join(sizes, "pattern", "left_semi"), "pii-open")
    seeds = materialise(edges.where("kind IS NOT NULL").select("pattern", "token", "kind", F.lit(1.0).alias("belief")), "pii-seeds")
    believed, reached = seeds, None
    for _ in range(rounds):
        support = believed.where(F.col("belief") >= min_score).groupBy("pattern").agg(F.countDistinct("token").alias("support")).where(F.col("support") >= min_seeds)
        confidence = believed.groupBy("pattern", "kind").agg(F.sum("belief").alias("s")).join(support, "pattern").join(sizes, "pattern").select(
            "pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= floor)
        scores = materialise(open_edges.join(confidence, "pattern").groupBy("token", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"), F.count("*").alias("patterns")), "pii-scores")
        now = scores.agg(F.count("*"), F.coalesce(F.sum("patterns"), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("score") * 100)), F.lit(0))).first()
        if reached is not None and all(a <= b for a, b in zip(now, reached)):
            return scores.drop("patterns")
        believed, reached = seeds.union(open_edges.join(scores, "token").select("pattern", "token", "kind", F.col("score").alias("belief"))), now
    raise RuntimeError("the rounds did not settle")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = 0.8, rounds: int = 100) -> DataFrame:
    """doc_id, text_hash, ``base`` and ``spans`` (arrays of start, end, kind) for every row of ``docs``.

    ``spans`` has the base spans and those found by context, of kind ``ctx_`` and the kind of the patterns. Offsets
    are code points, ends exclusive. Null texts count as empty and have no spans; repeated rows stay rows; other
    columns are ignored; an empty table gives an empty result.
    """
    found = extract(docs, doc_id, text)
    best = score_instances(found, rounds, min_score=min_score).where(F.col("score") >= min_score).groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("as_kind"))
    unseen = found.select("doc_id", "text_hash", F.explode("candidates").alias("c")).where("c.kind IS NULL").select(
        "doc_id", "text_hash", F.col("c.token").alias("token"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))
    extra = unseen.join(best, "token").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(
        "start", "end", F.concat(F.lit("ctx_"), "as_kind").alias("kind"))).alias("more"))  # bounded by the tokens of one text
    extra = extra.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    joined = found.join(extra, (found["text_hash"] == extra["_hash"]) & found["doc_id"].eqNullSafe(extra["_id"]), "left")
    order = lambda s: F.struct(
        s["start"].alias("start"), F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]) + F.when(s["kind"].startswith("ctx_"), 9).otherwise(0), F.lit(9)).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.transform(F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(SPAN))), order)),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("doc_id", "text_hash", "base", every.alias("spans"))


def as_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    state = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    end = F.aggregate(spans, state, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["pos"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans in text replaced by [KIND].

    Null and empty texts, rows with null ids and repeated rows stay; other columns stay whatever their names; an empty
    table stays empty.
    """
    spans = find(docs).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("_spans")).where(F.size("_spans") > 0)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    # the row travels as one column, so its names clash with none here
    rows = docs.select("doc_id", F.xxhash64(text_or_empty("text")).alias("hash"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(spans, (rows["hash"] == spans["_hash"]) & rows["doc_id"].eqNullSafe(spans["_id"]), "left")
    text = F.col("row")["text"]
    clean = F.when(F.col("_spans").isNull(), text).otherwise(redacted(text, F.col("_spans")))
    return joined.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
