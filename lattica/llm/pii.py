"""Personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Four base expressions find the seed entities. The two whole words before an entity form a lexical pattern, and
so do the two after it. The bipartite graph of patterns and instances (seeds, and other tokens that hold digits)
is scored in rounds: a pattern's confidence is the score of the instances it stands beside over all places where
its words occur in the corpus; a seed's score is one, another instance's is its best pattern's confidence in the
round that finds it. A token beside which a confident pattern stands becomes an instance of the pattern's kind
wherever its value stands, and supports the patterns beside these places in the next round, until a round finds
none. A context reaches to the neighbouring matches of the expression that found the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Kinds in their order. The expressions are the contract's, written so that Java's engine scans each
#: character a bounded number of times: runs are possessive and start at a run's start or a match's end.
KINDS = ("email", "ip", "card", "phone")
_L = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){2}\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Other tokens that may be identifiers: five characters or more with a digit.
_TOKEN = r"(?<!\S)(?=\S{5})[^\s0-9]*+[0-9]\S*+"
#: Distinct instances that a pattern must stand beside, and the confidence that makes it extract.
MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.5
#: The texts, dealt into the last number of shares, are read up to each of these in turn.
SHARES = (1, 8, 64)
#: Patterns up to which they are broadcast (some tens of bytes each); more meet their places in a shuffle.
BROADCAST_ROWS = 50_000
#: Matches of a text whose places are added up together, so that work grows with the matches, not their square.
_BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        # a part's value without leading zeros, which may leave nothing
        value = lambda p: F.regexp_replace(p, "^0++", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(value(p)) < 4) & (F.concat(F.lit("0"), F.substring(value(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _blocks(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def _whole_words(gap: Column, head: Column, tail: Column) -> Column:
    """The words of the text between two matches without the pieces of the matches' own words."""
    g = F.lower(gap)
    g = F.when(head, g).otherwise(F.regexp_replace(g, r"^\S++", ""))
    g = F.when(tail, g).otherwise(F.regexp_replace(g, r"\S++$", ""))
    return F.filter(F.split(g, r"\s++"), lambda w: w != "")


def _left(gap: Column, first: Column) -> Column:
    return _let(_whole_words(gap, first, F.lit(False)), lambda w: F.when(F.size(w) >= 2, F.concat_ws(" ", F.slice(w, -2, 2))))


def _right(gap: Column, last: Column) -> Column:
    return _let(_whole_words(gap, F.lit(False), last), lambda w: F.when(F.size(w) >= 2, F.concat_ws(" ", F.slice(w, 1, 2))))


_MATCH = "array<struct<s:int,e:int,v:bigint,l:string,r:string>>"


def _found(text: Column, pattern: str, passes=lambda m: F.lit(True), trimmed=lambda m: m) -> Column:
    """Passing matches as structs: places in code points, a hash of the value, and the patterns on its left and right.

    The value is trimmed(match), from the match's start.
    """
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"))

    def placed(z: Column) -> Column:
        items = F.transform(z["ms"], lambda m, i: F.struct(i.alias("i"), F.length(F.get(z["gaps"], i)).alias("g"), F.length(m).alias("n")))
        none = F.array().cast("array<struct<i:int,s:int>>")

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            return F.struct((s + x["n"]).alias("at"), F.array_append(acc["out"], F.struct(x["i"].alias("i"), s.alias("s"))).alias("out"))

        local = F.transform(_blocks(items), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), step))

        def moved(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            heads = F.aggregate(parts, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(parts, heads, lambda p, h: F.transform(p["out"], lambda x: F.struct(x["i"].alias("i"), (x["s"] + h).alias("s")))))

        def told(x: Column) -> Column:
            i = x["i"]
            return _let(
                trimmed(F.get(z["ms"], i)),
                lambda m: F.struct(
                    x["s"].alias("s"), (x["s"] + F.length(m)).alias("e"), F.xxhash64(m).alias("v"),
                    _left(F.get(z["gaps"], i), i == 0).alias("l"), _right(F.get(z["gaps"], i + 1), i + 1 == F.size(z["ms"])).alias("r"),
                ),
            )

        return F.transform(F.filter(_let(local, moved), lambda x: passes(F.get(z["ms"], x["i"]))), told)

    return F.when(text.rlike(pattern), _let(both, placed)).otherwise(F.array()).cast(_MATCH)


def base_matches(text: Column) -> Column:
    """The base entities by kind (k, an index into KINDS), then start; see _found()."""

    def part(k: int, kind: str) -> Column:
        found = _found(text, PATTERNS[kind], lambda m: _passes(kind, m))
        spans = F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r")))
        has = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.lit(True)
        return F.when(has if kind == "email" else has & text.rlike("[0-9]"), spans).otherwise(F.array()).cast(_KINDED)

    return F.concat(*[part(k, kind) for k, kind in enumerate(KINDS)])


_KINDED = "array<struct<k:int,s:int,e:int,v:bigint,l:string,r:string>>"
_SPANS = "array<struct<k:int,s:int,e:int>>"


def base_spans(text: Column) -> Column:
    """array<struct<k:int, s:int, e:int>> of the base entities, by kind, then start."""
    return F.transform(base_matches(text), _span)


def _span(x: Column) -> Column:
    return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base entity, block by block of the tokens."""

    def free(b: Column) -> Column:
        near = F.filter(base, lambda x: (x["s"] < F.get(b, F.size(b) - 1)["e"]) & (F.get(b, F.lit(0))["s"] < x["e"]))
        return _let(near, lambda n: F.filter(b, lambda t: ~F.exists(n, lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"]))))

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), F.flatten(F.transform(_blocks(tokens), free))).otherwise(tokens)


def _bigrams(text: Column) -> Column:
    w = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _places(src: DataFrame, ready: DataFrame) -> DataFrame:
    """(p, places): how often the two words of the patterns of ready stand in the texts of src."""
    every = src.select(F.explode(_bigrams(F.col("text"))).alias("p"))
    return every.join(_few(ready.select("p").distinct()), "p", "left_semi").groupBy("p").agg(F.count("*").alias("places"))


def _patterns(inst: DataFrame, *cols: str) -> DataFrame:
    """A row for each pattern (side, p) of an instance."""
    both = F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("p")), F.struct(F.lit("r").alias("side"), F.col("r").alias("p")))
    return inst.select(*cols, F.inline(both)).where("p is not null")


def extract(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_key, base and spans (array<struct<k, s, e>>).

    Places are code points, the end exclusive; base lists the matches of the base expressions that pass
    their tests, spans these and what patterns discovered, by kind, then start. Null and empty texts have
    none; repeated rows give repeated results; a null doc_id stays null; other columns are ignored.
    text_key is a hash of the text that, with doc_id, finds a row's spans again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    tail = r"[.,;:!?)\]]++$"
    tokens = F.when(F.col("text").rlike("[0-9]"), _found(F.col("text"), _TOKEN, trimmed=lambda m: F.regexp_replace(m, tail, ""))).otherwise(F.array()).cast(_MATCH)
    found = src.select("doc_id", "text_key", F.struct(base_matches(F.col("text")).alias("base"), tokens.alias("tokens")).alias("all"))
    # tokens are set apart from base entities once both are known
    seen = cut(found.select("doc_id", "text_key", "all.base", "all.tokens"))
    seeds = seen.select("doc_id", "text_key", F.inline("base"))
    open_ = cut(seen.where("size(tokens) > 0").select("doc_id", "text_key", F.inline(_apart(F.col("tokens"), F.col("base")))))
    new, known = None, seeds.select("k", "v", "l", "r", F.lit(1.0).alias("score"))
    gained = None
    while True:
        support = _patterns(known, "k", "v", "score").groupBy("side", "p", "k").agg(F.count_distinct("v").alias("n"), F.sum("score").alias("hits")).where(f"n >= {MIN_SUPPORT}")
        if gained is not None:  # the others are as the last round judged them
            support = support.join(gained, ["side", "p"], "left_semi")
        ready = cut(support.join(_patterns(open_).distinct(), ["side", "p"], "left_semi"))
        if ready.isEmpty():
            break
        # a share of the texts tells a lower bound of the places, which rules most patterns out before the rest is read
        ready = ready.withColumn("places", F.lit(0).cast("long"))
        for lo, hi in zip((0, *SHARES), SHARES):
            part = src.where(F.pmod(F.xxhash64(F.lit("share"), "doc_id", "text_key"), F.lit(SHARES[-1])).between(lo, hi - 1))
            more = ready.join(_places(part, ready).withColumnRenamed("places", "more"), "p", "left")
            places = F.col("places") + F.coalesce("more", F.lit(0).cast("long"))
            ready = cut(more.select("side", "p", "k", "n", "hits", places.alias("places")).where(F.col("hits") >= MIN_CONFIDENCE * F.col("places")))
            if ready.isEmpty():
                break
        sure = ready
        confidence = F.least(F.lit(1.0), F.col("hits") / F.greatest("places", F.lit(1)))
        best = cut(sure.groupBy("side", "p").agg(F.max_by("k", F.struct(F.col("hits"), -F.col("k"))).alias("k"), F.max(confidence).alias("score")))
        # an instance is its value: its other places are its, too
        values = _patterns(open_, "v").join(_few(best), ["side", "p"]).groupBy("v").agg(F.max_by("k", F.struct(F.col("score"), -F.col("k"))).alias("k"), F.max("score").alias("score"))
        values = cut(values)
        more = cut(open_.join(_few(values), "v").select("doc_id", "text_key", "k", "s", "e", "v", "l", "r", "score"))
        if more.isEmpty():
            break
        new = more if new is None else new.union(more)
        known = cut(known.union(more.select("k", "v", "l", "r", "score")))
        gained = _patterns(more).distinct()
        open_ = cut(open_.join(_few(values.select("v")), "v", "left_anti"))
    base = seen.select("doc_id", "text_key", F.transform("base", _span).cast(_SPANS).alias("base"))
    if new is None:
        return base.withColumn("spans", F.col("base"))
    # copies of a row hold the same spans
    gathered = new.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("k", "s", "e")).alias("added"))
    gathered = gathered.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "added")
    joined = base.join(gathered, base["doc_id"].eqNullSafe(F.col("_d")) & (base["text_key"] == F.col("_t")), "left")
    return joined.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans, per row of docs; see extract()."""
    found = extract(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in square brackets; overlapping spans count as the first of them."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"]
        return F.when(x["s"] < at, acc).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], text.substr(at + 1, x["s"] - at), F.get(names, x["k"])).alias("out"))
        )

    whole = F.aggregate(order, start, step)
    return F.concat(whole["out"], text.substr(whole["at"] + 1, F.length(text)))


def mask(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text replaced by kinds; all rows and columns stay, n_chars (if any) follows the text."""
    spans = extract(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("spans").alias("_spans"))
    spans = spans.dropDuplicates(["_d", "_t"])
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    out = keyed.join(spans, keyed["doc_id"].eqNullSafe(F.col("_d")) & (keyed["_key"] == F.col("_t")), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("_spans")))
    cols = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    out = out.select(*cols)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
