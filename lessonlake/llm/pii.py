"""Personal data: base patterns plus bootstrapped contextual extraction, with DataFrame functions only.

Base spans come from four expressions with checks. They are also the seeds of the bootstrap: the
words around an entity are lexical patterns, and the identifier-like strings that stand in the same
contexts are instances. Spark scores the pattern-instance graph in rounds: a pattern is worth the
share of its distinct instances that are known, and instances of patterns with a high share become
known. What is known in the end is marked wherever a pattern's context or the instance itself occurs.

A text is cut into pieces at white space that no match can cross, so the work on a text grows with
its length: arrays are built piece by piece, and what compares spans with one another is a window.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.llm._shared import drop_table, materialize, packed

KINDS = ("email", "ip", "card", "phone")
#: The share of known instances a pattern needs, and how many of them.
CONFIDENCE = 0.6
SUPPORT = 3
#: Characters of a piece at least and around a match at first, matches of an array step, characters that are redacted at a time.
_PIECE, _NEAR, _STEP, _BLOCK = 1024, 128, 64, 1 << 15

# The contract's expressions. A look-behind keeps a match from starting inside a run that its first
# character class would have taken whole (\G lets it start where the last match ended), and loops
# that nothing follows are possessive: the matches are the same, in linear time.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: White space that ends a piece: it follows a word; the first kind of pieces is for matches inside words,
#: the second for cards and phones, none of which goes on over its cuts.
_CUTS = r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]", r"(?<=[^\x20\x09-\x0D])(?:[\x09-\x0D]|(?<=[^().0-9-])\x20|\x20(?![\x20().0-9-]))"
_PIECES = [rf"(?s).{{1,{_PIECE}}}+.*?(?:{cut}|\z)" for cut in _CUTS]
#: An identifier-like word: has a digit or an @; starts and ends with what such words hold.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_BARE = r"^[^0-9A-Za-z+]*([0-9A-Za-z+].*?)[^0-9A-Za-z]*$"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often and wherever ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _spots(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: code point start and end, and text, of all matches.

    The text between matches comes from a split at the same expression, so starts are sums of lengths:
    first over steps of ``_STEP`` matches, then inside each.
    """
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = _let(matches, lambda ms: F.arrays_zip(ms.alias("m"), F.transform(F.slice(between, F.lit(1), F.size(ms)), F.char_length).alias("gap")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    width = lambda x: x["gap"] + F.char_length(x["m"])

    def steps(ps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(ps), F.lit(_STEP))
        return F.when(F.size(ps) > 0, F.transform(firsts, lambda i: F.slice(ps, i, F.lit(_STEP)))).otherwise(F.slice(F.array(ps), 1, 0))

    def begin(acc: Column, step: Column) -> Column:
        end = acc["at"] + F.aggregate(step, F.lit(0), lambda n, x: n + width(x))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def spot(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = acc["at"] + width(x)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    def placed(found: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(found, empty, begin, lambda acc: acc["out"])
        inside = lambda step, at: F.aggregate(step, F.struct(at.alias("at"), none.alias("out")), spot, lambda acc: acc["out"])
        return F.flatten(F.zip_with(found, starts, inside))

    return _let(_let(pairs, steps), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _found(piece: Column, inside: Column) -> Column:
    """array<struct<k,s,e,m>> of a piece: emails, addresses and, with k null, identifier-like words where ``inside``; cards and phones elsewhere."""
    none = F.array().cast("array<struct<k:int,s:int,e:int,m:string>>")

    def of(k: int, kind: str, pattern: str, needle: str) -> Column:
        spots = F.filter(_spots(piece, pattern), lambda x: _valid(kind, x["m"]))
        kept = F.transform(spots, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
        return F.when(piece.contains(needle), kept).otherwise(none)

    def bare(x: Column) -> Column:
        def inner(m: Column) -> Column:
            start = x["s"] + F.instr(x["m"], m) - 1
            return F.struct(F.lit(None).cast("int").alias("k"), start.alias("s"), (start + F.char_length(m)).alias("e"), m.alias("m"))

        return _let(F.regexp_extract(x["m"], _BARE, 1), inner)

    long_enough = lambda x: (F.length(_digits(x["m"])) >= 4) | (F.instr(x["m"], "@") > 1)
    words = F.filter(F.transform(_spots(piece, _TOKEN), bare), long_enough)
    email, ip = of(0, "email", _EMAIL, "@"), of(1, "ip", _IP, ".")
    return F.when(inside, F.concat(email, ip, words)).otherwise(F.concat(of(2, "card", _CARD, ""), of(3, "phone", _PHONE, "+")))


def _shape(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]+", "9")


def _contexts(piece: Column, spot: Column, before: Column, after: Column) -> Column:
    """The lexical patterns of a span: the two words before it, and the words on either side.

    ``before`` and ``after`` are the pieces around. The words before are read backwards, so that no
    expression runs over more than it takes. ``_NEAR`` characters mostly hold the whole words that
    are wanted; only where they don't are the pieces read.
    """
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    near_left = F.reverse(F.substring(piece, F.greatest(spot["s"] - _NEAR, F.lit(0)) + 1, F.least(spot["s"], F.lit(_NEAR))))
    all_left = F.reverse(F.concat(before, F.substring(piece, F.lit(1), spot["s"])))
    near_right = F.substring(piece, spot["e"] + 1, F.lit(_NEAR))
    all_right = F.concat(F.substring(piece, spot["e"] + 1, F.char_length(piece)), after)

    def patterns(w: Column) -> Column:
        lead = F.when(w["two"] != "", F.concat(F.lit("L "), _shape(F.concat_ws(" ", w["two"], w["one"]))))
        around = F.when((w["one"] != "") & (w["after"] != ""), F.concat(F.lit("A "), _shape(w["one"]), F.lit(" _ "), _shape(w["after"])))
        return F.array_compact(F.array(lead, around))

    def words(x: Column) -> Column:
        one, two = (F.reverse(F.regexp_extract(x["left"], rf"^{space}*+({word}++)(?:{space}++({word}++))?", g)) for g in (1, 2))
        after_word = F.regexp_extract(x["right"], rf"^{word}*+{space}++({word}++)", 1)
        return _let(F.struct(one.alias("one"), two.alias("two"), after_word.alias("after")), patterns)

    def sides(x: Column) -> Column:
        left = F.when(x["left"].rlike(rf"^{space}*+{word}++{space}++{word}++{space}"), x["left"]).otherwise(all_left)
        right = F.when(x["right"].rlike(rf"^{word}*+{space}++{word}++{space}"), x["right"]).otherwise(all_right)
        return _let(F.struct(left.alias("left"), right.alias("right")), words)

    return _let(F.struct(near_left.alias("left"), near_right.alias("right")), sides)


def _pieces(texts: DataFrame) -> DataFrame:
    """(h1, h2, inside, at, piece, before, after) of the pieces of both kinds: the offset, and the text around that has two words and one.

    Every piece but the last ends with a word and white space, so two pieces before and one after do.
    Pieces without a digit or an @ are left out.
    """
    def around(ps: Column) -> Column:
        def begin(acc: Column, p: Column) -> Column:
            return F.struct((acc["at"] + F.char_length(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        starts = F.aggregate(ps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), begin, lambda acc: acc["out"])
        near = lambda i: F.coalesce(F.get(ps, i), F.lit(""))
        places = F.arrays_zip(ps.alias("piece"), starts.alias("at"))
        return F.transform(places, lambda x, i: F.struct(x["at"].alias("at"), x["piece"].alias("piece"), F.concat(near(i - 2), near(i - 1)).alias("before"), near(i + 1).alias("after")))

    def kind(pattern: str, inside: bool) -> Column:
        pieces = _let(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), around)
        return F.transform(pieces, lambda p: F.struct(F.lit(inside).alias("inside"), p.alias("p")))

    cut = F.concat(*[kind(p, inside) for p, inside in zip(_PIECES, (True, False), strict=True)])
    # an outer explode, as a plain one would be filtered by its own array, computed once more
    rows = texts.where(F.col("text").rlike("[0-9@]")).select("h1", "h2", F.explode_outer(cut).alias("x"))
    return rows.select("h1", "h2", "x.inside", "x.p.*").where(F.col("piece").rlike(r"[0-9@]"))


def _without_touched(spots: DataFrame) -> DataFrame:
    """``spots`` without the identifier-like words that a base span touches; a row for each place of a text."""
    once = spots.groupBy("h1", "h2", "s", "e", "k").agg(F.first("value").alias("value"), F.first("ps").alias("ps"))
    base = F.col("k").isNotNull()
    by_text, until = Window.partitionBy("h1", "h2"), (Window.unboundedPreceding, Window.currentRow)
    forward, back = by_text.orderBy("s", "e").rowsBetween(*until), by_text.orderBy(F.col("s").desc(), F.col("e").desc()).rowsBetween(*until)
    marked = once.withColumns({"reach": F.max(F.when(base, F.col("e"))).over(forward), "next": F.min(F.when(base, F.col("s"))).over(back)})
    touched = F.coalesce(F.col("reach") > F.col("s"), F.lit(False)) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))
    return marked.where(base | ~touched).drop("reach", "next")


def bootstrap(spots: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(value, k) of the instances that the patterns discover, from one row per (value, k, p): k is null for candidates.

    Rounds go on until one adds no known instance.
    All rounds work on distinct (pattern, instance) edges; every count is pre-aggregated before its
    shuffle, so that neither a common pattern nor a common instance is gathered in one task.
    """
    edges = materialize(spots.groupBy("p", "value").agg(F.max("k").alias("k")), "pii-edges")
    known = edges.where(F.col("k").isNotNull()).groupBy("value").agg(F.max("k").alias("known"))
    written = None
    for turn in count(1):
        told = edges.join(known, "value", "left")
        by_kind = told.groupBy("p", "known").agg(F.count(F.lit(1)).alias("n"))
        best = F.max(F.when(F.col("known").isNotNull(), F.struct("n", -F.col("known"))))
        scored = by_kind.groupBy("p").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("known").isNotNull(), F.col("n"))).alias("hits"), best.alias("best"))
        good = scored.where((F.col("hits") >= support) & (F.col("hits") >= confidence * F.col("all")))
        good = good.select("p", (F.col("hits") / F.col("all")).alias("share"), (-F.col("best")["col2"]).alias("found"))
        news = told.where(F.col("known").isNull()).join(good, "p").groupBy("value").agg(F.max(F.struct("share", -F.col("found"))).alias("b"))
        news = news.select("value", (-F.col("b")["col2"]).cast("int").alias("known"))
        grown = materialize(known.withColumn("turn", F.lit(0)).unionByName(news.withColumn("turn", F.lit(turn))), "pii-known")
        if written is not None:
            drop_table(written)
        known, written = grown.drop("turn"), grown
        if grown.where(F.col("turn") == turn).isEmpty():
            break
    seeds = edges.where(F.col("k").isNotNull()).select("value").distinct()
    return known.join(seeds, "value", "left_anti").select("value", F.col("known").alias("k"))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2")]


def _spans_by_text(texts: DataFrame) -> DataFrame:
    """(h1, h2, base, spans, cuts) of every text of ``texts`` (h1, h2, text) with a span.

    ``cuts`` are the spans without overlaps: of overlapping ones, the first to start names the whole.
    Copies of a text give one row; what counts or gathers is written before it is joined, so that a
    join can split a hot key.
    """
    pieces = _pieces(texts)
    rows = pieces.select("h1", "h2", "at", "piece", "before", "after", F.explode_outer(_found(F.col("piece"), F.col("inside"))).alias("x")).where(F.col("x").isNotNull())
    place = [F.col("x.k").alias("k"), (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e")]
    spots = rows.select("h1", "h2", *place, F.lower("x.m").alias("value"), _contexts(F.col("piece"), F.col("x"), F.col("before"), F.col("after")).alias("ps"))
    spots = materialize(_without_touched(materialize(spots, "pii-found")), "pii-spots")
    found = materialize(bootstrap(spots.select("value", "k", F.explode("ps").alias("p"))), "pii-instances")
    more = spots.where(F.col("k").isNull()).select("h1", "h2", "s", "e", "value").join(found, "value")
    columns = ["h1", "h2", "k", "s", "e"]
    base = spots.where(F.col("k").isNotNull()).select(*columns, F.lit(True).alias("in_base"))
    every = base.unionByName(more.select(*columns, F.lit(False).alias("in_base")))

    by_text = Window.partitionBy("h1", "h2").orderBy("s", "e", "k")
    before, until = by_text.rowsBetween(Window.unboundedPreceding, -1), by_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("fresh", F.coalesce(F.col("s") >= F.max("e").over(before), F.lit(True)).cast("int"))
    every = every.withColumn("part", F.sum("fresh").over(until))
    span = F.struct("k", "s", "e")
    whole = [F.min(F.struct("s", "e", "k")).alias("first"), F.max("e").alias("last"), F.collect_list(F.struct("in_base", span.alias("x"))).alias("xs")]
    parts = every.groupBy("h1", "h2", "part").agg(*whole)
    cut = F.struct(F.col("first.s").alias("s"), F.col("last").alias("e"), F.col("first.k").alias("k"))
    texts = parts.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.flatten(F.collect_list("xs")).alias("xs"))
    of = lambda xs: F.array_sort(F.transform(xs, lambda x: x["x"]))
    return materialize(texts.select("h1", "h2", of(F.filter("xs", lambda x: x["in_base"])).alias("base"), of(F.col("xs")).alias("spans"), "cuts"), "pii-texts")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, *_text_key(text))


def _with_spans(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of every row, with base, spans and cuts. Only texts with a digit or an @ can have any, so only they are shuffled."""
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    bare = F.array().cast("array<struct<s:int,e:int,k:int>>")
    some = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    texts = _spans_by_text(_keyed(docs.where(some), F.col("text")))
    joined = _keyed(docs.where(some), *columns).join(texts, ["h1", "h2"], "left").drop("h1", "h2")
    found = {"base": F.coalesce("base", none), "spans": F.coalesce("spans", none), "cuts": F.coalesce("cuts", bare)}
    rest = docs.where(~some).select(*columns, none.alias("base"), none.alias("spans"), bare.alias("cuts"))
    return joined.withColumns(found).unionByName(rest)


def find_spans(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``base`` and ``spans``: arrays of (k, s, e), k the kind's position in KINDS.

    Offsets are code points, end exclusive. Base spans are exactly the contract's and stay; spans adds
    the discovered ones, which overlap no base span. Null and empty texts have none; texts are scanned
    whole, whatever their length; equal texts get equal spans; repeated rows each get a row; other
    columns pass through, whatever their names (``base`` and ``spans`` are replaced); an empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c not in ("base", "spans")]
    found = _with_spans(docs, packed(docs))
    return found.select(*[F.col("packed")[c].alias(c) for c in names], "base", "spans")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, told), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of every row; see ``find_spans``."""
    found = _with_spans(docs, F.col("doc_id"))
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _clean(text: Column, cuts: Column) -> Column:
    """``text`` with a token for each of the disjoint ``cuts``, put together from blocks of ``_BLOCK`` characters."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def block(low: Column) -> Column:
        def parts(body: Column) -> Column:
            def of(mine: Column) -> Column:
                last = lambda i: F.greatest(F.coalesce(F.get(mine, i)["e"], low), low)
                gap = lambda x, i: F.substring(body, last(i - 1) - low + 1, x["s"] - last(i - 1))
                token = lambda x: F.when(x["s"] >= low, F.element_at(names, x["k"] + 1)).otherwise("")
                shown = F.transform(mine, lambda x, i: F.concat(F.when(x["s"] > last(i - 1), gap(x, i)).otherwise(""), token(x)))
                return F.concat(F.array_join(shown, ""), F.substring(body, last(F.size(mine) - 1) - low + 1, F.lit(_BLOCK)))

            return _let(F.filter(cuts, lambda c: (c["s"] < low + _BLOCK) & (c["e"] > low)), of)

        return _let(F.substring(text, low + 1, F.lit(_BLOCK)), parts)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(_BLOCK)), block), "")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; of overlapping spans, the first to start names the whole.

    Texts without a span stay as they are, null and empty ones among them; repeated rows each get a
    row; all columns stay, whatever their names; an empty table gives no rows. See ``find_spans``.
    """
    found = _with_spans(docs, packed(docs), F.col("text"))
    shown = F.when(F.size("cuts") > 0, _clean(F.col("text"), F.col("cuts"))).otherwise(F.col("text"))
    return found.select(*[shown.alias(c) if c == "text" else F.col("packed")[c].alias(c) for c in docs.columns])
