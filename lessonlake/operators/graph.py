"""Code-graph queries over symbols, call edges and implements edges; requests are DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.sources.shared import materialize, shared_path

CAP, CLOSURE_CAP, PATH_LEVELS = 50, 500, 10
#: Parts of a key whose rows meet many others.
PARTS = 32


def resolve(requests: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """G1: (query_id, id, tier, ambiguous): by qname, else by name, else by qname ending in ``.name``; first tier with a hit wins.

    Qnames are exploded into their dotted endings, so the third tier is an equality join too. Each
    distinct name is resolved once for all requests, which meet its first ``most`` symbols only.
    """
    parts = F.split("qname", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = symbols.select("id", "qname", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("tier"), F.col("qname").alias("key")), F.struct(F.lit(2).alias("tier"), F.col("name").alias("key"))), F.when(F.size(parts) > 1, F.transform(ends, lambda e: F.struct(F.lit(3).alias("tier"), e.alias("key")))).otherwise(F.array().cast("array<struct<tier:int,key:string>>")))).alias("k"))
    named = keys.select("id", "qname", "k.tier", F.col("k.key").alias("name")).join(requests.select("name").distinct(), "name", "left_semi")
    hits = materialize(named.groupBy("name", "id", "qname").agg(F.min("tier").alias("tier")), "resolved")
    best = hits.groupBy("name", "tier").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.min(F.struct("tier", "n")).alias("best")).select("name", "best.*")
    # the rank alone, so that each task keeps its best rows before the shuffle
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("name", "tier").orderBy("qname", "id"))).where(F.col("r") <= most)
    told = ranked.join(best, ["name", "tier"]).select("name", "id", F.col("tier").cast("long").alias("tier"), (F.col("n") > 1).alias("ambiguous"))
    return requests.join(told, "name").select("query_id", "id", "tier", "ambiguous")


def _steps(edges: DataFrame, up: bool) -> DataFrame:
    return edges.select(F.col("callee" if up else "caller").alias("id"), F.col("caller" if up else "callee").alias("next"))


def reach(starts: DataFrame, edges: DataFrame, up: bool, depth: int | None, enough: int | None = None, include_start: bool = False) -> DataFrame:
    """(start, id, depth): every node at its first depth. A start with ``enough`` nodes goes no further.

    Each level is written once, as a partition of one table; what was seen is that table.
    """
    spark, root = starts.sparkSession, shared_path(starts.sparkSession, "reached")
    schema = f"start {starts.schema['id'].dataType.simpleString()}, id {starts.schema['id'].dataType.simpleString()}"
    seen = lambda: spark.read.schema(f"{schema}, depth long").option("basePath", root).parquet(f"{root}/depth=*")
    steps = materialize(_steps(edges, up), "steps")
    frontier = starts.select(F.col("id").alias("start"), "id").distinct()
    if not include_start:
        frontier.write.parquet(f"{root}/depth=0")
    level = 0
    while depth is None or level < depth:
        level += 1
        fresh = frontier.join(steps, "id").select("start", F.col("next").alias("id")).distinct()
        if level > 1 or not include_start:
            fresh = fresh.join(seen().drop("depth"), ["start", "id"], "left_anti")
        fresh.write.parquet(f"{root}/depth={level}")
        fresh = spark.read.schema(schema).parquet(f"{root}/depth={level}")
        if fresh.isEmpty():
            break
        frontier = fresh
        if enough is not None:
            open_starts = seen().groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < enough).select("start")
            frontier = fresh.join(open_starts, "start", "left_semi")
    return seen()


def neighbours(starts: DataFrame, symbols: DataFrame, edges: DataFrame, up: bool = True, depth: int = 1, cap: int = CAP) -> DataFrame:
    """(start, position, id, depth), nearest first, own package before others, then by qname; ``cap`` over all depths.

    A start whose whole levels hold ``cap`` nodes goes no further, as all that follow are farther. The
    start itself is among what ``reach`` counts.
    """
    found = reach(starts, edges, up, max(1, min(depth, 5)), enough=cap + 1).where("depth > 0")
    own = symbols.select(F.col("id").alias("start"), F.col("package").alias("own"))
    placed = found.join(symbols.select("id", "package", "qname"), "id").join(own, "start")
    order = Window.partitionBy("start").orderBy("depth", (F.col("package") != F.col("own")).cast("int"), "qname")
    return placed.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= cap).select("start", "position", "id", "depth")


def transitive_callers(starts: DataFrame, edges: DataFrame, cap: int = CLOSURE_CAP) -> DataFrame:
    """(id, callers): size of the up-closure, the start included where it lies on a cycle; ``cap`` at most."""
    found = reach(starts, edges, True, None, enough=cap, include_start=True).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    joined = starts.select("id").distinct().join(found.withColumnRenamed("start", "id"), "id", "left")
    return joined.select("id", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("long").alias("callers"))


def shortest_path(pairs: DataFrame, edges: DataFrame, levels: int = PATH_LEVELS) -> DataFrame:
    """(start, target, length, path) from caller to callee, the smallest path of the shortest; pairs without one have no row.

    Levels grow from both ends in turn, each written once. A pair leaves the search where the last levels
    of its ends meet, or one end has no further level. Paths are then walked through the nodes that lie
    on a shortest one, the smallest next node first.
    """
    spark, root, pair = pairs.sparkSession, shared_path(pairs.sparkSession, "levels"), ["start", "target"]
    steps = materialize(_steps(edges, False).distinct(), "steps")
    back = steps.select(F.col("next").alias("id"), F.col("id").alias("next"))
    todo = materialize(pairs.select(*pair).distinct(), "pairs")
    schema = todo.withColumn("id", F.col("start")).schema
    read = lambda end, level: spark.read.schema(schema).parquet(f"{root}/{end}={level}")
    apart = todo.where("start <> target")
    ends = {"down": apart.select(*pair, F.col("start").alias("id")), "up": apart.select(*pair, F.col("target").alias("id"))}
    for end, first in ends.items():
        first.write.parquet(f"{root}/{end}=0")
    reached, met = {"down": 0, "up": 0}, []
    for level in range(levels):
        end, other = ("down", "up") if level % 2 == 0 else ("up", "down")
        wider = ends[end].join(steps if end == "down" else back, "id").select(*pair, F.col("next").alias("id")).distinct()
        wider = wider.join(read(end, "*"), [*pair, "id"], "left_anti")
        reached[end] += 1
        wider.write.parquet(f"{root}/{end}={reached[end]}")
        fresh = read(end, reached[end])
        found = materialize(fresh.join(ends[other], [*pair, "id"]), "met")
        met.append((reached["down"], reached["up"], found))
        settled = found.select(*pair).distinct()
        ends[end] = fresh.join(settled, pair, "left_anti")
        ends[other] = materialize(ends[other].join(ends[end].select(*pair).distinct(), pair, "left_semi"), "frontier")
        if ends[other].isEmpty():
            break
    done = todo.where("start = target").select(*pair, F.array("start").alias("path"))
    for down, up, found in met:
        if found.isEmpty():
            continue
        through = {down: found}
        for depth in range(down - 1, 0, -1):
            before = through[depth + 1].join(back, "id").select(*pair, F.col("next").alias("id")).distinct()
            through[depth] = materialize(before.join(read("down", depth), [*pair, "id"], "left_semi"), "through")
        walk = found.select(*pair).distinct().select(*pair, F.col("start").alias("id"), F.array("start").alias("path"))
        for depth in range(1, down + up + 1):
            ahead = through[depth] if depth <= down else read("up", down + up - depth)
            stepped = walk.join(steps, "id").drop("id").withColumnRenamed("next", "id").join(ahead, [*pair, "id"])
            walk = stepped.groupBy(*pair).agg(F.min(F.struct("id", "path")).alias("s")).select(*pair, "s.id", F.concat("s.path", F.array("s.id")).alias("path"))
        done = done.unionByName(materialize(walk.select(*pair, "path"), "walked"))
    return done.select("start", "target", F.size("path").cast("long").alias("length"), "path")


def _listed(implements: DataFrame, symbols: DataFrame, of: str, other: str, cap: int) -> DataFrame:
    named = implements.join(symbols.select(F.col("id").alias(other), "qname"), other)
    total = named.groupBy(of).agg(F.count(F.lit(1)).alias("total"))
    ranked = named.withColumn("position", F.row_number().over(Window.partitionBy(of).orderBy("qname", other)).cast("long")).where(F.col("position") <= cap)
    return ranked.join(total, of).select(of, "position", other, "total")


def implementers(implements: DataFrame, symbols: DataFrame, cap: int = CAP) -> DataFrame:
    """(iface, position, impl, total) by qname."""
    return _listed(implements, symbols, "iface", "impl", cap)


def satisfies(implements: DataFrame, symbols: DataFrame, cap: int = CAP) -> DataFrame:
    """G6 the other way: (impl, position, iface, total), the interfaces that a type satisfies, by qname."""
    return _listed(implements, symbols, "impl", "iface", cap)


@dataclass
class Shapes:
    """The implements relation by method sets: ifaces (iface, shape) and impls (impl, shape), one row an id; a type implements the interfaces of its shape.

    Its pairs grow with the square of a shape's members, so operators over it rank and count a shape once.
    """

    ifaces: DataFrame
    impls: DataFrame

    def pairs(self) -> DataFrame:
        """(iface, impl), which is also what the other operators take."""
        return _meet(self.ifaces, self.impls, "iface", ["shape"]).select("iface", "impl")

    def totals(self) -> DataFrame:
        """(iface, total) of the interfaces with an implementer."""
        return self.ifaces.join(_sizes(self.impls), "shape").select("iface", "total")

    def implementers(self, symbols: DataFrame, cap: int = CAP) -> DataFrame:
        """G6 as ``implementers``."""
        return _listed_by_shape(self.ifaces, self.impls, symbols, "iface", "impl", cap)

    def satisfies(self, symbols: DataFrame, cap: int = CAP) -> DataFrame:
        """G6 as ``satisfies``."""
        return _listed_by_shape(self.impls, self.ifaces, symbols, "impl", "iface", cap)

    def named(self, symbols: DataFrame) -> DataFrame:
        """(iface, qname) of every pair; the names are joined to the types, so no pair is shuffled."""
        named = self.impls.join(symbols.select(F.col("id").alias("impl"), "qname"), "impl").select("shape", "qname")
        return _meet(self.ifaces, named, "iface", ["shape"]).select("iface", "qname")

    def dispatch(self, calls: DataFrame, methods: DataFrame) -> DataFrame:
        """G10 as ``dispatch``, of calls (caller, shape, method) of any interface of a shape and methods with one row an id.

        A method belongs to one type and so to one shape: distinct calls make distinct pairs, and none is shuffled.
        """
        asked = calls.join(self.ifaces.select("shape").distinct(), "shape", "left_semi").select("caller", "shape", "method").distinct()
        owned = methods.join(self.impls, "impl").select("shape", "method", "id")
        return _meet(asked, owned, "caller", ["shape", "method"]).select("caller", F.col("id").alias("callee")).where("caller <> callee")


def _meet(ones: DataFrame, others: DataFrame, spread: str, keys: list[str]) -> DataFrame:
    """Join by a few large keys: each is cut by a hash of ``spread`` in parts that meet a copy of the other side."""
    cut = ones.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    copies = others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return cut.join(copies.hint("shuffle_hash"), [*keys, "part"])


def _sizes(side: DataFrame) -> DataFrame:
    return side.groupBy("shape").agg(F.count(F.lit(1)).alias("total"))


def _listed_by_shape(ones: DataFrame, others: DataFrame, symbols: DataFrame, of: str, other: str, cap: int) -> DataFrame:
    named = others.join(symbols.select(F.col("id").alias(other), "qname"), other)
    # the rank alone, so that each task keeps its best rows before the shuffle
    ranked = named.withColumn("position", F.row_number().over(Window.partitionBy("shape").orderBy("qname", other)).cast("long")).where(F.col("position") <= cap)
    return ones.join(ranked.join(_sizes(others), "shape").select("shape", "position", other, "total"), "shape").select(of, "position", other, "total")


def fan(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees) of every symbol, 0 where it has none."""
    into = edges.groupBy(F.col("callee").alias("id")).agg(F.countDistinct("caller").alias("callers"))
    out = edges.groupBy(F.col("caller").alias("id")).agg(F.countDistinct("callee").alias("callees"))
    joined = symbols.select("id").join(into, "id", "left").join(out, "id", "left")
    return joined.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("callers", "callees")])


def index_size(**tables: DataFrame) -> DataFrame:
    """A10: (name, n) of the index's tables."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest_direct(symbols: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(start, id, r): the first ``cap`` direct callers of every symbol, own package before others, then by qname."""
    own = symbols.select(F.col("id").alias("callee"), F.col("package").alias("own"))
    placed = edges.join(own, "callee").join(symbols.select(F.col("id").alias("caller"), "package", "qname"), "caller")
    order = Window.partitionBy("callee").orderBy((F.col("package") != F.col("own")).cast("int"), "qname")
    ranked = placed.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= cap)
    return ranked.select(F.col("callee").alias("start"), F.col("caller").alias("id"), "r")


def resolve_packages(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, package): the shortest package that a request's ``name`` is, or is the tail of after a slash; then the first by name.

    Packages are exploded into their tails, so this is an equality join.
    """
    parts = F.split("package", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = symbols.select("package").distinct().select("package", F.explode(tails).alias("name"))
    asked = requests.select("query_id", F.btrim("name", F.lit("/")).alias("name"))
    return asked.join(keys, "name").groupBy("query_id").agg(F.min(F.struct(F.length("package").alias("n"), "package"))["package"].alias("package"))


def package_surface(requests: DataFrame, symbols: DataFrame, most: int = 200, doc_bytes: int = 120) -> DataFrame:
    """(query_id, package, position, id, doc, unexported, truncated): the exported symbols of the resolved package by line, the first line of their doc, the number of the others, and whether symbols were left out."""
    from lessonlake.functions import text as T

    found = resolve_packages(requests, symbols)
    census = symbols.groupBy("package").agg(F.count_if(~F.col("exported")).alias("unexported"), (F.count_if("exported") > most).alias("truncated"))
    order = Window.partitionBy("package").orderBy("line", "id")
    ranked = symbols.where("exported").withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most)
    told = ranked.select("package", "position", "id", T.truncated(T.first_line(F.col("doc")), doc_bytes).alias("doc"))
    return found.join(told, "package").join(census, "package").select("query_id", "package", "position", "id", "doc", "unexported", "truncated")


def hints(symbols: DataFrame, edges: DataFrame, implements: DataFrame | Shapes) -> DataFrame:
    """One number that tells most about a symbol of its kind; null where the kind has none."""
    callers = transitive_callers(symbols.where("kind IN ('func', 'method')"), edges)
    totals = implements.totals() if isinstance(implements, Shapes) else implements.groupBy("iface").agg(F.count(F.lit(1)).alias("total"))
    impls = totals.select(F.col("iface").alias("id"), F.col("total").alias("impls"))
    joined = symbols.join(callers, "id", "left").join(impls, "id", "left")
    hint = F.when(F.col("kind").isin("func", "method"), F.col("callers")).when(F.col("kind") == "interface", F.coalesce("impls", F.lit(0)))
    return joined.select("id", "kind", hint.alias("hint"))


def satisfied(needs: DataFrame, has: DataFrame) -> DataFrame:
    """(iface, impl) where ``has`` (impl, method) holds every method of ``needs`` (iface, method).

    Relational division by counts, of distinct sets of methods; rows with equal sets share the answer.
    """
    asked, held = _method_sets(needs, "iface").where("NOT odd"), _method_sets(has, "impl")
    wants = asked.select("methods").distinct().select(F.col("methods").alias("wanted"), F.size("methods").alias("size"), F.explode("methods").alias("method"))
    owns = held.select("methods").distinct().select("methods", F.explode("methods").alias("method"))
    met = wants.join(owns, "method").groupBy("wanted", "methods", "size").agg(F.count(F.lit(1)).alias("met")).where("met = size").select("wanted", F.col("methods").alias("shape"))
    ifaces = asked.join(met, F.col("methods") == F.col("wanted")).select("iface", "shape")
    return Shapes(ifaces, held.select("impl", F.col("methods").alias("shape"))).pairs()


def _method_sets(rows: DataFrame, of: str) -> DataFrame:
    sets = rows.groupBy(of).agg(F.array_sort(F.collect_set("method")).alias("methods"), F.bool_or(F.col("method").isNull()).alias("odd"))
    return materialize(sets, "method-sets")


def dispatch(calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee): calls of an interface's method (caller, iface, method) reach that method (id, impl, method) of all implementers."""
    return calls.join(implements, "iface").join(methods, ["impl", "method"]).select("caller", F.col("id").alias("callee")).where("caller <> callee").distinct()


def with_methods(types: DataFrame, methods: DataFrame) -> DataFrame:
    """Types with a method whose qname continues the type's; a method's dotted prefixes make it an equality semi join."""
    parts = F.split("qname", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    owners = methods.where(F.size(parts) > 1).select(F.explode(prefixes).alias("qname"))
    return types.join(owners, "qname", "left_semi")


def edge_totals(starts: DataFrame, edges: DataFrame, up: bool = True, cap: int = CAP) -> DataFrame:
    """(id, total) of direct neighbours where they are more than ``cap``."""
    found = starts.select("id").join(_steps(edges, up), "id").groupBy("id").agg(F.countDistinct("next").alias("total"))
    return found.where(F.col("total") > cap)


def describe(requests: DataFrame, symbols: DataFrame, edges: DataFrame, implements: DataFrame | Shapes) -> DataFrame:
    """Per request (query_id, name): the symbol and its hint, ``ambiguous`` for several, a menu of similar symbols for none."""
    from lessonlake.operators.retrieval import symbol_search

    found = materialize(resolve(requests, symbols), "described")
    clear = found.where("NOT ambiguous")
    told = clear.join(hints(symbols.join(clear.select("id").distinct(), "id", "left_semi"), edges, implements), "id").select("query_id", "id", F.lit("symbol").alias("answer"), "hint")
    none = F.lit(None).cast("long").alias("hint")
    several = found.where("ambiguous").select("query_id", "id", F.lit("ambiguous").alias("answer"), none)
    lost = requests.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("name").alias("query"))
    if lost.isEmpty():
        return told.unionByName(several)
    menu = symbol_search(lost, symbols.withColumn("doc", F.lit(""))).select("query_id", "id", F.lit("menu").alias("answer"), none)
    return told.unionByName(several).unionByName(menu)
