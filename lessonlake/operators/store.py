"""Lookups, censuses, retention, context bundles, ingest stages and the shared pool of a memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lessonlake.functions import text as T
from lessonlake.sources.shared import materialize

KINDS = ("error_resolution", "task_pattern", "user_rule", "session_summary")
SCOPES, ORIGINS = ("personal", "shared"), ("manual", "auto")


def _newest() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def _number(window) -> Column:
    return F.row_number().over(window).cast("long")


def list_memories(memories: DataFrame, task_type: str | None = None, kind: str | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Newest first under equality filters; a top-k, never a full sort."""
    limit = min(limit if limit > 0 else 20, 100)
    for column, value in (("task_type", task_type), ("kind", kind), ("scope", scope)):
        if value is not None:
            memories = memories.where(F.col(column) == value)
    return memories.orderBy(*_newest()).limit(limit)


def recent_sessions(memories: DataFrame, limit: int = 10) -> DataFrame:
    """Rows of origin auto, newest first."""
    return memories.where("origin = 'auto'").orderBy(*_newest()).limit(min(limit if limit > 0 else 10, 100))


def lookup(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """S3: the rows of requested ids; blank ids match nothing."""
    return memories.join(ids.where("trim(id) <> ''").select("id").distinct(), "id", "left_semi")


def expand(memories: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` (id, at) adds to each row's expand count and sets its last expansion."""
    more = seen.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    joined = memories.join(more, "id", "left")
    count = F.col("expand_count") + F.coalesce("n", F.lit(0))
    return joined.withColumns({"expand_count": count, "last_expanded_at": F.coalesce("last", "last_expanded_at")}).drop("n", "last")


def by_title(memories: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, found): the rows of each requested (id, title) exactly; blank titles find nothing."""
    asked = titles.where("trim(title) <> ''").select("id", "title")
    return asked.join(memories.select(F.col("id").alias("found"), "title"), "title").select("id", "found")


def session_files(events: DataFrame) -> DataFrame:
    """(session_id, file_path, created_at): the first edit of each file of a session."""
    edits = events.where("tool = 'Edit' AND path <> ''")
    return edits.groupBy(F.col("session").cast("string").alias("session_id"), F.col("path").alias("file_path")).agg(F.min("sec").alias("created_at"))


def kind_counts(memories: DataFrame) -> DataFrame:
    """A1: rows of each kind and in all."""
    return memories.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def census(memories: DataFrame) -> DataFrame:
    """A2: (task_type, n, newest): rows of each task type and the title of its newest summary, empty without one."""
    summary = F.col("kind") == "session_summary"
    newest = F.max_by(F.when(summary, F.col("title")), F.when(summary, F.struct("created_at", "id")))
    return memories.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(newest, F.lit("")).alias("newest"))


def shared_count(memories: DataFrame) -> DataFrame:
    """A3."""
    return memories.agg(F.count_if(F.col("scope") == "shared").alias("n"))


def slug_near_misses(rows: DataFrame) -> DataFrame:
    """A5: (task_type, n, other): the commonest other task type that is the same slug, the first by name among equals; null without one."""
    counts = rows.groupBy("task_type").agg(F.count(F.lit(1)).alias("n")).withColumn("slug", T.slug(F.col("task_type")))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.col("n").desc(), "task_type"))
    # whoever is not the first of its slug is pointed at the first, and the first at the second
    top = counts.withColumn("r", place).where("r <= 2").groupBy("slug").agg(F.min(F.struct("r", "task_type"))["task_type"].alias("first"), F.max(F.when(F.col("r") == 2, F.col("task_type"))).alias("second"))
    other = F.when(F.col("task_type") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return counts.join(top, "slug").select("task_type", "n", other.alias("other"))


def expand_signal(events: DataFrame) -> DataFrame:
    """(id, n, last) of the tool events that name a row by its number."""
    return events.where("event = 'PostToolUse'").groupBy(F.col("event_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.max("sec").alias("last"))


def dashboard(memories: DataFrame, recent: int = 10) -> DataFrame:
    """Rows of each kind and task type with the newest summary's title, and the newest automatic rows by title with their time."""
    kinds = memories.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("part"), F.col("kind").alias("name"), "n", F.lit("").alias("newest"))
    types = census(memories).select(F.lit("task_type").alias("part"), F.col("task_type").alias("name"), "n", "newest")
    last = recent_sessions(memories, recent).select(F.lit("recent").alias("part"), F.col("title").alias("name"), F.col("created_at").alias("n"), F.lit("").alias("newest"))
    return kinds.unionByName(types).unionByName(last)


def row_count(memories: DataFrame) -> DataFrame:
    """Rows, task types and bytes of text."""
    size = F.aggregate(F.array(*[F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long") for c in ("title", "what", "learned", "tags")]), F.lit(0).cast("long"), lambda a, x: a + x)
    return memories.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("task_type").alias("task_types"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def index_rows(memories: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, d): each indexed row with its number of tokens."""
    return memories.select("id").join(stats.select("id", "d"), "id")


def outside_newest(memories: DataFrame, most: int) -> DataFrame:
    """The rows that are not among the newest ``most`` of their task type."""
    rank = _number(Window.partitionBy("task_type").orderBy(*_newest()))
    kept = memories.select("id", "task_type", "created_at").withColumn("r", rank).where(F.col("r") <= most)
    return memories.join(kept.select("id"), "id", "left_anti")


def among_newest(memories: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` rows of all, by a semi join with their ids."""
    return memories.join(memories.orderBy(*_newest()).limit(most).select("id"), "id", "left_semi")


def export_shared(memories: DataFrame) -> DataFrame:
    """One JSON line for each shared row, six fields, in the order of fingerprints: range partitions, each sorted."""
    fields = F.to_json(F.struct("kind", "task_type", "title", "what", "learned", "tags"))
    return memories.where("scope = 'shared'").orderBy("fingerprint", "id").select("fingerprint", fields.alias("value"))


def record_files(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, file_path, created_at) rows to insert: trimmed, not blank, not there yet, first time only."""
    trimmed = new.select(F.trim("session_id").alias("session_id"), F.trim("file_path").alias("file_path"), "created_at")
    fresh = trimmed.where("session_id <> '' AND file_path <> ''").groupBy("session_id", "file_path").agg(F.min("created_at").alias("created_at"))
    return fresh.join(existing, ["session_id", "file_path"], "left_anti")


def tabular(rows: DataFrame, group: str, name: str, columns: list[str], order: list[str]) -> DataFrame:
    """Per group, ``name[n]{cols}:`` and one line a row; only values with a comma or quote are quoted."""
    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.contains(",") | v.contains('"'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    lines = rows.select(group, F.struct(*order, F.concat_ws(",", *[cell(c) for c in columns]).alias("line")).alias("x"))
    lined = lines.groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = F.concat(F.lit(f"{name}["), F.size("xs").cast("string"), F.lit("]{" + ",".join(columns) + "}:"))
    return lined.select(group, F.array_join(F.concat(F.array(head), F.transform("xs", lambda x: x["line"])), "\n").alias("text"))


def keep_manual(memories: DataFrame, most: int = 5) -> DataFrame:
    """The rows that stay when manual summaries keep the newest ``most`` of each task type."""
    mine = (F.col("kind") == "session_summary") & (F.col("origin") == "manual")
    rank = _number(Window.partitionBy("task_type").orderBy(*_newest()))
    return memories.where(mine).withColumn("r", rank).where(F.col("r") <= most).drop("r")


def keep_auto(memories: DataFrame, most: int = 30, grace: int = 5) -> DataFrame:
    """The automatic summaries that stay: newest in grace, then expanded, warmer and newer ones.

    Both cuts are top-k plans, so no task sorts all summaries.
    """
    autos = memories.where("kind = 'session_summary' AND origin = 'auto'")
    shield = autos.orderBy(*_newest()).limit(grace).select("id", F.lit(1).alias("grace"))
    marked = autos.join(F.broadcast(shield), "id", "left")
    order = [F.coalesce("grace", F.lit(0)).desc(), (F.col("expand_count") > 0).desc(), F.col("last_expanded_at").desc_nulls_last(), *_newest()]
    return marked.orderBy(*order).limit(most).drop("grace")


def last_session(memories: DataFrame) -> DataFrame:
    """The newest summary of each task type, of either origin."""
    rank = _number(Window.partitionBy("task_type").orderBy(*_newest()))
    return memories.where("kind = 'session_summary'").withColumn("r", rank).where("r = 1").drop("r")


def user_rules(memories: DataFrame, full: int = 5) -> DataFrame:
    """Rules by task type, newest first: ``full`` with their lesson, the rest as stubs; all full if negative."""
    window = Window.partitionBy("task_type")
    ranked = memories.where("kind = 'user_rule'").withColumns({"position": _number(window.orderBy(*_newest())), "total": F.count(F.lit(1)).over(window)})
    whole = F.lit(True) if full < 0 else F.col("position") <= full
    return ranked.withColumns({"tier": F.when(whole, "always").otherwise("browse"), "learned": F.when(whole, F.col("learned"))})


#: Browse rows of each kind, whether they come whole, and how many rules do (fixed values).
MODES = {"orient": (10, False, 5), "deep": (5, True, -1), "refresh": (0, False, 5)}


def context_bundle(requests: DataFrame, memories: DataFrame, index, mode: str = "orient") -> DataFrame:
    """Tier, position and text of everything a request (query_id, task_type, query) gets.

    A query without tokens falls back to the task type. All parts read one version of the table.
    """
    from lessonlake.operators import retrieval as R

    most, whole, full = MODES[mode]
    requests = requests.withColumn("task_type", F.lower(F.trim("task_type")))
    asked = F.col("query") if "query" in requests.columns else F.lit(None).cast("string")
    usable = F.exists(T.phrases(F.coalesce(asked, F.lit(""))), lambda p: F.size(R.tokenize(p)) > 0)
    requests = requests.withColumn("query", F.when(usable, asked).otherwise(F.col("task_type")))
    key = requests.select("query_id", "task_type")
    columns = ["query_id", "section", "position", "id", "text"]
    session = last_session(memories).join(key, "task_type").select("query_id", F.lit("session").alias("section"), F.lit(1).cast("long").alias("position"), "id", F.col("learned").alias("text"))
    rules = user_rules(memories, full).join(key, "task_type").select("query_id", F.concat(F.lit("rule_"), F.col("tier")).alias("section"), "position", "id", F.coalesce("learned", "title").alias("text"))
    parts = session.unionByName(rules)
    if most:
        found = R.browse_kinds(requests, memories, index, KINDS[:2], most).join(memories.select("id", "what", "learned"), "id")
        text = F.concat_ws("\n", "what", "learned") if whole else T.snippet(F.col("what"))
        parts = parts.unionByName(found.select("query_id", F.col("kind").alias("section"), F.col("rank").alias("position"), "id", text.alias("text")))
    return parts.select(*columns)


def validation_error(secret_in: Column | None = None) -> Column:
    """The first failing check as ``field:reason``, null if all pass. ``secret_in`` names a field with a secret."""
    blank = lambda c: T.trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [F.when(blank("task_type"), "task_type:required"), F.when(~T.valid_task_type(F.col("task_type")) & (F.octet_length(T.trimmed(F.col("task_type"))) <= 64), "task_type:slug"), F.when(~F.col("kind").isin(*KINDS), "kind:unknown")]
    checks += [F.when(blank(c), f"{c}:required") for c in ("title", "what", "learned")]
    checks += [F.when(~F.coalesce("scope", F.lit("personal")).isin(*SCOPES), "scope:unknown"), F.when(~F.coalesce("origin", F.lit("manual")).isin(*ORIGINS), "origin:unknown")]
    checks += [F.when(T.over_cap().isNotNull(), F.concat(T.over_cap(), F.lit(":too_long")))]
    if secret_in is not None:
        checks.append(F.when(secret_in.isNotNull(), F.concat(secret_in, F.lit(":secret"))))
    return F.coalesce(*checks, F.when(T.empty_after_scrub(F.col("learned")), "learned:emptied"))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Status saved or duplicate of every row in arrival order, with the first id of its fingerprint.

    The firsts are written before the join, which can so split a fingerprint that many rows share.
    """
    first = F.min(F.struct("created_at", "id")).alias("first")
    firsts = rows.groupBy("fingerprint").agg(first).select("fingerprint", F.col("first.id").alias("matched_id"))
    firsts = materialize(firsts, "first-fingerprints")
    joined = rows.join(firsts, "fingerprint")
    same = F.col("id") == F.col("matched_id")
    return joined.select("id", F.when(same, "saved").otherwise("duplicate").alias("status"), F.when(~same, F.col("matched_id")).alias("matched_id"))


def merge_forced(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """Forced saves replace body, scope and fingerprint of the matched row and keep the rest of it."""
    fresh = updates.select("fingerprint", *[F.col(c).alias(f"new_{c}") for c in ("title", "what", "learned", "tags", "scope", "updated_at")])
    joined = rows.join(fresh, "fingerprint", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("title", "what", "learned", "tags", "scope", "updated_at") else F.col(c) for c in rows.columns])


def supersede(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Without the rows that saved ones name in ``supersedes``, where kind, task type and scope agree."""
    gone = new.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"), "kind", "task_type", "scope").distinct()
    return rows.join(gone, ["id", "kind", "task_type", "scope"], "left_anti")


def prune(rows: DataFrame, now: int, ids: list[str] | None = None, kind: str | None = None, task_type: str | None = None, days: int | None = None) -> Column:
    """The condition of rows to remove. Ids override all else; without any filter it raises."""
    if ids:
        return F.col("id").isin(*ids)
    tests = []
    if kind:
        tests.append(F.col("kind") == kind)
    if task_type:
        tests.append(F.col("task_type") == task_type)
    if days:
        tests.append(F.col("created_at") < now - days * 86400)
    if not tests:
        raise ValueError("prune needs a filter")
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def set_scope(rows: DataFrame, ids: DataFrame, scope: str) -> DataFrame:
    """updated_at stays."""
    marked = rows.join(ids.select("id", F.lit(scope).alias("new_scope")).distinct(), "id", "left")
    return marked.withColumn("scope", F.coalesce("new_scope", "scope")).drop("new_scope")


def add_missing(rows: DataFrame, version: int) -> DataFrame:
    """Columns that later versions of the table have, with their defaults."""
    ladder = [(1, "scope", F.lit("personal")), (2, "expand_count", F.lit(0).cast("long")), (2, "last_expanded_at", F.lit(None).cast("long")), (3, "origin", F.lit("manual")), (4, "review_after", F.lit(None).cast("long")), (4, "pinned", F.lit(False))]
    for since, name, default in ladder:
        if version < since and name not in rows.columns:
            rows = rows.withColumn(name, default)
    return rows


def index_difference(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Postings that only one side has, counted by side."""
    lost = rebuilt.exceptAll(stored).select(F.lit("missing").alias("side"))
    return lost.unionByName(stored.exceptAll(rebuilt).select(F.lit("stale").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def upsert(rows: DataFrame) -> DataFrame:
    """I8: one row for each fingerprint: body and update time of the last arrival, id, origin and creation of the first."""
    order = F.struct("created_at", "id")
    first = [F.min_by(c, order).alias(c) for c in ("id", "origin", "created_at")]
    last = [F.max_by(c, order).alias(c) for c in ("title", "what", "learned", "tags", "updated_at")]
    return rows.groupBy("fingerprint").agg(*first, *last)


#: What every saved text is redacted in, and what must hold no secret at all.
TEXTS, IDENTIFIERS = ("title", "what", "learned"), ("session_id", "task_type", "tags")


def ingest(requests: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, status, matched_id, error, redactions, slug_hint) of requests in order of arrival: invalid, duplicate, near_duplicate or saved.

    Texts are redacted first; a secret in an identifier or tag makes a request invalid, as do the
    checks of I2 on what redaction leaves. Duplicates are found by fingerprint, then by token sets in
    greedy order; saved rows of a task type that is another's slug get that as a hint. Nothing is
    written, so this is also the dry run (I10); the caller appends the saved rows, and removes what
    they supersede (I9) and retention drops (W1, W2).
    """
    from lessonlake.operators import dedupe, scrub

    # in one pass, so that no text is shuffled
    secret = scrub.scrub_fields(requests.withColumn("request", F.struct(*requests.columns)), IDENTIFIERS).select("request.*", scrub.secret_field(IDENTIFIERS).alias("secret"))
    clean = scrub.scrub_fields(secret, TEXTS)
    error = F.coalesce(F.col("secret"), validation_error())
    checked = materialize(clean.withColumns({"error": error, "fingerprint": T.fingerprint(*[F.col(c) for c in ("task_type", "kind", "title", "learned")])}), "checked-requests")
    none = F.lit(None).cast("string")
    bad = checked.where("error IS NOT NULL").select("id", F.lit("invalid").alias("status"), none.alias("matched_id"), "error", "redactions", none.alias("slug_hint"))
    fine = checked.where("error IS NULL")
    exact = exact_duplicates(fine)
    exact = materialize(exact, "exact-duplicates")
    near = dedupe.near_duplicates(fine, threshold, exact.where("status = 'saved'")).select("id", F.col("matched_id").alias("near_id"))
    told = exact.join(near, "id", "left").join(fine.select("id", "task_type", "redactions"), "id")
    status = F.when(F.col("near_id").isNotNull(), "near_duplicate").otherwise(F.col("status"))
    told = told.withColumn("status", status).join(slug_near_misses(fine).select("task_type", "other"), "task_type", "left")
    hint = F.when(F.col("status") == "saved", F.col("other")).alias("slug_hint")
    return bad.unionByName(told.select("id", "status", F.coalesce("near_id", "matched_id").alias("matched_id"), none.alias("error"), "redactions", hint))
