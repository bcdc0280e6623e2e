"""Text functions as native columns. Word and space classes are ASCII and spelled out: Java's ``\\s`` takes one character more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\t\n\f\r ]+"
NOT_WORD = r"[^0-9A-Za-z_\t\n\f\r \-]"


def trimmed(text: Column) -> Column:
    """Without white space on either side; Spark's own trim takes spaces alone."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\x85\xa0"))


def words(text: Column, instead: str) -> Column:
    """Lower-cased words; characters outside word, space and hyphen are replaced."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), NOT_WORD, instead), BLANK, " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def normalized(text: Column) -> Column:
    """sorted words with repeats, punctuation deleted."""
    return F.array_join(F.array_sort(words(text, "")), " ")


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the normalized fields."""
    return F.sha2(normalized(F.concat_ws(" ", *fields)), 256)


def _long(w: Column) -> Column:
    return F.octet_length(w) > 2


def tokens(text: Column) -> Column:
    """distinct words of three bytes or more in order of first occurrence, punctuation as space."""
    return F.array_distinct(F.filter(words(text, " "), _long))


def search_terms(text: Column) -> Column:
    """like ``tokens`` with punctuation deleted."""
    return F.array_distinct(F.filter(words(text, ""), _long))


def capped(terms: Column, most: int = 100) -> Column:
    """beyond ``most`` terms the longest stay, equal lengths by name."""
    longest = F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.octet_length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    return F.when(F.size(terms) > most, F.slice(longest, 1, most)).otherwise(terms)


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def overlap(query: Column, text: Column) -> Column:
    """F8: share of the query's distinct tokens that the text has; 0 without any."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, text)) / F.size(query))


def phrases(query: Column) -> Column:
    """pieces between blanks, repeats kept."""
    return F.filter(F.split(query, BLANK), lambda p: p != "")


def symbol_terms(query: Column) -> Column:
    """pieces of letters, digits and underscore, of two bytes or more."""
    return F.filter(F.split(query, r"[^\p{L}\p{Nd}_]+"), lambda p: F.octet_length(p) >= 2)


def composite(bm25: Column, shared: Column, weight: float = 2.0) -> Column:
    """lower is better."""
    return bm25 - weight * shared


def snippet(text: Column, most: int = 120, back: int = 60) -> Column:
    """at most ``most`` characters, cut back to the last space if that lies beyond ``back`` bytes, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, BLANK, " "))
    cut = F.substring(flat, 1, most)
    head = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    at = F.when(cut.contains(" "), F.octet_length(head)).otherwise(-1)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.when(at > back, head).otherwise(cut), F.lit("…")))


def needs_review(review_after: Column, now: int) -> Column:
    """strictly past."""
    return F.coalesce(review_after < now, F.lit(False))


def slug(task_type: Column) -> Column:
    """F14."""
    return F.translate(F.lower(task_type), "_", "-")


def valid_task_type(task_type: Column) -> Column:
    """after trim and lower-casing; 64 bytes at most."""
    t = F.lower(trimmed(task_type))
    return t.rlike(r"\A[a-z0-9][a-z0-9._-]*\z") & (F.octet_length(t) <= 64)


#: F16: bytes (fixed values).
CAPS = {"task_type": 64, "session_id": 64, "title": 200, "what": 8192, "learned": 4096, "tags": 500}


def over_cap() -> Column:
    """The first field over its cap, in order; null if none."""
    return F.coalesce(*[F.when(F.octet_length(f) > n, F.lit(f)) for f, n in CAPS.items()])


def empty_after_scrub(text: Column) -> Column:
    """nothing but bracket tokens and blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[A-Z_]+\]", ""), BLANK, " ")) == ""


def entropy(text: Column) -> Column:
    """Shannon bits a character; 0 for empty text. Sorted characters give run lengths without a shuffle."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    runs = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.size(chars) == 0, 0.0).otherwise(F.aggregate(runs, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def valid_ipv4(text: Column) -> Column:
    """four parts of 0 to 255."""
    parts = F.split(text, r"\.")
    fine = F.forall(parts, lambda p: p.rlike(r"\A[0-9]+\z") & (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).try_cast("int"), F.lit(999)) <= 255))
    return (F.size(parts) == 4) & fine


def minted(prefix: str, *fields: Column) -> Column:
    """an id that reruns agree on."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, 26))


def event_name(name: Column) -> Column:
    """F21."""
    return F.translate(F.lower(name), "-_", "")


FILE_TOOLS = ("Read", "Edit", "Write", "MultiEdit", "NotebookEdit")


def hook_path(tool: Column, file_path: Column, notebook_path: Column) -> Column:
    """F22."""
    return F.when(tool.isin(*FILE_TOOLS), F.coalesce(F.nullif(file_path, F.lit("")), F.nullif(notebook_path, F.lit(""))))


def safe_session(session: Column) -> Column:
    """null where it is no safe id."""
    s = trimmed(session)
    return F.when(s.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), s)


def short_package(package: Column, module: str) -> Column:
    """without the module prefix; the root is its last segment."""
    return F.when(package == module, F.substring_index(F.lit(module), "/", -1)).otherwise(F.regexp_replace(package, f"^{module}/", ""))


def first_line(text: Column) -> Column:
    """F25."""
    return F.trim(F.substring_index(F.ltrim(text), "\n", 1))


def truncated(text: Column, most: int) -> Column:
    """at most ``most`` bytes, cut at a character's end, then a mark."""
    data = text.cast("binary")
    # the two hexadecimal digits of byte ``most`` - 2 and the three after; 8 to B begin the bytes inside a character
    inside = lambda i: F.substring(F.hex(F.substring(data, most - 2, 4)), 2 * i - 1, 1).isin("8", "9", "A", "B")
    keep = F.when(~inside(4), most).when(~inside(3), most - 1).when(~inside(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) > most, F.concat(F.substring(data, F.lit(1), keep).cast("string"), F.lit("…[truncated]"))).otherwise(text)


def last_name(name: Column) -> Column:
    """what follows the last dot."""
    return F.substring_index(name, ".", -1)


def is_exported(name: Column) -> Column:
    """the last name begins with an upper-case letter."""
    return last_name(name).rlike(r"\A\p{Lu}")


def older(created_at: Column, now: int, days: int) -> Column:
    """created before the cutoff of ``days`` ago."""
    return created_at < now - days * 86400


def clamp(limit: Column, default: int, most: int) -> Column:
    """a missing or non-positive limit is the default."""
    return F.least(F.when(F.coalesce(limit, F.lit(0)) <= 0, default).otherwise(limit), F.lit(most))


def type_label(name: Column) -> Column:
    """F29."""
    return F.coalesce(F.nullif(trimmed(name), F.lit("")), F.lit("untyped"))


def growth_warnings(size: Column, rows: Column) -> Column:
    """F30."""
    return F.array_compact(F.array(F.when(size > 20 * 1024 * 1024, F.lit("size")), F.when(rows > 8000, F.lit("rows"))))
