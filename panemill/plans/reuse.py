"""What can be shared: pane sizes as data, and the reuse analysis of a query log.

A query log is (query_id, consumer_id, query_text).  Texts repeat, so what is read from a text is worked out once for each different one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panemill.functions.tables import written
from panemill.operators.relational import enrich

# Words that the canonical text has in upper case, constructs that rule out sharing of pane states, and the forms of prefixes, aggregates and windows.
KEYWORDS = ("select", "from", "named window", "on stream", "range", "step", "where", "window", "union", "as", "avg", "sum", "count", "min", "max")
REFUSED = r"(?i)\b(FILTER|HAVING|UNION|JOIN|GROUP\s+BY|ORDER\s+BY|DISTINCT|OPTIONAL)\b"
PREFIX = r"(?i)PREFIX\s+([A-Za-z][\w-]*:)\s*<([^>]+)>"
AGGREGATE = r"(?i)\b(AVG|SUM|COUNT|MIN|MAX)\s*\(\s*(\?\w+|\*)\s*\)\s+AS\s+(\?\w+)"
DECLARED = r"(?i)FROM\s+NAMED\s+WINDOW\s+(\S+)\s+ON\s+STREAM\s+(\S+)\s*\[\s*RANGE\s+(\d+)\s+STEP\s+(\d+)\s*\]"


def gcd_column(values: Column) -> Column:
    """Greatest common divisor of an array of positive longs; 1 for an empty one."""
    one = F.lit(1).cast("long")
    # Euclid's steps on pairs: 93 are enough for 64-bit numbers.
    step = lambda p, _: F.when(p.b == 0, p).otherwise(F.struct(p.b.alias("a"), (p.a % F.when(p.b == 0, one).otherwise(p.b)).alias("b")))
    pair = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(93)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, lambda p: p.a)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("long"), lambda g, x: pair(x, g))).otherwise(one)


def lcm_column(values: Column) -> Column:
    """Least common multiple of an array of positive longs; 1 for an empty one."""
    one = F.lit(1).cast("long")
    return F.aggregate(values, one, lambda m, x: (m / gcd_column(F.array(m, x.cast("long")))).cast("long") * x)


def canonical_text(text: Column) -> Column:
    """The text as equal queries share it.

    Comments and the consumer's own registration go; prefixes come first, sorted, their labels in lower case; blanks are single, and none stand
    around brackets, commas, semicolons and IRIs; keywords are in upper case.
    """
    bare = F.regexp_replace(text, r"(?m)(^|[\t ])#.*$", "$1")
    labels, iris = (F.regexp_extract_all(bare, F.lit(PREFIX), F.lit(k)) for k in (1, 2))
    prefixes = F.array_sort(F.zip_with(labels, iris, lambda label, iri: F.struct(F.lower(label).alias("label"), iri.alias("iri"))))
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, PREFIX, " "), r"\s+", " "))
    body = F.regexp_replace(body, r"(?i)^(.*?)REGISTER\s+RSTREAM\s+<[^>]+>\s+AS\s+", "$1")
    body = F.regexp_replace(body, r"\s*([\[\]{}(),;<>])\s*", "$1")
    for word in KEYWORDS:
        body = F.regexp_replace(body, rf"(?i)\b{word}\b", word.upper())
    return F.trim(F.concat_ws(" ", F.array_join(F.transform(prefixes, lambda p: F.concat(F.lit("PREFIX "), p.label, F.lit(" <"), p.iri, F.lit(">"))), " "), F.trim(body)))


def by_text(log: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The log with what ``read`` adds to a table of its different texts."""
    texts = written(read(log.select("query_text").where("query_text is not null").distinct()), "texts")
    return enrich(log, texts, ["query_text"], "left")


def _canonical(texts: DataFrame) -> DataFrame:
    return texts.withColumn("canonical_text", canonical_text(F.col("query_text"))).withColumn("canonical_hash", F.sha2("canonical_text", 256))


def canonical(log: DataFrame) -> DataFrame:
    """Adds canonical_text and canonical_hash."""
    return by_text(log, _canonical)


def exact_reuse(log: DataFrame) -> DataFrame:
    """canonical_hash, consumers, hits: how often a text could be served by a result that is there."""
    return canonical(log).groupBy("canonical_hash").agg(F.count(F.lit(1)).alias("consumers")).withColumn("hits", F.col("consumers") - 1)


def query_signature(log: DataFrame) -> DataFrame:
    """Candidates for sharing have the same aggregates, form and output mode."""
    family = F.array_join(F.array_distinct(F.array_sort(F.transform(F.regexp_extract_all("query_text", F.lit(r"(?i)\b(AVG|SUM|COUNT|MIN|MAX)\s*\("), F.lit(1)), F.upper))), ",")
    form = F.upper(F.regexp_extract("query_text", r"(?i)\b(SELECT|CONSTRUCT|ASK|DESCRIBE)\b", 1))
    mode = F.upper(F.regexp_extract("query_text", r"(?i)\b(RSTREAM|ISTREAM|DSTREAM)\b", 1))
    return log.select("query_id", "consumer_id", family.alias("aggregates"), form.alias("form"), F.when(mode == "", "RSTREAM").otherwise(mode).alias("output"))


def expanded_term(term: Column, labels: Column, iris: Column) -> Column:
    """A term without its brackets, or with its prefix (labels end with a colon) replaced by what that stands for; else as it is."""
    label = F.regexp_extract(term, r"^([A-Za-z][\w-]*:)(.+)$", 1)
    at = F.array_position(labels, label)
    full = F.concat(F.try_element_at(iris, at.cast("int")), F.regexp_extract(term, r"^([A-Za-z][\w-]*:)(.+)$", 2))
    return F.when(term.rlike("^<.*>$"), F.regexp_replace(term, "^<|>$", "")).when((label != "") & (at > 0), full).otherwise(term)


def declarations(text: Column) -> Column:
    """Array of the windows that a text declares: window_name, stream, range_ms, step_ms, in order, prefixes expanded."""
    labels, iris = (F.regexp_extract_all(text, F.lit(PREFIX), F.lit(k)) for k in (1, 2))
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(DECLARED), F.lit(k)).alias(f"d{k}") for k in (1, 2, 3, 4)))
    return F.transform(
        parts,
        lambda d: F.struct(
            expanded_term(d["d1"], labels, iris).alias("window_name"),
            expanded_term(d["d2"], labels, iris).alias("stream"),
            d["d3"].cast("long").alias("range_ms"),
            d["d4"].cast("long").alias("step_ms"),
        ),
    )


def window_declarations(log: DataFrame) -> DataFrame:
    """A row for each different window that a query declares: window_name, stream (with its host and topic, as parts of a URL), range_ms, step_ms."""
    rows = log.select("query_id", F.explode(declarations(F.col("query_text"))).alias("d")).select("query_id", "d.*").distinct()
    return rows.withColumn("host", F.try_parse_url("stream", F.lit("HOST"))).withColumn("topic", F.regexp_replace(F.try_parse_url("stream", F.lit("PATH")), "^/+", ""))


def window_sets(log: DataFrame) -> DataFrame:
    """Adds window_set, the sorted declarations of a query as text; null if it declares none.  Only queries of equal sets may share a final result."""
    each = F.transform(declarations(F.col("query_text")), lambda d: F.concat_ws("|", d["window_name"], d["stream"], d["range_ms"], d["step_ms"]))
    return log.withColumn("window_set", F.nullif(F.array_join(F.array_sort(each), "\n"), F.lit("")))


def _classified(texts: DataFrame) -> DataFrame:
    declared = F.regexp_extract_all("query_text", F.lit(DECLARED), F.lit(0))
    aggregate = lambda k: F.regexp_extract_all("query_text", F.lit(AGGREGATE), F.lit(k))
    values = F.array_remove(F.array_distinct(aggregate(2)), "*")
    names = F.array_distinct(F.transform(aggregate(1), F.upper))
    calls = F.regexp_count("query_text", F.lit(r"(?i)\b(AVG|SUM|COUNT|MIN|MAX)\s*\("))
    terms = F.size(aggregate(0))
    reason = (
        F.when(F.regexp_like("query_text", F.lit(REFUSED)), "construct")
        .when(F.size(declared) != 1, "windows")
        .when(terms == 0, "aggregate")
        .when(calls != terms, "alias")
        .when(F.size(values) > 1, "variables")
        .when((F.size(values) == 0) & (F.array_except(names, F.array(F.lit("COUNT"))) != F.array().cast("array<string>")), "variables")
        .otherwise("")
    )
    window = declarations(F.col("query_text"))[0]
    pattern = F.regexp_replace("canonical_text", r"SELECT\b.*?\bFROM\b", "FROM")
    state = F.when(F.array_contains(names, "AVG"), "sum,count").otherwise(F.lower(F.array_join(F.array_sort(names), ",")))
    key = F.concat_ws("::", window["stream"], F.md5(pattern), F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("*")), state, window["range_ms"], window["step_ms"])
    return _canonical(texts).withColumn("reason", reason).withColumn("state_key", F.when(F.col("reason") == "", key))


def reuse_class(log: DataFrame) -> DataFrame:
    """Adds whether a query can be answered from shared pane states (an empty reason) or why not, and the key it shares them under: stream, digest of
    the canonical text without what it selects, variable, kept state, range and step."""
    return by_text(log, lambda texts: _classified(texts).drop("canonical_text", "canonical_hash"))


def reuse_level(log: DataFrame) -> DataFrame:
    """exact (an earlier query has the same text), chunk_state (another shares its pane states), or fresh."""
    rows = by_text(log, lambda texts: _classified(texts).select("query_text", "state_key", "canonical_hash")).select("query_id", "consumer_id", "state_key", "canonical_hash")
    exact = rows.groupBy("canonical_hash", "state_key").agg(F.min("query_id").alias("first_query"))
    # A row for each canonical text: few, and joined as a small table where a count shows it.
    shared = exact.where("state_key is not null").groupBy("state_key").agg(F.count_distinct("canonical_hash").alias("same_state"))
    exact = exact.groupBy("canonical_hash").agg(F.min("first_query").alias("first_query"))
    rows = enrich(enrich(rows, written(exact, "exact"), ["canonical_hash"], "left"), written(shared, "shared"), ["state_key"], "left")
    level = F.when(F.col("query_id") != F.col("first_query"), "exact").when(F.col("same_state") > 1, "chunk_state").otherwise("fresh")
    return rows.select("query_id", "consumer_id", level.alias("level"))


def query_complexity(text: Column) -> Column:
    """1 + 2 an aggregate + 3 a join + 1 a filter + 2 a window, 10 at most."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    score = 1 + 2 * n(r"(?i)\b(AVG|SUM|COUNT|MIN|MAX)\b") + 3 * n(r"(?i)\bJOIN\b") + n(r"(?i)\bFILTER\b") + 2 * n(r"(?i)\bWINDOW\b")
    return F.least(F.lit(10), score).cast("long")


def reuse_density(log: DataFrame) -> DataFrame:
    """dependencies of queries on producers (declared windows), unique producers, and the share that is reused; null for a log without windows."""
    rows = window_declarations(log)
    out = rows.agg(F.count(F.lit(1)).alias("dependencies"), F.count_distinct("stream", "range_ms", "step_ms").alias("producers"))
    return out.withColumn("reused_share", F.try_divide(F.col("dependencies") - F.col("producers"), "dependencies"))
