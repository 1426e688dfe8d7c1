"""Observations from tables, N-Triples text, result messages and log lines, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panemill.functions.tables import numbered
from panemill.functions.time import finite

# The predicates of the public vocabularies that an observation is written with.
PREDICATES = {
    "dataset": "http://rdfs.org/ns/void#inDataset",
    "sensor": "https://saref.etsi.org/core/measurementMadeBy",
    "kind": "http://purl.org/dc/terms/isVersionOf",
    "property": "https://saref.etsi.org/core/relatesToProperty",
    "ts": "https://saref.etsi.org/core/hasTimestamp",
    "value": "https://saref.etsi.org/core/hasValue",
}
XSD = "http://www.w3.org/2001/XMLSchema#"
# The terms of the N-Triples format.
_POINT = r"u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}"
# Runs of plain characters and single escapes take turns and are never given back: no stack a character, however long the term is.
_IRI = rf'<[^\x00-\x20<>"{{}}|^`\\]*+(?:\\(?:{_POINT})[^\x00-\x20<>"{{}}|^`\\]*+)*+>'
_BLANK = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-\u00B7]*[\p{L}\p{N}_\-\u00B7])?"
_STRING = rf'"[^"\\\r\n]*+(?:\\(?:[tbnrf"\'\\]|{_POINT})[^"\\\r\n]*+)*+"'
_TAG = r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"
#: Subject, predicate, object and its datatype or language; or a comment, to the end of its line.
_TRIPLE = rf"({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_STRING}(?:\s*\^\^\s*{_IRI}|{_TAG})?)\s*\."
_PART = rf"(?:{_TRIPLE}|#[^\r\n]*)"
#: What the pattern's \s matches.
_SPACE = " \t\n\x0b\f\r"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'"}


def observations(spark: SparkSession, path: str) -> DataFrame:
    """event_id, stream, sensor, ts, ms, value, props of an events table; values that are not finite are null."""
    events = spark.read.parquet(path)
    ts = F.col("ts").cast("timestamp")  # stored without a zone: taken as UTC, the session's zone
    value = finite(F.col("value"))
    rows = events.select("event_id", F.col("event_type").alias("stream"), F.col("user_id").alias("sensor"), ts.alias("ts"), value.alias("value"), "props")
    return rows.where("ts is not null").withColumn("ms", F.unix_millis("ts"))


def _triples(base: str) -> Column:
    """Array of the three triples of an observation: s, p, o, o_type."""
    s = F.concat(F.lit(base), F.col("event_id"))
    parts = [
        ("property", F.concat(F.lit("urn:stream:"), F.col("stream")), "iri"),
        ("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "dateTime"),
        ("value", F.col("value").cast("string"), "double"),
    ]
    return F.array(*(F.struct(s.alias("s"), F.lit(PREDICATES[p]).alias("p"), o.alias("o"), F.lit(kind).alias("o_type")) for p, o, kind in parts))


def to_triples(obs: DataFrame, base: str = "urn:obs:") -> DataFrame:
    """s, p, o, o_type: three triples for each observation."""
    return obs.select(F.explode(_triples(base)).alias("t")).select("t.*")


def to_lines(obs: DataFrame, base: str = "urn:obs:") -> DataFrame:
    """Text lines of N-Triples, one for each observation, without a shuffle."""
    return obs.select(F.array_join(F.transform(_triples(base), lambda t: triple_line(t.s, t.p, t.o, t.o_type)), " ").alias("value"))


def unescaped(text: Column) -> Column:
    """A term's text without escapes.

    Escaped backslashes part the text first; within a part every backslash begins an escape, of one letter or of a code point.
    """
    point = lambda piece, n: F.concat(F.decode(F.unhex(F.lpad(F.substring(piece, 2, n), 8, "0")), "UTF-32"), F.substring(piece, n + 2, 1 << 30))

    def piece(x: Column, k: Column) -> Column:
        kind = F.substring(x, 1, 1)
        letter = F.coalesce(*(F.when(kind == F.lit(c), F.lit(v)) for c, v in ESCAPES.items()))
        made = F.when(kind == "u", point(x, 4)).when(kind == "U", point(x, 8)).otherwise(F.concat(letter, F.substring(x, 2, 1 << 30)))
        return F.when(k == 0, x).otherwise(made)

    part = lambda x: F.array_join(F.transform(F.split(x, r"\\"), piece), "")
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")).otherwise(text)


def escaped(text: Column) -> Column:
    """A literal's text as it is written."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _node(text: Column) -> Column:
    return F.when(text.startswith("_:"), text).otherwise(F.concat(F.lit("<"), text, F.lit(">")))


def triple_line(s: Column, p: Column, o: Column, o_type: Column) -> Column:
    """A triple as text; o_type as ``parse_ntriples`` gives it."""
    quoted = F.concat(F.lit('"'), escaped(o), F.lit('"'))
    kind = F.when(o_type.startswith("@"), o_type).otherwise(F.concat(F.lit("^^<"), F.when(F.contains(o_type, F.lit(":")), o_type).otherwise(F.concat(F.lit(XSD), o_type)), F.lit(">")))
    node = F.when(o_type.isin("iri", "blank"), _node(o)).otherwise(F.concat(quoted, kind))
    return F.concat(_node(s), F.lit(" <"), p, F.lit("> "), node, F.lit(" ."))


def to_ntriples(triples: DataFrame, one_line: bool = True) -> DataFrame:
    """Text lines: all triples of a subject in one, or a line each."""
    line = triple_line(F.col("s"), F.col("p"), F.col("o"), F.col("o_type"))
    if not one_line:
        return triples.select(line.alias("value"))
    lines = triples.groupBy("s").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select(F.concat_ws(" ", "lines").alias("value"))


def parse_ntriples(lines: DataFrame, col: str = "value") -> DataFrame:
    """s, p, o, o_type of every triple of each line, in any number; comments are passed over (``rejected_ntriples`` tells what else is).

    Blank nodes begin with ``_:``; o_type is iri, blank, a language with its @, the name of a datatype of XML Schema (string where none is given), or another datatype's IRI.
    """
    # A triple that the pattern has found is cut at its first delimiters; neither IRIs, tags nor labels of blank nodes hold any.
    rest = lambda c, *before: F.btrim(F.substr(c, F.length(*before) + 1), F.lit(_SPACE))
    iri = lambda c: F.concat(F.substring_index(c, ">", 1), F.lit(">"))
    rows = lines.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(_PART), F.lit(0))).alias("triple")).where(~F.col("triple").startswith("#"))
    rows = rows.withColumn("s", F.when(F.col("triple").startswith("<"), iri(F.col("triple"))).otherwise(F.regexp_extract("triple", r"^[^\s<]+", 0)))
    rows = rows.select("s", rest(F.col("triple"), "s").alias("rest"))
    rows = rows.select("s", iri(F.col("rest")).alias("p"), "rest")
    rows = rows.select("s", "p", rest(F.col("rest"), "p").alias("o"))
    rows = rows.select("s", "p", F.btrim(F.substr("o", F.lit(1), F.length("o") - 1), F.lit(_SPACE)).alias("o"))
    # What stands after a literal's last quote is its language or its datatype.
    rows = rows.select("s", "p", "o", F.when(F.col("o").startswith('"'), F.substring_index("o", '"', -1)).alias("after"))
    inner = lambda c: F.when(c.startswith("<"), unescaped(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    text = F.substr("o", F.lit(2), F.length("o") - F.length("after") - 2)
    kind = F.substring_index(F.substring_index("after", "<", -1), ">", 1)
    rows = rows.select("s", "p", "o", "after", F.when(F.col("after").isNotNull(), text).alias("text"), kind.alias("kind"))
    own = F.substring("kind", len(XSD) + 1, 1 << 30)
    named = F.when(F.col("after").startswith("@"), F.col("after")).when(F.col("kind") == "", "string").when(F.col("kind").startswith(XSD), own).otherwise(unescaped(F.col("kind")))
    is_text = F.col("after").isNotNull()
    return rows.select(
        inner(F.col("s")).alias("s"),
        inner(F.col("p")).alias("p"),
        F.when(is_text, unescaped(F.col("text"))).otherwise(inner(F.col("o"))).alias("o"),
        F.when(is_text, named).when(F.col("o").startswith("<"), "iri").otherwise("blank").alias("o_type"),
    )


def rejected_ntriples(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines, all columns, that hold anything but triples and comments, and what that is (``rest``)."""
    rest = F.trim(F.regexp_replace(F.col(col), _PART, " "))
    return lines.withColumn("rest", rest).where(F.regexp_replace("rest", r"\s+", "") != "")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def pivot_observations(triples: DataFrame) -> DataFrame:
    """A row for each subject: subject, property, ms, value.  One shuffle, whatever the number of predicates."""
    of = lambda p: F.max(F.when(F.col("p") == PREDICATES[p], F.col("o")))
    rows = triples.groupBy(F.col("s").alias("subject")).agg(of("property").alias("property"), of("ts").alias("at"), of("value").alias("v"))
    return rows.select("subject", "property", F.unix_millis(F.try_to_timestamp("at")).alias("ms"), F.col("v").try_cast("double").alias("value"))


RESULT = T.StructType(
    [
        T.StructField("window", T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        *(T.StructField(n, T.LongType()) for n in ("window_start", "window_end")),
        *(T.StructField(n, T.DoubleType()) for n in ("value", "resultValue", "avg", "sum", "min", "max")),
        T.StructField("count", T.LongType()),
    ]
)


def parse_result_messages(messages: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Results of JSON messages of either shape (nested or flat bounds; the value under one of several names), and the rest."""
    m = F.from_json(col, RESULT)
    rows = messages.withColumn("m", m)
    rows = rows.select(
        *messages.columns,
        F.coalesce("m.window.start", "m.window_start").alias("start_ms"),
        F.coalesce("m.window.end", "m.window_end").alias("end_ms"),
        F.coalesce("m.value", "m.resultValue", "m.avg", "m.sum", "m.min", "m.max").alias("value"),
        F.col("m.count").alias("count"),
    )
    good = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & F.col("value").isNotNull() & (F.col("end_ms") > F.col("start_ms"))
    return rows.where(good), rows.where(~good).select(*messages.columns)


def to_result_json(states: DataFrame, compact: bool = False) -> DataFrame:
    """topic, payload: pane states as messages; the compact form drops what can be derived.

    A state claims to be temporally complete only if it has ``coverage_origin`` and ``input_watermark``, and they enclose it.
    """
    window = F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    fields = [window.alias("window"), "count", "sum"]
    if not compact:
        width = F.col("end_ms") - F.col("start_ms")
        known = {"coverage_origin", "input_watermark"} <= set(states.columns)
        whole = F.coalesce((F.col("coverage_origin") <= F.col("start_ms")) & (F.col("input_watermark") >= F.col("end_ms")), F.lit(False)) if known else F.lit(False)
        fields += ["min", "max", F.try_divide("sum", "count").alias("avg"), F.col("stream").alias("source_stream"), width.alias("range"), whole.alias("temporally_complete")]
    return states.select(F.col("stream").alias("topic"), F.to_json(F.struct(*fields)).alias("payload"))


def extract_log_rows(lines: DataFrame, patterns: Mapping[str, Sequence[str]], col: str = "value") -> DataFrame:
    """For each field the first group of the first of its patterns that is found in the line; null if none is."""
    found = {name: F.coalesce(*(F.nullif(F.regexp_extract(col, p, 1), F.lit("")) for p in several)) for name, several in patterns.items()}
    return lines.withColumns(found)


def domain_filter(obs: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """Observations within [lo, hi], and by stream how many were kept and rejected."""
    inside = F.coalesce(F.col("ms").between(lo, hi), F.lit(False))
    return obs.where(inside), obs.groupBy("stream").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("rejected"))


def downsample(obs: DataFrame, interval_ms: int, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """The first observation of each interval since the key's first; all of them where gaps are as wide already.

    The smallest gap is found from neighbours within intervals and their edges, the first time by an aggregate, so a
    busy key is not sorted in one task.
    """
    first = obs.groupBy(*keys).agg(F.min("ms").alias("first_ms"))
    rows = obs.join(first, list(keys)).withColumn("bucket", F.floor((F.col("ms") - F.col("first_ms")) / interval_ms))
    kept = rows.groupBy(*keys, "bucket").agg(F.min_by(F.struct("event_id", "ms", "value"), F.struct("ms", "event_id")).alias("o"), F.count_distinct("ms").alias("times"), F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    # A positive gap below the interval lies within a bucket or between the ends of two neighbouring ones.
    edge = kept.select(*keys, (F.col("bucket") + 1).alias("bucket"), F.col("hi").alias("before"))
    dense = kept.join(edge, [*keys, "bucket"], "left").groupBy(*keys).agg(F.max((F.col("times") > 1) | F.coalesce(F.col("lo") - F.col("before") < interval_ms, F.lit(False))).alias("dense"))
    sampled = kept.join(dense.where("dense"), list(keys)).select(*keys, "o.event_id", "o.ms", "o.value")
    return sampled.unionByName(obs.join(dense.where("not dense"), list(keys)).select(*keys, "event_id", "ms", "value"))


def rebase(obs: DataFrame, base_ms: int, loops: int, keys: Sequence[str] = ("stream",), gap_ms: int = 1) -> DataFrame:
    """Observations moved to start at base_ms and played ``loops`` times, each loop after the one before."""
    span = obs.groupBy(*keys).agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    rows = obs.join(span, list(keys)).withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    length = F.col("last_ms") - F.col("first_ms") + gap_ms
    return rows.withColumn("ms", F.lit(base_ms) + F.col("loop") * length + F.col("ms") - F.col("first_ms")).drop("first_ms", "last_ms")


def _uniform(key: Column) -> Column:
    """A number between 0 and 1 from the first 32 bits of a text's digest."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def add_noise(rows: DataFrame, col: str, sigmas: Sequence[float], seed: int = 0, id_col: str = "event_id") -> DataFrame:
    """A row for each sigma, with normal noise of that spread added.

    The noise is a function of the seed, the row's id and the place of the sigma, so it is the same however rows are partitioned.
    """
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, sigmas))).alias("_nth", "sigma"))
    key = lambda part: F.concat_ws(":", F.lit(seed), F.col(id_col), F.col("_nth"), F.lit(part))
    normal = F.sqrt(-2 * F.log(_uniform(key("r")))) * F.cos(2 * F.pi() * _uniform(key("a")))
    return rows.withColumn(col, F.col(col) + F.col("sigma") * normal).drop("_nth")


def write_sorted(obs: DataFrame, path: str, order: Sequence[str] = ("ms", "event_id")) -> None:
    """Writes observations in the order of time: files by ranges, rows in order within each.  No task sorts more than its range."""
    obs.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def in_order(obs: DataFrame, order: Sequence[str] = ("ms", "event_id")) -> DataFrame:
    """Adds place: the number of each observation in the order of time over all streams."""
    return numbered(obs, [], order)
