"""Secret scans over a trigram inverted index of the texts. All DataFrame code.

The index holds a posting (hash of a trigram, key of a row) for every trigram of every lower-cased text. It
is made once, without knowledge of any rule, in segments: each task writes the postings of its own texts,
sorted by trigram, so that nothing is shuffled and a lookup skips what it doesn't ask for. It lies in a
folder and answers rules that are added later. Each rule's expression yields a Boolean trigram query
(trigrams.py). The postings of a clause are intersected by a bit mask a row; rows that fulfil a clause are
the rule's candidates, whose texts alone are searched with the expression itself. Rules without mandatory
trigrams read every text. Matches are leftmost and do not overlap within a rule; positions count code points.

Rows are known by two hashes of id and text, so that repeated or null ids do no harm; hashes of trigrams
may collide, which adds candidates and loses none.

Defined cases: a null text is empty, and an empty text has no spans; null ids stay null; repeated rows
give repeated results; an empty table gives no rows; long texts are indexed in overlapping parts and
searched whole; columns other than id and text are not read, and redact hands all of them on whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import listed, narrow, scratch, stage, wrapped
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """group and least: matches whose group is shorter than least are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


# The expressions that the contract names. A shorter run of a class can't hold a longer
# one, so the least length of access and hex stands in the expression.
_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# A PEM key runs through its body to the END line. Where END is missing it runs to the last long base64 run
# and a short last line. Bodies of any length are single character classes, as Java recurses on repeated
# groups of varying length; lines that start with a dash (of a diff) are free in number in the usual widths
# of 64, 70 and 76, and otherwise counted, as header fields are.
_BASE64 = "A-Za-z0-9+/="
_BODY = rf"""[{_BASE64}\t\n\r\x20\\"'>#*|,:]"""
_BREAK = r"""[\t\n\r\x20nr\\"'>#*|,+]"""
_DASHED = "".join(rf"(?:-[{_BASE64}]{{{n}}}{end})*" for n in (64, 70, 76) for end in (r"\n", r"\r\n"))
_INNER = rf"{_BODY}*{_DASHED}(?:-{_BODY}+){{0,200}}"
_END = r"-{5,6}END [A-Z ]{0,40}PRIVATE KEY-----"
_FIELDS = rf"(?:{_BREAK}*[A-Z][A-Za-z]*-[A-Za-z]+:\x20?[A-Za-z0-9,-]+){{0,8}}"
_LAST = rf"""(?:(?:\r?\n|(?:\\r)?\\n)[\t\x20>#*|"']*-?(?:[{_BASE64}]*[0-9+/=][{_BASE64}]*|[A-Za-z]+(?:[\n\r"'\\]|$)))?"""
_OPEN = rf"{_FIELDS}{_BREAK}*-?[{_BASE64}]{{16,}}(?:{_INNER}[{_BASE64}]{{20,}})?{_LAST}"
# Further kinds of secrets with published formats.
MORE = (
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_INNER}{_END}|{_OPEN})?"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


#: Code points of a part of a text whose trigrams are taken together; parts overlap by two.
PART = 1 << 16
#: Code points of the pieces that a text is cut into before stretches of it are put together.
PIECE = 1 << 10


def _keys(number, text) -> tuple:
    return F.xxhash64(number, text).alias("key"), F.hash(text, number).alias("check")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, id_col, text_col).select("doc_id", *_keys(F.col("doc_id"), F.col("text")), "text")


@dataclass(frozen=True)
class TrigramIndex:
    """rows (doc_id, key, check: a row for each row of the table) and postings (trigram, key)."""

    rows: DataFrame
    postings: DataFrame


def read_index(spark: SparkSession, path: str) -> TrigramIndex:
    return TrigramIndex(spark.read.schema("doc_id long, key long, check int").parquet(f"{path}/rows"), spark.read.schema("trigram int, key long").parquet(f"{path}/postings"))


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TrigramIndex:
    """The index of docs, written to `path` (else to the shared folder)."""
    path = path or scratch(docs.sparkSession, "trigrams")
    own = _keyed(docs, id_col, text_col)
    own.select("doc_id", "key", "check").write.parquet(f"{path}/rows")
    parts = own.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=(.{{1,{PART + 2}}})).{{1,{PART}}}"), F.lit(1))).alias("part"))
    held = parts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("part", F.lit("(?s)(?=(...))"), F.lit(1)))).alias("trigram"))
    held.select(F.hash("trigram").alias("trigram"), "key").sortWithinPartitions("trigram").write.parquet(f"{path}/postings")
    return read_index(docs.sparkSession, path)


def candidates(index: TrigramIndex, rules=RULES) -> DataFrame:
    """(key, kind): rows that fulfil a clause of a rule that has clauses."""
    spark = index.rows.sparkSession
    asked = [(r.kind, n, t, i, len(clause)) for r in rules for n, clause in enumerate(trigram_query(r.pattern)) for i, t in enumerate(sorted(clause))]
    clauses = spark.createDataFrame(asked, "kind string, clause int, text string, bit int, bits int")  # as large as the rules
    clauses = clauses.select("kind", "clause", F.hash("text").alias("trigram"), "bit", "bits")
    wanted = sorted({x["trigram"] for x in clauses.collect()})
    held = index.postings.filter(F.col("trigram").isin(wanted)).join(F.broadcast(clauses), "trigram").groupBy("key", "kind", "clause", "bits")
    met = held.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).filter(F.bit_count("mask") == F.col("bits"))
    return met.select("key", "kind").distinct()


def scan(docs: DataFrame, index: TrigramIndex, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, check, kind, start, end: every span of every rule, in the texts of docs that `index` was built on."""
    own = _keyed(docs, id_col, text_col).select("key", "check", "text")
    found = stage(candidates(index, rules), "candidates")
    rows = listed(own, found, "key")[1].join(found.hint("merge"), "key")
    for rule in rules:
        if not trigram_query(rule.pattern):
            rows = rows.unionByName(own.filter(F.col("text").rlike(rule.pattern)).withColumn("kind", F.lit(rule.kind)))

    def by_rule(make):
        out = F
        for rule in rules:
            out = out.when(F.col("kind") == rule.kind, make(rule))
        return out

    every = lambda rule, group: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))
    cut = rows.select("key", "check", "kind", by_rule(lambda r: F.split("text", r.pattern, -1)).alias("between"), by_rule(lambda r: every(r, 0)).alias("found"), by_rule(lambda r: every(r, r.group)).alias("part"))
    lengths = F.arrays_zip(*(F.transform(c, F.length).alias(c) for c in ("between", "found", "part")))
    each = cut.select("key", "check", "kind", F.posexplode(lengths).alias("nth", "x")).select("key", "check", "kind", "nth", *(F.col("x")[c].alias(c) for c in ("between", "found", "part"))).distinct()
    until = Window.partitionBy("key", "check", "kind").orderBy("nth")
    placed = each.withColumn("end", F.sum(F.col("between") + F.coalesce("found", F.lit(0))).over(until)).filter("found IS NOT NULL")
    least = by_rule(lambda r: F.lit(r.least))
    return placed.filter(F.col("part") >= least).select("key", "check", "kind", (F.col("end") - F.col("found")).alias("start"), "end")


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", index: TrigramIndex | None = None) -> DataFrame:
    """doc_id, key, check, spans array<struct<start, order, kind, end>>: a row for each row of docs; spans by
    start, then by the rules' order. index: of these docs, if there is one."""
    index = index or build_index(docs, None, id_col, text_col)
    order = F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i))), F.col("kind"))
    spans = scan(docs, index, rules, id_col, text_col).withColumn("order", order)
    by_row = spans.groupBy("key", "check").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("spans"))
    rows = index.rows.join(by_row, ["key", "check"], "left")
    empty = F.array().cast("array<struct<start: bigint, order: int, kind: string, end: bigint>>")
    return rows.select("doc_id", "key", "check", F.coalesce("spans", empty).alias("spans"))


def stretches(spans: DataFrame) -> DataFrame:
    """(key, check, gaps, tail): the stretches of a row's text before each span (overlapping ones are one
    span), as an array of (low, high) in order, and where the text behind the last one starts."""
    row = Window.partitionBy("key", "check")
    earlier = F.max("end").over(row.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.coalesce(F.col("start") >= earlier, F.lit(True)).cast("int"))
    numbered = marked.withColumn("nth", F.sum("opens").over(row.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "check", "nth").agg(F.min("start").alias("high"), F.max("end").alias("end"))
    gaps = whole.withColumn("low", F.lag("end", 1, 0).over(row.orderBy("nth")))
    return gaps.groupBy("key", "check").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("gaps"), F.max("end").alias("tail"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span (overlapping ones together) replaced by `mark`; its columns and rows as they are.

    A text is cut into small pieces once, and each stretch is put together from those it touches, so the time
    is linear in the text however many spans it has."""
    found = stage(stretches(scan(docs, build_index(docs, None, id_col, text_col), rules, id_col, text_col)), "stretches")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    clear, doubtful = listed(wrapped(docs, *_keys(F.col(id_col).cast("long"), text)), found, "key", "check")
    both = doubtful.join(found.hint("merge"), ["key", "check"], "left")
    whole = F.col("row").getField(text_col)
    parts = F.struct(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), "gaps", "tail", F.length(whole).cast("long").alias("size"))

    def stretch(s, low, high):
        first, last = F.floor(low / PIECE).cast("int"), F.ceil(high / PIECE).cast("int")
        joined = F.array_join(F.slice(s["pieces"], first + 1, last - first), "")
        return F.when(low < high, F.substring(joined, (low - first * PIECE).cast("int") + 1, (high - low).cast("int"))).otherwise("")

    def cleaned(s):  # an array of one struct, so that the pieces are made once a row and not once a stretch
        return F.array_join(F.concat(F.transform(s["gaps"], lambda g: stretch(s, g["low"], g["high"])), F.array(stretch(s, s["tail"], s["size"]))), mark)

    new = F.when(F.col("gaps").isNull(), whole).otherwise(F.transform(F.array(parts), cleaned)[0])
    names = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return clear.select("row.*").union(both.select(*names))


def op7(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB's SQL of op7: the same expressions over every text, without an index."""
    parts = []
    for order, rule in enumerate(RULES):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT row_id, '{rule.kind}' AS kind, {order} AS ord, {rule.least} AS least, unnest(range(1, len(found) + 1)) AS nth, unnest(found) AS m, unnest(part) AS g, between
  FROM (SELECT row_id, regexp_extract_all(text, {p}, 0) AS found, regexp_extract_all(text, {p}, {rule.group}) AS part, string_split_regex(text, {p}) AS between FROM d)
  WHERE len(found) > 0""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT row_id, kind, ord, least, length(m) AS m, length(g) AS g, sum(length(between[nth]) + length(m)) OVER (PARTITION BY row_id, kind ORDER BY nth) AS stop
  FROM hits
),
spans AS (SELECT row_id, kind, ord, stop - m AS start, kind || ':' || CAST(stop - m AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE g >= least),
by_row AS (
  SELECT row_id, {counts}, string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY row_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (row_id)
"""
