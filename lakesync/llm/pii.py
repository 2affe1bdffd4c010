"""Personal data: base patterns, and terms that give a protected entity away.

Base kinds are found by patterns, leftmost and non-overlapping per kind, then checked (parts of an ip, check digits of a
card, digits of a phone number). Each found value is a protected entity. Terms are the words of a text outside all base spans;
over the whole corpus, n(t, e) is the number of documents that hold term t and entity e, wherever they stand, and n(t) of documents
with t. A term discloses e if t leaves at most `slack_bits` of uncertainty about it, -log2(n(t, e) / n(t)), and `support` documents
show both. All occurrences of disclosing terms, in all documents, become spans of kind ``term``; `sanitise` replaces spans by their kind.

A word of digits alone is no term; any other is, from `LEAST_LETTERS` = 1 letter on. Terms with equal bits count alike: the threshold decides.
Null texts count as empty and have no spans. Rows are independent but for the counts; repeated rows count as often
as they stand, in n(t, e) as in n(t). Span offsets are code points, the end exclusive. Other columns are kept by `sanitise` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import ascii_lower, broadcast_if_small, free_names, store, words

#: Patterns that find what the plain ones in the docstrings of _KINDS find, without backing off inside runs. \G: where the last match ended.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = tuple(PATTERNS)
SUPPORT, SLACK_BITS, LEAST_LETTERS = 3, 1.0, 1
_BLOCK, _CHUNK = 64, 2_048
_LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Stands for each character of a span while words are cut. It separates words, and where a text has it, a space takes its place first.
_HIDDEN = "\x00"
#: A word that touches no span.
_CLEAR = rf"(?<!\x00)(?<!{_LETTER}){_LETTER}++(?!\x00)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For an array of ints, the fold (from 0) of all elements before each. Blocks, and blocks' totals, keep it near linear."""
    total = lambda x: F.aggregate(x, F.lit(0), fold)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    before = lambda x: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i)))
    return _let(
        blocks,
        lambda bs: _let(
            F.transform(bs, total), lambda totals: _let(before(totals), lambda starts: F.flatten(F.transform(bs, lambda x, b: F.transform(before(x), lambda v: fold(F.get(starts, b), v)))))
        ),
    )


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def _chunks(text: Column) -> Column:
    """A text in pieces of _CHUNK characters: a place in a long text is found from the start of its piece, not of the text."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _CHUNK).cast("int")), lambda c: F.substring(text, c * _CHUNK + 1, F.lit(_CHUNK)))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end."""
    inner = lambda c: F.substring(F.get(chunks, c), F.greatest(start - c * _CHUNK, F.lit(0)) + 1, F.least(end - c * _CHUNK, F.lit(_CHUNK)) - F.greatest(start - c * _CHUNK, F.lit(0)))
    whole = F.array_join(F.transform(F.sequence(F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")), inner), "")
    return F.when(end > start, whole).otherwise("")


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with put(span, reached) in place of each span; reached: where the spans before it have ended, overlapping ones included."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    done = _let(
        F.struct(order.alias("s"), _chunks(text).alias("c"), F.length(text).alias("n")),
        lambda x: _let(
            running(F.transform(x["s"], lambda s: -s["back"]), lambda a, b: F.greatest(a, b)),
            lambda reached: F.concat(
                F.array_join(F.transform(x["s"], lambda s, i: F.concat(_cut(x["c"], F.get(reached, i), s["start"]), put(s, F.get(reached, i)))), ""),
                _cut(x["c"], F.array_max(F.transform(x["s"], lambda s: -s["back"])), x["n"]),
            ),
        ),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
        octet = rf"(?=[0-9]){part}"
        return value.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    digit = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
    luhn = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0
    return F.when(F.length(digits).between(16, 19), luhn).otherwise(False)


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _find(kind: str, text: Column) -> Column:
    """Spans of one kind, in order."""
    pattern = F.lit(PATTERNS[kind])
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    span = lambda h, start: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(h)).alias("end"), h.alias("value"))
    found = _let(
        F.struct(hits.alias("h"), gaps.alias("g")),
        lambda p: _let(
            running_sums(F.zip_with(p["h"], F.slice(p["g"], F.lit(1), F.size(p["h"])), lambda h, g: F.length(g) + F.length(h))),
            lambda before: F.transform(p["h"], lambda h, i: span(h, F.get(before, i) + F.length(F.get(p["g"], i)))),
        ),
    )
    kept = F.filter(found, lambda s: _valid(kind, s["value"]))
    there = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    return F.when(there & text.rlike(PATTERNS[kind]), kept).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    return F.concat(*[_find(kind, text) for kind in KINDS])


def hide(text: Column, spans: Column) -> Column:
    """The text with _HIDDEN for each character in a span; offsets stay."""
    free = F.when(F.contains(text, F.lit(_HIDDEN)), F.translate(text, _HIDDEN, " ")).otherwise(text)
    return _rewritten(free, spans, lambda s, reached: F.repeat(F.lit(_HIDDEN), F.greatest(-s["back"] - F.greatest(s["start"], reached), F.lit(0))))


def _is_term(word: Column) -> Column:
    """With letters enough."""
    return F.length(F.translate(word, "0123456789", "")) >= LEAST_LETTERS


def terms_of(text: Column, spans: Column) -> Column:
    """The distinct words that are clear of all spans and have letters enough."""
    clear = F.when(F.size(spans) > 0, F.regexp_extract_all(ascii_lower(hide(text, spans)), F.lit(_CLEAR), F.lit(0))).otherwise(words(text))
    return F.filter(F.array_distinct(clear), _is_term)


def placed_words(text: Column, spans: Column) -> Column:
    """(word, start) of all words that may be terms."""
    return _let(
        ascii_lower(hide(text, spans)),
        lambda low: _let(
            F.struct(F.regexp_extract_all(low, F.lit(_CLEAR), F.lit(0)).alias("w"), F.split(low, _CLEAR, -1).alias("g")),
            lambda p: _let(
                running_sums(F.zip_with(p["w"], F.slice(p["g"], F.lit(1), F.size(p["w"])), lambda w, g: F.length(g) + F.length(w))),
                lambda before: F.filter(
                    F.transform(p["w"], lambda w, i: F.struct(w.alias("word"), (F.get(before, i) + F.length(F.get(p["g"], i))).alias("start"))), lambda x: _is_term(x["word"])
                ),
            ),
        ),
    )


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, spans, held: base spans, and the distinct terms of the whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("doc_key"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    return rows.select("doc_id", "doc_key", "spans", terms_of(F.col("text"), F.col("spans")).alias("held"))


def disclosing_pairs(found: DataFrame, support: int = SUPPORT, slack_bits: float = SLACK_BITS) -> DataFrame:
    """entity, term, bits: the pairs that exceed the threshold, with the information that the term leaves open."""
    most = 2.0**slack_bits  # n(t) / n(t, e) of a disclosing pair
    shown = found.select((F.size("spans") > 0).cast("long").alias("beside"), F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"), F.sum("beside").alias("n_beside"))
    # n(t, e) is at most the number of documents with t and any entity, and of those with e: no pair is lost by either bound
    able = store(shown.where((F.col("n_beside") >= support) & (F.col("n_term") <= most * F.col("n_beside"))).select("term", "n_term"), "pii-able")
    holders = found.where(F.size("spans") > 0)
    entities = holders.select("doc_id", "doc_key", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("entity"))
    known = store(entities.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "pii-known")
    # repeated rows are one row with its number, on one side of the join
    left = entities.groupBy("doc_id", "doc_key", "entity").agg(F.count("*").alias("n_rows")).join(broadcast_if_small(known), "entity")
    right = holders.select("doc_id", "doc_key", "held").dropDuplicates(["doc_id", "doc_key"]).select(F.col("doc_id").alias("t_id"), F.col("doc_key").alias("t_key"), F.explode("held").alias("term"))
    right = right.join(broadcast_if_small(able), "term")
    both = left.join(right, left.doc_id.eqNullSafe(right.t_id) & (left.doc_key == right.t_key) & (right.n_term <= most * left.n_entity))
    counted = both.groupBy("entity", "term", "n_term").agg(F.sum("n_rows").alias("n_both")).where(F.col("n_both") >= support)
    return counted.withColumn("bits", -F.log2(F.col("n_both") / F.col("n_term"))).where(F.col("bits") <= slack_bits).select("entity", "term", "bits")


def find_spans(docs: DataFrame, support: int = SUPPORT, slack_bits: float = SLACK_BITS) -> DataFrame:
    """doc_id, doc_key, spans (base), terms (spans of disclosing terms) of each row."""
    found = store(find_base(docs), "pii-base")
    telling = store(disclosing_pairs(found, support, slack_bits).select("term").distinct(), "pii-terms")
    held = found.select("doc_id", "doc_key", F.explode("held").alias("term")).join(broadcast_if_small(telling), "term")
    own = store(held.select(F.col("doc_id").alias("t_id"), F.col("doc_key").alias("t_key")).distinct(), "pii-own")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_key", F.xxhash64("text"))
    marked = texts.join(broadcast_if_small(own), texts.doc_id.eqNullSafe(own.t_id) & (texts.doc_key == own.t_key)).dropDuplicates(["t_id", "t_key"])
    placed = marked.select("t_id", "t_key", F.explode(placed_words(F.col("text"), base_spans(F.col("text")))).alias("x")).select("t_id", "t_key", F.col("x.word").alias("term"), F.col("x.start").alias("start"))
    hits = placed.join(broadcast_if_small(telling), "term").groupBy("t_id", "t_key").agg(F.array_sort(F.collect_list(F.struct("start", "term"))).alias("h"))
    span = lambda h: F.struct(F.lit("term").alias("kind"), h["start"].alias("start"), (h["start"] + F.length(h["term"])).alias("end"), h["term"].alias("value"))
    listed = hits.select("t_id", "t_key", F.transform("h", span).alias("terms"))
    rows = found.select("doc_id", "doc_key", "spans")
    out = rows.join(listed, rows.doc_id.eqNullSafe(listed.t_id) & (rows.doc_key == listed.t_key), "left")
    return out.select("doc_id", "doc_key", "spans", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by its kind in brackets."""
    return _rewritten(text, spans, lambda s, reached: F.when(s["start"] >= reached, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))


def sanitise(docs: DataFrame, support: int = SUPPORT, slack_bits: float = SLACK_BITS) -> DataFrame:
    """docs with base spans and disclosing terms replaced in text; rows, columns and their order stay."""
    spans = find_spans(docs, support, slack_bits).where((F.size("spans") > 0) | (F.size("terms") > 0))
    own_id, own_key, own_spans = free_names(docs, "own_id", "own_key", "own_spans")
    marked = spans.select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key), F.concat("spans", "terms").alias(own_spans)).dropDuplicates([own_id, own_key])
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(broadcast_if_small(marked, limit=20_000), docs["doc_id"].eqNullSafe(F.col(own_id)) & (key == F.col(own_key)), "left")
    clean = F.when(F.col(own_spans).isNull(), docs["text"]).otherwise(redact(docs["text"], F.col(own_spans)))
    return joined.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])
