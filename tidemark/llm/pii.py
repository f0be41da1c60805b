"""Personal data by fixed patterns, extended by bootstrapped contextual extraction.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. They and tokens that look like
keys (SECRET) seed a bootstrap (Riloff and Jones, 1999): the two words before a seed, or after it, form a lexical
pattern; patterns and the identifier-like tokens they go with form a bipartite graph that Spark scores in rounds. A
pattern's confidence for a kind is the mean score of the distinct instances it goes with, an instance's score the
noisy-or of its patterns. Tokens that go with patterns of high confidence are added as spans of that kind; a token that
looks like a key but has no such context is not. Only DataFrame expressions are used; each text is read by one pass,
and what travels afterwards are matches and their contexts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import beside, row_keys
from tidemark.storage import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kind of the further seeds, and their form: hexadecimal digits as of a digest or key.
LEARNT_KIND, SECRET = "secret", r"^(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: The stated patterns, with possessive repetition where nothing can follow (same matches, linear time, no recursion).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Blank-separated tokens with a digit, neighbours taken together, and quoted tokens that = or : introduces.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+)(?:\x20[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+)*+|(?<=[=:]|[=:]\x20)[\"'][^\x20\x09-\x0D]++"
ROUNDS = 3
CONFIDENCE = 0.8
#: Distinct seed instances that a pattern needs before it may introduce new ones.
SUPPORT = 5
#: Blanks that a context reaches over.
CONTEXT_BLANKS = 6
#: Patterns that are broadcast at most.
BROADCAST_PATTERNS = 200_000


def _accepted(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.split(match, r"\.")
    small = F.forall(parts, lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.regexp_like(p, F.lit("^0*[0-9]{1,2}$"))))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)))
        .when(kind == "phone", F.length(digits).between(9, 15))
    )


@dataclass(frozen=True)
class _Scan:
    kind: str
    pattern: str
    needs: Column


def _scans(text: Column) -> list[_Scan]:
    digit = text.rlike("[0-9]")
    needs = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": F.contains(text, F.lit("+"))}
    return [*(_Scan(k, PATTERNS[k], needs[k]) for k in KINDS), _Scan("", CANDIDATE, digit | text.rlike("[=:]"))]


def matches(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end, value, before, after) of all matches, kind '' for candidates; positions in code points.

    A text's pieces between matches have known lengths, so running sums over a text's matches give positions.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def found(scan: _Scan) -> Column:
        def piece(p: Column) -> Column:
            spaced = F.translate(p, "\t\n\x0b\f\r", "     ")
            return F.struct(F.length(p).alias("length"), F.substring_index(spaced, " ", -CONTEXT_BLANKS).alias("tail"), F.substring_index(spaced, " ", CONTEXT_BLANKS).alias("head"))

        def ends(pieces: Column) -> Column:  # of neighbouring pieces
            rest = F.greatest(F.size(pieces) - 1, F.lit(0))
            return F.zip_with(F.slice(pieces, 1, rest), F.slice(pieces, 2, rest), lambda p, q: F.struct(p["length"].alias("gap"), p["tail"].alias("tail"), q["head"].alias("head")))

        around = F.transform(F.array(F.transform(F.split(text, scan.pattern, -1), piece)), ends)[0]
        values = F.regexp_extract_all(text, F.lit(scan.pattern), F.lit(0))
        return F.when(scan.needs, F.zip_with(around, values, lambda p, v: F.struct(F.lit(scan.kind).alias("kind"), p["gap"].alias("gap"), p["tail"].alias("tail"), p["head"].alias("head"), v.alias("value"))))

    arrays = docs.select(F.struct(*row_keys()).alias("key"), F.flatten(F.array_compact(F.array(*[found(s) for s in _scans(text)]))).alias("found")).filter(F.size("found") > 0)
    rows = materialize(arrays.dropDuplicates(["key"]).select("key", F.posexplode("found")).select("key", "pos", "col.*"), "pii-matches")
    so_far = Window.partitionBy("key", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("value")).select("key", "kind", "start", "end", "value", _context("tail", -2).alias("before"), _context("head", 1).alias("after"))


def _context(side: str, first: int) -> Column:
    """Two words beside a match, lower-cased, without digits and most punctuation; null where there are fewer."""
    words = F.filter(F.split(F.regexp_replace(F.lower(side), r"[^\p{L}=:@#\x20]+", ""), " "), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.concat(F.lit("< " if first < 0 else "> "), F.array_join(F.slice(words, first, 2), " ")))


def _inner(rows: DataFrame) -> DataFrame:
    """Candidates cut to their value: 'name=value' tokens are introduced by the name, outer punctuation is left out."""
    name = F.regexp_extract("value", r"^[\"'(]*([\p{L}_-]+[=:])", 1)
    lead = F.length(F.regexp_extract("value", r"^[\"'(\[]*(?:[\p{L}_-]+[=:])?[\"'(\[]*", 0))
    tail = F.length(F.regexp_extract("value", r"[\"')\].,;:!?]*$", 0))
    cut = rows.withColumn("__lead", lead).withColumn("__tail", tail).withColumn("__name", F.lower(name)).filter(F.length("value") > F.col("__lead") + F.col("__tail"))
    return cut.select(
        "key", "kind", (F.col("start") + F.col("__lead")).alias("start"), (F.col("end") - F.col("__tail")).alias("end"),
        F.expr("substring(value, __lead + 1, length(value) - __lead - __tail)").alias("value"),
        F.when(F.col("__name") != "", F.col("__name")).otherwise(F.col("before")).alias("before"), "after",
    )


def _with_contexts(rows: DataFrame, *keep: str) -> DataFrame:
    """keep columns and context: a row for each side that has one."""
    return rows.select(*keep, F.explode(F.array_compact(F.array("before", "after"))).alias("context"))


def learned_patterns(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(context, kind, confidence) of the patterns that go with kind with at least CONFIDENCE, as a written table."""
    secret = F.when(F.regexp_like("value", F.lit(SECRET)), LEARNT_KIND).alias("kind")
    edges = _with_contexts(seeds, "value", "kind").unionByName(_with_contexts(candidates, "value").select("context", "value", secret))
    edges = materialize(edges.groupBy("context", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    degree = materialize(edges.groupBy("context").agg(F.count("*").alias("n"), F.count("kind").alias("seeds")).filter(F.col("seeds") >= SUPPORT), "pii-degrees")
    edges = materialize(edges.join(beside(degree, BROADCAST_PATTERNS), "context").drop("seeds"), "pii-graph")
    given = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    score = given
    for _ in range(ROUNDS):
        patterns = edges.select("context", "value", "n").join(score, "value").groupBy("context", "kind").agg((F.sum("score") / F.max("n")).alias("confidence"))
        patterns = materialize(patterns.filter("confidence > 0.05"), "pii-patterns")
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        spread = edges.filter(F.col("kind").isNull()).select("context", "value").join(beside(patterns, BROADCAST_PATTERNS), "context").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        score = given.unionByName(spread.join(given.select("value").distinct(), "value", "left_anti"))
    return materialize(patterns.filter(F.col("confidence") >= CONFIDENCE), "pii-learned")


def _free(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """The candidates that no base span overlaps, found in one ordered pass over a text's spans."""
    both = candidates.withColumn("base", F.lit(False)).unionByName(seeds.withColumn("base", F.lit(True)))
    by_start = Window.partitionBy("key").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    marked = both.withColumn("reach", reach).withColumn("ahead", ahead).filter(~F.col("base"))
    clear = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))
    return marked.filter(clear).drop("reach", "ahead", "base")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned), one row per document.

    Counts and base_sha256 (of kind:start:end, by start and then kind as listed, comma-joined, lowercase hex)
    concern the base patterns; spans lists base and learned spans in the same form, kind secret last. Null texts are
    empty. Repeated rows give equal result rows. Learned spans never overlap a base span.
    """
    all_matches = matches(docs)
    seeds = materialize(all_matches.filter(F.col("kind") != "").filter(_accepted(F.col("kind"), F.col("value"))), "pii-base")
    free = materialize(_free(_inner(all_matches.filter(F.col("kind") == "")), seeds), "pii-candidates")
    best = materialize(learned_patterns(seeds, free).groupBy("context").agg(F.max(F.struct("confidence", "kind")).alias("best")), "pii-best")
    found = _with_contexts(free, "key", "start", "end").join(beside(best, BROADCAST_PATTERNS), "context")
    learned = found.groupBy("key", "start", "end").agg(F.max("best")["kind"].alias("kind")).withColumn("learned", F.lit(True))
    spans = seeds.select("key", "kind", "start", "end", F.lit(False).alias("learned")).unionByName(learned)
    order = F.array_position(F.array(*map(F.lit, (*KINDS, LEARNT_KIND))), F.col("kind"))
    item = F.struct("start", order.alias("rank"), "end", F.concat_ws(":", "kind", "start", "end").alias("span"), "learned")
    grouped = spans.groupBy("key").agg(F.array_sort(F.collect_set(item)).alias("items"))
    rows = docs.select("doc_id", F.struct(*row_keys()).alias("key")).join(grouped, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,span:string,learned:boolean>>")))
    base = F.filter("items", lambda x: ~x["learned"])

    def count(rank: int) -> Column:
        return F.size(F.filter(base, lambda x: x["rank"] == rank)).cast("long")

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["span"]), ",")

    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("items")).alias("spans"), F.size(F.filter("items", lambda x: x["learned"])).cast("long").alias("n_learned"),
    )
