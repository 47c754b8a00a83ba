"""Personal data: patterns, and information-theoretic sanitisation, with DataFrame and SQL functions only.

Patterns find protected entities (email, ip, card, phone). Corpus co-occurrence then tells which terms give an entity away:
for a term t seen near entity c, PMI(c; t) = ln(p(c, t) / (p(c) p(t))) is compared with the information of c itself,
IC(c) = -ln p(c), where probabilities are shares of all different texts, so copies of one text count once. At PMI = IC the
term occurs only with the entity. Every pair is rated, also those seen in one document, but one text says little: terms at
or above `generalise_at` of IC are generalised, and removed only if they are at or above `remove_at` and p(c|t) is at least
`support` even with one more text without the entity's help, (n(c, t) + p(c)) / (n(t) + 1), which one text cannot reach.

A term is generalised to the class of the words that begin like it: the longest beginning, of at most 12 characters and
shorter than the term, that discloses at most `generalise_to` of the entity's information. The corpus tells: if words of a
class stand near entities in n different texts, PMI(c; class) <= ln(N / n). A class that common is written ``[be*]``; if
there is none, the class of all words, ``[TERM]``.

Every document pairs each entity only with the words around it, so pairs grow with the entities, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import fresh, running_spans, spread, written

# Kinds in order, and patterns that find the leftmost non-overlapping matches of the contract's patterns in
# linear time (a match can begin only where a run begins, or where the match before it ended; runs are never given back).
BASE = ["email", "ip", "card", "phone"]
ADDED = ["generalise", "remove"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a match of the kind; cheap to test.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"[\p{L}\p{N}]{3,}"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,label:string>>"
#: Characters of the beginnings that stand for classes of words.
LONGEST_CLASS = 12


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            digits = F.regexp_replace(part, "^0+(?=.)", "")
            return (F.length(digits) <= 3) & (F.when(F.length(digits) <= 3, digits).otherwise(F.lit("999")).cast("int") <= 255)

        return F.forall(F.split(match, r"\."), small)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))


def positions(text: Column, pattern: str, wanted) -> Column:
    """array<struct<start,end,value>> of the pattern's matches for which wanted(match) holds, in code points.

    split() and regexp_extract_all() walk over the same matches, so running lengths of the pieces between matches and of
    the matches give every start.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    piece = lambda g, m: F.struct(F.length(g).alias("skip"), F.length(m).alias("size"), wanted(m).alias("keep"), m.alias("value"))
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, piece)
    return F.when(F.size(matches) > 0, running_spans(pieces, "string")).otherwise(empty)


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,value>> of the four base kinds, by kind, then start."""
    kind = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

    def of(name: str) -> Column:
        found = F.transform(positions(text, PATTERNS[name], lambda m: _valid(name, m)), lambda s: F.struct(F.lit(name).alias("kind"), s["start"], s["end"], s["value"]))
        may = F.contains(text, F.lit(NEEDS[name])) if name in NEEDS else F.rlike(text, F.lit("[0-9][ -]?[0-9]"))
        return F.when(may, found).otherwise(F.array().cast(kind))

    return F.concat(*map(of, BASE))


def entity(span: Column) -> Column:
    """What a span names: emails without case, the digits of cards and phones."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]", ""))
    return F.concat_ws(":", span["kind"], value)


def around(text: Column, span: Column, words: int = 8, chars: int = 160) -> Column:
    """The terms among the `words` terms before and after a span that lie whole within `chars` characters of it."""
    # One character more tells whether the window's edge cuts a word; what it cuts is left out.
    before = F.substr(text, F.greatest(span["start"] - chars, F.lit(1)).cast("int"), F.least(span["start"], F.lit(chars + 1)).cast("int"))
    after = F.substr(text, (span["end"] + 1).cast("int"), F.lit(chars + 1))
    left = F.when(span["start"] > chars, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    right = F.when(F.length(after) > chars, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    left, right = (F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0)) for x in (left, right))
    return F.concat(F.slice(left, F.greatest(F.size(left) - words + 1, F.lit(1)), F.lit(words)), F.slice(right, F.lit(1), F.lit(words)))


def classes(term: Column) -> Column:
    """The beginnings of a term that may stand for it."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(term) - 1, F.lit(LONGEST_CLASS))), lambda n: F.substr(term, F.lit(1), n))


def disclosing_terms(found: DataFrame, text: str, spans: str, generalise_at: float = 0.98, remove_at: float = 1.0, generalise_to: float = 0.5, support: float = 0.6) -> DataFrame:
    """(term, kind, label): terms whose strongest PMI reaches a threshold, kind `generalise` or `remove`, and what is
    written for them.

    found holds all documents with their base spans. Hot entities, terms and classes are counted by partial aggregation.
    """
    near = F.transform(F.col(spans), lambda s: F.struct(entity(s).alias("entity"), around(F.col(text), s).alias("terms")))
    content = F.xxhash64(F.col(text), F.length(text))
    seen = found.where(F.size(spans) > 0).select(content.alias("content"), F.array_distinct(near).alias("near"))
    seen = written(seen.dropDuplicates(["content"]), "seen")
    ids = F.array_distinct(F.transform("near", lambda x: x["entity"]))
    entities = seen.select(F.explode(ids).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = F.array_distinct(F.flatten(F.transform("near", lambda x: F.transform(x["terms"], lambda t: F.struct(x["entity"].alias("entity"), t.alias("term"))))))
    counted = seen.select(F.explode(pairs).alias("p")).select("p.*").groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    # A term occurs in at least as many texts as it occurs in near any entity, which bounds its PMI from above: pairs
    # that cannot reach the threshold go before the corpus is read again.
    n_all = F.lit(found.select(content.alias("content")).distinct().count())
    near_terms = F.array_distinct(F.flatten(F.transform("near", lambda x: x["terms"])))
    near_any = seen.select(F.explode(near_terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    counted = counted.join(entities, "entity").join(near_any, "term")
    most = F.col("n_ct") * F.pow(n_all / F.col("n_c"), F.lit(1 - generalise_at)) * (1 + 1e-6)
    counted = written(counted.where(F.col("n_near") <= most).drop("n_near"), "pairs")
    wanted = counted.select("term").distinct()
    # Frequency of the terms in question over all different texts; nothing is read if there are none.
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))
    frequency = found.select(content.alias("content"), F.explode(words).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.countDistinct("content").alias("n_t"))
    rated = counted.join(frequency, "term")
    information = F.log(n_all / F.col("n_c"))
    pmi = F.log(F.least(F.col("n_ct"), F.col("n_t")) * n_all / (F.col("n_c") * F.col("n_t")))
    shrunk = (F.least(F.col("n_ct"), F.col("n_t")) + F.col("n_c") / n_all) / (F.col("n_t") + 1)
    # Texts that a class must stand in so as to disclose little of this entity.
    need = n_all * F.pow(F.col("n_c") / n_all, F.lit(generalise_to))
    rated = rated.select("term", F.when(information > 0, pmi / information).otherwise(0.0).alias("strength"), shrunk.alias("shrunk"), need.alias("need"))
    rated = rated.where(F.col("strength") >= generalise_at - 1e-9)
    gone = (F.col("strength") >= remove_at - 1e-9) & (F.col("shrunk") >= support)
    rated = written(rated.groupBy("term").agg(F.max(gone).alias("gone"), F.max("need").alias("need")), "rated")
    common = seen.select(F.explode(F.array_distinct(F.flatten(F.transform(near_terms, classes)))).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    wider = rated.where("not gone").select("term", "need", F.explode(classes(F.col("term"))).alias("class")).join(common, "class").where("n >= need * (1 - 1e-9)")
    wider = wider.groupBy("term").agg(F.max_by("class", F.length("class")).alias("class"))
    label = F.when(F.col("gone"), "").otherwise(F.coalesce(F.concat(F.lit("["), F.col("class"), F.lit("*]")), F.lit("[TERM]")))
    kind = F.when(F.col("gone"), "remove").otherwise("generalise")
    return written(rated.join(wider, "term", "left").select("term", kind.alias("kind"), label.alias("label")), "terms")


def sanitise(df: DataFrame, text: str = "text", out: str = "pii", clean: str = "sanitised", generalise_at: float = 0.98, remove_at: float = 1.0, generalise_to: float = 0.5, support: float = 0.6) -> DataFrame:
    """df with `out` (array<struct<kind,start,end>>, code points, end exclusive, by kind: email, ip, card, phone,
    generalise, remove; then start) and `clean` (the text with entities as [EMAIL], [IP], [CARD], [PHONE], generalised
    terms as their class and removed terms gone; where spans overlap, the first stands for all).

    Null and empty texts have no spans; a null text stays null in `clean`. Rows are kept as they are, repeated rows and
    null keys included; columns named like `out` and `clean` are replaced; an empty table gives an empty one.
    """
    df = df.select(*(c for c in df.columns if c.lower() not in (out.lower(), clean.lower())))
    own, spans, terms, h = fresh(df, "text_", "spans_", "terms_", "hash_")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = spread(df).withColumn(own, whole).withColumn(spans, base_spans(F.col(own)))
    # Only texts with spans need their rows written for the corpus counts; the document count and frequencies read df.
    flagged = disclosing_terms(found, own, spans, generalise_at, remove_at, generalise_to, support)
    words = F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(TERM), F.lit(0)))
    hits = df.select(F.xxhash64(whole, F.length(whole)).alias(h), F.explode(words).alias("term")).join(flagged, "term")
    hits = written(hits.groupBy(h).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", F.struct("kind", "label"))))).alias(terms)), "hits")
    marked = found.withColumn(h, F.xxhash64(own, F.length(own))).join(hits, h, "left")
    added = positions(F.col(own), TERM, lambda m: F.map_contains_key(F.col(terms), F.lower(m)))
    said = lambda s: F.element_at(F.col(terms), F.lower(s["value"]))
    added = F.transform(added, lambda s: F.struct(said(s)["kind"].alias("kind"), s["start"], s["end"], said(s)["label"].alias("label")))
    # A term inside a base span is that span's business.
    added = F.filter(added, lambda s: ~F.exists(F.col(spans), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    added = F.when(F.col(terms).isNotNull(), added).otherwise(F.array().cast(SPAN))
    plain = F.transform(F.col(spans), lambda s: F.struct(s["kind"], s["start"], s["end"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    of_kind = lambda kind: F.filter(F.col(terms), lambda s: s["kind"] == kind)
    extra = F.concat(*map(of_kind, ADDED))
    marked = marked.withColumn(terms, added).withColumn(out, F.concat(plain, extra))
    marked = marked.withColumn(clean, F.when(F.col(text).isNotNull(), replaced(F.col(own), F.col(out))))
    return marked.withColumn(out, F.transform(F.col(out), lambda s: F.struct(s["kind"], s["start"], s["end"]))).select(*df.columns, out, clean)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span's label; a span that begins inside an earlier one only extends it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["label"])))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(piece, s["label"]))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    end = lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), F.length(text)))), "")
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, end)).otherwise(text)
