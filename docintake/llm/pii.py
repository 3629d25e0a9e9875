"""PII: fixed patterns, and terms that reveal a protected entity by corpus co-occurrence. Built-in functions only.

Base kinds are `email`, `ip`, `card` and `phone`. Java's matcher gives no offsets to SQL, so a text is both split at a
pattern and matched with it; offsets are running sums of the lengths of the alternating pieces.

Information-theoretic part (kind `term`): each base span is an occurrence of a protected entity (its normalised value).
The words in a context around it co-occur with it, those of other base spans left out. With P(t|e) the share of
different contexts of entity e that hold term t and P(t) the share of documents that hold it, t discloses
log2(P(t|e) / P(t)) bits of the -log2 P(e) bits that the entity carries; a term that gives away DISCLOSED of them, with
at least SUPPORT different contexts, is marked wherever it occurs, since it points to the entity in documents that do
not name it too. Contexts count once per wording, so copies are no evidence. Contexts bound the pairs by the number of
spans, so no document or entity makes pairs of everything with everything.

Texts stay where they are: spans are made in place, and what is shuffled are contexts and counts. Up to MOST_TERMS
candidates are looked up in place as well; more of them meet the exploded words of the corpus by a join.

Edge cases: null and empty texts have no spans; overlapping spans of different kinds all stay, the sanitised text
replaces their union; repeated rows give repeated results; a null doc_id keeps its row; an empty table gives an empty
table; extra columns are kept by sanitise() and ignored by spans().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, removed, stored, text_key

KINDS = ("email", "ip", "card", "phone")

# The local part starts where its run of characters starts, or where the match before ended: each run is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold for the pattern to be tried.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

WORD = r"[\p{L}\p{N}]+"

#: Characters on each side of a span that form its context; words cut by the limit do not count.
CONTEXT = 80
#: Different contexts of an entity that must hold a term, share of its bits that a term may not reach, and the least
#: share of the entity's contexts that hold the term.
SUPPORT = 3
DISCLOSED = 0.8
ALWAYS = 0.5
#: Terms that are looked up in place, as part of the expression; with more of them words are joined.
MOST_TERMS = 5_000

CHUNK = 256
#: Characters of one block of a text that is cut.
BLOCK = 512
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def fold(items: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Running fold over an array that emits one element per item: step(state, item) -> (new state, element).

    Goes in chunks, since appending to one growing array would copy it for every item.
    """
    none = F.array().cast(f"array<{out_type}>")
    nested = F.array().cast(f"array<array<{out_type}>>")

    def within(acc: Column, x: Column) -> Column:
        new, element = step(acc["s"], x)
        return F.struct(new.alias("s"), F.concat(acc["out"], F.array(element)).alias("out"))

    def whole(rows: Column) -> Column:
        def over(acc: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(rows, at * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["s"].alias("s"), none.alias("out")), within)
            return let(inner, lambda i: F.struct(i["s"].alias("s"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int"))
        return F.when(F.size(rows) > 0, F.flatten(F.aggregate(chunks, F.struct(state.alias("s"), nested.alias("out")), over)["out"])).otherwise(none)

    return let(items, whole)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(places, F.lit(0), lambda n, i: n + worth(i)) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(VALID_IP)
    if kind == "card":
        digits = F.regexp_replace(found, "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def nearby(piece: Column, last: bool) -> Column:
    """The last or first CONTEXT characters of a text between spans, without a word that the limit cuts."""
    cut = F.right(piece, F.lit(CONTEXT)) if last else F.left(piece, F.lit(CONTEXT))
    whole = F.regexp_replace(cut, rf"^{WORD}" if last else rf"{WORD}$", "")
    return F.when(F.length(piece) > CONTEXT, whole).otherwise(cut)


def located(text: Column, pattern: str, contexts: bool = False) -> Column:
    """array<struct<start, end, found>> of all matches; with `contexts`, also what stands `before` and `after` each."""

    def row(r: Column) -> Column:
        near = [nearby(r["before"], last=True).alias("before"), nearby(r["after"], last=False).alias("after")] if contexts else []
        return F.struct(r["start"].alias("start"), (r["start"] + F.length(r["found"])).alias("end"), r["found"].alias("found"), *near)

    def placed(x: Column) -> Column:
        pieces, matches = x["pieces"], x["matches"]
        before = F.slice(pieces, 1, F.size(matches))
        lengths = F.zip_with(before, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        starts = fold(lengths, F.lit(0).cast("bigint"), "bigint", lambda at, n: (at + n["p"] + n["m"], at + n["p"]))
        around = [before.alias("before"), F.slice(pieces, 2, F.size(matches)).alias("after")]
        return F.transform(F.arrays_zip(starts.alias("start"), matches.alias("found"), *(around if contexts else ())), row)

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    return let(parts, placed)


def base_spans(text: Column, kind: str, contexts: bool = False) -> Column:
    """array<struct<kind, start, end>> of the valid matches of one kind, by start; with `contexts`, also `value` and `context`."""
    sign = SIGNS[kind]
    more = "value:string,context:string," if contexts else ""
    empty = F.array().cast(f"array<struct<{more}kind:string,start:bigint,end:bigint>>")

    def row(r: Column) -> Column:
        value = F.lower(r["found"]) if kind == "email" else F.regexp_replace(r["found"], "[^0-9.]" if kind == "ip" else "[^0-9]", "")
        extra = [value.alias("value"), F.concat_ws(" ", r["before"], r["after"]).alias("context")] if contexts else []
        return F.struct(*extra, F.lit(kind).alias("kind"), r["start"].alias("start"), r["end"].alias("end"))

    found = F.transform(F.filter(located(text, PATTERNS[kind], contexts), lambda r: valid(kind, r["found"])), row)
    likely = text.contains(sign) if sign else F.lit(True)
    return F.when(likely & text.rlike(PATTERNS[kind]), found).otherwise(empty)


def words_of(text: Column) -> Column:
    """The different words of a text in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def without_spans(context: Column) -> Column:
    """A context without the personal data that stands in it, whose parts are no terms."""
    for pattern in PATTERNS.values():
        context = F.regexp_replace(context, pattern, " ")
    return context


def occurrences(docs: DataFrame) -> DataFrame:
    """(entity, context): one row for each base span, and one without a context for each entity that a document names."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[base_spans(text, k, contexts=True) for k in KINDS])
    named = F.transform(found, lambda s: F.struct(F.xxhash64(s["kind"], s["value"]).alias("entity"), without_spans(s["context"]).alias("context")))
    none = F.lit(None).cast("string").alias("context")
    rows = let(named, lambda s: F.concat(s, F.transform(F.array_distinct(s["entity"]), lambda e: F.struct(e.alias("entity"), none))))
    return docs.select(F.explode(rows).alias("s")).select("s.entity", "s.context")


def disclosive(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED, always: float = ALWAYS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(entity, term, bits, share): terms that give away at least `disclosed` of the bits of an entity.

    Pairs are counted map-side before they are shuffled. The document counts of terms are taken over all documents.
    """
    seen = stored(occurrences(docs))
    wordings = seen.where("context is not null").distinct()
    known = wordings.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    named = seen.where("context is null").groupBy("entity").agg(F.count("*").alias("n_d"))
    pairs = wordings.select("entity", F.explode(words_of(F.col("context"))).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    candidates = stored(pairs.join(known, "entity").where(F.col("n_te") >= always * F.col("n_e")).join(named, "entity"))
    removed(seen)
    # a common word is a candidate of most entities, hence a hot key
    terms = stored(candidates.groupBy("term").agg(F.count("*").alias("n_c")))
    counted = term_rows(docs, listed(terms, most_terms)).groupBy("term").agg(F.count("*").alias("n_t"))
    total = max(docs.count(), 1)
    bits = F.log2((F.col("n_te") / F.col("n_e")) / (F.col("n_t") / F.lit(total)))
    carried = F.greatest(-F.log2(F.col("n_d") / F.lit(total)), F.lit(1.0))
    facts = stored(terms.join(counted, "term"))
    scored = join_hot(candidates, facts, "term", candidates.count(), "n_c").select("entity", "term", bits.alias("bits"), (bits / carried).alias("share"))
    found = stored(scored.where(F.col("share") >= disclosed))
    for done in (candidates, terms, facts):
        removed(done)
    return found


def listed(terms: DataFrame, most: int) -> list[str] | None:
    """The terms, or None if there are more than `most`."""
    found = [r[0] for r in terms.select("term").distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def term_rows(docs: DataFrame, terms: list[str] | None) -> DataFrame:
    """(term): one row for each document and different word of it that is one of the terms (None: for each word).

    All words become rows before they are looked up, so the rows made grow with the texts alone and not with the number of
    terms too, which grows with the corpus; the aggregate behind sees only those that are terms.
    """
    words = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    if terms is None:
        return words
    return words.where(F.col("term").isin(terms)) if terms else words.limit(0)


def marked_terms(text: Column, is_term: Callable[[Column], Column]) -> Column:
    """array<struct<kind, start, end>> of the words of text that are terms."""
    marked = F.filter(located(text, WORD), lambda r: is_term(F.lower(r["found"])))
    return F.transform(marked, lambda r: F.struct(F.lit("term").alias("kind"), r["start"].alias("start"), r["end"].alias("end")))


def with_spans(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """docs with the struct column `__spans` of five arrays email, ip, card, phone, term (struct<kind, start, end>, code points)."""
    text = F.coalesce("text", F.lit(""))
    found = disclosive(docs, most_terms=most_terms)
    terms, none = listed(found, most_terms), F.array().cast(f"array<{SPAN}>")
    if terms is None:
        docs = _holding(docs, found.select("term").distinct())
        term = F.when(F.size("__terms") > 0, marked_terms(text, lambda w: F.array_contains(F.col("__terms"), w))).otherwise(none)
    elif terms:
        term = F.when(F.exists(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w).isin(terms)), marked_terms(text, lambda w: w.isin(terms))).otherwise(none)
    else:
        term = none
    plain = [base_spans(text, k).alias(k) for k in KINDS]
    return docs.withColumn("__spans", F.struct(*plain, term.alias("term"))).drop("__terms")


def _holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs with `__terms`, the terms that each row holds, for more terms than fit an expression: words meet terms by a
    join that splits off words which a large part of the rows holds."""
    keyed = docs.withColumn("__own", text_key())
    words = keyed.select("doc_id", "__own", F.explode(words_of(F.col("text"))).alias("term"))
    counts = stored(words.groupBy("term").agg(F.count("*").alias("n_w")))
    facts = stored(terms.join(counts, "term"))
    total = counts.agg(F.coalesce(F.sum("n_w"), F.lit(0))).first()[0]
    removed(counts)
    hits = join_hot(words, facts, "term", total, "n_w").groupBy("doc_id", "__own").agg(F.collect_set("term").alias("__terms"))
    hits = hits.withColumnsRenamed({"doc_id": "__id", "__own": "__key"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    none = F.array().cast("array<string>")
    return keyed.join(hits, same, "left").withColumn("__terms", F.coalesce("__terms", none)).drop("__own", "__id", "__key")


def spans(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """doc_id, text_key and five span arrays: email, ip, card, phone, term (struct<kind, start, end>, code points)."""
    found = with_spans(docs.select("doc_id", "text"), most_terms)
    return found.select("doc_id", text_key().alias("text_key"), *[F.col(f"__spans.{k}") for k in (*KINDS, "term")])


def generalised(kind: Column) -> Column:
    """What stands for a span in a sanitised text: its kind in brackets; a disclosive term is removed."""
    return F.when(kind == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def replaced(text: Column, marks: Column) -> Column:
    """text with every span of marks generalised; overlapping spans are replaced together, by the first one's kind."""
    ordered = F.array_sort(marks, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)))
    pieces = fold(
        ordered,
        F.lit(0).cast("bigint"),
        "struct<a:bigint,b:bigint,label:string>",
        lambda at, s: (
            F.greatest(at, s["end"]),
            F.struct(
                F.least(at, s["start"]).alias("a"),
                s["start"].alias("b"),
                F.when(s["start"] >= at, generalised(s["kind"])).otherwise(F.lit("")).alias("label"),
            ),
        ),
    )

    def span(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, from the blocks that they lie in."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        part = lambda at, first, n: F.coalesce(F.substr(F.get(blocks, at), (first + 1).cast("int"), n.cast("int")), F.lit(""))
        between = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, part(i, a % BLOCK, b - a)).otherwise(F.concat(part(i, a % BLOCK, F.lit(BLOCK)), between, part(j, F.lit(0), b % BLOCK)))

    def cut(x: Column) -> Column:
        slices = F.transform(x["pieces"], lambda p: F.concat(span(x["blocks"], p["a"], p["b"]), p["label"]))
        return F.concat(F.array_join(slices, ""), F.substr(text, (x["last"] + 1).cast("int"), F.length(text)))

    last = F.array_max(F.transform(marks, lambda s: s["end"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    parts = F.struct(blocks.alias("blocks"), pieces.alias("pieces"), last.alias("last"))
    return F.when(F.size(marks) > 0, let(parts, cut)).otherwise(text)


def sanitise(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """docs with the spans of text generalised or removed and n_chars (if there is one) counted anew; null texts stay null."""
    found = with_spans(docs, most_terms)
    clean = let(F.concat(*[F.col(f"__spans.{k}") for k in (*KINDS, "term")]), lambda marks: F.when(F.size(marks) > 0, replaced(F.col("text"), marks)).otherwise(F.col("text")))
    out = found.withColumn("text", F.when(F.col("text").isNotNull(), clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
