"""Personal data: known forms, and an information-theoretic sanitisation of the terms around them.

All of it is DataFrame functions, no Python on the executors. Base spans are leftmost and non-overlapping
for each kind; offsets follow from the texts between the matches and the matches themselves, in code points.
The patterns start only where a run of their characters does (or where the last match ended) and never give
characters back, and what is folded over matches is folded by chunks of them, so the work is in proportion to
the text however many matches it holds. Texts are searched once; what is found is written.

The matched values are the protected entities. All words of a document that mentions one are its context, and
the corpus says how strongly a word t reveals an entity e: with document counts n over all documents, PMI(e;t) =
log(N n(e,t) / n(e) n(t)) of the information IC(e) = log(N / n(e)) that identifying e takes. A word that
reveals most of it is generalised, one that reveals nearly all is removed, wherever it stands in the
documents that hold that entity; documents without a protected entity stay as they are. Words are judged on
SUPPORT documents at least. Documents are distinct texts here: copies and repeated rows are no evidence.

Null and empty texts have no spans. Rows of one text get the same spans. An empty table gives an
empty one. Extra columns, whatever their names, are kept by sanitise() and ignored by the digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract, written so that they cannot backtrack (Java).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Least letters of a term.
LETTERS = 3
#: Documents with both term and entity needed to judge; share of the entity's information from which a term
#: is generalised, and from which it is removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.7, 0.95
#: Candidate terms broadcast to the corpus count at most; beyond, they are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: A code point of a base span of each kind, when spans are masked: characters that no text interchanges (a text
#: that does hold one gets a space for it, if it has spans).
_MASKS = "\ufdd0\ufdd1\ufdd2\ufdd3"
#: Whole words that touch no mask.
_WORD = rf"(?<![\p{{L}}{_MASKS}])\p{{L}}++(?![{_MASKS}])"
_SPANS = "array<struct<start:int,end:int,value:string>>"
#: Matches folded at a time, and code points of a piece of text that two masks are merged in.
_CHUNK, _PIECE = 512, 4096


def _parts(text: Column, pattern: str) -> Column:
    """The text as pairs of what is between matches and the match after it, the last without one."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def located(parts: Column, wanted=lambda value: F.lit(True)) -> Column:
    """Start, end (exclusive) and value of every wanted match, in code points. An array that grows by one is
    copied each time, so matches are gathered by chunks and the chunks then joined."""
    empty = F.array().cast(_SPANS)

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        found = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("value"))))
        return F.struct(end.alias("at"), F.when(part["hit"].isNotNull() & wanted(part["hit"]), found).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, k: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), empty.alias("out"))
        join = lambda own: F.struct(own["at"].alias("at"), F.concat(acc["out"], own["out"]).alias("out"))
        return F.aggregate(F.slice(parts, k * _CHUNK + 1, F.lit(_CHUNK)), start, step, join)

    chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _CHUNK).cast("int"))
    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty.alias("out")), chunk, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


#: What a text must hold for a kind to be looked for at all.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def _merged(a: Column, b: Column) -> Column:
    """Two masks of one text as one, the first's where both have one. Only pieces that both mask are merged
    character by character."""
    any_mask = f"[{_MASKS}]"
    pieces = lambda t: F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    letters = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    each = lambda x, y: F.array_join(F.zip_with(letters(x), letters(y), lambda p, q: F.when(p.rlike(any_mask), p).otherwise(q)), "")
    both = F.zip_with(pieces(a), pieces(b), lambda x, y: F.when(~x.rlike(any_mask), y).when(~y.rlike(any_mask), x).otherwise(each(x, y)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_join(both, ""))


def _found(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Each row's other columns as struct `row`; a key of its text; base spans by kind as listed, then
    start, and the entities they name; and as `body` the masked text of rows with spans, else the text itself
    if it is kept."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"))
    some = F.col("text").rlike("[0-9@]")
    rows = rows.withColumns({f"_p{k}": F.when(some & F.col("text").rlike(_HINTS[kind]), _parts(F.col("text"), PATTERNS[kind])) for k, kind in enumerate(KINDS)})
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def spans(k: int, kind: str) -> Column:
        found = F.filter(located(F.col(f"_p{k}")), lambda s: _holds(kind, s["value"]))
        found = F.transform(found, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.coalesce(found, empty)

    rows = rows.withColumn("spans", F.concat(*(spans(k, kind) for k, kind in enumerate(KINDS))))

    def mask(k: int, kind: str) -> Column:
        hidden = lambda hit: F.when(_holds(kind, hit), F.repeat(F.lit(_MASKS[k]), F.length(hit))).otherwise(hit)
        piece = lambda p: F.concat(F.translate(p["gap"], _MASKS, " " * len(_MASKS)), F.coalesce(hidden(p["hit"]), F.lit("")))
        return F.when(F.exists("spans", lambda s: s["kind"] == k), F.array_join(F.transform(F.col(f"_p{k}"), piece), ""))

    masked = reduce(_merged, (mask(k, kind) for k, kind in enumerate(KINDS)))
    held = F.size("spans") > 0
    key = F.struct(F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(17)).alias("two"))
    entities = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    places = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    body = F.when(held, masked).otherwise(F.col("text") if keep_text else F.lit(None).cast("string"))
    out = rows.select("row", F.when(held, key).alias("key"), places.alias("spans"), F.when(held, entities).alias("entities"), body.alias("body"))
    return materialise(out, "pii-found")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Each text that is not null once. Hashes are counted first, so only texts that have copies are shuffled."""
    named = texts.where("text is not null").withColumn("hash", F.xxhash64("text"))
    copied = materialise(named.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "pii-copied")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_TERMS else copied.hint("merge")
    once = named.join(copied, "hash", "left_semi").dropDuplicates(["hash"])
    return named.join(copied, "hash", "left_anti").unionByName(once).select("text")


def disclosing_terms(found: DataFrame, texts: DataFrame) -> DataFrame:
    """key, shares: for documents with protected entities, the terms that reveal one of them, and how much.
    texts(text) are all texts of the corpus. Documents are distinct texts throughout.

    Entities that are in the same documents are one class, and so are terms, so a document's pairs are those of its
    classes, however many entities and words it holds; a class is known by its size and the exclusive or of two
    hashes of each document. A document keeps, of each class of terms, the best count for each size of an entity's
    set, which is all that a term's share can depend on; pairs of a document are never listed word by word."""
    term = F.filter(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(_WORD), F.lit(0)), F.lower)), lambda t: F.length(t) >= LETTERS)
    mentions = materialise(found.where("key is not null").select("key", "entities", term.alias("terms")).dropDuplicates(["key"]), "pii-mentions")
    unique = distinct_texts(texts)
    total = float(max(unique.count(), 1))
    documents = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("y"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TERMS else df.hint("merge")
    held = mentions.select("key", F.explode("entities").alias("entity"))
    entities = materialise(held.groupBy("entity").agg(documents.alias("e")).where(F.col("e.n") >= SUPPORT), "pii-entities")
    of_entities = materialise(held.join(small(entities), "entity").select("key", "e").distinct(), "pii-of-entities")
    # n_both is n_entity at most, so a term in more documents than this reveals too little of the entity.
    most = lambda n: F.lit(total ** (1 - GENERALISE) * (1 + 1e-9)) * F.pow(n, F.lit(GENERALISE))
    # Documents with entities come first: a term is in as many documents at least as in these, and only the terms
    # that may reveal an entity by that count are counted over the corpus.
    widest = F.broadcast(of_entities.agg(F.max("e.n").alias("widest")))
    words = mentions.select("key", F.explode("terms").alias("term"))
    seen = words.groupBy("term").agg(documents.alias("t")).where(F.col("t.n") >= SUPPORT)
    seen = materialise(seen.join(widest).where(F.col("t.n") <= most(F.col("widest"))).drop("widest"), "pii-seen")
    of_terms = words.join(small(seen), "term").select("key", "t").distinct()
    met = materialise(of_terms.join(of_entities.hint("merge"), "key").where(F.col("t.n") <= most(F.col("e.n"))).select("key", "e", "t"), "pii-pairs")
    both = met.groupBy("e", "t").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)

    def share(n_entity: Column, n_both: Column, n_term: Column) -> Column:
        information = F.log2(F.lit(total) / n_entity)
        return F.when(information > 0, F.log2(F.lit(total) * n_both / n_entity / n_term) / information).otherwise(0.0)

    both = materialise(both.where(share(F.col("e.n"), F.col("n_both"), F.col("t.n")) >= GENERALISE * (1 - 1e-9)), "pii-both")
    best = met.join(small(both), ["e", "t"]).groupBy("key", "t", F.col("e.n").alias("n")).agg(F.max("n_both").alias("n_both"))
    best = best.groupBy("key", "t").agg(F.collect_list(F.struct("n", "n_both")).alias("ways"))
    wanted = materialise(seen.join(small(both.select("t").distinct()), "t").select("term", "t"), "pii-wanted")
    words = unique.select(F.explode(F.array_distinct(F.transform(F.split("text", r"[^\p{L}]+"), F.lower))).alias("term"))
    counted = lambda df: df.groupBy("term").agg(F.count("*").alias("n_term"))
    # Few terms meet the words where these lie; many meet them once the words are counted, never word by word.
    terms = counted(words.join(F.broadcast(wanted.select("term")), "term", "left_semi")) if wanted.count() <= BROADCAST_TERMS else counted(words).join(wanted.select("term").hint("merge"), "term", "left_semi")
    terms = materialise(wanted.join(terms.hint("merge"), "term"), "pii-terms")
    judged = best.join(small(terms), "t").select("key", "term", F.array_max(F.transform("ways", lambda w: share(w["n"], w["n_both"], F.col("n_term")))).alias("share"))
    # A document's terms only: bounded by the document, and once where two entities share a word.
    of = judged.where(F.col("share") >= GENERALISE).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    of = materialise(of, "pii-shares")
    discard(mentions, entities, of_entities, seen, met, both, wanted, terms)
    return of


LABELS = (*KINDS, "generalise", "remove")


def _with_shares(docs: DataFrame, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """Rows without base spans, and rows with them and their disclosing terms; only the latter are shuffled."""
    found = _found(docs, keep_text)
    terms = disclosing_terms(found, docs.select(F.col("text").cast("string").alias("text")))
    return found.where("key is null"), found.where("key is not null").join(terms, "key", "left")


def _share(value: Column) -> Column:
    return F.try_element_at("shares", F.lower(value))


def digest(docs: DataFrame) -> DataFrame:
    """The columns that op3 is compared by."""
    clean, held = _with_shares(docs.select("doc_id", "text"), False)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    added = located(_parts(F.col("body"), _WORD), lambda value: _share(value).isNotNull())
    added = F.array_sort(F.transform(added, lambda s: F.struct(F.when(_share(s["value"]) >= REMOVE, 5).otherwise(4).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    held = held.withColumn("added", F.when(F.col("shares").isNotNull(), added).otherwise(none))
    label = lambda k: F.element_at(F.array(*map(F.lit, LABELS)), k + 1)
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", label(s["kind"]), s["start"], s["end"])))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.when(F.size("added") > 0, F.concat_ws(",", written(F.col("spans")), written(F.col("added")))).otherwise(written(F.col("spans")))
    out = clean.select("row", "spans", none.alias("added")).unionByName(held.select("row", "spans", "added"))
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(written(F.col("spans")).cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs, with its own columns: known forms become their kind in brackets, disclosing terms `[word]` or
    nothing, n_chars (if there) follows. What several kinds claim is of the first of them as listed; spans of
    one kind without anything between them are replaced as one."""
    clean, held = _with_shares(docs, True)
    told = lambda p: F.when(_share(p["hit"]) >= REMOVE, "").when(_share(p["hit"]).isNotNull(), "[word]").otherwise(p["hit"])
    without = F.array_join(F.transform(_parts(F.col("body"), _WORD), lambda p: F.concat(p["gap"], F.coalesce(told(p), F.lit("")))), "")
    written = F.when(F.col("shares").isNotNull(), without).otherwise(F.col("body"))
    for mask, kind in zip(_MASKS, KINDS, strict=True):
        written = F.regexp_replace(written, f"{mask}+", f"[{kind}]")
    out = clean.select("row", F.col("body").alias("written"), F.lit(False).alias("changed")).unionByName(held.select("row", written.alias("written"), F.lit(True).alias("changed")))
    column = {"text": F.col("written").alias("text")}
    if "n_chars" in docs.columns:
        kept = F.col("row.n_chars")
        column["n_chars"] = F.when(F.col("changed"), F.length("written").cast(docs.schema["n_chars"].dataType)).otherwise(kept).alias("n_chars")
    return out.select(*(column.get(c, F.col(f"row.`{c}`")) for c in docs.columns))
