"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail and IP addresses, card and phone numbers that fixed patterns find, each both as a kind
(``email``) and as a value (``email:a@b.org``). Co-occurrence in the corpus tells how much another term gives away: for
a term t in the words around an entity e,

    PMI(t; e) = log2(near(t, e) * N / (df(t) * n(e)))        IC(e) = log2(N / n(e))

with N documents, n(e) that hold e, df(t) that hold t and near(t, e) that hold t within ``WINDOW`` characters of e. A
term discloses e when it stood near e in at least ``SUPPORT`` different contexts (equal surroundings count once, so
copies of a text add nothing) and PMI >= ALPHA * IC: it gives away that share of all there is to know about e. In a
document that holds e, every place of such a term becomes a span: terms that disclose a kind are generalised to
``[RELATED]``, terms that disclose one value are removed. Documents without any entity are left as they are.

All counts cover all documents. Terms are runs of three letters or more, in lower case. Equal texts are told by 128 bits.

Texts: null is empty, without spans. Offsets are code points, ends exclusive. Rows that repeat an id and text give equal
results; an id may be null. Very long texts are read whole, once for each of the two kinds of terms whatever their number,
and the time for one grows no faster than its length and n log n of its spans. An empty table gives an empty result. Extra columns stay in sanitise() and are not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, stored

WINDOW = 40
SUPPORT = 3
ALPHA = 0.8
#: Terms, pairs of entity and term, or added spans that a broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Texts that more than one in HOT_SHARE rows hold (so fewer than HOT_SHARE) are joined in SALTS parts.
HOT_SHARE, SALTS = 1_000, 64
#: Matches of a text whose places are found by one inner fold.
RUN = 64

#: The kinds in the order of reports, and their patterns. Possessive quantifiers and the conditions on
#: what comes before change no match; they keep the time linear on long runs.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "related": "[RELATED]", "removed": ""}
TERM = r"\p{L}{3,}"

SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    digit = lambda i: F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + digit(i) - F.when(digit(i) > 9, 9).otherwise(0))
    return total % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _places(found: Column, kind: str) -> Column:
    """Spans of the matches m that pass the kind's check, from their lengths and the lengths of what lies between, g."""

    def step(a: Column, i: Column) -> Column:
        start, value = a["at"] + F.length(F.get(found["g"], i)), F.get(found["m"], i)
        stop = start + F.length(value)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), value.alias("value"))
        return F.struct(stop.alias("at"), F.when(CHECKS[kind](value), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    last = F.size(found["m"]) - 1

    def run(a: Column, c: Column) -> Column:  # a fold over RUN matches, so that the whole list is copied once a run only
        at = F.sequence(c * RUN, F.least(c * RUN + RUN - 1, last))
        return F.aggregate(at, F.struct(a["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], x["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(found.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.floor(last / RUN).cast("int")), start, run, lambda a: a["out"]))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``base``, the spans of the four kinds in order; ``text`` must be a string column without nulls."""
    out = docs
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
        if HINTS[kind]:
            found = F.when(F.contains(F.col(text), F.lit(HINTS[kind])), found)
        out = out.withColumn(f"__{kind}", found)
    for kind in KINDS:
        m = F.col(f"__{kind}")
        # the matches that can't pass by their length are many (numbers in a text); only with another one are places looked for
        some = F.exists(m, CHECKS[kind])
        out = out.withColumn(f"__{kind}", F.when(some, F.struct(m.alias("m"), F.split(F.col(text), PATTERNS[kind], -1).alias("g"))))
    spans = [F.coalesce(_places(F.col(f"__{kind}"), kind), F.expr(f"cast(array() as {SPAN})")) for kind in KINDS]
    return out.withColumn("base", F.concat(*spans)).drop(*(f"__{k}" for k in KINDS))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _any_of(terms: Column) -> Column:
    """A pattern of whole runs of letters that are one of the terms (two letters or more, not quoted), grouped by first letter."""
    first = lambda t: F.substring(t, 1, 1)
    group = lambda c: F.concat(c, F.lit("(?:"), F.array_join(F.transform(F.filter(terms, lambda t: first(t) == c), lambda t: F.substring(t, F.lit(2), F.length(t))), "|"), F.lit(")"))
    return F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(terms, first))), group), "|"), F.lit(r")(?!\p{L})"))


def _context(text: Column, s: Column) -> Column:
    """The characters around a span, without cut words at the outer ends and without addresses."""
    before = F.substring(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW)))
    after = F.substring(text, s["stop"] + 1, F.lit(WINDOW))
    before = F.when(s["start"] > WINDOW, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    after = F.when(F.length(after) == WINDOW, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    return F.regexp_replace(F.concat(before, F.lit(" "), after), r"\S*[@0-9]\S*", " ")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, extra): base spans and the spans that the corpus adds, a row for each row. key is a hash of the text."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.md5(F.col("text").cast("binary")))
    found = stored(base_spans(rows).select("id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "entities")
    holders = found.where(F.col("text").isNotNull())
    names = F.array_distinct(F.flatten(F.transform("base", lambda s: F.array(s["kind"], F.concat_ws(":", s["kind"], F.lower(s["value"]))))))
    spots = F.transform("base", lambda s: F.struct(F.array(s["kind"], F.concat_ws(":", s["kind"], F.lower(s["value"]))).alias("entities"), _context(F.col("text"), s).alias("around")))
    spots = F.transform(spots, lambda s: F.struct(s["entities"].alias("entities"), F.array_distinct(_terms(s["around"])).alias("terms"), F.xxhash64(F.lower(s["around"])).alias("context")))
    each = lambda s, t: F.transform(s["entities"], lambda e: F.struct(e.alias("entity"), t.alias("term"), s["context"].alias("context")))
    near = F.flatten(F.transform(spots, lambda s: F.flatten(F.transform(s["terms"], lambda t: each(s, t)))))
    contexts = holders.select(F.explode(near).alias("x")).select("x.*").distinct().groupBy("entity", "term").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    close = holders.select(F.explode(F.array_distinct(F.transform(near, lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("x")).select("x.*").groupBy("entity", "term").agg(F.count("*").alias("near"))
    candidates = cut(contexts.join(close, ["entity", "term"]))
    terms = cut(candidates.select("term").distinct())
    bounded = terms.count() <= MOST_BROADCAST
    small = F.broadcast if bounded else (lambda df: df)
    if terms.isEmpty():
        return found.select("id", "key", "base", F.expr(f"cast(array() as {SPAN})").alias("extra"))
    df = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    n_e = holders.select(F.explode(names).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    n = found.count()
    pmi = F.log2(F.least("near", "df") * F.lit(float(n)) / (F.col("df") * F.col("n_e")))
    disclosing = candidates.join(df, "term").join(n_e, "entity").where(pmi >= ALPHA * F.log2(F.lit(float(n)) / F.col("n_e"))).select("entity", "term")
    disclosing = cut(disclosing)
    if disclosing.count() <= MOST_BROADCAST:  # the pairs, so the size of the sets as well
        by_term = F.broadcast(disclosing.groupBy("term").agg(F.collect_set("entity").alias("entities")))
    else:
        by_term = disclosing.select("term", F.array("entity").alias("entities"))
    held = holders.select("key", "text", "base", names.alias("names")).dropDuplicates(["key"])
    hits = held.select("key", "names", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(by_term, "term")
    hits = hits.withColumn("hit", F.array_intersect("names", "entities")).where(F.size("hit") > 0)
    hits = hits.groupBy("key", "term").agg(F.max(F.exists("hit", lambda e: F.contains(e, F.lit(":")))).alias("value"))
    per_kind = hits.groupBy("key", F.when(F.col("value"), "removed").otherwise("related").alias("kind")).agg(F.collect_list("term").alias("terms"))
    per_kind = per_kind.select("key", "kind", _any_of(F.col("terms")).alias("pattern"))
    # a text is read once for each kind, whatever the number of its terms
    found_terms = held.select("key", "text").join(per_kind, "key")
    matched = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    gaps = F.slice(F.split("text", F.col("pattern"), -1), F.lit(1), F.size(matched))
    # places are running sums of what lies between matches; no row carries its text's arrays
    rows_ = found_terms.select("key", "kind", F.posexplode(F.arrays_zip(gaps.alias("g"), matched.alias("m"))).alias("i", "x"))
    stop = F.sum(F.length("x.g") + F.length("x.m")).over(Window.partitionBy("key", "kind").orderBy("i")).cast("int")
    added = rows_.select("key", "kind", (stop - F.length("x.m")).alias("start"), stop.alias("stop"), F.col("x.m").alias("value"), F.lit(False).alias("own"))
    base = held.join(per_kind.select("key"), "key", "left_semi").select("key", F.explode("base").alias("s")).select("key", "s.kind", "s.start", "s.stop", "s.value", F.lit(True).alias("own"))
    # a span that overlaps a base span isn't added: the furthest end of base spans before it, and the next start after it
    both, w = added.union(base), Window.partitionBy("key")
    reach = F.max(F.when(F.col("own"), F.col("stop"))).over(w.orderBy("start", F.desc("own")).rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.min(F.when(F.col("own"), F.col("start"))).over(w.orderBy(F.desc("start"), F.desc("own")).rowsBetween(Window.unboundedPreceding, -1))
    free = both.withColumn("reach", reach).withColumn("next", next_).where(~F.col("own") & ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("stop"), F.lit(False)))
    extra = cut(free.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop", "value"))).alias("extra")))
    spans = extra.agg(F.sum(F.size("extra"))).first()[0] or 0
    none = F.expr(f"cast(array() as {SPAN})")
    if spans <= MOST_BROADCAST:
        return found.join(F.broadcast(extra), "key", "left").select("id", "key", "base", F.coalesce("extra", none).alias("extra"))
    # only rows with a base span can have more; copies of a text that more than a share of all rows hold are dealt out by their ids
    own, rest = found.where("size(base) > 0").select("id", "key", "base"), found.where("size(base) = 0").select("id", "key", "base", none.alias("extra"))
    hot = F.broadcast(cut(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > n // HOT_SHARE).select("key", F.lit(SALTS).alias("salts"))))
    salted = lambda df: df.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted(own).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = salted(extra).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, ["key", "salt"], "left").select("id", "key", "base", F.coalesce("extra", none).alias("extra")).union(rest)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_related), a row for each row."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find(docs, id_col, text_col).select(
        F.col("id").alias(id_col), *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_related"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced in its text: entities by the label of their kind, disclosing terms by ``[RELATED]`` or nothing.

    Spans that overlap are replaced as one, by the label of the first. Texts move only where they hold a span."""
    spans = find(docs, id_col, text_col).where("size(base) > 0").select(F.col("key").alias("__key"), F.concat("base", "extra").alias("__spans")).dropDuplicates(["__key"])
    keyed = docs.withColumn("__key", F.md5(docs[text_col].cast("string").cast("binary")))
    text = F.col(text_col)
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(labels, s["kind"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return keyed.join(spans, "__key", "left").withColumn(text_col, F.when(F.col("__spans").isNotNull(), done).otherwise(text)).select(*docs.columns)
