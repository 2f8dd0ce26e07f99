"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give the found entities away.

A term discloses an entity as far as their co-occurrence does: PMI(entity; term) / IC(entity), with probabilities estimated
from the corpus (occurrences of the term near the entity against all its occurrences, anywhere). 1 means that the term
never stands elsewhere, however often it was seen: the estimate is smoothed towards what chance gives, so that few
occurrences say less than many. Above one threshold a term is generalised to its kind, above a higher one it is removed.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written

#: The kinds in their order. The quantifiers are possessive and starts are anchored to the start of a run,
#: which finds the same leftmost matches as the plain patterns in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this one has none of that kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": "+"}
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"
#: Code points on either side of an entity that count as near it, as far as no other match of its kind stands between.
WINDOW = 120
#: Occurrences of a term, elsewhere by chance, that its own ones are weighed against.
PRIOR = 1.0
#: Matches whose places are summed up at a time.
STEP = 64
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.98


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(s)).between(12, 19) & F.call_function("luhn_check", digits(s))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: an expression named within a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def running(lengths: Column) -> Column:
    """Sums of all the lengths before each, and of all of them at the end. In steps, as appending to an array copies it."""
    sums = lambda xs, at: F.aggregate(xs, F.array(at), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")))
    steps = F.transform(places, lambda i: F.slice(lengths, i * STEP + 1, STEP))

    def joined(steps: Column, starts: Column) -> Column:
        inner = F.zip_with(steps, F.slice(starts, 1, F.size(steps)), lambda c, at: F.slice(sums(c, at), 1, F.size(c)))
        return F.array_append(F.flatten(inner), F.element_at(starts, -1))

    total = lambda steps: sums(F.transform(steps, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
    return let(steps, lambda c: let(total(c), lambda at: joined(c, at)))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, value, left, right, edge): what stands between them, of
    which left and right are the nearest WINDOW code points, gives their places. Between two equal matches no code point is
    in both the right of one and the left of the other, which edge tells. Linear in the text."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def spans(parts: Column) -> Column:
        gap = lambda i: F.get(parts["gaps"], i)

        def span(at: Column):
            def one(value: Column, i: Column) -> Column:
                end, again = F.get(at, i + 1), F.coalesce(F.get(parts["values"], i - 1) == value, F.lit(False))
                most = F.when(again, F.greatest(F.lit(0), F.least(F.lit(WINDOW), F.char_length(gap(i)) - WINDOW))).otherwise(WINDOW)
                return F.struct((end - F.char_length(value)).alias("start"), end.alias("end"), value.alias("value"), F.right(gap(i), most).alias("left"), F.left(gap(i + 1), F.lit(WINDOW)).alias("right"), again.alias("edge"))

            return one

        lengths = F.transform(parts["values"], lambda v, i: F.char_length(gap(i)) + F.char_length(v))
        return let(lengths, lambda n: let(running(n), lambda at: F.transform(parts["values"], span(at))))

    return let(both, spans)


def kind_spans(text: Column, kind: str, at: int) -> Column:
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in ("email", "phone") else text.rlike(HINTS[kind])
    spans = F.transform(F.filter(found(text, PATTERNS[kind]), lambda x: valid(kind, x["value"])), lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"), x["edge"].alias("edge")))
    return F.when(hint, spans).otherwise(F.array().cast("array<struct<start:int,at:int,kind:string,end:int,value:string,left:string,right:string,edge:boolean>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans by start, then kind) and near (terms around each: entity, term, start, end), written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    rows = rows.withColumns({k: kind_spans(F.col("text"), k, i) for i, k in enumerate(PATTERNS)})
    rows = rows.withColumn("base", F.array_sort(F.concat(*PATTERNS)))

    def terms(part: Column, low: Column, whole) -> Column:
        return F.transform(F.filter(found(part, TERM), whole), lambda t: F.struct(F.xxhash64(F.lower(t["value"])).alias("term"), (low + t["start"]).alias("start"), (low + t["end"]).alias("end")))

    def around(x: Column) -> Column:
        # A term cut by the window's edge isn't one.
        size = F.char_length(x["left"])
        before = terms(x["left"], x["start"] - size, lambda t: (t["start"] > 0) | ((size < WINDOW) & ~x["edge"]))
        after = terms(x["right"], x["end"], lambda t: t["end"] < WINDOW)
        return F.transform(F.concat(before, after), lambda t: F.struct(F.xxhash64(x["kind"], x["value"]).alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")))

    near = F.when(F.size("base") > 0, F.flatten(F.transform("base", around)))
    return written(rows.select("row", "doc_id", F.transform("base", lambda b: b.dropFields("value", "at", "left", "right", "edge")).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], near.alias("near")))


def term_counts(docs: DataFrame) -> DataFrame:
    """term (hash of the lower-cased word), n: occurrences in all whole texts."""
    words = pick(docs, "text").select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(TERM), F.lit(0))).alias("word"))
    return words.groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("n"))


def disclosures(near: DataFrame, counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """entity, term, disclosure for all pairs that stand together.

    Of a term's n occurrences c are near the entity, which a share p of all occurrences is: P(entity | term) is estimated as
    (c + prior p) / (n + prior). One occurrence at all thus tells less than ten of which all are near, in any corpus."""
    counts = written(counts)
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("together"))
    entities = pairs.groupBy("entity").agg(F.sum("together").alias("around"))
    pairs = pairs.join(entities, "entity").join(counts, "term").crossJoin(F.broadcast(total))
    chance = F.least(F.col("around") / F.col("total"), F.lit(0.999))
    given = F.least(F.lit(1.0), (F.col("together") + prior * chance) / (F.col("n") + prior))
    return pairs.select("entity", "term", (1 - F.log(given) / F.log(chance)).alias("disclosure"))


def free(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """hits (row, start, end) that overlap none of their row's base spans; both meet by stretches of WINDOW code points."""
    stretch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / WINDOW), F.floor((F.col(b) - 1) / WINDOW)))
    spans = rows.select(F.col("row").alias("r"), F.explode("base").alias("b")).select("r", F.col("b.start").alias("s"), F.col("b.end").alias("e"))
    spans = spans.withColumn("z", stretch("s", "e"))
    placed = hits.select("row", "start", "end").withColumn("at", stretch("start", "end"))
    met = placed.join(spans, (F.col("row") == F.col("r")) & (F.col("at") == F.col("z")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")))
    met = met.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    return hits.join(met, (F.col("row") == F.col("r")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), "left_anti")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, row, marks: a row for every input row.

    marks are all spans with what to do with them. Null text counts as empty: no spans, and the digest of nothing. Spans of
    different kinds may overlap; the terms' own kind is 'term'. A hot entity's pairs are summed before they are shuffled, and
    the join back is one that adaptive execution splits. Repeated rows come out repeated; empty tables give no rows.
    """
    rows = base_spans(docs)
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.*")
    telling = disclosures(near.select("entity", "term"), term_counts(docs), prior).filter(F.col("disclosure") >= generalise)
    telling = telling.select(F.col("entity").alias("e"), F.col("term").alias("t"), F.col("disclosure"))
    hits = near.join(telling, (F.col("entity") == F.col("e")) & (F.col("term") == F.col("t")))
    hits = free(written(hits.groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure"))), rows)
    terms = hits.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", F.lit("term").alias("kind"), "end", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("act"))).alias("terms"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("remove").alias("act")))
    order = {k: i for i, k in enumerate([*PATTERNS, "term"])}
    place = lambda x: F.struct(x["start"], F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), x["kind"]))
    both = F.array_sort(F.concat(base, F.col("terms")), lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))
    out = rows.join(terms, F.col("row") == F.col("r"), "left").withColumn("marks", F.when(F.col("terms").isNull(), base).otherwise(both))
    return out.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("marks")).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"), "row", "marks")


def sanitised(text: Column, marks: Column) -> Column:
    """text without what is removed, and with [kind] for what is generalised; of overlapping spans the first one counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.when(m["act"] == "generalise", F.concat(F.lit("["), m["kind"], F.lit("]"))).otherwise(""))
        return F.when(m["start"] < acc["at"], acc).otherwise(F.struct(m["end"].alias("at"), piece.alias("out")))

    return F.aggregate(marks, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
