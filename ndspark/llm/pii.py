"""Information-theoretic removal of personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lookup, materialize, stored, whole

#: The contract's patterns, in the order of the spans. They are guarded so that long runs take linear
#: time: a match starts at the start of a run or where the last one ended, and runs aren't given back.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words and numbers that can reveal an entity, and what separates them.
TERM, REST = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
#: Shorter ones are too common to reveal anything.
SHORTEST = 2
#: Up to so many candidate terms are broadcast; more are joined by a shuffle. A term has at most `context` characters.
SMALL = 100_000
#: Long texts are cut into blocks of so many characters before places in them are looked up.
BLOCK = 16_384


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
        .when(kind == 2, F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def running(values: Column, step: int = 512) -> Column:
    """Running sums of an array, in steps, so that a long one takes time nearly in proportion."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / step).cast("int")), lambda i: F.aggregate(F.slice(values, i * step + 1, F.lit(step)), F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))
    ahead = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.element_at(x, -1)))
    return F.flatten(F.zip_with(parts, F.slice(ahead(parts), F.lit(1), F.size(parts)), lambda x, o: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda y: y + o)))


def base_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, id, spans (kind, start, end, value), and the text of rows that have any: a row each row of df.

    Splitting and extracting find the same matches, so positions are running sums of lengths.
    """
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), whole(text_col).alias("text"))
    text = F.col("text")
    possible = [F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9]"), F.contains(text, F.lit("+"))]
    for k, (pattern, maybe) in enumerate(zip(PATTERNS.values(), possible)):
        rows = rows.withColumns({f"found{k}": F.regexp_extract_all(F.when(maybe, text), F.lit(pattern), F.lit(0)), f"parts{k}": F.split(F.when(maybe, text), pattern, -1)})
    for k in range(len(PATTERNS)):
        rows = rows.withColumn(f"sizes{k}", F.zip_with(f"found{k}", F.slice(f"parts{k}", F.lit(1), F.size(f"found{k}")), lambda m, p: F.length(m) + F.length(p)))
    each = lambda k: F.coalesce(F.filter(F.zip_with(f"found{k}", running(F.col(f"sizes{k}")), lambda m, e: F.struct(F.lit(k).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))), lambda s: valid(F.lit(k), s["value"])), F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>"))
    rows = rows.select("rid", "id", F.concat(*[each(k) for k in range(len(PATTERNS))]).alias("spans"), "text")
    return rows.select("rid", "id", "spans", F.when(F.size("spans") > 0, text).alias("text"))


def lowered(text) -> Column:
    """In lower case, each character in its place."""
    return F.lower(F.translate(text, "\u0130", "i"))


def entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == 0, F.lower(value)).otherwise(F.regexp_replace(value, r"[^0-9.]", "")))


def window_terms(base: DataFrame, context: int) -> DataFrame:
    """The terms within `context` characters of each base span: rid, entity, window (a hash of it), term."""
    text = F.col("text")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK + context)))
    # blocks are looked up twice below, so the optimizer leaves them a column of their own
    rows = base.where("text IS NOT NULL").select("rid", "spans", F.length(text).alias("n"), blocks.alias("blocks"))
    cut = lambda a, size: F.substring(F.get("blocks", F.floor(a / BLOCK).cast("int")), F.pmod(a, F.lit(BLOCK)) + 1, size)
    first = lambda s: F.greatest(F.lit(0), s["start"] - context)
    around = F.transform("spans", lambda s: F.struct(entity(s["kind"], s["value"]).alias("entity"), cut(first(s), s["start"] - first(s)).alias("before"), cut(s["end"], F.lit(context)).alias("after"), (first(s) > 0).alias("left"), (s["end"] + context < F.col("n")).alias("right")))
    rows = rows.select("rid", F.explode(around).alias("x")).select("rid", "x.*")
    # a word that the window's edge cuts is none
    before = F.when(F.col("left"), F.regexp_replace("before", rf"^{TERM}", "")).otherwise(F.col("before"))
    after = F.when(F.col("right"), F.regexp_replace("after", rf"{TERM}$", "")).otherwise(F.col("after"))
    rows = rows.select("rid", "entity", F.xxhash64("before", "after").alias("window"), F.explode(F.array_distinct(F.split(lowered(F.concat(before, F.lit(" "), after)), REST, -1))).alias("term"))
    return rows.where(F.length("term") >= SHORTEST)


def doc_terms(text) -> Column:
    """The distinct terms of a whole text."""
    return F.array_distinct(F.split(lowered(text), REST, -1))


def disclosing(df: DataFrame, text_col: str, base: DataFrame, context: int, alpha: float, support: int) -> DataFrame | None:
    """rid, term, strength: the terms of documents that reveal an entity in the same document; None if no term does.

    strength = PMI(term; entity) / IC(entity) by the number of documents that hold the term, the entity
    and both, anywhere in them, out of all; 1 where a term occurs with the entity only. Candidates
    are the pairs that meet within `context` characters in `support` different surroundings, so copies of one
    passage prove nothing; at least `support` documents must hold both. Pairs that can't reach alpha by the counts of either alone are not counted together.
    """
    terms = materialize(window_terms(base, context))
    pairs = materialize(terms.groupBy("entity", "term", "window").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("windows")).where(F.col("windows") >= support).select("entity", "term"))
    wanted = materialize(pairs.select("term").distinct())
    if (n := wanted.count()) == 0:
        return None
    among = lambda rows: rows.join(F.broadcast(wanted), "term", "left_semi") if n <= SMALL else rows
    counts = among(df.select(F.explode(doc_terms(whole(text_col))).alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("ct"))
    held = base.where("text IS NOT NULL")
    entities = materialize(held.select("rid", F.explode(F.array_distinct(F.transform("spans", lambda s: entity(s["kind"], s["value"])))).alias("entity")))
    some = among(held.select("rid", F.explode(doc_terms("text")).alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("cm"))
    ces = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("ce"))
    total = float(df.count())
    ic = F.greatest(F.log2(F.lit(total) / F.col("ce")), F.lit(1e-9))
    strength = lambda both: F.log2(both * total / (F.col("ct") * F.col("ce"))) / ic
    known = pairs.join(counts, "term").join(some, "term").join(ces, "entity").where((strength(F.least("cm", "ce")) >= alpha) & (F.least("cm", "ce") >= support))
    known = materialize(known.select("entity", "term", "ct", "cm", "ce"))
    # one row a term with its entities, few by now; documents that hold it get them, frequent terms are dealt out
    of = materialize(known.groupBy("term").agg(F.collect_list("entity").alias("entities"), F.max("cm").alias("cm")))
    if (n := of.count()) == 0:
        return None
    held = materialize(held.select("rid", F.explode(doc_terms("text")).alias("term")).join(F.broadcast(of.select("term")) if n <= SMALL else of.select("term"), "term", "left_semi"))
    both = lookup(held, of, ["term"], "cm", held.count(), F.xxhash64("rid")).select("rid", "term", F.explode("entities").alias("entity"))
    both = materialize(both.join(entities, ["rid", "entity"], "left_semi"))
    told = known.join(both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")), ["entity", "term"])
    told = materialize(told.where((strength(F.col("both")) >= alpha) & (F.col("both") >= support)).select("entity", "term", strength(F.col("both")).alias("strength"), "both"))
    if told.isEmpty():
        return None
    return lookup(both, told, ["entity", "term"], "both", both.count(), F.xxhash64("rid")).where("strength IS NOT NULL").groupBy("rid", "term").agg(F.max("strength").alias("strength"))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 80, alpha: float = 0.9, support: int = 2) -> DataFrame:
    """id, spans: array of (kind, start, end, strength) in code points, by kind as in KINDS, then start; a row each row of df.

    Base kinds come from the patterns and their checks. A term is added wherever it occurs in a
    document that holds an entity which it reveals (see disclosing): found near it in at least
    `support` different surroundings and documents, and PMI over information content, by counts over all documents, at
    least alpha. Terms that a base span covers in part are none. Terms are words or numbers of two characters and
    more, case aside.

    Null text counts as empty. Null identifiers and repeated rows are rows like others. An empty
    table gives no row. Other columns of the input are not read.
    """
    base = stored(base_spans(df, id_col, text_col))
    told = disclosing(df, text_col, base, context, alpha, support)
    known = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("double").alias("strength")))
    if told is None:
        return base.select("id", F.sort_array(known).alias("spans"))
    told = materialize(told)
    rows = base.join(told.select("rid").distinct(), "rid", "left_semi").select("rid", F.regexp_extract_all(lowered("text"), F.lit(TERM), F.lit(0)).alias("found"), F.split(lowered("text"), TERM, -1).alias("parts"))
    rows = rows.select("rid", "found", F.zip_with("found", F.slice("parts", F.lit(1), F.size("found")), lambda m, p: F.length(m) + F.length(p)).alias("sizes"))
    rows = rows.select("rid", F.explode(F.arrays_zip("found", running(F.col("sizes")).alias("ends"))).alias("x")).select("rid", F.col("x.found").alias("term"), F.col("x.ends").alias("end"))
    places = rows.join(told, ["rid", "term"]).select("rid", (F.col("end") - F.length("term")).alias("start"), "end", "strength", F.lit(None).cast("int").alias("opens"), F.lit(None).cast("int").alias("closes"))
    cover = base.join(told.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode("spans").alias("s")).select("rid", "s.start", "s.end", F.lit(None).cast("double").alias("strength"), F.col("s.start").alias("opens"), F.col("s.end").alias("closes"))
    # in the order of the text: what a base span before a term closes, and in reverse what one after it opens
    own, upto = Window.partitionBy("rid"), (Window.unboundedPreceding, Window.currentRow)
    told_apart = places.unionByName(cover).select("rid", "start", "end", "strength", F.max("closes").over(own.orderBy("start", F.desc_nulls_last("closes")).rowsBetween(*upto)).alias("closed"), F.min("opens").over(own.orderBy(F.desc("start"), "end").rowsBetween(*upto)).alias("opened"))
    free = told_apart.where("strength IS NOT NULL AND coalesce(closed <= start, true) AND coalesce(opened >= end, true)")
    terms = free.groupBy("rid").agg(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end", "strength")).alias("terms"))
    every = base.select("rid", "id", "spans").join(terms, "rid", "left")
    return every.select("id", F.sort_array(F.when(F.col("terms").isNull(), known).otherwise(F.concat(known, "terms"))).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 80, alpha: float = 0.9, support: int = 2) -> DataFrame:
    """df with the spans of find_pii replaced in its text: base ones by their kind, terms removed where
    they reveal an entity fully (strength 1), else generalised to [NUMBER] or [WORD].

    Rows are matched by identifier; rows with a null identifier or that share one are sanitised by
    the spans found in rows of the same text. Cases else as in find_pii.
    """
    rows = df.withColumn("_key", F.struct(F.col(id_col), F.xxhash64(text_col)))
    found = find_pii(rows, "_key", text_col, context, alpha, support)
    found = found.groupBy("id").agg(F.first("spans").alias("_spans")).withColumnRenamed("id", "_found")
    text = whole(text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])

    def step(acc: Column, s: Column) -> Column:
        old = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        tag = F.when(s["kind"] < 4, F.get(names, s["kind"])).when(s["strength"] >= 1 - 1e-9, "").when(old.rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]")
        new = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    ordered = F.array_sort(F.col("_spans"), lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), a["kind"] - b["kind"]))
    merged = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    both = rows.join(found, rows["_key"].eqNullSafe(found["_found"]), "left")
    return both.withColumn(text_col, F.when(F.size("_spans") > 0, merged).otherwise(F.col(text_col))).select(*df.columns)


def counted(found: DataFrame) -> DataFrame:
    """The digest columns of what find_pii gives."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select(F.col("id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(find_pii(documents(spark, sf_dir)))
