"""Information-theoretic sanitisation, in DataFrame operations only.

Protected entities are the values of four base patterns (email, ip, card, phone). For a term t and an entity c that
occur together, corpus counts give

    IC(c) = -log2 P(c),   PMI(c; t) = IC(c) + log2 P(c | t),   P(c | t) = (n(c, t) + K P(c)) / (n(t) + K).

n counts rows of the corpus with the term, the entity, or both; K pseudo-counts of independence keep few counts from
saying too much. A term whose PMI is at least ALPHA * IC(c) discloses the entity, and is generalised in the texts that
hold both: to the longest of its beginnings (written with a *) that some term with enough texts shares, so many that
even if all texts of the entity were among them the PMI would stay below the threshold. A longer beginning has a higher
IC, so of all safe generalisations the most informative is taken; where none is safe the term is removed. Texts without
the entity keep the term: after sanitisation nothing published connects the two.

How it stays in proportion: PMI depends on an entity only through the texts that hold it, so entities with the same
texts (those of one text and its copies) count as one class. Terms in too many texts to disclose any class of their
text are left out before terms and classes are paired, and what was found returns to the texts along the pairs, not by
class, so a common entity doesn't meet all terms of all its texts.

Only texts with a trigger character of some pattern are searched for entities. Term counts of the whole corpus are one
aggregation with partial counts in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import stored

#: Fixed patterns. They match what the plain ones of the README match: possessive loops and starts at the edge of a
#: run only spare backtracking.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
TERM = "[\\p{L}\\p{N}]++"
KINDS = ("email", "ip", "card", "phone", "term")
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
ALPHA, K = 0.9, 0.5
#: Beginnings of a term have so many code points at least.
BEGIN = 3
#: Terms in most texts, which disclose nothing, that tasks drop at once; any others like them fall away in a join.
FREQUENT = 10_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.pmod(2 * F.try_to_number(c, F.lit("9")).cast("int") - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    digits = _digits(m)
    parts = F.transform(F.split(m, "\\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    small = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    return F.when(kind == "ip", small).when(kind == "card", F.length(digits).between(12, 19) & luhn(digits)).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def _cut(kind: str, pattern: str, when: Column) -> Column:
    """What lies between matches and the matches, in turn: their lengths give all places."""
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits")))


def _placed(rows: DataFrame, cuts: list[Column], uid: str = "uid") -> DataFrame:
    """(uid, kind, start, end, m): all matches with their places in code points, end exclusive."""
    cut = rows.select(uid, F.explode(F.array_compact(F.array(*cuts))).alias("c")).where(F.size("c.hits") > 0)
    flat = cut.select(uid, F.col("c.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("c.gaps").alias("gap"), F.col("c.hits").alias("hit"))).alias("pos", "x"))
    sized = flat.select(uid, "kind", "pos", F.length("x.gap").alias("gap"), F.col("x.hit").alias("m"))
    upto = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(Window.partitionBy(uid, "kind").orderBy("pos"))
    return sized.withColumn("end", upto).where("m is not null").select(uid, "kind", (F.col("end") - F.length("m")).alias("start"), "end", "m")


def triggered(text: Column) -> Column:
    return text.contains("@") | text.contains("+") | text.rlike("[0-9][0-9 .-]*[0-9]")


def base_spans(rows: DataFrame) -> DataFrame:
    """Base matches of rows(uid, text) that pass their checks."""
    text = F.col("text")
    many = text.rlike("[0-9]")
    cuts = [_cut("email", EMAIL, text.contains("@")), _cut("ip", IP, many), _cut("card", CARD, many), _cut("phone", PHONE, text.contains("+"))]
    return _placed(rows, cuts).where(valid(F.col("kind"), F.col("m")))


def entity(kind: Column, m: Column) -> Column:
    """One value for the ways to write an entity."""
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(m)).when(kind == "ip", m).otherwise(_digits(m)))


def lower_terms(column: str) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(TERM), F.lit(0)))


def _most(p: Column, dc: Column, alpha: float) -> Column:
    """Texts that a term may have at most to disclose a class with dc texts, a share p of all: with n(c, t) = dc."""
    return (dc + K * p) / F.pow(p, F.lit(1 - alpha)) - K


def beginnings(term: Column) -> Column:
    """All beginnings of a term of BEGIN code points or more, but itself."""
    return F.when(F.length(term) > BEGIN, F.transform(F.sequence(F.lit(BEGIN), F.length(term) - 1), lambda k: term.substr(F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def disclosing(docs_text: DataFrame, hits: DataFrame, spans: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(uid, term, to): terms of a text that disclose one of its entities, and their generalisation, null for none.

    docs_text(text) is the whole corpus, hits(uid, text) its texts that may have entities.
    """
    own = stored(spans.select("uid", entity(F.col("kind"), F.col("m")).alias("entity")).distinct(), "entities")
    # a class of entities: those with the same texts
    marks = own.groupBy("entity").agg(F.count("*").alias("dc"), F.bit_xor(F.xxhash64("uid")).alias("a"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("b"))
    owned = own.join(marks, "entity").select("uid", F.xxhash64("dc", "a", "b").alias("class"), "dc").distinct()
    n = max(1, docs_text.count())
    share = F.col("dc") / F.lit(float(n))
    owned = stored(owned.withColumn("most", F.when(share < 1, _most(share, F.col("dc"), alpha)).otherwise(0.0)), "owned")

    # counted in each task first, so the shuffle carries a task's distinct terms and not their occurrences
    df_t = stored(docs_text.select(F.explode(lower_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("dt")), "counts")
    limits = owned.groupBy("uid").agg(F.max("most").alias("limit"))
    top = limits.agg(F.max("limit")).first()[0] or 0.0
    usual = df_t.where(F.col("dt") > top).orderBy(F.desc("dt"), "term").limit(FREQUENT).select("term")
    terms = hits.join(limits, "uid").select("uid", "limit", F.explode(lower_terms("text")).alias("term")).join(F.broadcast(usual), "term", "left_anti")  # FREQUENT rows
    rare = terms.join(df_t.where(F.col("dt") <= top), "term").where(F.col("dt") <= F.col("limit")).select("uid", "term", "dt")
    pairs = stored(rare.join(owned, "uid").where(F.col("dt") <= F.col("most")).select("uid", "class", "term", "dt", "dc", "most"), "pairs")
    pmi = -F.log2(share) + F.log2((F.col("both") + K * share) / (F.col("dt") + K))
    flagged = pairs.groupBy("class", "term").agg(F.count("*").alias("both"), F.first("dt").alias("dt"), F.first("dc").alias("dc")).where(pmi >= -alpha * F.log2(share)).select("class", "term")
    found = stored(pairs.join(flagged, ["class", "term"]).groupBy("uid", "term").agg(F.max("most").alias("most")), "flagged")

    # the most texts that some term with a beginning has, a lower bound of the texts with that beginning
    wanted = found.select("term").distinct().select(F.explode(beginnings(F.col("term"))).alias("to")).distinct()
    least = found.agg(F.min("most")).first()[0] or 0.0
    shared = df_t.where(F.col("dt") > least).select(F.explode(F.concat(beginnings(F.col("term")), F.array("term"))).alias("to"), "dt").where(F.length("to") >= BEGIN)
    shared = stored(shared.groupBy("to").agg(F.max("dt").alias("dg")).join(wanted, "to", "left_semi"), "beginnings")
    safe = found.select("uid", "term", "most", F.explode_outer(beginnings(F.col("term"))).alias("to")).join(shared, "to", "left")
    best = F.max(F.when(F.col("dg") > F.col("most"), F.struct(F.length("to").alias("n"), "to")))
    return safe.groupBy("uid", "term").agg(best.alias("g")).select("uid", "term", F.concat("g.to", F.lit("*")).alias("to"))


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, with_text: bool = True) -> DataFrame:
    """The rows with n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, and with_text the sanitised text in
    clean_text and all columns of docs.

    Counts and base_sha256 are of base spans; spans holds all, as kind:start:end by start, then kind. A term inside a
    base span adds none. clean_text replaces base spans by their tags, disclosing terms by their generalisation, with
    none by nothing, and of spans that overlap the first; a null text gives a null clean_text and no spans. Repeated
    rows are each answered and each count. Columns of docs with the names of new ones are replaced.
    """
    empty = F.sha2(F.lit(""), 256)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = docs.columns if with_text else [id_col]
    extra = ["n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans", *(["clean_text"] if with_text else [])]
    out = [c for c in keep if c not in extra]
    plain = docs.where(~triggered(text)).select(*out, *(F.lit(0).cast("long").alias(c) for c in extra[:5]), empty.alias("base_sha256"), F.lit("").alias("spans"), *([F.col(text_col).alias("clean_text")] if with_text else []))
    hits = stored(docs.where(triggered(text)).select(F.struct(*out).alias("row"), text.alias("text"), F.monotonically_increasing_id().alias("uid")), "hits")
    base = stored(base_spans(hits.select("uid", "text")), "spans")
    found = stored(disclosing(docs.select(text.alias("text")), hits.select("uid", "text"), base, alpha), "terms")

    words = _placed(hits.join(found.select("uid").distinct(), "uid").select("uid", "text"), [_cut("term", TERM, F.lit(True))])
    terms = words.withColumn("term", F.lower("m")).join(found, ["uid", "term"]).select("uid", "kind", "start", "end", "to")
    inside = terms.join(base.select("uid", F.col("start").alias("s"), F.col("end").alias("e")), "uid").where("s < end and start < e").select("uid", "start").distinct()
    terms = terms.join(inside, ["uid", "start"], "left_anti")

    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    tag = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))[F.col("kind")]
    every = base.select("uid", "kind", "start", "end", tag.alias("to")).unionByName(terms.select("uid", "kind", "start", "end", F.coalesce("to", F.lit("")).alias("to")))
    span = F.struct("start", rank.alias("rank"), "end", "to")
    per = every.groupBy("uid").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS), F.collect_list(F.when(F.col("kind") != "term", span)).alias("own"), F.collect_list(span).alias("all"))
    rows = hits.join(per, "uid", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS]
    lists = [F.coalesce(F.sha2(_listed(F.col("own")), 256), empty).alias("base_sha256"), F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans")]
    clean = [_replaced(F.col("text"), F.array_sort("all")).alias("clean_text")] if with_text else []
    return plain.unionByName(rows.select("row.*", *counts, *lists, *clean))


def _replaced(text: Column, spans: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(text.substr(a["at"] + 1, (s["start"] - a["at"]).cast("int")), s["to"])
        return F.when(s["start"] >= a["at"], F.struct(s["end"].cast("int").alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))).otherwise(a)

    done = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["at"] + 1, F.length(text))))
    return F.when(spans.isNull(), text).otherwise(done)
