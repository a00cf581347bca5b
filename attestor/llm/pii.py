"""Personal data: base patterns, and contextual patterns bootstrapped from them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import read_table, write_table

#: Base patterns in the order of the kinds. Repeats are possessive where nothing that follows can need a shorter one,
#: and a failed run is not tried again from within, so each takes time in proportion to the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: a word with a digit and four signs or more after it, of any length, also after a plus.
CANDIDATE = r"(?<![A-Za-z0-9])\+?+[A-Za-z]*+[0-9][A-Za-z0-9._@+-]{4,}+"
KINDS = [("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("id", CANDIDATE)]

IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Least seeds of a pattern, its least confidence at the end, rounds of scoring, and what unseen instances weigh.
SUPPORT, CONFIDENCE, ROUNDS, SMOOTH = 5, 0.8, 3, 1.0
#: Hops end when no instance is discovered any more; more than this is an error.
MOST_HOPS = 60


def _tail(c: Column) -> Column:
    """The last two words and what follows them, of any length. The text is turned round, so that the pattern starts
    where it must match and takes no more time than what it finds is long."""
    return F.reverse(F.regexp_extract(F.reverse(c), r"^\S*+(?:\s++\S++){0,2}", 0))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, i, gap, m, before): the i-th match, the code points since the one before, and the end of what
    stands there. The text is split only where something matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # let-binding: each lambda sees its array evaluated once
    return F.flatten(
        F.transform(
            F.array(F.struct(found.alias("m"), text.alias("t"))),
            lambda x: F.when(
                F.size(x["m"]) > 0,
                F.transform(
                    F.arrays_zip(x["m"].alias("m"), F.transform(F.split(x["t"], pattern, -1), lambda p: F.struct(F.length(p).alias("n"), _tail(p).alias("b"))).alias("p")),
                    lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["p"]["n"].cast("long").alias("gap"), z["m"].alias("m"), z["p"]["b"].alias("before")),
                ),
            ).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:bigint,m:string,before:string>>")),
        )
    )


def _valid() -> Column:
    digits = F.regexp_replace("m", "[^0-9]", "")
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("m").rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
        .when(F.col("kind") == "card", F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One scan: (rows with rid and doc_id; spans with rid, kind, start, end, m, before, base), both written."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = t.rlike("[0-9@]")
    kind = "array<struct<kind:string,i:int,gap:bigint,m:string,before:string>>"
    found = F.when(some, F.concat(*(_matches(t, k, p) for k, p in KINDS))).otherwise(F.array().cast(kind))
    rows = write_table(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")), "pii-rows"
    )
    flat = rows.select("rid", F.inline("found")).where("m is not null").withColumn("n", F.length("m").cast("long"))
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    spans = flat.withColumn("end", end).select("rid", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "m", "before", _valid().alias("base"))
    return rows.select("rid", "doc_id"), write_table(spans.where("base or kind = 'id'"), "pii-spans")


def _candidates(spans: DataFrame) -> DataFrame:
    """Identifier-like words that touch no base span; a base span before or after in the document decides."""
    w = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return (
        spans.withColumn("b", F.coalesce(before, F.lit(0))).withColumn("a", F.coalesce(after, F.col("end")))
        .where("not base and b <= start and a >= end").drop("a", "b")
    )


def patterns_of(before: Column) -> Column:
    """Lexical patterns of an instance: the last word, or last two, before it, with the signs between. What the instance
    itself looks like is no part of them, so a context learned from seeds of one shape finds instances of any."""
    left = F.regexp_replace(F.lower(before), "[0-9]+", "0")
    one, two = (F.regexp_extract(left, rf"(?s)^(?:.*\s)??((?:[^\s]++\s++){{{n}}}[^\s]*+)$", 1) for n in (1, 2))
    return F.array_distinct(F.filter(F.array(*(F.when(x != "", F.trim(x)) for x in (one, two))), lambda x: x.isNotNull()))


def bootstrap(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) of the patterns kept, and the candidates' (rid, start, end) they discover.

    Graph: pattern - instance, from every span of the corpus. Seeds weigh 1 throughout. Each round a pattern's
    confidence is the mean weight of its instances (smoothed), and an instance's weight the noisy-or of its patterns'
    confidences; patterns with few seeds never count. What patterns of high confidence discover are seeds of the next
    hop, in all contexts they stand in and with the able patterns found anew, until a hop discovers nothing."""
    candidates = write_table(_candidates(spans).select("rid", "start", "end", "m", F.explode(patterns_of(F.col("before"))).alias("pattern")), "pii-candidates")
    seeds = spans.where("base").select("m", F.explode(patterns_of(F.col("before"))).alias("pattern"))
    every = write_table(
        seeds.withColumn("seed", F.lit(1)).unionByName(candidates.select("m", "pattern", F.lit(0).alias("seed")))
        .groupBy("pattern", "m").agg(F.max("seed").alias("seed")), "pii-edges",
    )
    for _ in range(MOST_HOPS):
        able = write_table(every.groupBy("pattern").agg(F.sum("seed").alias("seeds")).where(F.col("seeds") >= SUPPORT).select("pattern"), "pii-able")
        edges = write_table(every.join(able, "pattern"), "pii-graph")
        kept = _scores(edges).where(F.col("confidence") >= CONFIDENCE)
        new = write_table(edges.where("seed = 0").join(kept, "pattern").select("m", F.lit(1).alias("new")).distinct(), "pii-discovered")
        if new.isEmpty():
            break
        every = write_table(every.join(new, "m", "left").select("pattern", "m", F.greatest("seed", F.coalesce("new", F.lit(0))).alias("seed")), "pii-edges")
    else:
        raise RuntimeError(f"personal data: instances were still discovered after {MOST_HOPS} hops")
    found = candidates.join(kept, "pattern").select("rid", "start", "end").distinct()
    return kept, found


def _scores(edges: DataFrame) -> DataFrame:
    """(pattern, confidence) after the rounds of one hop. edges: pattern, m, seed."""
    weighted = edges.withColumn("w", F.col("seed").cast("double"))
    for r in range(ROUNDS):
        scores = write_table(
            weighted.groupBy("pattern").agg((F.sum("w") / (F.count(F.lit(1)) + SMOOTH)).alias("confidence")), "pii-scores"
        )
        if r == ROUNDS - 1:
            break
        odds = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        unseen = edges.where("seed = 0").join(scores, "pattern").groupBy("m").agg((1 - F.exp(odds)).alias("w"))
        unseen = write_table(unseen, "pii-weights")
        weighted = edges.join(unseen, "m", "left").withColumn("w", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("w", F.lit(0.0))))
    return scores


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    The counts and the digest are those of the base spans; spans adds, as kind ``id``, what contextual patterns of
    high confidence discover. Null texts count as empty and give no span; repeated rows are found each (but weigh as
    one instance); an empty table gives an empty result; other columns are ignored."""
    rows, spans = find(docs, text)
    _, added = bootstrap(spans)
    order = F.create_map(*(F.lit(x) for i, (k, _) in enumerate(KINDS) for x in (k, i)))
    every = spans.where("base").select("rid", "kind", "start", "end").unionByName(added.select("rid", F.lit("id").alias("kind"), "start", "end"))
    by = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(order[F.col("kind")].alias("o"), "start", "end", "kind"))).alias("s"))
    s = F.coalesce("s", F.array().cast("array<struct<o:int,start:bigint,end:bigint,kind:string>>"))

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k, _ in KINDS[:4]]
    base = F.filter(s, lambda x: x["kind"] != "id")
    return rows.join(by, "rid", "left").select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))
