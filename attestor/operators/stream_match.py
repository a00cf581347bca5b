"""Exact and fuzzy matching of claims in an ordered stream of passages, across passage borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.align import rank_of


def token_stream(passages: DataFrame, part: str, order: str, words: Column) -> DataFrame:
    """part, pos, id, at, n, word: each word with its place in its part's stream and in its passage of n words.

    ``part`` keeps streams apart (a collection, a conversation); running sums go by part, so a corpus of many parts
    is never one task's work."""
    p = passages.select(F.col(part).alias("part"), F.col(order).alias("id"), words.alias("w"))
    before = F.sum(F.size("w")).over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    p = p.select("part", "id", F.coalesce(before, F.lit(0)).alias("base"), F.size("w").alias("n"), "w")
    return p.select("part", "id", "base", "n", F.posexplode("w").alias("at", "word")).select("part", (F.col("base") + F.col("at")).alias("pos"), "id", "at", "n", "word")


def exact_matches(claims: DataFrame, stream: DataFrame, limit: int | None = 50) -> DataFrame:
    """claim_id, part, start_id, end_id, whole, pos: every occurrence of the claim's words in the stream, overlapping
    ones too; whole: it covers whole passages. claims: (claim_id, words).

    The claim's rarest word is looked up; the places it gives are then met with the stream on (part, place, word) for
    all words and counted. ``limit`` keeps the first so many of each claim in stream order."""
    counts = stream.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    asked = claims.select("claim_id", F.size("words").alias("n_words"), F.posexplode("words").alias("k", "word"))
    anchor = asked.join(counts, "word").groupBy("claim_id").agg(F.min_by(F.struct("k", "word"), F.struct("freq", "k")).alias("a"), F.count(F.lit(1)).alias("have"), F.first("n_words").alias("n_words"))
    anchor = anchor.where("have = n_words").select("claim_id", "n_words", F.col("a.k").alias("k"), F.col("a.word").alias("word"))
    starts = stream.join(anchor, "word").where("pos >= k").select("claim_id", "n_words", "part", (F.col("pos") - F.col("k")).alias("start"))
    wanted = starts.join(asked.select("claim_id", "k", "word"), "claim_id").withColumn("pos", F.col("start") + F.col("k"))
    met = wanted.join(stream, ["part", "pos", "word"]).groupBy("claim_id", "part", "start").agg(
        F.count(F.lit(1)).alias("have"), F.first("n_words").alias("n_words"),
        F.min(F.struct("pos", "id", "at", "n")).alias("first"), F.max(F.struct("pos", "id", "at", "n")).alias("last"),
    )
    out = met.where("have = n_words").select(
        "claim_id", "part", F.col("first.id").alias("start_id"), F.col("last.id").alias("end_id"),
        ((F.col("first.at") == 0) & (F.col("last.at") == F.col("last.n") - 1)).alias("whole"), F.col("start").alias("pos"),
    )
    if limit is None:
        return out
    w = Window.partitionBy("claim_id").orderBy("part", "pos")
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def pick_occurrence(matches: DataFrame) -> DataFrame:
    """Best occurrence of each claim (whole passages first, then the lowest place) and the others, in order."""
    w = Window.partitionBy("claim_id").orderBy(F.desc("whole"), "part", "start_id", "pos")
    ranked = matches.withColumn("__n", F.row_number().over(w))
    others = F.array_sort(F.collect_list(F.when(F.col("__n") > 1, F.struct("__n", "part", "start_id", "end_id"))))
    rest = ranked.groupBy("claim_id").agg(F.transform(others, lambda x: F.struct(x["part"].alias("part"), x["start_id"].alias("start_id"), x["end_id"].alias("end_id"))).alias("others"))
    return ranked.where("__n = 1").drop("__n", "pos").join(rest, "claim_id")


def windows(candidates: DataFrame, passages: DataFrame, part: str, order: str, text: str, reach: int = 12, also: dict[str, str] | None = None) -> DataFrame:
    """Grows each candidate (claim_id, part, id, n_words) to a window of consecutive passages: one back if it is
    shorter than the claim, then on until it has two words more than the claim, at most ``reach`` further passages.

    Adds start_id, end_id, window_text, and rows (id, n) in order; for each further spelling in ``also`` (name to column)
    window_<name> and rows_<name> of the same passages. Passages are numbered by one within a part. A candidate asks for
    the few passages that it may take in by their numbers, so no part is ever met as a whole."""
    texts = {"": text, **{f"_{n}": c for n, c in (also or {}).items()}}
    size = lambda c: F.size(F.array_remove(F.split(F.coalesce(F.col(c), F.lit("")), " "), ""))
    p = passages.select(F.col(part).alias("part"), F.col(order).cast("long").alias("pid"), *(F.struct(F.coalesce(F.col(c), F.lit("")).alias("t"), size(c).alias("n")).alias(f"w{k}") for k, c in texts.items()))
    at = F.col("id").cast("long")
    own = candidates.select("claim_id", "part", "id", "n_words", F.explode(F.sequence(at - 1, at + reach)).alias("pid")).join(p, ["part", "pid"])
    rows = F.array_sort(F.collect_list(F.struct("pid", *(f"w{k}" for k in texts))))
    near = own.groupBy("claim_id", "part", "id", "n_words").agg(rows.alias("near"))
    # one back only if the passage is shorter than the claim
    itself = F.filter("near", lambda r: r["pid"] == at)
    near = near.withColumn("near", F.when(F.get(itself, 0)["w"]["n"] < F.col("n_words"), F.col("near")).otherwise(F.filter("near", lambda r: r["pid"] >= at)))
    # on while the words so far are fewer than wanted: a running sum over the few rows of a window
    before = F.transform("near", lambda r, i: F.struct(r.alias("r"), F.aggregate(F.slice("near", 1, i), F.lit(0), lambda s, x: s + x["w"]["n"]).alias("before")))
    first = F.get("near", 0)["pid"]
    kept = F.transform(F.filter(before, lambda x: (x["r"]["pid"] <= at) | ((x["before"] < F.col("n_words") + 2) & (x["r"]["pid"] - first <= reach))), lambda x: x["r"])
    near = near.select("claim_id", "part", "id", "n_words", kept.alias("kept"))
    out = [F.get("kept", 0)["pid"].alias("start_id"), F.element_at("kept", -1)["pid"].alias("end_id")]

    def spelling(k: str) -> list[Column]:
        texts_ = F.filter(F.transform("kept", lambda r: r[f"w{k}"]["t"]), lambda t: t != "")
        sizes = F.transform("kept", lambda r: F.struct(r["pid"].alias("id"), r[f"w{k}"]["n"].alias("n")))
        return [F.array_join(texts_, " ").alias(f"window{k}" if k else "window_text"), sizes.alias(f"rows{k}")]

    for k in texts:
        out += spelling(k)
    return near.where("size(kept) > 0").select("claim_id", "part", "id", "n_words", *out)


def shrink(rows: Column, start: Column, end: Column) -> Column:
    """Struct (start_id, end_id): the passages of a window that the aligned words [start, end) cover."""
    upto = F.transform(rows, lambda r, i: F.struct(r["id"].alias("id"), r["n"].alias("n"), F.aggregate(F.slice(rows, 1, i), F.lit(0), lambda s, x: s + x["n"]).alias("pos")))
    covered = F.filter(upto, lambda r: (r["pos"] < end) & (r["pos"] + r["n"] > start))
    return F.struct(F.get(covered, 0)["id"].alias("start_id"), F.try_element_at(covered, F.lit(-1))["id"].alias("end_id"))


def best_match(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The match of each key of the best class, then coverage (2 places), span similarity (3), confidence, first rank."""
    order = [F.desc(rank_of(F.col("match_type"))), F.desc(F.bround("coverage", 2)), F.desc(F.bround("span_sim", 3)), F.desc("confidence"), F.col("rank")]
    return matches.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
