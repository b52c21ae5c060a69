"""URL filtering: rules first, a character language-model ratio for what no rule decides.

Rules: (host suffix, path prefix, verdict); a rule fits its host and all subdomains if the url's path starts
with the rule's; the longest rule wins.

The method: two smoothed variable-order Markov models over characters, one of the urls that a rule accepts and
one of those that a rule rejects. Every context of up to ``ORDER`` characters that a class has shown is known to its model.
In a known context the probability of a character is smoothed towards the shorter context's by Witten-Bell:
(n(context, c) + d(context) * p(c | shorter)) / (n(context) + d(context)); an unknown context leaves
the shorter one's, and below order 0 every one of ``ALPHABET`` characters is as likely.

The models are tables. What a character adds to a score follows from it and the ``ORDER`` before it, so each distinct
string of ORDER + 1 characters is scored once, order by order, in joins whose keys hold at most one row for each
character; then every character meets its string's part: the strings that are 1 / ``HOT`` of all
characters or more (at most ``HOT`` by the pigeonhole principle) by a broadcast, the others in a plain join.

A url's score is the difference of its two log-likelihoods divided by its length. The models learn from
four fifths of the decided urls (by a hash of the url); the threshold is the one that decides most of the
other fifth rightly, with each class weighing a half (ties: the smallest). Urls from there on are allowed.
Where a class has no urls to learn from, the method allows.

Rows: a null url has an empty host and path and score 0, and so has an empty one. Repeated rows are judged as
separate rows. Extra columns are ignored; an empty table gives an empty result. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.session import ensure_checkpoint_dir

ORDER = 3
HOT = 20_000
ALPHABET = 256
BINS = 400  # of the threshold search, over scores from -5 to 5
START = "\u0002"

#: (host, path, verdict) of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased (A-Z) host after the first ``://`` and the path before the query; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    tested = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = None
    for name, prefix, verdict in tested:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _chars(urls: DataFrame) -> DataFrame:
    """A row for each character of ``url`` with it and the three before: column ``gram`` of ORDER + 1 characters."""
    padded = F.concat(F.lit(START * ORDER), "url")
    rows = urls.withColumn("padded", padded).filter(F.char_length("url") > 0)
    return (rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("url"))))
            .withColumn("gram", F.substr("padded", F.col("at"), F.lit(ORDER + 1))).drop("padded", "at"))


def _tail(k: int, of: str = "gram") -> Column:
    """The last k + 1 characters."""
    return F.substr(F.col(of), F.lit(ORDER + 1 - k), F.lit(k + 1))


def _context(k: int, of: str = "gram") -> Column:
    return F.substr(F.col(of), F.lit(ORDER + 1 - k), F.lit(k))


def _models(decided: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order k: strings (s, a, b) of k + 1 characters and contexts (c, a, b) of k characters, where a and b
    are the log-probabilities (of the last character; of the escape) under the accepted and the rejected model."""
    full = _chars(decided).groupBy("gram").agg(*[
        F.sum((F.col("verdict") == v).cast("long")).alias(n) for n, v in (("na", "allow"), ("nb", "block"))]).checkpoint()
    strings, contexts, shorter = [], [], None
    for k in range(ORDER + 1):
        grams = full.groupBy(_tail(k).alias("s"), _context(k).alias("c")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        known = grams.groupBy("c").agg(*[f(x).alias(y) for x in "ab" for f, x, y in (
            (F.sum, f"n{x}", f"n{x}_c"), (lambda col: F.sum((F.col(col) > 0).cast("long")), f"n{x}", f"d{x}_c"))]).checkpoint()
        escape = lambda x: F.when(F.col(f"n{x}_c") > 0, F.log(F.col(f"d{x}_c") / (F.col(f"n{x}_c") + F.col(f"d{x}_c")))).otherwise(0.0)
        contexts.append(known.select("c", escape("a").alias("a"), escape("b").alias("b")))
        seen = grams.join(known, "c")
        if k:
            less = shorter.select(F.col("s").alias("s_less"), F.col("a").alias("a_less"), F.col("b").alias("b_less"))
            seen = seen.join(less, F.substr("s", F.lit(2)) == F.col("s_less"))  # every string's end is a string too
        else:
            seen = seen.withColumn("a_less", F.lit(0.0) - F.log(F.lit(float(ALPHABET)))).withColumn("b_less", F.col("a_less"))
        smooth = lambda x: F.when(F.col(f"n{x}_c") > 0, F.log(
            (F.col(f"n{x}") + F.col(f"d{x}_c") * F.exp(f"{x}_less")) / (F.col(f"n{x}_c") + F.col(f"d{x}_c")))).otherwise(F.col(f"{x}_less"))
        shorter = seen.select("s", smooth("a").alias("a"), smooth("b").alias("b")).checkpoint()
        strings.append(shorter)
    return strings, contexts


def _parts(grams: DataFrame, models: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """(gram, part) of the distinct strings ``grams``: the difference of the two log-probabilities of their last character."""
    strings, contexts = models
    shorter = None
    for k in range(ORDER + 1):
        rows = (grams.select(_tail(k).alias("s")).distinct().withColumn("c", F.substr("s", F.lit(1), F.lit(k)))
                .join(strings[k].select("s", F.struct("a", "b").alias("m")), "s", "left")
                .join(contexts[k].select("c", F.struct("a", "b").alias("e")), "c", "left"))
        if k:
            rows = rows.join(shorter, F.substr("s", F.lit(2)) == F.col("s_less"))
        less = {x: F.col(f"{x}_less") if k else F.lit(0.0) - F.log(F.lit(float(ALPHABET))) for x in "ab"}
        found = lambda x: F.when(F.col("m").isNotNull(), F.col(f"m.{x}")).otherwise(F.coalesce(F.col(f"e.{x}"), F.lit(0.0)) + less[x])
        shorter = rows.select(F.col("s").alias("s_less"), found("a").alias("a_less"), found("b").alias("b_less"))
    return shorter.select(F.col("s_less").alias("gram"), (F.col("a_less") - F.col("b_less")).alias("part"))


def _scored(urls: DataFrame, models: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """(rid, score) of the rows (rid, url)."""
    counts = _chars(urls).groupBy("gram").agg(F.count("*").alias("n")).checkpoint()
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    valued = _parts(counts.select("gram"), models).join(counts, "gram").crossJoin(total).checkpoint()
    hot = F.broadcast(valued.filter(F.col("n") * HOT >= F.col("total")).select("gram", "part"))
    rare = valued.filter(F.col("n") * HOT < F.col("total")).select("gram", F.col("part").alias("part_rare"))
    chars = _chars(urls).select("rid", "gram").join(hot, "gram", "left")
    of = lambda rows, part: rows.groupBy("rid").agg(F.sum(part).alias("sum"), F.count("*").alias("n"))
    met = chars.filter("part is null").select("rid", "gram").join(rare, "gram")
    return (of(chars.filter("part is not null"), "part").unionByName(of(met, "part_rare"))
            .groupBy("rid").agg((F.sum("sum") / F.sum("n")).alias("score")))


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the smallest threshold that decides most calibration urls rightly, the classes weighing equally."""
    width = 10.0 / BINS
    bins = (scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + 5) / width))).alias("bin"))
            .agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("b")))
    # at most BINS rows from here on
    one = bins.agg(F.collect_list(F.struct("bin", "a", "b")).alias("bins"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    at_least = lambda x, t: F.aggregate("bins", F.lit(0).cast("long"), lambda s, r: s + F.when(r["bin"] >= t, r[x]).otherwise(0))
    right = lambda t: (at_least("a", t) / F.col("all_a") + (F.col("all_b") - at_least("b", t)) / F.col("all_b"))
    tried = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda t: F.struct((-right(t)).alias("loss"), t.alias("t")))
    best = F.array_min(tried)["t"]
    usable = (F.col("all_a") > 0) & (F.col("all_b") > 0)
    return one.select(F.when(usable, best * width - 5).otherwise(F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    ensure_checkpoint_dir(pages.sparkSession)
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = (pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"),
                         F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
            .withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).checkpoint())
    decided = rows.filter("found is not null").select("rid", "url", F.col("found.verdict").alias("verdict"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    models = _models(decided.filter(~held))
    scores = _scored(rows.select("rid", "url"), models)
    judged = rows.join(scores, "rid", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).checkpoint()
    calibration = judged.filter(F.col("found").isNotNull() & held).select("score", F.col("found.verdict").alias("verdict"))
    sides = decided.filter(~held).agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(n) for n, v in (("na", "allow"), ("nb", "block"))])
    able = (F.col("na") > 0) & (F.col("nb") > 0)
    method = F.when(able & (F.col("score") < F.col("threshold")), "block").otherwise("allow")
    return (judged.crossJoin(F.broadcast(_threshold(calibration))).crossJoin(F.broadcast(sides))
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce(F.col("found.verdict"), method).alias("verdict"), "score", "threshold"))
