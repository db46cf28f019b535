"""URL filtering by stated prefix rules and mined association rules; SQL functions only.

Spark's FP-growth mines combinations of URL tokens that go with blocked labels. A rule
is pruned if it has too few labelled pages (a share and a count), too little
confidence, or too little lift over the share of blocked pages, or if all its tokens
but one imply the same as surely. The others match through an inverted index: each
rule stands under its rarest token, the tokens of a distinct URL meet the index, and a
rule met there blocks the URL if it has all of the rule's tokens.

The tables link labels to pages only by number, so the label of page n is that of
document n: blocked where quality is 0 or toxic is 1. Such labels say little of URLs;
the count and the lift keep rules that hold by chance out.

Defined cases: a null URL, or one without ``://``, has an empty host and path, meets
no stated rule and has no tokens, so it is allowed; equal URLs get equal verdicts; a
null page_id is never labelled; a page with several labels is blocked if any says so;
without labelled pages nothing is mined; URLs of any length are judged whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import cut

# The stated rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MOST_BROADCAST = 100_000  # index entries; a larger index is joined by a shuffle
BLOCK = "label=block"
SALTS = 16  # parts that the pages of one URL are dealt into


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = F.instr(F.col(url), "://")
    rest = F.when(cut > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return urls.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumns({"host": F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), upper, lower), "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def ruled(rules=RULES):
    """The stated rule that fits host and path best, as a struct (size, rule, verdict), or null."""
    fits = []
    for verdict, host, path in rules:
        on = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append(F.when(on, F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def tokens():
    """Distinct tokens of a URL: host names and their suffixes, path words, query and fragment names."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split("path", r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.when(x.rlike("^[0-9]+$"), "#").otherwise(F.lower(x))))
    query = F.transform(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.lower(F.regexp_extract(x, r"^[^=]*", 0))))
    mark = F.filter(F.array(F.concat(F.lit("mark="), F.lower(F.regexp_extract("url", r"#(.*)", 1)))), lambda x: x != "mark=")
    return F.when(F.col("host") != "", F.array_distinct(F.concat(suffixes, words, query, mark))).otherwise(F.array().cast("array<string>"))


def mined(pages: DataFrame, labels: DataFrame, support: float = 0.005, confidence: float = 0.8, fewest: int = 20, lift: float = 2.0) -> DataFrame | None:
    """Rules (rule_id, tokens, confidence) by which token combinations are blocked.

    A rule holds on at least ``fewest`` labelled pages and a share of ``support`` of
    them, and its confidence is at least ``confidence`` and ``lift`` times the share of
    blocked pages (as far as that can be: at most 1).
    """
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    rows = pages.select("page_id", "url", "host", "path").join(bad, "page_id").select("bad", F.when(F.col("bad") == 1, F.concat(tokens(), F.array(F.lit(BLOCK)))).otherwise(tokens()).alias("items")).where("size(items) > bad")
    n, blocked = rows.agg(F.count("*"), F.sum("bad")).first()
    if not n or not blocked:
        return None
    share, sure = max(support, fewest / n), max(confidence, min(1.0, lift * blocked / n))
    if share > 1:
        return None
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=sure).fit(rows.select("items"))
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    # a rule that a shorter one implies changes no verdict; parts of one token less are looked up
    less = F.transform("tokens", lambda t: F.array_remove("tokens", t))
    parts = rules.where("size(tokens) > 1").select("tokens", "confidence", F.explode(less).alias("less"))
    implied = parts.join(rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("sure")), "less").where("sure >= confidence")
    return rules.join(implied.select("tokens").distinct(), "tokens", "left_anti").withColumn("rule_id", F.sha2(F.array_join("tokens", "\n"), 256))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the URLs that some mined rule blocks, by inverted index."""
    urls = pages.where("host <> ''").select("url", "host", "path").distinct().select("url", tokens().alias("all"))
    frequent = urls.select(F.explode("all").alias("token")).join(F.broadcast(rules.select(F.explode("tokens").alias("token")).distinct()) if _small(rules) else rules.select(F.explode("tokens").alias("token")).distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(frequent, "token")
    index = index.groupBy("rule_id").agg(F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"), F.min_by("token", F.struct("n", "token")).alias("token")).drop("rule_id")
    met = urls.select("url", "all", F.explode("all").alias("token")).join(F.broadcast(index) if _small(rules) else index, "token")
    return met.where(F.size(F.array_except("tokens", "all")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def _small(rules: DataFrame) -> bool:
    return (rules.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= MOST_BROADCAST


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = 0.005, confidence: float = 0.8, fewest: int = 20, lift: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the mined rule that blocks, else null)."""
    named = parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    found = mined(named, labels, support, confidence, fewest, lift)
    if found is not None:
        found = cut(found)
    if found is None or found.isEmpty():
        named = named.withColumn("confidence", F.lit(None).cast("double"))
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
        blocked = matched(named, found).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = named.withColumn("_salt", salt).join(blocked, ["url", "_salt"], "left")
    named = named.withColumn("_rule", ruled(rules))
    return named.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


def op4(spark, sf_dir) -> DataFrame:
    found = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict")
