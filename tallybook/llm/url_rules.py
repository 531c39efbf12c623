"""URL filtering: fixed rules by host and path, and association rules mined from labelled URLs.

A URL becomes a set of tokens: scheme, host labels, path segments, query keys; runs of
digits count as one token, and words inside a label or segment as tokens of their own. Tokens of exactly the
same labelled URLs are taken as one item. FP-growth mines item sets of the labelled URLs; a rule is a token set that implies the label ``block``
with enough support and confidence. A rule that holds another rule's tokens is pruned, since the
smaller one blocks the same URLs. Rules are matched through an inverted index: each is filed
under its rarest token, distinct URLs meet it there, and its other tokens are then checked.

Fixed rules are asked first: a rule fits its host and all subdomains if the path starts with
the rule's, and the longest one wins. Only where none fits do the mined rules decide.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule, and
is allowed unless a mined rule holds; rows that repeat a URL get the same verdict; null ids are
carried; labels without a URL or with a null value are not learned from; of several labels of an
id, any that blocks counts; without labels nothing is mined; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.tables import stored

ALLOW, BLOCK = "allow", "block"
#: Fixed values: (verdict, host, path prefix).
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: Blocked rows a rule rests on, at least.
MIN_BLOCKED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The item that stands for the label among the tokens; no token begins with it.
_LABEL = "!"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fixed rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; each is marked with the part it comes from."""
    host, path = host_of(url), path_of(url)

    def part(mark: str, text: Column, split: str) -> Column:
        pieces = F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), split, -1)
        words = F.flatten(F.transform(pieces, lambda p: F.concat(F.array(p), F.split(p, "[^\\p{L}\\p{N}]+", -1))))
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark + ":"), w))

    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    keys = F.array_join(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), "&")
    scheme = F.filter(F.array(F.lower(F.regexp_extract(url, "^([^:/?#]+)://", 1))), lambda s: s != "")
    found = F.concat(
        F.transform(scheme, lambda s: F.concat(F.lit("scheme:"), s)),
        part("host", host, "\\."),
        part("path", path, "/"),
        part("key", keys, "&"),
    )
    return F.array_distinct(F.when(url.isNull(), F.array().cast("array<string>")).otherwise(found))


def _same_rows(each: DataFrame) -> DataFrame:
    """Tokens of the same rows as one item: (item, same, n), the item being the least of the tokens ``same``.

    Rows are compared by their number and two 64-bit exclusive sums of hashes. All of ``same`` stand in
    one URL, which bounds their number.
    """
    signed = each.groupBy("token").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b"),
    )
    return signed.groupBy("n", "a", "b").agg(
        F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("same")
    )


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_blocked: int = MIN_BLOCKED,
) -> DataFrame:
    """Rules (``tokens``, ``confidence``, ``support``) from rows of ``url`` and ``blocked``.

    ``tokens`` is an array of arrays: a URL fits that holds one token of each. A rule has at least
    ``min_blocked`` blocked rows, and at least ``min_support`` of all rows. Tokens that occur in exactly the same
    rows are one item, and one that is in all rows is none, so what is mined does not grow with the
    words a site's URLs share.
    """
    rows = stored(
        labelled.select(F.monotonically_increasing_id().alias("row"), "blocked", tokens_of(F.col("url")).alias("tokens")),
        "url-tokens",
    )
    total = rows.count()
    least = max(min_support, min_blocked / max(total, 1))
    each = rows.select("row", F.explode("tokens").alias("token"))
    groups = stored(_same_rows(each).filter((F.col("n") < total) & (F.col("n") >= least * total - 1e-6)), "url-items")
    held = each.join(groups.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("held"))
    label = F.when(F.col("blocked"), F.array(F.lit(_LABEL + BLOCK))).otherwise(F.array().cast("array<string>"))
    items = F.concat(F.coalesce("held", F.array().cast("array<string>")), label)
    baskets = stored(rows.join(held, "row", "left").select(items.alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(least, 1.0), minConfidence=min_confidence).fit(baskets)
    implied = model.associationRules.filter(F.col("consequent") == F.array(F.lit(_LABEL + BLOCK)))
    rules = stored(
        implied.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-rules"
    )
    # a rule meets the rules that hold its first item; one that holds it and is longer is not needed
    first = rules.select(F.col("items")[0].alias("item"), F.col("items").alias("inner"))
    longer = rules.select(F.explode("items").alias("item"), F.col("items").alias("outer"))
    needless = (
        longer.join(first, "item")
        .filter((F.size("outer") > F.size("inner")) & (F.size(F.array_except("inner", "outer")) == 0))
        .select(F.col("outer").alias("items"))
        .distinct()
    )
    needed = rules.join(needless, "items", "left_anti")
    alternatives = (
        needed.select("items", F.explode("items").alias("item"))
        .join(groups.select("item", "same"), "item")
        .groupBy("items")
        .agg(F.array_sort(F.collect_list("same")).alias("tokens"))
    )
    return needed.join(alternatives, "items").select("tokens", "confidence", "support")


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct values of ``url`` that hold a token of each array of some rule's ``tokens``."""
    rules = stored(rules.select("tokens"), "rules")
    each = (
        urls.filter("url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    ).withColumnsRenamed({"tokens": "held"})
    parts = rules.select("tokens", F.explode("tokens").alias("part"))
    asked = parts.select(F.explode("part").alias("token")).distinct()
    counts = (
        each.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(asked, "token")
    )
    # a rule is filed under the tokens of its rarest array; one with an array no URL holds is not
    filed = (
        parts.select("tokens", "part", F.explode("part").alias("token"))
        .join(counts, "token")
        .groupBy("tokens", "part")
        .agg(F.sum("n").alias("n"))
        .groupBy("tokens")
        .agg(F.min(F.struct("n", "part")).alias("rarest"), F.count("*").alias("known"))
        .filter(F.col("known") == F.size("tokens"))
        .select("tokens", F.explode("rarest.part").alias("token"))
    )
    return (
        each.select("url", "held", F.explode("held").alias("token"))
        .join(filed, "token")
        .filter(F.forall("tokens", lambda part: F.arrays_overlap(part, F.col("held"))))
        .select("url")
        .distinct()
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE, min_blocked: int = MIN_BLOCKED,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``labels`` has ``doc_id``, the page's id, and ``quality`` and ``toxic``: a page of quality 0
    or toxic 1 is to be blocked.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    known = (
        labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("b"))
        .dropna()
        .groupBy("page_id")
        .agg(F.max("b").alias("blocked"))
    )
    labelled = urls.filter("url IS NOT NULL").join(known, "page_id").select("url", "blocked")
    hits = stored(matching(urls, mine(labelled, min_support, min_confidence, min_blocked)), "blocked-urls")
    hits = hits.withColumnsRenamed({"url": "hit"})
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parted = urls.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = parted.withColumn("fixed", rule_of(F.col("host"), F.col("path"), rules))
    mined = F.when(F.col("hit").isNotNull(), BLOCK).otherwise(ALLOW)
    return ruled.join(hits, F.col("url") == F.col("hit"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), mined).alias("verdict"),
    )
