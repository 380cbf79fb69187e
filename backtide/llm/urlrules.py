"""URL filter by association rules, and by listed rules that go first.

A URL is the set of its tokens: scheme, labels of the host and their last two together, path segments (numbers as one
token), file ending, query names, fragment. FP-growth mines token combinations from labelled URLs, each with an item for
its label; a rule `tokens -> label` stays if its support and confidence reach the thresholds and no shorter rule with
as much confidence is part of it. Rules are matched by an inverted index from each rule's rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stash, stash

#: (host, path) -> verdict.
LISTED = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
#: Labelled URLs with more frequent tokens are counted by length instead of by FP-growth.
BASKET = 12
#: Sets of tokens, or rules, up to which rows meet them in a broadcast.
BROADCAST = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; empty without :// or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: dict[tuple[str, str], str], give) -> Column:
    """give(rule, verdict) of the longest listed rule that fits: its host or a subdomain, and a path that begins with
    the rule's. Null if none does."""
    out = F.lit(None).cast("string")
    for (own, start), verdict in sorted(rules.items(), key=lambda r: (len(r[0][0] + r[0][1]), r[0])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.lit(give(own + start, verdict))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none for null."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.concat(F.lit("path:"), F.regexp_replace(p, "[0-9]+", "#")))
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    names = F.transform(F.filter(query, lambda q: q != ""), lambda q: F.concat(F.lit("query:"), F.substring_index(q, "=", 1)))
    one = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(name), value))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.coalesce(F.concat(
        F.transform(F.filter(labels, lambda p: p != ""), lambda p: F.concat(F.lit("host:"), p)),
        one("site:", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)), one("scheme:", F.regexp_extract(url, "^([a-z]+)://", 1)),
        named, names, one("fragment:", F.regexp_extract(url, "#(.+)$", 1)),
    ), F.array().cast("array<string>")))


def _beside_rows(sets: DataFrame) -> DataFrame:
    """sets, for a join with rows: broadcast, or sorted if there are many. Rows hold few different tokens, so that their files
    are small and Spark would broadcast the rows instead, which outgrow the driver."""
    return F.broadcast(sets) if sets.count() <= BROADCAST else sets.hint("merge")


def _counted_sets(rows: DataFrame, least: float) -> DataFrame:
    """(tokens) of the sets of up to three tokens that `least` rows (items, label) of one label hold, counted by length: pairs
    out of frequent tokens, triples out of frequent pairs of one row."""
    own = stash(rows.withColumn("row", F.monotonically_increasing_id()), "wide")
    often = lambda sets: sets.groupBy("tokens", "label").count().filter(F.col("count") >= least).select("tokens", "label")
    singles = own.select("row", "label", F.explode("items").alias("a"))
    one = often(singles.withColumn("tokens", F.array("a")))
    singles = singles.join(one.select(F.col("tokens")[0].alias("a"), "label"), ["a", "label"], "left_semi")
    both = singles.join(singles.select("row", F.col("a").alias("b")).hint("merge"), "row").filter("a < b").withColumn("tokens", F.array("a", "b"))
    two = often(both)
    pairs = stash(both.join(two, ["tokens", "label"], "left_semi").select("row", "label", "a", "b"), "pairs")
    triples = pairs.join(pairs.select("row", "a", F.col("b").alias("c")).hint("merge"), ["row", "a"]).filter("b < c").withColumn("tokens", F.array("a", "b", "c"))
    out = stash(one.unionByName(two).unionByName(often(triples)).select("tokens").distinct(), "wide-sets")
    drop_stash(own)
    drop_stash(pairs)
    return out


def mine_rules(labelled: DataFrame, *, support: float = 0.01, confidence: float = 0.6, longest: int = 3, basket: int = BASKET) -> DataFrame:
    """Rules (rule_id, tokens, key_token, label, confidence, support) of up to `longest` (three at most) tokens from
    (tokens array<string>, label string).

    FP-growth mines the labelled URLs with up to `basket` frequent tokens. As it has no bound on the length of its sets,
    and n tokens that go together make 2^n of them, sets of the URLs with more are counted by length. A set that is frequent
    over all URLs is so in one of the two parts, so what either finds is then counted over all URLs, by an index of each
    set's rarest token: no rule is lost, and figures are those of all URLs. Frequent tokens number (mean tokens of a URL)
    / support at most. Without labelled URLs or rules the table is empty; null labels and URLs without tokens are left out.
    """
    if not 1 <= longest <= 3:
        raise ValueError("rules have one to three tokens")
    rows = stash(labelled.filter((F.size("tokens") > 0) & F.col("label").isNotNull()).select("tokens", "label"), "labelled")
    total = rows.count()
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= support * total)
    frequent = [r["token"] for r in sorted(counts.collect(), key=lambda r: (r["count"], r["token"]))]
    known = F.array(*map(F.lit, frequent)) if frequent else F.array().cast("array<string>")
    kept = stash(rows.select(F.array_intersect(known, "tokens").alias("items"), "label"), "baskets")
    narrow, wide = kept.filter(F.size("items") <= basket), kept.filter(F.size("items") > basket)
    baskets = narrow.select(F.concat("items", F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    is_label = lambda t: t.startswith("label:")
    found = sets.filter(F.exists("items", is_label) & F.size("items").between(2, longest + 1)).select(F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("tokens")).distinct()
    if n := wide.count():
        found = found.unionByName(_counted_sets(wide, support * n).filter(F.size("tokens") <= longest)).distinct()

    rarest = F.get(F.array_intersect(known, "tokens"), 0)
    found = stash(found.withColumn("key_token", rarest), "sets")
    looked = kept.withColumn("key_token", F.explode("items")).join(_beside_rows(found), "key_token").filter(F.size(F.array_except("tokens", "items")) == 0)
    by_label = looked.groupBy("tokens", "key_token", "label").agg(F.count("*").alias("hits")).withColumn("rows", F.sum("hits").over(Window.partitionBy("tokens")))
    rules = by_label.select("tokens", "key_token", "label", (F.col("hits") / F.col("rows")).alias("confidence"), (F.col("hits") / max(1, total)).alias("support"))
    rules = stash(rules.filter((F.col("confidence") >= confidence) & (F.col("support") >= support)), "all-rules")

    # A longer rule goes if a part of it says as much with as much confidence: each rule looks up its own parts.
    at = lambda *places: F.array(*[F.col("tokens")[i] for i in places])
    parts = F.when(F.size("tokens") == 2, F.array(at(0), at(1))).when(F.size("tokens") == 3, F.array(at(0), at(1), at(2), at(0, 1), at(0, 2), at(1, 2)))
    short = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("part_confidence"))
    said = rules.select("tokens", "label", "confidence", F.explode(parts).alias("part")).join(short, ["part", "label"]).filter("part_confidence >= confidence")
    out = rules.join(said.select("tokens", "label").distinct(), ["tokens", "label"], "left_anti").withColumn("rule_id", F.xxhash64(F.array_join("tokens", "\n"), "label"))
    for done in (rows, kept, found):
        drop_stash(done)
    return out


def match_rules(urls: DataFrame, rules: DataFrame, *, tokens: str = "tokens") -> DataFrame:
    """urls with `best` (label, confidence, matched): the most confident rule that each row's tokens contain; null if
    none is.

    Each token looks up the rules of which it is the rarest; those whose other tokens are there too match. The rules
    are a table of bounded size (see mine_rules), so they are broadcast (beyond BROADCAST sorted), and a row is put together
    again by a number of its own: no token, URL or host gathers rows."""
    index = _beside_rows(rules.select("key_token", F.struct("tokens", "label", "confidence", "support", "rule_id").alias("_rule")))
    own = urls.select(F.struct("*").alias("_url"), F.col(tokens).alias("_tokens"), F.monotonically_increasing_id().alias("_row"))
    looked = own.withColumn("key_token", F.explode_outer("_tokens")).join(index, "key_token", "left")
    fits = F.size(F.array_except("_rule.tokens", "_tokens")) == 0
    told = F.struct("_rule.label", "_rule.confidence", F.array_join("_rule.tokens", " ").alias("matched"))
    best = F.max_by(F.when(fits, told), F.when(fits, F.struct("_rule.confidence", "_rule.support", "_rule.rule_id")))
    return looked.groupBy("_row").agg(F.first("_url").alias("_url"), best.alias("best")).select("_url.*", "best")


def judge_urls(pages: DataFrame, rules: DataFrame, *, listed: dict[tuple[str, str], str] = LISTED, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict, matched) for each page: the longest listed rule's verdict, else the
    best mined rule's, else the default. A null url, or one without ://, has an empty host and path; null keys stay
    null; repeated pages give repeated rows, very long URLs are judged whole, an empty table gives an empty one. Other
    columns of pages are left out."""
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    found = match_rules(own.withColumn("tokens", url_tokens(F.col("url"))), rules)
    return found.select(
        "page_id", host.alias("host"), path.alias("path"),
        listed_rule(host, path, listed, lambda rule, verdict: rule).alias("rule"),
        F.coalesce(listed_rule(host, path, listed, lambda rule, verdict: verdict), F.col("best.label"), F.lit(default)).alias("verdict"),
        F.col("best.matched").alias("matched"),
    )
