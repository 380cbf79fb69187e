"""Document fingerprints by spot signatures.

Words are runs of anything but ASCII characters other than letters and digits, in lower case. An anchor is a run of
common words (ANCHORS); the words between are content words. Each anchor with the chain of CHAIN content words that
begins at it is a spot. A document's fingerprint is the set of its spots' 64-bit hashes, sorted, sixteen hexadecimal
digits each. A text without a spot has one signature of all it holds; a null or empty text has none.

Sets are searched within partitions by length: of a similarity of `least` or more the sizes differ by a factor of 1 / least
at most, so two sets lie in one partition or in neighbouring ones; others are apart, as are those of one partition whose
sizes rule it out, and nobody looks at their members. `spot_matches` finds the similar pairs of a whole table that way,
through an index of each set's first spots. The likeness of a document to its edit and its neighbour is exact, however
small: only sets without members are told apart without a look.

Everything is made of built-in functions. `let` binds a value to a lambda variable, so that it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Common words of English, German, French and Spanish.
ANCHORS = sorted(set(
    "the of and to in a is that it for on was as with be by are this at an from or not but his her they we you he she "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so dass "
    "le la les de des et un une du en que qui dans pour par sur est pas au plus ne se ce "
    "el los las y en por con para una su del al lo como más o pero sus le ya".split()
))
CHAIN = 3
_BREAK = r"[\x00-/:-@\[-`{-\x7f]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def spot_set(text: Column) -> Column:
    """array<bigint>: the sorted distinct hashes of a text's spots."""
    words = F.split(F.lower(text), _BREAK)
    # Anchors stick to the word behind them: "of|the|house" is a content word with its anchor.
    glued = F.filter(F.split(F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(ANCHORS), "|").otherwise(" "))), ""), " "), lambda t: t != "")

    def spots(tokens: Column) -> Column:
        def of(content: Column) -> Column:
            rest = content
            for _ in range(CHAIN - 2):
                rest = F.zip_with(rest, F.slice(content, 2, F.size(content)), lambda x, y: F.concat(x, F.lit(" "), y))
            chained = F.zip_with(tokens, F.slice(rest, 2, F.size(rest)), lambda head, tail: F.when(head.contains("|") & tail.isNotNull() & (tail != ""), F.xxhash64(head, tail)))
            return F.sort_array(F.array_distinct(F.filter(chained, lambda s: s.isNotNull())))

        return let(F.transform(tokens, lambda t: F.substring_index(t, "|", -1)), of)

    whole = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lower(text))))
    return F.coalesce(let(let(glued, spots), lambda found: F.when(F.size(found) > 0, found).otherwise(whole)), F.array().cast("array<bigint>"))


def fingerprint(spots: Column) -> Column:
    return F.array_join(F.transform(spots, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def length_partition(spots: Column, least: float) -> Column:
    """Sets whose partitions differ by more than one cannot have a similarity of `least` or more."""
    return F.floor(F.log(F.greatest(F.size(spots), F.lit(1)).cast("double")) / F.log(F.lit(1 / least))).cast("int")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two sorted sets; 0 without looking at the members if their length partitions or sizes alone rule
    out `least`. Two empty sets are equal."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda n: n / (small + large - n))
    apart = F.abs(length_partition(a, least) - length_partition(b, least)) > 1 if least > 0 else F.lit(False)
    return F.when(large == 0, 1.0).when((small == 0) | apart | (small < least * large), 0.0).otherwise(exact)


def spot_matches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of the pairs of different spot sets, each by the smallest key that has it, with a likeness of
    least or more, a > b.

    A set of n spots is entered in its length partition under each of its first n - ceil(least n) + 1 spots, in order of
    how many sets hold them, and looked up under those in its own and the next partition; sets of that likeness share
    one. Equal sets count once, so copies make no pairs. Texts without spots match equal ones only; null keys, null and
    empty texts match nothing. Other columns are left out.
    """
    sets = docs.select(F.col(key).alias("id"), spot_set(F.col(text)).alias("spots")).filter(F.col("id").isNotNull() & (F.size("spots") > 0))
    sets = stash(sets.groupBy("spots").agg(F.min("id").alias("id")), "spots")
    held = sets.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("holders"))
    ordered = sets.select("id", F.size("spots").alias("n"), F.explode("spots").alias("spot")).join(held, "spot").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "spot"))).alias("order"))
    first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    entries = ordered.select("id", "n", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int").alias("part"), F.explode(first).alias("first")).select("id", "n", "part", "first.spot")
    looked = entries.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    ends = [F.col(c).alias(f"{c}_{end}") for end in "ab" for c in ("id", "n")]
    pairs = looked.select("part", "spot", *ends[:2]).join(entries.select("part", "spot", *ends[2:]), ["part", "spot"]).filter((F.col("id_a") != F.col("id_b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")))
    pairs = pairs.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("spots").alias("spots_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("spots").alias("spots_b")), "b")
    return both.withColumn("likeness", pruned_jaccard(F.col("spots_a"), F.col("spots_b"), least)).filter(F.col("likeness") >= least).select("a", "b", "likeness")


def _followers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, take, next_id) for each distinct key: the next one in descending order (after the last: the first) and a
    third of the text's characters. Only keys and lengths are shuffled; windows span one range of keys each."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.floor(F.char_length(text) / 3)).cast("int").alias("take"))
    placed = stash(sizes.repartitionByRange(n, F.desc("id")).withColumn("part", F.spark_partition_id()), "order")
    edges = placed.groupBy("part").agg(F.max("id").alias("first")).withColumn("next_first", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.max("first").over(Window.partitionBy())))
    inside = placed.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id"))))
    return inside.join(F.broadcast(edges), "part").select("id", "take", F.coalesce("next_id", "next_first").alias("next_id"))


def fingerprint_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """One row for each row of docs: (key, n_chars, spots, edited, edited_spots, near_edited, near_next).

    The edited text has its last third replaced by the first characters of the next document (descending key; after the
    last the first). A null text counts as empty. A null key has no next document: nothing takes the third's place and
    near_next is 0. With `least`, likenesses below it may be told as 0 (see pruned_jaccard). Under repeated keys the least text stands for the next document. Texts are shuffled once by key,
    and the next document's first characters and spots once more; other columns of docs are left out.
    """
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("spots", spot_set(F.col("text")))
    order = stash(_followers(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "id", "text"), "followers")
    gifts = base.join(order.select(F.col("next_id").alias("id"), F.col("id").alias("to"), "take"), "id").select("to", F.expr("substring(text, 1, take)").alias("gift"), F.col("spots").alias("next_spots"))
    gifts = gifts.groupBy("to").agg(F.min(F.struct("gift", "next_spots")).alias("next"))
    # Both joins take the same rows by the same key, so that their texts are shuffled once.
    joined = base.filter("id is not null").join(gifts, F.col("id") == F.col("to"), "left").drop("to")
    nulls = base.filter("id is null").withColumn("next", F.lit(None).cast(joined.schema["next"].dataType))
    own = joined.union(nulls.select(*joined.columns)).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), coalesce(substring(next.gift, 1, cast(n_chars div 3 as int)), ''))")
    out = own.withColumn("edited", edited).withColumn("edited_spots", spot_set(F.col("edited")))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "spots", "edited", "edited_spots",
        pruned_jaccard(F.col("spots"), F.col("edited_spots"), least).alias("near_edited"),
        F.when(F.col("next").isNull(), 0.0).otherwise(pruned_jaccard(F.col("spots"), F.col("next.next_spots"), least)).alias("near_next"),
    )
