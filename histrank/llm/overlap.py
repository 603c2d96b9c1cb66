"""Same or near-same records across splits: winnowing fingerprints.

Order and repetition aside, a record is its set of items; its canonical sequence has them sorted.  Rolling hashes over
grams of the sequence are computed and the minimum of every window is selected with its position (frequent items are
avoided).  Selected minima of training and evaluation records with the same target are joined (seeds).  The sequences
run in one strict order, so the seeds of a pair are collinear; they are chained by position, and what a chain can
reach at most tells which pairs drop out.  Each chain is extended from its first seed to both ends by aligning the
stretches, which gives the exact number of common items, the similarity and the coverage.

No pair of similarity >= 0.6 is lost.  Let c items be common and d not.  Then d <= 2c / 3, and the items that aren't
common cut the common ones into at most d + 1 runs that are consecutive in both sequences.  For c >= 4 it is c > d + 1,
so some run has two items or more; winnowing of single items by windows of two selects a shared minimum in it.  c = 3
is possible for two sets of four items only, and sets of SHORT items keep every item.  (Longer grams or windows
would lose pairs: a similarity of 0.6 guarantees no run of three.)
Copies are classes: a class is fingerprinted and joined once, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histrank.session import materialize

#: Items of a gram, hashes of a window, and the size up to which a set keeps every item.
GRAM, WINDOW, SHORT = 1, 2, 4
#: Training classes that one task joins for one target and fingerprint; more are spread over several.
SALT_ROWS = 5_000
#: Items with at least one in HOT_SHARE of all occurrences come last in the choice of minima; there are at most HOT_SHARE of them.
HOT_SHARE = 256


def side_of(split: Column) -> Column:
    """'train', 'eval' or null for a split name, apart from case and outer blanks."""
    name = F.lower(F.trim(split))
    return F.when(name == "train", F.lit("train")).when(name.isNotNull(), F.lit("eval"))


def record_classes(records: DataFrame, min_items: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of records (id, side, target, items): equal side, target and item set are one class.

    Records with null id, side, target or with fewer than min_items different items drop out.
    """
    sets = records.select("id", "side", "target", F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items"))
    sets = sets.where(F.col("id").isNotNull() & F.col("side").isNotNull() & F.col("target").isNotNull() & (F.size("items") >= min_items))
    members = sets.withColumn("class", F.md5(F.to_json(F.struct("side", "target", "items")))).distinct()
    members = materialize(members, "members")
    classes = members.groupBy("class").agg(F.first("side").alias("side"), F.first("target").alias("target"), F.first("items").alias("items"))
    return classes, members.select("class", "id", "side")


def _coded(classes: DataFrame) -> DataFrame:
    """classes with codes: of each item, in order, the rank among the frequent items (0: none) and the hash."""
    counts = classes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = classes.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first()["n"]
    hot = sorted((r["n"], r["item"]) for r in counts.where(F.col("n") * HOT_SHARE >= F.lit(total)).collect())
    names = F.array(*[F.lit(item) for _, item in hot]).cast("array<string>")
    return classes.withColumn("codes", F.transform("items", lambda x: F.struct(F.coalesce(F.array_position(names, x), F.lit(0)).alias("hot"), F.xxhash64(x).alias("hash"))))


def fingerprints(ordered: DataFrame, gram: int, window: int) -> DataFrame:
    """(class, side, target, m, seed, pos): the minima of rolling hashes in every window, with their positions.

    The hash of a gram of several items rolls on from item to item; the minimum of `window` consecutive hashes is
    kept, the rightmost of equal ones, and a minimum that several windows share counts once.  A set of at most
    SHORT items keeps every single item.
    """
    shifted = lambda x, n: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    single = F.transform("codes", lambda c, i: F.struct(c["hot"].alias("hot"), c["hash"].alias("seed"), (-i).alias("back")))
    rows = ordered.select("class", "side", "target", F.size("items").alias("m"), single.alias("single"))
    grams = F.col("single")
    for n in range(1, gram):
        rolled = lambda a, b: F.struct(F.greatest(a["hot"], b["hot"]).alias("hot"), F.shiftleft(a["seed"], 5).bitwiseXOR(F.shiftrightunsigned(a["seed"], 59)).bitwiseXOR(b["seed"]).alias("seed"), a["back"].alias("back"))
        nexts = shifted(F.col("single"), n)
        grams = F.zip_with(F.slice(grams, F.lit(1), F.size(nexts)), nexts, rolled)
    rows = rows.withColumn("grams", grams)
    minima = F.col("grams")
    for n in range(1, window):
        nexts = shifted(F.col("grams"), n)
        minima = F.zip_with(F.slice(minima, F.lit(1), F.size(nexts)), nexts, lambda a, b: F.least(a, b))
    kept = F.when(F.col("m") <= SHORT, F.col("single")).otherwise(F.array_distinct(minima))
    return rows.select("class", "side", "target", "m", F.explode(kept).alias("g")).select("class", "side", "target", "m", F.col("g.seed").alias("seed"), (-F.col("g.back")).alias("pos"))


def _seeds(found: DataFrame) -> DataFrame:
    """(train, eval, ma, mb, pa, pb): fingerprints that a training and an evaluation class of one target share.

    A (target, fingerprint) that more than SALT_ROWS training classes have is split into as many parts as needed.
    """
    a = found.where("side = 'train'").select("target", "seed", F.col("class").alias("train"), F.col("m").alias("ma"), F.col("pos").alias("pa"))
    b = found.where("side = 'eval'").select("target", "seed", F.col("class").alias("eval"), F.col("m").alias("mb"), F.col("pos").alias("pb"))
    hot = materialize(a.groupBy("target", "seed").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("parts")).where("parts > 1"), "hot")
    if not hot.isEmpty():
        a = a.join(hot, ["target", "seed"], "left").withColumn("part", F.pmod(F.xxhash64("train"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        b = b.join(hot, ["target", "seed"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return a.join(b, ["target", "seed", "part"]).drop("target", "seed", "part")
    return a.join(b, ["target", "seed"]).drop("target", "seed")


def class_overlaps(classes: DataFrame, similarity: float) -> DataFrame:
    """(train, eval, n_common, n_train, n_eval, n_seeds): classes of equal target whose item sets have at least the similarity."""
    if similarity < 0.6:
        raise ValueError("fingerprints of this gram and window are complete for a similarity of 0.6 or more only")
    ordered = materialize(_coded(classes), "ordered")
    seeds = _seeds(materialize(fingerprints(ordered, GRAM, WINDOW), "fingerprints"))
    chains = seeds.groupBy("train", "eval", "ma", "mb").agg(F.array_sort(F.collect_list(F.struct("pa", "pb"))).alias("chain"))
    # between neighbours of a chain, before its first and behind its last seed at most the shorter stretch is common
    first, last = F.get("chain", F.lit(0)), F.element_at("chain", -1)
    step = F.aggregate(
        "chain", F.struct(first["pa"].alias("pa"), first["pb"].alias("pb"), F.lit(1).alias("n")),
        lambda s, x: F.struct(x["pa"].alias("pa"), x["pb"].alias("pb"), (s["n"] + F.when((x["pa"] > s["pa"]) & (x["pb"] > s["pb"]), F.least(x["pa"] - s["pa"], x["pb"] - s["pb"])).otherwise(0)).alias("n")), lambda s: s["n"],
    )
    most = F.least(first["pa"], first["pb"]) + step + F.least(F.col("ma") - last["pa"], F.col("mb") - last["pb"]) - 1
    need = F.lit(similarity / (1 + similarity)) * (F.col("ma") + F.col("mb")) - 1e-9
    chains = chains.where(most >= need).select("train", "eval", F.size("chain").alias("n_seeds"), first["pa"].alias("a0"), first["pb"].alias("b0"))
    left = ordered.where("side = 'train'").select(F.col("class").alias("train"), F.col("items").alias("ia"))
    right = ordered.where("side = 'eval'").select(F.col("class").alias("eval"), F.col("items").alias("ib"))
    # both run in one strict order, so the longest alignment of two stretches is what they have in common
    head = F.size(F.array_intersect(F.slice("ia", 1, F.col("a0")), F.slice("ib", 1, F.col("b0"))))
    tail = F.size(F.array_intersect(F.slice("ia", F.col("a0") + 1, F.size("ia")), F.slice("ib", F.col("b0") + 1, F.size("ib"))))
    aligned = chains.join(left, "train").join(right, "eval").select("train", "eval", (head + tail).alias("n_common"), F.size("ia").alias("n_train"), F.size("ib").alias("n_eval"), "n_seeds")
    return aligned.where(F.col("n_common") >= F.lit(similarity) * (F.col("n_train") + F.col("n_eval") - F.col("n_common")) - 1e-9)


def cross_split_pairs(records: DataFrame, similarity: float, min_items: int) -> DataFrame:
    """(train_id, eval_id, n_common, n_train, n_eval): every overlapping pair of one training and one evaluation record."""
    classes, members = record_classes(records, min_items)
    found = class_overlaps(classes, similarity)
    train = members.where("side = 'train'").select(F.col("class").alias("train"), F.col("id").alias("train_id"))
    evaluation = members.where("side = 'eval'").select(F.col("class").alias("eval"), F.col("id").alias("eval_id"))
    return found.join(train, "train").join(evaluation, "eval").where("train_id <> eval_id").select("train_id", "eval_id", "n_common", "n_train", "n_eval").distinct()


def record_coverage(records: DataFrame, similarity: float, min_items: int) -> DataFrame:
    """(id, split, source, train_source, coverage, n_train): for each evaluation record and each source of the training
    records that it overlaps, the largest share of its items in one of them, and how many there are.

    A record that repeats with several splits or sources counts for each.
    """
    classes, members = record_classes(records, min_items)
    found = class_overlaps(classes, similarity).select("train", "eval", (F.col("n_common") / F.col("n_eval")).alias("share"))
    of = records.select("id", "split", "source").distinct()
    train = members.where("side = 'train'").join(of, "id").groupBy(F.col("class").alias("train"), F.col("source").alias("train_source")).agg(F.count(F.lit(1)).alias("n"))
    best = found.join(train, "train").groupBy("eval", "train_source").agg(F.max("share").alias("coverage"), F.sum("n").alias("n_train"))
    evaluation = members.where("side = 'eval'").select(F.col("class").alias("eval"), "id").join(of, "id")
    return evaluation.join(best, "eval").groupBy("id", "split", "source", "train_source").agg(F.max("coverage").alias("coverage"), F.sum("n_train").alias("n_train"))
