"""Exact duplicates and near duplicates (variants) of acts, by set similarity of long tokens.

Variants are found by a prefix-filtered join: tokens are put in a global order, rare first; two sets of
Jaccard similarity t or more share one of their first n - ceil(t n) + 1 tokens, and their sizes differ by no
more than t. With k - 1 tokens more they share k of them, which rules out most pairs before anything but their names is
shuffled. Candidates are verified exactly in integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lavra.functions.text import fold, squeeze
from lavra.sources.shared import new_folder

LIKE = (72, 100)
#: Hash buckets in which tokens are counted for their order.
BUCKETS = 2**18
#: Leading tokens that two sets must share, or all that they need if those are fewer.
SHARED = 3
#: Rows of a block up to which a token counts as rare in `link_parts`.
RARE = 64


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tokens(text: Column) -> Column:
    """Distinct folded tokens of letters and digits, longer than 4."""
    return F.array_distinct(F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 4))


def duplicates(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows(key, text) to key, duplicate_of: the least earlier row of equal text but for white space. The
    digest is grouped with partial sums, then joined back, so that a text with many copies is no one task."""
    hashed = rows.select(key, F.sha2(squeeze(F.col("text")), 256).alias("norm"))
    least = hashed.groupBy("norm").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").select("norm", "first")
    return hashed.join(least, "norm", "left").select(key, F.when(F.col("first") < F.col(key), F.col("first")).alias("duplicate_of"))


def token_facts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows(key, block, text) with tokens (sorted), n and set_id, written once: texts are not folded again. Null keys and
    texts without tokens have no pairs and go."""
    each = rows.filter(F.col(key).isNotNull()).select(key, "block", F.sort_array(tokens(F.col("text"))).alias("tokens"))
    told = each.select("*", F.size("tokens").alias("n"), F.unhex(F.md5(F.array_join("tokens", " ").cast("binary"))).alias("set_id"))
    return written(told.filter("n > 0"), "tokens")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def frequencies(sets: DataFrame) -> DataFrame:
    """bucket, df: in how many of sets(tokens) a token of each hash bucket stands, summed over its tokens. This is the
    order of tokens; one that shares its bucket with a frequent one counts as frequent, which costs time only."""
    return sets.select(F.explode(F.transform("tokens", _bucket)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))


def leading(sets: DataFrame, order: DataFrame, like: tuple[int, int] = LIKE) -> DataFrame:
    """at, token and the other columns of the leading tokens of sets(block, tokens, n, ...), rare first by `frequencies`:
    token is a hash of token and block, so that equal ones meet and others are told apart when pairs are checked."""
    a, b = like
    dense = sets.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(order, "bucket", "left")
    place = (F.log2(F.coalesce("df", F.lit(0)) + 1) * 512).cast("long")  # below 2^15, so that it goes before 48 bits of the hash
    line = dense.agg(F.array_sort(F.collect_list(F.struct("bucket", place.alias("place")))).alias("ps")).select(F.transform("ps", lambda x: x["place"].cast("short")).alias("places"))
    ahead = lambda t: F.shiftleft(F.coalesce(F.get(F.col("places"), _bucket(t)).cast("long"), F.lit(0).cast("long")), 48)
    ranked = F.sort_array(F.transform("tokens", lambda t: ahead(t).bitwiseOR(F.shiftrightunsigned(F.xxhash64("block", t), 16))))
    lead = F.slice(ranked, 1, F.col("n") - F.ceil(F.col("n") * a / b).cast("int") + SHARED)
    others = [c for c in sets.columns if c not in ("block", "tokens")]
    led = sets.crossJoin(F.broadcast(line)).select(*others, lead.alias("lead"))
    return led.select(*others, F.posexplode("lead").alias("at", "token"))


def meeting(left: str, right: str, like: tuple[int, int] = LIKE) -> Column:
    """Whether two leading tokens (aliases of `leading`) are among the first `SHARED` by which their sets may be alike: with those
    that may go before, enough are left in each of them."""
    a, b = like
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    left_over = F.least(n - F.col(f"{left}.at"), m - F.col(f"{right}.at")) + (SHARED - 1)
    return (F.col(f"{left}.token") == F.col(f"{right}.token")) & (n * a <= m * b) & (m * a <= n * b) & (left_over * (a + b) >= (n + m) * a)


def needed(left: str, right: str, like: tuple[int, int] = LIKE) -> Column:
    """How many leading tokens two sets share at least if they are alike."""
    a, b = like
    return F.least(F.lit(SHARED), F.ceil(F.greatest(F.col(f"{left}.n"), F.col(f"{right}.n")) * a / b)).cast("tinyint")


def often(found: DataFrame) -> DataFrame:
    """The pairs of found(rep, like, need), a row for each token shared, that share as many as they need."""
    return found.groupBy("rep", "like").agg(F.count("*").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("rep", "like")


#: Parity of the tokens at each of 64 * W places, 2 to 4 to a token: W words, a power of two and 8 at least.
_SIGNED = """transform(array(transform(tokens, t -> xxhash64(t))), hs -> flatten(transform(
    transform(sequence(0, w div 8 - 1), g -> filter(hs, h -> (shiftrightunsigned(h, 9) & (w div 8 - 1)) = g)),
    part -> transform(sequence(0, 7), r -> aggregate(filter(part, h -> (shiftrightunsigned(h, 6) & 7) = r), 0L, (acc, h) -> acc ^ shiftleft(1L, cast(h & 63 as int)))))))[0]"""


def signed(sets: DataFrame, *others: str) -> DataFrame:
    """others and `signature` of sets(tokens, n, ...): the places in which two signatures differ are no more than the tokens
    that only one of the sets has."""
    w = sets.withColumn("w", F.greatest(F.lit(8.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / 32)))).cast("bigint"))
    return w.select(*others, F.expr(_SIGNED).alias("signature"))


def _differing(x: Column, y: Column) -> Column:
    """Least number of tokens that only one of two sets has, by their signatures; a signature of twice the words is folded."""
    fold_ = lambda v, n: F.when(F.size(v) == 2 * n, F.zip_with(F.slice(v, 1, n), F.slice(v, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(v)
    n = F.least(F.size(x), F.size(y))
    bits = F.zip_with(fold_(x, n), fold_(y, n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    told = F.aggregate(bits, F.lit(0), lambda acc, k: acc + k)
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * n, told).otherwise(0)


def near(pairs: DataFrame, classes: DataFrame, like: tuple[int, int] = LIKE) -> DataFrame:
    """pairs(rep, like) without those that the signatures of classes rule out; written, as `checked` reads them twice."""
    a, b = like
    signs = written(signed(classes, "rep", "n"), "signatures")
    both = pairs.join(signs.withColumnsRenamed({"n": "nx", "signature": "sx"}), "rep").join(signs.withColumnsRenamed({"rep": "like", "n": "ny", "signature": "sy"}), "like")
    n = F.col("nx") + F.col("ny")
    return written(both.filter((n - _differing(F.col("sx"), F.col("sy"))) * (a + b) >= 2 * a * n).select("rep", "like"), "near")


def checked(pairs: DataFrame, classes: DataFrame, like: tuple[int, int] = LIKE) -> DataFrame:
    """pairs(rep, like) with inter and total, of those alike. Tokens of classes that no pair names are not shuffled."""
    a, b = like
    met = classes.join(pairs.select(F.explode(F.array("rep", "like")).alias("rep")).distinct(), "rep", "left_semi")
    one = met.select("rep", F.col("tokens").alias("x"), F.col("block").alias("bx"))
    two = met.select(F.col("rep").alias("like"), F.col("tokens").alias("y"), F.col("block").alias("by"))
    inter = F.size(F.array_intersect("x", "y"))
    both = pairs.join(one, "rep").join(two, "like").filter(F.col("bx").eqNullSafe(F.col("by")))
    told = both.select("rep", "like", F.size("x").alias("nx"), F.size("y").alias("ny"), inter.alias("inter"))
    return told.select("rep", "like", "inter", (F.col("nx") + F.col("ny") - F.col("inter")).alias("total")).filter(F.col("inter") * b >= F.col("total") * a)


def class_pairs(classes: DataFrame, like: tuple[int, int] = LIKE) -> DataFrame:
    """classes(rep, block, tokens, n) of different sets to rep, like (the lesser), inter, total of those alike."""
    probe = leading(classes, frequencies(classes), like)
    left, right = probe.alias("l"), probe.toDF(*probe.columns).alias("r")
    found = left.join(right, meeting("l", "r", like) & (F.col("r.rep") < F.col("l.rep")))
    return checked(near(often(found.select(F.col("l.rep").alias("rep"), F.col("r.rep").alias("like"), needed("l", "r", like).alias("need"))), classes, like), classes, like)


def similar_classes(rows: DataFrame, key: str = "doc_id", like: tuple[int, int] = LIKE) -> tuple[DataFrame, DataFrame]:
    """members (key, rep) and alike (rep, like, inter, total), in both directions and each class with itself. Rows of one
    block and one token set are a class, named by its least key; only classes are compared."""
    facts = token_facts(rows, key)
    named = facts.groupBy("block", "set_id").agg(F.min(key).alias("rep"), F.count("*").alias("of"))
    several = facts.select(key, "block", "set_id").join(named.filter("of > 1"), (facts["set_id"] == named["set_id"]) & facts["block"].eqNullSafe(named["block"])).select(key, "rep")
    copies = written(several.filter(F.col(key) != F.col("rep")), "copies")
    classes = written(facts.join(copies.select(key), key, "left_anti").select(F.col(key).alias("rep"), "block", "tokens", "n"), "classes")  # tokens are shuffled once
    members = copies.unionByName(classes.select(F.col("rep").alias(key), "rep"))
    pairs = written(class_pairs(classes, like), "pairs")
    back = pairs.select(F.col("like").alias("rep"), F.col("rep").alias("like"), "inter", "total")
    own = classes.select("rep", F.col("rep").alias("like"), F.col("n").alias("inter"), F.col("n").alias("total"))
    return members, pairs.unionByName(back).unionByName(own)


def similar_pairs(rows: DataFrame, key: str = "doc_id", like: tuple[int, int] = LIKE) -> DataFrame:
    """Pairs of one block with Jaccard similarity like[0] / like[1] or more: key, other (the lesser), inter, total.
    Null blocks are equal to each other. Pairs of classes are written out for their members last."""
    members, alike = similar_classes(rows, key, like)
    others = members.select(F.col("rep").alias("like"), F.col(key).alias("other"))
    return members.join(alike, "rep").join(others, "like").filter(F.col("other") < F.col(key)).select(key, "other", "inter", "total")


def variants(rows: DataFrame, key: str = "doc_id", like: tuple[int, int] = LIKE) -> DataFrame:
    """Variant links: key, variant_of. A row that has a duplicate looks only at rows before that duplicate."""
    members, alike = similar_classes(rows, key, like)
    stop = duplicates(rows, key).withColumnRenamed("duplicate_of", "stop")
    others = members.select(F.col("rep").alias("like"), F.col(key).alias("other"))
    before = F.col("other") < F.least(F.col(key), F.col("stop"))
    return members.join(stop, key).join(alike.select("rep", "like"), "rep").join(others, "like").filter(before).select(key, F.col("other").alias("variant_of"))


def link_parts(rows: DataFrame, key: str = "doc_id", like: tuple[int, int] = LIKE) -> tuple[DataFrame, DataFrame]:
    """rows(key, block, text) as parts of links, from which `variants_of` makes the long lists in one pass, unshuffled:
    parts: key, duplicate_of, rep (of its class), bound (variants are before it) and more (variants beside those of its class);
    lists: rep and all, the sorted keys of all classes that are alike, its own among them.

    A class is the rows of one block, one set of frequent tokens and one size. Where frequent tokens alone make two
    classes alike, all their rows are; other rows are alike only by rare tokens that they share, of which each has at most
    `RARE` rows. Null blocks are equal to each other."""
    a, b = like
    each = rows.select(key, F.struct("block").alias("block"), F.explode(tokens(F.col("text"))).alias("token"))
    counts = each.groupBy("block", "token").agg(F.count("*").alias("df"))
    told = each.join(counts, ["block", "token"])
    some = lambda on: F.sort_array(F.collect_list(F.when(on, F.col("token"))))
    sets = told.groupBy(key, "block").agg(F.count("*").cast("int").alias("n"), some(F.col("df") > RARE).alias("core"), some((F.col("df") > 1) & (F.col("df") <= RARE)).alias("rare"))
    sets = written(sets, "sets")
    classes = written(sets.groupBy("block", "core", "n").agg(F.min(key).alias("rep"), F.sort_array(F.collect_list(key)).alias("keys")), "classes")
    cores = classes.select("rep", "block", "core", "n")
    fits = lambda inter, n, m: inter * b >= (n + m - inter) * a
    most = F.size("core") - F.ceil(F.col("n") * a / b).cast("int") + 1
    probe = cores.withColumn("most", most).filter("most > 0").select("rep", "block", "n", F.explode(F.slice("core", 1, F.col("most"))).alias("token"))
    left, right = probe.alias("l"), probe.toDF(*probe.columns).alias("r")
    close = (F.col("l.n") * a <= F.col("r.n") * b) & (F.col("r.n") * a <= F.col("l.n") * b)
    found = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block")) & close)
    pairs = found.select(F.col("l.rep").alias("rep"), F.col("r.rep").alias("like")).distinct()
    one = cores.select("rep", F.col("core").alias("x"), F.col("n").alias("nx"))
    two = cores.select(F.col("rep").alias("like"), F.col("core").alias("y"), F.col("n").alias("ny"))
    inter = F.size(F.array_intersect("x", "y"))
    alike = written(pairs.join(one, "rep").join(two, "like").filter(fits(inter, F.col("nx"), F.col("ny"))).select("rep", "like"), "alike")
    lists = alike.join(classes.select(F.col("rep").alias("like"), "keys"), "like").groupBy("rep").agg(F.sort_array(F.flatten(F.collect_list("keys"))).alias("all"))
    members = classes.select("rep", F.explode("keys").alias(key))
    # rows that share rare tokens and whose classes are not alike by the others
    bare = sets.select(key, F.col("block"), F.explode("rare").alias("token")).join(members, key)
    p, q = bare.alias("p"), bare.toDF(*bare.columns).alias("q")
    shared = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.block") == F.col("q.block")) & (F.col(f"q.{key}") < F.col(f"p.{key}")))
    shared = shared.select(F.col(f"p.{key}").alias(key), F.col("p.rep").alias("rep"), F.col(f"q.{key}").alias("other"), F.col("q.rep").alias("like")).groupBy(key, "rep", "other", "like").agg(F.count("*").alias("r"))
    beside = shared.join(alike, ["rep", "like"], "left_anti").join(one, "rep").join(two, "like").filter(fits(inter + F.col("r"), F.col("nx"), F.col("ny")))
    stop = duplicates(rows, key)
    bound = F.coalesce("duplicate_of", key)
    more = beside.join(stop, key).filter(F.col("other") < bound).groupBy(key).agg(F.sort_array(F.collect_list("other")).alias("more"))
    return stop.join(members, key, "left").join(more, key, "left").withColumn("bound", bound), lists


def variants_of(bound: Column, all_: Column, more: Column) -> Column:
    """The keys of a sorted list before a bound, found by halving, and those beside them."""
    start = F.struct(F.lit(0).alias("low"), F.size(all_).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = F.get(all_, middle) < bound
        return F.when(acc["low"] >= acc["high"], acc).when(less, F.struct((middle + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(all_) + 1)).cast("int"))
    before = F.slice(all_, 1, F.aggregate(steps, start, halve, lambda acc: acc["low"]))
    before = F.when(all_.isNull(), F.slice(more, 1, 0)).otherwise(before)
    return F.when(more.isNull(), before).when(before.isNull(), more).otherwise(F.sort_array(F.concat(before, more)))


def links(rows: DataFrame, key: str = "doc_id", like: tuple[int, int] = LIKE) -> DataFrame:
    """rows(key, block, text) to key, duplicate_of and variants, all earlier keys of `variants` in one array."""
    parts, lists = link_parts(rows, key, like)
    variants = variants_of(F.col("bound"), F.col("all"), F.col("more"))
    none = F.array().cast(lists.schema["all"].dataType)
    return parts.join(lists, "rep", "left").select(key, "duplicate_of", F.coalesce(variants, none).alias("variants"))


def act_rows(acts: DataFrame) -> DataFrame:
    """classified acts as rows for `links`; variants are of equal classe and tipo."""
    return acts.select(F.struct("doc_id", "ord", "act_id").alias("key"), F.struct("classe", "tipo").alias("block"), "text")


def act_links(acts: DataFrame) -> DataFrame:
    """classified acts to doc_id, ord, duplicate_of (an act_id or null) and variants (act_ids), in the order of
    the archive; variants are of equal classe and tipo."""
    return links(act_rows(acts), "key").select("key.doc_id", "key.ord", F.col("duplicate_of.act_id").alias("duplicate_of"), F.transform("variants", lambda x: x["act_id"]).alias("variants"))


def remap(links: DataFrame, local: DataFrame, everywhere: DataFrame) -> DataFrame:
    """links(doc_id, old) with new: the document's own new id, else the only new id anywhere, else null if
    ambiguous and old if unknown. local(doc_id, old, new), everywhere(old, new)."""
    only = everywhere.groupBy("old").agg(F.min("new").alias("one"), F.count_distinct("new").alias("n"))
    joined = links.join(local, ["doc_id", "old"], "left").join(only, "old", "left")
    return joined.select("doc_id", "old", F.when(F.col("new").isNotNull(), F.col("new")).when(F.col("n") == 1, F.col("one")).when(F.col("n").isNull(), F.col("old")).alias("new"))


def last_states(history: DataFrame, most: int = 12) -> DataFrame:
    """The last states of each document: history(doc_id, at, ...)."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("at"))
    return history.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= most)
