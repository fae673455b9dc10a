"""Similarity join on word n-grams: prefix filtering, rare n-grams first.

Documents with equal sets fold into one class, whatever their number.  Two sets of
similarity t share all but a few n-grams, so in any common order they meet among the
first ones of each: only such prefixes are joined.  This is done twice.

1. In the order of hashes, which needs no counting.  The prefixes are a little longer
   than needed, so that a pair must share several n-grams of them; classes that share
   too few with all others together have no partner and leave.  Most do.
2. For those that stay, all n-grams are counted and put in order, the rare ones first.
   An n-gram that a single class has is no one's partner; if the others are too few
   for any link, the class leaves.  The rest join on their rare-first prefixes, under
   a length filter, a positional filter and a suffix filter.

Members of a large bucket need not all be compared: what is asked for is who is
connected.  So each class is first compared with one leader, then with the leaders
of all buckets that still hold several components, and only what these rounds left
apart is joined as a whole.  Every pair is verified once, on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.operators.bitmap import MemberBits
from adsift.llm.common import (
    NO_ID,
    ascii_lower,
    joined_runs,
    marked,
    member_bits,
    own_columns,
    space_words,
    stage,
    text_digest,
    without_rows,
)

#: Words of a shingle and percent of the union that linked sets share.
WORDS, PERCENT = 5, 80
#: Percent of a set by which the prefixes of the first step are longer than needed.
FIRST_EXTRA = 5
#: Bits of an n-gram's hash in the first step; equal ones are told apart in the second.
_SHORT = 48
#: Parts of a set that the suffix filter compares.
SUFFIX_PARTS = 16


# --- sets -----------------------------------------------------------------------


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_digest, set)``: the hashes of the different shingles, sorted.

    A text with fewer words is one shingle; one without words or null has none.
    """
    own = own_columns(docs, doc_id="long", text="string")
    hashes = F.transform(space_words(ascii_lower(own["text"])), lambda w: F.xxhash64(w))
    digest = text_digest(own["text"]).alias("text_digest")
    rows = docs.select(own["doc_id"].alias("doc_id"), digest, hashes.alias("h"))
    rows = joined_runs(rows.withColumn("s", F.col("h")), "s", words)
    size = F.size("h")
    # A whole short sequence is hashed with its length, unlike any run.
    whole = F.array(F.xxhash64(size, F.col("h")))
    chosen = F.when(size >= words, F.col("s")).when(size > 0, whole).otherwise(
        F.array().cast("array<bigint>")
    )
    return rows.select("doc_id", "text_digest", F.sort_array(F.array_distinct(chosen)).alias("set"))


def _digests(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"d1": F.xxhash64("set"), "d2": F.xxhash64(F.lit(1), F.col("set")), "n": F.size("set")}
    )


# --- components -----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(v, label)`` of all vertices of edges ``(a, b)``: the least one connected.

    Alternating large and small stars: each vertex hands its larger, then its
    smaller neighbours on to the least one it knows, until only stars are left.
    Minima fold in each task, so a vertex with very many neighbours is no hot key.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stage(ends.where(F.col("u") != F.col("v")).distinct(), "star")
    while not _all_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", "m").unionAll(small.select(F.col("v").alias("u"), "m"))
        small = small.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))
        now = stage(small.distinct(), "small-star")
    leaves = now.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return leaves.unionAll(now.select("v", F.col("v").alias("label")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller end, which is no larger end itself."""
    if not edges.groupBy("u").count().where(F.col("count") > 1).isEmpty():
        return False
    inner = edges.select(F.col("v").alias("u"))
    return edges.join(inner, "u", "left_semi").isEmpty()


# --- candidates -----------------------------------------------------------------


def _least(percent: int) -> str:
    """How many n-grams a set of ``n`` shares with any partner at least."""
    return f"(({percent} * n + 99) div 100)"


def _first_prefix(percent: int) -> tuple[Column, Column]:
    """Of a set of ``n``: the length of its prefix in the first step, and how many
    n-grams of it any partner's prefix shares at least; the smallest partner counts."""
    least = _least(percent)
    length = f"least(n, n - {least} + ({FIRST_EXTRA} * n) div 100 + 1)"
    return F.expr(f"int({length})"), F.expr(f"int(({FIRST_EXTRA} * {least}) div 100 + 1)")


def _classes(sets: DataFrame, odd: MemberBits) -> tuple[DataFrame, DataFrame]:
    """The classes ``(d1, d2, id, tag)``, and one row ``(id, tag, n, prefix)`` of each.

    A class is named by its least id, and by a digest where ``odd`` says that rows
    may share an id.  Only members of classes with several move.
    """
    keyed = sets.where(F.col("n") > 0).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = keyed.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"))
    found = stage(_tagged(found, odd), "join-classes")
    shared = member_bits(found.where(F.col("members") > 1).select("d1"))
    keyed = marked(keyed, shared, F.col("d1"), "hit")
    kept = ["id", "tag", "n", "prefix"]
    several = keyed.where("hit").join(found.select("d1", "d2", "id", "tag"), ["d1", "d2", "id"])
    single = _tagged(keyed.where(~F.col("hit")), odd)
    rows = single.select(*kept).unionAll(several.dropDuplicates(["d1", "d2"]).select(*kept))
    return found, rows


def _tagged(classes: DataFrame, odd: MemberBits) -> DataFrame:
    """With a column ``odd``, whether rows may share the id, and the tag for this case."""
    tag = F.when(F.col("odd"), F.col("d1")).otherwise(F.lit(0).cast("long"))
    return marked(classes, odd, F.col("id"), "odd").withColumn("tag", tag)


def _survivors(classes: DataFrame, percent: int) -> DataFrame:
    """``(id, tag)`` of the classes that share enough of their hash-order prefixes."""
    need = _first_prefix(percent)[1]
    rows = classes.select("id", "tag", need.alias("need"), F.explode("prefix").alias("s"))
    common = rows.groupBy("s").count().where(F.col("count") > 1).select("s")
    return (
        rows.join(common, "s", "left_semi")
        .groupBy("id", "tag")
        .agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
        .where(F.col("shared") >= F.col("need"))
        .select("id", "tag")
    )


def _whole_sets(docs: DataFrame, kept: DataFrame, odd: MemberBits, words: int) -> DataFrame:
    """``(c, n, set)`` of the classes that stay, from the text of one member each."""
    own = own_columns(docs, doc_id="long", text="string")
    able = docs.select(F.coalesce(own["doc_id"], F.lit(NO_ID)).alias("id"), own["text"].alias("text"))
    able = marked(able, member_bits(kept.select("id")), F.col("id"), "hit")
    texts = able.where("hit").join(kept.select("id").distinct(), "id", "left_semi")
    texts = marked(texts, odd, F.col("id"), "odd")

    def sets(rows: DataFrame) -> DataFrame:
        found = _digests(shingle_sets(rows.select(F.col("id").alias("doc_id"), "text"), words))
        return found.withColumnRenamed("doc_id", "id")

    # An id of one row names its class; only others need the digest and may repeat.  They are
    # told apart before their sets are made.
    several = _tagged(sets(texts.where("odd")), odd).select("id", "tag", "n", "set")
    several = several.join(kept, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
    single = sets(texts.where(~F.col("odd"))).withColumn("tag", F.lit(0).cast("long"))
    once = single.select("id", "tag", "n", "set").unionAll(several)
    return once.select(F.struct("id", "tag").alias("c"), "n", "set")


def _place(count: Column, hashed: Column) -> Column:
    """Rare n-grams first, in one number: 20 bits of the count, 43 of the hash.

    N-grams that fall together are one entry of the join, and told apart when
    pairs are verified.
    """
    high = F.call_function("shiftleft", F.least(count, F.lit((1 << 20) - 1)), F.lit(43))
    return high.bitwiseOR(F.call_function("shiftrightunsigned", hashed, F.lit(21)))


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """``(s, c, n, pos, parts)``: the rare-first prefixes of all classes that can
    have a partner.

    An n-gram is named by its place in the order, its count followed by its hash;
    ``pos`` is its place among the class's own, those of no other class being in
    front; ``parts`` are the numbers of the common ones by hash.
    """
    rows = sets.select("c.id", "c.tag", "n", F.explode("set").alias("s"))
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    part = F.pmod("s", F.lit(SUFFIX_PARTS))
    parts = [F.count_if(part == b).cast("int").alias(f"p{b}") for b in range(SUFFIX_PARTS)]
    least = F.expr(f"int({_least(percent)})")
    shared = (
        rows.join(common, "s")
        .groupBy("id", "tag", "n")
        .agg(
            F.count(F.lit(1)).cast("int").alias("m"),
            F.collect_list(_place(F.col("k"), F.col("s"))).alias("order"),
            *parts,
        )
        .where(F.col("m") >= least)
    )
    prefix = F.slice(F.sort_array("order"), F.lit(1), F.col("m") - least + 1)
    # Outer: a filter on the array would sort it once more.
    return shared.select(
        F.struct("id", "tag").alias("c"), "n", "m",
        F.array(*[f"p{b}" for b in range(SUFFIX_PARTS)]).alias("parts"),
        F.posexplode_outer(prefix).alias("i", "x"),
    ).select(
        F.col("x").alias("s"), "c", "n", (F.col("n") - F.col("m") + F.col("i")).alias("pos"), "parts"
    )


def _may_link(a: str, b: str, percent: int, first: bool) -> Column:
    """Length and suffix filter for two entries of a bucket, and the positional one
    where the bucket is to be the first n-gram that the two have in common."""
    x, y = (lambda f, t=t: F.col(f"{t}.{f}") for t in (a, b))
    length = (100 * F.least(x("n"), y("n"))) >= percent * F.greatest(x("n"), y("n"))
    overlap = F.ceil(F.lit(percent) * (x("n") + y("n")) / F.lit(100 + percent))
    bound = F.aggregate(
        F.zip_with(x("parts"), y("parts"), lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v
    )
    after = 1 + F.least(x("n") - x("pos") - 1, y("n") - y("pos") - 1)
    placed = after >= overlap if first else F.lit(True)
    return length & placed & (bound >= overlap)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b, linked)`` of each pair, from the whole sets."""
    one = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    other = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * common >= percent * (F.col("na") + F.col("nb") - common)
    return pairs.join(other, "b").join(one, "a").select("a", "b", linked.alias("linked"))


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Bucket entries with their component, of buckets that hold several."""
    labels = components(edges).withColumnRenamed("v", "c")
    rows = rows.drop("label").join(labels, "c", "left").withColumn(
        "label", F.coalesce("label", F.col("c"))
    )
    mixed = rows.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.where(F.col("low") != F.col("high")).select("s")
    return stage(rows.join(mixed, "s", "left_semi"), "join-rows")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified edges ``(a, b)`` that connect all that links connect."""
    entry = F.struct("c", "n", "pos", "parts")
    rows = stage(rows.withColumn("label", F.col("c")), "join-rows")

    def with_leaders(rows: DataFrame, leader: Column) -> DataFrame:
        lead = rows.groupBy("s").agg(leader.alias("x"))
        pairs = rows.select("s", entry.alias("y"), "label").join(lead, "s")
        return pairs.where((F.col("label") != F.col("x.label")) & _may_link("x", "y", percent, False)).select(
            F.col("x.c").alias("a"), F.col("y.c").alias("b")
        )

    full = F.struct("c", "n", "pos", "parts", "label")
    # One leader for each class: the least of those that its buckets offer.
    first = with_leaders(rows, F.min(full)).groupBy("b").agg(F.min("a").alias("a"))
    done = stage(_verified(_ordered(first), sets, percent), "join-done")
    rows = _labelled(rows, done.where("linked").select("a", "b"))
    # Every bucket's own leader, drawn by hash, for members not connected with it.
    second = _ordered(with_leaders(rows, F.min_by(full, F.xxhash64("s", "c"))))
    new = second.join(done, ["a", "b"], "left_anti")
    done = done.unionAll(stage(_verified(new, sets, percent), "join-done"))
    rows = _labelled(rows, done.where("linked").select("a", "b"))
    # What is left: entries outside a bucket's largest component, with all others.
    sizes = rows.groupBy("s", "label").count()
    main = sizes.groupBy("s").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    entries = rows.select("s", entry.alias("y"), "label")
    outside = rows.select("s", entry.alias("x"), F.col("label").alias("own")).join(main, "s").where(
        F.col("own") != F.col("main")
    )
    third = outside.join(entries, "s").where(
        (F.col("own") != F.col("label")) & _may_link("x", "y", percent, True)
    ).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    new = _ordered(third).join(done, ["a", "b"], "left_anti")
    done = done.unionAll(stage(_verified(new, sets, percent), "join-done"))
    return done.where("linked").select("a", "b")


def _prepared(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the digests of text and set, and the label of each set's class."""
    own = own_columns(docs, doc_id="long", text="string")
    rows = docs.select(own["doc_id"].alias("doc_id"), own["text"].alias("text"))
    sets = _digests(shingle_sets(rows, words))
    short = F.transform(
        F.slice("set", F.lit(1), _first_prefix(percent)[0]),
        lambda x: F.call_function("shiftrightunsigned", x, F.lit(64 - _SHORT)),
    )
    sets = stage(sets.withColumn("prefix", short).drop("set"), "join-sets")
    ident = F.coalesce("doc_id", F.lit(NO_ID))
    repeated = sets.groupBy(ident.alias("id")).count().where(F.col("count") > 1).select("id")
    odd = member_bits(repeated)
    classes, rows = _classes(sets, odd)
    kept = stage(_survivors(rows, percent), "join-kept")
    whole = stage(_whole_sets(docs, kept, odd, words), "join-whole")
    edges = _links(_rare_first(whole, percent), whole, percent)
    labels = stage(components(edges).select(F.col("v").alias("c"), "label"), "join-labels")
    named = (
        classes.select("d1", "d2", F.struct("id", "tag").alias("c"))
        .join(labels, "c", "left")
        .select("d1", "d2", F.coalesce("label", "c").alias("label"))
    )
    return sets.drop("prefix"), named


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document.

    Documents are linked if they share ``percent`` of the union of their sets;
    ``component_id`` is the smallest id that links reach.  Documents without a
    word are linked with nothing.  Null ids are reported as null unless a link
    reaches an id.  Rows with equal ids are documents of their own.
    """
    sets, named = _prepared(docs, words, percent)
    joined = sets.join(named, ["d1", "d2"], "left")
    reached = F.nullif(F.col("label.id"), F.lit(NO_ID))
    found = F.when(F.col("n") > 0, reached).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), found.alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each group; the columns of ``docs``.

    If several rows of a group have that id, one of them stays.  Documents
    without a word stay, each being its own group.
    """
    sets, named = _prepared(docs, words, percent)
    ident = F.coalesce("doc_id", F.lit(NO_ID))
    rows = sets.where(F.col("n") > 0).join(named, ["d1", "d2"]).select(
        "label", ident.alias("id"), F.col("text_digest").alias("digest")
    )
    rows = rows.groupBy("label", "id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy("label").agg(F.min(F.struct("id", "digest")).alias("first"))
    marked = rows.join(first, "label").withColumn(
        "stays", F.struct("id", "digest") == F.col("first")
    )
    gone = marked.where(~F.col("stays") | (F.col("copies") > 1)).select("id", "digest", "stays")
    return without_rows(docs, stage(gone, "join-gone"))
