"""Text helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adsift.operators.bitmap import marked as marked
from adsift.operators.bitmap import member_bits as member_bits
from adsift.sources.storage import scratch_path as scratch_path
from adsift.sources.storage import stage as stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: blank and the control characters from tab to return.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is; null stays null.

    ``lower`` does just this for texts of plain ASCII, and fast.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of separators; none for null."""
    words = F.split(F.coalesce(text, F.lit("")), separators)
    return F.array_remove(words, "")


def space_words(text: Column) -> Column:
    return split_words(text, SPACES)


def joined_runs(df: DataFrame, column: str, width: int, combine=F.xxhash64) -> DataFrame:
    """Replace an array by the values of each ``width`` neighbours together, in order;
    empty if there are fewer.

    Each step doubles the neighbours taken, the last one overlaps.  Every step is a
    column of its own, since it reads the one before more than once.
    """
    have = 1
    while have < width:
        shift = min(have, width - have)
        values = F.col(column)
        n = F.greatest(F.size(values) - shift, F.lit(0))
        left, right = F.slice(values, F.lit(1), n), F.slice(values, F.lit(shift + 1), n)
        df = df.withColumn(column, F.zip_with(left, right, lambda a, b: combine(a, b)))
        have += shift
    return df


def own_columns(docs: DataFrame, **kinds: str) -> dict[str, Column]:
    """The named columns, cast to the types given; columns the table lacks are null.

    Operators read their input through these, so further columns, whatever
    their names, do not disturb them.
    """
    return {
        name: (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)
        for name, kind in kinds.items()
    }


def document_columns(docs: DataFrame, **kinds: str) -> DataFrame:
    """A table of just these columns."""
    return docs.select(*[c.alias(n) for n, c in own_columns(docs, **kinds).items()])


def private(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not use."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Stands for a null id among ids, behind all others.
NO_ID = (1 << 63) - 1


def text_digest(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text digest are in ``gone``.

    ``gone`` is a staged table ``(id, digest, stays)``; of equal rows marked
    ``stays`` one is left.  Only documents whose id may be in it are joined;
    the texts of all others stay where they are.
    """
    own = own_columns(docs, doc_id="long", text="string")
    names = [private(docs, n) for n in ("_id", "_digest", "_stays")]
    ident, digest, stays = names
    hit = private(docs, "_hit")
    asked = F.coalesce(own["doc_id"], F.lit(NO_ID))
    flagged = marked(docs, member_bits(gone), asked, hit)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    able = flagged.where(F.col(hit)).withColumns({ident: asked, digest: text_digest(own["text"])})
    joined = able.join(gone.toDF(*names), [ident, digest], "left")
    once = joined.where(F.col(stays)).dropDuplicates([ident, digest])
    return (
        flagged.where(~F.col(hit)).select(*kept)
        .unionAll(joined.where(F.col(stays).isNull()).select(*kept))
        .unionAll(once.select(*kept))
    )


#: A key that holds more than one row in so many of a table is hot.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, salts)`` of the hot keys of a staged table: ``HOT_SHARE`` rows at most."""
    share = max(1, df.count() // HOT_SHARE)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    return counts.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))


def hot_join(left: DataFrame, right: DataFrame, key: str, place: str, how: str = "left") -> DataFrame:
    """Join of two staged tables, ``right`` unique by ``key``, whatever share of ``left``
    a key holds.

    Rows of a hot key are dealt by the hash of column ``place`` to salted copies of the key's
    row, about as many as it has thousandths of the table.  The list of hot keys is
    bounded by their definition, so it is broadcast.
    """
    hot = stage(hot_keys(left, key), "hot-keys")
    salt = F.pmod(F.xxhash64(place), F.col("_salts")).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.coalesce(salt, F.lit(0))
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies))
    return dealt.drop("_salts").join(copied.drop("_salts"), [key, "_salt"], how).drop("_salt")
