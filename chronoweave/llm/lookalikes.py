"""Values that look the same but are made of different characters, brought to one form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.components import shared_folder
from chronoweave.operators.sizes import sent_if_small

# Letters of other scripts and the Cyrillic (or else Latin) letter they look like or stand in for.
LATIN = "ABCEHKMOPTXYaceopxy"
LATIN_AS = "АВСЕНКМОРТХУасеорху"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ"
GREEK_AS = "АВЕZНIКМНОРТУХаiкvортух"
OTHERS = {"\u00eb": "ё", "\u00cb": "Ё", "\u0455": "s", "\u0405": "S", "\u0456": "i", "\u0406": "I", "\u0458": "j", "\u0408": "J"}
# Dashes like the hyphen, and blanks like the space.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63"
BLANKS = "\t\n\r\u000b\u000c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and signs of these blocks are copies of the ASCII ones in the same order: full-width, and mathematical styles.
_WIDE = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_STYLED = {chr(0x1D400 + 52 * style + k): chr((0x41 if k < 26 else 0x61 - 26) + k) for style in range(13) for k in range(52)}


BREVE, DIAERESIS = "\u0306", "\u0308"


def _mapping() -> dict[str, str]:
    base = dict(zip(LATIN, LATIN_AS, strict=True)) | dict(zip(GREEK, GREEK_AS, strict=True)) | OTHERS | dict.fromkeys(DASHES, "-") | dict.fromkeys(BLANKS, " ")
    again = {k: base.get(v, v) for k, v in (_WIDE | _STYLED).items()}
    return base | again


#: A letter run with its marks and invisible characters, or one other character. Every character is in one piece.
PIECE = r"[\p{L}\p{M}\p{Cf}]+|[^\p{L}\p{M}\p{Cf}]"
PLAIN = r"^(?:[А-ЯЁа-яё]+|[A-Za-z]+|[ -@\[-`{-~№«»])$"


def skeleton(piece: Column) -> Column:
    """The piece with every look-alike mapped to one letter; what still differs by form only is left to the collation."""
    pairs = _mapping()
    return F.translate(piece, "".join(pairs), "".join(pairs.values()))


def _composed(text: Column) -> Column:
    """Without invisible characters, and with breve and diaeresis joined to their letter."""
    text = F.regexp_replace(text, r"\p{Cf}", "")
    for letter, mark, joined in (("и", BREVE, "й"), ("И", BREVE, "Й"), ("е", DIAERESIS, "ё"), ("Е", DIAERESIS, "Ё")):
        text = F.replace(text, F.lit(letter + mark), F.lit(joined))
    return text


def _boxes(fields: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))


def canonical_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each distinct value that is not in its canonical form, with that form: ``field``, ``value``, ``canonical`` (a checkpoint).

    Values are reduced to distinct ones with counts and written once. They are cut into letter runs and single signs, and each
    piece is mapped to a skeleton in which look-alike letters are one. Skeletons of a field that are equal under an
    accent-sensitive, case-insensitive Unicode collation (full width, styled letters, joined or apart accents and invisible
    characters are no difference there; е and ё, и and й are) form a class. Of the members of one script without odd
    characters, the one most rows write is canonical, the Cyrillic one on a tie; it is joined back to the pieces that aren't
    written like it, keeping their letter case. Only values that hold such a piece are put together again: pieces that stay as
    they are, such as the blank in nearly every value, are never shuffled with their values.

    A class without such a member becomes its skeleton with accents joined: Cyrillic if all its letters can be, else Latin.
    A character that is neither plain nor like a plain one stays and makes the value a case. Null is no value. Empty values
    are plain.
    """
    shared_folder(df.sparkSession)
    values = df.select(_boxes(fields).alias("b")).select("b.field", "b.value").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n")).checkpoint()
    cut = F.regexp_extract_all("value", F.lit(PIECE), F.lit(0))

    members = values.select("field", "n", F.explode(cut).alias("piece")).groupBy("field", "piece").agg(F.sum("n").alias("n")).withColumn("skeleton", skeleton(F.col("piece")))
    # Spark compares collated texts by their collation: groups and joins by this column are by class.
    low = F.when(F.col("piece").rlike(PLAIN), F.lower("piece"))
    spelled = members.withColumn("class", F.collate("skeleton", "UNICODE_CI")).withColumn("low", low).checkpoint()
    votes = spelled.where("low IS NOT NULL").groupBy("field", "class", "low").agg(F.sum("n").alias("votes"))
    best = votes.groupBy("field", "class").agg(
        F.max_by("low", F.struct("votes", F.col("low").rlike("[а-яё]").cast("int").alias("cyrillic"), "low")).alias("winner")
    )
    joined = spelled.alias("s").join(best.alias("w"), (F.col("s.field") == F.col("w.field")) & (F.col("s.class") == F.col("w.class")), "left")
    bare = _composed(F.col("skeleton"))
    latin = F.translate(bare, LATIN_AS, LATIN)
    made = F.when(bare.rlike(PLAIN), bare).when(latin.rlike(PLAIN), latin).otherwise(bare)
    styled = (
        F.when(F.lower("piece") == F.col("winner"), F.col("piece"))
        .when((bare == F.upper(bare)) & ((F.length(bare) > 1) | (bare != F.lower(bare))), F.upper("winner"))
        .when((F.substring(bare, 1, 1) == F.upper(F.substring(bare, 1, 1))), F.concat(F.upper(F.substring("winner", 1, 1)), F.expr("substring(winner, 2)")))
        .otherwise(F.col("winner"))
    )
    canon = joined.select(F.col("s.field").alias("field"), "piece", F.coalesce(styled, made).alias("good"))
    canon = sent_if_small(canon.where(~F.col("piece").rlike(PLAIN) | (F.col("piece") != F.col("good"))).checkpoint())  # the rest stays as it is

    # Pieces carry a digest of their value, not the value, which may be very long.
    hit = values.select("field", F.md5("value").alias("of"), F.explode(F.array_distinct(cut)).alias("piece")).join(canon, ["field", "piece"])
    better = hit.groupBy("field", "of").agg(F.map_from_entries(F.collect_list(F.struct("piece", "good"))).alias("better"))
    whole = values.withColumn("of", F.md5("value")).join(better, ["field", "of"])
    canonical = F.array_join(F.transform(cut, lambda p: F.coalesce(F.col("better")[p], p)), "")
    return whole.select("field", "value", canonical.alias("canonical")).checkpoint()


def odd_rows(df: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """The rows and fields whose value is not plain: ``row_id``, ``field_name``, ``value``, ``canonical``."""
    rows = df.select(F.col(row_id).alias("__id"), _boxes(fields).alias("b")).select("__id", "b.field", "b.value")
    return rows.join(sent_if_small(canonical_values(df, fields)), ["field", "value"]).select(F.col("__id").alias(row_id), F.col("field").alias("field_name"), "value", "canonical")


def one_form(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The table with the values of ``fields`` in canonical form; every row and every other column stays."""
    odd = canonical_values(df, fields)
    out = df
    for f in fields:
        mine = odd.where(F.col("field") == f).select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
        out = out.join(sent_if_small(mine), F.col(f) == F.col("__value"), "left").withColumn(f, F.coalesce("__canonical", f)).drop("__value", "__canonical")
    return out
