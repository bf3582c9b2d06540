"""An inverted index of identifiers: many names are found by one join in place of a scan for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tokens as T

#: Words of a text of no known language.
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"


def folded(name: Column) -> Column:
    """The name in small letters without underscores: the same for its spellings in Pascal, camel and snake case."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def of_lines(lines: DataFrame, key: str = "rel_path") -> DataFrame:
    """name, key, uses and lines (ascending, each once) of every word in lines(key, line_no, line)."""
    words = lines.select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(WORD), 0)).alias("name"))
    return words.groupBy("name", key).agg(F.count(F.lit(1)).alias("uses"), F.sort_array(F.collect_set("line_no")).alias("lines"))


def of_code(texts: DataFrame) -> DataFrame:
    """name, rel_path, uses and lines of every identifier in the code of texts(rel_path, ext, text), comments and strings aside."""
    words = T.tokens(texts).filter("kind = 'word'")
    return words.groupBy(F.col("token").alias("name"), "rel_path").agg(F.count(F.lit(1)).alias("uses"), F.sort_array(F.collect_set("line")).alias("lines"))


def refreshed(postings: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "rel_path") -> DataFrame:
    """Postings without those of the files in gone(key), and of the files in ``changed``, other postings, only these: what an update of some files leaves to do."""
    touched = gone.select(key).unionByName(changed.select(key)).distinct()
    return postings.join(touched, key, "left_anti").select(*postings.columns).unionByName(changed.select(*postings.columns))


def found(postings: DataFrame, names: DataFrame, key: str = "rel_path", any_casing: bool = False) -> DataFrame:
    """asked, name, key, uses and lines for each of names(name) and each file that has it, or, if so asked, some spelling of it.

    One equi-join for all names; a name that most files have is dealt out by the skew join.
    """
    asked = names.select(F.col("name").alias("asked")).distinct()
    if not any_casing:
        return postings.join(asked, F.col("name") == F.col("asked")).select("asked", "name", key, "uses", "lines")
    spelt = asked.withColumn("fold", folded(F.col("asked")))
    return postings.withColumn("fold", folded(F.col("name"))).join(spelt, "fold").select("asked", "name", key, "uses", "lines")
