"""Names to a roster by shared words: a Dice score over words that are equal or one the beginning of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say nothing about which club is meant.
STOP_WORDS = ("fc", "cf", "ac", "afc", "sc", "cd", "ud", "ca", "rc", "as", "1", "de")
_FROM = "àâäáãåéèêëíìîïóòôöõøúùûüçñýÿ"
_TO = "aaaaaaeeeeiiiioooooouuuucnyy"


def words(name: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(name), _FROM, _TO), "[^a-z0-9 ]", " ")
    return F.filter(F.split(F.btrim(F.regexp_replace(plain, " +", " ")), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def link(names: DataFrame, roster: DataFrame, group: str, name: str, entry: str, least: float = 0.5, alias: dict[str, str] | None = None) -> DataFrame:
    """(group, name, entry, score): the best entry of the group's roster, null below `least`; ties to the first entry in order.

    alias: names that are looked up under another name first; the given name is reported. Names meet entries only over a shared beginning of a word (three letters, or the whole of a shorter word), not all of a roster.
    """
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in alias.items() for v in kv]), F.col(name)), F.col(name)) if alias else F.col(name)
    n = names.select(group, name).where(F.col(name).isNotNull()).distinct().withColumn("_a", words(known))
    r = roster.select(F.col(group).alias("_g"), F.col(entry)).distinct().withColumn("_b", words(F.col(entry)))
    key = lambda ws: F.array_distinct(F.transform(ws, lambda w: F.substring(w, 1, 3)))
    pairs = n.select("*", F.explode(key("_a")).alias("_k")).join(r.select("*", F.explode(key("_b")).alias("_rk")), (F.col(group) == F.col("_g")) & (F.col("_k") == F.col("_rk")))
    pairs = pairs.select(group, name, entry, "_a", "_b").distinct()
    meets = lambda t, f: (t == f) | ((F.length(t) >= 3) & f.startswith(t)) | ((F.length(f) >= 3) & t.startswith(f))
    hits = F.size(F.filter("_a", lambda t: F.exists("_b", lambda f: meets(t, f))))
    same = F.array_join("_a", " ") == F.array_join("_b", " ")
    score = F.when(same, 1.0).otherwise(2.0 * hits / (F.size("_a") + F.size("_b")))
    best = pairs.withColumn("_s", score).where(F.col("_s") >= least).groupBy(group, name).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(entry).alias("e"))).alias("m"))
    return n.select(group, name).join(best, [group, name], "left").select(group, name, F.col("m.e").alias(entry), (-F.col("m.s")).alias("score"))
