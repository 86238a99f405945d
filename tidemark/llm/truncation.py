"""Texts cut off by field limits or in transfer.

First stage: length histograms of each source, in characters and in bytes, show spikes where a field limit cuts; a text of such a length
that has no terminal is cut. Second stage, for transfers that break anywhere: a text whose end shows that it was not
finished, by the same test of terminals and of last lines that are complete in themselves. `stage` says which found a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import checked_broadcast


@dataclass(frozen=True)
class Closings:
    """Last lines that are complete without a terminal: notes by themselves, and labels of what follows them (`Photo: Name`); lower case."""

    notes: tuple[str, ...] = (
        "to be continued", "more follows", "more to follow", "à suivre", "suite demain", "la suite demain", "continuará", "sigue mañana",
        "lol", "mdr", "ptdr", "jaja", "jajaja", "haha", "xd", "ends", "fin", "end", "final", "the end",
    )
    labels: tuple[str, ...] = (
        "tags", "mots-clés", "etiquetas", "photo", "photos", "foto", "source", "fuente", "text", "texte", "texto", "by", "par", "por",
        "attendance", "spectateurs", "asistencia", "espectadores", "kick-off", "coup d'envoi", "saque inicial",
    )
    clocks: tuple[str, ...] = ("kick-off", "coup d'envoi", "saque inicial")


# What a cutter appends: an ellipsis, bare or bracketed, or a count of what is missing, or both.
_DOTS = r"(?:\[ ?(?:\.\.\.|…) ?\]|\( ?(?:\.\.\.|…) ?\)|\.\.\.|…)"
_MISSING = r"\[?\+ ?\d+ (?:chars|characters|caractères|caracteres)\]?"
MARK = rf"(?:{_DOTS}[ ]?{_MISSING}|{_DOTS}|{_MISSING})$"
_EMOJI = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{2B00}-\x{2BFF}\x{FE0F}]"


def _lengths(text: Column) -> dict[str, Column]:
    """Characters and bytes of the text without a mark of cutting, which was appended after a limit had cut: only the last 64
    characters, longer than any mark, are searched for one."""
    mark = F.regexp_extract(F.substring(text, -64, 64), r"[ ]?" + MARK, 0)
    return {"chars": F.length(text) - F.length(mark), "bytes": F.octet_length(text) - F.octet_length(mark)}


def limits(docs: DataFrame, text: str, source: str, least: int = 5, factor: float = 5.0, deviations: float = 5.0) -> DataFrame:
    """(source, unit, length, n, usual): lengths at which a source's texts pile up, unit `chars` or `bytes`.

    A spike holds `least` different texts, `factor` times what the 20 lengths on either side hold on average, and `deviations` standard
    deviations more. A source may have several, as its fields or their limits differ. Marks of cutting are left out of the lengths.
    Texts reposted word for word in a source count once, by hash. Null texts are left out, a null source is a source. Counts are
    taken over all texts, of which only hashes and lengths are shuffled.
    """
    h = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), *[c.alias(k) for k, c in _lengths(F.col(f"`{text}`")).items()]).distinct()
    h = h.select("source", F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])))
    h = h.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    near = lambda a, b: f"coalesce(sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN {a} AND {b}), 0) / 20D"
    h = h.select("*", F.greatest(F.expr(near("20 PRECEDING", "1 PRECEDING")), F.expr(near("1 FOLLOWING", "20 FOLLOWING"))).alias("usual"))
    spike = (F.col("n") >= least) & (F.col("n") >= factor * (F.col("usual") + 0.2)) & (F.col("n") >= F.col("usual") + deviations * F.sqrt("usual"))
    return h.where(spike).select("source", "unit", "length", "n", "usual")


def _shape(line: Column) -> Column:
    """What the end of a structured line looks like: list entries, table rows and bracketed log lines; null for others."""
    tail = lambda c: F.regexp_replace(F.regexp_replace(c, r"\d+(?=\.)", "9"), r"\d", "9")
    return (
        F.when(line.rlike(r"^\s*[-*•] "), F.concat(F.lit("-"), tail(F.regexp_extract(line, r"([^\p{L}]*)$", 1))))
        .when(line.rlike(r"^\s*\|"), F.concat(F.lit("|"), (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))).cast("string"), F.substring(F.rtrim(line), -1, 1)))
        .when(line.rlike(r"^\s*\[\p{L}+\]"), F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(F.regexp_extract(line, r"(\S+)\s*$", 1), r"\d+", "9"), r"\p{Lu}+", "A")))
    )


def line_shapes(docs: DataFrame, text: str, least: int = 3) -> DataFrame:
    """(shape): ends of structured lines that another line follows, which are therefore complete; seen `least` times."""
    t = F.col(f"`{text}`")
    lines = docs.where(t.rlike(r"(?m)^\s*([-*•] |\||\[\p{L}+\])")).select(F.explode(F.slice(F.split(t, "\n"), 1, F.greatest(F.lit(0), F.size(F.split(t, "\n")) - 1))).alias("line"))
    return lines.select(_shape(F.col("line")).alias("shape")).where("shape is not null").groupBy("shape").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("shape")


def ends(docs: DataFrame, text: str, source: str, closings: Closings = Closings()) -> DataFrame:
    """docs with `cut` (boolean, null for null or blank texts), `stage` (length_spike, text_end) and `evidence` (why it is held cut, else null).

    Other columns stay; those three names are replaced. Repeated rows are judged alike; a very long text is judged by its last
    line, its length and, for closing tags or scores, the words before them.
    """
    docs = docs.drop("cut", "stage", "evidence")
    t = F.col(f"`{text}`")
    x = docs.withColumn("_t", F.regexp_replace(t, r"(?:\s|</[a-zA-Z]+>|<br ?/?>)+$", ""))
    x = x.withColumn("_line", F.substring_index("_t", "\n", -1)).withColumn("_shape", _shape(F.col("_line")))
    shapes = line_shapes(docs, text).select(F.col("shape").alias("_known"))
    # texts without a shape get keys of their own, so that they spread where the join is shuffled
    x = x.join(checked_broadcast(shapes), F.coalesce("_shape", F.concat(F.lit("?"), F.xxhash64(t).cast("string"))) == F.col("_known"), "left")
    lim = checked_broadcast(limits(docs, text, source))
    for unit, length in _lengths(t).items():
        # a limit in bytes can fall within a character, which is then dropped or replaced
        slack = F.array(F.lit(0)) if unit == "chars" else F.array(*[F.lit(i) for i in range(3)])
        u = lim.where(F.col("unit") == unit).select(F.col("source").alias(f"_s_{unit}"), F.explode(F.transform(slack, lambda i: F.col("length") - i)).alias(f"_l_{unit}")).distinct()
        x = x.join(checked_broadcast(u), F.col(f"`{source}`").eqNullSafe(F.col(f"_s_{unit}")) & (length == F.col(f"_l_{unit}")), "left")
    at_limit = F.col("_l_chars").isNotNull() | F.col("_l_bytes").isNotNull()
    line = F.btrim("_line")
    low = F.lower(line)
    bare = F.regexp_replace(low, r"^[\s(\[—–-]+|[\s.…!)\]]+$", "")
    note = bare.isin(*closings.notes) | line.rlike(r"^[+*=~_#-]{2,}$")
    tags = line.rlike(r"^#[\p{L}\d_]+(?: #[\p{L}\d_]+)*$")
    label = low.rlike("^(?:" + "|".join(closings.labels) + r") ?:? \S")
    clock_label = low.rlike("^(?:" + "|".join(closings.clocks) + ")")
    score = line.rlike(r"^[\p{Lu}][\p{L}\d'. -]{1,60} \d{1,2}[-–:]\d{1,2} \p{Lu}[\p{L}\d'. -]{1,60}$") & ~line.rlike(r"[\p{Ll}]\. ")
    signed = line.rlike(r"^[—–-]{1,2} ?\p{Lu}")
    outlet = F.replace(F.coalesce(F.col(f"`{source}`"), F.lit("")), F.lit("_"), F.lit(" "))
    # a last word that the text knows only as the beginning of a longer one
    word = F.regexp_extract(line, r"([\p{L}]+)$", 1)
    before = F.substring(F.col("_t"), F.lit(1), F.length("_t") - F.length("_line"))
    longer = F.rlike(before, F.concat(F.lit(r"(?<!\p{L})\Q"), word, F.lit(r"\E\p{L}"))) & ~F.rlike(before, F.concat(F.lit(r"(?<!\p{L})\Q"), word, F.lit(r"\E(?!\p{L})")))
    broken_word = (word != "") & longer
    mark = line.rlike(rf"{MARK}|\x{{FFFD}}$")
    terminal = line.rlike(r"[.!?。](?:[\s»\"”’')\]]*)$")
    inside_number = line.rlike(r"(?:^|[^\d.])\d\.$") & at_limit
    evidence = (
        F.when(F.col("_t") == "", None)
        .when(note | line.rlike(_EMOJI + "$"), None)
        .when(mark, "cut_mark")
        .when(F.col("_shape").isNotNull(), F.when(F.col("_known").isNull(), "unfinished_line"))
        .when(signed & line.contains(","), F.when(~low.endswith(outlet) & F.concat(F.lit(", "), outlet).contains(F.regexp_extract(low, r"(, ?[^,]*)$", 1)), "unfinished_signature"))
        .when(tags | score, F.when(broken_word, "unfinished_word"))
        .when(clock_label, F.when(~line.rlike(r"\d{1,2} ?[:hH.] ?\d{2}$"), "unfinished_line"))
        .when(label, F.when(broken_word, "unfinished_word"))
        .when(signed & (F.length(line) <= 60), None)
        .when(inside_number, "inside_number")
        .when(~terminal, "unfinished")
    )
    x = x.withColumn("evidence", F.when(t.isNotNull(), evidence)).withColumn("stage", F.when(F.col("evidence").isNotNull(), F.when(at_limit, "length_spike").otherwise("text_end")))
    return x.withColumn("cut", F.when(t.isNotNull() & (F.col("_t") != ""), F.col("evidence").isNotNull())).select(*[F.col(f"`{c}`") for c in docs.columns], "cut", "stage", "evidence")
