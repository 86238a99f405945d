"""Freely typed names to the entries of a canonical list.

A name is brought to a plain form and its words are told apart by the list itself: words that many entries share (FC, Rovers,
United ...) are types, the others make the stem. A word of a typed name stands for a type if it is its beginning, its skeleton
(Utd, Rvrs), its two ends (W'derers), or within an edit of it; no list of short forms is kept. Stems are joined by the
pigeonhole principle: a reference of which at most k characters were changed still holds one of its k + 1 segments
unchanged, so equality on positional substrings finds every pair within k edits; levenshtein() then decides. SQL functions
only; names that no entry is meant by are reported through an anti-join.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

K = 2  # edits the join of whole stems can bridge; two only for two swapped neighbours
K_SHORT = 1  # edits in the beginning or end of a shortened stem


@dataclass(frozen=True)
class Vocabulary:
    """What a kind of names knows beside its list; the defaults are for sports clubs, NOTHING knows nothing.

    types: words known to be shared by many names, beside those that the list itself shows. legal: words that may be added to a name or left out without another entry being meant. phrases: written-out forms (patterns)
    and the word they stand for. other_side: words that mean another side of the club. no_entry: words of placeholders.
    """

    types: tuple[str, ...] = ("united", "city", "town", "county", "rovers", "rangers", "wanderers", "albion", "athletic", "olympic", "racing", "sporting", "real", "dynamo", "lokomotiv", "union", "etoile", "as", "rc", "sv", "04")
    legal: tuple[str, ...] = ("fc", "cf", "afc", "sc", "ac", "club", "clube")
    phrases: tuple[tuple[str, str], ...] = ((r"football club", "fc"), (r"racing club", "rc"), (r"assoc(?:iation|\.)? sportive", "as"), (r"sportverein", "sv"))
    other_side: tuple[str, ...] = ("youth", "women", "feminines", "feminin", "femenino", "ladies", "reserves", "reserve", "ii", "iii", "b", "juniors", "academy")
    no_entry: tuple[str, ...] = ("tbd", "tbc", "tba", "bye", "winner", "vainqueur", "ganador", "loser", "group", "groupe", "grupo", "confirmed", "qualifier")


CLUBS, NOTHING = Vocabulary(), Vocabulary((), (), (), (), ())


def _letters() -> tuple[str, str]:
    """Accented Latin letters and their plain forms, from the Unicode decompositions."""
    src, dst = "", ""
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base.isascii() and base.isalpha():
            src, dst = src + chr(cp), dst + base.lower()
    return src + "øØłŁđĐıßœŒæÆ’‘´`ʼ", dst + "oollddisooaa'''''"


_SRC, _DST = _letters()


def _garbled() -> dict[str, str]:
    """UTF-8 read as a one-byte code page: the two characters that then stand for an accented letter, and its plain form."""
    out = {}
    for cp in range(0xC0, 0x180):
        base, raw = unicodedata.normalize("NFKD", chr(cp))[0], chr(cp).encode()
        for page in ("cp1252", "latin-1") if base.isascii() and base.isalpha() else ():
            try:
                out[raw.decode(page)] = base.lower()
            except UnicodeDecodeError:
                pass
    return out


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _mended(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in _garbled().items() for v in kv])
    at = lambda cs, i: F.coalesce(F.get(cs, i), F.lit(""))

    def fix(cs: Column) -> Column:
        one = lambda c, i: F.coalesce(
            F.try_element_at(pairs, F.concat(c, at(cs, i + 1))),
            F.when(F.try_element_at(pairs, F.concat(at(cs, i - 1), c)).isNotNull(), F.lit("")),
            c,
        )
        return F.array_join(F.transform(cs, one), "")

    return _let(F.split(name, ""), fix)


def plain(name: Column) -> Column:
    """Lower case without accents; separators become single blanks; points and apostrophes stay, as they mark short forms."""
    mended = F.when(name.rlike("[ÃÄÅ]."), _mended(name)).otherwise(name)
    t = F.lower(F.translate(mended, _SRC, _DST))
    t = F.regexp_replace(t, r"\p{M}", "")
    return F.btrim(F.regexp_replace(t, r"[^a-z0-9.'?]+", " "))


def type_words(entries: DataFrame, name: str, least: int = 2, share: float = 0.01) -> dict[str, int]:
    """Words that at least `least` entries and `share` of all have in common, with their numbers: a few hundred at the most, as an
    entry has few words."""
    x = entries.select(name).distinct()
    words = x.select(F.explode(F.array_distinct(F.split(plain(F.col(name)), " "))).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return {r["w"]: r["n"] for r in words.where(F.col("n") >= max(least, share * x.count())).collect()}


def _stands_for(word: Column, type_: Column) -> Column:
    """Whether a written word may be the type word, misspelled or shortened."""
    bare = F.translate(word, ".'", "")
    n, m = F.length(bare), F.length(type_)
    skeleton = F.concat(F.array_join(F.split(bare, ""), "%"), F.lit("%"))
    shorter = (word.endswith(".") | (n <= 5)) & (n > 0) & (n < m) & bare.rlike("^[a-z]+$") & (F.substring(bare, 1, 1) == F.substring(type_, 1, 1))
    ends = F.split(word, "'")
    two_ends = word.rlike("^[a-z]+'[a-z]+$") & type_.startswith(ends[0]) & type_.endswith(F.coalesce(F.get(ends, 1), F.lit("?"))) & (n < m)
    digits = type_.rlike(r"^\d+$") & bare.rlike(r"^\d+$") & bare.endswith(type_)
    misspelled = (n >= 4) & (m >= 4) & _near(bare, type_).isNotNull()
    return (bare == type_) | digits | two_ends | (shorter & F.like(type_, skeleton)) | misspelled


def parsed(name: Column, types: dict[str, int], vocabulary: Vocabulary = CLUBS, entry: bool = False) -> Column:
    """struct(kind, types, stem): types holds each type word (`w`), what it may stand for (`may`) whether it may be left out (`opt`) and
    whether it comes before the stem (`first`).

    kind is full, head (the stem is a beginning, `Hrodon.`), tail (`D'isewald`) or none. entry: a name of the list, whose words are
    what they are; if all are types the rarest is the stem.
    """
    t = plain(name)
    for pattern, to in vocabulary.phrases:
        t = F.regexp_replace(t, rf"\b(?:{pattern})(?![a-z0-9])", to)
    every = F.array(*[F.lit(w) for w in types]) if types else F.array().cast("array<string>")
    legal = [w for w in vocabulary.legal]
    bare = lambda w: F.translate(w, ".'", "")
    year = lambda w: bare(w).rlike(r"^(?:1[89]|20)\d\d$")
    same = lambda w: F.filter(every, lambda x: x == bare(w))
    may = lambda w: F.when(F.size(same(w)) > 0, same(w)).when(bare(w).isin(*legal), F.array().cast("array<string>")).otherwise(F.filter(every, lambda x: _stands_for(w, x)))
    meaning = (lambda w: same(w)) if entry else may
    word = lambda w: _let(meaning(w), lambda m: F.struct(w.alias("w"), m.alias("may"), (bare(w).isin(*legal) | year(w)).alias("opt"), (bare(w).isin(*legal) | year(w) | (F.length(bare(w)) <= 3)).alias("small")))
    words = F.transform(F.filter(F.split(t, " "), lambda w: w != ""), word)
    text = lambda ws: F.array_join(F.transform(ws, lambda w: w["w"]), " ")

    def judged(ws: Column) -> Column:
        left = F.filter(ws, lambda w: (F.size(w["may"]) == 0) & ~w["small"])
        # nothing left: the word that fewest entries have is the stem after all
        number = F.create_map(*[F.lit(v) for kv in types.items() for v in kv]) if types else F.create_map().cast("map<string,int>")
        shared = lambda w: F.coalesce(F.array_min(F.transform(w["may"], lambda x: F.try_element_at(number, x))), F.lit(0))
        rarest = F.array_min(F.transform(F.filter(ws, lambda w: ~w["opt"]), lambda w: F.struct((F.size(w["may"]) == 0).alias("small"), shared(w).alias("n"), w["w"].alias("w"))))["w"]
        again = F.filter(ws, lambda w: w["w"] == rarest)
        stem = F.when(F.size(left) > 0, left).otherwise(again)
        return _let(stem, lambda st: finished(ws, st))

    def finished(ws: Column, stem: Column) -> Column:
        other = F.exists(ws, lambda w: F.btrim(w["w"], F.lit(".'")).isin(*vocabulary.other_side, *vocabulary.no_entry) | w["w"].rlike(r"^u\d\d$|^\?+$"))
        st = text(stem)
        kind = F.when((F.lit(False) if entry else other) | (st == ""), "none").when(st.rlike(r"^[a-z0-9 ]{3,}\.$"), "head").when(st.rlike(r"^[a-z]'[a-z0-9 ]{3,}$"), "tail").otherwise("full")
        of_stem = lambda w: F.array_contains(F.transform(stem, lambda x: x["w"]), w["w"])
        at = F.array_position(F.transform(ws, of_stem), True)
        own = F.filter(F.transform(ws, lambda w, i: F.struct(bare(w["w"]).alias("w"), w["may"].alias("may"), w["opt"].alias("opt"), of_stem(w).alias("stem"), (i < at).alias("first"))), lambda w: ~w["stem"] & (F.size(w["may"]) > 0))
        return F.struct(kind.alias("kind"), own.alias("types"), st.alias("stem"))

    return _let(words, judged)


def _starts(n: Column, parts: int):
    """Where segment i of `parts` begins: lengths differ by one at most, the longer ones last."""
    return lambda i: i * F.floor(n / parts) + F.greatest(F.lit(0), i - (parts - n % parts))


def _segments(text: Column, k: int = K) -> Column:
    """The k + 1 segments of a reference with their numbers."""
    start = _starts(F.length(text), k + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("no"), F.substring(text, (start(i) + 1).cast("int"), (start(i + 1) - start(i)).cast("int")).alias("text")))


def _probes(text: Column, k: int = K) -> Column:
    """Keys (length of the reference, segment, text) under which a reference within k edits must be found."""
    n = F.length(text)

    def for_length(d: Column) -> Column:
        m = n + d
        start = _starts(m, k + 1)

        def for_segment(i: Column) -> Column:
            size = (start(i + 1) - start(i)).cast("int")
            at = lambda s: (start(i) + s).cast("int")
            one = lambda s: F.when((at(s) >= 0) & (at(s) + size <= n) & (size > 0), F.struct(m.alias("len"), i.alias("no"), F.substring(text, at(s) + 1, size).alias("text")))
            return F.transform(F.sequence(F.lit(-k), F.lit(k)), one)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), for_segment))

    keys = F.flatten(F.transform(F.sequence(F.lit(-k), F.lit(k)), for_length))
    return F.array_distinct(F.array_compact(keys))


def _near(a: Column, b: Column) -> Column:
    """Edits between a and b: 0, 1, or 2 that swap neighbours; null beyond."""
    d = F.levenshtein(a, b, K)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return F.when(d < 0, None).when((d == 2) & ~((F.length(a) == F.length(b)) & (letters(a) == letters(b))), None).otherwise(d)


def _references(stem: Column) -> Column:
    """What a reference is found by: segments of its stem; of every beginning, for names cut short (`Hrodon.`); of every end after
    the first letter (`D'isewald`); and its leading words (`Brighton` of `Brighton Hove`). array<struct<how, len, no, text, ref>>"""
    n = F.length(stem)
    key = lambda how, ref, k: F.transform(_segments(ref, k), lambda s: F.struct(F.lit(how).alias("how"), F.length(ref).cast("int").alias("len"), s["no"].alias("no"), s["text"].alias("text"), ref.alias("ref")))
    sizes = F.when(n > 3, F.sequence(F.lit(3), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.flatten(F.transform(sizes, lambda m: key("head", F.substring(stem, F.lit(1), m), K_SHORT)))
    tails = F.flatten(F.transform(sizes, lambda m: key("tail", F.substring(stem, -m, m), K_SHORT)))
    words = F.split(stem, " ")
    leading = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " "))).otherwise(F.array().cast("array<string>"))
    leading = F.transform(leading, lambda t: F.struct(F.lit("words").alias("how"), F.length(t).cast("int").alias("len"), F.lit(0).alias("no"), t.alias("text"), t.alias("ref")))
    return F.concat(key("stem", stem, K), heads, tails, leading)


def _sought(n: Column) -> Column:
    """The keys of a typed name: array<struct<how, len, no, text>>."""
    none = F.array().cast("array<struct<how:string,len:int,no:int,text:string>>")
    probes = lambda how, text, k: F.transform(_probes(text, k), lambda s: F.struct(F.lit(how).alias("how"), s["len"].cast("int").alias("len"), s["no"].alias("no"), s["text"].alias("text")))
    head, tail = F.regexp_replace(n["stem"], r"\.$", ""), F.regexp_replace(n["stem"], "^.'", "")
    whole = F.array(F.struct(F.lit("words").alias("how"), F.length(n["stem"]).cast("int").alias("len"), F.lit(0).alias("no"), n["stem"].alias("text")))
    return F.concat(probes("stem", n["stem"], K), whole, F.when(n["kind"] == "head", probes("head", head, K_SHORT)).when(n["kind"] == "tail", probes("tail", tail, K_SHORT)).otherwise(none))


def link(names: DataFrame, roster: DataFrame, vocabulary: Vocabulary = CLUBS) -> DataFrame:
    """(league, written, club_id, edits) for every distinct (league, written); club_id -1 where no entry is meant.

    names: league, written; roster: league, club, club_id (a club may be in several leagues). Character-for-character
    entries are linked as such. Null or empty names and names in leagues without a roster give -1; null leagues are left out.
    Repeated rows count once; other columns are ignored. Two clubs equally near: -1, as neither can be told to be meant.
    vocabulary: what is known about this kind of names beside the roster.
    """
    names = cut_lineage(names.select("league", "written").where("league is not null and written is not null").distinct())
    types = {**dict.fromkeys(vocabulary.types, 1 << 30), **type_words(roster, "club")}
    entries = roster.where("league is not null and club is not null").select(F.col("league").alias("r_league"), "club", "club_id").distinct()
    exact = names.join(entries.groupBy(F.col("r_league").alias("league"), F.col("club").alias("written")).agg(F.min("club_id").alias("club_id")), ["league", "written"]).withColumn("edits", F.lit(0))
    rest = names.join(entries.select(F.col("r_league").alias("league"), F.col("club").alias("written")), ["league", "written"], "left_anti")
    # a fixed number of tasks: the few bytes of a name stand for much work
    rest = rest.repartition(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "written").withColumn("n", parsed(F.col("written"), types, vocabulary))
    # cut here: else the large expression of `n` is planned, printed and run again wherever n is filtered or read
    rest = cut_lineage(rest)
    r = cut_lineage(entries.select("r_league", "club_id", parsed(F.col("club"), types, vocabulary, entry=True).alias("r")))
    # how often a stem occurs in its league: a bare stem means a club only if one club bears it
    r = r.withColumn("same_stem", F.count("*").over(Window.partitionBy("r_league", "r.stem")))
    refs = r.select("r_league", "club_id", F.col("r.types").alias("r_types"), F.col("r.stem").alias("r_stem"), "same_stem", F.inline(_references(F.col("r.stem")))).distinct()
    # a club has hundreds of references, which the planner takes for one row: without the hint it broadcasts them all through the driver
    refs = refs.hint("merge")
    n = F.col("n")
    probe = rest.where("n.kind <> 'none'").select("league", "written", "n", F.inline(_sought(n)))
    probe = probe.withColumnsRenamed({c: f"p_{c}" for c in ("how", "len", "no", "text")})
    pairs = probe.join(refs, (F.col("league") == F.col("r_league")) & (F.col("p_how") == F.col("how")) & (F.col("p_len") == F.col("len")) & (F.col("p_no") == F.col("no")) & (F.col("p_text") == F.col("text")))
    ref = F.col("ref")
    head, tail = F.regexp_replace(n["stem"], r"\.$", ""), F.regexp_replace(n["stem"], "^.'", "")
    one = lambda d: F.when(d == 0, 0).when(d >= 1, d + 1)
    edits = (
        F.when(F.col("how") == "stem", F.when((F.length(ref) >= 4) | (n["stem"] == ref), _near(n["stem"], ref)))
        .when(F.col("how") == "words", 1)
        .when(F.col("how") == "head", one(_near(head, ref)))
        .otherwise(F.when(F.substring(n["stem"], 1, 1) == F.substring("r_stem", 1, 1), one(_near(tail, ref))))
    )
    # which types agree: each written one stands for one of the club's and the other way round, but for words that may be added; or
    # none is written and the stem is borne by one club only
    mine, its = n["types"], F.col("r_types")
    meets = lambda w, x: F.size(F.array_intersect(w["may"], x["may"])) > 0
    covered = F.forall(its, lambda x: F.exists(mine, lambda w: meets(w, x)))
    added = F.size(F.filter(mine, lambda w: ~F.exists(its, lambda x: meets(w, x))))
    agrees = covered & F.forall(mine, lambda w: w["opt"] | F.exists(its, lambda x: meets(w, x)))
    rank = F.when(agrees & (added == 0), 0).when(agrees, 1).when(F.forall(mine, lambda w: w["opt"]) & (F.col("same_stem") == 1), 2)
    # a short form that fits types of two clubs means the one on its side of the stem, then the one that it leaves fewest letters out
    # of, before one that it misspells
    skeleton = lambda w: F.concat(F.array_join(F.split(w["w"], ""), "%"), F.lit("%"))
    far = lambda w, x: F.when(F.array_contains(x["may"], w["w"]), 0).when(F.like(x["may"][0], skeleton(w)), F.length(x["may"][0]) - F.length(w["w"])).otherwise(100)
    loose = F.aggregate(mine, F.lit(0), lambda acc, w: acc + F.coalesce(F.array_min(F.transform(F.filter(its, lambda x: meets(w, x)), lambda x: far(w, x) + F.when(w["first"] == x["first"], 0).otherwise(1000))), F.lit(0)))
    found = pairs.withColumn("edits", edits).withColumn("rank", rank).where("edits is not null and rank is not null")
    found = found.groupBy("league", "written", "club_id").agg(F.min(F.struct("edits", "rank", loose.alias("loose"))).alias("b"))
    found = found.groupBy("league", "written").agg(F.min(F.struct("b", "club_id")).alias("m"), F.min("b").alias("least"), F.collect_list("b").alias("all"))
    found = found.where(F.size(F.filter("all", lambda b: b == F.col("least"))) == 1)
    found = cut_lineage(found.select("league", "written", F.col("m.club_id").alias("club_id"), F.col("least.edits").cast("int").alias("edits")))
    linked = exact.unionByName(found)
    unmatched = names.join(linked, ["league", "written"], "left_anti").select("league", "written", F.lit(-1).cast("long").alias("club_id"), F.lit(None).cast("int").alias("edits"))
    return linked.unionByName(unmatched)
