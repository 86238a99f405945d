import random

from pyspark.sql import functions as F

from tidemark.llm import names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


CLUBS = ["Ravithoshaw Olympic", "Méririvik", "Fenogecourt Racing", "Clunozanez Rovers", "Clunozanez Athletic", "FC Ashemawick", "RC Quinisadosa", "Brückaupamont 04", "Lokomotiv Wilebewald", "Étoile Coreikidale", "Deneisewald Albion", "FC Noru", "RC Noru"]


def link(spark, written, clubs=CLUBS, **kw):
    roster = spark.createDataFrame([("L", c, i, "x") for i, c in enumerate(clubs)], "league string, club string, club_id bigint, written string")
    df = spark.createDataFrame([("L", w, 1) for w in written] + [(None, "x", 1), ("NONE", "Méririvik", 1)], "league string, written string, club_id int")
    out = {r["written"]: r["club_id"] for r in names.link(df, roster, **kw).where("league = 'L'").collect()}
    return {w: (clubs[i] if i >= 0 else None) for w, i in out.items()}


def test_ways_of_writing(spark):
    want = {
        "ravithoshaw olympic": "Ravithoshaw Olympic", "Ravithosahw Oly.": "Ravithoshaw Olympic", "Olympic Ravithoshaw": "Ravithoshaw Olympic", "Ravithoshaw": "Ravithoshaw Olympic", "AC Méririvik": "Méririvik",
        "MÃ©ririvik": "Méririvik", "Mtéririvik": "Méririvik", "Fenogecourt, Racing": "Fenogecourt Racing", "Fenogecourt Racng": "Fenogecourt Racing", "Clunozanez Ath.": "Clunozanez Athletic",
        "C'ozanez Rvrs": "Clunozanez Rovers", "Clunozanez": None, "Clunozanez United": None, "Football Club Ashema.": "FC Ashemawick", "Ashemawick": "FC Ashemawick", "Racing Club Quinis.": "RC Quinisadosa",
        "Brückaupamont '04": "Brückaupamont 04", "Bruckaupamont 2004": "Brückaupamont 04", "Loko Wliebewald": "Lokomotiv Wilebewald", "Et. Corikidale": "Étoile Coreikidale", "D'isewald Alb": "Deneisewald Albion",
        "Deneisewald\xa0Albion": "Deneisewald Albion", "Deneisewald  Albion F.C.": "Deneisewald Albion", "Ravithoshaw Olympic U19": None, "Méririvik II": None, "Clunozanez Rovers Women": None, "Winner QF1": None,
        "???": None, "": None, "To be confirmed": None, "Tolvegethorpe Racing": None, "Racing": None, "R.C. Noru": "RC Noru", "F.C. Noru": "FC Noru", "Noru": None, "x" * 100_000: None,
    }
    assert link(spark, list(want) * 2 + [None]) == want


def test_a_roster_of_other_names(spark):
    """Nothing is known but the list: its shared words, and that words are shortened and misspelled."""
    titles = ["Senior Software Engineer", "Junior Software Engineer", "Software Engineer", "Sales Manager", "Product Manager", "Account Manager", "Data Scientist", "Nurse"]
    want = {
        "senior software enginer": "Senior Software Engineer", "Jnior Software Eng.": "Junior Software Engineer", "Product Mgr": "Product Manager", "Sales Mngr.": "Sales Manager", "acount manager": "Account Manager",
        "DATA  SCIENTIST": "Data Scientist", "Data Scientsit": "Data Scientist", "Nrse": "Nurse", "Nurse": "Nurse", "Pilot": None, "Manager": None, "Regional Manager": None,
    }
    assert link(spark, list(want), titles, vocabulary=names.NOTHING) == want
    clubs = ["Sheffield Wednesday", "Sheffield United", "Brighton & Hove Albion", "Hamburger SV", "Manchester United", "Manchester City", "Wolverhampton Wanderers", "Nottingham Forest", "West Bromwich Albion", "Newcastle United", "Leeds United"]
    want = {"Sheffield Utd": "Sheffield United", "Brighton": "Brighton & Hove Albion", "Man. City": "Manchester City", "Manchester C.": "Manchester City", "Wolverhampton": "Wolverhampton Wanderers", "Leeds": "Leeds United", "Notingham Forest FC": "Nottingham Forest", "West Brom.": "West Bromwich Albion", "Newcastle Utd.": "Newcastle United", "Manchester": None}
    assert link(spark, list(want), clubs) == want


def test_exact_entries_are_themselves(spark):
    assert link(spark, CLUBS) == {c: c for c in CLUBS}


def test_pigeonhole_finds_every_pair_within_two_edits(spark):
    rng = random.Random(2)
    refs = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(60)]
    typed = []
    for r in refs:
        t = list(r)
        for _ in range(2):
            k, op = rng.randrange(len(t) + 1), rng.randrange(3)
            t[k : k + (op != 0)] = [rng.choice("abc")] if op != 1 else []
        typed.append("".join(t) or "a")
    a = spark.createDataFrame([(r,) for r in set(refs)], "ref string").select("ref", F.explode(names._segments(F.col("ref"))).alias("s"))
    b = spark.createDataFrame([(t,) for t in set(typed)], "t string").select("t", F.explode(names._probes(F.col("t"))).alias("p"))
    pairs = b.join(a, (F.col("p.len") == F.length("ref")) & (F.col("p.no") == F.col("s.no")) & (F.col("p.text") == F.col("s.text")))
    got = {(r["t"], r["ref"]) for r in pairs.where(F.levenshtein("t", "ref") <= 2).select("t", "ref").distinct().collect()}
    assert got == {(t, r) for t in set(typed) for r in set(refs) if distance(t, r) <= 2 and len(r) >= 3}


def test_empty(spark):
    roster = spark.createDataFrame([], "league string, club string, club_id bigint")
    df = spark.createDataFrame([("L", "Foo")], "league string, written string")
    assert [tuple(r)[2] for r in names.link(df, roster).collect()] == [-1]
    assert names.link(df.where("false"), roster).count() == 0
