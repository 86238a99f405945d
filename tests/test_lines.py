from tidemark.operators import lines

HEAD = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,Referee"
SCHEMA = "source_file string, line_no int, raw_line string, valid string, Date string, note string"


def run(spark, rows):
    df = spark.createDataFrame([(f, n, t, "old", "old", "kept") for f, n, t in rows], SCHEMA)
    out = lines.parse(df).collect()
    assert all(r["note"] == "kept" for r in out)
    return {(r["source_file"], r["line_no"]): r for r in out}


def test_valid_and_reasons(spark):
    cases = {
        2: ("A,1/2/24,Foo,Bar,1,2,x", None),
        3: ('"A",29/02/2024," Foo ","B ""x"" ar",3.0, 0 ,', None),
        4: ("A,2024-02-29,Foo,Bar,30,0,", None),
        5: ("A,2023-02-29,Foo,Bar,1,0,", "not_an_existing_day"),
        6: ("A,31/04/24,Foo,Bar,1,0,", "not_an_existing_day"),
        7: ("A,29/02/1900,Foo,Bar,1,0,", "not_an_existing_day"),
        8: ("A,01/02/24,Foo,Bar,31,0,", "not_a_whole_number_0_to_30"),
        9: ("A,01/02/24,Foo,Bar,1,0.5,", "not_a_whole_number_0_to_30"),
        10: ("A,01/02/24,-,Bar,1,0,", "no_letter"),
        11: ("A,01/02/24,Foo,Bar,1", "too_few_fields"),
        12: ("A,01/02/24,Foo,Bar,1,0,x,y", "too_many_fields"),
        13: ('A,01/02/24,"Foo,Bar,1,0,x', "broken_quoting"),
        14: ('A,01/02/24,"Fo"o",Bar,1,0,x', "broken_quoting"),
        15: ("", "empty_line"),
        16: (None, "empty_line"),
        17: (HEAD, "not_an_existing_day"),
        18: ("A,01/02/24,Foo,Bar,1,0," + "x" * 300_000, None),
        19: ('A,01/02/24,Foo,Bar,1,0,"' + "x," * 100_000, "broken_quoting"),
        20: ('A,01/02/24,"Foo, FC",Bar,1,0,x', None),
        21: ("A,01/02/24,Foo,Bar,-1,0,x", "not_a_whole_number_0_to_30"),
    }
    out = run(spark, [("f", 1, HEAD)] + [("f", n, t) for n, (t, _) in cases.items()])
    assert len(out) == len(cases)
    for n, (_, reason) in cases.items():
        r = out["f", n]
        assert r["reason"] == reason and r["valid"] == (reason is None), (n, r["reason"], r["broken_field"])
    assert str(out["f", 3]["Date"]) == "2024-02-29" and out["f", 3]["HomeTeam"] == "Foo" and out["f", 3]["AwayTeam"] == 'B "x" ar' and out["f", 3]["FTHG"] == 3
    assert out["f", 2]["FTAG"] == 2 and str(out["f", 2]["Date"]) == "2024-02-01"
    assert out["f", 8]["broken_field"] == "FTHG" and out["f", 8]["field_no"] == 5


def test_headers_differ(spark):
    out = run(spark, [("s", 1, "Date;FTAG;FTHG;AwayTeam;HomeTeam"), ("s", 2, "1/2/24;1;2;Foo, x;Bar"), ("n", 2, "1/2/24"), ("m", 1, "Date,HomeTeam"), ("m", 2, "1/2/24,Foo"), ("s", 2, "1/2/24;1;2;Foo, x;Bar")])
    assert out["s", 2]["valid"] and out["s", 2]["AwayTeam"] == "Foo, x" and out["s", 2]["FTHG"] == 2
    assert out["n", 2]["reason"] == "unusable_header" and out["m", 2]["reason"] == "unusable_header"


def test_empty(spark):
    assert lines.parse(spark.createDataFrame([], SCHEMA)).count() == 0
