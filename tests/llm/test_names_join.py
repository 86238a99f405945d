"""References of a roster are not sent through the driver, however small the planner takes them for."""

from tidemark.llm import names


def test_references_are_not_broadcast(spark, monkeypatch, tmp_path):
    plans, cut = [], names.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(names, "cut_lineage", seen)
    spark.createDataFrame([("A", "Avonbury Rovers", 1), ("A", "Brindleham Town", 2)], "league string, club string, club_id long").write.parquet(f"{tmp_path}/clubs")
    roster = spark.read.parquet(f"{tmp_path}/clubs")  # the size of a file is known
    written = spark.createDataFrame([("A", "Avonbury Rvrs"), ("A", "Brindelham Town"), ("A", "Brindleham Town"), ("A", "Nobody")], "league string, written string")
    got = {(r["written"], r["club_id"]) for r in names.link(written, roster).collect()}
    assert got == {("Avonbury Rvrs", 1), ("Brindelham Town", 2), ("Brindleham Town", 2), ("Nobody", -1)}
    joins = [line for p in plans for line in p.splitlines() if "Join" in line and "p_text" in line]
    assert joins and not [x for x in joins if "Broadcast" in x]
