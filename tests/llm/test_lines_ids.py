"""Similar lines with the same id and line number: the one of the earlier row stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.llm import lines


def test_similar_lines_under_one_id(spark):
    rows = [(k // 2, " ".join(f"t{k // 2}x{i}" for i in range(30)) + f" own{k}", k) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(6)
    got = {r["row"]: r["removed"] for r in lines.later_lines(docs, row_col="row").collect()}
    assert got == {k: k % 2 == 1 for k in range(80)}


def test_columns_of_any_name_come_back(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{line}\nshort", 7, "g", "r", 5), (2, f"{line} more\nÉTÉ là", 8, "g", "r", 6), (2, "été LÀ", 9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls long, gone string, row string, levels long")
    got = {r["cls"]: r for r in lines.without_later_lines(docs).collect()}
    assert lines.without_later_lines(docs).columns == docs.columns
    assert [got[k]["text"] for k in (7, 8, 9)] == [f"{line}\nshort", "", "été LÀ"]
    assert [got[k]["levels"] for k in (7, 8, 9)] == [5, 6, None]


def test_sketch_is_no_column(spark):
    """The sketch of a megabyte stays an argument: no select and no aggregate has it as a column, which each row would get a copy of."""
    rows = spark.createDataFrame([(k % 50, f"a b{k % 50} c c d{k % 7}") for k in range(200)], "k long, line string")
    levels = lines.rarity_levels(rows.select(F.col("line").alias("text")))
    sets = lines.by_rarity(rows.groupBy("k").agg(F.any_value("line").alias("line")), "line", levels, "ids").withColumn("own", lines.own_hashes(F.col("ids")))
    got = sets.select("k", F.size("ids").alias("n"), lines.signatures(F.col("own")).alias("signs"), (F.col("own") == lines.token_hashes(F.col("line"))).alias("same"), lines.parity(F.col("ids"), 6).alias("even"))
    assert "AS levels" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["n"], r["same"]) for r in got.collect()} == {(4, True)} and got.count() == 50


def test_equal_sets_and_odd_white_space(spark):
    rows = [(1, "a\tb  c\x0bd\n \t\r\f"), (2, "d c b a a\r\n\n\t"), (3, "\fA B C D \né x y"), (4, "É X Y\nx y"), (5, None)]
    got = lines.later_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]): r["removed"] for r in got} == {(1, 0): False, (1, 1): False, (2, 0): True, (2, 1): False, (2, 2): False, (3, 0): True, (3, 1): False, (4, 0): True, (4, 1): False}


def test_copies_make_no_postings(spark, monkeypatch):
    """Tokens are counted among classes: those of one line's copies are in one class alone and not posted. The sketch is no column here either."""
    made = {}

    def bucketed(df, name, *args, **options):
        made[name] = df._jdf.queryExecution().optimizedPlan().toString(), real(df, name, *args, **options)
        return made[name][1]

    real = lines.bucketed
    monkeypatch.setattr(lines, "bucketed", bucketed)
    docs = spark.createDataFrame([(k, "one\ttwo three  four\nmore " + " ".join(f"t{k % 3}x{i}" for i in range(9))) for k in range(30)], "doc_id long, text string")
    assert lines.later_lines(docs).where("removed").count() == 29 + 27
    plan, postings = made["line-postings"]
    assert "AS levels" not in plan
    assert postings.count() == 4 and postings.agg(F.sum(F.size("shared"))).first()[0] == 0  # "more", the only shared token, is no rare one


def test_lines_split_at_one_sign(spark):
    """Patterns are dear: tokens are split at a blank, in lines whose white space is blanks alone."""
    got = spark.createDataFrame([("A\tb\x0bc\r\nD e\f",)], "t string").select(lines._lines(F.col("t")).alias("x")).first()["x"]
    assert got == ["a b c ", "d e "]
