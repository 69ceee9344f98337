"""Readers, writers, resolution and streams."""

import pytest
from pyspark.sql import functions as F

from tallyspark.session import materialise, shared_folder
from tallyspark.sources import readers, resolve, writers
from tallyspark.streaming import jobs


def write_text(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_register_last_row_wins(spark, tmp_path):
    path = write_text(tmp_path, "r.csv", "Check No,Payee,Category,Memo\n001836,Old,,\n1836,Victor Patri,Labor Expense,4 Days\n,Nobody,,\n")
    rows = readers.read_register(spark, path).collect()
    assert [(r.check_number, r.payee_name, r.category, r.memo) for r in rows] == [("1836", "Victor Patri", "Labor Expense", "4 Days")]


def test_register_without_payee_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_register(spark, write_text(tmp_path, "r.csv", "Check No,Memo\n1,x\n"))


def test_encoding_falls_back(spark, tmp_path):
    content = "Date,Memo,Amount\n2024-01-05,Café,5\n"
    assert readers.pick_encoding(spark, write_text(tmp_path, "u.csv", content)) == "UTF-8"
    path = write_text(tmp_path, "l.csv", content, "latin-1")
    assert readers.pick_encoding(spark, path) == "ISO-8859-1"
    assert readers.read_ledger(spark, path).first().memo == "Café"


def test_quoted_cells_survive(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 'say "x"', None)], "x string, y string, z string")
    path = str(tmp_path / "q")
    writers.write_csv(df, path)
    back = readers.read_delimited(spark, path).select("x", "y", "z").first()
    assert tuple(back) == ("a, b", 'say "x"', None)


def test_bank_from_file_name(spark, tmp_path):
    path = write_text(tmp_path, "Chase_2024.csv", "Posting Date,Description,Type,Amount\n01/05/2024,Deposit,13000 CHECK_DEPOSIT,\n01/06/2024,Fee,,-4.50\n,No date,,1\n")
    rows = {r.description: r for r in readers.read_bank_csv(spark, path).collect()}
    assert set(rows) == {"Deposit", "Fee"} and rows["Deposit"].bank == "Chase Bank"
    assert float(rows["Deposit"].credit) == 13000 and float(rows["Fee"].debit) == 4.5


@pytest.mark.parametrize(
    "columns, want",
    [
        (["Date", "Account Name", "Memo", "Split", "Debit", "Credit"], {"date": "Date", "name": "Account Name", "memo": "Memo", "split": "Account Name", "debit": "Debit", "credit": "Credit"}),
        (["Unnamed: 0", "Txn dt", "Desc", "Amt"], {"date": "Txn dt", "name": None, "memo": "Desc", "split": None, "amount": "Amt"}),
    ],
)
def test_ledger_headers(columns, want):
    found = resolve.ledger_columns(columns)
    assert {k: found[k] for k in want} == want


def test_posting_date_comes_first():
    assert resolve.bank_columns(["Transaction Date", "Posting Date", "Description"])["date"] == "Posting Date"


def test_pick_column_prefers_exact():
    assert resolve.pick_column(["Account Name", "Account"], ["account"]) == "Account"
    assert resolve.pick_column(["My Deposit"], ["credit", "deposit"]) == "My Deposit"


def test_category_files_keep_all_columns(spark, inputs, tmp_path):
    from tallyspark import constants as K
    from tallyspark.operators import cascade

    rows = cascade.categorise(inputs.bank_txn, inputs.rules, inputs.check_register)
    path = str(tmp_path / "out")
    writers.write_categorized_csv(writers.categorized_csv_rows(rows), path)
    back = readers.read_delimited(spark, path)
    assert set(K.CATEGORIZED_CSV_COLUMNS) <= set(back.columns) and back.count() == inputs.bank_txn.count()


def test_materialise_uses_the_shared_folder(spark):
    df = materialise(spark.range(5).withColumn("x", F.col("id") * 2), "test")
    assert df.count() == 5
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert shared_folder(spark, "p").startswith(base.rstrip("/"))


def test_stream_batches_carry_number_and_progress(spark):
    out = jobs.categorise_stream(
        jobs.table_stream(spark, "/root/testdata/sf0.001", "events"), spark, lambda b: b.select("event_id", "event_type"), F.col("event_type") == "click"
    )
    p = jobs.progress(out).collect()
    assert sum(r.n for r in p) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert p[-1].running_matched == sum(r.matched for r in p)


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Date,Description,Amount\n2024-01-05,"A\nB, C",5.00\n2024-01-06,"say ""x""\r\ny",-6.00\n')
    rows = readers.read_delimited(spark, str(tmp_path)).orderBy("row_pos").collect()
    assert [r["Description"] for r in rows] == ["A\nB, C", 'say "x"\ny'] or [r["Description"] for r in rows] == ["A\nB, C", 'say "x"\r\ny']
    assert [r["Amount"] for r in rows] == ["5.00", "-6.00"]


def test_later_file_wins_whatever_its_size(spark, tmp_path):
    head = "Check Number,Payee Name\n"
    (tmp_path / "a1.csv").write_text(head + "7,old\n8,first\n")
    (tmp_path / "b2.csv").write_text(head + "7,new\n" + "".join(f"{n},filler payee {n}\n" for n in range(100, 400)))
    (tmp_path / "c3.csv").write_text(head + "8,last\n")
    rows = readers.read_check_payees(spark, str(tmp_path)).collect()
    got = {r["check_number"]: r["payee_name"] for r in rows}
    assert got["7"] == "new" and got["8"] == "last"


def test_lines_in_another_encoding(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("café\n".encode("utf-8") + "café\r\n".encode("latin-1") + b"plain\n")
    assert [r["value"] for r in readers.read_text(spark, str(tmp_path)).collect()] == ["café", "café", "plain"]


def test_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    stream = jobs.split_stream(spark.range(300).withColumnRenamed("id", "k"), "k", 3)
    tried = []

    def write(batch, number, path, fail):
        tried.append(number)
        if fail and number == 1:
            raise RuntimeError("lost")
        writers.write_batch(batch, number, path)

    path = str(tmp_path / "out")
    with pytest.raises(Exception):
        jobs.run_batches(stream, spark, lambda b, n, p: write(b, n, p, True), "t", path)
    assert tried == [0, 1]
    jobs.run_batches(stream, spark, lambda b, n, p: write(b, n, p, False), "t", path)
    assert tried == [0, 1, 1, 2]
    rows = spark.read.parquet(path)
    assert rows.count() == 300 and rows.select("k").distinct().count() == 300


HEADERS = [("Date,Description,Debit,Credit", "2024-05-01,SALARY,,100.00"), ("Description,Date,Credit,Debit", "RENT,2024-05-02,,70.00"), ("Remark,Credit,Debit,Date,Description", "x,,5.00,2024-05-03,FEE")]


def test_each_file_has_its_own_header(spark, tmp_path):
    for k, (head, row) in enumerate(HEADERS):
        (tmp_path / f"{'abc'[k]} {{{k}}} 50%.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "empty.csv").write_text("")
    rows = sorted((r["date"], r["description"], str(r["credit"]), str(r["debit"])) for r in readers.read_tabular(spark, f"{tmp_path}/*.csv").collect())
    assert rows == [("2024-05-01", "SALARY", "100.00", "None"), ("2024-05-02", "RENT", "None", "70.00"), ("2024-05-03", "FEE", "None", "5.00")]
    apart = [readers.read_tabular(spark, f"{tmp_path}/{name}*.csv").drop("row_pos") for name in "abc"]
    assert sorted((r["date"], r["description"], str(r["credit"]), str(r["debit"])) for part in apart for r in part.collect()) == rows
    whole = readers.read_delimited(spark, str(tmp_path))
    assert set(whole.columns) == {"Date", "Description", "Debit", "Credit", "Remark", "file_name", "row_pos"} and whole.count() == 3


def test_file_without_a_needed_column_is_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount\n2024-05-01,x,1\n")
    (tmp_path / "bad one.csv").write_text("Date,Amount\n2024-05-01,1\n")
    with pytest.raises(ValueError, match="bad one.csv.*description"):
        readers.read_bank_csv(spark, str(tmp_path))
    (tmp_path / "bad one.csv").write_text("Check No,Memo\n1,x\n")
    (tmp_path / "a.csv").write_text("Check No,Payee\n1,x\n")
    with pytest.raises(ValueError, match="bad one.csv.*payee"):
        readers.read_register(spark, str(tmp_path))


def test_each_ledger_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Date,Memo,Amount\n2024-01-05,Café,5\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("Memo,Date,Amount\nCrème,2024-01-06,6\n".encode("utf-8"))
    assert {r["memo"] for r in readers.read_ledger(spark, str(tmp_path)).collect()} == {"Café", "Crème"}


def test_rules_with_nested_objects(spark):
    from tallyspark.operators import rulebase

    rule = '{"rule_id":"%s","account_name":"x","trigger_payee_contains":["T"]%s}'
    nested = ',"meta":{"k":{"deep":[1,2]}}'
    replies = [
        (1, "```json\n[" + rule % ("a", nested) + "," + rule % ("b", "") + "]\n```"), (2, "[" + rule % ("c", ',"m":{"k":"}"}') + ", " + rule % ("d", "") + ', {"rule_id": "cut'),
        (3, "nothing"), (4, None), (5, '[{"rule_id":"e"}, 7, ' + rule % ("f", "") + "]"), (6, rule % ("g", "")),
    ]
    rows = rulebase.rules_from_replies(spark.createDataFrame(replies, "n int, reply string")).collect()
    assert sorted((r["n"], r["reply_pos"], r["rule_id"]) for r in rows) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d"), (5, 1, "f"), (6, 0, "g")]
    assert all(r["trigger_payee_contains"] == ["T"] for r in rows)


def test_name_search_never_answers_with_the_own_row(spark):
    import datetime as dt

    from tallyspark.operators import neighbours

    day = dt.date(2024, 1, 1)
    vector = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.95, 0.05]]
    history = spark.createDataFrame([(1, k + 1, vector[k], n, c, day + dt.timedelta(d)) for k, (n, c, d) in enumerate([("Acme", "new", 9), ("acme ", "old", 1), ("Lone", "own", 5), ("Other", "near", 3)])],
                                    "client_id int, vec_id long, embedding array<double>, name string, category string, date date")
    queries = spark.createDataFrame([(1, 1, "ACME", vector[0]), (1, 2, "acme", vector[1]), (1, 3, "Lone", vector[0])], "client_id int, txn_id long, search string, name_embedding array<double>")
    got = {r["query_id"]: (r["match_type"], r["category"]) for r in neighbours.name_search(queries, history, "search", 3, exclude_self=True).collect()}
    assert got == {1: ("exact", "old"), 2: ("exact", "new"), 3: ("similar", "new")}
    assert {r["query_id"]: r["category"] for r in neighbours.name_search(queries, history, "search", 3).collect()} == {1: "new", 2: "new", 3: "own"}


@pytest.mark.parametrize("files", [0, 3])
def test_stream_over_a_table_of_one_file_or_of_many(spark, tmp_path, files):
    rows = spark.range(40).withColumnRenamed("id", "vec_id")
    target = str(tmp_path / "embeddings.parquet")
    if files:
        rows.repartition(files).write.parquet(target)
    else:
        rows.toPandas().to_parquet(target)
    spark.range(7).write.parquet(str(tmp_path / "events.parquet"))
    got = jobs.batch_sink(jobs.table_stream(spark, str(tmp_path), "embeddings"), spark)
    assert sorted(r["vec_id"] for r in got.collect()) == list(range(40))
