"""Storage holdings by normalised names."""

from tidemark import jobs
from tidemark.operators import tracking


def listing(spark, rows):
    return spark.createDataFrame(rows, "file_path string, size long")


def test_names_of_different_listings_meet(spark):
    stores = {
        "b": listing(spark, [("hdfs://h:54310/x/y//f1", 5), ("/x/y/f2", None), (None, 1), ("", 2), ("s3://only-bucket", 3)]),
        "a": listing(spark, [("x/y/f1", 7), ("s3://bucket/x/y/f2", 4), ("/x/y/f2", 4), ("f3", 1)]),
    }
    got = {r["name"]: (r["size"], r["size_differs"], r["held_by"]) for r in tracking.holders(stores, "file_path", "size").collect()}
    assert got == {"x/y/f1": (7, True, "a+b"), "x/y/f2": (4, False, "a+b"), "f3": (1, False, "a")}
    rows = {(r["level"], r["held_by"], r["folder"]): (r["files"], r["bytes"], r["size_differs"]) for r in jobs.storage_holdings(stores).collect()}
    assert rows == {
        (0, "a+b", "x/y"): (2, 11, 1), (0, "a", "f3"): (1, 1, 0),
        (1, "a+b", None): (2, 11, 1), (1, "a", None): (1, 1, 0), (2, None, None): (3, 12, 1),
    }


def test_empty_listings(spark):
    stores = {"a": listing(spark, []), "b": listing(spark, [])}
    assert [tuple(r) for r in jobs.storage_holdings(stores).collect()] in ([], [(None, None, 0, None, 0, 2)])


def test_moves_take_the_last_launch_up_to_the_second(spark):
    at = lambda t: f"/loose/ARC-{t}123-1-2~w~8443.warc.gz"
    launches = ["20240102000000", "20240102120000", "20240102120000", "20240105060000", None]
    want = {
        at("20240101235959"): None, at("20240102000000"): "20240102000000", at("20240102115959"): "20240102000000",
        at("20240102120000"): "20240102120000", at("20240104010101"): "20240102120000", at("20240105055959"): "20240102120000",
        at("20240105060000"): "20240105060000", at("20300101000000"): "20240105060000",
    }
    odd = ["/loose/x.warc.gz", None, at("20241301000000")]
    files = spark.createDataFrame([(p,) for p in [*want, *odd, at("20240102000000")]], "file_path string")
    moves = jobs.archive_moves(files, spark.createDataFrame([(x,) for x in launches], "launch_id string"), "file_path", "j", "/out")
    got = [tuple(r) for r in moves.collect()]
    rows = [
        (p, x and f"/out/j/{x}/warcs/{p.rsplit('/', 1)[1]}", None if x else "before the first launch")
        for p, x in [*want.items(), (at("20240102000000"), "20240102000000")]
    ] + [(p, None, "no time in the name") for p in odd]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_moves_neither_sort_nor_shuffle_files(spark):
    """Only days and launches are ordered: no window, sort or exchange reads paths."""
    files = spark.range(10).selectExpr("concat('/loose/ARC-20240101000000123-', id, '-2~w~8443.warc.gz') AS file_path")
    launches = spark.createDataFrame([("20240101000000",)], "launch_id string")
    moves = jobs.archive_moves(files, launches, "file_path", "j", "/out")
    plan = moves._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if ("Exchange" in x or "Sort " in x or "Window" in x) and "file_path" in x]
    assert all("/loose" not in x for x in plan.splitlines() if "Window" in x) and "BroadcastHashJoin" in plan.split("LocalTable")[0].split("Window")[0]
    assert moves.where("target_path like '%/20240101000000/%'").count() == 10
