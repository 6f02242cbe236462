"""Matching, repair and reports on hand-made frames and on the fixtures."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rolltrace.functions.text import jaro_winkler, java_pattern
from rolltrace.operators import adjust, changes, linkage
from rolltrace.operators.clean import clean_contact, clean_vars
from rolltrace.operators.evaluate import compare
from rolltrace.operators.match import ConservationError, Match, assert_inter, exact_match, id_match, random_sample
from rolltrace.plans import audit, fixtures
from rolltrace.sources.catalog import date_spine, interval, snapshot_list
from rolltrace.sources.snapshots import clean_snapshot, snapshot_import

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="id string, v string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs_of(spark, found):
    if not found:
        return audit.no_pairs(frame(spark, []), frame(spark, []))
    return spark.createDataFrame(found, "a struct<id:string,v:string>, b struct<id:string,v:string>")


def made(spark, pairs, only_a=(), only_b=()):
    empty = frame(spark, [])
    return Match(empty, pairs_of(spark, []), pairs_of(spark, pairs), frame(spark, list(only_a)), frame(spark, list(only_b)))


def test_nulls_match_nulls(spark):
    inter = exact_match(frame(spark, [("1", None), (None, "x")]), frame(spark, [("1", None), (None, "y")]))
    assert rows(inter.exact) == [("1", None)]
    done = id_match(inter, ["id"])
    assert rows(done.id_pairs) == [((None, "x"), (None, "y"))]
    assert id_match(inter, ["id"], null_ids_match=False).id_pairs.count() == 0
    assert exact_match(inter.exact, inter.exact, False).mismatch_a.count() == 1


def test_duplicates_break_conservation(spark):
    a, b = frame(spark, [("1", "r"), ("1", "r")]), frame(spark, [("1", "r")])
    inter = exact_match(a, b)
    assert inter.exact.count() == 2
    with pytest.raises(ConservationError):
        assert_inter(inter, a, b)


def test_ids_in_turn(spark):
    s = "id string, k string, v int"
    a, b = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], s), spark.createDataFrame([("1", "q", 2), ("9", "y", 2)], s)
    done = id_match(exact_match(a, b), ["id", "k"])
    assert done.id_pairs.count() == 2 and done.mismatch_a.count() == 0 and done.mismatch_b.count() == 0


def test_conservation_on_random_changes(spark):
    rng = random.Random(1)
    for _ in range(2):
        a = [(str(i), rng.choice("xyz")) for i in range(60)]
        b = [(i, rng.choice("xyz")) if rng.random() < 0.3 else (i, v) for i, v in a if rng.random() < 0.9] + [(str(100 + k), "n") for k in range(5)]
        fa, fb = frame(spark, a), frame(spark, b)
        n = assert_inter(id_match(exact_match(fa, fb), ["id"]), fa, fb)
        assert n["exact"] == len(set(a) & set(b))


def test_report_and_null_changes(spark):
    m = made(spark, [(("1", None), ("1", None)), (("2", "a"), ("2", None)), (("3", "a"), ("3", "a"))], [("8", "z")])
    got = {r["labels"]: r for r in changes.changes_report(m, ["v"]).collect()}
    assert (got["v"]["change_n"], got["Changed"]["change_n"], got["Dropped"]["change_n"], got["v"]["totalA"], got["v"]["totalB"]) == (2, 3, 1, 4, 3)
    assert {r["change_kind"] for r in changes.changes_extract(m, ["v"]).collect()} == {"both_null", "to_null"}
    assert changes.changes_extract(m, ["v"], null_changes="strict").count() == 1
    assert changes.changes_report(made(spark, []), None).first()["change_prop"] is None
    with pytest.raises(ValueError):
        changes.changes_extract(m, ["nrow"])


def test_duplicate_ties_are_broken(spark):
    m = made(spark, [(("a1", "p"), ("a1", "q")), (("a2", "p"), ("a1", "q")), (("a3", "p"), ("a4", "q"))])
    done = adjust.adjust_dups(m, ["id"])
    assert rows(done.changed) == [(("a1", "p"), ("a1", "q")), (("a3", "p"), ("a4", "q"))] and rows(done.only_a) == [("a2", "p")] and done.only_b.count() == 0
    literal = adjust.adjust_dups(m, ["id"], "literal")
    assert rows(literal.changed) == [(("a1", "p"), ("a1", "q"))]


def test_false_negatives_and_wrong_pairs(spark):
    m = made(spark, [(("a1", "p"), ("a3", "q")), (("a4", "p"), ("a1", "q"))], [("a7", "p")], [("a7", "q")])
    done = adjust.adjust_fn(m, ["id"])
    got = {(x[0], y[0]) for x, y in done.changed.collect()}
    assert ("a1", "a1") in got and ("a7", "a7") in got and done.only_a.count() == 0


def test_linkage_finds_the_true_links(spark):
    a, b = fixtures.snapshots(spark, SF, added=False)
    i = id_match(exact_match(a, b), ["voter_id"])
    for block in (None, [["dob_days"], ["city"]]):
        links, fit = linkage.link(i.mismatch_a, i.mismatch_b, ["full_name", "city", "dob_days"], ["full_name", "city"], block=block, key="voter_id")
        got = {(r["_rid_a"], r["_rid_b"]) for r in links.collect()}
        assert got == {(v, v + 1000000) for v in range(1, 151) if v % 20 == 5} and fit.iterations > 1
    with pytest.raises(ValueError):
        linkage.candidates(a, b, None, max_pairs=10)
    with pytest.raises(ValueError):
        linkage.roles(["x"], ["y"])


def test_scalars(spark):
    assert abs(jaro_winkler("martha", "marhta") - 0.9611111) < 1e-6 and jaro_winkler("", "a") == 0 and jaro_winkler(None, "a") is None
    assert java_pattern("%m%d%y") == "MMddyy" and java_pattern("%Y-%b") == "yyyy-MMM"
    df = spark.createDataFrame([("ABC@Example.com", "( __)___-____"), ("José@x.org", "(999)999-9999"), ("a@b", "000"), ("a@c", "(714)___-____"), (None, "")], "e string, p string")
    assert [tuple(r) for r in clean_contact(df, "e", phone="p").collect()] == [(None, None), ("jose@x.org", None), ("a@b", None), ("a@c", None), (None, "")]
    c = clean_vars(spark.createDataFrame([(" José  ann", "Mrs.", None, "4/26/2018", "7x")], "f string, t string, g string, d string, n string"), None, ["d"], "mdy", ["n"], "f", "t", "g").first()
    assert (c["f"], c["t"], c["g"], str(c["d"]), c["n"]) == ("JOSE ANN", "MRS", "F", "2018-04-26", None)


def test_catalogue_and_import(spark, tmp_path):
    for name in ("Cntywd_042618.txt", "Cntywd_042818.txt", "Cntywd_Hist_042718.txt"):
        (tmp_path / name).write_bytes('id\tname\n1\tJos\xe9 \n2\t"x\n3\n'.encode("latin-1"))
    got = snapshot_list(spark, "2018-04-25", "2018-04-30", str(tmp_path)).collect()
    assert [r["date_label"] for r in got] == ["042618", "042818"] and got[0]["weekday"] == "Thu"
    df = snapshot_import(spark, str(tmp_path), "Cntywd_", "042618")
    assert rows(df) == [("1", "José"), ("2", '"x'), ("3", None)]
    assert set(snapshot_import(spark, str(tmp_path), "Cntywd_", ["042618", "042818"])) == {"dfA", "dfB"}
    for bad in ({"units": "Cntywd"}, {"units": "999999"}, {"units": []}, {"units": "042618", "file_type": ".dat"}, {"units": [str(i) for i in range(27)]}):
        with pytest.raises(ValueError):
            snapshot_import(spark, str(tmp_path), "", **bad)
    assert interval("2 weeks") == "INTERVAL 2 WEEK" and date_spine(spark, "2018-01-31", "2018-04-30", "month").count() == 4


def test_samples_are_exact_and_repeatable(spark):
    a, b = fixtures.snapshots(spark, SF)
    i = id_match(exact_match(a, b), ["voter_id"])
    x, y = random_sample(i, sample_exact=True, sample_id=True, varnames_id=["voter_id"], sample_perc=0.1)
    assert x.count() == round(0.1 * (94 + 40)) and rows(x) == rows(random_sample(i, True, True, True, ["voter_id"], sample_perc=0.1)[0]) and rows(x) != rows(y)
    assert random_sample(i)[0].count() == 0


def test_the_whole_audit(spark, tmp_path):
    a, b = fixtures.snapshots(spark, SF, added=False)
    for label, df in (("d1", a), ("d2", b), ("d3", fixtures.third(spark, b))):
        df.write.parquet(f"{tmp_path}/clean/df_cleaned_{label}.parquet")
    days = spark.createDataFrame([("2024-01-0%d" % k, f"d{k}") for k in (1, 2, 3)], "date string, date_label string")
    paths = {f"path_{k}": f"{tmp_path}/{k}" for k in ("clean", "changes", "reports", "matches")}
    options = {"varnames": ["full_name", "city", "dob_days"], "varnames_str": ["full_name", "city"], "varnames_id": ["voter_id"], "vars_change": ["phone"]}
    report = audit.vrmatch(days, **options, **paths, sample_exact=True).collect()
    first = {r["labels"]: r["change_n"] for r in report if r["date_origin"] == "d2"}
    # 17 among the id matches, and linked voter 85, whose phone is null on both sides
    assert first == {"Exact Matches": 94, "Changed": 48, "Dropped": 8, "Added": 0, "phone": 18}
    assert sorted(map(tuple, audit.vrmatch(days, **options, **paths, exist_files=True).collect())) == sorted(map(tuple, report))
    assert audit.performance(days, f"{tmp_path}/matches", ids=["dob_days"]).filter("date_origin = 'd2'").first()["f1"] == 1.0
    again = audit.adjust_vrmatch(days, ["dob_days"], ["dob_days"], ["phone"], **paths, adj_suffix="x").collect()
    assert {r["labels"]: r["change_n"] for r in again if r["date_origin"] == "d2"} == first
    with pytest.raises(ValueError):
        audit.vrmatch(days.limit(1), **options, **paths)


def test_comparison_of_a_match_with_itself(spark):
    m = made(spark, [(("1", "a"), ("2", "b")), (("3", "a"), ("3", "b"))])
    got = compare(m, m, id="id")
    assert got["setdiff_1"].count() == 0 and got["common"].count() == 1 and got["union"].count() == 2


def test_clean_snapshots(spark, tmp_path):
    (tmp_path / "Cntywd_042618.txt").write_text("szNameFirst\tsVoterTitle\tsGender\tszEmailAddress\tszPhone\nann\tMs\t\tabc@example.com\t000\n")
    done = clean_snapshot(spark, start="2018-04-26", end="2018-04-27", path=str(tmp_path), path_clean=f"{tmp_path}/clean")
    r = spark.read.parquet(*done).first()
    assert (r["szNameFirst"], r["sGender"], r["szEmailAddress"], r["szPhone"]) == ("ANN", "F", None, None)
    with pytest.raises(ValueError):
        clean_snapshot(spark, start="2018-04-26", end="2018-04-27", path=str(tmp_path), path_clean=f"{tmp_path}/clean", email="nope")


def test_arrivals(spark, tmp_path):
    from rolltrace.streaming.arrivals import watch

    for k, rows_ in enumerate(([("1", "a"), ("2", "b")], [("1", "a"), ("2", "c")])):
        frame(spark, rows_).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        watch(spark, f"{tmp_path}/in", "id string, v string", f"{tmp_path}/state", f"{tmp_path}/reports", ["id"], ["v"], f"{tmp_path}/cp").awaitTermination(60)
    got = {r["labels"]: r["change_n"] for r in spark.read.parquet(f"{tmp_path}/reports").collect()}
    assert got["Exact Matches"] == 1 and got["v"] == 1


def test_entry(spark):
    assert entry.entry(spark).filter(F.col("labels") == "Exact Matches").first()["change_n"] == 94
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_columns_with_inner_names(spark):
    names = "side in_a in_b copy _a _ka _kb _c k n a b kind sides o0 mark bucket _k _n _r _rid id".split()
    df = spark.createDataFrame([tuple(str(i + j) for j in range(len(names))) for i in range(5)], ", ".join(f"`{c}` string" for c in names))
    inter = exact_match(df, df)
    assert inter.exact.count() == 5 and inter.mismatch_a.count() == inter.mismatch_b.count() == 0 and inter.exact.columns == names
    changed = df.withColumn("side", F.lit("new"))
    done = id_match(exact_match(df, changed), ["id"])
    assert done.id_pairs.count() == 5 and done.mismatch_a.count() == 0 and done.id_match_a.columns == names
    assert random_sample(inter, sample_exact=True, sample_perc=0.4)[0].columns == names


def test_unbalanced_ids_raise_or_stay(spark):
    a, b = frame(spark, [("1", "p"), ("1", "q"), (None, "x"), ("7", "y")]), frame(spark, [("1", "r"), (None, "z"), (None, "zz")])
    with pytest.raises(ConservationError):
        id_match(exact_match(a, b), ["id"])
    done = id_match(exact_match(a, b), ["id"], on_unbalanced="demote")
    assert rows(done.id_pairs) == [(("1", "p"), ("1", "r")), ((None, "x"), (None, "z"))]
    assert rows(done.mismatch_a) == [("1", "q"), ("7", "y")] and rows(done.mismatch_b) == [(None, "zz")]
    assert_inter(done, a, b)
    apart = id_match(exact_match(a, b), ["id"], null_ids_match=False, on_unbalanced="demote")
    assert apart.id_pairs.count() == 1 and apart.mismatch_b.count() == 2


def test_unbalanced_ids_all_pair(spark):
    s = "id string, k string, v string"
    a = spark.createDataFrame([("1", "x", "p"), ("2", "y", "p"), (None, "w", "p"), ("7", "u", "p")], s)
    b = spark.createDataFrame([("1", "x", "q"), ("1", "z", "q"), ("9", "y", "q"), (None, "o", "q"), (None, "w", "r")], s)
    done = id_match(exact_match(a, b), ["id", "k"], on_unbalanced="all")
    assert sorted((r["a"]["k"], r["b"]["k"]) for r in done.id_pairs.collect()) == [("w", "o"), ("w", "w"), ("x", "x"), ("x", "z"), ("y", "y")]
    assert rows(done.mismatch_a) == [("7", "u", "p")] and done.mismatch_b.count() == 0
    apart = id_match(exact_match(a, b), ["id"], null_ids_match=False, on_unbalanced="all")
    assert apart.id_pairs.count() == 2 and apart.mismatch_a.count() == 3 and apart.mismatch_b.count() == 3


def test_two_ids_where_a_suppliers_number_is_a_customers(spark, tmp_path):
    import duckdb

    for name, cut in (("customer", "c_custkey + 810000 AS c_custkey"), ("part", "p_partkey + 810000 AS p_partkey"), ("supplier", "s_suppkey + 10000 AS s_suppkey"), ("nation", "n_nationkey")):
        duckdb.sql(f"COPY (SELECT * REPLACE ({cut if ' AS ' in cut else cut + ' AS ' + cut}) FROM '{SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    con = duckdb.connect()
    for name in ("customer", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(entry.oracle_sql()["id_match_two_ids"]).fetchall()
    assert len(want) > len({x for x, _ in want}) and rows(entry.queries()["id_match_two_ids"](spark, str(tmp_path))) == sorted(want, key=repr)


def test_a_row_of_a_is_in_one_pair(spark):
    s = "a struct<id:string,v:string>, b struct<id:string,v:string>, posterior double, _rid_a long, _rid_b long"
    links = spark.createDataFrame([(("1", "x"), ("2", "y"), 0.9, 1, 11), (("1", "x"), ("3", "z"), 0.9, 1, 12), (("4", "x"), ("2", "y"), 0.9, 2, 11), (("5", "x"), ("2", "y"), 0.8, 3, 11)], s)
    got = [(r["_rid_a"], r["_rid_b"]) for r in linkage.one_to_one(links).collect()]
    assert sorted(got) == [(1, 11), (2, 11)]


def test_rows_that_tie_for_the_same_rows_take_them_in_turn(spark):
    s = "a struct<id:string,v:string>, b struct<id:string,v:string>, posterior double, _rid_a long, _rid_b long"
    links = spark.createDataFrame([((str(i), "x"), (str(j), "y"), 0.9, 9 - i, 19 - j) for i in range(3) for j in range(4)], s)
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in linkage.one_to_one(links).collect()) == [("0", "0"), ("1", "1"), ("2", "2")]


def test_pairs_outside_the_blocks_count_as_non_matches(spark):
    i = id_match(exact_match(*fixtures.snapshots(spark, "/root/testdata/sf0.1")), ["voter_id"])
    links, _ = linkage.link(i.mismatch_a, i.mismatch_b, ["full_name", "city", "dob_days"], ["full_name", "city"], block=[["dob_days"], ["city"]], key="voter_id")
    assert sorted((r["_rid_a"], r["_rid_b"]) for r in links.collect()) == [(v, v + 1000000) for v in range(5, 15000, 20)]


def test_level_counts_are_those_of_all_pairs(spark):
    a, b = fixtures.snapshots(spark, SF)
    want = linkage.gammas(a.select(F.struct("*").alias("a")).crossJoin(b.select(F.struct("*").alias("b"))), ["full_name", "phone"], ["full_name"], ["dob_days"])
    got = linkage.level_counts(a, b, ["full_name", "phone"], ["full_name"], ["dob_days"])
    for v in ("full_name", "phone", "dob_days"):
        found = {r[0]: r["count"] for r in want.groupBy(f"g_{v}").count().collect()}
        assert got[v].tolist() == [found.get(k, 0) for k in range(3)]
    assert set(linkage.level_counts(a, b, ["full_name"], [], ["dob_days"], max_pairs=10)) == {"dob_days"}


def test_level_counts_leave_out_no_field_for_its_size(spark):
    # 51,840,000 pairs of values, which is beyond MAX_PAIRS
    n = 7200
    a, b = (spark.range(n).select((F.col("id") + more).alias("x")) for more in (0.0, 0.5))
    got = linkage.level_counts(a, b, [], [], ["x"], cut_number=1.0)
    assert got["x"].tolist() == [n * n - (2 * n - 1), 0, 2 * n - 1]
    names = lambda k, c: spark.range(n).selectExpr(f"concat('{c}', CAST(id + {k} AS string)) AS s")
    got = linkage.level_counts(names(10000, "aaaaaaaaaaaaaaaa"), names(20000, "bbbbbbbbbbbbbbbb"), ["s"], ["s"], [])
    assert got["s"].tolist() == [n * n, 0, 0]


def test_level_counts_of_odd_values_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["", "a", "aa", "ab", "ba", "anna", "hanna", "\u00e4\u00f6", "\U0001f600x", "\U0001f600y", "\U0001f601\U0001f600", "a1", "1a", "aaaaaaaaaaab", None]
    words += ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    x = [0.0, -0.0, 1.0, 1.5, 2.0, 3.0, 1e18, 1e18 + 1000, -2.5, float("inf"), float("-inf"), float("nan"), None]
    a, b = (spark.createDataFrame([(rng.choice(words), rng.choice(x)) for _ in range(120)], "s string, x double") for _ in "ab")
    pairs = a.select(F.struct("*").alias("a")).crossJoin(b.select(F.struct("*").alias("b")))
    for cuts in ({}, {"cut": 0.75, "cut_partial": 0.6, "cut_number": 1.0}, {"cut": 0.2, "cut_partial": 0.0, "cut_number": 0.5}, {"cut": 1.0, "cut_number": -1.0}):
        for partial in (["s"], []):
            want, got = linkage.gammas(pairs, ["s"], partial, ["x"], **cuts), linkage.level_counts(a, b, ["s"], partial, ["x"], **cuts)
            for v in "sx":
                found = {r[0]: r["count"] for r in want.groupBy(f"g_{v}").count().collect()}
                assert got[v].tolist() == [found.get(k, 0) for k in range(3)], (v, cuts, partial)


@pytest.mark.parametrize("name", ["vrmatch", "adjust_vrmatch", "vrmatch_changes", "vrmatch_performance"])
def test_the_audit_where_linked_rows_have_twins(spark, tmp_path, name):
    import duckdb

    # 60000 is the period in which name, city and birth date repeat; 180000 that of the phone as well
    con = duckdb.connect()
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", None)):
        change = f"REPLACE ({key} + shift AS {key}), " if key else ""
        shifts = "(VALUES (0), (60000), (180000)) t(shift)" if table in ("customer", "part") else "(VALUES (0)) t(shift)"
        con.execute(f"COPY (SELECT * EXCLUDE (shift) {change.rstrip(', ')} FROM '{SF}/{table}.parquet', {shifts}) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    exact = lambda found: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found), key=repr)
    assert exact(entry.queries()[name](spark, str(tmp_path)).collect()) == exact(con.execute(entry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["vrmatch", "adjust_vrmatch", "vrmatch_changes", "vrmatch_performance"])
def test_the_audit_where_a_neighbour_has_the_better_pattern(spark, tmp_path, name):
    import duckdb

    # five customers share a birth date; "cod plate" is less like its own "cold plate" than the neighbour's "ol plate" is
    con = duckdb.connect()
    old = "/root/testdata/sf0.1"
    keys = "(SELECT r + 20000 * k AS v FROM range(10500, 10900) r(r), range(5) k(k))"
    made = {
        "customer": f"SELECT v AS c_custkey, c_nationkey, c_mktsegment FROM {keys} JOIN '{old}/customer.parquet' ON c_custkey = v * 31 % 14983",
        "part": f"SELECT v AS p_partkey, CASE v WHEN 10625 THEN 'cold plate' WHEN 30625 THEN 'old plate' ELSE p_name END AS p_name FROM {keys} JOIN '{old}/part.parquet' ON p_partkey = v * 37 % 19997",
        "supplier": f"SELECT * FROM '{old}/supplier.parquet' WHERE s_suppkey < 100",
        "nation": f"SELECT * FROM '{old}/nation.parquet'",
    }
    for table, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    exact = lambda found: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found), key=repr)
    assert exact(entry.queries()[name](spark, str(tmp_path)).collect()) == exact(con.execute(entry.oracle_sql()[name]).fetchall())


def test_a_row_whose_best_is_taken_gets_the_next(spark):
    s = "a struct<id:string,v:string>, b struct<id:string,v:string>, posterior double, _rid_a long, _rid_b long"
    found = [(1, 11, 0.9), (1, 12, 0.8), (1, 15, 0.75), (2, 11, 0.95), (3, 12, 0.85), (3, 13, 0.7), (4, 13, 0.6), (None, 14, 0.9)]
    links = spark.createDataFrame([((str(x), "x"), (str(y), "y"), p, x, y) for x, y, p in found], s)
    assert rows(linkage.one_to_one(links).select("_rid_a", "_rid_b")) == [(1, 15), (2, 11), (3, 12), (4, 13), (None, 14)]


def test_a_row_of_nulls_and_lost_rows_are_told(spark):
    a = frame(spark, [("1", "p")])
    with pytest.raises(ConservationError):
        audit.assert_match(made(spark, [], [("1", "p"), ("2", "q")]), a)
    with pytest.raises(ConservationError):
        audit.assert_match(made(spark, [], [(None, None)]), a)


def test_exact_samples_of_repeated_rows(spark):
    df = frame(spark, [("1", "same")] * 300 + [(str(i), "x") for i in range(300)]).repartition(7)
    from rolltrace.operators.match import exact_sample

    for size in (0, 1, 250, 599, 600, 900):
        got = exact_sample(df, ["id", "v"], 5, "a", size=size)
        assert got.count() == min(size, 600) and rows(got) == rows(exact_sample(df.repartition(2), ["id", "v"], 5, "a", size=size))


def test_half_a_row_of_a_sample_counts_as_one(spark):
    from rolltrace.operators.match import exact_sample

    for n, fraction, size in ((5, 0.1, 1), (25, 0.1, 3), (24, 0.1, 2), (45, 0.1, 5), (100, 0.145, 15), (4, 0.1, 0)):
        assert exact_sample(spark.range(n), ["id"], 1, "a", fraction=fraction).count() == size


def test_linkage_errors_are_not_hidden(spark, tmp_path, monkeypatch):
    a, b = frame(spark, [(str(i), "x") for i in range(4)]), frame(spark, [(str(i), "y") for i in range(4)])

    def lost(*args, **options):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(audit, "link", lost)
    with pytest.raises(RuntimeError):
        audit.match_pair(a, b, str(tmp_path), ["v"], ["v"])
